"""Line de-duplication by a segment-partition edit join.

Lines that differ by at most `edits` edits are linked; of short lines fewer edits: none below 12 characters of the
shorter line, one below 24. All such links are found, whatever the edits touch, and lines that links lead to are one
class of near lines. Which of them go as copies is a matter of what the edits touch: an edit is a slip, not another
statement, if it leaves the same words and touches case, blanks, punctuation, or the inside of a word of LONG letters or
more, once (or two letters there trade places). Numbers and what they stand with, short words, first and last letters and
other signs are a line's skeleton, which all lines of a statement share.

Cut a line into edits + 1 segments: a line within `edits` edits of it holds one of them unchanged, near its place. So each
line is indexed under its segments, with its length and the segment's number, and is looked up under those of its substrings
that can be a segment of a line as long or up to `edits` shorter; the places that can hold one follow from the edits
that are possible before and after it. Where many lines meet under a key, they meet again by segments of what is left of
them without the one they share, until few meet. Those are verified by a banded bit-parallel automaton.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import components, hidden, stored, table, tidy, with_row

#: Most edits between lines of one class: one for each so many characters of the shorter line, EDITS at most.
EDITS, CHARS_AN_EDIT = 2, 12
BLANK = " \t\n\x0b\x0c\r"
#: Letters of a word within which an edit is a slip.
LONG = 6
#: Lines that meet under one key and are compared with each other; more meet anew by what else they share.
MANY = 256
WORDLIKE = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
DIGIT, PART, SENTENCE_MARKS = re.compile(r"\d"), re.compile(r"[^\W\d_]+|[^\w\s.,;:!?'\"()\[\]{}…–—*-]"), ".,;:!?'\"()[]{}…"


def segments(length: int, n: int) -> list[tuple[int, int]]:
    """Start and size of n segments of even size, the longer ones last."""
    size, longer = divmod(length, n)
    sizes = [size] * (n - longer) + [size + 1] * longer
    return [(sum(sizes[:i]), s) for i, s in enumerate(sizes)]


def allowed(length: int, edits: int) -> int:
    return min(edits, length // CHARS_AN_EDIT)


def parts(line: str) -> list[str]:
    """Words in small letters, signs that aren't punctuation, and what holds a digit as it stands, without the marks of
    a sentence around it."""
    if not DIGIT.search(line):
        return PART.findall(line.lower())
    out = []
    for x in line.split():
        out += ["=" + x.strip(SENTENCE_MARKS)] if DIGIT.search(x) else PART.findall(x.lower())
    return out


def skeleton(line: str) -> str:
    """The parts, long words by their first and last letter."""
    return " ".join([x if len(x) < LONG or x[0] == "=" else f"{x[0]}~{x[-1]}" for x in parts(line)])


def slip(a: str, b: str) -> bool:
    """Whether two words differ by one letter, or two letters beside each other that trade places."""
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    start = next((i for i in range(n) if a[i] != b[i]), n)
    end = next((i for i in range(n - start) if a[-1 - i] != b[-1 - i]), n - start)
    x, y = a[start : len(a) - end], b[start : len(b) - end]
    return len(x) <= 1 and len(y) <= 1 or len(x) == len(y) == 2 and x == y[::-1]


def same_statement(a: str, b: str) -> bool:
    """Of two lines with one skeleton: whether each word differs by a slip at most."""
    return all(x == y or slip(x, y) for x, y in zip(parts(a), parts(b), strict=True))


def places(length: int, other: int, most: int) -> list[tuple[int, int, int, bool]]:
    """Of a line of this length: number, start and end of what can be a segment of a line of the other length, as long or
    shorter, at most so many edits apart, and whether it is the line's own segment."""
    more, out = length - other, []
    for i, (s, size) in enumerate(segments(other, most + 1)):
        low = max(0, s - i, s + more - (most - i))
        high = min(length - size, s + i, s + more + (most - i))
        out += [(i, at, at + size, not more and at == s) for at in range(low, high + 1)]
    return out


def plan(length: int, edits: int) -> list[tuple[int, int, int, bool]]:
    """Of a line of this length: tag, start and end of what it is looked up under, and whether it is indexed there too.
    The shorter of two lines says how many edits they may be apart; a line that allows none needs no keys."""
    out = []
    for other in range(max(1, length - edits), length + 1):
        most = allowed(other, edits)
        if most and length - other <= most:
            out += [(other * (edits + 1) + i, s, e, own) for i, s, e, own in places(length, other, most)]
    return out


def within(a: str, b: str, edits: int) -> bool:
    """At most so many insertions, deletions and substitutions of characters apart. Bit e of state d: the first
    j + e - edits characters of a are within d edits of the first j of b."""
    if abs(len(a) - len(b)) > edits:
        return False
    x, y = np.array([*map(ord, a)], np.int32), np.array([*map(ord, b)], np.int32)
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    start = int(differ[0]) if len(differ) else n
    x, y = x[start:], y[start:]
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[len(x) - n :][::-1] != y[len(y) - n :][::-1])
    end = int(differ[0]) if len(differ) else n
    x, y = x[: len(x) - end], y[: len(y) - end]
    width = 2 * edits + 1
    padded = np.concatenate([np.full(edits, -1, np.int32), x, np.full(len(y) + width, -1, np.int32)])
    match = sum((padded[e : e + len(y)] == y).astype(np.int64) << e for e in range(width))
    full, state = (1 << width) - 1, [0] * (edits + 1)
    state[0] = 1 << edits
    for d in range(1, edits + 1):
        state[d] = state[d - 1] | state[d - 1] << 1 & full
    for m in match.tolist():
        new = [state[0] & m]
        for d in range(1, edits + 1):
            new.append((state[d] & m | state[d - 1] | state[d - 1] >> 1 | new[d - 1] << 1) & full)
        state = new
        if not state[edits]:
            return False
    return bool(state[edits] >> (len(x) - len(y) + edits) & 1)


def _groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Batches sorted by key, cut anew so that none ends within a group."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        goes_on = bool(held) and held[-1][key].iloc[-1] == b[key].iloc[-1]  # all of the batch is of the held group
        held.append(b)
        if not goes_on:
            whole = pd.concat(held, ignore_index=True)
            k = whole[key].to_numpy()
            if end := int(np.searchsorted(k, k[-1])):
                yield whole.iloc[:end]
            held = [whole.iloc[end:].reset_index(drop=True)]
    if held:
        yield pd.concat(held, ignore_index=True)


def _lines(docs: DataFrame, *columns: str) -> DataFrame:
    """columns, line_no (from 0), line (trimmed), h of the lines that take part: those with a letter or a digit."""
    each = docs.select(*columns, F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line", F.btrim("line", F.lit(BLANK)))
    return each.where(F.col("line").rlike(r"[\p{L}\p{N}]")).withColumn("h", F.xxhash64("line"))


def line_links(docs: DataFrame, edits: int = EDITS, many: int = MANY) -> DataFrame:
    """src, dst (XXH64 of a line, seed 42), same: links between different lines `edits` edits or fewer apart, enough of
    them to lead from a line to all that it leads to; same: both are one statement, again enough of these. Null texts and
    lines of marks alone have none; an empty table gives an empty one. Where more than `many` lines meet under a key they
    meet anew, which changes the work, not the classes."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[int, tuple] = {}
        for b in batches:
            keys: list[int] = []
            hs: list[int] = []
            sizes: list[int] = []
            own: list[bool] = []

            def flush() -> pa.RecordBatch:
                h = np.repeat(np.array(hs, np.uint64).view(np.int64), sizes)  # noqa: B023
                out = pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(h), pa.array(own, pa.bool_())], names=["key", "h", "own"])  # noqa: B023
                for x in (keys, hs, sizes, own):  # noqa: B023
                    x.clear()
                return out

            for line in _different(b.column(0).to_pylist()):
                n, raw = len(line), line.encode()
                if n not in plans:
                    if len(plans) > 20_000:
                        plans.clear()
                    found = plan(n, edits)
                    plans[n] = [x[:3] for x in found], [x[3] for x in found]
                at, is_own = plans[n]
                keys += [xxh64_intdigest(raw[s:e], t) for t, s, e in at] if len(raw) == n else [xxh64_intdigest(line[s:e].encode(), t) for t, s, e in at]
                own += is_own
                hs.append(xxh64_intdigest(raw, 42))
                sizes.append(len(at))
                if len(keys) > 50_000:
                    yield flush()
            if keys:
                yield flush()

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The groups that hold an indexed line and another one: under a hash of their lines, or, of many, their key."""
        for b in _groups(batches, "key"):
            sets = [pd.DataFrame({"met": m, "h": lines, "many": more}) for m, lines, more, _, _ in _meetings(b, many)]
            if sets:
                yield pd.concat(sets, ignore_index=True).drop_duplicates()

    def rests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What is left of lines that meet with many, without what they share."""
        for b in batches:
            out = []
            for key, h, line in zip(b["met"].tolist(), b["h"].tolist(), b["line"].tolist(), strict=True):
                for t, s, e, own in plan(len(line), edits):
                    if xxh64_intdigest(line[s:e].encode(), t) == key % (1 << 64):
                        out.append((key, h, own, line[:s] + line[e:], t // (edits + 1) - (e - s), allowed(t // (edits + 1), edits)))
            yield pd.DataFrame(out, columns=["key", "h", "own", "rest", "other", "most"])

    def anew(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Keys by segments of rests."""
        for b in batches:
            out = []
            for key, h, own, rest, other, most in b.itertuples(index=False, name=None):
                for i, s, e, first in places(len(rest), other, most):
                    k = _signed(xxh64_intdigest(rest[s:e].encode(), (key + i) % (1 << 64)))
                    out.append((k, h, own and first, rest[:s] + rest[e:], other - (e - s), most))
            yield pd.DataFrame(out, columns=["key", "h", "own", "rest", "other", "most"])

    def met_anew(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """As met, with the rests of many. Indexed lines of which no more is left than they may differ by are all alike;
        these and the lines that are looked up there are compared, however many they are."""
        for b in _groups(batches, "key"):
            out = []
            for m, lines, more, start, end in _meetings(b, many):
                if more and b["other"].iat[start] > b["most"].iat[start]:
                    out.append(b.iloc[start:end].assign(many=True))
                else:
                    m = _signed(xxh64_intdigest(lines.tobytes()))
                    out.append(pd.DataFrame({"key": m, "h": lines, "own": False, "rest": "", "other": 0, "most": 0, "many": False}))
            if out:
                yield pd.concat(out, ignore_index=True)

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _groups(batches, "met"):
            links: list[tuple[int, int, bool]] = []
            for _, g in b.groupby("met", sort=False):
                links += _forest(g["h"].tolist(), g["line"].tolist(), edits)
            yield pd.DataFrame(links, columns=["src", "dst", "same"]).astype({"src": np.int64, "dst": np.int64, "same": bool})

    keys = docs.select("text").mapInArrow(tidy(keyed), "key long, h long, own boolean")
    together = stored(keys.repartition("key").sortWithinPartitions("key").mapInPandas(tidy(met), "met long, h long, many boolean").distinct(), "lines-that-meet")
    texts = _texts(docs, together.select("h").distinct())
    few = together.where("not many").select("met", "h")
    rows_of = "key long, h long, own boolean, rest string, other int, most int"
    rows = together.where("many").join(texts, "h").select("met", "h", "line").mapInPandas(tidy(rests), rows_of)
    while not together.where("many").isEmpty():
        keys = rows.mapInPandas(tidy(anew), rows_of)
        together = stored(keys.repartition("key").sortWithinPartitions("key").mapInPandas(tidy(met_anew), rows_of + ", many boolean"), "lines-that-meet-again")
        few = few.union(together.where("not many").select("key", "h"))
        rows = together.where("many").drop("many")
    with_text = few.distinct().join(texts, "h")
    return stored(with_text.repartition("met").sortWithinPartitions("met").mapInPandas(tidy(linked), "src long, dst long, same boolean").distinct(), "links-of-lines")


def line_classes(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """h (XXH64 of a line, seed 42), class: for each line that has another one `edits` slips or fewer apart; class is the
    smallest h that it leads to. Null texts and lines of marks alone have none; an empty table gives an empty one."""
    return _classes(line_links(docs, edits).where("same"))


def _classes(links: DataFrame) -> DataFrame:
    return components(links.select("src", "dst")).select(F.col("node").alias("h"), F.col("component").alias("class"))


def _meetings(b: pd.DataFrame, many: int) -> Iterator[tuple[int, np.ndarray, bool, int, int]]:
    """Of rows sorted by key: of each group that holds an indexed line and another one a hash of its lines, these,
    whether they are more than many (then the key instead of the hash), and the rows' start and end."""
    key, h, own = (b[c].to_numpy() for c in ("key", "h", "own"))
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    end = np.append(start[1:], len(key))
    low, high = np.minimum.reduceat(h, start), np.maximum.reduceat(h, start)
    for i in np.flatnonzero((low != high) & np.logical_or.reduceat(own.astype(bool), start)).tolist():
        lines = np.unique(h[start[i] : end[i]])
        if len(lines) > many:
            yield int(key[start[i]]), lines, True, int(start[i]), int(end[i])
        else:
            yield _signed(xxh64_intdigest(lines.tobytes())), lines, False, int(start[i]), int(end[i])


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def _different(texts: list[str | None]) -> list[str]:
    """The different lines of some texts that edits may touch, but for those of ASCII marks alone."""
    return list({x for text in texts for line in (text or "").split("\n") if len(x := line.strip(BLANK)) >= CHARS_AN_EDIT and WORDLIKE.search(x)})


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """h, line of the lines whose h is wanted, but for those of marks alone. The texts are read again, and a bitmap of
    the wanted lines, 4 MB at most, tells most others from them before the join."""
    bits, bitmap = _bitmap(wanted)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = _different(b.column(0).to_pylist())
            h = np.fromiter((xxh64_intdigest(x.encode(), 42) for x in lines), np.uint64, len(lines))
            place = (h % np.uint64(bits)).astype(np.int64)
            hit = np.flatnonzero(sent.value[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)[hit]), pa.array([lines[i] for i in hit.tolist()], pa.string())], names=["h", "line"])

    found = docs.select("text").mapInArrow(tidy(kept), "h long, line string").where(F.col("line").rlike(r"[\p{L}\p{N}]"))
    return stored(found.join(wanted, "h", "left_semi").groupBy("h").agg(F.first("line").alias("line")), "texts-of-lines")


def _bitmap(wanted: DataFrame) -> tuple[int, np.ndarray]:
    """Bits set for the wanted h, by their remainder: 4 MB at most. What it lets through is joined exactly later, so
    where it fills up, that join shuffles more."""
    bits = 1 << min(25, max(16, (16 * wanted.count()).bit_length()))
    at = F.pmod("h", F.lit(bits))
    words = wanted.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(h, {bits}) % 64 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    bitmap = np.zeros(bits // 64, np.uint64)
    for r in words.toLocalIterator():
        bitmap[r["word"]] = r["bits"] % (1 << 64)
    return bits, bitmap


def _forest(hs: list[int], lines: list[str], edits: int) -> list[tuple[int, int, bool]]:
    """Spanning forests of the links between lines, of all (False) and of those within a statement (True). What two
    lines' counts of characters differ by is twice their distance at most, which rules most pairs out at once."""
    marks = np.zeros((len(lines), 64), np.int16)
    for i, x in enumerate(lines):
        marks[i] = np.bincount(np.frombuffer(x.encode("utf-32-le"), np.uint32) % 64, minlength=64).clip(max=32_000)
    sizes = np.array([*map(len, lines)])
    # the squares of these differences sum to 2 * edits ** 2 at most; lines that are near none but themselves are out
    counts, some = marks.astype(np.float64), []
    squares = (counts * counts).sum(axis=1)
    for at in range(0, len(lines), MANY):
        apart = squares[at : at + MANY, None] + squares - 2 * (counts[at : at + MANY] @ counts.T)
        some.append((apart <= 2 * edits * edits).sum(axis=1) > 1)

    def trees(rest: np.ndarray, alike: Callable[[str, str], bool]) -> Iterator[list[tuple[int, int]]]:
        while len(rest) > 1:
            queue, rest, links = [int(rest[0])], rest[1:], []
            while queue and len(rest):
                i = queue.pop()
                most = np.minimum(edits, np.minimum(sizes[rest], sizes[i]) // CHARS_AN_EDIT)
                close = np.flatnonzero(np.abs(sizes[rest] - sizes[i]) <= most)
                close = close[np.abs(marks[rest[close]] - marks[i]).sum(axis=1, dtype=np.int64) <= 2 * most[close]]
                near = [j for j, e in zip(rest[close].tolist(), most[close].tolist(), strict=True) if within(lines[i], lines[j], e) and alike(lines[i], lines[j])]
                links += [(i, j) for j in near]
                queue += near
                if near:
                    rest = rest[~np.isin(rest, near)]
            yield links

    out = []
    for links in trees(np.flatnonzero(np.concatenate(some)), lambda a, b: True):
        out += [(hs[i], hs[j], False) for i, j in links]
        forms: dict[str, list[int]] = {}
        for i in sorted({i for link in links for i in link}):
            forms.setdefault(skeleton(lines[i]), []).append(i)
        for form in forms.values():
            out += [(hs[i], hs[j], True) for tree in trees(np.array(form), same_statement) for i, j in tree]
    return out


def deduplicated(docs: DataFrame, edits: int = EDITS, near: bool = False) -> DataFrame:
    """docs (doc_id, text and any others) with n_lines, removed (line_no, first_doc), and text without the lines that
    are removed: those with a letter or a digit, blanks at the ends apart, whose class (of one statement) has an earlier
    line, by doc_id and then by place. first_doc: the document that keeps a line of the class.

    With near, also near (line_no, class): all lines that links of at most `edits` edits, slips or not, lead to or from,
    removed ones among them, with the smallest h (XXH64, seed 42) that they lead to.

    Lines of marks alone stay. Null texts have no lines and stay null. Each row is a document of its own, whatever its
    doc_id, of any type: of rows that share one the order is that in which they are read, and null doc_ids come before
    all others. Other columns come back unchanged, but for ones named n_lines, removed or, with it, near, which are replaced. An empty
    table gives an empty one. Lines are told apart by 64 bits: of 10**12 different lines, some 3 in 10**8 meet another.
    """
    given, columns = hidden(docs.drop("n_lines", "removed", *(["near"] if near else [])), "doc_id", "text")
    docs = with_row(given)
    links = line_links(docs, edits)
    classes = _classes(links.where("same"))
    if near:
        classes = stored(_classes(links).withColumnRenamed("class", "near").join(classes, "h", "left"), "classes")
    lines = _lines(docs, "doc_id", "_row").select("doc_id", "_row", "line_no", "h")
    place = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "_row", "line_no")
    of_class = stored(lines.join(classes, "h", "left").select(F.coalesce("class", "h").alias("class"), place.alias("place"), *(["near"] if near else [])), "line-classes")
    # combined before its shuffle, and written, so that the join can split a class that many lines are of
    kept = stored(of_class.groupBy("class").agg(F.min("place").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n"), "kept-lines")
    rows = of_class.join(kept, "class").where("place <> kept")
    removed = F.struct(F.col("place.line_no").alias("line_no"), F.col("kept.doc_id").alias("first_doc"))
    marked = rows.select(F.col("place._row").alias("_gone_row"), removed.alias("removed"))
    if near:
        of_near = of_class.where("near is not null").select(F.col("place._row").alias("_gone_row"), F.struct(F.col("place.line_no").alias("line_no"), F.col("near").alias("class")).alias("near"))
        marked = marked.unionByName(of_near, allowMissingColumns=True)
    lists = [F.sort_array(F.collect_list(c)).alias(n) for c, n in (("removed", "_gone"), ("near", "_near"))[: 1 + near]]
    gone = marked.groupBy("_gone_row").agg(*lists)
    joined = docs.join(gone, F.col("_row") == F.col("_gone_row"), "left")
    pieces = F.expr("transform(split(text, '\\n'), (x, i) -> struct(i as i, x as x))")
    numbers = F.expr("map_from_entries(transform(_gone, g -> struct(g.line_no as k, true as v)))")
    out = joined.withColumn("_numbers", numbers).withColumn("_n_lines", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)))
    left = F.array_join(F.transform(F.filter(pieces, lambda p: ~F.coalesce(F.try_element_at("_numbers", p.i), F.lit(False))), lambda p: p.x), "\n")
    out = out.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left))
    found = [F.coalesce(c, F.expr("array()")).alias(n) for c, n in (("_gone", "removed"), ("_near", "near"))[: 1 + near]]
    return out.select(*columns, F.col("_n_lines").alias("n_lines"), *found)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document, besides what went and what is left: how many of its lines have a near line, the classes of
    these, and how many of them stay."""
    found = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), near=True)
    firsts = F.array_distinct(F.col("removed.first_doc")).alias("first_docs")
    kept = [F.length("text").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")]
    near = [F.size("near").alias("n_near"), F.array_sort(F.array_distinct("near.class")).alias("near_classes"), F.size(F.array_except("near.line_no", "removed.line_no")).alias("n_near_kept")]
    return found.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), firsts, *kept, *near)
