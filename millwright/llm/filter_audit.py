"""How document filters interact: what each removes, alone and behind every order of the others.

A table-driven transducer reads a batch of texts once, byte by byte: a byte's class and the state before it look up the
next state and what is emitted (a word begins or ends, a code point, a capital, a symbol). The word spans go into a hash
table that compares the bytes of words with equal hashes, so different words never count as one.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, tidy
from .tokens import by_size

FILTERS = "ABCDE"
MIN_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 3, b"#$%&*|"
SLICE_BYTES, CHUNK_BYTES = 2 << 20, 1 << 20

# classes of bytes; 0xFF, which UTF-8 hasn't, ends a text
SPACE, CAPITAL, SYMBOL, INNER, OTHER, END = range(6)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE
CLASS[np.arange(ord("A"), ord("Z") + 1)] = CAPITAL
CLASS[list(SYMBOLS)] = SYMBOL
CLASS[0x80:0xC0] = INNER
CLASS[0xFF] = END
#: State behind a byte of each class: 0 between words, 1 in a word.
STATE = np.array([0, 1, 1, 1, 1, 0], np.uint8)
BEGINS, ENDS, POINT, IS_CAPITAL, IS_SYMBOL = 1, 2, 4, 8, 16
_SIGNS = np.array([POINT, POINT | IS_CAPITAL, POINT | IS_SYMBOL, 0, POINT, 0], np.uint8)
#: What is emitted in each state for each class.
EMITTED = np.stack([_SIGNS | np.where(STATE > 0, BEGINS, 0).astype(np.uint8), _SIGNS | np.where(STATE == 0, ENDS, 0).astype(np.uint8)])

BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2^64
MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(BASE, CHUNK_BYTES), _powers(pow(BASE, -1, 1 << 64), CHUNK_BYTES)


def _chunks(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes make up some CHUNK_BYTES, one row at least."""
    until, start = np.cumsum(size), 0
    while start < len(size):
        before = int(until[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(until, before + CHUNK_BYTES, side="right")))
        yield start, end
        start = end


def _hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of each span: differences of a running polynomial, moved to a common place."""
    out = np.empty(len(begin), np.uint64)
    for a, b in _chunks(np.diff(begin, append=end[-1:])):
        first, n = begin[a], int(end[b - 1] - begin[a])
        up, down = (_UP, _DOWN) if n <= CHUNK_BYTES else (_powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n))
        running = np.zeros(n + 1, np.uint64)
        np.cumsum((raw[first : first + n].astype(np.uint64) + np.uint64(1)) * up[:n], out=running[1:])
        out[a:b] = (running[end[a:b] - first] - running[begin[a:b] - first]) * down[begin[a:b] - first]
    return out


def _equal(raw: np.ndarray, left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the bytes from left equal those from right."""
    out = np.empty(len(left), bool)
    for a, b in _chunks(length):
        n = length[a:b]
        until = np.cumsum(n)
        at = np.arange(until[-1]) - np.repeat(until - n, n)
        differ = raw[np.repeat(left[a:b], n) + at] != raw[np.repeat(right[a:b], n) + at]
        out[a:b] = ~np.logical_or.reduceat(differ, until - n)
    return out


def first_words(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each span is the first of its text with its bytes. All spans probe an open table at once; one that meets
    another word goes on to the next place, as every equal span does."""
    new = np.zeros(len(begin), bool)
    if not len(begin):
        return new
    length = end - begin
    key = (_hashes(raw, begin, end) ^ (doc.astype(np.uint64) << np.uint64(40)) ^ length.astype(np.uint64)) * MIX
    key ^= key >> np.uint64(29)
    key *= MIX
    bits = (2 * len(begin)).bit_length()
    place, taken, mask = (key >> np.uint64(64 - bits)).astype(np.int64), np.full(1 << bits, -1, np.int64), (1 << bits) - 1
    waiting = np.arange(len(begin))
    while len(waiting):
        at = place[waiting]
        free = np.flatnonzero(taken[at] < 0)[::-1]  # of several the last assignment stays, so the first span comes last
        taken[at[free]] = waiting[free]
        owner = taken[at]
        own = owner == waiting
        new[waiting[own]] = True
        alike = np.flatnonzero(~own & (key[owner] == key[waiting]) & (length[owner] == length[waiting]) & (doc[owner] == doc[waiting]))
        done = own
        if len(alike):
            done[alike] = _equal(raw, begin[owner[alike]], begin[waiting[alike]], length[waiting[alike]])
        waiting = waiting[~done]
        place[waiting] = (place[waiting] + 1) & mask
    return new


def counts(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """words, different words, capitals, code points and symbols of each text."""
    raw = np.frombuffer(b"".join(x for t in texts for x in (t, b"\xff")), np.uint8)
    kind = CLASS[raw]
    before = np.zeros(len(raw), np.uint8)
    before[1:] = STATE[kind[:-1]]
    signs = EMITTED[before, kind]
    stop = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    start = np.concatenate([[0], stop[:-1]])
    summed = lambda bit: np.add.reduceat((signs & bit) > 0, start, dtype=np.int64)
    words = summed(BEGINS)
    begin, end, doc = np.flatnonzero(signs & BEGINS), np.flatnonzero(signs & ENDS), np.repeat(np.arange(len(texts)), words)
    distinct = np.bincount(doc[first_words(raw, begin, end, doc)], minlength=len(texts))
    return words, distinct, summed(IS_CAPITAL), summed(POINT), summed(IS_SYMBOL)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest (of the text) and the five counts of each row; a null text is an empty one, a null lang the
    part ''. Rows that are alike keep a row each; other columns aren't read; an empty table gives an empty one."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "part", "digest", "n_words", "n_distinct", "n_capitals", "n_points", "n_symbols"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_size(b, 2, SLICE_BYTES):
                texts = part.column(2).cast(pa.binary()).to_pylist()
                digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), digests, *map(pa.array, counts(texts))], names=names)

    given = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return given.mapInArrow(tidy(run), f"doc_id {kind}, part string, digest binary, " + ", ".join(f"{n} long" for n in names[3:]))


def classes(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bit i set if filter i of FILTERS fails), good, toxic (booleans), n: documents counted by what they
    fail. E, of a text that a smaller doc_id has too, fails all of a text's rows but those of its smallest doc_id; a null
    doc_id is larger than all others, and no smaller than another null. A doc_id with several labels is good or toxic
    if one of them says so; one without labels, or with nulls, is neither."""
    bits = [F.col("n_words") < MIN_WORDS, 100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words"), 100 * F.col("n_capitals") > MOST_CAPITALS * F.col("n_points"), F.col("n_symbols") > 0]
    fails = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(bits)), F.lit(0))
    marks = labels.groupBy(F.col("doc_id").alias("labelled")).agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    each = measured(docs).select("doc_id", "part", "digest", fails.alias("fails"))
    marked = each.join(marks, F.col("doc_id") == F.col("labelled"), "left")
    group = ["digest", "part", "fails", "good", "toxic"]
    by_id = marked.groupBy("doc_id", *(F.coalesce(c, F.lit(False)).alias(c) if c in ("good", "toxic") else F.col(c) for c in group)).agg(F.count("*").alias("n"))
    lowest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n")).alias("low")  # a text's copies meet here as sums of each task
    by_text = by_id.groupBy(*group).agg(F.sum("n").alias("n"), lowest)
    least = F.min(F.struct("low.none", "low.doc_id")).over(Window.partitionBy("digest"))
    kept = F.when(F.struct("low.none", "low.doc_id") == F.col("least"), F.col("low.n")).when(F.col("low.none") & F.col("least.none"), F.col("low.n")).otherwise(0)
    split = by_text.withColumn("least", least).withColumn("first", kept)
    two = F.explode(F.array(F.struct(F.col("first").alias("n"), F.lit(0).alias("more")), F.struct((F.col("n") - F.col("first")).alias("n"), F.lit(16).alias("more"))))
    return split.select("part", "fails", "good", "toxic", two.alias("x")).groupBy("part", (F.col("fails") + F.col("x.more")).alias("fails"), "good", "toxic").agg(F.sum("x.n").alias("n"))


def audit(spark: SparkSession, counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """counted (part, fails, good, toxic, n), as classes gives it -> a row for each part, order of the filters and step.

    What a step removes depends on its filter and the set of those before it alone, so k * 2^(k-1) sums of each part
    serve all k! orders. A part without rows has none; an empty table gives an empty one.
    """
    k = len(filters)
    behind = F.explode(F.sequence(F.lit(0), F.lit(k * (1 << k) - 1))).alias("x")
    cases = counted.select("*", behind).withColumn("f", F.col("x") % k).withColumn("prior", F.floor(F.col("x") / k).cast("int"))
    cases = cases.withColumn("bit", F.expr("shiftleft(1, f)")).where("prior & bit = 0")
    count = lambda when: F.sum(F.when(F.expr(when), F.col("n")).otherwise(0))
    removed, sums = "fails & bit <> 0 and fails & prior = 0", {}
    sums |= {"kept": "fails & (prior | bit) = 0", "removed": removed, "redundant": "fails & bit <> 0 and fails & prior <> 0", "unique_fails": "fails = bit"}
    sums |= {"good_lost": f"good and {removed}", "toxic_lost": f"toxic and {removed}"}
    summed = cases.groupBy("part", "f", "prior").agg(*(count(when).alias(n) for n, when in sums.items()))
    ways = F.element_at(F.array(*(F.lit(math.factorial(i) * math.factorial(k - 1 - i)) for i in range(k))), F.bit_count("prior") + 1)
    summed = summed.withColumn("shapley", F.sum(F.col("removed") * ways).over(Window.partitionBy("part", "f")))
    steps = []
    for order in itertools.permutations(range(k)):
        for i, f in enumerate(order):
            steps.append(("".join(filters[x] for x in order), i + 1, f, sum(1 << x for x in order[:i])))
    steps = spark.createDataFrame(steps, "filter_order string, step int, f int, prior int")
    return summed.join(F.broadcast(steps), ["f", "prior"]).select("part", "filter_order", "step", *sums, "shapley")  # k * k! rows


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark, classes(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


ORACLE = """
WITH split AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
         doc_id > min(doc_id) OVER (PARTITION BY text) AS e
  FROM split LEFT JOIN marks USING (doc_id)),
counted AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS fails, good, toxic, count(*) AS n
  FROM flags GROUP BY ALL),
letters AS (SELECT unnest([0, 1, 2, 3, 4]) AS f, unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.f, b.f, c.f, d.f, e.f] AS fs
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (
  SELECT filter_order, step::INT AS step, 1 << fs[step] AS bit, list_sum(list_transform(fs[1:step - 1], lambda x: 1 << x)) AS before
  FROM orders, range(1, 6) AS r(step)),
summed AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN fails & (coalesce(before, 0)::INT | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN fails & bit <> 0 AND fails & coalesce(before, 0)::INT = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN fails & bit <> 0 AND fails & coalesce(before, 0)::INT <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN good AND fails & bit <> 0 AND fails & coalesce(before, 0)::INT = 0 THEN n ELSE 0 END) AS good_lost,
         sum(CASE WHEN toxic AND fails & bit <> 0 AND fails & coalesce(before, 0)::INT = 0 THEN n ELSE 0 END) AS toxic_lost
  FROM counted, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM summed
"""
