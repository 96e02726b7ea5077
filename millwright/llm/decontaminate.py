"""Benchmark decontamination through a positional inverted index.

The index is cut by document: each shard, some four million words of whole documents, has one posting list for each term
in it, holding the word positions of the term within the shard. It is stored once and serves any test items. Documents
stand SLOP + WINDOW apart, so no phrase crosses their border. A search takes the terms of a window from the rarest in
the corpus on, subtracts each term's offset from its positions, and intersects the lists until one is empty or all terms
are used: what is left is where the phrase starts. With slack, the same gives the proximity matches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hidden, stored, table, tidy, with_row

WINDOW, SLOP = 13, 3
SHARD_WORDS = 4_000_000
#: Items are searched for in blocks of so many words of theirs, which bounds what a task is sent.
BLOCK_WORDS = 1_000_000
#: A byte of UTF-8 as words have it: A-Z lower-cased, ASCII other than letters and digits blank.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def build_index(docs: DataFrame, gap: int = WINDOW + SLOP) -> DataFrame:
    """shard, term, n, positions (int32) of each term in each shard, and for each shard a row without a term: n is the
    shard's number of documents, positions their first positions and numbers of words, doc_ids their ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, shards = TaskContext.get().partitionId(), 0
        ids, sizes, codes, terms = [], [], [], {}
        id_type, n_words = pa.null(), 0

        def shard() -> Iterator[pa.RecordBatch]:
            n = np.array(sizes, np.int64)
            starts = np.cumsum(n + gap) - n - gap
            code = np.array(codes, np.int32)
            place = (np.arange(len(code)) + np.repeat(np.arange(len(n)) * gap, n)).astype(np.int32)
            order = np.argsort(code, kind="stable")
            ends = np.append(0, np.cumsum(np.bincount(code, minlength=len(terms))))
            head = starts.astype("<i4").tobytes() + n.astype("<i4").tobytes()
            name, id_list = f"{task}-{shards}", pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids, id_type))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.nulls(1, pa.binary()), pa.array([len(ids)]), pa.array([head]), id_list], names=["shard", "term", "n", "positions", "doc_ids"])
            lists = pa.Array.from_buffers(pa.binary(), len(terms), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(place[order].tobytes())])
            whole = pa.RecordBatch.from_arrays([pa.array([name] * len(terms), pa.string()), pa.array(list(terms), pa.binary()), pa.array(np.diff(ends)), lists, pa.nulls(len(terms), pa.list_(id_type))], names=["shard", "term", "n", "positions", "doc_ids"])
            for i in range(0, len(terms), 20_000):
                yield whole.slice(i, 20_000)

        for b in batches:
            id_type = b.schema.field(0).type
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(text)
                codes += [terms.setdefault(w, len(terms)) for w in words]
                ids.append(doc_id)
                sizes.append(len(words))
                n_words += len(words) + gap
                if n_words >= SHARD_WORDS:
                    yield from shard()
                    shards, n_words = shards + 1, 0
                    ids, sizes, codes, terms = [], [], [], {}
        if ids:
            yield from shard()

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"shard string, term binary, n long, positions binary, doc_ids array<{kind}>")


def phrase_starts(lists: dict[bytes, np.ndarray], terms: list[bytes], rarest: list[int]) -> np.ndarray:
    """Where the terms stand one after another; rarest: their places in the phrase, in the order of search."""
    starts = None
    for i in rarest:
        positions = lists.get(terms[i])
        if positions is None:
            return np.zeros(0, np.int32)
        if starts is None:
            starts = positions - np.int32(i)
        else:
            want = starts + np.int32(i)
            k = np.searchsorted(positions, want)
            k[k == len(positions)] = 0
            starts = starts[positions[k] == want]
        if not len(starts):
            break
    return starts


def near_starts(lists: dict[bytes, np.ndarray], terms: list[bytes], rarest: list[int], slop: int) -> np.ndarray:
    """Where all terms stand within slop words of their places, from where the rarest one stands."""
    starts = None
    for i in rarest:
        positions = lists.get(terms[i])
        if positions is None:
            return np.zeros(0, np.int32)
        if starts is None:
            starts = positions - np.int32(i)
        else:
            low = np.searchsorted(positions, starts + np.int32(i - slop))
            k = np.minimum(low, len(positions) - 1)
            starts = starts[(low < len(positions)) & (positions[k] <= starts + np.int32(i + slop))]
        if not len(starts):
            break
    return starts


def search(index: DataFrame, items: list[tuple[int, list[bytes]]], frequency: dict[bytes, int], id_type: str, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """shard, place, doc_id, n_words, runs (item, start, end within the document; of exact windows), near (items of
    which only proximity matches were found) of each document. index: rows of the items' terms and those without one."""
    spark = index.sparkSession
    windows: dict[bytes, list[tuple[int, list[bytes], list[int]]]] = {}  # by rarest term: a shard looks at those whose it has
    for item, words in items:
        for at in range(max(1, len(words) - window + 1)):
            part = words[at : at + window]
            order = sorted(range(len(part)), key=lambda i: (frequency.get(part[i], 0), i))  # noqa: B023
            windows.setdefault(part[order[0]], []).append((item, part, order))
    sent = spark.sparkContext.broadcast(windows)  # bounded by BLOCK_WORDS
    schema = f"shard string, place int, doc_id {id_type}, n_words long, runs array<struct<item:int,start:int,end:int>>, near array<int>"

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        head = rows[rows["term"].isna()].iloc[0]
        n, table_ = int(head["n"]), head["positions"]
        starts, sizes = np.frombuffer(table_, "<i4", n), np.frombuffer(table_, "<i4", n, 4 * n)
        lists = {t: np.frombuffer(p, "<i4") for t, p in zip(rows["term"], rows["positions"], strict=True) if t is not None}
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        close: set[tuple[int, int]] = set()
        for term in lists.keys() & sent.value.keys():
            for item, part, order in sent.value[term]:
                exact = phrase_starts(lists, part, order)
                for s, d in zip(exact.tolist(), (np.searchsorted(starts, exact, side="right") - 1).tolist(), strict=True):
                    found.setdefault((d, item), []).append((s - int(starts[d]), s - int(starts[d]) + len(part)))
                loose = near_starts(lists, part, order, slop)
                docs = np.clip(np.searchsorted(starts, loose + len(part), side="right") - 1, 0, None)
                close.update((d, item) for d in docs.tolist())
        runs: list[list[dict]] = [[] for _ in range(n)]
        near: list[list[int]] = [[] for _ in range(n)]
        for (d, item), spans in sorted(found.items()):
            held: list[list[int]] = []
            for a, e in sorted(spans):
                if held and a <= held[-1][1]:
                    held[-1][1] = max(held[-1][1], e)
                else:
                    held.append([a, e])
            runs[d] += [{"item": item, "start": a, "end": e} for a, e in held]
        for d, item in sorted(close - found.keys()):
            near[d].append(item)
        return pd.DataFrame({"shard": head["shard"], "place": range(n), "doc_id": pd.Series(list(head["doc_ids"]), dtype="object"), "n_words": sizes.astype(np.int64), "runs": runs, "near": near})

    return index.groupBy("shard").applyInPandas(find, schema)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, runs, near (see search).

    A window is `window` consecutive words of an item; an item of fewer, but not none, is one window. Null and empty
    texts have no words; items without words match nothing; items that share an item_id count as one; a null item_id is
    written as an empty string. Repeated and null doc_ids keep a row each. Other columns aren't read. An empty benchmark
    leaves runs and near empty; empty docs give an empty table.
    """
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    n_words = F.length("text")  # at least twice the words
    total = benchmark.agg(F.sum(n_words)).first()[0] or 0
    blocks = max(1, -(-total // (2 * BLOCK_WORDS)))
    index = stored(build_index(docs, window + slop), "postings")
    results = []
    for k in range(blocks):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        given = [(r[0] or "", w) for r in part.select(F.col("item_id").cast("string"), "text").toLocalIterator() if (w := words_of(r[1]))]
        names = sorted({item for item, _ in given})
        number = {x: i for i, x in enumerate(names)}
        items = [(number[item], w) for item, w in given]
        terms = spark.createDataFrame([(bytearray(t),) for t in sorted({t for _, w in items for t in w})], "term binary")
        wanted = index.join(F.broadcast(terms), "term", "left_semi")  # bounded by BLOCK_WORDS
        frequency = {bytes(r[0]): r[1] for r in wanted.groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator()}  # a row for each term of the block
        found = search(wanted.union(index.where("term is null").select(*wanted.columns)), items, frequency, id_type, window, slop)
        named = F.from_json(F.lit(json.dumps(names)), "array<string>")  # one constant, however many names
        runs = F.transform("runs", lambda r: F.struct(F.get(named, r["item"]).alias("item"), r["start"].alias("start"), r["end"].alias("end")))
        results.append(found.withColumn("runs", runs).withColumn("near", F.transform("near", lambda x: F.get(named, x))))
    if blocks == 1:
        return results[0].drop("shard", "place")
    both = reduce(DataFrame.unionByName, results)
    return both.groupBy("shard", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")).drop("shard", "place")


def contamination(found: DataFrame, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted), n_items, contaminated (at least one word in `share` is hit), n_near."""
    ordered = F.expr("array_sort(transform(runs, r -> struct(r.start as s, r.end as e)))")
    covered = F.expr("aggregate(spans, struct(0L as n, 0 as upto), (a, r) -> struct(a.n + greatest(0, r.e - greatest(r.s, a.upto)) as n, greatest(a.upto, r.e) as upto), a -> a.n)")
    out = found.withColumn("spans", ordered).withColumn("n_hit", covered.cast("long")).withColumn("items", F.array_sort(F.array_distinct(F.col("runs.item"))))
    return out.select("doc_id", "n_words", "n_hit", "items", F.size("items").cast("long").alias("n_items"), ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), F.size("near").cast("long").alias("n_near"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without its contaminated rows, each found by itself: neither null nor shared doc_ids matter, nor the names
    of other columns."""
    given, columns = hidden(docs, "text")
    rows = with_row(given)
    found = contamination(matches(rows.select(F.col("_row").alias("doc_id"), "text"), benchmark))
    bad = stored(found.where("contaminated").select(F.col("doc_id").alias("_bad_row")), "contaminated")
    return rows.join(bad, F.col("_row") == F.col("_bad_row"), "left_anti").select(columns)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated", "n_near")
