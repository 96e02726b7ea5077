"""Token ids in a content-addressed store.

A rolling hash of the last 16 ids cuts each document's ids into chunks, wherever the same ids recur. The store holds
each different chunk once, under its BLAKE2b digest; a document is its recipe, the list of its chunks. Recipes lie in
ascending doc_id order in range-partitioned parts; the manifest has each part's counts and the root of the Merkle tree
over its recipes. The shared folder holds all three as Parquet:

    content/kind=chunk    chunk (digest), ids (little-endian uint16)
    content/kind=recipe   what each document was cut into, as it came
    recipes               part, place, doc_id, n_tokens, chunks, sizes, leaf: in ascending doc_id order
    manifest              part, n_docs, n_tokens, root
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_folder, table, tidy
from .tokens import by_size, encoder

WINDOW, LEAST, MOST, MASK = 16, 128, 4096, 511 << 40
DIGEST = 16
#: Digests that a task remembers.
MOST_SEEN = 200_000
MIXED = (np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
MIXED ^= MIXED >> np.uint64(29)
#: Recipes in a part of the store: their leaves are one group in the manifest's making.
PART_DOCS = 200_000


def cut_points(ids: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """Ends, within each document, of its chunks: where the hash of the last 16 ids has nine zero bits, at least 128 ids
    and at most 4096 after the last end. ids: of all documents; bounds: where each starts, and the end of the last."""
    h = np.zeros(max(0, len(ids) - WINDOW + 1), np.uint64)
    mixed = MIXED[ids]
    for i in range(WINDOW):
        h *= np.uint64(0xD1B54A32D192ED03)
        h += mixed[i : i + len(h)]
    places = np.flatnonzero(h & np.uint64(MASK) == 0) + WINDOW
    first, until = (np.searchsorted(places, x, side="left").tolist() for x in (bounds[:-1] + WINDOW, bounds[1:] + 1))
    out = []
    for a, b, start, n in zip(first, until, bounds[:-1].tolist(), np.diff(bounds).tolist(), strict=True):
        if n <= LEAST:
            out.append([n])
            continue
        ends, last = [], 0
        for end in places[a:b].tolist():
            end -= start
            while end - last > MOST:
                last += MOST
                ends.append(last)
            if end - last >= LEAST:
                ends.append(end)
                last = end
        while n - last > MOST:
            last += MOST
            ends.append(last)
        out.append(ends if last == n else [*ends, n])
    return out


def _shift_tables() -> np.ndarray:
    """[k, j, byte]: what the CRC-32 register byte at place j becomes after 2**k zero bytes."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    byte = np.arange(256, dtype=np.uint32)
    step = np.stack([table, byte << 0, byte << 8, byte << 16])  # one zero byte: the low byte through the table, others move down
    out = [step]
    for _ in range(40):
        out.append(np.stack([_apply(out[-1], row) for row in out[-1]]))
    return np.stack(out)


def _apply(step: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return step[0][crc & 255] ^ step[1][crc >> 8 & 255] ^ step[2][crc >> 16 & 255] ^ step[3][crc >> 24]


SHIFTS = _shift_tables()


def crc_share(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What a part with this CRC-32 and so many bytes after it gives to the CRC-32 of the whole: the shares' exclusive or."""
    out = crc.astype(np.uint32)
    for k in range(int(after.max(initial=0)).bit_length()):
        out = np.where(after >> k & 1, _apply(SHIFTS[k], out), out)
    return out


def leaf(doc_id: int | None, chunks: list[bytes], sizes: list[int]) -> bytes:
    return hashlib.sha256(repr((doc_id, sizes)).encode() + b"".join(chunks)).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    level = leaves
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() for i in range(0, len(level), 2)]
    return level[0]


def write(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 2) -> None:
    """Documents (doc_id, text) into a store at path. Null and empty texts are the end id alone; null doc_ids come
    first; rows that share a doc_id keep a recipe each. Other columns aren't read. An empty table makes an empty store."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ["kind", "key", "doc_id", "ids", "chunks", "sizes"]
    schema = f"kind string, key binary, doc_id {kind}, ids binary, chunks array<binary>, sizes array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, seen = TaskContext.get().partitionId() << 40, set()

        def rows(n: int, **given: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(n, t) for c, t in zip(columns, types, strict=True)], names=columns)

        for b in batches:
            types = [pa.string(), pa.binary(), b.schema.field(0).type, pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32())]
            for part in by_size(b, 1):
                ids, bounds = encoder(tokenizer, True).encode_ended(part.column(1).to_pylist(), end_id)
                cuts = cut_points(ids, bounds)
                n_chunks = np.fromiter(map(len, cuts), np.int32, len(cuts))
                ends = np.concatenate([[0], np.fromiter((e for c in cuts for e in c), np.int64) + np.repeat(bounds[:-1], n_chunks)])
                data = ids.astype("<u2").tobytes()
                at = (2 * ends).tolist()
                digests = [hashlib.blake2b(data[s:e], digest_size=DIGEST).digest() for s, e in zip(at, at[1:])]  # noqa: B905
                new = [d not in seen and not seen.add(d) for d in digests]  # a chunk found in many documents leaves its task once
                if len(seen) > MOST_SEEN:
                    seen.clear()
                keys = pa.array(digests, pa.binary())
                chunks = pa.Array.from_buffers(pa.binary(), len(digests), [None, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(data)]).filter(pa.array(new))
                yield rows(len(chunks), kind=pa.array(["chunk"] * len(chunks)), key=keys.filter(pa.array(new)), ids=chunks)
                offsets = pa.array(np.concatenate([[0], np.cumsum(n_chunks)]).astype(np.int32))
                recipe = pa.array([k.to_bytes(8, "big") for k in range(row, row + len(cuts))], pa.binary())
                row += len(cuts)
                yield rows(len(cuts), kind=pa.array(["recipe"] * len(cuts)), key=recipe, doc_id=part.column(0), chunks=pa.ListArray.from_arrays(offsets, keys), sizes=pa.ListArray.from_arrays(offsets, pa.array(np.diff(ends).astype(np.int32))))

    cut = docs.select("doc_id", "text").mapInArrow(tidy(run), schema).repartition("key")
    once = cut.groupBy("kind", "key").agg(*(F.first(c).alias(c) for c in columns[2:]))
    once.write.partitionBy("kind").parquet(f"{path}/content")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for b in batches:
            chunks, sizes, ids = b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(0).to_pylist()
            n = np.array([sum(x) for x in sizes], np.int64)
            ends = place + np.cumsum(n)
            leaves = [leaf(*x) for x in zip(ids, chunks, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n), b.column(0), pa.array(n), b.column(1), b.column(2), pa.array(leaves)], names=["part", "place", "doc_id", "n_tokens", "chunks", "sizes", "leaf"])
            place = int(ends[-1]) if len(ends) else place

    recipes = spark.read.schema(schema).parquet(f"{path}/content").where("kind = 'recipe'")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-recipes.count() // PART_DOCS))
    ordered = recipes.select("doc_id", "key", "chunks", "sizes").repartitionByRange(parts, "doc_id", "key").sortWithinPartitions("doc_id", "key").select("doc_id", "chunks", "sizes")
    ordered.mapInArrow(placed, f"part int, place long, doc_id {kind}, n_tokens long, chunks array<binary>, sizes array<int>, leaf binary").write.parquet(f"{path}/recipes")
    roots(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")


def roots(recipes: DataFrame) -> DataFrame:
    """part, n_docs, n_tokens, root of each part of the recipes."""

    def root(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "n_docs": [len(rows)], "n_tokens": [rows["n_tokens"].sum()], "root": [merkle_root(list(rows["leaf"]))]})

    return recipes.select("part", "place", "n_tokens", "leaf").groupBy("part").applyInPandas(root, "part int, n_docs long, n_tokens long, root binary")


def _uses(recipes: DataFrame) -> DataFrame:
    """A row for each chunk of each recipe, with the ids after it."""
    kinds = {f.name: f.dataType.simpleString() for f in recipes.schema}
    names = ["part", "place", "doc_id", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, of = pc.list_flatten(b.column(5)), pc.list_parent_indices(b.column(5))
            each, until = of.to_numpy(), np.cumsum(sizes.to_numpy(), dtype=np.int64)
            n = np.bincount(each, minlength=b.num_rows)
            ends = np.cumsum(n)
            total = np.concatenate([[0], until])[ends]  # ids up to the end of each recipe
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(of) for i in range(4)), pa.array((np.arange(len(each)) - (ends - n)[each]).astype(np.int32)), pc.list_flatten(b.column(4)), sizes, pa.array(total[each] - until)], names=[*names, "at", "chunk", "size", "after"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in names)
    return recipes.select(*names, "chunks", "sizes").mapInArrow(tidy(run), f"{schema}, at int, chunk binary, size int, after long")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("kind string, key binary, ids binary").parquet(f"{path}/content").where("kind = 'chunk'").select(F.col("key").alias("chunk"), "ids")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, intact of each document, from the store's
    files. intact: every chunk is there and has its digest and size, and the recipes of the document's part give the
    manifest's Merkle root and counts."""

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = b.column(1).to_pylist()
            good = [hashlib.blake2b(p, digest_size=DIGEST).digest() == k for k, p in zip(b.column(0).to_pylist(), parts, strict=True)]
            crc = [zlib.crc32(np.frombuffer(p, "<u2").astype("<u4")) for p in parts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(p) // 2 for p in parts], pa.int32()), pa.array(crc, pa.int64()), pa.array(good, pa.bool_())], names=["chunk", "found", "crc", "good"])

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = crc_share(b.column(3).to_numpy(), b.column(4).to_numpy() * 4)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc.astype(np.int64)), b.column(5)], names=["part", "place", "n_tokens", "share", "good"])

    recipes = spark.read.parquet(f"{path}/recipes")
    chunks = _chunks(spark, path).mapInArrow(verified, "chunk binary, found int, crc long, good boolean")
    used = _uses(recipes).join(chunks, "chunk", "left").select("part", "place", "n_tokens", F.coalesce("crc", F.lit(0)).alias("crc"), "after", F.coalesce(F.col("good") & (F.col("found") == F.col("size")), F.lit(False)).alias("good"))
    whole = used.mapInArrow(shares, "part int, place long, n_tokens long, share long, good boolean").groupBy("part", "place").agg(F.bit_xor("share").alias("ids_crc32"), F.bool_and("good").alias("intact"))
    manifest = spark.read.parquet(f"{path}/manifest")
    before = manifest.select("part", F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each part
    before = before.join(verify(spark, path).select("part", F.lit(True).alias("broken")), "part", "left")
    out = recipes.select("part", "place", "doc_id", "n_tokens").join(whole, ["part", "place"]).join(F.broadcast(before), "part")
    return out.select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", (F.col("intact") & F.col("broken").isNull()).alias("intact"))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids (little-endian uint16) of each document."""
    recipes = spark.read.parquet(f"{path}/recipes")
    chunks = _chunks(spark, path)
    parts = _uses(recipes).join(chunks, "chunk").groupBy("part", "place", "doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("parts"))
    return parts.select("doc_id", F.expr("aggregate(parts.ids, X'', (x, y) -> concat(x, y))").alias("ids"))


def verify(spark: SparkSession, path: str) -> DataFrame:
    """The parts whose recipes no longer give the manifest's root or counts; none if the store is sound."""
    kept = spark.read.parquet(f"{path}/manifest").select("part", *(F.col(c).alias(f"kept_{c}") for c in ("n_docs", "n_tokens", "root")))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaves = [leaf(*x) for x in zip(*(b.column(k).to_pylist() for k in (3, 4, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(leaves, pa.binary())], names=["part", "place", "n_tokens", "leaf"])

    now = roots(spark.read.parquet(f"{path}/recipes").select("part", "place", "n_tokens", "doc_id", "chunks", "sizes").mapInArrow(again, "part int, place long, n_tokens long, leaf binary"))
    same = " and ".join(f"{c} <=> kept_{c}" for c in ("n_docs", "n_tokens", "root"))
    return now.join(kept, "part", "full").where(f"not ({same})").select("part")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/token-store-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path)
    return read(spark, path)
