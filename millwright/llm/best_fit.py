"""Hierarchical residual packing: best fit within partitions, then underfull bins as items in a tree of merges.

Each task packs its own pieces by best fit, largest first. Bins that are nearly full are done; the others become items of
their fill and go to an eighth as many groups in each round, which pack them again, until one group is left or merging
no longer pays. Rounds move a bin's number and fill alone; the pieces meet their final sequence in one join at the end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, tidy
from .tokens import by_size, encoder

MAX_TOKENS = 2048
#: Free tokens of a bin that is done, groups that merge into one, items packed together at most.
SLACK, FAN_IN, GROUP = 16, 8, 100_000
#: Bits of a bin's number: round, group, number in it.
ROUND_AT, GROUP_AT = 56, 24


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin (from 0) of each size, largest first, each into the fullest bin that has room. Ties: the earlier row, the bin filled last."""
    bins = np.zeros(len(sizes), np.int64)
    if not len(sizes):
        return bins
    if sizes.max() > capacity:
        raise ValueError("an item exceeds the capacity")
    order = np.argsort(-sizes, kind="stable")
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free room
    rooms, number, chosen = 0, 0, []  # rooms: a bit for each room that some bin has
    for size in sizes[order].tolist():
        if fitting := rooms >> size:
            room = size + (fitting & -fitting).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, b, number = capacity, number, number + 1
        if left := room - size:
            open_bins[left].append(b)
            rooms |= 1 << left
        chosen.append(b)
    bins[order] = chosen
    return bins


def _placed(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """bin, offset in it, and the bin's fill, of each size."""
    bins = best_fit(sizes, capacity)
    order = np.argsort(bins, kind="stable")
    until = np.cumsum(sizes[order])
    first = np.searchsorted(bins[order], bins[order])
    offset = np.empty(len(sizes), np.int64)
    offset[order] = until - sizes[order] - (until - sizes[order])[first]
    return bins, offset, np.bincount(bins, weights=sizes, minlength=1).astype(np.int64)[bins]


def _cut(docs: DataFrame, tokenizer: str, end_id: int, most: int) -> DataFrame:
    """Pieces of all documents, packed by each task in groups of GROUP: with bin, offset, filled."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "filled"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, group = TaskContext.get().partitionId(), 0
        held: list[list] = []

        def packed() -> Iterator[pa.RecordBatch]:
            columns = [pa.concat_arrays(c) for c in zip(*held, strict=True)]
            bins, offset, filled = _placed(columns[3].to_numpy(), most)
            number = ((task + (group << 20)) << GROUP_AT) + bins
            out = pa.table(dict(zip(names, [*columns, pa.array(number), pa.array(offset), pa.array(filled)], strict=True)))
            yield from out.to_batches(max_chunksize=10_000)

        for b in batches:
            for part in by_size(b, 1):
                ids, bounds = encoder(tokenizer, True).encode_ended(part.column(1).to_pylist(), end_id)
                sizes = np.diff(bounds)
                pieces = -(-sizes // most)
                doc = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * most
                length = np.minimum(most, sizes[doc] - start)
                at, wide = bounds[doc] + start, ids.astype("<u4")
                crc = [zlib.crc32(wide[a:e]) for a, e in zip(at.tolist(), (at + length).tolist(), strict=True)]
                held.append([part.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())])
                if sum(len(x[1]) for x in held) >= GROUP:
                    yield from packed()
                    held, group = [], group + 1
        if held:
            yield from packed()

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, bin long, offset long, filled long")


def _merged(items: DataFrame, groups: int, level: int, capacity: int) -> DataFrame:
    """(bin, filled) dealt evenly to groups, each packed -> child, bin, offset (of the child in the bin), filled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            bins, offset, filled = _placed(t.column("filled").to_numpy(), capacity)
            number = (level << ROUND_AT) + (held[0].column(0)[0].as_py() << GROUP_AT) + bins
            return pa.RecordBatch.from_arrays([t.column("bin").combine_chunks(), *map(pa.array, (number, offset, filled))], names=["child", "bin", "offset", "filled"])

        for b in (b for b in batches if b.num_rows):
            of = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, e in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[-1].column(0)[0].as_py() != of[a]:
                    yield packed()
                    held = []
                held.append(b.slice(a, e - a))
        if held:
            yield packed()

    dealt = items.select(F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(groups)).alias("group"), "bin", "filled")
    return dealt.repartition(groups, "group").sortWithinPartitions("group", "bin").mapInArrow(tidy(run), "child long, bin long, offset long, filled long")


def pack_best_fit(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 0, most: int = MAX_TOKENS) -> DataFrame:
    """Documents (doc_id, text) as pieces in sequences of at most `most` tokens: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset.

    A document's ids and end_id are one piece; longer ones are cut into pieces of `most`, the last of which may be
    shorter. A null or empty text is the end id alone. Null and repeated doc_ids keep a row for each of their pieces.
    Other columns aren't read. An empty table gives an empty one.
    """
    pieces = stored(_cut(docs, tokenizer, end_id, most), "pieces")
    underfull = F.col("filled") < most - SLACK
    items, rounds = pieces.where(underfull & (F.col("offset") == 0)).select("bin", "filled"), []
    n, width = items.agg(F.count("*"), F.count_distinct(F.shiftright("bin", GROUP_AT))).first()
    while n:
        width = max(-(-width // FAN_IN), -(-n // GROUP))
        merged = stored(_merged(items, width, len(rounds) + 1, most), f"merged-{len(rounds)}")
        rounds.append(merged)
        items = merged.where(underfull & (F.col("offset") == 0)).select("bin", "filled")
        before, n = n, items.count()
        if width == 1 or width == -(-before // GROUP) and n > 0.99 * before:
            break
    done = pieces.where(~underfull)
    columns = [*pieces.columns[:5], F.col("bin").alias("sequence_id"), "offset"]
    if not rounds:
        return pieces.select(columns)
    moved = rounds[-1].select("child", "bin", "offset")
    for earlier in reversed(rounds[:-1]):
        later = moved.select(F.col("child").alias("bin"), F.col("bin").alias("to"), F.col("offset").alias("further"))
        moved = earlier.join(later, "bin", "left").select("child", F.coalesce("to", "bin").alias("bin"), (F.col("offset") + F.coalesce("further", F.lit(0))).alias("offset"))
    moved = moved.select(F.col("child").alias("bin"), F.col("bin").alias("to"), F.col("offset").alias("further"))
    rest = pieces.where(underfull).join(moved, "bin").select(*pieces.columns[:5], F.col("to").alias("sequence_id"), (F.col("offset") + F.col("further")).alias("offset"))
    return done.select(columns).union(rest)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(table(spark, sf_dir, "documents"))
