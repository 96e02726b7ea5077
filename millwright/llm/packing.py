"""Vector bin packing of training examples under limits on tokens, segments and loss-bearing tokens.

Examples are dealt evenly into groups of GROUP on average, each packed by one task, so how full sequences get depends on
the number of examples alone, not on how the input is cut. The dot-product heuristic fills a sequence with the example
whose demands, weighted by how scarce each resource is, agree most with the room that is left.
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

MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 2048, 256, 2048
SEQUENCE_BITS = 36  # of a sequence's number within its group or partition
#: Examples packed together, and tasks among which their groups are dealt: the last sequences of a group, a few hundred tokens each, are what it loses.
GROUP, MOST_TASKS = 20_000, 10_000


def pack_vectors(demands: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The bin (from 0) of each row of demands; bins come in the order in which they are filled. No bin exceeds a limit.

    Equal demands form one type, so a choice costs as many steps as there are different demands. Ties: the type with
    more of the first resource. A row that exceeds a limit alone is an error.
    """
    bins = np.zeros(len(demands), np.int64)
    if not len(demands):
        return bins
    if (demands > limits).any():
        raise ValueError("an example exceeds a limit")
    types, which, left = np.unique(demands, axis=0, return_inverse=True, return_counts=True)
    members = np.split(np.argsort(which.ravel(), kind="stable"), np.cumsum(left)[:-1])
    share = types / limits
    weighted = share * (share * left[:, None]).sum(axis=0)
    taken, number, n_left = np.zeros(len(types), np.int64), 0, len(demands)
    while n_left:
        room = limits.astype(np.int64).copy()
        open_types = np.flatnonzero(taken < left)
        while len(open_types := open_types[(types[open_types] <= room).all(axis=1) & (taken[open_types] < left[open_types])]):
            score = weighted[open_types] @ (room / limits)
            best = open_types[len(score) - 1 - int(np.argmax(score[::-1]))]
            bins[members[best][taken[best]]] = number
            taken[best] += 1
            room -= types[best]
            n_left -= 1
        number += 1
    return bins


def _packed(examples: DataFrame, kept: list[str], demands: list[str], limits: tuple[int, int, int], names: list[str]) -> DataFrame:
    """kept columns with sequence_id and the names: position (from 0) and offset (in the first demand) in its sequence.
    examples is read twice and must give the same rows each time."""
    groups = max(1, -(-examples.count() // GROUP))
    columns = [*kept, "sequence_id", "position", "offset"]
    types = {f.name: f.dataType.simpleString() for f in examples.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in kept)

    def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
        held: list[pa.RecordBatch] = []  # of one group: some GROUP rows
        for b in batches:
            number = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[-1].column(0)[0].as_py() != number[start]:
                    yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)
                    held = []
                if end > start:
                    held.append(b.slice(start, end - start))
        if held:
            yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, t in whole_groups(b for b in batches if b.num_rows):
            wanted = np.stack([t.column(c).fill_null(0).to_numpy() for c in demands], axis=1)
            bins = pack_vectors(wanted, np.array(limits))
            order = np.argsort(bins, kind="stable")
            first = np.searchsorted(bins[order], bins[order])
            offset = np.cumsum(wanted[order, 0]) - wanted[order, 0]
            out = {c: t.column(c).take(pa.array(order)) for c in kept}
            out |= {"sequence_id": bins[order] + (g << SEQUENCE_BITS), "position": np.arange(len(order)) - first, "offset": offset - offset[first]}
            yield from pa.table({c: out[c] for c in columns}).to_batches(max_chunksize=10_000)

    dealt = examples.withColumn("group", F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(groups)))
    each = dealt.select("group", *dict.fromkeys([*kept, *demands])).repartition(min(groups, MOST_TASKS), "group").sortWithinPartitions("group")
    return each.mapInArrow(tidy(run), f"{schema}, sequence_id long, position long, offset long").select(*kept, *names)


def pack(examples: DataFrame, id_column: str, tokens: str, segments: str, loss: str, limits: tuple[int, int, int] = (MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS)) -> DataFrame:
    """id, sequence_id, position (from 0 in its sequence) of each example, by its three demands. A null demand counts as
    0. An example that exceeds a limit is an error: cut it before. Null and repeated ids keep a row each; other columns
    aren't read; an empty table gives an empty one."""
    columns = [F.col(id_column).alias("id"), *(F.col(c).cast("long").alias(n) for c, n in ((tokens, "tokens"), (segments, "segments"), (loss, "loss")))]
    return _packed(stored(examples.select(columns), "examples"), ["id"], ["tokens", "segments", "loss"], limits, ["sequence_id", "position"])


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 1, limits: tuple[int, int, int] = (MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS), with_ids: bool = False) -> DataFrame:
    """Documents (doc_id, text) as pieces packed into sequences: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and with with_ids the piece's ids as little-endian uint16.

    A document's ids and end_id are cut into pieces of the most tokens a sequence may hold and what remains; a piece is
    one segment, and all of its tokens but the first, which nothing in the piece predicts, bear loss. Full pieces are
    sequences of their own; the others are packed. A null or empty text is the end id alone. Null and repeated doc_ids
    keep a row for each of their pieces. Other columns aren't read. An empty table gives an empty one.
    """
    most = min(limits[0], limits[2] + 1)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "whole"] + ["ids"] * with_ids
    columns = names[:5] + ["sequence_id", "offset"] + names[6:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << SEQUENCE_BITS
        for b in batches:
            for part in by_size(b, 1):
                ids, bounds = encoder(tokenizer, False).encode_ended(part.column(1).to_pylist(), end_id)
                sizes = np.diff(bounds)
                pieces = -(-sizes // most)
                doc = np.repeat(np.arange(len(sizes)), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * most
                length = np.minimum(most, sizes[doc] - start)
                at = bounds[doc] + start
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[a:e]) for a, e in zip(at.tolist(), (at + length).tolist(), strict=True)]
                full = length == most
                whole = number + np.cumsum(full) - 1
                number += int(full.sum())
                out = [part.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(sizes[doc]), pa.array(whole, mask=~full)]
                if with_ids:
                    out.append(pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(np.append(2 * at, 2 * len(ids)).astype(np.int32)), pa.py_buffer(ids.astype("<u2").tobytes())]))
                yield pa.RecordBatch.from_arrays(out, names=names)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, whole long" + ", ids binary" * with_ids
    pieces = stored(docs.select("doc_id", "text").mapInArrow(tidy(run), schema), "pieces")
    # the highest bit but one tells the full pieces' sequences from the packed ones
    alone = pieces.where("whole is not null").select(*names[:5], (F.col("whole") + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *names[6:])
    rest = pieces.where("whole is null").drop("whole").withColumn("segments", F.lit(1).cast("long")).withColumn("loss", F.col("length") - 1)
    return alone.union(_packed(rest, names[:5] + names[6:], ["length", "segments", "loss"], limits, ["sequence_id", "offset"]).select(columns))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
