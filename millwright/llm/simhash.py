"""SimHash near-duplicates, found through the binary Golay code.

A 64-bit fingerprint is cut into segments A (23 bits), B (23) and C (18). The perfect Golay code [23, 12, 7] puts every
23-bit word within three bits of exactly one codeword. A word's fuzzy keys are the indices of all codewords within four
bits of it, one or six of them; two words that differ in at most two bits share at least one: change one differing bit
in each of them, and both arrive at words with one and the same decoding.

Two fingerprints with at most four differing bits, (a, b, c) of them by segment, share a key of one of these kinds:

    c = 0                 C and a fuzzy key of A, or C and a fuzzy key of B (the smaller of a and b is 2 at most)
    a = 0                 A and a fuzzy key of B; for b > 2, A and one half of C
    b = 0                 B and a fuzzy key of A; for a > 2, B and one half of C
    a, b and c above 0    a fuzzy key of A, a fuzzy key of B (a and b are 2 at most) and one third of C (c is 2 at most)

So a key has 30 to 35 bits, and the groups of a key are small even among 10**9 fingerprints.

Fingerprints are grouped by key and compared exactly within a group by a search from member to member, which emits a
spanning forest of the links in the group, never all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import components, stored, table, tidy

GENERATOR = 0b101011100011  # x^11+x^9+x^7+x^6+x^5+x+1, one of the two generator polynomials of the code


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    out = words.astype(np.int64)
    for bit in range(22, 10, -1):
        out = np.where(out >> bit & 1, out ^ GENERATOR << (bit - 11), out)
    return out


def _coset_vectors() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error patterns of at most four bits (six columns, repeated where there are fewer), and their number."""
    bits = 1 << np.arange(23)
    found: list[list[int]] = [[] for _ in range(2048)]
    patterns = np.zeros(1, dtype=np.int64)
    for _ in range(4):
        patterns = np.unique(np.concatenate([patterns, *(patterns | b for b in bits)]))
    for pattern, s in zip(patterns.tolist(), _syndrome(patterns).tolist(), strict=True):
        found[s].append(pattern)
    count = np.array([len(x) for x in found])
    return np.array([(x * 6)[:6] for x in found]), count


COSETS, N_KEYS = _coset_vectors()


def fuzzy_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of the codewords within four bits of each 23-bit word: six columns, of which the first so many hold."""
    s = _syndrome(words)
    return (words[:, None].astype(np.int64) ^ COSETS[s]) >> 11, N_KEYS[s]


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text; 0 for a null or a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > 4:
        starts, ends = starts[:-3], ends[3:]
    else:
        starts, ends = starts[:1], ends[-1:]
    h = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)].astype("<u8")
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(h), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id and fp (long, the fingerprint's bits) of each row."""
    kind = docs.schema[id_column].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py()) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return docs.select(id_column, text_column).mapInArrow(tidy(run), f"id {kind.simpleString()}, fp long")


def _bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All bucket keys of the fingerprints (uint64), and which fingerprint each belongs to."""
    x = fps.astype(np.uint64)
    a, b, c = (x & 0x7FFFFF).astype(np.int64), (x >> 23 & 0x7FFFFF).astype(np.int64), (x >> 46).astype(np.int64)
    (ka, na), (kb, nb) = fuzzy_keys(a), fuzzy_keys(b)
    keys, owners, row = [], [], np.arange(len(x))

    def put(kind: int, value: np.ndarray, holds: np.ndarray) -> None:
        keys.append((value | kind << 56)[holds])
        owners.append(row[holds])

    every = np.ones(len(x), bool)
    for i in range(6):
        put(1, c << 12 | ka[:, i], na > i)
        put(2, c << 12 | kb[:, i], nb > i)
        put(3, a << 12 | kb[:, i], nb > i)
        put(4, b << 12 | ka[:, i], na > i)
        for j in range(6):
            for third in range(3):
                part = (c >> 6 * third & 0x3F) | third << 6
                put(7, (ka[:, i] << 12 | kb[:, j]) << 8 | part, (na > i) & (nb > j))
    for half in range(2):
        part = (c >> 9 * half & 0x1FF) | half << 9
        put(5, a << 10 | part, every)
        put(6, b << 10 | part, every)
    return np.concatenate(keys), np.concatenate(owners)


def _forest(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between distinct fingerprints."""
    links, rest = [], fps
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= bits
            if near.any():
                reached = rest[near]
                links += [(int(x), int(y)) for y in reached.view(np.int64)]
                queue += list(reached)
                rest = rest[~near]
    return links


def links(fps: DataFrame, bits: int = 4) -> DataFrame:
    """fp (long, distinct) -> src, dst: edges between fingerprints with at most `bits` (4 at most) differing bits, whose
    components are those of all such pairs."""
    if not 0 <= bits <= 4:
        raise ValueError("the keys hold for 0 to 4 differing bits")

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b["fp"].to_numpy(np.int64)
            for i in range(0, len(x), 4096):
                part = x[i : i + 4096]
                key, owner = _bucket_keys(part.view(np.uint64))
                yield pd.DataFrame({"key": key, "fp": part[owner]})

    def flush(key: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        """Links within whole groups, sorted by key."""
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([start, [len(key)]]))
        x, src, dst = fp.view(np.uint64), [], []
        for step in range(1, 8):  # small groups, all at once
            at = start[(size > step) & (size <= 8)]
            if not len(at):
                continue
            for i in range(int(size[size <= 8].max()) - step):
                left = start[(size <= 8) & (size > i + step)] + i
                near = np.bitwise_count(x[left] ^ x[left + step]) <= bits
                src.append(fp[left[near]])
                dst.append(fp[left[near] + step])
        for s, n in zip(start[size > 8].tolist(), size[size > 8].tolist(), strict=True):
            if forest := _forest(x[s : s + n], bits):
                pairs = np.array([(np.uint64(a), np.uint64(b % (1 << 64))) for a, b in forest], dtype=np.uint64).view(np.int64)
                src.append(pairs[:, 0])
                dst.append(pairs[:, 1])
        if not src:
            return pd.DataFrame({"src": np.zeros(0, np.int64), "dst": np.zeros(0, np.int64)})
        return pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst)}).drop_duplicates()

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # its last group may go on
        for b in batches:
            key, fp = b["key"].to_numpy(np.int64), b["fp"].to_numpy(np.int64)
            if not len(key):
                continue
            goes_on = bool(held) and held[-1][0][-1] == key[-1]  # all of the batch is of the held group
            held.append((key, fp))
            if not goes_on:
                key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
                end = int(np.searchsorted(key, key[-1]))
                if end:
                    yield flush(key[:end], fp[:end])
                held = [(key[end:], fp[end:])]
        if held:
            yield flush(*(np.concatenate(x) for x in zip(*held, strict=True)))

    rows = fps.select("fp").mapInPandas(tidy(keyed), "key long, fp long")
    return rows.repartition("key").sortWithinPartitions("key").mapInPandas(tidy(joined), "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, bits: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: id, fp (long), component_id (the smallest id it reaches, itself included).

    Null texts and texts without words have fingerprint zero and are linked like any other. A null id stands after all
    others: its component has the smallest id that isn't null, or null. Rows that share an id keep a row each. Columns
    other than the two named aren't read. An empty table gives an empty one.
    """
    each = stored(with_fingerprints(docs, id_column, text_column), "fingerprints")
    distinct = stored(each.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    found = components(links(distinct, bits))
    lowest = stored(distinct.join(found, distinct.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root")), "roots")
    smallest = lowest.groupBy("root").agg(F.min("least").alias("component_id"))
    label = lowest.join(smallest, "root").select("fp", "component_id")
    return each.join(label, "fp").select("id", "fp", "component_id")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
