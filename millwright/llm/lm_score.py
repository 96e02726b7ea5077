"""Stupid-backoff scores of documents by the n-grams of all other documents.

Documents are dealt into blocks by hash. A block sends its different n-grams of each order, as sorted keys, to the count
tables, which are partitioned by ranges of the keys' hash; each partition adds up what it gets and answers every block
with the totals of that block's n-grams. The join's rows are such lists, not single n-grams: a few bytes for an n-gram,
and none larger than a block's share of a partition. A list holds one n-gram at least, so there are never more rows than
n-grams, however many blocks and partitions meet. Each block then sums up its documents' scores.

A document's own n-grams are taken off the totals first, so it is scored by the others only:

    S(w | context) = c(context w) / c(context)      if c(context w) > 0
                     0.4 * S(w | shorter context)   else
    S(w) = c(w) / N, and 1 / (2 N) for a word that no other document has
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import table

ORDER, BACKOFF = 3, 0.4
KEY_BITS = 48  # of an n-gram's hash; of 10**8 different n-grams, one in three million shares a key with another
BLOCK_CHARS, PARTITION_CHARS = 6_000_000, 6_000_000


def grams(texts: list[str | None], order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Words of each text; then by order the n-grams' keys, and the documents in which they stand."""
    codes: dict[bytes, int] = {}
    at: list[int] = []
    sizes = []
    for t in texts:
        words = (t or "").encode("utf-8", "surrogatepass").lower().split()
        at += [codes.setdefault(w, len(codes)) for w in words]
        sizes.append(len(words))
    n = np.array(sizes, np.int64)
    word = np.fromiter((xxh64_intdigest(w) for w in codes), np.uint64, len(codes))[np.array(at, np.int64)]
    doc = np.repeat(np.arange(len(texts)), n)
    keys, docs, h = [], [], word
    for k in range(1, order + 1):
        if k > 1:
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[k - 1 :]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
        inside = doc[k - 1 :] == doc[: len(doc) - k + 1]
        keys.append((h >> np.uint64(64 - KEY_BITS))[inside])
        docs.append(doc[k - 1 :][inside])
    return n, keys, docs


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys: the steps between them, in as few bytes as the largest needs."""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(steps[1:].max(initial=0)).bit_length() + 7) // 8)
    planes = steps[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return keys[:1].astype("<u8").tobytes() + bytes([width]) + planes.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    width = data[8]
    planes = np.zeros(((len(data) - 9) // width, 8), np.uint8)
    planes[:, :width] = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    return np.cumsum(np.concatenate([np.frombuffer(data, "<u8", 1), planes.view("<u8").ravel()]), dtype=np.uint64)


def _counts(n: np.ndarray) -> bytes:
    """Counts in four bytes each, or in eight if one of them needs it."""
    wide = int(n.max(initial=0)) >> 32 > 0
    return bytes([wide]) + zlib.compress(n.astype("<u8" if wide else "<u4").tobytes(), 1)


def _counted(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), "<u8" if data[0] else "<u4").astype(np.int64)


def scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, score (mean of the natural logarithms of S by word, null without words), log_sum (their sum) of each
    row.

    Null and empty texts have no words, a log_sum of 0. Rows that share a doc_id, or all their values, are documents
    each. Other columns aren't read. An empty table gives an empty one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    n_words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    total, chars = docs.agg(F.sum(n_words), F.sum(F.length("text"))).first()
    total, chars = total or 0, chars or 0
    blocks, parts = 1 + chars // BLOCK_CHARS, 1 + chars // PARTITION_CHARS
    dealt = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"))
    edges = (np.arange(parts + 1, dtype=object) * (1 << KEY_BITS) // parts).astype(np.uint64)

    def asked(rows: pd.DataFrame) -> pd.DataFrame:
        _, keys, _ = grams(rows["text"].tolist(), order)
        out = []
        for k, key in enumerate(keys, 1):
            different, n = np.unique(key, return_counts=True)
            part = np.searchsorted(edges, different, side="right") - 1  # only parts that have a key are walked over
            bounds = np.flatnonzero(np.diff(part, prepend=-1, append=parts))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                out.append((int(part[a]), k, rows["block"].iloc[0], _packed(different[a:b]), _counts(n[a:b])))
        return pd.DataFrame(out, columns=["part", "n", "block", "keys", "counts"])

    def answered(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for k, g in rows.groupby("n"):
            keys = [_unpacked(x) for x in g["keys"]]
            counts = np.concatenate([_counted(x) for x in g["counts"]])
            different, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            totals = np.bincount(inverse, counts, len(different)).astype(np.int64)[inverse]
            for block, t in zip(g["block"], np.split(totals, np.cumsum([*map(len, keys)])[:-1]), strict=True):
                out.append((block, k, rows["part"].iloc[0], _counts(t)))
        return pd.DataFrame(out, columns=["block", "n", "part", "totals"])

    def scored(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        n, keys, in_doc = grams(rows["text"].tolist(), order)
        others = []  # by order: how often each n-gram stands in other documents
        for k, key in enumerate(keys, 1):
            different, inverse = np.unique(key, return_inverse=True)
            mine = answers[answers["n"] == k].sort_values("part")["totals"]
            totals = np.concatenate([np.zeros(0, np.int64), *map(_counted, mine)])
            pair = in_doc[k - 1] * len(different) + inverse
            _, at, own = np.unique(pair, return_inverse=True, return_counts=True)
            others.append(totals[inverse] - own[at])
        words = np.maximum(1, total - n)[np.repeat(np.arange(len(n)), n)]
        best = np.log(np.maximum(others[0], 0.5) / words) if len(words) else np.zeros(0)
        starts = np.cumsum(n) - n
        for k in range(2, order + 1):
            # the n-grams of order k end at every word of a document but its first k - 1; their contexts begin with them
            place = np.arange(len(words)) - np.repeat(starts, n)
            ends = np.flatnonzero(place >= k - 1)
            context = others[k - 2][_places(n, k - 1, ends - 1)]
            found = others[k - 1] > 0
            value = best.copy()
            value[ends] = np.where(found, np.log(np.maximum(others[k - 1], 1) / np.maximum(context, 1)), np.log(BACKOFF) + best[ends])
            best = value
        sums = np.add.reduceat(np.append(best, 0.0), starts) * (n > 0) if len(n) else np.zeros(0)
        mean = np.where(n > 0, sums / np.maximum(n, 1), np.nan)
        out = pd.DataFrame({"doc_id": rows["doc_id"], "n_words": n, "log_sum": sums.round(6)})
        out.insert(2, "score", pd.Series(mean.round(6), index=out.index).astype(object).where(n > 0, None))
        return out

    requests = dealt.groupBy("block").applyInPandas(asked, "part int, n int, block long, keys binary, counts binary")
    answers = requests.groupBy("part").applyInPandas(answered, "block long, n int, part int, totals binary")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(scored, f"doc_id {kind}, n_words long, score double, log_sum double")


def _places(n: np.ndarray, k: int, ends: np.ndarray) -> np.ndarray:
    """Where, among the n-grams of order k, those stand that end at these words."""
    missing = np.minimum(n, k - 1)
    before = np.cumsum(missing)
    return ends - before[np.searchsorted(np.cumsum(n), ends, side="right")]


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
