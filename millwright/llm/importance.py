"""Importance resampling towards a target distribution, by log ratios of hashed n-gram frequencies.

Arrow kernels cut and number the words of a batch: ascii_lower, split_pattern_regex, list_flatten, dictionary_encode.
Shifted indices of that dictionary make n-grams; a CRC is computed for each distinct one only. A document's weight is
the segment sum of its features' gains, and a Gumbel term of its id turns the highest scores into a weighted sample.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, tidy
from .tokens import by_size

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # words are what stands between; letters are lower-cased before
LONGEST, BUCKETS, SEED, PERCENT, MIN_WORDS = 1, 10_000, 2024, 10, 20
SLICE_BYTES = 4 << 20
MOST_PARTITIONS = 2_000  # of the ranking


def _features(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Number of words of each text, and for each length of n-gram the buckets of all of them and each one's text."""
    words = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=BETWEEN)
    doc, flat = pc.list_parent_indices(words).to_numpy(), pc.list_flatten(words)
    there = pc.not_equal(flat, "")  # before a leading and behind a closing separator stands nothing
    doc, flat = doc[there.to_numpy(zero_copy_only=False)], flat.filter(there)
    coded = flat.dictionary_encode()
    names, index = [w.encode() for w in coded.dictionary.to_pylist()], coded.indices.to_numpy().astype(np.int64)
    crc = np.fromiter(map(zlib.crc32, names), np.int64, len(names))
    found, code, starts = [(crc[index] % buckets, doc)], index, np.arange(len(index))
    for n in range(2, longest + 1):
        last = n - 1 + np.arange(max(0, len(index) - n + 1))  # the word that makes (n-1)-grams longer
        within = doc[last] == doc[last - n + 1]
        before = code[np.searchsorted(starts, last[within] - n + 1)]
        pair, code = np.unique(before * len(names) + index[last[within]], return_inverse=True)
        crc = np.fromiter((zlib.crc32(b" " + names[w], c) for w, c in zip((pair % len(names)).tolist(), crc[pair // len(names)].tolist(), strict=True)), np.int64, len(pair))
        starts = last[within] - n + 1
        found.append((crc[code] % buckets, doc[starts]))
    return np.bincount(doc, minlength=len(texts)), found


def bucket_counts(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: features of all texts, summed in each task before they are sent. Null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for part in by_size(b, 0, SLICE_BYTES):
                for bucket, _ in _features(part.column(0), longest, buckets)[1]:
                    total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.mapInArrow(tidy(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """1000 times the log ratio of each bucket's smoothed share in target to that in docs, floored. At most `buckets`
    rows of each reach the driver."""
    raw, wanted = ({r.bucket: r.n for r in bucket_counts(d, longest, buckets).collect()} for d in (docs, target))
    s_all, t_all = sum(raw.values()), sum(wanted.values())
    ratio = ((wanted.get(b, 0) + 1) * (s_all + buckets) / ((raw.get(b, 0) + 1) * (t_all + buckets)) for b in range(buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row; a null or wordless text has none and weight 0."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_words", "n_features", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_size(b, 1, SLICE_BYTES):
                n_words, found = _features(part.column(1), longest, len(gain))
                n_features, weight = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
                for bucket, doc in found:
                    each = np.bincount(doc, minlength=part.num_rows)
                    until = np.concatenate([[0], np.cumsum(gain[bucket])])
                    ends = np.cumsum(each)
                    weight += until[ends] - until[ends - each]
                    n_features += each
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words), pa.array(n_features), pa.array(weight)], names=names)

    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """1000 times a Gumbel variate of the id, floored; a null id is the empty string."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row: of those with min_words words `percent` of a hundred are
    drawn, ranked 1, 2, 3 by score; the others' rank is null.

    Ties go to the smaller doc_id, a null one last; rows that share both keep a row each, in any order. Other columns
    aren't read. An empty table gives an empty one, an empty target all buckets of docs' own frequencies.
    """
    scored = weighted(docs, gains(docs, target, longest, buckets), longest)
    scored = stored(scored.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("able", F.col("n_words") >= min_words).withColumn("_row", F.monotonically_increasing_id()), "scored")
    # a range of scores each, numbered within; a range's first rank is the rows before it
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row")]
    total, able = scored.agg(F.count("*"), F.count_if("able")).first()
    parts = min(MOST_PARTITIONS, -(-total // 100_000)) or 1
    placed = stored(scored.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("at", 33)
    sizes = {r.part: r["count"] for r in placed.groupBy(part.alias("part")).count().collect()}  # a row for each of MOST_PARTITIONS at most
    before, seen = [0] * (max(sizes, default=0) + 1), 0
    for p in sorted(sizes):
        before[p] = seen
        seen += sizes[p]
    rank = F.element_at(F.lit(before).cast("array<long>"), (part + 1).cast("int")) + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return placed.select("doc_id", "n_features", "weight", "score", F.when(rank <= percent * able // 100, rank).alias("rank"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# Distinct words' CRC-32 by table; the table by its rule.
ORACLE = """
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
texts AS (SELECT 'd' AS side, doc_id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark),
split AS (
  SELECT side, doc_id, list_filter(string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda w: w <> '') AS words FROM texts),
each AS (SELECT side, doc_id, unnest(words) AS word FROM split),
by_word AS (SELECT side, doc_id, word, count(*) AS n FROM each GROUP BY ALL),
vocabulary AS (SELECT DISTINCT word, hex(encode(word)) AS code FROM by_word),
bytes AS (SELECT word, list_transform(range(1, length(code), 2), lambda i: ('0x' || substr(code, i, 2))::BIGINT) AS b FROM vocabulary),
bucketed AS (
  SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) % 10000 AS bucket
  FROM bytes, crc_table),
counted AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t
  FROM by_word JOIN bucketed USING (word) GROUP BY bucket),
totals AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM counted),
gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (s_all + 10000))::DOUBLE / ((s + 1) * (t_all + 10000))::DOUBLE))::BIGINT AS gain FROM counted, totals),
weights AS (
  SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight
  FROM by_word JOIN bucketed USING (word) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (
  SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM documents LEFT JOIN weights USING (doc_id)),
ranked AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place,
         10 * count(*) FILTER (n_features >= 20) OVER () // 100 AS drawn FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM ranked
"""
