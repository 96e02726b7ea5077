"""Retrieval on small rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.operators import retrieval


def test_vector_topk_in_blocks(spark, monkeypatch):
    v = spark.range(60).select(F.col("id").alias("vec_id"), F.concat(F.lit("l"), F.col("id") % 3).alias("label"), F.array(F.sin("id"), F.cos(F.col("id") * 3), F.lit(0.5)).cast("array<float>").alias("embedding"))
    q = v.where("vec_id % 2 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    for per_label in (None, 1):
        monkeypatch.setattr(retrieval, "MOST_QUERIES", 10_000)
        whole = sorted(retrieval.vector_topk(v, q, 3, per_label).collect())
        assert len(whole) == 30 * 3
        monkeypatch.setattr(retrieval, "MOST_QUERIES", 8)
        assert sorted(retrieval.vector_topk(v, q, 3, per_label).collect()) == whole
