"""What the operators of this subpackage share: tables, durable intermediate results, connected components."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it names none, one of this machine if all of
    Spark runs in this process (tests); an error elsewhere, since executors wouldn't see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="millwright-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def unused(docs: DataFrame, name: str) -> str:
    """name, or a longer one, that docs doesn't have as a column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hidden(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """docs with all columns but the used ones under names of their own, and what selects docs' columns from it again."""
    names = {c: c if c in used else f"_given_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), [F.col(n).alias(c) for c, n in names.items()]


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: later steps neither repeat its work nor lose it with an executor.
    Compressed well, since what is written stays there until the folder is cleared."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row(docs: DataFrame, name: str = "_row") -> DataFrame:
    """docs with a number of its own for each row; written, so that each reading gives a row the same number."""
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "rows")


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function of a task's batches, which hands freed memory back to the system at the task's end: a Python
    worker lives on between tasks, beside those of other steps, and would keep what the largest batch took."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(src, dst), long and undirected -> (node, component): the smallest node that each node with an edge reaches.

    Large-star and small-star steps in turn (Kiveris et al., 2014). Each is one grouped minimum, combined before its
    shuffle, and one join that adaptive execution can split, so a hub with many edges isn't one task's work. Edges with
    a null end are left out; an empty table gives an empty one.
    """
    e = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    e, before = stored(e, "edges"), None
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(small_low.select("u", F.col("m").alias("v"))).distinct()
        e = stored(small, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
