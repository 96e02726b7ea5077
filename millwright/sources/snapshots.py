"""Tables that change together: each run writes folders of rows, and one commit at its end makes all of them visible.

    root/data/<table>/<run>/    rows, written once, never changed
    root/commits/<number>/      of each run: the tables' folders, and what it counted

A run that dies leaves folders that no commit names, so nobody reads them. One writer at a time; any number of readers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import islice

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A table's rows, or what makes them of the tables written before.
Rows = DataFrame | Callable[[dict[str, DataFrame]], DataFrame]
COMMIT = "number int, table string, folder string, base boolean, counts map<string,long>"


@dataclass
class Snapshot:
    """A root folder at one commit; later commits don't change what it reads."""

    spark: SparkSession
    root: str
    number: int = -1
    folders: dict[str, list[str]] = field(default_factory=dict)
    counts: dict[int, dict[str, int]] = field(default_factory=dict)

    @classmethod
    def latest(cls, spark: SparkSession, root: str) -> Snapshot:
        """The newest one; an empty one where nothing was committed. Commits are few: one a run."""
        out = cls(spark, root.rstrip("/"))
        if not exists(spark, f"{out.root}/commits"):
            return out
        rows = spark.read.schema(COMMIT).parquet(f"{out.root}/commits/*").collect()
        for r in sorted(rows, key=lambda r: r.number):
            if r.base:
                out.folders[r.table] = []
            if r.folder:
                out.folders.setdefault(r.table, []).append(r.folder)
            out.counts.setdefault(r.number, {}).update(r.counts or {})
            out.number = r.number
        return out

    def read(self, table: str, schema: str) -> DataFrame:
        """All rows of a table; none where no run wrote any."""
        found = [f"{self.root}/data/{table}/{x}" for x in self.folders.get(table, [])]
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def commit(self, tables: dict[str, Rows], observed: dict[str, dict[str, str]] | None = None, base: bool = False) -> Snapshot:
        """Writes the rows of all tables, in order, and then the commit; with base they replace the tables' rows. Rows may
        be a function of the tables written before them.

        observed: aggregates (SQL) of a table's rows by name, taken while they are written. Their values, and each table's
        number of rows, are the commit's counts.
        """
        number, run, counts, written = self.number + 1, uuid.uuid4().hex, {}, {}
        for table, given in tables.items():
            rows = given(written) if callable(given) else given
            seen, wanted = Observation(), {"rows": "count(1)", **((observed or {}).get(table) or {})}
            rows.observe(seen, *(F.expr(c).cast("long").alias(n) for n, c in wanted.items())).write.parquet(path := f"{self.root}/data/{table}/{run}")
            written[table] = self.spark.read.schema(rows.schema).parquet(path)
            counts[table] = {f"{table}.{n}": v or 0 for n, v in seen.get.items()}
        rows = [(number, t, run, base, counts[t]) for t in tables]
        self.spark.createDataFrame(rows, COMMIT).coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/commits/{number:09d}")
        return Snapshot.latest(self.spark, self.root)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


MANIFEST = "path string, length long, modified timestamp, digest string, number int"


def _manifest(s: Snapshot) -> DataFrame:
    """The newest entry of each file."""
    newest = F.max_by(F.struct("length", "modified", "digest", "number"), "number").alias("x")
    return s.read("manifest", MANIFEST).groupBy("path").agg(newest).select("path", "x.*")


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, modified of every file below the folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def pending(s: Snapshot, folder: str, force: bool = False) -> DataFrame:
    """Files that the manifest doesn't have as they are now: new ones, and those of another size or time."""
    files = listed(s.spark, folder)
    return files if force else files.join(_manifest(s).select("path", "length", "modified"), ["path", "length", "modified"], "left_anti")


Extract = Callable[[DataFrame], dict[str, Rows]]


def ingest(spark: SparkSession, folder: str, root: str, extract: Extract, observed: dict[str, dict[str, str]] | None = None, files_a_commit: int = 10_000, force: bool = False) -> list[dict[str, int]]:
    """Brings root up to the files in folder; the counts of each commit.

    extract gives the tables of some files (path, digest, content); each of its tables has columns path and digest, which
    say what their rows come from. files_a_commit files go into one commit, so a run that dies goes on where it stopped.
    A file is known by path, size and time, and read again if they change, or for all files with force; its rows are new
    only if its digest is. Reading the manifest and listing the folder are all that a run without changes does. Files
    that are gone keep their rows. Empty files and an empty folder change nothing.
    """
    s, out = Snapshot.latest(spark, root), []
    # the list of one run; what is ingested leaves it commit by commit
    todo = pending(s, folder, force).select("path", "length", "modified").orderBy("path")
    paths = todo.toLocalIterator(prefetchPartitions=True)
    while part := list(islice(paths, files_a_commit)):
        entries = spark.createDataFrame(part, "path string, length long, modified timestamp")
        content = spark.read.format("binaryFile").load([r.path for r in part]).select("path", F.sha2("content", 256).alias("digest"), "content")
        known = _manifest(s).select("path", F.col("digest").alias("known"))
        changed = content.join(F.broadcast(entries.select("path")), "path", "left_semi").join(known, "path", "left")  # of the listed part
        fresh = changed.where("known IS NULL OR known <> digest").drop("known")
        tables = extract(fresh)
        digests = changed.select("path", "digest").join(F.broadcast(entries), "path")
        tables["manifest"] = digests.select("path", "length", "modified", "digest", F.lit(s.number + 1).alias("number"))
        s = s.commit(tables, observed)
        out.append(s.counts[s.number])
    return out


def current(s: Snapshot, table: str, schema: str) -> DataFrame:
    """The rows that come from files as they are now; those of a file's earlier contents are left out."""
    return s.read(table, schema).join(_manifest(s).select("path", "digest"), ["path", "digest"], "left_semi")


def compacted(s: Snapshot, schemas: dict[str, str]) -> Snapshot:
    """A commit in which each table has the current rows alone, in one folder."""
    tables = {t: current(s, t, schema) for t, schema in schemas.items()}
    tables["manifest"] = _manifest(s).select("path", "length", "modified", "digest", "number")
    return s.commit(tables, base=True)
