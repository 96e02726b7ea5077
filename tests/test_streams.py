"""Streams in batches, out of order and restarted, against the same over tables."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millwright.operators import conversation, graph
from millwright.streaming import evidence, memory

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
T0 = datetime(2025, 1, 1)


@pytest.fixture
def state(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def drain(stream, path, mode="append"):
    q = stream.writeStream.format("parquet" if mode == "append" else "noop")
    if mode == "append":
        q = q.option("path", f"{path}/out").outputMode("append")
    else:  # a foreachBatch sink keeps each batch's rows under its number
        q = stream.writeStream.outputMode("update").foreachBatch(lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/out/b={n}"))
    q = q.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


TURNS = "conv_id long, turn long, role string, text string, ts timestamp"


def turns():
    r = random.Random(8)
    out = []
    for c in range(6):
        for t in range(r.choice([1, 5, 7, 20, 60])):
            role = r.choice(["user", "assistant", "assistant", "system"])
            out.append((c, t, role, r.choice([None, " ", "short", "x " * r.randint(1, 90)]), T0 + timedelta(seconds=len(out))))
    return out


def test_memory_in_any_batches(spark, state, tmp_path):
    """Turns shuffled over files, one file a batch, the query stopped and started anew between them."""
    rows = turns()
    shuffled = random.Random(1).sample(rows, len(rows))
    src = f"{tmp_path}/in"
    stream = lambda: memory.conversation_memory(spark.readStream.schema(TURNS).option("maxFilesPerTrigger", 1).parquet(src), "1 day")
    for part in range(2):
        for i in range(part, 6, 2):
            spark.createDataFrame(shuffled[i::6], TURNS).coalesce(1).write.mode("append").parquet(src)
        drain(stream(), str(tmp_path), "update")
    last = {}
    for r in sorted(spark.read.parquet(f"{tmp_path}/out").collect(), key=lambda r: r.batch):
        last[r.conv_id] = r
    table = spark.createDataFrame(rows, TURNS)
    sums = conversation.summaries(table)
    want = {r.conv_id: (r.cursor, r.summary) for r in sums.collect()}
    assert {i: (r.cursor, r.summary) for i, r in last.items() if r.messages} == want
    recent = {r.conv_id: [tuple(x) for x in r.entries if not x.text.startswith("Conversation summary: ")] for r in conversation.memory(table, sums).collect()}
    assert {i: [tuple(x) for x in r.recent] for i, r in last.items() if r.messages} == recent


def test_memory_gives_up_waiting(spark, state, tmp_path):
    """Turn 1 never comes: what follows it joins once event time has gone on, and no earlier."""
    src = f"{tmp_path}/in"
    at = lambda s: T0 + timedelta(seconds=s)
    batches = [[(1, 0, "user", "a", at(0)), (1, 2, "user", "c", at(1))], [(2, 0, "user", "z", at(30))], [(2, 1, "user", "y", at(400))], [(2, 2, "user", "x", at(800))]]
    for b in batches:
        spark.createDataFrame(b, TURNS).coalesce(1).write.mode("append").parquet(src)
        drain(memory.conversation_memory(spark.readStream.schema(TURNS).parquet(src), "10 seconds", 60_000), str(tmp_path), "update")
    grown = [(r.conv_id, r.messages) for r in sorted(spark.read.parquet(f"{tmp_path}/out").collect(), key=lambda r: r.batch) if r.conv_id == 1]
    assert grown == [(1, 1), (1, 2)]


def test_timeline_of_streams(spark, state, tmp_path):
    """Documents and chunks that come late, in other batches, or never."""
    at = lambda m: T0 + timedelta(minutes=m)
    schemas = {"m": "mention_id long, tag string, document_id long, chunk_index int, entity_id long, ts timestamp", "d": "document_id long, filename string, created_at timestamp, ts timestamp", "c": "document_id long, chunk_index int, text string, ts timestamp"}
    m = [(i, f"P-{i % 3}", i % 7, i % 2, i % 4, at(i)) for i in range(40)] + [(40, "P-9", None, None, None, at(5))]
    d = [(i, f"inspection_{i}.txt", at(-i), at(20 - i)) for i in range(5)]
    c = [(i, k, "seal leak" if k else "bearing wear", at(25 + i)) for i in range(6) for k in range(2) if (i, k) != (2, 1)]
    entities = spark.createDataFrame([(0, "zero"), (2, "two")], "entity_id long, name string")
    far = {"m": (999, "end", -1, -1, -1, at(10_000)), "d": (-2, "end", at(0), at(10_000)), "c": (-2, 0, "end", at(10_000))}
    for k, (name, rows) in enumerate((("c", c), ("m", m), ("d", d))):
        for part in range(3):
            spark.createDataFrame(rows[(part + k) % 3 :: 3], schemas[name]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    read = lambda name: spark.readStream.schema(schemas[name]).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
    run = lambda: drain(evidence.timeline(read("m"), read("d"), read("c"), entities, "2 hours", "1 hour"), str(tmp_path))
    run()
    for name, row in far.items():
        spark.createDataFrame([row], schemas[name]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    run()  # a new query goes on from the checkpoint; the far rows move the watermark past all others
    tables = {k: spark.createDataFrame(v, schemas[k]).drop("ts") for k, v in (("m", m), ("d", d), ("c", c))}
    want = graph.timeline(graph.evidence(tables["m"], tables["d"], tables["c"], entities))
    got = spark.read.parquet(f"{tmp_path}/out").where("tag <> 'end'").select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.where("filename is null").count() > 0
