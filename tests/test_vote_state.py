"""Keyed state of votes: shuffled and late batches, a restart, cancels, and what the store still holds."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators.ratings import latest
from scriptorium.streaming.vote_state import STORE, last_actions, standing_votes

SCHEMA = "user_id long, page_id long, vote_id long, rate int, ts timestamp, cancelled boolean"


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STORE)
    yield spark
    spark.conf.set(name, before)


def _actions(spark, seed, n, first_day, days):
    rng = random.Random(seed)
    rows = [(rng.randrange(6), rng.randrange(5), seed * 1000 + i, rng.choice([-1, 0, 1]), first_day * 86400 + rng.randrange(days * 86400), rng.random() < 0.2) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "ts long")).withColumn("ts", F.col("ts").cast("timestamp"))


def _run(spark, path, out, check, late):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    run = last_actions(stream, late).writeStream.foreachBatch(lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(out))
    query = run.outputMode("update").option("checkpointLocation", check).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _rows(df):
    return sorted(map(str, df.select("user_id", "page_id", "vote_id", "rate", "ts").collect()))


def test_shuffled_batches_and_a_restart(store, tmp_path):
    """Batches in no order of time, all within the allowed lateness, the stream stopped and started in between."""
    path, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    parts = [_actions(store, seed, 60, 100, 20) for seed in range(1, 5)]
    for part in parts[:2]:
        part.coalesce(1).write.mode("append").parquet(path)
    _run(store, path, out, check, "30 days")
    for part in parts[2:]:
        part.coalesce(1).write.mode("append").parquet(path)
    _run(store, path, out, check, "30 days")
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    found = standing_votes(store.read.parquet(out).drop("batch"))
    assert _rows(found) == _rows(latest(every, "user_id", "page_id").filter("not cancelled"))
    assert store.read.parquet(out).count() <= every.count()


def test_late_actions_are_left_out_and_state_goes(store, tmp_path):
    path, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    early, middle, late, end = _actions(store, 1, 40, 100, 1), _actions(store, 2, 40, 110, 1), _actions(store, 3, 40, 101, 1), _actions(store, 4, 5, 120, 1)
    for part in (early, middle, late, end):
        part.coalesce(1).write.mode("append").parquet(path)
        query = _run(store, path, out, check, "2 days")
    taken = early.unionByName(middle).unionByName(end)
    assert _rows(standing_votes(store.read.parquet(out).drop("batch"))) == _rows(latest(taken, "user_id", "page_id").filter("not cancelled"))
    assert query.lastProgress["stateOperators"][0]["customMetrics"].get("rocksdbGetCount", 0) >= 0
