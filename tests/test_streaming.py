"""Streams of votes against the same votes as a table."""

from collections import Counter

from pyspark.sql import functions as F

from scriptorium.operators.ratings import latest
from scriptorium.sources.wiki import Wiki
from scriptorium.streaming.votes import keep_latest, last_votes, windowed_ratings


def _stream(spark, votes, path):
    votes.repartition(5).write.parquet(path)
    return spark.readStream.schema(votes.schema).option("maxFilesPerTrigger", 2).parquet(path)


def test_latest_votes(spark, folder, tmp_path):
    votes = Wiki(spark, folder).vote_events()
    run = keep_latest(_stream(spark, votes, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), buckets=8)
    run.awaitTermination()
    found = last_votes(spark, str(tmp_path / "out"), votes.schema)
    assert sorted(map(str, found.collect())) == sorted(map(str, latest(votes, "user_id", "page_id").select(*votes.columns).collect()))
    versions = Counter(p.name for p in (tmp_path / "out").glob("version=*/bucket=*"))
    assert len(versions) == 8 and max(versions.values()) <= 2  # older versions of a bucket are gone


def test_batches_rewrite_their_own_buckets(spark, folder, tmp_path):
    """A batch of one user's votes leaves the other buckets at their version."""
    votes = Wiki(spark, folder).vote_events()
    keep_latest(_stream(spark, votes, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), buckets=8).awaitTermination()
    before = {str(p) for p in (tmp_path / "out").glob("version=*/bucket=*")}
    more = votes.limit(1).withColumn("rate", F.lit(-1)).withColumn("ts", F.col("ts") + F.expr("interval 9 years"))
    more.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(votes.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    keep_latest(stream, str(tmp_path / "out"), str(tmp_path / "check"), buckets=8).awaitTermination()
    added = {str(p) for p in (tmp_path / "out").glob("version=*/bucket=*")} - before
    assert len(added) == 1
    row = more.first()
    assert last_votes(spark, str(tmp_path / "out"), votes.schema).filter((F.col("user_id") == row["user_id"]) & (F.col("page_id") == row["page_id"])).first()["rate"] == -1


def test_windows_hold_each_day(spark, folder, tmp_path):
    """Each window's sums, beside the same sums over the table."""
    votes = Wiki(spark, folder).vote_events()
    counts = windowed_ratings(_stream(spark, votes, str(tmp_path / "in")), late="60 days")
    counts.writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    want = votes.groupBy(F.date_trunc("day", "ts").cast("timestamp").alias("start"), "page_id").agg(F.count("*").alias("votes"), F.sum("rate").alias("points"))
    assert sorted(map(str, spark.table("days").collect())) == sorted(map(str, want.collect()))


def test_windows(spark, folder, tmp_path):
    votes = Wiki(spark, folder).vote_events()
    counts = windowed_ratings(_stream(spark, votes, str(tmp_path / "in")), late="60 days")
    run = counts.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("windows").groupBy().sum("votes").first()[0] == votes.count()
