"""Votes as a stream: counts in windows with late votes bounded, and a table kept at each user's last vote."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from scriptorium.operators.ratings import latest


def windowed_ratings(votes: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Votes and points per page in tumbling windows; votes later than ``late`` are left out."""
    timed = votes.withColumn("ts", F.col("ts").cast("timestamp"))
    counts = timed.withWatermark("ts", late).groupBy(F.window("ts", size), "page_id").agg(F.count("*").alias("votes"), F.sum("rate").alias("points"))
    return counts.select(F.col("window.start").alias("start"), "page_id", "votes", "points")


#: Parts of the kept table: a batch rewrites only those that its votes fall into.
BUCKETS = 64


def _folders(spark: SparkSession, path: str):
    """The file system of a kept table, and the versions of each bucket, oldest first."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[int, list[int]] = {}
    for status in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, "version=*/bucket=*")) or []:
        version, bucket = (int(x) for x in re.search(r"version=(\d+)/bucket=(\d+)$", status.getPath().toString()).groups())
        found.setdefault(bucket, []).append(version)
    return fs, {b: sorted(v) for b, v in found.items()}


def last_votes(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The kept table: the newest version of each bucket."""
    _, versions = _folders(spark, path)
    newest = [f"{path}/version={v[-1]}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.schema(schema).parquet(*newest) if newest else spark.createDataFrame([], schema)


def keep_latest(votes: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Upsert each batch into a table with the last vote of each user and page.

    The table is dealt into buckets by user and page. A batch reads and rewrites the buckets of its own votes, as a new
    version named by the batch, so a batch that runs twice writes the same rows. The version before it stays for that
    case; older ones of the same buckets are deleted.
    """
    bucket = F.pmod(F.xxhash64("user_id", "page_id"), F.lit(buckets)).cast("int")

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fs, versions = _folders(spark, path)
        touched = [r["bucket"] for r in batch.select(bucket.alias("bucket")).distinct().collect()]  # one row a bucket
        before = {b: max((v for v in versions.get(b, []) if v < number), default=None) for b in touched}
        places = [f"{path}/version={v}/bucket={b}" for b, v in before.items() if v is not None]
        old = spark.read.schema(batch.schema).parquet(*places) if places else batch.limit(0)
        merged = latest(old.unionByName(batch), "user_id", "page_id").select(*batch.columns).withColumn("bucket", bucket)
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={number}")
        for b, last in before.items():
            for v in versions.get(b, []):
                if last is not None and v < last:
                    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={v}/bucket={b}"), True)

    return votes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
