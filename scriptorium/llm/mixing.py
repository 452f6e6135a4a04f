"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected the same number of times (its source's target over its size). The
documents of a source stand in order of size; the prefix sums of their expected copies, shifted by one
random offset of the source, give a copy for each whole number that is crossed. The offset is the one of DRAWS
seeded draws whose words come nearest to the target; that brings the source's error well under its largest document,
which is what a single draw can miss by.

Ranks and running sums come from range partitions, so neither a source with a large share of all rows nor a great
number of sources passes one task, and no source comes to the driver.

Nulls: a null text has size 0, as an empty one; a null source is a source of its own, last in order; a null doc_id
sorts first. Documents of one size stand in order of doc_id, then of a hash of the text; repeated rows are documents of
their own and may be taken at different numbers. Very long texts are counted whole and are the largest step of the error.
Extra columns are ignored, whatever their names. Sources without words have target 0. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import WORD_PATTERN, Scratch

#: Offsets that are tried for each source.
DRAWS = 32


def ranked(df: DataFrame, scratch: Scratch, *order: Column) -> DataFrame:
    """The rows with ``rank``, from 1 in the given order over the whole table: places in range partitions on top of
    the partitions' running counts."""
    sort = scratch.write(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part, row = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition only
    bases = sort.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return sort.withColumns({"part": part, "row": row}).join(bases, "part").withColumn("rank", F.col("base") + F.col("row") + 1).drop("place", "part", "row", "base")


def targets(sources: DataFrame, share: float, cap: float, scratch: Scratch) -> DataFrame:
    """``target`` for rows of (source_size, weight): ``share`` times all sizes by weight, none above ``cap`` times its
    size; what is over goes to the others by weight until none is above. Each round is one aggregate over the sources."""
    most = cap * F.col("source_size")
    left, total = F.lit(True), F.lit(0.0)
    whole = sources.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    known = None
    while True:
        open_row = sources.agg(F.sum(F.when(left, F.col("weight"))).alias("weight"), F.sum(F.when(~left, most)).alias("full"), F.count_if(left).alias("n")).first()
        budget = share * whole - (open_row["full"] or 0.0)
        if open_row["n"] == known or not open_row["n"]:
            return sources.withColumn("target", F.when(left, total).otherwise(most))
        known = open_row["n"]
        total = F.lit(float(budget)) * F.col("weight") / F.lit(float(open_row["weight"]))
        left = left & (total <= most)


def _offset(source: Column, draw: int, seed: int) -> Column:
    """A random offset from 0 to 1 of a source, the same in every run."""
    name = F.concat(F.lit(f"{seed}/{draw}/"), F.coalesce(F.concat(F.lit("s"), source), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / float(1 << 32)


def _copies(offset: Column) -> Column:
    """Whole numbers that the prefix sum crosses at a document."""
    at = F.col("rank_there").cast("double")
    return F.floor(at * F.col("rate") + offset) - F.floor((at - 1) * F.col("rate") + offset)


def mix_sources(
    docs: DataFrame, share: float = 1.5, cap: float = 2.0, cycle: tuple[float, ...] = (5, 2, 1), seed: int = 17, draws: int = DRAWS, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (size times copies), source, copies, then the long columns ``keys``."""
    if share > cap:
        raise ValueError("no mix can take more than cap times all sizes")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    sized = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size"), F.xxhash64("text").alias("tie"), *keys)
    with Scratch(docs.sparkSession) as scratch:
        sized = scratch.write(sized)  # ranking reads its rows twice, and words should be counted once
        order = (F.col("source").asc_nulls_last(), F.col("size").asc(), F.col("doc_id").asc(), F.col("tie").asc())
        rows = ranked(sized, scratch, *order)
        totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("rank").alias("first"))
        sources = ranked(totals, scratch, F.col("source").asc_nulls_last())
        weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.pmod(F.col("rank") - 1, F.lit(len(cycle))) + 1).cast("int"))
        sources = scratch.write(sources.withColumn("weight", weight).drop("rank"))
        goal = scratch.write(targets(sources, share, cap, scratch).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)))
        there = rows.join(goal.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named"))).drop("named").withColumn("rank_there", F.col("rank") - F.col("first") + 1)
        tried = there.groupBy("source").agg(F.first("target").alias("target"), *[F.sum(_copies(_offset(F.col("source"), n, seed)) * F.col("size")).alias(f"taken_{n}") for n in range(draws)])
        miss = F.array(*[F.struct(F.abs(F.col(f"taken_{n}") - F.col("target")).alias("miss"), F.lit(n).alias("draw"), _offset(F.col("source"), n, seed).alias("offset")) for n in range(draws)])
        best = scratch.write(tried.select(F.col("source").alias("named"), F.array_min(miss)["offset"].alias("offset")))
        copies = F.least(_copies(F.col("offset")), F.lit(int(cap))).cast("long")
        mix = there.join(best, F.col("source").eqNullSafe(F.col("named"))).withColumn("copies", copies)
        return scratch.keep(mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies", *keys))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the sources' target weights."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5e0, 2e0, 1e0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS w FROM d GROUP BY source
), p AS (
  SELECT *, 1.5e0 * sum(source_size) OVER () - coalesce(sum(2e0 * source_size) OVER before, 0) AS budget, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS weights
  FROM s WINDOW before AS (ORDER BY source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT budget, weights FROM p WHERE budget * w / weights <= 2e0 * source_size ORDER BY source_size / w, source LIMIT 1
), g AS (
  SELECT source, source_size, CASE WHEN l.budget * w / l.weights <= 2e0 * source_size THEN l.budget * w / l.weights ELSE 2e0 * source_size END AS target FROM s, l
), r AS (
  SELECT d.doc_id, d.size, g.*, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
    CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS DOUBLE) AS pos
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), o AS (
  SELECT source, n, CAST('0x' || substr(md5('17/' || n || '/' || coalesce('s' || source, '')), 1, 8) AS BIGINT) / 4294967296e0 AS shift FROM g, range(32) t(n)
), t AS (
  SELECT o.source, o.n, o.shift, abs(sum((floor(pos * rate + shift) - floor((pos - 1) * rate + shift)) * size) - any_value(target)) AS miss
  FROM r JOIN o ON r.source IS NOT DISTINCT FROM o.source GROUP BY o.source, o.n, o.shift
), b AS (
  SELECT source, shift FROM t QUALIFY row_number() OVER (PARTITION BY source ORDER BY miss, n) = 1
)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, source, copies
FROM (SELECT r.*, CAST(floor(pos * rate + shift) - floor((pos - 1) * rate + shift) AS BIGINT) AS copies FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source)
"""
