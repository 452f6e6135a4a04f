"""Cases of the findings of round 3, each of which failed before."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import scriptorium.plans  # noqa: F401
from scriptorium.llm.media import WITNESSES, describe, drawn, image_copies, to_graymap
from scriptorium.operators import graphs
from scriptorium.operators.batch import batch_listings
from scriptorium.registry import ORACLE_SQL, QUERIES
from scriptorium.sources.wiki import Wiki


@pytest.fixture(autouse=True)
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def test_heading_of_html_keeps_the_entities_that_its_sql_keeps(spark, tmp_path):
    rows = [(1, "<h1>a &quot;b&quot; &#39;c&#39;&nbsp;&lt;d&gt; &amp;quot; e</h1><p>x &quot;y&quot;</p>"), (2, "<p>none</p>"), (3, None)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    mine = sorted(tuple(r) for r in QUERIES["dc_heading_of_html"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert mine == sorted(con.sql(ORACLE_SQL["dc_heading_of_html"]).fetchall())
    assert mine[0][1] == "+ a &quot;b&quot; &#39;c&#39;&nbsp;<d> &quot; e"


def test_batch_of_broad_listings_makes_no_row_for_each_listing_and_page(spark, folder):
    wiki, made = Wiki(spark, folder), []

    def materialize(df):
        made.append(df.checkpoint())
        return made[-1]

    rows = [(n, f"-none-{n}", "*", "size desc", n, 5) for n in range(40)]
    queries = spark.createDataFrame(rows, "query_id int, tags string, category string, `order` string, offset int, limit int")
    found = batch_listings(wiki, queries, materialize=materialize)
    best = [r[0] for r in wiki.pages().filter("name not like '\\_%'").orderBy(F.col("size").desc(), F.col("page_id").desc()).select("page_id").collect()]
    assert sorted((r["query_id"], r["index"], r["page_id"], r["total"]) for r in found.collect()) == [(n, n + i + 1, best[n + i], len(best)) for n in range(40) for i in range(5)]
    assert max(df.count() for df in made) <= len(best) * 2


def test_page_forest_stores_no_whole_path_for_each_page(spark):
    stored = []

    def materialize(df):
        stored.append(df.checkpoint())
        return stored[-1]

    # A chain with a side page at every step, a short tree, and a cycle.
    parents = {n: n - 1 for n in range(2, 151)} | {1000 + n: n for n in range(1, 151)} | {1: None, 3000: 77777, 3001: 3000, 5000: 5001, 5001: 5000, 5002: 5001}
    pages = spark.createDataFrame([(k, p, f"name-{k}") for k, p in parents.items()], "page_id long, parent_id long, fullname string").repartition(4)

    def way(k):
        return [k] if parents.get(k) not in parents else [*way(parents[k]), k]

    want = {k: (way(k)[0], len(way(k)) - 1, "/".join(f"name-{n}" for n in way(k)), False) for k in parents if k < 5000}
    want |= {5000: (None, None, None, True), 5001: (None, None, None, True), 5002: (None, None, None, False)}
    found = graphs.page_forest(pages, materialize)
    assert {r["page_id"]: (r["root_id"], r["depth"], r["path"], r["cyclic"]) for r in found.collect()} == want
    size = sum(df.select(F.sum(F.length(c))).first()[0] or 0 for df in stored for c in df.columns if c in ("path", "names"))
    assert size < sum(len(w[2] or "") for w in want.values())


def test_image_copies_are_found_behind_smaller_images_of_their_keys(spark):
    pixels = np.round(drawn(np.arange(8, dtype=np.float32))[:56, :56])
    corners = sorted({(int(n) >> 38, int(n) >> 12 & (1 << 26) - 1) for n in describe(pixels)[1]})
    rows = []
    for y, x in corners:  # each corner alone stands in an image of its own, before the copies
        alone = np.full((56, 56), 128.0)
        part = np.s_[max(y - 12, 0) : y + 13, max(x - 12, 0) : x + 13]
        alone[part] = pixels[part]
        rows.append((len(rows) + 1, to_graymap(alone)))
    share = {r["id"]: r["share"] for r in spark.range(1000, 1020).select("id", F.pmod(F.xxhash64("id"), F.lit(WITNESSES)).alias("share")).collect()}
    other = next(n for n in share if share[n] != share[1000])
    rows += [(1000, to_graymap(pixels)), (other, to_graymap(np.round(pixels) + 3))]
    found = {r["image_id"]: r["group_id"] for r in image_copies(spark.createDataFrame(rows, "image_id long, media binary")).collect()}
    assert len(corners) > 8 and found[1000] == 1000 and found[other] == 1000
