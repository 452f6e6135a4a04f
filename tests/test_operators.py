"""Include and tag-condition expansion at their limits, listings past their ends, and vote rules."""

from datetime import datetime

from pyspark.sql import functions as F

from scriptorium.operators import aggregates, ratings
from scriptorium.operators.listing import Current, Listing, PageQuery
from scriptorium.sources.wiki import Wiki


def here(df):
    return df.cache()


def test_includes(spark):
    texts = spark.createDataFrame([(1, "a", "x\n[[include one|k=v|k=w]]\ny"), (2, "b", "[[include b]]"), (3, "c", "[[include none]]"), (4, "d", "no includes"), (5, "e", "[[include big]]")], "page_id long, fullname string, source_text string")
    library = spark.createDataFrame([("one", "{$k} {$k} {$q}\n[[include two]]"), ("two", "end"), ("big", "z" * 60)], "page string, content string")
    found = {r["page_id"]: r for r in aggregates.expand_includes(texts, library, most=50, materialize=here).collect()}
    assert found[1]["source_text"] == "x\nv v {$q}\nend\ny" and found[1]["rounds"] == 2
    assert found[2]["source_text"] == "[[include b]]"
    assert 'Page to be included "none" cannot be found!' in found[3]["source_text"] or found[3]["too_long"]
    assert found[5]["too_long"] and found[5]["source_text"] == "[[include big]]"


def test_include_trace_and_selection(spark):
    texts = spark.createDataFrame([(1, "a", "[[include one]]\n[[include :far:one]]\n[[include two]]"), (2, "b", "none")], "page_id long, fullname string, source_text string")
    library = spark.createDataFrame([("one", "1\n[[include two]]"), ("two", "2")], "page string, content string")
    found = {r["page_id"]: r for r in aggregates.expand_includes(texts, library, materialize=here, trace=True).collect()}
    assert [(x["round"], x["ord"], x["page"]) for x in found[1]["included"]] == [(1, 0, "one"), (1, 1, "one"), (1, 2, "two"), (2, 0, "two")]
    assert found[1]["source_text"].startswith("1\n2\n[[div") and found[1]["source_text"].endswith("\n2") and found[2]["included"] == []
    only = aggregates.expand_includes(texts, library, materialize=here, only=["two"]).filter("page_id = 1").first()
    assert only["source_text"] == "[[include one]]\n[[include :far:one]]\n2"


def test_undecided_conditions_stay(spark):
    texts = spark.createDataFrame([(1, None, "[[iftags a]]A[[/iftags]]"), (2, ["a"], "[[iftags a]]A[[/iftags]]")], "page_id long, tags array<string>, source_text string")
    assert {r["page_id"]: r["source_text"] for r in aggregates.expand_iftags(texts, materialize=here).collect()} == {1: "[[iftags a]]A[[/iftags]]", 2: "A"}


def test_listings_without_what_they_sort_or_rate_by(spark, folder):
    """An unregistered key to sort by, an axis that is unknown or hidden: no result, and no other order instead."""
    wiki = Wiki(spark, folder)
    for query in (PageQuery(category="*", order="metadata{nothing}"), PageQuery(category="*", rating_axis="nothing"), PageQuery(category="*", rating_axis="error")):
        assert Listing(wiki, query).page().count() == 0
    assert Listing(wiki, PageQuery(category="*", rating_axis="click")).page().count() == 20


def test_endless_include_stops(spark):
    texts = spark.createDataFrame([(1, "a", "[[include loop]]")], "page_id long, fullname string, source_text string")
    library = spark.createDataFrame([("loop", ".\n[[include loop]]")], "page string, content string")
    row = aggregates.expand_includes(texts, library, rounds=3, materialize=here).first()
    assert row["rounds"] == 3 and row["source_text"].count(".") == 3


def test_iftags(spark):
    rows = [(1, ["a"], "[[iftags +a]]A[[iftags b]]B[[/iftags]][[/iftags]][[iftags -a]]N[[/iftags]]"), (2, ["a", "b"], "[[iftags +]]x[[/iftags]][[iftags -]]y[[/iftags]]"), (3, [], "[[iftags +a]]open")]
    texts = spark.createDataFrame(rows, "page_id long, tags array<string>, source_text string")
    found = {r["page_id"]: r["source_text"] for r in aggregates.expand_iftags(texts, materialize=here).collect()}
    assert found == {1: "A", 2: "y", 3: "[[iftags +a]]open"}


def test_page_past_the_end(spark, folder):
    listing = Listing(Wiki(spark, folder), PageQuery(category="*", created_at="1997", per_page=20, limit=41, offset=3), Current(now=datetime(2000, 1, 1)))
    last = listing.page(9)
    assert [r["index"] for r in last.orderBy("index").collect()] == [44]
    assert listing.page(1).count() == 20


def test_latest_vote_wins(spark):
    votes = spark.createDataFrame([(1, 1, 9, 1, 5), (2, 1, 9, -1, 7), (3, 1, 9, 0, 7), (4, 2, 9, 1, 1)], "vote_id long, user_id long, page_id long, rate int, ts int")
    assert {(r["user_id"], r["rate"]) for r in ratings.latest(votes, "user_id", "page_id").collect()} == {(1, 0), (2, 1)}
    assert spark.range(1).select(ratings.percent(F.lit(1), F.lit(8)).alias("p")).first()["p"] == 13
