"""Rows of one row group, or that compress well, are worked on by more than a few tasks, with the same results."""

import pytest
from pyspark.sql import functions as F

import scriptorium.plans  # noqa: F401
from scriptorium.functions import text
from scriptorium.operators import aggregates, graphs
from scriptorium.sources import wiki as tables


@pytest.fixture(autouse=True)
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def test_tree_of_a_page_is_made_alone_and_meets_at_no_root(spark, monkeypatch):
    monkeypatch.setattr(tables, "SHARE", 1)
    stored = []

    def materialize(df):
        stored.append(df.checkpoint())
        return stored[-1]

    rows = [(n, n // 8 if n else None, f"p{n}") for n in range(600)] + [(1000, 1001, "a"), (1001, 1000, "b"), (1002, 1001, "c")]
    pages = spark.createDataFrame(rows, "page_id long, parent_id long, fullname string")
    found = {r["page_id"]: r for r in graphs.page_forest(pages, materialize, top=3).collect()}

    def way(n):
        return [n] if n == 3 else [*way(n // 8), n] if n > 3 else [None]

    want = {n: way(n) for n in range(600) if way(n)[0] == 3}
    assert {n: (r["root_id"], r["depth"], r["path"]) for n, r in found.items()} == {n: (3, len(w) - 1, "/".join(f"p{x}" for x in w)) for n, w in want.items()}
    # After the first step no page that is still open stands at a root, where all of a level would meet.
    rounds = [df for df in stored if df.columns == ["page_id", "at", "hops", "closed"]][1:]
    assert rounds and all(df.filter("not closed and at in (0, 3)").isEmpty() for df in rounds)
    assert graphs.page_forest(pages, top=1000).isEmpty() and graphs.page_forest(pages, top=5000).isEmpty()


#: Queries whose work for each row is spread: before, a table of one row group was one task.
SPREAD = [
    "rn_html", "rn_round_trip", "nd_tokens", "wn_heading_parents",
    "dt_include_raw", "dt_include_expansion", "dt_include_sites", "dt_include_trace", "dt_include_refresh",
]


@pytest.mark.parametrize("name", SPREAD)
def test_query_spreads_its_rows(name, spark, folder):
    from scriptorium.registry import QUERIES

    assert QUERIES[name](spark, folder).rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_status_of_a_cloud_tells_no_tags_apart(spark, folder):
    from scriptorium.registry import QUERIES

    assert "Aggregate [page_id" not in QUERIES["ag_cloud_status"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()


def test_tags_are_spread_before_each_is_taken_once(spark, folder):
    from scriptorium.registry import QUERIES

    assert "RepartitionByExpression [page_id" in QUERIES["ag_tag_cloud"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_text_of_a_number_names_its_value_once_and_formats_no_null(spark):
    """a value that every branch names makes code too large to be compiled; a null that is formatted and read back costs an exception."""
    rows = spark.createDataFrame([(4.0,), (None,), (0.1 + 0.2,), (-12.5,), (2.0**53,), (2.0**-44,), (123456.7890625,), (1.2e-3,), (-9.9e-4,), (12345678.5,)], "x double")
    made = rows.select(text.number_text(F.sqrt(F.col("x") * F.col("x")) * F.signum("x")).alias("t"))
    assert _plan(made).count("SQRT(") == 1 and "isnotnull" in _plan(made)
    assert [r["t"] for r in rows.select(text.number_text(F.col("x")).alias("t")).collect()] == [
        "4", None, "0.30000000000000004", "-12.5", "9007199254740992", "5.684341886080802e-14", "123456.7890625", "0.0012", "-0.00099", "12345678.5"]


def test_lists_of_depths_are_spread(spark, folder):
    """before, adaptive execution left all lists to one task, as their numbers compress well."""
    from scriptorium.registry import QUERIES

    assert all("RepartitionByExpression [l_orderkey" in _plan(QUERIES[name](spark, folder)) for name in ("wn_depth_tree", "se_styles_left", "se_styles_merged"))


def test_tag_conditions_of_a_page_need_no_shuffle(spark):
    """F16: before, each round shuffled, joined and stored all texts."""
    rows = [(1, ["a"], "x[[iftags +a]]A[[iftags b]]B[[/iftags]]@@[[/iftags]]@@[[/iftags]]y[[iftags +a]]A[[/iftags]]"), (1, ["b"], "[[iftags +a]]A[[/iftags]]"), (2, None, "[[iftags]][[/iftags]]"), (3, ["a"], None)]
    texts = spark.createDataFrame(rows, "page_id long, tags array<string>, source_text string")
    made = aggregates.expand_iftags(texts)
    # Two rows of one page have their own tags each.
    assert sorted((r["page_id"], r["source_text"] or "") for r in made.collect()) == [(1, ""), (1, "xA@@[[/iftags]]@@yA"), (2, "[[iftags]][[/iftags]]"), (3, "")]
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_long_values_of_includes_are_read(spark):
    """F8: before, each character of a value was a step of the pattern's stack, which a long value overflowed."""
    value = "v [x] [[[page]]] [[module Rate]] " + "w" * 60_000
    texts = spark.createDataFrame([(1, "a", f"[[include one | k={value}]]\nend")], "page_id long, fullname string, source_text string")
    library = spark.createDataFrame([("one", "<{$k}>")], "page string, content string")
    assert aggregates.expand_includes(texts, library).first()["source_text"] == f"<{value}>\nend"


def test_texts_with_nothing_left_to_put_in_need_no_further_round(spark):
    """before, a text that only includes itself was parted, joined and stored once more; two rows of one page were mixed up."""
    stored = []

    def materialize(df):
        stored.append(df.checkpoint())
        return stored[-1]

    rows = [(1, "a", "x\n[[include one | k=@@|@@]]\n[[include a]]"), (1, "a", "[[include none]]\n[!--\n[[include one | k=@@]]\n--]"), (2, "b", None), (3, "c", "[[include c]]")]
    texts = spark.createDataFrame(rows, "page_id long, fullname string, source_text string")
    library = spark.createDataFrame([("one", "<{$k}>")], "page string, content string")
    found = aggregates.expand_includes(texts, library, materialize=materialize, trace=True).collect()
    error = '[[div class="error-block"]]\nPage to be included "none" cannot be found!\n[[/div]]'
    assert sorted((r["page_id"], r["source_text"] or "", r["rounds"], r["too_long"], [x["page"] for x in r["included"]]) for r in found) == [
        (1, error + "\n[!--\n<@@>\n--]", 1, False, ["none", "one"]), (1, "x\n<@@|@@>\n[[include a]]", 1, False, ["one"]), (2, "", 0, False, []), (3, "[[include c]]", 0, False, [])]
    assert len(stored) == 1 and [r["source_text"] for r in found if r["page_id"] == 2] == [None]


def test_refresh_reads_the_trace_and_no_texts_for_edges(spark, monkeypatch):
    """before, all texts and all pages of the library were parted for their edges, and these told apart."""
    library = spark.createDataFrame([("a", "[[include b]]"), ("b", "old"), ("c", "see")], "page string, content string")
    texts = spark.createDataFrame([(1, "p1", "[[include A]]"), (2, "p2", "[[include c]]"), (3, "p3", "[[include d]]")], "page_id long, fullname string, source_text string")
    stored = aggregates.expand_includes(texts, library, trace=True).checkpoint()
    monkeypatch.setattr(graphs, "include_edges", None)
    new = spark.createDataFrame([("a", "[[include b]]"), ("b", "new"), ("c", "see"), ("d", "there")], "page string, content string")
    out = graphs.refreshed(stored, texts, new, spark.createDataFrame([("B",), ("d",)], "page string"))
    assert sorted((r["page_id"], r["source_text"], r["renewed"]) for r in out.collect()) == [(1, "new", True), (2, "see", False), (3, "there", True)]


def test_excerpt_of_a_first_match_looks_for_no_other(spark, folder):
    """before, all matches of a text and all runs of its loops were gathered for its first match, in one task for a table of one row group."""
    from scriptorium.registry import QUERIES

    texts = spark.createDataFrame([("ab cd ef",), ("",), (None,), ("x" * 90_000,), ("\U0001F600" * 499_999 + "ab cd",), ("\U0001F600" * 500_001 + "ab cd",)], "t string")
    made = texts.select(text.excerpt(F.col("t"), "([a-w]+) ([a-w]+)", group=2).alias("e"))
    assert [r["e"] for r in made.collect()] == ["cd", "", "", "", "", ""]
    assert [r["e"] for r in texts.select(text.excerpt(F.col("t"), "[a-w]+").alias("e")).collect()] == ["ab", "", "", "", "", ""]
    assert "regexp_extract(t" in _plan(texts.select(text.excerpt(F.col("t"), "a.").alias("e")))
    assert "RepartitionByExpression [doc_id" in _plan(QUERIES["st_excerpt_options"](spark, folder))
