"""Two texts of one id, columns of any name and type, and what a run leaves in the shared folder."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm.common import Scratch, shared_dir
from scriptorium.llm.language import identify, train
from scriptorium.llm.lines import dedup_units
from scriptorium.llm.minhash import near_duplicates
from tests.llm.test_training_data import prose

WORDS = 60


def test_two_texts_of_one_id_are_two_documents(spark):
    import random

    rng = random.Random(2)
    one, two, other = (prose(rng, WORDS) for _ in range(3))
    rows = [(5, one), (5, two), (6, one + " more"), (7, two + " more"), (8, other), (3, other), (3, None), (5, one)]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    found = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in out}
    size = {t: len(set(zip(t.split(), t.split()[1:]))) for t in (one, two, other, one + " more", two + " more")}
    assert len(out) == len(rows)
    assert found[6, size[one + " more"]] == (5, False) and found[7, size[two + " more"]] == (5, False)
    assert found[8, size[other]] == (3, False) and found[3, size[other]] == (3, True) and found[3, 0] == (3, True)
    assert all(found[5, size[t]] == (5, True) for t in (one, two))


@pytest.fixture
def odd(spark):
    rows = [(n, "one line that stays\nand one that comes again and again\n" * 2, "en", (n, "x"), [n], 1.5, {"k": n}) for n in range(6)]
    schema = "doc_id long, TEXT string, lang string, `a b` struct<`c d`:long,`e``f`:string>, `t``ick` array<int>, `dot.ted` double, Removed map<string,long>"
    return spark.createDataFrame(rows, schema)


def test_any_columns_pass_through(odd):
    cut = dedup_units(odd)
    assert [f for f in cut.schema if f.name != "removed"] == [f for f in odd.schema if f.name != "Removed"]
    rows = {r["doc_id"]: r for r in cut.collect()}
    assert rows[0]["TEXT"] == "one line that stays\nand one that comes again and again\n" and rows[5]["TEXT"] == "" and rows[4]["a b"]["e`f"] == "x"
    model = train(odd.withColumnRenamed("TEXT", "text"))
    named = identify(odd, model)
    assert named.columns[:-3] == odd.columns and {r["dot.ted"] for r in named.collect()} == {1.5} and {r["lang_pred"] for r in named.collect()} <= {"en", "und"}


def _tables(spark):
    folder = Path(shared_dir(spark).removeprefix("file://")) / "scriptorium"
    return set(folder.iterdir()) if folder.exists() else set()


def test_failed_writes_leave_nothing(spark):
    before = _tables(spark)
    bad = spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    for name in ("write", "keep"):
        with pytest.raises(Exception, match="no"), Scratch(spark) as scratch:
            getattr(scratch, name)(bad.repartition(2))
    assert _tables(spark) == before


def test_pipeline_leaves_only_what_its_rows_need(spark):
    """After a run the stages' tables are gone; what stays is kept for the rows and goes with the application."""
    before = _tables(spark)
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = _tables(spark) - before
    assert out.count() and out.count()
    stages = [t for t in left if {"n_chars", "text"} <= set(spark.read.parquet(str(t)).columns) and "row_no" not in spark.read.parquet(str(t)).columns]
    assert not stages
