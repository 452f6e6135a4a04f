"""Cases of the review's first round."""

import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import lines, mixing, suffixes
from scriptorium.llm.token_files import read_token_files, token_positions, write_token_files
from scriptorium.llm.tokens import tokenizer_path
from tests.llm.test_training_data import SPLITS, WORDS, covered, prose


@pytest.mark.parametrize("splits", SPLITS)
def test_suffixes_tell_texts_of_one_id_apart(spark, splits, monkeypatch):
    """300 texts without an id and 300 of one id, some with a passage in common, some rows repeated."""
    monkeypatch.setattr(suffixes, "SPLITS", splits)
    rng = random.Random(9)
    shared = [prose(rng, 60) for _ in range(8)]
    rows = [(None if n < 300 else 5, f"{prose(rng, rng.randrange(30, 70))} {shared[n % 40] if n % 40 < 8 else ''} {prose(rng, 35)}") for n in range(600)]
    rows += [rows[1], rows[1], rows[301], rows[9]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = suffixes.repeated_substrings(docs).select("doc_id", "n_bytes", "n_removed", F.size("removed"), "kept_sha256").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(str((r[0], *c)) for r, c in zip(rows, covered([r[1] for r in rows])))


def test_lines_with_a_stop_after_most_words():
    """An exact copy of shouted words, as sf0.01 documents 913 and 957 are of 521."""
    rng = random.Random(1)
    raw = " ".join(f"{rng.choice(WORDS).upper()}x{rng.randrange(50)}!!" for _ in range(169)).encode()
    place = lines.units(raw)[0]
    assert lines.repeated_spans(raw, place, lines.LEAST_WORDS, lines.SHORT) == [(0, len(raw))]


def test_lines_cut_passages_of_few_stops(spark):
    """Passages of 50 words without a stop, in the middle of two long lines."""
    rng = random.Random(2)
    word = lambda: f"{rng.choice(WORDS)}{rng.randrange(9)}"
    run = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for n in range(200):
        passage = run(50)
        rows += [(2 * n, f"{run(31)} {passage} {run(20)}"), (2 * n + 1, f"{run(17)} {passage} {run(43)}")]
    found = {r["doc_id"]: r for r in lines.dedup_units(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[2 * n]["removed"] == [] for n in range(200))
    assert sum(bool(found[2 * n + 1]["removed"]) for n in range(200)) == 200


def test_lines_repeat_whatever_their_length(spark):
    rows = [(1, "Alpha beta.\nOne line of nine words that comes again here.\ngamma"), (2, "Delta\none line  of nine words that comes again here.\nepsilon"), (3, "Alpha beta.\nzeta")]
    found = {r["doc_id"]: r["text"] for r in lines.dedup_units(spark.createDataFrame(rows, "doc_id long, text string"), short=3).collect()}
    assert found == {1: rows[0][1], 2: "Delta\nepsilon", 3: rows[2][1]}


def test_lines_of_documents_named_in_the_review(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = {r["doc_id"]: r["removed"] for r in lines.dedup_units(docs).filter("doc_id in (913, 957, 554, 774, 551)").collect()}
    assert all(found[i] for i in (913, 957, 554, 774, 551))


def test_mixing_stage_copies_each_row_by_its_own_number(spark):
    """Rows without an id keep their sources' shares of the mix."""
    rng = random.Random(5)
    rows = [(None, prose(rng, 40), "en", f"s{n % 3}", 0) for n in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()
    want = {r["source"]: r["n"] for r in mixing.mix_sources(docs).groupBy("source").agg(F.sum("copies").alias("n")).collect()}
    found = {r["source"]: r["count"] for r in corpus_pipeline.mixed(spark, docs, "").groupBy("source").count().collect()}
    assert found == want and len(set(want.values())) > 1


def test_token_positions_are_in_the_order_of_the_file(spark, tmp_path):
    """Many texts without an id: each start is where the ids are in the files."""
    rng = random.Random(6)
    docs = spark.createDataFrame([(None if n % 2 else 7, prose(rng, rng.randrange(1, 30))) for n in range(60)], "doc_id long, text string")
    write_token_files(docs, str(tmp_path / "t"), tokenizer_path("word_bpe_49k.json"))
    files = read_token_files(spark, str(tmp_path / "t"))
    ids = [i for p in sorted((tmp_path / "t").glob("part-*.parquet")) for row in pq.read_table(p)["tokens"].to_pylist() for i in row]
    for r in token_positions(files).collect():
        assert zlib.crc32(np.array(ids[r["start"] : r["start"] + r["n_tokens"]], "<u4").tobytes()) == r["ids_crc32"]
