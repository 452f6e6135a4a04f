"""The pipeline's stages beside plain versions, on odd rows and on empty tables."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from scriptorium.llm import lines
from scriptorium.llm.language import identify, train
from tests.llm.test_training_data import plain_copies, plain_targets, prose, shingles, whole_ids

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row_no string, removed int, score double"


@pytest.fixture(scope="module")
def rows():
    """Several texts of one id, equal rows, null ids, null and empty texts, near copies, clashing columns."""
    rng = random.Random(14)
    base = [prose(rng, 130) for _ in range(30)]
    near = " ".join(base[4].split()[:-1] + ["other"])
    texts = [(n, t) for n, t in enumerate(base)] + [(7, base[4]), (7, base[8] + " more"), (7, "quite another text of its own"), (None, base[5]), (None, near), (50, near), (51, None), (52, ""), (53, " \n"), (None, None), (3, base[3]), (54, prose(rng, 6000))]
    return [(i, t, ["en", "de"][n % 2], [None, "a", "b"][n % 3], 5, "x", 1, 0.5) for n, (i, t) in enumerate(texts)] + [(3, base[3], "de", "a", 5, "x", 1, 0.5)] * 2


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def texts_of(frame):
    assert tuple(frame.columns) == corpus_pipeline.COLUMNS
    return Counter((r["doc_id"], r["text"]) for r in frame.collect())


def test_language_stage(spark, docs, rows):
    kept = corpus_pipeline.known_language(spark, docs, "")
    judged = identify(docs, train(docs)).filter("not rejected")
    assert texts_of(kept) == Counter((r["doc_id"], r["text"]) for r in judged.collect())
    assert not any(t is None or not t.strip() for _, t in texts_of(kept))
    assert {r["lang"] for r in kept.collect()} <= {"en", "de"}


def test_near_dedup_stage(spark, docs, rows):
    """Of each group that five-word shingles link, the row of smallest id stays; every row is a document of its own."""
    sets = [shingles(r[1], 5) for r in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if k in (x, y) else k for k in root]
    groups = defaultdict(list)
    for n, k in enumerate(root):
        groups[k].append(n)
    stays = [min(g, key=lambda n: (rows[n][0] is None, rows[n][0] or 0)) for g in groups.values()]
    want = Counter((rows[n][0], tuple(sorted(sets[n]))) for n in stays)
    found = texts_of(corpus_pipeline.one_of_each_group(spark, docs, ""))
    assert Counter((i, tuple(sorted(shingles(t, 5)))) for (i, t), n in found.items() for _ in range(n)) == want
    sixty = spark.createDataFrame([(1, f"document {n} " + " ".join(f"w{n}x{k}" for k in range(20)), "en", "s", 0) for n in range(60)], ", ".join(DOCS.split(", ")[:5]))
    assert corpus_pipeline.one_of_each_group(spark, sixty, "").count() == 60


def test_substring_stage(spark, docs, rows):
    """Repeated units go, texts that had words and have none left go, others stay with their length."""
    kept = corpus_pipeline.without_repeats(spark, docs, "")
    out = [(r["doc_id"], r["text"], r["removed"]) for r in lines.dedup_units(docs).collect()]
    want = Counter((i, t) for i, t, gone in out if not gone or (t or "").strip(" \t\n\x0b\x0c\r"))
    assert texts_of(kept) == want
    assert all(r["n_chars"] == (5 if r["text"] is None else len(r["text"])) for r in kept.collect())
    assert (51, None) in want and (52, "") in want and (7, rows[4][1]) not in want


def test_mixing_stage(spark, docs, rows):
    """Every row as often as a plain loop takes it; rows of one source, size and id are alike to it."""
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    goal = plain_targets(sizes)
    items = [(r[3], len((r[1] or "").split()), -1 if r[0] is None else r[0], n) for n, r in enumerate(rows)]
    copies, want = plain_copies(items, goal, sizes), Counter()
    for source, size, doc, n in items:
        want[source, size, doc] += copies[n]
    found = Counter((r["source"], len((r["text"] or "").split()), -1 if r["doc_id"] is None else r["doc_id"]) for r in corpus_pipeline.mixed(spark, docs, "").collect())
    assert found == +want


def test_packing_stage(spark, docs, rows):
    pieces = corpus_pipeline.packed(spark, docs, "").collect()
    want = Counter(i for r in rows for i in whole_ids("byte_bpe_50k.json", r[1]))
    assert Counter(i for p in pieces for i in p["ids"]) == want


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_no_rows(spark, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs.limit(0), "")
    assert out.count() == 0
    assert name == "packing" or tuple(out.columns) == corpus_pipeline.COLUMNS


def test_run_loses_no_clean_document(spark):
    """All stages over a whole table: what is packed comes from documents, and no sequence is too long."""
    pieces = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    known = {r["doc_id"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id").collect()}
    used = Counter()
    for p in pieces:
        used[p["sequence_id"]] += p["length"]
    assert {p["doc_id"] for p in pieces} <= known and max(used.values()) <= 2048 and len(pieces) > 100
