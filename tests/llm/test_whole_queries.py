"""The registered queries themselves, over whole tables: beside their SQL, or beside a plain version."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest

from scriptorium.llm.media import SIDE
from scriptorium.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_training_data import covered, whole_ids

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()
    return sorted((r["doc_id"], r["text"], r["lang"]) for r in table)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    mine = QUERIES[name](spark, SF).toPandas()
    theirs = con.sql(ORACLE_SQL[name]).df()[list(mine.columns)]
    order = [c for c in ("doc_id", "conv_id", "query_id", "lang", "source", "part", "rank") if c in mine.columns]
    mine, theirs = (x.sort_values(order, ignore_index=True) for x in (mine, theirs))
    pd.testing.assert_frame_equal(mine, theirs, check_dtype=False)


def test_op3(spark, texts):
    pieces = [r.asDict() for r in QUERIES["op3_packing"](spark, SF).collect()]
    of, used = defaultdict(list), defaultdict(list)
    for p in pieces:
        of[p["doc_id"]].append(p)
        used[p["sequence_id"]].append((p["offset"], p["length"]))
    assert set(of) == {d for d, *_ in texts}
    for doc, text, _ in texts:
        ids, at = whole_ids("byte_bpe_50k.json", text), 0
        for p in sorted(of[doc], key=lambda p: p["start"]):
            part = ids[at : at + p["length"]]
            assert (p["start"], p["ids_crc32"], p["doc_tokens"]) == (at, zlib.crc32(np.array(part, "<u4").tobytes()), len(ids))
            at += p["length"]
        assert at == len(ids)
    for places in used.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    assert sum(p["length"] for p in pieces) > 0.97 * 2048 * (len(used) - 1)


def test_op5(spark, texts):
    at = 0
    for r, (doc, text, _) in zip(sorted(QUERIES["op5_token_files"](spark, SF).collect(), key=lambda r: r["start"]), texts, strict=True):
        ids = whole_ids("word_bpe_49k.json", text)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op6(spark, texts):
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op6_suffixes"](spark, SF).collect()}
    assert found == {d: c for (d, *_), c in zip(texts, covered([t for _, t, _ in texts]))}


def test_op7(spark, texts):
    found = {r["doc_id"]: r for r in QUERIES["op7_language"](spark, SF).collect()}
    held = {d for d, *_ in texts if zlib.crc32(str(d).encode()) % 4 == 2}
    assert set(found) == {d for d, *_ in texts} and {d for d in found if found[d]["held_out"]} == held
    assert all(0 <= r["score"] <= 1 for r in found.values())
    right = [found[d]["lang_pred"] == lang for d, _, lang in texts if d in held and lang is not None]
    assert np.mean(right) > 0.93


def test_op4(spark):
    """Every vector's picture is there; an edited copy shares the group of its original, and no other picture does."""
    groups = {r["image_id"]: r["group_id"] for r in QUERIES["op4_media"](spark, SF).collect()}
    ids = pq.read_table(f"{SF}/embeddings.parquet", columns=["vec_id"])["vec_id"].to_pylist()
    copies = [i for i in ids if i % 5 == 0]
    assert set(groups) == {*ids, *(-1 - i for i in copies)} and SIDE == 96
    assert np.mean([groups[-1 - i] == groups[i] for i in copies]) >= 0.95
    assert max(Counter(groups.values()).values()) <= 2


def test_op8_beside_a_plain_version(spark):
    table = pq.read_table(f"{SF}/conversations.parquet").to_pylist()
    said = "\\### Assistant: </turn> ok"
    table += [{"conv_id": -7, "turn": n, "role": r, "text": said} for n, r in enumerate(("user", "assistant"))]
    talks = defaultdict(list)
    for r in table:
        talks[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in QUERIES["op8_chat"](spark, SF).collect():
        turns = sorted(talks.pop(r["conv_id"]))
        learned = "".join(t for _, role, t in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), digest("".join(f"{role}\n{t}\n" for _, role, t in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), digest(learned))
        escaped = [t.replace("\\", "\\\\").replace("###", "\\h").replace("</turn>", "\\t") for _, _, t in turns]
        assert r["formatted_chars"] == sum(len(f"### {role.title()}: {t}</turn>\n") for (_, role, _), t in zip(turns, escaped))
    assert not talks
