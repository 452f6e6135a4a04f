"""Training-data operators against plain versions, and on nulls, empty tables, ties, repeats and clashing columns."""

import functools
import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scriptorium.llm import lines, minhash, mixing, suffixes
from scriptorium.llm.chat import ChatTemplate, format_conversations, read_formatted
from scriptorium.llm.common import Scratch
from scriptorium.llm.language import identify, train
from scriptorium.llm.media import drawn, image_copies, to_graymap
from scriptorium.llm.packing import pack_documents
from scriptorium.llm.token_files import read_token_files, token_positions, write_token_files
from scriptorium.llm.tokens import ChunkMemo, tokenizer_path
from scriptorium.llm.topk import Cells, top_k

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, kid string"
WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Odd rows beside ordinary ones: null, empty, blank, very long, copies, near copies, a null id, a repeated row."""
    rng = random.Random(4)
    passage = prose(rng, 70) + "."
    texts = [None, "", "  \n ", "one", "One", prose(rng, 9000), *(prose(rng, 120) for _ in range(20))]
    texts += [texts[8], texts[9] + " extra", f"{prose(rng, 40)}.\n{passage}\n{prose(rng, 30)}", f"{prose(rng, 50)}. {passage} {prose(rng, 20)}", "żółć " * 80, "żółć " * 80]
    out = [(i, t, ["de", "en", None][i % 3], f"s{i % 4}" if i % 7 else None, 0, 9, "k") for i, t in enumerate(texts)]
    return out + [out[10], (None, texts[11], None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text, width):
    words = [w for w in "".join(c if c not in "\t\n\x0b\x0c\r" else " " for c in (text or "")).split(" ") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(width))))


@pytest.mark.parametrize("width", [2, 5])
def test_minhash(docs, rows, width):
    found = {(r["doc_id"], r["n_shingles"]): r for r in minhash.near_duplicates(docs, width).collect()}
    sets = {r[0]: shingles(r[1], width) for r in rows if r[0] is not None}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    for i, s in sets.items():
        r = found[i, len(s)]
        assert (r["component_id"], r["kept"]) == (root[i], root[i] == i)
    assert [r["component_id"] for r in found.values() if r["doc_id"] is None] == [None]


def test_minhash_across_components(spark):
    """Edited copies that are like the original and not like one another, and an outlier among them."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(200)]
    texts = [" ".join(base)]
    for _ in range(60):
        words = list(base)
        for i in rng.sample(range(200), 9):
            words[i] = f"x{rng.random()}"
        texts.append(" ".join(words))
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = spark.createDataFrame([(i, t) for i, t in zip(order, texts)], "doc_id long, text string")
    sets = {i: shingles(t, 2) for i, t in zip(order, texts)}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, 2).collect()} == root


def test_super_minhash_estimates():
    rng = np.random.default_rng(1)
    both, one, two = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (700, 150, 150))
    x, y = minhash.super_minhash([np.concatenate([both, one]), np.concatenate([both, two])])
    assert abs((x == y).mean() - 0.7) < 0.12
    assert (minhash.super_minhash([both[:1]]) < np.iinfo(np.uint64).max).all()


@pytest.mark.parametrize("together", [minhash.TOGETHER, 20])
def test_components(spark, together):
    rng = random.Random(2)
    pairs = [tuple(sorted(rng.sample(range(400), 2))) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)] + [(600, i) for i in range(601, 700)]
    root = {i: i for p in pairs for i in p}
    for a, b in pairs:
        x, y = root[a], root[b]
        root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    found = {r["id"]: r["root"] for r in minhash.components(spark.createDataFrame(pairs, "a long, b long").repartition(7), Scratch(spark), together).collect()}
    assert {k: found.get(k, k) for k in root} == root


def covered(texts, length=suffixes.LENGTH):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


#: Every bucket whole, in ranges, and by single strings.
SPLITS = [suffixes.SPLITS, ((0, 23),), ((0, 1),)]


@pytest.mark.parametrize("splits", SPLITS)
def test_suffixes(docs, rows, splits, monkeypatch):
    monkeypatch.setattr(suffixes, "SPLITS", splits)
    found = suffixes.repeated_substrings(docs).select("doc_id", "n_bytes", "n_removed", F.size("removed"), "kept_sha256").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(str((r[0], *c)) for r, c in zip(rows, covered([r[1] for r in rows])))


def test_cover_sorts_suffixes():
    rng = random.Random(3)
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD)) and (suffixes.SHIFT >= 0).all()
    texts = ["".join(rng.choice("ab") for _ in range(rng.choice([0, 5, 70]))) * rng.choice([1, 3]) for _ in range(80)]
    texts = [t.encode() for t in texts + texts[:20] + [t + "a" for t in texts[:20]]]
    order = suffixes.CoverSorter(texts).bucket(list(range(len(texts))))
    assert [texts[i] for i in order] == sorted(texts)


def test_lines(docs, rows):
    found = {(r["doc_id"], r["n_chars"]): r for r in lines.dedup_units(docs).collect()}
    assert len(found) == len({(r[0], r[4]) for r in rows})
    shared = [r for r in found.values() if r["doc_id"] in (28, 29)]
    by = {r["doc_id"]: r for r in shared}
    texts = {r[0]: r[1] for r in rows}
    assert by[28]["text"] == texts[28] and by[28]["removed"] == []
    assert len(by[29]["text"]) < len(texts[29]) and by[29]["removed"]
    for r in found.values():
        if r["removed"]:
            raw, at, kept = texts[r["doc_id"] if r["doc_id"] is not None else 11].encode(), 0, b""
            for s in r["removed"]:
                kept, at = kept + raw[at : s["start"]], s["start"] + s["length"]
            assert (kept + raw[at:]).decode() == r["text"]
    assert found[26, 0]["text"].strip() == ""  # an exact copy of document 8
    assert found[0, 0]["text"] is None and found[1, 0]["text"] == "" and found[8, 0]["removed"] == []


def test_token_memo():
    rng = random.Random(3)
    parts = ["a", "B", "é", ".", ",", " ", "\n", "\t", "!", "0", "'s", " ", "“", "好", "\x1c", "  ", ". ", "Foo", "ß", "<|endoftext|>"]
    parts += ["<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "  \n "]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        memo = ChunkMemo(tokenizer_path(name))
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 14))) for _ in range(1500)] + ["plain words, and more. " * 4000, ""]
        for text, ids in zip(texts, memo.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain_tokenizer(name).encode(text, add_special_tokens=False).ids


@functools.cache
def plain_tokenizer(name):
    """The named file's tokenizer as it is."""
    return Tokenizer.from_file(tokenizer_path(name))


def whole_ids(name, text):
    return plain_tokenizer(name).encode(text or "", add_special_tokens=False).ids + [1]


def test_packing(docs, rows):
    pieces = pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), length=256, open_windows=4).collect()
    sequences, parts = {}, {}
    for p in pieces:
        assert len(p["ids"]) == p["length"] and p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        parts.setdefault((p["doc_id"], p["doc_tokens"]), []).append((p["start"], p["ids"]))
    for used in sequences.values():
        at = 0
        for offset, length in sorted(used):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(p["length"] for p in pieces) > 0.9 * 256 * (len(sequences) - 1)
    for r in rows:
        ids = whole_ids("byte_bpe_50k.json", r[1])
        own = parts[r[0], len(ids)]
        copies = 2 if r[0] == 10 else 1
        assert sorted(i for _, x in own for i in x) == sorted(ids * copies)
        if copies == 1:
            assert [i for _, x in sorted(own) for i in x] == ids


def test_token_files(spark, docs, rows, tmp_path):
    write_token_files(docs, str(tmp_path / "t"), tokenizer_path("word_bpe_49k.json"))
    found = token_positions(read_token_files(spark, str(tmp_path / "t"))).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    at, ids = 0, {r[0]: whole_ids("word_bpe_49k.json", r[1]) for r in rows}
    for r in found:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids[r["doc_id"]]), zlib.crc32(np.array(ids[r["doc_id"]], "<u4").tobytes()))
        at += r["n_tokens"]


def test_mixing(docs, rows):
    found = mixing.mix_sources(docs).collect()
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix_sources(docs).collect())) and len(found) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len([w for w in (r[1] or "").split() if w])
    total = sum(sizes.values())
    goal = plain_targets(sizes)
    assert abs(sum(goal.values()) - 1.5 * total) < 1e-6 and all(goal[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    taken = Counter()
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - goal[r["source"]]) < 1e-9 and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    biggest = max(r["size"] for r in found)
    assert all(abs(taken[s] - goal[s]) <= 2 * biggest for s in sizes)


def plain_weights(sources):
    return {s: (5, 2, 1)[n % 3] for n, s in enumerate(sorted(sources, key=lambda s: (s is None, s or "")))}


def plain_targets(sizes):
    """Shares by weight, a source at a time stopped at twice its size."""
    weights, out = plain_weights(sizes), {}
    while len(out) < len(sizes):
        left = [s for s in sizes if s not in out]
        unit = (1.5 * sum(sizes.values()) - sum(out.values())) / sum(weights[s] for s in left)
        over = [s for s in left if unit * weights[s] > 2 * sizes[s]]
        out |= {s: 2.0 * sizes[s] for s in over} if over else {s: unit * weights[s] for s in left}
    return out


def test_targets(spark):
    def goal(sizes):
        rows = [(s, n, float(w)) for (s, n), w in zip(sizes.items(), plain_weights(sizes).values())]
        with Scratch(spark) as scratch:
            return {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size long, weight double"), 1.5, 2.0, scratch).collect()}

    assert plain_weights(["b", None, "a", "c"]) == {"a": 5, "b": 2, "c": 1, None: 5}
    assert goal({"a": 10, "b": 10, "c": 10}) == {"a": 20, "b": pytest.approx(50 / 3), "c": pytest.approx(25 / 3)}
    assert goal({"a": 0}) == {"a": 0}
    sizes = {f"s{n:02}": (n * 37) % 101 for n in range(40)}
    assert goal(sizes) == {s: pytest.approx(t) for s, t in plain_targets(sizes).items()}


def plain_copies(rows, goal, sizes, seed=17, draws=32):
    """Copies of (source, size, doc_id, n) rows, recomputed row by row: the draw of least error, and its crossings."""
    out = {}
    for source in sizes:
        mine = sorted([r for r in rows if r[0] == source], key=lambda r: r[1:3])
        rate, best = goal[source] / sizes[source] if sizes[source] else 0.0, None
        for n in range(draws):
            name = f"{seed}/{n}/{'' if source is None else 's' + source}"
            shift = int(hashlib.md5(name.encode()).hexdigest()[:8], 16) / 2**32
            got = [int(np.floor(k * rate + shift) - np.floor((k - 1) * rate + shift)) for k in range(1, len(mine) + 1)]
            miss = abs(sum(c * r[1] for c, r in zip(got, mine)) - goal[source])
            if best is None or miss < best[0]:
                best = (miss, got)
        out |= {r[3]: c for r, c in zip(mine, best[1])}
    return out


def test_mixing_beside_a_plain_version(spark):
    """Copies of every document as a plain loop takes them, and each source's words near its target."""
    rng = random.Random(8)
    raw = [(n, " ".join(["w"] * int(rng.paretovariate(1.1) * 20)), rng.choice(["a", "b", None, "ü", ""])) for n in range(700)]
    sizes = Counter()
    for _, text, source in raw:
        sizes[source] += len(text.split())
    goal = plain_targets(sizes)
    want = plain_copies([(s, len(t.split()), n, n) for n, t, s in raw], goal, sizes)
    found = mixing.mix_sources(spark.createDataFrame(raw, "doc_id long, text string, source string").repartition(6)).collect()
    assert found[0].__fields__[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    assert {r["doc_id"]: r["copies"] for r in found} == want
    taken = Counter()
    for r in found:
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 0.02 * goal[s] for s in sizes)


def test_chat(spark):
    said = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "system", "s"), (1, 1, "user", None), (1, 2, "assistant", said), (1, 3, "user", "\\\\h \\t ###"), (1, 4, "assistant", ""), (2, 0, "user", "x"), (2, 0, "user", "x"), (3, 5, None, "<"), (3, 4, "Tool: a\\", "</turn>\n</turn"), (None, 0, "assistant", "q")]
    turns = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, loss int, turns string")
    done = format_conversations(turns).withColumn("back", read_formatted(F.col("formatted")))
    found = {r["conv_id"]: r for r in done.collect()}
    for conv in (1, 2, 3, None):
        own = sorted([r for r in rows if r[0] == conv], key=lambda r: r[1])
        assert [(t["role"], t["text"]) for t in found[conv]["back"]] == [(r[2] or "", r[3] or "") for r in own]
        learned = [s["text"] for s in found[conv]["segments"] if s["loss"]]
        assert len(learned) == sum(r[2] == "assistant" for r in own)
        assert "".join(s["text"] for s in found[conv]["segments"]) == found[conv]["formatted"]
    assert [(c, found[c]["valid"], found[c]["bad_turn"]) for c in (1, 2, 3, None)] == [(1, True, None), (2, False, 1), (3, False, 0), (None, False, 0)]
    assert format_conversations(turns.limit(0), ChatTemplate()).count() == 0


def test_topk(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in rng.normal(0, 1, 8)]) for i in range(300)] + [(400 + i, [0.5] * 8) for i in range(40)]
    odd = [(500, None), (501, [1.0, None]), (502, [float("nan")] * 8), (503, [float("inf")]), (None, [1.0] * 8), (504, [3.0]), (7, vectors[7][1])]
    table = spark.createDataFrame([(i, v, 0, 0) for i, v in vectors + odd], "vec_id long, embedding array<float>, cell int, score int")
    good = [(i, np.floor(1024 * np.pad(np.array(v, np.float32).astype(float), (0, 8 - len(v)))).astype(int)) for i, v in vectors + odd[5:]]
    want = []
    for q, x in good:
        if q % 20 == 0:
            hits = sorted([(-int(x @ y), i) for i, y in good if i != q])[:10]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(hits)]
    found = [tuple(r) for r in top_k(table, "vec_id % 20 = 0", pivots=6).collect()]
    assert sorted(found) == sorted(want)
    assert top_k(table.limit(0), "true").count() == 0


def test_language(spark, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", F.lit(1).alias("share"))
    found = identify(docs, train(docs)).filter("pmod(crc32(cast(doc_id as string)), 4) = 2")
    row = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("rejected").cast("int")), F.min("score"), F.max("score")).first()
    assert row[0] > 0.97 and row[1] < 0.02 and 0 <= row[2] <= row[3] <= 1
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 ½²"), (None, "the"), (4, "好")], "doc_id long, text string")
    langs = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(odd, train(docs)).collect()}
    assert all(langs[i] == ("und", 0.0) for i in (1, 2, 3)) and langs[None][0] != "und"
    assert identify(odd, train(nothing)).filter("lang_pred <> 'und'").count() == 0


def test_language_of_clashing_columns_and_rare_languages(spark, nothing):
    """Columns named as the results are replaced; a language of one row in a thousand is learned."""
    rng = random.Random(3)
    words = {"aa": ["tala", "mena", "soru"], "bb": ["xik", "quz", "wyv"], "cc": ["öst", "åby", "äpp"]}
    rows = [(n, " ".join(rng.choice(words[lang]) for _ in range(40)), lang, 7.0, "x", "y") for n in range(3000) for lang in ["cc" if n % 600 == 1 else "bb" if n % 9 == 0 else "aa"]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, Score double, lang_pred string, rejected string")
    found = identify(docs, train(docs, sample=300))
    assert sorted(found.columns) == ["doc_id", "lang", "lang_pred", "rejected", "score", "text"]
    assert found.filter("lang <> lang_pred").count() == 0
    long = spark.createDataFrame([(1, "tala mena " * 200_000), (1, "xik quz"), (1, None)], "doc_id long, text string")
    assert sorted(r["lang_pred"] for r in identify(long, train(docs, sample=300)).collect()) == ["aa", "bb", "und"]
    assert identify(docs.limit(0), train(nothing)).count() == 0


def test_media(spark):
    rng = np.random.default_rng(3)
    pictures = [drawn(rng.normal(0, 1, 16)) for _ in range(12)]
    rows = [(i, to_graymap(p)) for i, p in enumerate(pictures)]
    rows += [(100 + i, to_graymap(p[5:90, 3:80] * 0.85 + 12)) for i, p in enumerate(pictures[:6])] + [(200, rows[7][1]), (201, None), (202, b"no image"), (203, b""), (None, rows[1][1]), rows[8]]
    found = {r["image_id"]: r["group_id"] for r in image_copies(spark.createDataFrame([(*r, "x") for r in rows], "image_id long, media binary, digest string")).collect()}
    assert {i: found[i] for i in range(12)} == {i: i for i in range(12)}
    assert [found[100 + i] for i in range(6)] == list(range(6))
    assert (found[200], found[201], found[202], found[203], found[None]) == (7, 201, 202, 203, None)
    turned = np.rot90(pictures[3])
    pair = spark.createDataFrame([(1, to_graymap(pictures[3])), (2, to_graymap(turned))], "image_id long, media binary")
    assert {r["group_id"] for r in image_copies(pair).collect()} == {1}


def test_media_at_size(spark):
    """Two in five of 500 larger pictures cropped, brightened or turned: their copies are found, and no others."""
    rng = np.random.default_rng(12)
    rows, want = [], {}
    for i in range(300):
        big = np.kron(rng.integers(40, 200, (20, 24)), np.ones((10, 10))) + np.kron(rng.integers(-30, 31, (50, 60)), np.ones((4, 4)))
        big = np.clip(big, 0, 235)
        rows.append((i, to_graymap(big)))
        want[i] = i
        if i % 3 == 0:
            edited = big[20:170, 30:200] if i % 2 else np.rot90(big * 0.9 + 8, 2)
            rows.append((1000 + i, to_graymap(edited)))
            want[1000 + i] = i
    found = {r["image_id"]: r["group_id"] for r in image_copies(spark.createDataFrame(rows, "image_id long, media binary").repartition(4)).collect()}
    assert {i: found[i] for i in range(300)} == {i: i for i in range(300)}
    assert sum(found[i] == want[i] for i in want if i >= 1000) >= 0.95 * 100


def test_topk_odd_rows(spark):
    """A query id in several rows, vectors of no length, large components, and a score beyond a long."""
    rows = [(20, [1.0, 2.0]), (20, [3.0, -1.0]), (1, [0.5, 0.5]), (2, []), (3, [1e6, -1e6]), (4, [2.0]), (5, [3.0, 3.0]), (5, [3.0, 3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    want = sorted([(-sum(a * b for a, b in zip(x, y)), i) for q, x in ints if q == 20 for i, y in ints if i != 20])[:10]
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in top_k(table, "vec_id = 20").collect()) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]
    with pytest.raises(Exception, match="OverflowError|too large|out of bounds"):
        top_k(spark.createDataFrame([(20, [1e10]), (1, [1e10])], "vec_id long, embedding array<double>"), "vec_id = 20").collect()


def test_topk_goes_to_few_cells():
    """In clustered vectors a query that knows a score near its best goes to a small share of the cells."""
    rng = np.random.default_rng(4)
    middles = rng.normal(0, 10, (40, 16))
    x = np.concatenate([m + rng.normal(0, 0.3, (50, 16)) for m in middles])
    cell = ((x[:, None] - middles) ** 2).sum(2).argmin(1)
    summaries = [{"cell": c, "n": int((cell == c).sum()), "radius": float(np.sqrt(((x[cell == c] - middles[c]) ** 2).sum(1)).max())} for c in range(40)]
    cells = Cells(middles, summaries)
    q = x[::50]
    scores = q @ x.T
    tenth = np.sort(scores, axis=1)[:, -11]
    able = cells.able(q, tenth)
    assert able.mean() < 0.2
    best = np.argsort(-scores, axis=1)[:, :10]
    assert all(able[n, cell[b]].all() for n, b in enumerate(best))
    assert all(sum(summaries[c]["n"] for c in found) >= 40 for found in cells.nearest(q, 40))
    asked = {c: 30 if c % 3 else 250 for c in range(40) if c != 7}
    places, loads = cells.dealt(asked, 100), Counter()
    for c, (first, spread) in places.items():
        for b in range(first, first + spread):
            loads[b] += asked[c] / spread
    assert set(places) == set(asked) and max(loads.values()) <= 100 and len(loads) <= 2 * sum(asked.values()) / 100 and set(loads) == set(range(len(loads)))


def test_lines_beside_sql(spark):
    """Odd texts, copies and long runs of one word, as the query's SQL has them."""
    rng = random.Random(6)
    passage = prose(rng, 60)
    texts = ["", " \n ", "One\n\ntwo", "one\nTWO\n\n three", passage, f"{prose(rng, 20)} {passage} {prose(rng, 15)}", "na " * 90, f"x {'na ' * 50}y", "żółć " * 30, "żółć " * 30, None]
    texts += [prose(rng, rng.randrange(1, 60)) + "\n" + rng.choice(["same line here", "a b", prose(rng, 30)]) for _ in range(60)]
    data = [(n, t) for n, t in enumerate(texts)]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(data, columns=["doc_id", "text"]).astype({"text": "string"}))
    want = {r[0]: (r[1], r[4]) for r in con.sql(lines.OP10_SQL).select("doc_id, text, n_spans, n_removed, removed").fetchall()}
    found = {r["doc_id"]: (r["text"], ",".join(f"{s['start']}+{s['length']}" for s in r["removed"])) for r in lines.dedup_units(frame).collect()}
    assert found == want


def test_lines_remove_each_repeated_unit(spark):
    """One line of fifteen words in thirty documents, and lines of one and two words, stay in the first document only."""
    rng = random.Random(9)
    common = " ".join(rng.choice(WORDS) for _ in range(15))
    rows = [(n, f"{prose(rng, 12)}\n{common}\nThe end\nfin", "r", 3, "p") for n in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Removed string, places int, kid string")
    found = {r["doc_id"]: r for r in lines.dedup_units(docs).collect()}
    assert found[0]["text"] == rows[0][1] and found[0]["removed"] == []
    assert all(found[n]["text"] == rows[n][1].split("\n")[0] + "\n" and found[n]["places"] == 3 and found[n]["kid"] == "p" for n in range(1, 30))


def test_token_files_layout_and_selective_reads(spark, docs, tmp_path):
    """Ids in a dictionary, numbers as deltas, bounded row groups, indexes of pages; a filter on ids reaches the scan."""
    path = str(tmp_path / "t")
    write_token_files(docs, path, tokenizer_path("word_bpe_49k.json"))
    groups = [g for f in sorted((tmp_path / "t").glob("part-*.parquet")) for m in [pq.ParquetFile(f).metadata] for g in (m.row_group(n) for n in range(m.num_row_groups)) if g.num_rows]
    for group in groups:
        columns = {group.column(n).path_in_schema.split(".")[0]: group.column(n) for n in range(group.num_columns)}
        assert group.total_byte_size <= 16 << 20
        assert {"RLE_DICTIONARY"} <= set(columns["tokens"].encodings)
        assert set(columns["n_tokens"].encodings) & {"DELTA_BINARY_PACKED", "RLE_DICTIONARY"}
        assert all(c.has_offset_index and c.has_column_index for c in columns.values())
    some = read_token_files(spark, path).filter("doc_id = 9").select("n_tokens")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,9)" in plan and "tokens:array" not in plan.split("ReadSchema")[1]
    assert some.count() == 1


def test_empty_tables(spark, nothing, tmp_path):
    assert minhash.near_duplicates(nothing).count() == 0
    assert suffixes.repeated_substrings(nothing).count() == 0
    assert lines.dedup_units(nothing).count() == 0
    assert mixing.mix_sources(nothing).count() == 0
    assert pack_documents(nothing, tokenizer_path("byte_bpe_50k.json")).count() == 0
    assert image_copies(spark.createDataFrame([], "image_id long, media binary")).count() == 0
    write_token_files(nothing, str(tmp_path / "t"), tokenizer_path("word_bpe_49k.json"))
    assert token_positions(read_token_files(spark, str(tmp_path / "t"))).count() == 0
