"""Near-duplicate documents by SuperMinHash signatures, banding, verification on whole shingle sets and
union-find grouping.

A signature has SLOTS values. Each shingle draws a random permutation of the slots, one step at a time
(Fisher-Yates), and at step j offers the rank j + u, u random in [0, 1), to the slot drawn. A slot's value is
its least rank. Once every slot of a document has a value from a step that is over, later steps can't lower
one, so the document stops: large sets need a few steps only.

Documents with equal sets form a class, and only its smallest id goes on. Bands of ROWS slots are bucket
keys. In a bucket every member is compared with one leader (the document that meets the most others in
all its buckets), never all with all. Where members are then left in different components, those outside the largest
one meet the others in cells of bounded size: each pair in the first bucket that it shares, after a check of sketches (a
byte for each slot), and not if the cell has joined the two components by then, so a cell gives fewer links than it has
members. Every link is confirmed on whole sets. Components come from union-find, and from alternating large and small
stars where there are many links.

Nulls: a null or empty text, or one without words, has an empty set and is linked with nothing; rows with a
null doc_id are linked with nothing and have a null component_id and kept = true. Repeated rows are copies of each
other (the same doc_id, both kept); different texts of one id are different documents. Texts shorter than a shingle count as one shingle. Very long texts are
read whole. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import Scratch, mix64, parts, release_memory, span_hashes

#: 30 bands of 5: a pair of similarity 0.8 shares no bucket once in 150,000 times.
ROWS, BANDS = 5, 30
SLOTS = ROWS * BANDS
#: Sketch agreement below which a pair isn't compared: 0.8 less 4.5 standard deviations.
SKETCH_LEAST = int(SLOTS * (0.8 - 4.5 * (0.16 / SLOTS) ** 0.5))
#: Members of a bucket in a block of comparisons, and links that one union-find takes.
BLOCK, TOGETHER = 1024, 250_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of ``width`` words."""
    raw = [(t or "").encode() for t in texts]
    sets: list[np.ndarray] = []
    at = 0
    while at < len(raw):  # about a megabyte at a time
        size, to = 0, at
        while to < len(raw) and (to == at or size + len(raw[to]) < 1 << 20):
            size += len(raw[to]) + 1
            to += 1
        sets += _some_sets(raw[at:to], width)
        at = to
    return sets


def _some_sets(raw: list[bytes], width: int) -> list[np.ndarray]:
    data = _LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    words = span_hashes(data, starts, ends)
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in raw)]))
    rolled = words[: max(len(words) - width + 1, 0)].copy()
    for j in range(1, width):
        rolled = mix64(rolled * _ODD + words[j : j + len(rolled)])
    empty = np.zeros(0, np.uint64)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            whole = words[a : a + 1]
            for j in range(a + 1, b):
                whole = mix64(whole * _ODD + words[j : j + 1])
            out.append(whole)
        else:
            out.append(empty)
    return out


def super_minhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Signatures (documents x slots) of non-empty sets; integer part of a rank above bit 40."""
    h = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    row = np.arange(len(h))
    perm = np.empty((len(h), slots), np.uint8 if slots <= 256 else np.uint16)
    perm[:] = np.arange(slots)
    signature = np.full(len(sets) * slots, np.iinfo(np.uint64).max, np.uint64)
    have = np.zeros(len(sets) * slots, bool)
    for j in range(slots):
        draw = mix64(h + np.uint64((j + 1) * int(_ODD) % 2**64))
        k = j + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        slot = perm[row, k]
        perm[row, k] = perm[row, j]
        flat = doc * slots + slot
        new = np.flatnonzero(~have[flat])
        flat = flat[new]
        np.minimum.at(signature, flat, np.uint64(j) << np.uint64(40) | draw[new] >> np.uint64(24))
        have[flat] = True
        left = ~have.reshape(len(sets), slots).all(1)
        if not left.all():
            stay = left[doc]
            h, doc, row = h[stay], doc[stay], row[stay]
            if not len(h):
                break
    return signature.reshape(len(sets), slots)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each document and band."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(ROWS):
        key = mix64(key * _ODD + parts[:, :, j])
    return key.view(np.int64)


def _signed(width: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in batches:
            ids, ties, texts = batch.column("doc_id"), batch.column("tie"), batch.column("text")
            for at in range(0, len(texts), 256):
                sets = shingle_sets(texts.slice(at, 256).to_pylist(), width)
                full = [n for n, s in enumerate(sets) if len(s)]
                bands: list = [None] * len(sets)
                sketch: list = [None] * len(sets)
                group, size = [], 0
                for n in [*full, None]:  # signatures of about 100,000 shingles at a time
                    if group and (n is None or size + len(sets[n]) > 100_000):
                        signature = super_minhash([sets[i] for i in group])
                        for i, keys, s in zip(group, band_keys(signature), mix64(signature.ravel()).astype(np.uint8).reshape(signature.shape)):
                            bands[i], sketch[i] = keys, s.tobytes()
                        group, size = [], 0
                    if n is not None:
                        group.append(n)
                        size += len(sets[n])
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(sets)), ties.slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                    names=["doc_id", "tie", "n_shingles", "digest", "bands", "sketch"],
                )

    return sign


def _with_sets(width: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sets = shingle_sets(batch.column("text").to_pylist(), width)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "elements"])

    return build


def _linked(percent: int):
    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["left_set"], pdf["right_set"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pdf.loc[keep, ["a", "b"]]

    return confirm


def sets_of(texts: DataFrame, classes: DataFrame, ids: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """(id, elements) of the classes in ``ids``, from one text of each."""
    rows = classes.select(F.col("member").alias("id"), F.col("who.doc_id").alias("doc_id"), F.col("who.tie").alias("tie")).join(ids, "id", "left_semi")
    found = texts.join(rows, ["doc_id", "tie"]).select("id", "text")
    return scratch.write(found.mapInArrow(_with_sets(width), "id long, elements binary").dropDuplicates(["id"]), rows=1024)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Of pairs (a, b) those whose whole sets of shingles are similar enough."""
    joined = pairs.join(sets.select(F.col("id").alias("b"), F.col("elements").alias("right_set")), "b").join(sets.select(F.col("id").alias("a"), F.col("elements").alias("left_set")), "a")
    return scratch.write(joined.mapInPandas(_linked(percent), "a long, b long"), rows=1024)


def components(links: DataFrame, scratch: Scratch, together: int = TOGETHER) -> DataFrame:
    """(id, root) for every linked id but the roots: the smallest id it can reach. ``links`` are pairs (a, b), a < b.

    Union-find makes trees of about ``together`` links at a time; where there are more, alternating large and small
    stars join the trees, in a number of rounds that grows with the logarithm of the longest chain.
    """
    written = scratch.write
    groups = -(-links.count() // together)

    def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Union-find over a partition's links: the same components from fewer links."""
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        for pdf in batches:
            for x, y in zip(pdf["a"].tolist(), pdf["b"].tolist()):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            if len(parent) > 4 * together:
                yield pd.DataFrame([(x, root(x)) for x in parent], columns=["big", "small"])
                parent = {}
        if parent:
            yield pd.DataFrame([(x, root(x)) for x in parent], columns=["big", "small"])

    edges = written(links.coalesce(max(groups, 1)).mapInPandas(forest, "big long, small long"))
    if groups <= 1:
        return edges.select(F.col("big").alias("id"), F.col("small").alias("root"))
    mark = None
    while True:
        both = edges.select(F.col("big").alias("x"), F.col("small").alias("y")).unionByName(edges.select(F.col("small").alias("x"), F.col("big").alias("y")))
        least = written(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")))
        large = both.filter("y > x").join(least, "x").select(F.col("y").alias("big"), F.col("m").alias("small")).filter("big <> small").distinct()
        large = written(large)
        parent = written(large.groupBy("big").agg(F.min("small").alias("m")))
        paired, before = large.join(parent, "big"), edges
        small = paired.select("big", F.col("m").alias("small")).unionByName(paired.filter("small <> m").select(F.col("small").alias("big"), F.col("m").alias("small")))
        edges = written(small.distinct())
        scratch.drop(before, least, large, parent)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            return edges.select(F.col("big").alias("id"), F.col("small").alias("root"))
        mark = tuple(now)


def _across(percent: int):
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links of a cell between its left members and right members of other components."""
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        sketch = np.frombuffer(b"".join(right["sketch"]), np.uint8).reshape(len(right), -1)
        bands = np.stack(right["bands"].to_list()) if len(right) else np.zeros((0, BANDS), np.int64)
        ids, component = right["member"].to_numpy(), right["root"].to_numpy(copy=True)
        sets = [np.frombuffer(e, np.uint64) for e in right["elements"]]
        sizes = np.array([len(s) for s in sets])
        key = pdf["key"].iloc[0]
        now: dict[int, int] = {}  # what a component has been joined to in this cell
        out = []
        for own, keys, elements, member, root in zip(left["sketch"], left["bands"], left["elements"], left["member"].tolist(), left["root"].tolist()):
            mine, root = np.frombuffer(elements, np.uint64), now.get(root, root)
            able = np.flatnonzero((component != root) & (100 * np.minimum(sizes, len(mine)) >= percent * np.maximum(sizes, len(mine))))
            able = able[(sketch[able] == np.frombuffer(own, np.uint8)).sum(1) >= SKETCH_LEAST]
            earlier = int(np.flatnonzero(keys == key)[0])
            able = able[~(bands[able, :earlier] == keys[:earlier]).any(1)]
            while len(able):
                some, able = able[:64], able[64:]
                every = np.concatenate([sets[i] for i in some])
                found = mine[np.minimum(np.searchsorted(mine, every), len(mine) - 1)] == every
                common = np.add.reduceat(found, np.cumsum([0, *sizes[some][:-1]]), dtype=np.int64)
                for i in some[100 * common >= percent * (len(mine) + sizes[some] - common)].tolist():
                    if component[i] != root:
                        other = int(component[i])
                        out.append((min(member, int(ids[i])), max(member, int(ids[i]))))
                        component[component == other] = root
                        now = {k: root if v == other else v for k, v in now.items()} | {other: root}
                able = able[component[able] != root]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return links


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (it is its component's id).

    Links are pairs with 100 * intersection >= percent * union over sets of ``width``-word shingles;
    ``percent`` must be 80 or more, which the number of bands and the sketches are made for.
    """
    if percent < 80:
        raise ValueError("bands and sketches are set for a similarity of 0.8 or more")
    with Scratch(docs.sparkSession) as scratch:
        return _near_duplicates(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), width, percent, scratch)


def _near_duplicates(texts: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    written = scratch.write
    texts = texts.withColumn("tie", F.xxhash64("text"))
    signed = written(texts.mapInArrow(_signed(width), "doc_id long, tie long, n_shingles long, digest binary, bands array<long>, sketch binary"), rows=1024)
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    # A class has a number of its own: one id may have several texts, which are different documents.
    classes = full.groupBy("digest").agg(F.min(F.struct("doc_id", "tie")).alias("who"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"), F.any_value("n_shingles").alias("n_shingles"))
    classes = written(classes.withColumn("member", F.monotonically_increasing_id()))
    member = classes.select("member", F.explode("bands").alias("key"))
    shared = written(member.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    met = written(member.join(shared, "key"))
    # The original of many edited copies meets more documents in its buckets than a copy does.
    fame = written(met.groupBy("member").agg(F.sum("n").alias("fame")))
    leaders = met.join(fame, "member").groupBy("key").agg(F.max(F.struct("fame", (-F.col("member")).alias("id"))).alias("best"))
    led = written(leaders.select("key", (-F.col("best.id")).alias("leader")))
    dealt = met.join(led, "key").filter("member <> leader")
    pairs = written(dealt.select(F.least("leader", "member").alias("a"), F.greatest("leader", "member").alias("b")).distinct())
    scratch.drop(shared, fame, led)
    sets = sets_of(texts, classes, scratch.write(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), width, scratch)
    links = confirmed(pairs, sets, percent, scratch)
    roots = components(links, scratch)
    # Buckets whose members are still in different components: those outside the largest one there (outliers)
    # meet all others of the bucket, in cells of bounded size.
    placed = written(met.filter("n > 2").join(roots, F.col("member") == F.col("id"), "left").select("key", "member", F.coalesce("root", "member").alias("root")))
    scratch.drop(met)
    shares = placed.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("parts"))
    mixed = written(shares.filter("parts > 1").select("key", F.col("most.root").alias("main"), F.ceil((F.col("n") - F.col("most.n")) / BLOCK).alias("outer"), F.ceil(F.col("n") / BLOCK).alias("all")))
    place = placed.join(mixed, "key").withColumns({"i": F.pmod(F.xxhash64("member"), F.col("outer")), "j": F.pmod(F.xxhash64("member"), F.col("all"))})
    grid = place.select("key", "member", "root", F.explode(F.concat(
        F.when(F.col("root") != F.col("main"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("all") - 1), lambda j: F.struct(F.col("i").alias("i"), j.alias("j"), F.lit(0).alias("side")))).otherwise(F.array()),
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("outer") - 1), lambda i: F.struct(i.alias("i"), F.col("j").alias("j"), F.lit(1).alias("side"))),
    )).alias("cell")).select("key", "member", "root", "cell.*")
    facts = classes.select("member", "sketch", "bands").join(sets.withColumnRenamed("id", "member"), "member")
    more = written(grid.join(facts, "member").groupBy("key", "i", "j").applyInPandas(_across(percent), "a long, b long").distinct())
    if not more.isEmpty():
        roots = components(links.unionByName(more), scratch)
    grouped = written(classes.join(roots, F.col("member") == F.col("id"), "left").select("digest", F.col("who.doc_id").alias("first"), F.coalesce("root", "member").alias("group")))
    least = grouped.groupBy("group").agg(F.min("first").alias("component"))
    reps = grouped.join(least, "group").select("digest", "component")
    own = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return scratch.keep(
        signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest")).join(reps, "digest", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents over 2-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2, percent=80)


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) = 1 THEN w
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), f AS (SELECT g, count(*) AS df FROM s GROUP BY g
), p AS (
  SELECT s.doc_id, s.g, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY f.df, s.g) AS r FROM s JOIN f USING (g) JOIN n USING (doc_id)
), k AS (SELECT doc_id, g FROM p WHERE r <= n - CAST(ceil(0.8 * n) AS BIGINT) + 1
), c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM k a JOIN k b ON a.g = b.g AND a.doc_id < b.doc_id
), i AS (
  SELECT c.a, c.b, count(*) AS common FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b AND y.g = x.g GROUP BY c.a, c.b
), e AS (
  SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)
), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e
), r AS (SELECT a AS id, a AS reach FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.reach = l.a
), m AS (SELECT id, min(reach) AS root FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.root, d.doc_id) AS component_id,
  coalesce(m.root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = d.doc_id
"""
