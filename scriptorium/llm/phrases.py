"""Phrases whose words stand together more often than apart: hash-pruned counting of n-grams, length by length.

Each pass over the texts counts the n-grams of one length that can still be frequent, exactly, and drops the next
length's n-grams into a fixed number of buckets. An n-gram is counted only if its bucket reached ``least`` and both of
its parts, one word shorter, were frequent. Both tests reach the tasks as bitmaps over hashes, ``buckets`` bits each, so what is
broadcast has a fixed size; a collision only lets an n-gram through that is then counted and found rare. Nothing
frequent is lost: a bucket's count is at least that of each of its n-grams, and a part occurs at least as often as the whole.
Counts of buckets stop at ``least`` in a task, which leaves the test as it is and needs a byte each.

Tasks tell n-grams apart by 64-bit hashes and Spark adds them up by their text, so equal texts are one phrase whatever
task has met them. Scores are whole numbers of decimals of 38 digits, so no product overflows.

Nulls: a null text is empty, a null lang is ``und``. Empty texts have no words. Very long texts are taken apart in blocks
cut at stops; only a stretch without a stop has to fit in memory. Repeated rows count as often as they
stand there. Ties have an order down to the phrase. Extra columns are ignored. An empty table gives no rows, and so does a lang
without a frequent phrase.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import Scratch, mix64, parts, release_memory
from scriptorium.llm.words import BLOCK, Tally, Vocabulary, Words, blocks, word_hashes

#: Least and most buckets; between them, sixteen for each document, in powers of two. At the most a bitmap has 8 MB.
FEWEST, MOST = 1 << 22, 1 << 26
#: Buckets whose counts travel together.
CHUNK = 1 << 14
#: N-grams or words that a task holds before it passes its counts on; bytes of text of all langs that wait for their block.
HELD, WAITING = 1 << 20, 1 << 24
#: Parts of a lang that are ranked before the lang is.
SALT = 64

_STOP = re.compile(rb"[.,;:!?\n-\r]")
_STOPS = np.isin(np.arange(256), [*b".,;:!?\n\x0b\x0c\r"])
_WORD = ~(_STOPS | np.isin(np.arange(256), [0x20, 0x09]))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ROWS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())])


def _longer(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of n-grams with one more word after them."""
    return mix64(hashes * _ODD + words)


class _Buckets:
    """Counts by bucket that stop at ``least``."""

    def __init__(self, buckets: int, least: int):
        self.shift, self.least = np.uint64(65 - buckets.bit_length()), min(least, 255)
        self.counts = np.zeros(buckets, np.uint8)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> self.shift).astype(np.int64)

    def add(self, hashes: np.ndarray) -> None:
        found, n = np.unique((hashes >> self.shift).astype(np.uint32), return_counts=True)
        self.counts[found] = np.minimum(self.counts[found] + np.minimum(n, self.least), self.least)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.counts), CHUNK):
            if (part := self.counts[at : at + CHUNK]).any():
                yield _batch(chunk=[at // CHUNK], counts=[part.tobytes()])


def _batch(**columns: list) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ROWS], schema=_ROWS)


class _Pass:
    """One task's share of a pass: exact counts of n-grams of ``length`` words, and buckets of the next length."""

    def __init__(self, length: int, least: int, buckets: int, last: bool, grams: np.ndarray | None, shorter: np.ndarray | None):
        self.length, self.grams, self.shorter = length, grams, shorter
        self.next = None if last else _Buckets(buckets, least)
        self.place = _Buckets(buckets, least).of
        self.waiting: dict[str, list[bytes]] = {}
        self.sizes: dict[str, int] = {}
        self.empty()

    def empty(self) -> None:
        self.words, self.tallies = Vocabulary(), {}

    def take(self, lang: str, text: bytes) -> Iterator[pa.RecordBatch]:
        for block in blocks(text, _STOP):
            self.waiting.setdefault(lang, []).append(block)
            self.sizes[lang] = self.sizes.get(lang, 0) + len(block) + 1
            if self.sizes[lang] >= BLOCK:
                yield from self.count(lang)
        if sum(self.sizes.values()) >= WAITING:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        for lang in list(self.waiting):
            yield from self.count(lang)

    def count(self, lang: str) -> Iterator[pa.RecordBatch]:
        raw = b"\n".join(self.waiting.pop(lang))
        self.sizes.pop(lang)
        words = Words(raw, _WORD)
        if not len(words.starts):
            return
        tally = self.tallies.setdefault(lang, Tally())
        numbers = self.words.add(words.distinct)
        hashes = [_longer(word_hashes([lang.encode()]), self.words.hashes(numbers)[words.places])]  # of n-grams from each word on, by length
        n, k = len(words.starts), self.length
        if self.grams is None:
            tally.add(numbers.astype(np.uint64), np.bincount(words.places, minlength=len(numbers)).astype(np.int64), numbers[:, None])
        if n > 1:
            piece = np.cumsum(_STOPS[words.data], dtype=np.int64)[words.starts]
            own = self.words.hashes(numbers)[words.places]
            for size in range(2, k + (self.next is not None) + 1):
                hashes.append(_longer(hashes[-1][: n - size + 1], own[size - 1 :]) if n >= size else own[:0])
            kept = np.ones(n, bool)
            if self.grams is not None and n >= k:
                part = self.shorter[self.place(hashes[k - 2])]
                kept = (piece[: n - k + 1] == piece[k - 1 :]) & part[: n - k + 1] & part[1 : n - k + 2]
                kept[kept] = self.grams[self.place(hashes[k - 1][kept])]
                at = np.flatnonzero(kept)
                keys, first, sums = np.unique(hashes[k - 1][at], return_index=True, return_counts=True)
                tally.add(keys, sums.astype(np.int64), numbers[words.places[at[first][:, None] + np.arange(k)]])
            if self.next is not None and n > k:
                both = kept[: n - k] & kept[1 : n - k + 1] & (piece[: n - k] == piece[k:])
                self.next.add(hashes[k][: n - k][both])
        if len(self.words) > HELD or tally.waiting > HELD and len(tally.merged()[0]) > HELD:
            yield from self.counts()

    def counts(self) -> Iterator[pa.RecordBatch]:
        """The counts so far, which are then forgotten."""
        words = self.words.words
        for lang, tally in self.tallies.items():
            if found := tally.merged():
                _, sums, firsts = found
                for at in range(0, len(sums), 1 << 14):
                    texts = [b" ".join([words[n] for n in row]).decode() for row in firsts[at : at + (1 << 14)].tolist()]
                    yield _batch(lang=[lang] * len(texts), phrase=texts, n=sums[at : at + (1 << 14)])
        self.empty()


def _unpacked(bitmap: bytes | None) -> np.ndarray | None:
    return None if bitmap is None else np.unpackbits(np.frombuffer(bitmap, np.uint8)).view(bool)


def _pass(length: int, least: int, buckets: int, last: bool, maps) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        grams, shorter = (_unpacked(x) for x in (maps.value if maps else (None, None)))
        state = _Pass(length, least, buckets, last, grams, shorter)
        for part in parts(batches):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                yield from state.take(lang, text.encode())
        yield from state.rest()
        yield from state.counts()
        if state.next is not None:
            yield from state.next.rows()

    return run


def _marks(least: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The buckets of frequent n-grams, as full counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        marked = _Buckets(buckets, least)
        for part in parts(batches, 1 << 14):
            texts = [p.encode().split(b" ") for p in part.column("phrase").to_pylist()]
            hashes = word_hashes([lang.encode() for lang in part.column("lang").to_pylist()])
            for words in zip(*texts):
                hashes = _longer(hashes, word_hashes(list(words)))
            marked.counts[marked.of(hashes)] = marked.least
        yield from marked.rows()

    return run


def _full(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The chunks' sums as bits: which buckets reached ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        sums: dict[int, np.ndarray] = {}
        for part in parts(batches):
            for chunk, counts in zip(part.column("chunk").to_pylist(), part.column("counts").to_pylist()):
                more = np.frombuffer(counts, np.uint8)
                sums[chunk] = np.minimum(sums[chunk].astype(np.uint16) + more, 255).astype(np.uint8) if chunk in sums else more
        for chunk, counts in sums.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "bits": [np.packbits(counts >= min(least, 255)).tobytes()]})

    return run


def _bitmap(rows: DataFrame, least: int, buckets: int) -> bytes:
    """One bit for each bucket: whether it reached ``least``. At most MOST bits come to the driver."""
    out = bytearray(buckets // 8)
    for r in rows.filter("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(_full(least), "chunk int, bits binary").collect():
        out[r["chunk"] * CHUNK // 8 : (r["chunk"] + 1) * CHUNK // 8] = r["bits"]
    return bytes(out)


def frequent_phrases(docs: DataFrame, scratch: Scratch, least: int = 30, longest: int = 4, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """All n-grams of 1 to ``longest`` words with at least ``least`` occurrences: lang, phrase, words, f; and all words by lang: lang, n."""
    spark = docs.sparkSession
    if buckets is None:
        buckets = min(max(1 << (16 * docs.count()).bit_length(), FEWEST), MOST)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").filter("text is not null")
    kind = ", ".join(f"{f.name} {'binary' if f.name == 'counts' else 'string' if f.type == pa.string() else 'int' if f.name == 'chunk' else 'long'}" for f in _ROWS)
    found, totals, maps = [], None, None
    for length in range(1, longest + 1):
        last = length == longest
        counted = scratch.write(texts.mapInArrow(_pass(length, least, buckets, last, maps), kind), rows=1024)
        sums = counted.filter("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        if length == 1:
            sums = scratch.write(sums)
            totals = scratch.write(sums.groupBy("lang").agg(F.sum("f").alias("n")))
        found.append(scratch.write(sums.filter(F.col("f") >= least).withColumn("words", F.lit(length))))
        if not last:
            grams = _bitmap(counted, least, buckets)
            shorter = _bitmap(found[-1].mapInArrow(_marks(least, buckets), kind), least, buckets)
            if maps:
                maps.unpersist()
            maps = spark.sparkContext.broadcast((grams, shorter))
        scratch.drop(counted)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("lang", "phrase", "words", "f"), totals


def _joined(words: Column, first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def collocations(
    docs: DataFrame, least: int = 30, longest: int = 4, percent: int = 80, first: int = 2000, scale: int = 2_000_000, buckets: int | None = None
) -> DataFrame:
    """Each lang's best phrases: lang, rank, phrase, a, l, r, n, score.

    ``a``, ``l`` and ``r`` are the occurrences of the phrase and of its two parts at the cut that scores least;
    score = floor(scale * a / (l + r)). A phrase inside a longer one that has ``percent`` of its occurrences is left out.
    """
    with Scratch(docs.sparkSession) as scratch:
        counts, totals = frequent_phrases(docs, scratch, least, longest, buckets)
        word = F.split("phrase", " ")
        phrases = counts.filter("words > 1").select("lang", "phrase", F.col("f").alias("a"), word.alias("w"))
        size = F.size("w")
        cut = phrases.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
        halves = cut.select("lang", "phrase", "a", "k", _joined(F.col("w"), 1, F.col("k")).alias("head"), _joined(F.col("w"), F.col("k") + 1, size - F.col("k")).alias("tail"))
        halves = halves.join(counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
        halves = halves.join(counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
        score = F.expr(f"cast({scale} as decimal(18, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
        scored = halves.groupBy("lang", "phrase").agg(F.min("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

        spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda at: _joined(F.col("w"), at, n))))
        inner = phrases.filter(size > 2).select("lang", F.col("a").alias("whole"), F.explode(F.array_distinct(spans)).alias("phrase"))
        inner = inner.groupBy("lang", "phrase").agg(F.max("whole").alias("whole"))
        wide = "cast(100 as decimal(3, 0)) * cast(whole as decimal(19, 0)) >= cast({0} as decimal(9, 0)) * cast(a as decimal(19, 0))".format(percent)
        stays = scored.join(inner, ["lang", "phrase"], "left").filter(f"whole is null or not ({wide})")

        order = [F.desc("cut.score"), F.desc("a"), F.asc("phrase")]
        salted = stays.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SALT)))
        # Ranked in parts first, so that a lang with most phrases isn't sorted in one task.
        best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= first)
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= first)
        out = best.join(totals, "lang").select(
            "lang", F.col("rank").cast("long"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").cast("long").alias("score")
        )
        return scratch.keep(out)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language in all documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), g AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w
), f AS (
  SELECT lang, words, array_to_string(w[i:i + words - 1], ' ') AS phrase, count(*) AS f
  FROM g, range(1, 5) t(words) WHERE i + words - 1 <= len(w) GROUP BY 1, 2, 3
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE words = 1 GROUP BY lang
), c AS (
  SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND f >= 30
), k AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, words)) AS k FROM c)
), h AS (
  SELECT k.*, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * a // (l.f + r.f) AS BIGINT) AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = k.head JOIN f r ON r.lang = k.lang AND r.phrase = k.tail
), s AS (
  SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), e AS (
  SELECT lang, a, w, size, unnest(range(1, words - size + 2)) AS i FROM (SELECT *, unnest(range(2, words)) AS size FROM c)
), i AS (
  SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, max(a) AS whole FROM e GROUP BY 1, 2
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM s JOIN n USING (lang) LEFT JOIN i USING (lang, phrase) WHERE whole IS NULL OR 100::HUGEINT * whole < 80::HUGEINT * a
QUALIFY rank <= 2000
"""
