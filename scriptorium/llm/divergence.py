"""How the sources of a language differ in their words: smoothed shares of terms, compared group by group.

Tasks count terms in numpy; Spark adds the counts up. Each kept term of a lang becomes one row with an array of its counts
by source (the lang's sources in order), higher-order functions turn it into the shares of all sources at once and into one
contribution for each pair of sources, and the sums of the contributions combine on the map side: what is shuffled
is at most a row for each pair and task. The result itself has a row for each pair of sources, so arrays are as wide as the result
is deep.

All arithmetic is of whole numbers; what may pass 64 bits is decimal of 38 digits.

Nulls: a null text, lang or source is ''. A group whose texts have no terms, and a lang that keeps no term, give their pairs
all the same (value 0 where no term is kept). Very long texts are counted in blocks and are one document. Repeated
rows are documents of their own. Ties stand in order of the item. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import Scratch, parts, release_memory
from scriptorium.llm.words import BLOCK, Tally, Vocabulary, Words, blocks

#: Terms, or counts by group and term, that a task holds before it passes them on.
HELD = 1 << 20
#: Whole of the shares, pseudo-count of a term.
UNIT, EXTRA = 1_000_000_000, 2

_BETWEEN = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
_TERM = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


class _Counts:
    """A task's counts of terms by (lang, source), with the number of documents that have them."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.texts: list[bytes] = []
        self.of: list[int] = []
        self.size = 0
        self.empty()

    def empty(self) -> None:
        self.words, self.tally = Vocabulary(), Tally()

    def take(self, lang: str, source: str, text: bytes) -> Iterator[pa.RecordBatch]:
        group = self.groups.setdefault((lang, source), len(self.groups))
        if len(text) > BLOCK:
            yield from self.long(group, text)
            return
        self.texts.append(text)
        self.of.append(group)
        self.size += len(text) + 1
        if self.size >= BLOCK:
            yield from self.count()

    def count(self) -> Iterator[pa.RecordBatch]:
        if not self.texts:
            return
        words = Words(b" ".join(self.texts), _TERM)
        ends = np.cumsum([len(t) + 1 for t in self.texts])
        doc = np.searchsorted(ends, words.starts, side="right")
        pairs, n = np.unique(doc * max(len(words.distinct), 1) + words.places, return_counts=True)
        self.add(np.array(self.of)[pairs // max(len(words.distinct), 1)], pairs % max(len(words.distinct), 1), n, words.distinct)
        self.texts, self.of, self.size = [], [], 0
        if self.full():
            yield from self.rows()

    def long(self, group: int, text: bytes) -> Iterator[pa.RecordBatch]:
        """A text of many blocks: its terms count as of one document."""
        met: dict[bytes, int] = {}
        for block in blocks(text, _BETWEEN):
            words = Words(block, _TERM)
            for term, n in zip(words.distinct, np.bincount(words.places, minlength=len(words.distinct)).tolist()):
                met[term] = met.get(term, 0) + n
        self.add(np.full(len(met), group), np.arange(len(met)), np.fromiter(met.values(), np.int64, len(met)), list(met))
        if self.full():
            yield from self.rows()

    def add(self, group: np.ndarray, term: np.ndarray, n: np.ndarray, distinct: list[bytes]) -> None:
        """Counts of one document and term each."""
        if len(n):
            keys = (group.astype(np.uint64) << np.uint64(32)) | self.words.add(distinct)[term].astype(np.uint64)
            self.tally.add(keys, np.stack([n.astype(np.int64), np.ones(len(n), np.int64)], axis=1))

    def full(self) -> bool:
        return len(self.words) > HELD or self.tally.waiting > HELD and len(self.tally.merged()[0]) > HELD

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The counts so far, which are then forgotten."""
        names = list(self.groups)
        if found := self.tally.merged():
            keys, sums, _ = found
            for at in range(0, len(keys), 1 << 14):
                part, n = keys[at : at + (1 << 14)], sums[at : at + (1 << 14)]
                of = [names[g] for g in (part >> np.uint64(32)).tolist()]
                terms = [self.words.words[t].decode() for t in (part & np.uint64(0xFFFFFFFF)).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([[g[0] for g in of], [g[1] for g in of], terms, n[:, 0], n[:, 1]], _COUNTS)], schema=_COUNTS)
        self.empty()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release_memory()
    counts = _Counts()
    for part in parts(batches):
        for lang, source, text in zip(*(part.column(c).to_pylist() for c in ("lang", "source", "text"))):
            yield from counts.take(lang, source, text.encode())
    yield from counts.count()
    yield from counts.rows()
    # A term is never empty: these rows say that the groups are there.
    names = list(counts.groups)
    columns = [[g[0] for g in names], [g[1] for g in names], [""] * len(names), [0] * len(names), [0] * len(names)]
    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _COUNTS)], schema=_COUNTS)


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (n + EXTRA) / (total + EXTRA * kept)); the quotient is at most UNIT, as n is at most total."""
    top = F.lit(UNIT).cast("decimal(10,0)") * (n + F.lit(EXTRA)).cast("decimal(19,0)")
    whole = F.call_function("div", top, (total + F.lit(EXTRA) * kept).cast("decimal(19,0)"))
    return whole.cast("long") + 1


def _apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)): shares are under 2^30 and a bit, so the square fits in a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def source_divergence(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank.

    ``pair``: the other sources of the lang by their distance over all kept terms. ``term``: the ``top`` terms that the source
    has more of than the lang as a whole. Terms are kept if at least ``least_docs`` documents of the lang have them.
    """
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")}
    with Scratch(docs.sparkSession) as scratch:
        counted = scratch.write(docs.select(*text.values()).mapInArrow(_count, "lang string, source string, term string, n long, docs long"), rows=1024)
        named = counted.filter("term = ''").select("lang", "source").distinct()
        sources = scratch.write(named.groupBy("lang").agg(F.array_sort(F.collect_list("source")).alias("sources")))

        by_source = counted.filter("term <> ''").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        by_term = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("found"))
        by_term = by_term.filter(F.col("docs") >= least_docs).join(sources, "lang")
        found = F.map_from_entries("found")
        wide = F.transform("sources", lambda s: F.coalesce(F.try_element_at(found, s), F.lit(0).cast("long")))
        vectors = scratch.write(by_term.select("lang", "term", wide.alias("n")))

        sums = vectors.select("lang", F.posexplode("n").alias("i", "n")).groupBy("lang", "i").agg(F.sum("n").alias("total"), F.count("*").alias("kept"))
        sums = sums.groupBy("lang").agg(F.max("kept").alias("kept"), F.transform(F.array_sort(F.collect_list(F.struct("i", "total"))), lambda x: x["total"]).alias("totals"))
        sums = scratch.write(sums.withColumn("whole", F.aggregate("totals", F.lit(0).cast("long"), lambda s, x: s + x)))

        n_all = F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x)
        shared = vectors.join(sums, "lang").select(
            "lang", "term", "n", F.zip_with("n", "totals", lambda n, t: _share(n, t, F.col("kept"))).alias("p"), _share(n_all, F.col("whole"), F.col("kept")).alias("q")
        )

        size = F.size("p")
        later = lambda p, i: F.transform(F.slice("p", i + 2, size), lambda q, j: F.struct(i.alias("i"), (i + 1 + j).alias("j"), _apart(p, q).alias("f")))
        each = shared.filter(size > 1).select("lang", F.inline(F.flatten(F.transform("p", later))))
        halves = each.groupBy("lang", "i", "j").agg(F.sum("f").alias("value"))
        both = halves.unionByName(halves.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
        pairs = sources.select("lang", F.posexplode("sources").alias("i", "source"), "sources")
        pairs = pairs.select("lang", "i", "source", F.posexplode("sources").alias("j", "item")).filter("i <> j")
        pairs = pairs.join(scratch.write(both), ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

        above = F.arrays_zip("n", "p", F.sequence(F.lit(0), size - 1).alias("i"))
        above = F.filter(above, lambda x: (x["n"] > 0) & (x["p"] > F.col("q")))
        terms = shared.select("lang", F.col("term").alias("item"), "q", F.inline(above)).select("lang", "item", "i", _apart(F.col("p"), F.col("q")).alias("value"))
        best = Window.partitionBy("lang", "i").orderBy(F.desc("value"), F.asc("item"))
        terms = terms.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= top)
        terms = terms.join(sources.select("lang", F.posexplode("sources").alias("i", "source")), ["lang", "i"])
        terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", "value")

        order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
        return scratch.keep(pairs.unionByName(terms).withColumn("rank", F.row_number().over(order)))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources of each language against one another, and the terms that tell them from the language."""
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), t AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS a FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 10
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3
), g AS (
  SELECT DISTINCT lang, source FROM d
), v AS (
  SELECT lang, count(*) AS v, sum(a) AS whole FROM k GROUP BY 1
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) + 2 * v.v) AS p,
    1 + (1000000000::HUGEINT * (k.a + 2)) // (v.whole + 2 * v.v) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pair AS (
  SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), u AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pair ON pair.lang = x.lang AND pair.source = x.source AND pair.item = y.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM u QUALIFY part = 'pair' OR rank <= 10
"""
