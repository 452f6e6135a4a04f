"""Secrets in texts by patterns and by a character model, with DataFrame functions only.

Three kinds of spans are found by pattern: values assigned to a telling name, access keys, and long runs of hex
digits. Their values and ordinary words of a sample train two Markov models of characters; a run of key characters
that no pattern has met is a secret too if its log-likelihood ratio, random string over ordinary identifier, is that of
``odds`` or more. The models are one table of whole numbers for pairs of characters, so a score is the same sum everywhere.

Places come from a running sum over the matches of a text and the gaps between them, so a text with very many matches
costs in proportion. A row is known by a number of its own; only texts with matches are shuffled, and without their text.

Labelled samples: the ``sample`` distinct values and the ``sample`` distinct words whose MD5 is least; words come from texts whose
id's MD5 is among the ``texts`` least. Without values, or without words, the smoothing alone makes that model: all characters alike.

Nulls: a null text is empty and has no spans; a null doc_id stays null and is sampled as ''. Empty texts and texts
without a match give zeros, '' and the digest of ''. Very long texts are read whole; a run of key characters over LONGEST is judged in
stretches of LONGEST, and a rest under SHORTEST isn't judged. Repeated rows are rows of their own. Spans of one start stand in the
kinds' order. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import Scratch

#: Kinds of spans in order; the last is the model's.
KINDS = ("assign", "access", "hex", "random")
MODEL = len(KINDS) - 1
#: Shortest and longest run of key characters that the model judges at once.
SHORTEST, LONGEST = 16, 1000
#: Strings of each class, and texts, that train the models.
SAMPLE, TEXTS = 20_000, 2_000
#: How much likelier a random string has to be.
ODDS = 1e6

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


ASSIGN = "(" + _either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of 24 hex digits or more is the whole run that the shorter pattern would meet; so is a key.
PATTERNS = (ASSIGN, "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}", f"[A-Za-z0-9+/_=-]{{{SHORTEST},{LONGEST}}}")
LEAST_VALUE = 6
_TOKEN, _WORD = "[A-Za-z0-9+/_=-]{4,}", "^[A-Za-z]+([_-][A-Za-z]+)*$"


def _matches(text: Column, kind: int) -> Column:
    """All matches of a kind, each with the length of the gap before it; null if there is none."""
    hits = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), 0)
    gaps = F.transform(F.split(text, PATTERNS[kind], -1), F.length)
    zipped = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda gap, hit: F.struct(F.lit(kind).alias("kind"), gap.alias("gap"), hit.alias("hit")))
    return F.when(text.rlike(PATTERNS[kind]), zipped)


def _characters(text: Column) -> Column:
    return F.split(text, "")


def _pairs(text: Column, pair) -> Column:
    chars = _characters(text)
    n = F.greatest(F.size(chars) - 1, F.lit(0))
    return F.zip_with(F.slice(chars, 1, n), F.slice(chars, 2, n), pair)


def weights(values: DataFrame, words: DataFrame) -> list[int]:
    """For each pair of ASCII codes, 128 * first + second, a thousand times the logarithm of the likelihoods' ratio.

    ``values`` and ``words`` have a column ``s``. At most one row for each pair of the alphabet comes to the driver.
    """
    rows = []
    for name, strings in (("value", values), ("word", words)):
        pair = strings.select(F.explode(_pairs(F.col("s"), lambda a, b: F.concat(a, b))).alias("pair"))
        rows.append(pair.groupBy("pair").count().withColumn("name", F.lit(name)))
    counts = {(r["name"], r["pair"]): r["count"] for r in rows[0].unionByName(rows[1]).collect()}
    total = {(name, a): sum(counts.get((name, a + b), 0) for b in ALPHABET) for name in ("value", "word") for a in ALPHABET}
    out = [0] * (128 * 128)
    for a in ALPHABET:
        for b in ALPHABET:
            value, word = (math.log((counts.get((name, a + b), 0) + 1) / (total[name, a] + len(ALPHABET))) for name in ("value", "word"))
            out[128 * ord(a) + ord(b)] = math.floor(1000 * (value - word) + 0.5)
    return out


def score(text: Column, table: list[int]) -> Column:
    """Sum of the table's entries for the pairs of neighbours in a text of the alphabet."""
    entries = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")
    each = _pairs(text, lambda a, b: F.element_at(entries, F.ascii(a) * 128 + F.ascii(b) + 1))
    return F.aggregate(each, F.lit(0).cast("long"), lambda s, x: s + x)


def find_secrets(docs: DataFrame, sample: int = SAMPLE, texts: int = TEXTS, odds: float = ODDS) -> DataFrame:
    """Per row: doc_id and spans (kind, start, end, in code points, end exclusive), ordered by start and kind."""
    with Scratch(docs.sparkSession) as scratch:
        mark = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
        last = docs.select(mark.alias("mark")).orderBy("mark").limit(texts).agg(F.max("mark").alias("mark")).first()["mark"]
        text = F.coalesce(F.col("text"), F.lit(""))
        words = F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(_TOKEN), 0), lambda w: w.rlike(_WORD)))
        none = F.array().cast("array<struct<kind:int,gap:int,hit:string>>")
        read = docs.select(
            "doc_id", F.concat(*[F.coalesce(_matches(text, kind), none) for kind in range(len(KINDS))]).alias("hits"), F.when(mark <= F.lit(last or ""), words).alias("words")
        )
        read = scratch.write(read.withColumn("key", F.monotonically_increasing_id()))

        hit = read.filter("size(hits) > 0").select("key", "doc_id", F.posexplode("hits").alias("pos", "h")).select("key", "doc_id", "pos", "h.*")
        size = F.length("hit")
        value = F.when(F.col("kind") == 0, F.regexp_extract("hit", ASSIGN, 2)).otherwise(F.col("hit"))
        end = F.sum(F.col("gap") + size).over(Window.partitionBy("key", "kind").orderBy("pos")).cast("long")
        spans = hit.withColumns({"end": end, "value": value}).withColumn("start", F.col("end") - size)
        spans = spans.withColumn("good", (F.col("kind") != 0) | (F.length("value") >= LEAST_VALUE))
        base = F.col("good") & (F.col("kind") < MODEL)
        by_start = Window.partitionBy("key").orderBy("start", "kind")
        before = F.max(F.when(base, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, 0))
        after = F.min(F.when(base, F.col("start"))).over(by_start.rowsBetween(0, Window.unboundedFollowing))
        met = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False))
        spans = spans.withColumn("good", F.when(F.col("kind") == MODEL, ~met).otherwise(F.col("good")))
        spans = scratch.write(spans.select("key", "doc_id", "kind", "start", "end", "value", "good"))

        known = spans.filter((F.col("kind") < MODEL) & F.col("good")).select(F.col("value").alias("s"))
        ordinary = read.filter("words is not null").select(F.explode("words").alias("s"))
        least = [scratch.write(x.distinct().orderBy(F.md5("s"), "s").limit(sample)) for x in (known, ordinary)]
        random = score(F.col("value"), weights(*least)) >= math.floor(1000 * math.log(odds))
        good = F.col("good") & F.when(F.col("kind") == MODEL, random).otherwise(True)
        span = F.struct("start", F.col("kind").alias("no"), "end")
        found = spans.groupBy("key", "doc_id").agg(F.array_sort(F.collect_list(F.when(good, span))).alias("spans"))
        named = F.transform("spans", lambda s: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), s["no"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        clean = read.filter("size(hits) = 0").select("doc_id", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>").alias("spans"))
        return scratch.keep(found.select("doc_id", named.alias("spans")).unionByName(clean))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of all documents, by kind and by place."""
    out = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = joined(F.filter("spans", lambda s: s["kind"] != KINDS[MODEL]))
    return out.select("doc_id", *[count(kind).alias(f"n_{kind}") for kind in KINDS[:MODEL]], F.sha2(base, 256).alias("base_sha256"), joined("spans").alias("spans"))


OP12_SQL = (
    r"""
WITH d AS (
  SELECT row_number() OVER () AS key, doc_id, coalesce(text, '') AS text, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS mark FROM documents
), m AS (
  SELECT key, 0 AS kind, regexp_extract_all(text, '{0}') AS hits, string_split_regex(text, '{0}') AS gaps FROM d
  UNION ALL SELECT key, 1, regexp_extract_all(text, 'AKIA[A-Z0-9]+'), string_split_regex(text, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT key, 2, regexp_extract_all(text, '[0-9a-f]+'), string_split_regex(text, '[0-9a-f]+') FROM d
  UNION ALL SELECT key, 3, regexp_extract_all(text, '{3}'), string_split_regex(text, '{3}') FROM d
), h AS (
  SELECT key, kind, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, unnest(range(len(hits))) AS pos FROM m
), p AS (
  SELECT *, CASE WHEN kind = 0 THEN regexp_extract(hit, '{0}', 2) ELSE hit END AS value,
    sum(length(gap) + length(hit)) OVER (PARTITION BY key, kind ORDER BY pos) AS stop
  FROM h
), s AS (
  SELECT key, kind, value, CAST(stop - length(hit) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop
  FROM p WHERE CASE kind WHEN 0 THEN length(value) >= 6 WHEN 1 THEN length(hit) >= 20 WHEN 2 THEN length(hit) >= 24 ELSE true END
), base AS (
  SELECT * FROM s WHERE kind < 3
), c AS (
  SELECT s.* FROM s WHERE kind = 3 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.key = s.key AND b.start < s.stop AND b.stop > s.start)
), sampled AS (
  SELECT text FROM d WHERE mark <= (SELECT max(mark) FROM (SELECT mark FROM d ORDER BY mark LIMIT 2000))
), train AS (
  (SELECT 'value' AS name, value AS s FROM (SELECT DISTINCT value FROM base) ORDER BY md5(value), value LIMIT 20000)
  UNION ALL
  (SELECT 'word', s FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9+/_=-]{{4,}}')) AS s FROM sampled)
    WHERE regexp_matches(s, '^[A-Za-z]+([_-][A-Za-z]+)*$') ORDER BY md5(s), s LIMIT 20000)
), n AS (
  SELECT name, substr(s, i, 1) AS a, substr(s, i + 1, 1) AS b, count(*) AS n
  FROM (SELECT name, s, unnest(range(1, length(s))) AS i FROM train) GROUP BY ALL
), letters AS (
  SELECT unnest(string_split('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-', '')) AS c
), grid AS (
  SELECT a, b, name, coalesce(n.n, 0) AS n, sum(coalesce(n.n, 0)) OVER (PARTITION BY a, name) AS total
  FROM (SELECT x.c AS a, y.c AS b, name FROM letters x, letters y, (VALUES ('value'), ('word')) t(name)) LEFT JOIN n USING (a, b, name)
), w AS (
  SELECT a, b, CAST(floor(1000 * (max(ln((n + 1) / (total + 68))) FILTER (WHERE name = 'value')
    - max(ln((n + 1) / (total + 68))) FILTER (WHERE name = 'word')) + 0.5) AS BIGINT) AS w
  FROM grid GROUP BY a, b
), scored AS (
  SELECT key, start, stop, sum(w) AS score
  FROM (SELECT key, start, stop, substr(value, i, 1) AS a, substr(value, i + 1, 1) AS b FROM (SELECT *, unnest(range(1, length(value))) AS i FROM c)) JOIN w USING (a, b)
  GROUP BY ALL
), spans AS (
  SELECT key, kind, start, ['assign', 'access', 'hex'][kind + 1] || ':' || start || ':' || stop AS span FROM base
  UNION ALL SELECT key, 3, start, 'random:' || start || ':' || stop FROM scored WHERE score >= 13815
), g AS (
  SELECT key, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
    string_agg(span, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans
  FROM spans GROUP BY key
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (key)
"""
).format(*[p.replace("'", "''") for p in PATTERNS])
