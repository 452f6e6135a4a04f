"""Substring dedup by hashing units: whole lines, and chains of short pieces cut by their content.

Words are normalised (UTF-8, A-Z lower-cased, white space between words ignored) and hashed. Each line is a unit. A passage
also stands in the middle of longer lines, so a text is cut into pieces as well, after words that are the least of five
neighbours: words before punctuation come first, else the order is that of their first bytes, so a passage is cut
alike wherever it stands, but for a few words at its edges. Pieces have 3 to 16 words, 18 at an edge, and each chain of CHAIN
pieces is a unit. Over all documents the earliest occurrence of a digest, by doc_id and place, is kept; every later one is
removed. The rest keeps its offsets in the original text. ``short`` (words of a line) and ``least_words`` (words of a run of
repeats that isn't a whole line) can spare short repeats; by default none is spared.

Nulls: a null text stays null and has nothing removed; a null doc_id ranks after all others. Rows of
the same doc_id rank by a hash of their text; equal rows are one occurrence and stay alike. Texts without words stay. Very
long texts are read whole. Further columns pass through, but one named ``removed``, which is replaced. An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.common import Scratch, free_name, in_arrow, mix64, named, parts, quoted, release_memory, span_hashes
from scriptorium.llm.minhash import _LOWER, _SPACE

#: Least words of a run of repeats and of a repeated line that go; pieces to a unit, most words of a piece, neighbours of a cut.
LEAST_WORDS, SHORT = 1, 1
CHAIN, LONGEST, NEAR = 3, 16, 2
_STOPS = np.isin(np.arange(256), list(b".!?,;:"))
_LAST = (1 << 63) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_ranks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order of words for cuts: those that end in punctuation first, then by their first seven bytes."""
    rank = (~_STOPS[data[ends - 1]]).astype(np.uint64)
    for k in range(7):
        at = starts + k
        rank = rank << np.uint64(8) | np.where(at < ends, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint64)
    return rank


def pieces(rank: np.ndarray) -> np.ndarray:
    """First words of the pieces of a text of ranked words. A cut depends on NEAR words before it and as many after."""
    n = len(rank)
    wide = np.concatenate([np.full(NEAR, ~np.uint64(0)), rank, np.full(NEAR, ~np.uint64(0))])
    least = np.ones(n, bool)
    for d in range(1, NEAR + 1):
        least &= (rank < wide[NEAR - d : NEAR - d + n]) & (rank <= wide[NEAR + d : NEAR + d + n])
    cuts = np.flatnonzero(least) + 1
    cuts = np.concatenate([[0], cuts[(cuts > NEAR) & (n - cuts > NEAR)]])
    gaps = np.diff(np.append(cuts, n))
    more = np.maximum((gaps - NEAR - 1) // LONGEST, 0)  # words that repeat give no least one
    step = np.arange(int((more + 1).sum())) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
    return np.repeat(cuts, more + 1) + step * LONGEST


def _digests(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    n = np.diff(np.append(first, len(words)))
    place = np.arange(len(words)) - np.repeat(first, n)
    return mix64(np.add.reduceat(mix64(words + place.astype(np.uint64) * _ODD), first) ^ n.astype(np.uint64))


def units(text: bytes, short: int = SHORT) -> tuple[np.ndarray, ...]:
    """Of each unit its place (twice its first word, plus one for lines), digest, first word and the word after its last;
    and the words' starts."""
    data = np.frombuffer(text + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return (np.zeros(0, np.int64),) * 5
    low = _LOWER[data]
    words = span_hashes(low, starts, ends)
    first = pieces(word_ranks(low, starts, ends))
    own = _digests(words, first)
    chain = min(CHAIN, len(first))
    count = len(first) - chain + 1
    digest = np.zeros(count, np.uint64)
    for k in range(chain):
        digest = mix64(digest * _ODD + own[k : k + count])
    upto = np.append(first, len(words))[chain:]
    line = np.cumsum(data == 10)[starts]
    begin = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    stop = np.append(begin[1:], len(words))
    long = stop - begin >= short
    lines = mix64(_digests(words, begin) ^ _ODD)[long]
    begin, stop = begin[long], stop[long]
    place = np.concatenate([2 * first[:count], 2 * begin + 1])
    return place, np.concatenate([digest, lines]).view(np.int64), np.concatenate([first[:count], begin]), np.concatenate([upto, stop]), starts


def _unit_rows(short: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in parts(batches):
            found = []
            for k, t, text in zip(*(batch.column(c).to_pylist() for c in ("kid", "tie", "text"))):
                place, digest, *_ = units(text.encode(), short)
                found.append((np.full(len(place), k, np.int64), np.full(len(place), t, np.int64), place.astype(np.int32), digest))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["kid", "tie", "place", "digest"])

    return rows


def repeated_spans(text: bytes, repeats: np.ndarray, least_words: int, short: int) -> list[tuple[int, int]]:
    """Byte spans of repeats; ``repeats`` are places of units. A span reaches to the next word."""
    place, _, first, upto, starts = units(text, short)
    hit = np.isin(place, repeats)

    def marked(which: np.ndarray) -> np.ndarray:
        change = np.zeros(len(starts) + 1, np.int64)
        np.add.at(change, first[which], 1)
        np.add.at(change, upto[which], -1)
        return np.cumsum(change[:-1]) > 0

    def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = np.diff(np.pad(flags.astype(np.int8), 1))
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    gone = marked(hit & (place % 2 == 1))
    for a, b in zip(*runs(marked(hit))):
        if b - a >= least_words:
            gone[a:b] = True
    nexts = np.append(starts, len(text))
    return [(int(nexts[a]), int(nexts[b])) for a, b in zip(*runs(gone))]


def _without_repeats(text_at: int, least_words: int, short: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            *columns, places = batch.columns
            texts, spans = columns[text_at].to_pylist(), []
            for n, found in enumerate(places.to_pylist()):
                found = repeated_spans(raw := texts[n].encode(), np.array(found, np.int64), least_words, short) if found else []
                if found:
                    edges = [0, *(x for span in found for x in span), len(raw)]
                    texts[n] = b"".join(raw[a:b] for a, b in zip(edges[0::2], edges[1::2])).decode()
                spans.append([{"start": a, "length": b - a} for a, b in found])
            columns[text_at] = pa.array(texts, columns[text_at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind)], names=[f"c{n}" for n in range(len(columns) + 1)])

    return cut


def dedup_units(docs: DataFrame, least_words: int = LEAST_WORDS, short: int = SHORT) -> DataFrame:
    """The input's rows with their texts' repeats removed, and ``removed``: byte spans of the original text."""
    names = [c for c in docs.columns if c.lower() != "removed"]
    kid, tie, places = (free_name(x, names) for x in ("kid", "tie", "places"))
    keyed = docs.select(*[quoted(c) for c in names]).withColumns({
        kid: F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), tie: F.xxhash64(F.col("text"), F.col("doc_id").isNull())
    })
    where = F.struct("kid", "tie", "place")
    with Scratch(docs.sparkSession) as scratch:
        texts = keyed.filter("text is not null").select(F.col(kid).alias("kid"), F.col(tie).alias("tie"), "text")
        found = scratch.write(texts.mapInArrow(_unit_rows(short), "kid long, tie long, place int, digest long"), rows=1024)
        firsts = scratch.write(found.groupBy("digest").agg(F.min(where).alias("first"), F.max(where).alias("last")).filter("first <> last").select("digest", "first"))
        repeats = found.join(firsts, "digest").filter(where != F.col("first"))
        gone = scratch.keep(repeats.groupBy(F.col("kid").alias(kid), F.col("tie").alias(tie)).agg(F.collect_set("place").alias(places)))
    joined = keyed.join(gone, [kid, tie], "left").select(*[quoted(c) for c in names], places)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])
    added = T.StructType([T.StructField("removed", T.ArrayType(span))])
    return in_arrow(joined, _without_repeats(joined.columns.index(named(joined, "text")), least_words, short), joined.schema[:-1], added)


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated passages: the text left, how much is gone, and where it stood (start+length in bytes)."""
    out = dedup_units(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["length"])
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws("+", x["start"].cast("string"), x["length"].cast("string"))), ",")
    return out.select("doc_id", "text", F.size("removed").cast("long").alias("n_spans"), size.alias("n_removed"), spans.alias("removed"))


OP10_SQL = r"""
WITH t AS (
  SELECT doc_id, text, coalesce(regexp_extract(text, '^[\x20\x09-\x0D]*'), '') AS head,
    coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*'), []) AS tokens
  FROM documents
), u AS (
  SELECT doc_id, head, len(tokens) AS n, unnest(tokens) AS token, unnest(range(len(tokens))) AS i FROM t
), w AS (
  SELECT *, translate(regexp_extract(token, '^[^\x20\x09-\x0D]+'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word,
    strlen(head) + coalesce(sum(strlen(token)) OVER before, 0) AS byte,
    coalesce(sum(len(token) - len(replace(token, chr(10), ''))) OVER before, 0) AS line
  FROM u WINDOW before AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), k AS (
  SELECT *, CASE WHEN right(word, 1) IN ('.', '!', '?', ',', ';', ':') THEN '0' ELSE '1' END || substr(hex(word), 1, 14) AS rank FROM w
), c AS (
  SELECT *, i >= 2 AND n - i > 3 AND rank < lag(rank, 1, 'x') OVER d AND rank < lag(rank, 2, 'x') OVER d
    AND rank <= lead(rank, 1, 'x') OVER d AND rank <= lead(rank, 2, 'x') OVER d AS cut
  FROM k WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), g AS (
  SELECT *, coalesce(sum(CAST(cut AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cuts FROM c
), h AS (
  SELECT *, i - min(i) OVER p AS j, greatest((count(*) OVER p - 3) // 16, 0) AS more FROM g WINDOW p AS (PARTITION BY doc_id, cuts)
), p AS (
  SELECT doc_id, cuts, least(j // 16, more) AS step, string_agg(word, ' ' ORDER BY i) AS body, min(i) AS a, max(i) + 1 AS b FROM h GROUP BY ALL
), q AS (
  SELECT doc_id, a, count(*) OVER (PARTITION BY doc_id) AS m, row_number() OVER o AS r,
    body || coalesce(chr(10) || lead(body, 1) OVER o, '') || coalesce(chr(10) || lead(body, 2) OVER o, '') AS body,
    coalesce(lead(b, 2) OVER o, lead(b, 1) OVER o, b) AS b
  FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY a)
), units AS (
  SELECT 'chain' AS kind, body, doc_id, 2 * a AS place, a, b FROM q WHERE r <= greatest(m - 2, 1)
  UNION ALL
  SELECT 'line', string_agg(word, ' ' ORDER BY i), doc_id, 2 * min(i) + 1, min(i), max(i) + 1 FROM w GROUP BY doc_id, line
), again AS (
  SELECT * FROM units QUALIFY row_number() OVER (PARTITION BY kind, body ORDER BY doc_id NULLS LAST, place) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(a, b)) AS i FROM again
), s AS (
  SELECT w.*, gone.i IS NOT NULL AS out, w.i - row_number() OVER (PARTITION BY w.doc_id, gone.i IS NOT NULL ORDER BY w.i) AS run
  FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.i = w.i
), spans AS (
  SELECT doc_id, min(byte) AS start, sum(strlen(token)) AS length FROM s WHERE out GROUP BY doc_id, run
), sums AS (
  SELECT doc_id, count(*) AS n_spans, sum(length) AS n_removed, string_agg(CAST(start AS BIGINT) || '+' || CAST(length AS BIGINT), ',' ORDER BY start) AS removed
  FROM spans GROUP BY doc_id
), left_over AS (
  SELECT doc_id, string_agg(token, '' ORDER BY i) FILTER (WHERE NOT out) AS kept FROM s GROUP BY doc_id
)
SELECT t.doc_id, CASE WHEN x.doc_id IS NULL THEN t.text ELSE t.head || coalesce(y.kept, '') END AS text,
  coalesce(x.n_spans, 0) AS n_spans, CAST(coalesce(x.n_removed, 0) AS BIGINT) AS n_removed, coalesce(x.removed, '') AS removed
FROM t LEFT JOIN sums x ON x.doc_id = t.doc_id LEFT JOIN left_over y ON y.doc_id = t.doc_id
"""
