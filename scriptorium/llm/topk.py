"""Exact top-k search by inner product as a Voronoi join.

Every vector belongs to its nearest pivot, and there are about as many pivots as the square root of the rows, up to a
bound. A cell's summary (count and radius r) bounds the scores of its vectors for any query: q.x <= q.p + |q| r. Each query
is solved in the cells nearest to it that hold rows enough, which gives a score that its k-th hit must reach. It then goes only to the other cells that can reach that score, and brings from
them only hits that do. Queries whose first cells are near each other stand in blocks of QUERY_BLOCK, for they want much
the same cells, and a cell's rows are copied to the blocks of which some query wants it, to no others. Cells are dealt to
bins of bounded size, a large cell, or many copies of one vector, to several; each bin is solved locally and the hits are
merged.

Vectors that are null or hold null or non-finite components take no part; a null id neither. Components are whole numbers
in doubles, exact up to 2**53; a score that doesn't fit a long raises an error. Vectors of different lengths are
compared as if the shorter ended in zeros; an empty one is all zeros. Repeated rows are rows of their own (a query's own
id is never its hit), and a query id that stands in several rows asks with each of their vectors: its hits are the best of
all. Equal scores go to the smaller vec_id. Extra columns are ignored. No vectors, or no queries: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import Scratch, release_memory

#: Most pivots (their vectors and summaries are what the driver and the tasks hold), and queries in a block.
PIVOTS, QUERY_BLOCK = 1024, 2048
#: Rows that are solved together, queries that are scored at once, and times k rows that a query's first cells hold.
BIN, AT_ONCE, FIRST_ROWS = 8192, 256, 4


def _matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    if len(vectors) and all(len(v) == dims for v in vectors):
        return np.stack(vectors.to_list()).astype(float)
    out = np.zeros((len(vectors), dims))
    for n, v in enumerate(vectors):
        out[n, : len(v)] = v
    return out


def _exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; in doubles where every sum stays exact, else in Python's integers."""
    bound = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1]
    if bound < 2**53:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64).astype(object) @ x.astype(np.int64).astype(object).T


class Cells:
    """Pivots with the summaries of their cells; a row for each pivot, so small."""

    def __init__(self, pivots: np.ndarray, summaries: list):
        self.number = np.array([c["cell"] for c in summaries], np.int32)
        self.pivot = pivots[self.number]
        self.radius = np.array([c["radius"] for c in summaries])
        self.count = np.array([c["n"] for c in summaries])

    def nearest(self, q: np.ndarray, rows: int) -> list[np.ndarray]:
        """For each query the cells of highest score of pivot that hold ``rows`` rows together."""
        order = np.argsort(-(q @ self.pivot.T), axis=1, kind="stable")
        return [self.number[o[: int(np.searchsorted(self.count[o].cumsum(), rows)) + 1]] for o in order]

    def dealt(self, rows: dict[int, int], size: int) -> dict[int, tuple[int, int]]:
        """For each cell with rows the first part that they go to and how many parts they are spread over. Cells stand in
        order along the axis of largest spread of their pivots; small neighbours share a part of ``size`` rows."""
        spread = self.pivot - self.pivot.mean(0)
        axis = np.linalg.svd(spread, full_matrices=False)[2][0]
        out, part, room = {}, -1, 0
        for cell in self.number[np.argsort(spread @ axis, kind="stable")].tolist():
            n = rows.get(cell, 0)
            if n > size:
                out[cell], part, room = (part + 1, -(-n // size)), part + -(-n // size), 0
            elif n:
                if n > room:
                    part, room = part + 1, size
                out[cell], room = (part, 1), room - n
        return out

    def able(self, q: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Queries x cells: whether a vector of the cell can reach the query's score."""
        at, wide = q @ self.pivot.T, np.sqrt((q**2).sum(1))[:, None] * self.radius
        return at + wide + 1e-6 * (1 + np.abs(at) + wide) >= least[:, None]


def _nearest(centre: np.ndarray, dims: int):
    def to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release_memory()
        for pdf in batches:
            if len(pdf):
                x = _matrix(pdf["v"], dims)
                cell = ((centre**2).sum(1) - 2 * x @ centre.T).argmin(1)
                yield pdf.assign(cell=cell.astype("int32"), dist=np.sqrt(((x - centre[cell]) ** 2).sum(1)))

    return to_cells


def _first_cells(cells: Cells, dims: int, rows: int):
    def targets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                found = cells.nearest(_matrix(pdf["v"], dims), rows)
                yield pd.DataFrame({"query_id": pdf["vec_id"], "q": pdf["v"], "home": [c[0] for c in found], "cells": found})

    return targets


def _other_cells(cells: Cells, dims: int):
    def targets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                able = cells.able(_matrix(pdf["q"], dims), pdf["least"].to_numpy())
                yield pdf.assign(cells=[np.setdiff1d(cells.number[row], done) for row, done in zip(able, pdf["cells"])])

    return targets


def _solve(dims: int, k: int):
    def solve(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        """The k best rows of a bin for each query of a block, of those that reach the query's score."""
        out = [(np.zeros(0, np.int64),) * 3]
        if len(x) and len(q):
            x = x.sort_values("vec_id", kind="stable", ignore_index=True)
            rows, ids, cell = _matrix(x["v"], dims), x["vec_id"].to_numpy(), x["cell"].to_numpy()
            most = int(cell.max())
            for at in range(0, len(q), AT_ONCE):
                some = q.iloc[at : at + AT_ONCE]
                own = some["query_id"].to_numpy()
                scores = _exact_scores(_matrix(some["q"], dims), rows)
                able = (scores >= some["least"].to_numpy()[:, None]) & (ids != own[:, None])
                for n, wanted in enumerate(some["cells"]):  # a bin has cells that the query doesn't want, or has seen
                    mine = np.zeros(most + 1, bool)
                    mine[wanted[wanted <= most]] = True
                    able[n] &= mine[cell]
                for n in np.flatnonzero(able.sum(1) > k):  # the k best of more, ties to the smaller id
                    there = np.flatnonzero(able[n])
                    row = scores[n, there]
                    there = there[row >= np.partition(row, -k)[-k]]
                    able[n] = False
                    able[n, there[np.argsort(-scores[n, there], kind="stable")][:k]] = True
                query, hit = np.nonzero(able)
                out.append((own[query], ids[hit], scores[query, hit].astype(np.int64)))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out)))))

    return solve


def top_k(vectors: DataFrame, is_query: str, k: int = 10, scale: float = 1024.0, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest floor(scale * x) inner products, ties to the smaller id."""
    whole = "embedding is not null and vec_id is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    ints = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    with Scratch(vectors.sparkSession) as scratch:
        table = scratch.write(vectors.filter(whole).select(F.col("vec_id").cast("long"), ints.alias("v")))
        facts = table.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"), F.count_if(F.expr(is_query)).alias("queries")).first()
        if not facts["n"] or not facts["queries"]:
            return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        dims, count = max(facts["dims"], 1), int(np.clip(round(facts["n"] ** 0.5), 1, pivots))
        centre = _matrix(pd.Series([r["v"] for r in table.orderBy(F.xxhash64("vec_id"), "vec_id").limit(count).collect()]), dims)
        celled = scratch.write(table.mapInPandas(_nearest(centre, dims), "vec_id long, v array<long>, cell int, dist double"))
        # As many rows as there are pivots come to the driver.
        summaries = celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius")).collect()
        cells = Cells(centre, summaries)
        bins = cells.dealt({c["cell"]: c["n"] for c in summaries}, BIN)
        query = "query_id long, q array<long>, home int, cells array<int>"
        asked = scratch.write(celled.filter(is_query).select("vec_id", "v").mapInPandas(_first_cells(cells, dims, FIRST_ROWS * k), query))
        blocks = cells.dealt({r["home"]: r["count"] for r in asked.groupBy("home").count().collect()}, QUERY_BLOCK)

        def part(parts: dict[int, tuple[int, int]], cell: Column, n: int) -> Column:
            return F.element_at(F.create_map(*[F.lit(x) for c, p in parts.items() for x in (c, p[n])]), cell)

        def dealt(parts: dict[int, tuple[int, int]], cell: str, by: str) -> Column:
            return (part(parts, F.col(cell), 0) + F.pmod(F.xxhash64(by), part(parts, F.col(cell), 1))).cast("int")

        asked = asked.withColumn("block", dealt(blocks, "home", "query_id"))

        def hits(queries: DataFrame) -> DataFrame:
            """Of queries with the cells that each wants: their best hits there."""
            needed = scratch.write(queries.select(F.explode("cells").alias("cell"), "block").distinct())
            data = celled.join(needed, "cell").select("vec_id", "v", "cell", dealt(bins, "cell", "vec_id").alias("bin"), "block")
            every = F.array_distinct(F.flatten(F.transform("cells", lambda c: F.sequence(part(bins, c, 0), part(bins, c, 0) + part(bins, c, 1) - 1))))
            wants = queries.select("query_id", "q", "least", "cells", F.explode(every).alias("bin"), "block")
            key = ("bin", "block")
            return data.groupBy(*key).cogroup(wants.groupBy(*key)).applyInPandas(_solve(dims, k), "query_id long, vec_id long, score long")

        first = scratch.write(hits(asked.withColumn("least", F.lit(float("-inf")))))
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        kth = first.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("kth"))
        # Slightly lower than exact, for doubles round scores over 2**53.
        least = F.coalesce(F.col("kth") - 1e-12 * F.abs("kth"), F.lit(float("-inf")))
        known = asked.join(kth, "query_id", "left").select("query_id", "q", "home", "cells", "block", least.alias("least"))
        every = first.unionByName(hits(scratch.write(known.mapInPandas(_other_cells(cells, dims), f"{query}, block int, least double"))))
        ranked = every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        return scratch.keep(ranked.select("query_id", "rank", "vec_id", "score"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all vectors for every vector whose id is divisible by 100."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 100 = 0")


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
