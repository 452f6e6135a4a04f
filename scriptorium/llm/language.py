"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's features are its byte n-grams after lower-casing, hashed into buckets. A bucket has an embedding;
the text's embedding is their average, and a linear layer with softmax gives the languages. Embeddings and
layer are trained together by stochastic gradient descent in numpy on a bounded sample of labelled rows.
A temperature fitted on rows kept from training calibrates the probability, and a floor on it, fitted on
the same rows, rejects texts the model doesn't know.

Averaging and the linear layer commute, so prediction looks up one score per bucket and language and
averages these: the same result without the embeddings in between.

Nulls: a null text or one without a letter gets 'und', score 0, and is rejected. Rows with a null lang are
predicted but never learned from; a null doc_id is predicted, never learned from and not held out.
Repeated rows are rows of their own, but learned from once. Very long texts are read whole. Extra columns pass through,
but for those named as the results are, which are replaced. Of languages with equal scores the first by name is predicted.
Without a labelled row every text gets 'und'. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.common import arrow_batches, in_arrow, named, parts, quoted, release_memory

#: Subword lengths in bytes, buckets for each, and the embedding's width.
ORDERS, BUCKETS, WIDTH = (1, 2, 3, 4), 1 << 14, 16
#: At most so many labelled rows are learned from; a fifth of them calibrate. Few rows are gone through more often, until
#: there are as many steps as all of them would make.
SAMPLE, EPOCHS, RATE = 2000, 4, 0.6
STEPS = SAMPLE * EPOCHS * 4 // 5
#: Share of the calibration rows' correct predictions that rejection may cost.
COST = 0.002

_ASCII_LETTER = re.compile(r"[A-Za-z]")
_ODD = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text)))


def _features(data: np.ndarray) -> Iterator[np.ndarray]:
    """Bucket of the n-gram at each place, for each order; buckets of different orders are apart."""
    wide = data.astype(np.uint32)
    total = np.zeros(len(wide), np.uint32)
    for n in ORDERS:
        size = len(wide) - n + 1
        if size <= 0:
            return
        total = total[:size] + (wide[n - 1 :] + np.uint32(1)) * _ODD[n - 1]
        mixed = (total ^ (total >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        yield (mixed >> np.uint32(18)).astype(np.int32) + (n - 1) * BUCKETS


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and their shares."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    found = np.bincount(np.concatenate(list(_features(data))), minlength=BUCKETS * len(ORDERS))
    at = np.flatnonzero(found)
    return at.astype(np.int32), (found[at] / found.sum()).astype(np.float32)


@dataclass
class LanguageModel:
    """Scores of buckets for each language, ready to be averaged; they come with the temperature in them."""

    languages: list[str]
    table: np.ndarray  # buckets x languages
    bias: np.ndarray
    floor: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        langs, scores, rejected = [], [], []
        for text in texts:
            if not self.languages or not has_letter(text):
                langs.append("und"), scores.append(0.0), rejected.append(True)
                continue
            data = np.frombuffer(text.lower().encode(), np.uint8)
            total, n = self.bias.astype(np.float64), 0
            sums = np.zeros(len(self.languages))
            for f in _features(data):
                found = np.bincount(f - f.min(), minlength=1) if len(f) > 4 * BUCKETS else None
                if found is None:
                    sums += self.table[f].sum(0, dtype=np.float64)
                else:
                    sums += found @ self.table[f.min() : f.min() + len(found)].astype(np.float64)
                n += len(f)
            logits = sums / n + total
            p = np.exp(logits - logits.max())
            p /= p.sum()
            best = int(p.argmax())
            langs.append(self.languages[best]), scores.append(float(p[best])), rejected.append(bool(p[best] < self.floor))
        return langs, scores, rejected


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], seed: int = 5, cost: float = COST) -> LanguageModel:
    """Stochastic gradient descent over (buckets, shares, language) rows; every fifth row calibrates."""
    languages = sorted({r[2] for r in rows})
    if not languages:
        return LanguageModel([], np.zeros((0, 0), np.float32), np.zeros(0), 1.0)
    rng = np.random.Generator(np.random.PCG64(seed))
    number = {s: n for n, s in enumerate(languages)}
    kept = rows[4::5] or rows
    learn = [r for n, r in enumerate(rows) if n % 5 != 4] or rows
    embed = (rng.random((BUCKETS * len(ORDERS), WIDTH), dtype=np.float32) - 0.5) / WIDTH
    layer = (rng.random((WIDTH, len(languages)), dtype=np.float32) - 0.5) / WIDTH
    bias = np.zeros(len(languages), np.float32)
    epochs = max(EPOCHS, -(-STEPS // len(learn)))
    steps, done = epochs * len(learn), 0
    for _ in range(epochs):
        for n in rng.permutation(len(learn)):
            at, share, lang = learn[n]
            rate = RATE * (1 - done / steps) + 1e-3
            hidden = share @ embed[at]
            logits = hidden @ layer + bias
            wrong = np.exp(logits - logits.max())
            wrong /= wrong.sum()
            wrong[number[lang]] -= 1
            back = layer @ wrong
            layer -= rate * np.outer(hidden, wrong)
            bias -= 0.1 * rate * wrong
            embed[at] -= np.outer(share * (rate * 50), back)
            done += 1
    table = embed @ layer
    raw = np.array([s @ table[a] + bias for a, s, _ in kept], np.float64)
    truth = np.array([number[r[2]] for r in kept])

    def probabilities(heat: float) -> np.ndarray:
        z = raw / heat
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    # Soft targets, one wrong in n + 2, keep the temperature finite where every row is right.
    soft, others = 1 / (len(truth) + 2), max(1, len(languages) - 1)

    def loss(heat: float) -> float:
        logs = np.log(np.maximum(probabilities(heat), 1e-300))
        own = logs[np.arange(len(truth)), truth]
        return float(-((1 - soft) * own + soft / others * (logs.sum(1) - own)).mean())

    heats = np.geomspace(0.05, 20, 60)
    losses = [loss(h) for h in heats]
    heat = float(heats[int(np.argmin(losses))])
    p = probabilities(heat)
    right = p.max(1)[p.argmax(1) == truth]
    floor = min(0.5, float(np.quantile(right, cost))) if len(right) else 0.0
    return LanguageModel(languages, (table / heat).astype(np.float32), bias / heat, floor)


def learnable() -> str:
    """Rows to learn from: labelled, not held out."""
    return "lang is not null and doc_id is not null and pmod(crc32(cast(doc_id as string)), 4) <> 2"


def train(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Fit on at most ``sample`` learnable rows; only their bucket counts come to the driver.

    Each language gives as many rows as any other while it has them, those of the smallest hash of id and text, so
    that a rare language is learned too.
    """
    mine = docs.filter(learnable()).select(F.col("text").cast("string").alias("text"), "lang", F.xxhash64("doc_id", "text").alias("place"), F.xxhash64("text").alias("tie"))
    # Of a large language only rows with a low hash are ranked: twice as many as can be wanted, and the lowest are among them.
    low = F.shiftrightunsigned("place", 1).cast("double") / float(1 << 63)
    few = mine.join(mine.groupBy("lang").agg(F.count("*").alias("n")), "lang").filter(low < F.lit(2.0 * sample + 200) / F.col("n"))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(low, "place", "tie"))
    chosen = few.select("lang", "place", "tie", turn.alias("turn")).filter(F.col("turn") <= sample).orderBy("turn", "lang", "place", "tie").limit(sample)

    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release_memory()
        for pdf in batches:
            pdf = pdf[[has_letter(x) for x in pdf["text"]]]
            found = [counts(x) for x in pdf["text"]]
            yield pd.DataFrame({"place": pdf["place"], "lang": pdf["lang"], "at": [a.tobytes() for a, _ in found], "share": [s.tobytes() for _, s in found]})

    # Broadcast: at most ``sample`` rows of three values.
    texts = mine.join(F.broadcast(chosen.select("lang", "place", "tie").distinct()), ["lang", "place", "tie"], "left_semi")
    with arrow_batches(docs.sparkSession, 1024):
        rows = texts.dropDuplicates(["lang", "place", "tie"]).select("place", "lang", "text").mapInPandas(shares, "place long, lang string, at binary, share binary").collect()
    rows = sorted(rows, key=lambda r: (r["place"], r["at"], r["lang"]))
    return fit([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["share"], np.float32), r["lang"]) for r in rows])


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The input's columns with lang_pred, score and rejected; columns of these names in the input are replaced.

    The model (buckets x languages) is small whatever the input.
    """
    added = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    kept = docs.select(*[quoted(c) for c in docs.columns if c.lower() not in added.names])
    text_at = kept.columns.index(named(kept, "text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in parts(batches):
            langs, scores, rejected = model.predict(batch.column(text_at).to_pylist())
            columns = [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{n}" for n in range(len(columns))])

    return in_arrow(kept, predict, kept.schema, added)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs)
    out = identify(docs.select("doc_id", "text"), model)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
