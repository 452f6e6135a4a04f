"""Substring dedup by suffix sorting: bytes covered by a string of LENGTH bytes that starts elsewhere too.

Candidates. Every string of LENGTH bytes has an anchor, its GRAM-byte piece of least hash. Equal strings
have equal anchors at the same distance, so only anchors that occur twice can lead to a repeat. All strings
of one anchor form a suffix bucket; each occurrence brings the text around it.

Buckets are sorted one block at a time: suffixes from the anchor on, and reversed prefixes before it. A
sort compares a few bytes (PERIOD); longer ties are resolved by ranks of the difference-cover sample, which
are computed for the block beforehand: for any two suffixes some shift under PERIOD takes both to sampled
places, whose ranks decide. Shared lengths of neighbours in both orders give classes at each depth, and
two occurrences share the string that starts d bytes before the anchor if they are in one class of prefixes at
depth d and in one class of suffixes at depth LENGTH - d.

Large buckets are split: strings whose distances from the anchor lie in one range of ``width`` share the bytes that all
of the range have, so these bytes name a smaller bucket, down to single strings (SPLITS). A partition sends an equal
occurrence once however often it meets it, so a passage that everyone quotes makes a row for each partition. All buckets
are solved in the same way, on their bytes.

Nulls: a null text is empty; a null doc_id is kept. Rows with the same doc_id are documents of their own, known by id and
a 64-bit hash of the text; equal rows are copies of each other. Very long texts are cut into pieces that overlap by
LENGTH - 1 bytes. Strings that tie in all bytes are one string. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import Scratch, parts, release_memory, window_hashes

LENGTH, GRAM = 200, 64
#: Distances from an anchor to the starts of its strings.
SPAN = LENGTH - GRAM + 1
#: Width of the ranges of distances that a bucket is split into, by its number of occurrences.
SPLITS = ((1 << 16, 1), (256, 23), (0, SPAN))
#: Bytes hashed together, members of buckets sorted together, and occurrences that a partition remembers to have sent.
PIECE, BLOCK, SENT = 1 << 20, 20_000, 50_000
#: A perfect difference set (fixed values): every residue modulo PERIOD is a difference of two of COVER.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)


def _shifts() -> np.ndarray:
    """shift[r, s]: the least d with r + d and s + d both in the cover, modulo PERIOD."""
    table = np.full((PERIOD, PERIOD), -1)
    for d in range(PERIOD - 1, -1, -1):
        at = [(c - d) % PERIOD for c in COVER]
        table[np.ix_(at, at)] = d
    return table


SHIFT = _shifts()


class CoverSorter:
    """Sorts suffixes of a block of short texts that stand one after the other."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        residues = self.starts[:-1] % PERIOD
        # Only sampled places within PERIOD of a start can decide between two starts.
        names, keys = [], []
        for n, (text, r) in enumerate(zip(texts, residues.tolist())):
            for c in COVER:
                d = (c - r) % PERIOD
                names.append((n, d))
                keys.append(text[d:])
        order = sorted(range(len(keys)), key=keys.__getitem__)
        self.rank: dict[tuple[int, int], int] = {}
        rank, last = -1, None
        for i in order:
            if keys[i] != last:
                rank, last = rank + 1, keys[i]
            self.rank[names[i]] = rank
        self.residue = residues.tolist()

    def compare(self, a: int, b: int) -> int:
        """Order of two texts that agree in PERIOD bytes (or are equal where one ends)."""
        d = int(SHIFT[self.residue[a], self.residue[b]])
        return self.rank[a, d] - self.rank[b, d]

    def bucket(self, members: list[int]) -> list[int]:
        """One suffix bucket in order."""
        texts = self.texts
        members = sorted(members, key=lambda m: texts[m][:PERIOD])
        out, i = [], 0
        while i < len(members):
            j = i + 1
            while j < len(members) and texts[members[j]][:PERIOD] == texts[members[i]][:PERIOD]:
                j += 1
            out += sorted(members[i:j], key=cmp_to_key(self.compare)) if j - i > 1 else members[i:j]
            i = j
        return out


def _sorted_depths(texts: list[bytes], buckets: list[list[int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of all members bucket after bucket, and the bytes each shares with the one before (-1: another bucket)."""
    sorter = CoverSorter(texts)
    order = np.array([m for b in buckets for m in sorter.bucket(b)], np.int64)
    rows = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(len(texts), width)[order]
    size = np.array([len(t) for t in texts])[order]
    same = rows[1:] == rows[:-1]
    depth = np.where(same.all(1), width, same.argmin(1))
    depth = np.minimum(depth, np.minimum(size[1:], size[:-1]))
    depth = np.concatenate([[-1], depth])
    heads = np.cumsum([0, *(len(b) for b in buckets)])[:-1]
    depth[heads] = -1
    return order, depth


def repeated_starts(keys: np.ndarray, before: list[bytes], after: list[bytes], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """members x distances: whether the string that starts so many bytes before the anchor occurs twice.

    ``keys`` come in order; a member's strings start ``low`` to ``high`` bytes before its anchor.
    """
    n, span = len(keys), SPAN
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    buckets = [list(range(a, b)) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
    right, right_depth = _sorted_depths(after, buckets, LENGTH)
    left, left_depth = _sorted_depths(before, buckets, span - 1)
    found = np.zeros((n, span), bool)
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(span):
        mine = np.flatnonzero((low <= d) & (d <= high))
        if len(mine) < 2:
            continue
        right_class[right] = np.cumsum(right_depth < LENGTH - d)
        left_class[left] = np.cumsum(left_depth < d)
        both = left_class[mine] * (n + 1) + right_class[mine]
        order = np.argsort(both, kind="stable")
        ranked = both[order]
        equal = ranked[1:] == ranked[:-1]
        twice = np.concatenate([[False], equal]) | np.concatenate([equal, [False]])
        found[mine[order[twice]], d] = True
    return found


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of true values."""
    edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of each anchor, first and last start of the strings that have it. ``data``: under 4 MB."""
    width = SPAN
    gram = window_hashes(data, GRAM)
    count = len(gram) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    mask = np.uint64((1 << 22) - 1)
    value = (gram & ~mask) | np.arange(len(gram), dtype=np.uint64)
    blocks = -(-len(value) // width)
    grid = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(value)] = value
    grid = grid.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()[:count]
    behind = np.minimum.accumulate(grid, axis=1).ravel()[width - 1 : width - 1 + count]
    place = (np.minimum(ahead, behind) & mask).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return gram[place[first]], place[first], first, np.append(first[1:], count) - 1


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(group: list) -> pa.RecordBatch:
        """Anchors of the pieces of texts in a group, found together; strings across two pieces don't count."""
        data = np.frombuffer(b"".join(g[2] for g in group), np.uint8)
        bounds = np.cumsum([0, *(len(g[2]) for g in group)])
        key, at, first, last = anchors(data)
        own = np.searchsorted(bounds, first, "right") - 1
        to = np.searchsorted(bounds, last, "right") - 1
        parts = []
        for step in range(int((to - own).max(initial=0)) + 1):  # a run of starts may go on in the next pieces
            piece = np.minimum(own + step, len(group) - 1)
            a, b = np.maximum(first, bounds[piece]), np.minimum(last, bounds[piece + 1] - LENGTH)
            ok = (own + step <= to) & (a <= b)
            parts.append((key[ok], at[ok], a[ok], b[ok], piece[ok]))
        key, at, a, b, piece = (np.concatenate(c) for c in zip(*parts))
        move = np.array([g[1] for g in group], np.int64) - bounds[:-1]
        doc, tie = (np.array([g[0][k] for g in group], np.int64) for k in (0, 1))
        # Starts go as distances from the anchor: small numbers, which shuffle files pack well.
        cols = [key.view(np.int64), doc[piece], tie[piece], (at + move[piece]).astype(np.int32), (at - a).astype(np.int16), (b - a).astype(np.int16)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "doc", "tie", "at", "before", "more"])

    release_memory()
    for batch in parts(batches):
        group, size = [], 0
        for *doc, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "tie", "text"))):
            raw = (text or "").encode()
            for start in range(0, max(len(raw) - LENGTH + 1, 0), PIECE):
                piece = raw[start : start + PIECE + LENGTH - 1]
                if group and size + len(piece) > PIECE:
                    yield flush(group)
                    group, size = [], 0
                group.append((doc, start, piece))
                size += len(piece)
        if group:
            yield flush(group)


_MEMBER = {"key": pa.int64(), "doc": pa.int64(), "tie": pa.int64(), "at": pa.int32(), "first": pa.int32(), "last": pa.int32(), "around": pa.binary(), "sure": pa.bool_()}
MEMBER = "key long, doc long, tie long, at int, first int, last int, around binary, sure boolean"


def _split(raw: bytes, at: int, first: int, last: int, width: int) -> Iterator[tuple[int, int, int]]:
    """Key, first and last start of the smaller buckets of a member whose strings start at ``first`` to ``last``."""
    for low in range((at - last) // width * width, at - first + 1, width):
        core = raw[at - low : at - (low + width - 1) + LENGTH]  # what every string of the range has
        key = hashlib.blake2b(core, digest_size=8, key=bytes([low, width])).digest()
        yield int.from_bytes(key, "little", signed=True), max(first, at - (low + width - 1)), min(last, at - low)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket rows of documents: the text around an anchor, whole or in ranges. An occurrence in a split bucket that
    equals one that was sent before is a repeat for sure, and so is that one."""
    sent: dict[tuple, tuple | None] = {}

    def sure(doc: int, tie: int, first: int, last: int) -> tuple:
        """A row that no other has to meet: its key only deals it out."""
        return (doc + first * 0x9E3779B1) % (1 << 63), doc, tie, first, first, last, None, True

    for batch in parts(batches):
        rows: list[tuple] = []
        for doc, tie, text, own in zip(*(batch.column(c).to_pylist() for c in ("doc", "tie", "text", "own"))):
            raw, again = text.encode(), []
            for a in own:
                at, first, width = a["at"], a["at"] - a["before"], a["width"]
                last = first + a["more"]
                if width == SPAN:
                    rows.append((a["key"], doc, tie, at, first, last, raw[first : last + LENGTH], False))
                    continue
                for key, low, high in _split(raw, at, first, last, width):
                    around = raw[low : high + LENGTH]
                    seen = (key, at - low, around)
                    if seen not in sent:
                        if len(sent) >= SENT:
                            sent.clear()
                        sent[seen] = (doc, tie, low, high)
                        rows.append((key, doc, tie, at, low, high, around, False))
                        continue
                    if sent[seen] is not None:
                        rows.append(sure(*sent[seen]))
                        sent[seen] = None
                    again.append((low, high))
            run: list[int] = []
            for low, high in sorted(again):
                if run and low <= run[1] + 1:
                    run[1] = max(run[1], high)
                else:
                    if run:
                        rows.append(sure(doc, tie, *run))
                    run = [low, high]
            if run:
                rows.append(sure(doc, tie, *run))
        cols = list(zip(*rows)) if rows else [()] * len(_MEMBER)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _MEMBER.values())], names=list(_MEMBER))


def _solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of starts that are repeats, from bucket rows in order of their keys."""
    cols = ["doc", "tie", "first", "last"]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rest = pdf[~pdf["sure"]]
        rest = rest[rest.duplicated(["key"], keep=False)]
        out = [pdf.loc[pdf["sure"], cols]]
        if len(rest):
            at, first, last = (rest[c].to_numpy(np.int64) for c in ("at", "first", "last"))
            around = rest["around"].tolist()
            cuts = (at - first).tolist()
            before, after = [x[:c][::-1] for x, c in zip(around, cuts)], [x[c:] for x, c in zip(around, cuts)]
            found = repeated_starts(rest["key"].to_numpy(), before, after, at - last, at - first)
            row, low, high = _runs(found)
            doc, tie = (rest[c].to_numpy()[row] for c in ("doc", "tie"))
            out.append(pd.DataFrame({"doc": doc, "tie": tie, "first": at[row] - high, "last": at[row] - low}))
        return pd.concat(out, ignore_index=True)

    held, size = [], 0
    for pdf in batches:
        held.append(pdf)
        size += len(pdf)
        if size >= BLOCK:
            rows = pd.concat(held, ignore_index=True)
            whole = (rows["key"] != rows["key"].iloc[-1]).to_numpy()
            if whole.any():
                yield solve(rows[whole])
            held = [rows[~whole]]
            size = len(held[0])
    if held:
        yield solve(pd.concat(held, ignore_index=True))


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for text, runs in zip(pdf["text"], pdf["runs"]):
            raw = text.encode() if isinstance(text, str) else b""
            spans: list[list[int]] = []
            for a, b in sorted((r["first"], r["last"] + LENGTH) for r in runs) if runs is not None else ():
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            at, parts = 0, []
            for a, b in spans:
                parts.append(raw[at:a])
                at = b
            kept = b"".join([*parts, raw[at:]]) if spans else raw
            rows.append((len(raw), len(raw) - len(kept), [{"start": a, "length": b - a} for a, b in spans], hashlib.sha256(kept).hexdigest()))
        yield pd.DataFrame({"doc_id": pdf["doc_id"]}).assign(**dict(zip(("n_bytes", "n_removed", "removed", "kept_sha256"), map(list, zip(*rows)) if rows else [[]] * 4)))


def repeated_substrings(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, removed (byte spans), kept_sha256 of the bytes left."""
    text, doc = F.col("text").cast("string"), F.col("doc_id").cast("long")
    # Both joins to the texts read the same columns, so that one shuffle of the texts serves both. Equal rows have one key:
    # sets keep one of each of their anchors and runs.
    tie = F.xxhash64(text, doc.isNull())
    keyed = docs.select(doc.alias("doc_id"), F.coalesce(doc, F.lit(0).cast("long")).alias("doc"), tie.alias("tie"), text.alias("text"))
    width = F.expr("case " + " ".join(f"when n > {n} then {w}" for n, w in SPLITS) + " end").cast("short")
    with Scratch(docs.sparkSession) as scratch:
        long = keyed.filter(f"octet_length(text) >= {LENGTH}").select("doc", "tie", "text")
        found = scratch.write(long.mapInArrow(_anchor_rows, "key long, doc long, tie long, at int, before short, more short"), rows=1024)
        shared = scratch.write(found.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", width.alias("width")))
        own = scratch.keep(found.join(shared, "key").groupBy("doc", "tie").agg(F.collect_set(F.struct("key", "at", "before", "more", "width")).alias("own")))
    members = keyed.join(own, ["doc", "tie"]).select("doc_id", "doc", "tie", "text", "own").mapInArrow(_members, MEMBER)
    runs = members.repartition("key").sortWithinPartitions("key").mapInPandas(_solved, "doc long, tie long, first int, last int")
    runs = runs.groupBy("doc", "tie").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    out = keyed.join(runs, ["doc", "tie"], "left").select("doc_id", "doc", "tie", "text", "runs")
    return out.mapInPandas(_cut, "doc_id long, n_bytes long, n_removed long, removed array<struct<start:long,length:long>>, kept_sha256 string")


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of strings of 200 bytes that occur twice."""
    out = repeated_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")
