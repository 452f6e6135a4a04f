"""Packing documents into training sequences by bounded-space online best fit.

Each partition keeps a fixed number of open windows. A document's ids are cut into full windows and a
rest; the rest goes to the open window that it fills best. When none has room, the fullest window is
emitted if its gap is small, else it is filled with the first ids of the piece and then emitted. The
windows that are open at a partition's end are merged once with those of FAN_IN partitions, whole windows at a
time, so no task sees more than a fixed number of windows. Each group leaves at most one window that is not over half full.

Nulls: a null text is an empty document, as an empty one is: its end id alone; a null doc_id is kept. A very long text
fills windows of its own and leaves its rest to the open ones. Repeated rows are packed each on its own, so the pieces
of rows with one doc_id are told apart by their sequence and offset only. Windows with equal room are taken in the order
in which they were opened. Extra columns are ignored, whatever their names. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import Scratch, parts
from scriptorium.llm.tokens import chunk_memo, tokenizer_path

LENGTH, END_ID = 2048, 1
#: Windows that a partition keeps open; a gap that may be padded; partitions whose open windows meet.
OPEN, GAP, FAN_IN = 32, 24, 16

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, at long, part long, left_open boolean, ids array<int>"


class OpenWindows:
    """A fixed number of windows that take pieces until they are emitted."""

    def __init__(self, base: int, length: int, count: int):
        self.base, self.length, self.count = base, length, count
        self.free: dict[int, int] = {}
        self.next = base

    def fresh(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, size: int) -> list[tuple[int, int, int]]:
        """Cut a piece of ``size`` ids into (window, offset there, ids taken), in order."""
        out = []
        while size >= self.length:
            out.append((self.fresh(), 0, self.length))
            size -= self.length
        while size:
            fits = [(room, w) for w, room in self.free.items() if room >= size]
            if fits:
                room, best = min(fits)
            elif len(self.free) < self.count:
                best, room = self.fresh(), self.length
            else:
                room, best = min((r, w) for w, r in self.free.items())
                if room <= GAP:
                    del self.free[best]
                    continue
            taken = min(size, room)
            out.append((best, self.length - room, taken))
            size -= taken
            self.free[best] = room - taken
            if not self.free[best]:
                del self.free[best]
        return out


def _pieces(tokenizer: str, length: int, end_id: int, count: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        memo, end = chunk_memo(tokenizer), np.array([end_id], "<u4").tobytes()
        windows = OpenWindows(part << 32, length, count)
        held: dict[int, list] = {}

        def batch_of(rows: list, left_open: bool) -> pa.RecordBatch:
            cols = list(zip(*[r[:7] for r in rows])) if rows else [()] * 7
            offsets = np.concatenate([[0], np.cumsum([len(r[7]) // 4 for r in rows], dtype=np.int64)]).astype(np.int32)
            ids = pa.array(np.frombuffer(b"".join(r[7] for r in rows), "<i4"))
            n = len(rows)
            return pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in cols), pa.array([part] * n, pa.int64()), pa.array([left_open] * n, pa.bool_()), pa.ListArray.from_arrays(pa.array(offsets), ids)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "window", "at", "part", "left_open", "ids"],
            )

        for batch in parts(batches):
            ids = batch.column("doc_id").to_pylist()
            for doc, data in zip(ids, memo.encode([t or "" for t in batch.column("text").to_pylist()])):
                data += end
                start, total = 0, len(data) // 4
                for window, at, taken in windows.place(total):
                    own = data[4 * start : 4 * (start + taken)]
                    held.setdefault(window, []).append((doc, start, taken, zlib.crc32(own), total, window, at, own))
                    start += taken
            ready = [w for w in held if w not in windows.free]
            if ready:
                yield batch_of([r for w in ready for r in held.pop(w)], False)
        if held:
            yield batch_of([r for rows in held.values() for r in rows], True)

    return pack


def _merge(length: int):
    """Open windows of a group as items of one size each; best fit decreasing."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["used", "window"], ascending=[False, True], ignore_index=True)
        room: dict[int, int] = {}
        to, base = [], []
        for used in pdf["used"].tolist():
            fits = [(r, w) for w, r in room.items() if r >= used]
            r, w = min(fits) if fits else (length, len(room))
            to.append(w)
            base.append(length - r)
            room[w] = r - used
        return pd.DataFrame({"window": pdf["window"], "merged": pdf["grp"] * (1 << 32) + np.array(to, np.int64), "base": np.array(base, np.int64)})

    return merge


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, open_windows: int = OPEN) -> DataFrame:
    """Pieces of all documents with their ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    The pieces of a sequence have offsets from 0 without gaps; no sequence exceeds ``length``.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # The result reads the pieces, so they are kept.
    pieces = Scratch(docs.sparkSession).keep(texts.mapInArrow(_pieces(tokenizer, length, end_id, open_windows), _PIECE), rows=512)
    rest = pieces.filter("left_open").groupBy("window", "part").agg(F.sum("length").alias("used"))
    rest = rest.withColumn("grp", F.floor(F.col("part") / FAN_IN))
    moved = rest.select("window", "used", "grp").groupBy("grp").applyInPandas(_merge(length), "window long, merged long, base long")
    open_pieces = pieces.filter("left_open").join(moved, "window")
    # Merged sequences have odd ids, the others even ones.
    closed = pieces.filter("not left_open").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("window") * 2).alias("sequence_id"), F.col("at").alias("offset"), "ids")
    return closed.unionByName(open_pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("merged") * 2 + 1).alias("sequence_id"), (F.col("at") + F.col("base")).alias("offset"), "ids"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids; a row for each piece."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json")).drop("ids")
