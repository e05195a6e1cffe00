"""Sum-of-squares online packing into windows of ``window`` tokens.

A document's ids and its end id arrive online.  As long as at least a window is
left, whole windows are cut off; the rest (shorter than a window) goes to the fill
level h that gives the smallest sum of squares of N(h), the numbers of open windows
filled to h, kept in a level array (level 0 opens a window, a full window leaves the
array; ties go to the fullest window).  All levels are compared at once.

At most ``max_open`` windows are open in a task.  When there are more, and at the end
of a task, all open windows are drained: their pieces are cut freely so that full
windows leave, and the last remainder is cut into windows of power-of-two lengths,
which need no padding.

A task packs its own rows, so nothing is shuffled, and a window is closed before its
task ends; a repeated task gives the same rows again.  Null or empty text is the end
id alone; repeated rows are documents of their own; an empty table gives no pieces.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, text_slices
from .tokens import encoder, tokenizer_path

WINDOW = 1024
END_ID = 0
MAX_OPEN = 4_096


class SumOfSquares:
    """Pieces of documents to windows; ``emit`` gets (doc, start, ids, window number, offset)."""

    def __init__(self, window: int, max_open: int, emit):
        self.window, self.max_open, self.emit = window, max_open, emit
        self.level = np.zeros(window, np.int64)     # N(h); N(0) stands for a new window and is 0
        self.held = defaultdict(list)               # open windows by fill level
        self.n_open, self.n_windows = 0, 0

    def choose(self, size: int) -> int:
        """The level that minimises the sum of squares after placing ``size`` there."""
        n, last = self.level, self.window - size     # last: the level that a full window comes from
        best, gain = 0, 2 * int(n[size]) + 1         # a new window
        h = np.flatnonzero(n[1:last]) + 1            # open levels that stay open
        if len(h):
            change = 2 * (n[h + size] - n[h]) + 2
            least = int(change.min())
            if least <= gain:
                best, gain = int(h[np.flatnonzero(change == least)[-1]]), least
        if n[last] and 1 - 2 * int(n[last]) <= gain:
            best = last
        return best

    def add(self, doc, ids: np.ndarray) -> None:
        at, w = 0, self.window
        while len(ids) - at >= w:
            self._close([(doc, at, ids[at:at + w])])
            at += w
        if at == len(ids):
            return
        size = len(ids) - at
        h = self.choose(size)
        if h:
            pieces = self.held[h].pop()
            self.level[h] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append((doc, at, ids[at:]))
        if h + size == w:
            self._close(pieces)
        else:
            self.held[h + size].append(pieces)
            self.level[h + size] += 1
            self.n_open += 1
            if self.n_open > self.max_open:
                self.drain(last=False)

    def _close(self, pieces) -> None:
        offset = 0
        for doc, start, ids in pieces:
            self.emit(doc, start, ids, self.n_windows, offset)
            offset += len(ids)
        self.n_windows += 1

    def drain(self, last: bool = True) -> None:
        """Cut the open windows' pieces into full windows; what is left over stays open,
        or (``last``) leaves in windows of power-of-two lengths."""
        pieces = [p for h in sorted(self.held, reverse=True) for ps in self.held[h] for p in ps]
        self.held.clear()
        self.level[:] = 0
        self.n_open = 0
        pieces.reverse()
        left = sum(len(p[2]) for p in pieces)
        while left >= self.window:
            self._close(self._take(pieces, self.window))
            left -= self.window
        if not left:
            return
        if not last:
            self.held[left].append(pieces[::-1])
            self.level[left] = 1
            self.n_open = 1
            return
        while left:
            size = 1 << (left.bit_length() - 1)
            self._close(self._take(pieces, size))
            left -= size

    @staticmethod
    def _take(pieces, size: int):
        out = []
        while size:
            doc, start, ids = pieces.pop()
            if len(ids) > size:
                pieces.append((doc, start + size, ids[size:]))
                ids = ids[:size]
            out.append((doc, start, ids))
            size -= len(ids)
        return out


def pack(docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = END_ID, window: int = WINDOW,
         max_open: int = MAX_OPEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([
        rows.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        encode, first, out = encoder(tokenizer, kind), TaskContext.get().partitionId() << 36, []

        def emit(doc, start, ids, number, offset):
            out.append((doc[0], start, len(ids), ids.astype("<u4").tobytes(), doc[1], first + number, offset))

        def batch_of(made):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), arrow)], names=arrow.names)

        packer = SumOfSquares(window, max_open, emit)
        end = np.array([end_id])
        for batch in batches:
            numbers = batch.column(0).to_pylist()
            for at, texts in text_slices(batch.column(1)):
                for i, x in enumerate(encode.ids(texts)):
                    ids = np.concatenate([x, end.astype(x.dtype)])
                    packer.add((numbers[at + i], len(ids)), ids)
                if out:
                    yield batch_of(out)
                    out.clear()
        packer.drain()
        if out:
            yield batch_of(out)
        pa.default_memory_pool().release_unused()  # the worker stays for other stages

    return rows.mapInArrow(run, schema)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def q_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4 over whole ``documents``."""
    return digest(pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")))
