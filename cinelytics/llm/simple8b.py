"""Token-id files in Simple-8b word-aligned coding.

A 64-bit word holds a 4-bit selector (highest bits) and 60 data bits: selector s
packs ``COUNTS[s]`` ids of ``60 // COUNTS[s]`` bits each, lowest bits first.  An id
of more than 60 bits is an escape: selector 0 and the id's index in the segment's
list of escapes.  Ids are coded in blocks of ``BLOCK`` ids; a block starts on a word
of its own, whose number is in ``offsets``, so blocks decode independently, and all
words of a segment decode at once by selector with numpy.

File format (Parquet rows, one per segment, in ascending order): ``part``, ``seq``,
``start`` (ids of the part before the segment), ``n_ids``, ``doc_ids``, ``lengths``
(ids per document), ``words`` (little-endian 64-bit), ``offsets`` (one per block),
``escapes`` (little-endian 64-bit).  Parts are ranges of doc_id in ascending order;
a segment holds whole documents, so a reader can take any segment alone.

Documents lie in ascending doc_id order (null ids first; repeated ids side by side,
ordered by a hash of their ids, so that a much repeated doc_id is split over parts too).
doc_id has to be a whole number; a text that isn't one fails in the cast.  Null or empty
text is the end id alone.  An empty table gives files without rows.

Texts are encoded where they lie, and only their ids move.  The bounds of the parts are
quantiles of the ids of all documents, found before (a range partitioner would read, and
encode, its whole input twice).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .common import SLICE_CHARS, table, text_slices
from .tokens import encoder, tokenizer_path

COUNTS = (1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)  # by selector; 0 is the escape
BLOCK = 512
END_ID = 1
SEGMENT_IDS = 400_000
PARTS_PER_TASK = 4
MAX_PARTS = 50_000  # of the driver's list of bounds; parts are streamed, so their size is free

SEGMENT = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("start", T.LongType()),
    T.StructField("n_ids", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("words", T.BinaryType()),
    T.StructField("offsets", T.BinaryType()), T.StructField("escapes", T.BinaryType())])


# -------------------------------------------------------------------- codec --

_BIT_LENGTH = np.array([x.bit_length() for x in range(1 << 16)], np.uint8)


def _selectors(ids: np.ndarray, n_blocks: int) -> np.ndarray:
    """For every position of the padded ids, the selector of the word that starts there:
    the one that packs most ids; a word may reach past its block's end into padding."""
    bits = np.zeros(len(ids), np.uint8)
    if ids.dtype == np.uint16:
        bits = _BIT_LENGTH[ids]
    else:
        for k in range(64):
            bits += (ids >> np.uint64(k) > 0)
    grid = np.zeros((n_blocks, BLOCK + 60), np.uint8)  # zeros after each block: padding fits any width
    grid[:, :BLOCK] = bits.reshape(n_blocks, BLOCK)
    chosen = np.where(grid[:, :BLOCK] > 60, 0, len(COUNTS) - 1).astype(np.uint8)
    # most ids per word last, so the widest reach wins
    widest, reach = grid.copy(), 1
    for selector in range(len(COUNTS) - 2, 0, -1):
        n = COUNTS[selector]
        while reach < n:  # widest[p] becomes the largest width of the next n ids
            step = min(reach, n - reach)
            widest[:, :-step] = np.maximum(widest[:, :-step], widest[:, step:])
            reach += step
        fits = widest[:, :BLOCK] <= 60 // n
        if not fits.any():
            break
        chosen[fits] = selector
    return chosen


def encode_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, word number of each block, escapes)."""
    n = len(ids)
    n_blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    narrow = np.uint16 if ids.dtype.itemsize <= 2 or ids.max() < 1 << 16 else np.uint64
    padded = np.zeros(n_blocks * BLOCK, narrow)
    padded[:n] = ids
    chosen = _selectors(padded, n_blocks)
    # walk all blocks in step: the k-th word of every block that has one
    length = np.full(n_blocks, BLOCK)
    length[-1] = n - (n_blocks - 1) * BLOCK
    counts, at, live = np.array(COUNTS), np.zeros(n_blocks, np.int64), np.arange(n_blocks)
    begins = np.zeros(n, bool)
    while len(live):
        here = at[live]
        begins[live * BLOCK + here] = True
        at[live] = here + counts[chosen[live, here]]
        live = live[at[live] < length[live]]
    first = np.flatnonzero(begins)                     # the first id of every word, in order
    block = first // BLOCK
    selector = chosen[block, first - block * BLOCK]
    taken = np.diff(np.r_[first, n])                   # ids of each word; less than its count at a block's end
    values, width = padded[:n].astype(np.uint64), (60 // counts)[selector].astype(np.uint8)
    escaped = np.flatnonzero(selector == 0)
    escapes = values[first[escaped]].copy()
    values[first[escaped]] = np.arange(len(escaped), dtype=np.uint64)
    # the shift of a word's k-th id, at most 59 bits
    shift = np.zeros(n, np.uint8)
    for k in range(1, int(taken.max())):
        live = taken > k
        shift[first[live] + k] = k * width[live]
    words = np.bitwise_or.reduceat(values << shift, first)
    words |= selector.astype(np.uint64) << np.uint64(60)
    return words, np.searchsorted(block, np.arange(n_blocks)).astype(np.uint32), escapes


def decode_ids(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """All ids of a segment (or of any run of its blocks) by one pass per selector."""
    if not n:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array(COUNTS)[selector]
    before = np.cumsum(counts) - counts
    starts = offsets.astype(np.int64)
    block = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(words)]))
    first = before - before[starts][block] + block * BLOCK   # a block's words may end in padding
    taken = np.minimum(counts, np.minimum((block + 1) * BLOCK, n) - first)
    width = (60 // np.array(COUNTS))[selector].astype(np.uint64)
    data = words & np.uint64((1 << 60) - 1)
    escaped = np.flatnonzero(selector == 0)
    slot = (np.arange(n) - np.repeat(first, taken)).astype(np.uint64)
    width = np.repeat(width, taken)
    out = (np.repeat(data, taken) >> (slot * width)) & ((np.uint64(1) << width) - np.uint64(1))
    out[first[escaped]] = escapes[data[escaped].astype(np.int64)]
    return out


# -------------------------------------------------------------------- files --

def _bounds(rows: DataFrame) -> np.ndarray:
    """Quantiles of doc_id that cut the documents into parts, some of them per shuffle task,
    as a part goes to a task by hash."""
    parts = min(MAX_PARTS, PARTS_PER_TASK * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = rows.where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)
    return np.array([int(x) for x in found or []], np.int64)


def _part(bounds: np.ndarray, doc_ids: pa.Array, raws: list[bytes]) -> np.ndarray:
    """Parts ascend with doc_id (null first); an id that takes up several quantiles is
    dealt to the parts between them by a hash of its ids."""
    ids = doc_ids.fill_null(0).to_numpy(zero_copy_only=False)
    below = np.searchsorted(bounds, ids, "left")
    equal = np.searchsorted(bounds, ids, "right") - below
    for i in np.flatnonzero(equal > 1):
        below[i] += xxhash.xxh64_intdigest(raws[i]) % int(equal[i])
    below[np.asarray(doc_ids.is_null())] = 0
    return below


def write_ids(docs: DataFrame, path: str, tokenizer: str, kind: str = "word", end_id: int = END_ID,
              id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts and write them in ascending id order."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def encode_texts(batches):
        encode = encoder(tokenizer, kind)
        end = np.array([end_id], encode.dtype).tobytes()
        for batch in batches:
            for at, texts in text_slices(batch.column(1)):
                raws = [x.tobytes() + end for x in encode.ids(texts)]
                here = batch.column(0).slice(at, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [here, pa.array([len(r) // encode.dtype().itemsize for r in raws], pa.int64()), pa.array(raws, pa.binary()),
                     pa.array(_part(bounds, here, raws), pa.int32())], names=["doc_id", "n", "ids", "part"])

    bounds = _bounds(rows)
    coded = rows.mapInArrow(encode_texts, "doc_id long, n long, ids binary, part int").withColumn("h", F.xxhash64("ids"))
    coded = coded.repartition("part").sortWithinPartitions("part", "doc_id", "h").select("doc_id", "n", "ids", "part")
    schema = SEGMENT

    def run(batches):
        part, seq, start, total = None, 0, 0, 0
        numbers, lengths, held = [], [], []

        def segment():
            nonlocal seq, start, total, numbers, lengths, held
            raw, size = b"".join(held), sum(lengths)
            flat = np.frombuffer(raw, np.dtype(f"<u{len(raw) // size}"))
            words, offsets, escapes = encode_ids(flat)
            row = [[part], [seq], [start], [size], [numbers], [lengths], [words.astype("<u8").tobytes()],
                   [offsets.astype("<u4").tobytes()], [escapes.astype("<u8").tobytes()]]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()),
                     pa.binary(), pa.binary(), pa.binary()]
            seq, start, total = seq + 1, start + size, 0
            numbers, lengths, held = [], [], []
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=schema.names)

        for batch in batches:
            for doc_id, n, ids, here in zip(*[c.to_pylist() for c in batch.columns]):
                if here != part:
                    if held:
                        yield segment()
                    part, seq, start = here, 0, 0
                numbers.append(doc_id)
                lengths.append(n)
                held.append(ids)
                total += n
                if total >= SEGMENT_IDS:
                    yield segment()
        if held:
            yield segment()

    coded.mapInArrow(run, schema).write.mode("overwrite").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian
    unsigned 32-bit), decoded from the files; one row of totals per part is all that is summed."""
    segments = spark.read.schema(SEGMENT).parquet(path)
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # one row per part
    before, at = {}, 0
    for r in sorted(totals, key=lambda r: r["part"]):
        before[r["part"]], at = at, at + r["n"]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n_ids"]
                flat = decode_ids(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["offsets"], "<u4"),
                                  np.frombuffer(row["escapes"], "<u8"), n).astype("<u4")
                ends = np.cumsum(row["lengths"])
                starts = ends - np.array(row["lengths"])
                raw, base = flat.tobytes(), before[row["part"]] + row["start"]
                step = max(1, len(starts) * SLICE_CHARS // max(len(raw), 1))
                for i in range(0, len(starts), step):  # a few MB a batch
                    s, e = starts[i:i + step], ends[i:i + step]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row["doc_ids"][i:i + step], pa.int64()), pa.array(base + s, pa.int64()),
                         pa.array(e - s, pa.int64()),
                         pa.array([raw[4 * a:4 * b] for a, b in zip(s.tolist(), e.tolist())], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"])

    return segments.select("part", "start", "n_ids", "doc_ids", "lengths", "words", "offsets", "escapes").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids binary")


def q_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2 over whole ``documents``: written, read back, digested."""
    path = scratch_path(spark, "token-files")
    write_ids(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
