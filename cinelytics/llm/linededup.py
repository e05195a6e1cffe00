"""Reversible line deduplication: sharded cuckoo filters over exact reference counts.

Index (three written tables):

* ``refs``    one row (key, doc_id) per document and line key: the exact references;
* ``counts``  one row (key, n_docs, max_doc) per key, from ``refs``;
* ``filters`` one row (shard, filter) per shard of keys: a cuckoo filter of the
  keys found in at least ``min_docs`` documents.

A key is the line without ASCII white space at its ends, A-Z lower-cased, of at
least ``min_chars`` code points, held as a 128-bit BLAKE2 digest.  A document with
n lines gives at most n references, made distinct before any shuffle; counting is
two-phase, so a line that every document holds never meets in one task.

``apply`` tests the references against the filters (fast, no false negatives) and
joins the few survivors to the exact counts, which takes the false positives out.
While the filters are at most ``FILTER_BYTES`` together they all travel to the tasks;
beyond it references and filters meet by shard: a shard's references are split into
parts of about ``PART_REFS`` by a hash of key and document, so a line that every document
holds is many parts, and each part gets its shard's filter only (some 130 kB).

``insert`` and ``delete`` recount only the keys that the change touches, and add or
remove just the keys that cross the threshold in the filters of their shards, so
a deleted document's effect on all other documents is undone.

A line whose key is in ``min_docs`` or more documents is dropped except in the
largest doc_id that holds it.  Null or empty text is one empty line.  A row without
an id is not a document to count and never the one that keeps a line.  Repeated
ids count as one document.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, enter_stage, fresh, map_texts, small_side, table

MIN_CHARS = 20
MIN_DOCS = 3
SHARD_KEYS = 50_000
FILTER_BYTES = 64 << 20
PART_REFS = 200_000
MAX_KICKS = 500
SLOTS = 4

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BLANK = b" \t\n\x0b\x0c\r"


# ------------------------------------------------------------ cuckoo filter --

class CuckooFilter:
    """Partial-key cuckoo filter over 16-byte digests: 16-bit fingerprints, four
    slots a bucket, inserts and deletions; it doubles itself when it is full."""

    def __init__(self, n_buckets: int):
        self.table = np.zeros((n_buckets, SLOTS), np.uint16)

    @classmethod
    def of(cls, keys: np.ndarray) -> "CuckooFilter":
        n = 1
        while n * SLOTS * 0.85 < max(1, len(keys)):
            n *= 2
        while True:
            made = cls(n)
            if all(made._put(int(f), int(b)) for f, b in zip(*made._places(keys))):
                return made
            n *= 2

    def _places(self, keys: np.ndarray):
        """Fingerprint and first bucket of digests given as an (n, 2) uint64 array."""
        return (keys[:, 0] % np.uint64(65535) + np.uint64(1)).astype(np.uint16), keys[:, 1] & np.uint64(len(self.table) - 1)

    def _other(self, f, b):
        """The second bucket; an involution, as the number of buckets is a power of two."""
        mix = (np.asarray(f, np.uint64) * np.uint64(0x5BD1E995)) ^ np.uint64(0x9E37)
        return np.asarray(b, np.uint64) ^ (mix & np.uint64(len(self.table) - 1))

    def _put(self, f: int, b: int) -> bool:
        for place in (b, int(self._other(f, b))):
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = f
                return True
        for kick in range(MAX_KICKS):
            slot = (kick * 7 + f) % SLOTS
            f, self.table[b, slot] = int(self.table[b, slot]), f
            b = int(self._other(f, b))
            free = np.flatnonzero(self.table[b] == 0)
            if len(free):
                self.table[b, free[0]] = f
                return True
        return False

    def insert(self, keys: np.ndarray) -> bool:
        """False when an insertion found no place; the caller then builds a larger one."""
        return all(self._put(int(f), int(b)) for f, b in zip(*self._places(keys)))

    def delete(self, keys: np.ndarray) -> None:
        """Remove keys that were inserted before (one copy of the fingerprint each)."""
        for f, b in zip(*self._places(keys)):
            for place in (int(b), int(self._other(f, b))):
                at = np.flatnonzero(self.table[place] == f)
                if len(at):
                    self.table[place, at[0]] = 0
                    break

    def contains(self, keys: np.ndarray) -> np.ndarray:
        f, b = self._places(keys)
        o = self._other(f, b)
        return (self.table[b.astype(np.int64)] == f[:, None]).any(axis=1) | (
            self.table[o.astype(np.int64)] == f[:, None]).any(axis=1)

    def to_bytes(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> "CuckooFilter":
        made = cls(1)
        made.table = np.frombuffer(raw, "<u2").reshape(-1, SLOTS).copy()
        return made


def _digests(column) -> np.ndarray:
    """An (n, 2) uint64 array of a column of 16-byte values."""
    return np.frombuffer(b"".join(column), "<u8").reshape(-1, 2)


def line_key(line: bytes, min_chars: int) -> bytes | None:
    key = line.strip(_BLANK).translate(_LOWER)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "surrogatepass")) < min_chars):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


# -------------------------------------------------------------------- index --

@dataclass
class LineIndex:
    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    n_shards: int
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS


def references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, doc_id): the distinct line keys of each row that has an id."""
    def make():
        def work(texts):
            return [[list({k for k in (line_key(x, min_chars) for x in set(t.encode("utf-8", "surrogatepass").split(b"\n")))
                           if k is not None}) for t in texts]]

        return work

    ids = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("doc_id IS NOT NULL")
    rows = map_texts(ids, "text", make, [T.StructField("keys", T.ArrayType(T.BinaryType()))], ["doc_id"])
    return rows.select(F.explode("keys").alias("key"), "doc_id")


def _count(refs: DataFrame) -> DataFrame:
    """Exact counts per key; ``refs`` are distinct (key, document) pairs."""
    return refs.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))


def _shard(n_shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(n_shards))


def _frequent(counts: DataFrame, min_docs: int) -> DataFrame:
    return counts.where(F.col("n_docs") >= min_docs)


def _build_filters(frequent: DataFrame, n_shards: int) -> DataFrame:
    """One filter per shard; a shard holds about SHARD_KEYS keys."""
    def build(shard, rows):
        made = CuckooFilter.of(_digests(rows.column("key").to_pylist()))
        return pa.table({"shard": [shard[0].as_py()], "filter": [made.to_bytes()]})

    return frequent.select("key", _shard(n_shards).alias("shard")).groupBy("shard").applyInArrow(
        build, "shard long, filter binary")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS) -> LineIndex:
    refs = cut(references(docs, id_col, text_col, min_chars).distinct(), "lines-refs")
    counts = cut(_count(refs), "lines-counts")
    frequent = _frequent(counts, min_docs)
    n_shards = max(1, -(-frequent.count() // shard_keys))
    return LineIndex(refs, counts, cut(_build_filters(frequent, n_shards), "lines-filters"), n_shards, min_chars, min_docs)


def _changed(index: LineIndex, refs: DataFrame, touched: DataFrame) -> LineIndex:
    """The index over ``refs`` when only the counts of ``touched`` keys can differ."""
    old = index.counts.join(touched, "key", "left_semi")
    new = cut(_count(refs.join(touched, "key", "left_semi")), "lines-recount")
    counts = cut(index.counts.join(touched, "key", "left_anti").unionByName(new), "lines-counts")
    was, now = _frequent(old, index.min_docs).select("key"), _frequent(new, index.min_docs).select("key")
    delta = now.join(was, "key", "left_anti").select("key", F.lit(True).alias("put")).union(
        was.join(now, "key", "left_anti").select("key", F.lit(False).alias("put")))
    delta = cut(delta.select("key", "put", _shard(index.n_shards).alias("shard")), "lines-delta")
    frequent = _frequent(counts, index.min_docs).select("key", _shard(index.n_shards).alias("shard"))

    def update(key, rows, held):
        keys, put = rows.column("key").to_pylist(), np.array(rows.column("put").to_pylist(), bool)
        raw = held.column("filter").to_pylist()
        made = CuckooFilter.from_bytes(raw[0]) if raw else CuckooFilter.of(np.zeros((0, 2), np.uint64))
        d = _digests(keys) if keys else np.zeros((0, 2), np.uint64)
        made.delete(d[~put])
        full = not made.insert(d[put])
        return pa.table({"shard": [key[0].as_py()], "filter": [None if full else made.to_bytes()]},
                        schema=pa.schema([("shard", pa.int64()), ("filter", pa.binary())]))

    filters = cut(delta.groupBy("shard").cogroup(index.filters.groupBy("shard")).applyInArrow(
        update, "shard long, filter binary"), "lines-filters-new")
    full = filters.where("filter IS NULL").select("shard")
    again = _build_filters(frequent.join(full, "shard", "left_semi"), index.n_shards)
    filters = cut(filters.where("filter IS NOT NULL").unionByName(again), "lines-filters")
    return LineIndex(refs, counts, filters, index.n_shards, index.min_chars, index.min_docs)


def insert(index: LineIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
    """The index with the references of ``docs`` added (a document may be given again)."""
    more = cut(references(docs, id_col, text_col, index.min_chars), "lines-more")
    refs = cut(index.refs.unionByName(more).distinct(), "lines-refs")
    return _changed(index, refs, more.select("key").distinct())


def delete(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """The index without the documents of ``doc_ids`` (one column of ids)."""
    ids = doc_ids.select(F.col(f"`{doc_ids.columns[0]}`").alias("doc_id")).distinct()
    gone = index.refs.join(ids, "doc_id", "left_semi").select("key").distinct()
    touched = cut(gone, "lines-touched")
    refs = cut(index.refs.join(ids, "doc_id", "left_anti").select("key", "doc_id"), "lines-refs")
    return _changed(index, refs, touched)


def _passing(table: pa.Table | pa.RecordBatch, held: CuckooFilter):
    """Rows whose key, the first column, passes the filter."""
    return table.filter(pa.array(held.contains(_digests(table.column(0).to_pylist()))))


def _maybe_frequent(refs: DataFrame, index: LineIndex, filter_bytes: int) -> DataFrame:
    """The references that pass their shard's filter."""
    size = index.filters.agg(F.sum(F.octet_length("filter").cast("long"))).first()[0] or 0
    schema = T.StructType([T.StructField("key", T.BinaryType()), refs.schema["doc_id"]])
    tagged = refs.select("key", "doc_id", _shard(index.n_shards).alias("shard"))
    if size > filter_bytes:
        return _by_shard(tagged, index, schema)
    sent = refs.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in index.filters.collect()})

    def run(batches):
        enter_stage()
        filters = {k: CuckooFilter.from_bytes(v) for k, v in sent.value.items()}
        for batch in batches:
            shards = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), np.int64)
            for s in np.unique(shards):
                if int(s) in filters:
                    yield _passing(batch.select([0, 1]).filter(pa.array(shards == s)), filters[int(s)])

    return tagged.mapInArrow(run, schema)


def _by_shard(tagged: DataFrame, index: LineIndex, schema: T.StructType) -> DataFrame:
    """Parts of a shard's references beside a copy of its filter; nothing travels whole."""
    loads = cut(tagged.groupBy("shard").agg(F.count("*").alias("n")).select(
        "shard", F.ceil(F.col("n") / PART_REFS).cast("int").alias("parts")), "lines-loads")
    near = small_side(loads, F.lit(64))  # a row per shard, that is per SHARD_KEYS keys
    parts = tagged.join(near, "shard").select(
        "key", "doc_id", "shard", F.pmod(F.xxhash64("key", "doc_id"), F.col("parts")).alias("part"))
    copies = index.filters.join(loads, "shard").select(
        "filter", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"))

    def test(_, rows, held):
        raw = held.column("filter").to_pylist()
        rows = rows.select(["key", "doc_id"])
        return _passing(rows, CuckooFilter.from_bytes(raw[0])) if raw and rows.num_rows else rows.slice(0, 0)

    return parts.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(test, schema)


def dropped_keys(index: LineIndex, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(doc_id, keys): the keys whose lines the document loses."""
    frequent = _frequent(index.counts, index.min_docs).select("key", "max_doc")
    hits = _maybe_frequent(index.refs, index, filter_bytes).join(frequent, "key").where("doc_id <> max_doc")
    return hits.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def apply(index: LineIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          names: tuple[str, str, str] = ("n_lines", "n_dropped", "kept"), keep: list[str] | None = None,
          filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``keep`` columns (all by default) plus n_lines (before), n_dropped and the kept text."""
    min_chars = index.min_chars
    drops = cut(dropped_keys(index, filter_bytes), "lines-drops")
    keys, key = fresh(docs, "keys"), fresh(docs, "id")
    # the texts stay where they are while the keys to drop are few
    drops = small_side(drops, 64 + 48 * F.size("keys"))
    joined = docs.join(drops.select(F.col("doc_id").alias(key), F.col("keys").alias(keys)),
                       docs[f"`{id_col}`"] == F.col(key), "left")
    # a row without an id loses every frequent line: no document keeps lines through it
    if not docs.where(F.col(f"`{id_col}`").isNull()).isEmpty():
        joined = _without_id(index, docs, id_col, text_col, keys, key, joined)

    def make():
        def work(texts, dropped):
            out = []
            for t, gone in zip(texts, dropped):
                lines = t.encode("utf-8", "surrogatepass").split(b"\n")
                if gone:
                    gone = set(gone)
                    left = [x for x in lines if line_key(x, min_chars) not in gone]
                    t = b"\n".join(left).decode("utf-8", "surrogatepass")
                    out.append((len(lines), len(lines) - len(left), t))
                else:
                    out.append((len(lines), 0, t))
            return [list(c) for c in zip(*out)]

        return work

    fields = [T.StructField(names[0], T.LongType()), T.StructField(names[1], T.LongType()),
              T.StructField(names[2], T.StringType())]
    return map_texts(joined, text_col, make, fields, docs.columns if keep is None else keep, extra=keys)


def _without_id(index, docs, id_col, text_col, keys, key, joined):
    """Rows without an id get the frequent keys among their own lines."""
    row = fresh(docs, "row")
    none = cut(docs.where(F.col(f"`{id_col}`").isNull()).withColumn(row, F.monotonically_increasing_id()), "lines-noid")
    refs = references(none.select(F.col(row).alias("doc_id"), F.col(f"`{text_col}`").alias("text")), min_chars=index.min_chars)
    gone = refs.join(_frequent(index.counts, index.min_docs).select("key"), "key").groupBy("doc_id").agg(
        F.collect_set("key").alias(keys)).withColumnRenamed("doc_id", key)
    none = none.join(gone, none[row] == gone[key], "left").drop(row)
    named = joined.where(F.col(f"`{id_col}`").isNotNull())
    return named.unionByName(none.withColumn(key, F.lit(None).cast(named.schema[key].dataType)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_chars",
                **params) -> DataFrame:
    """The documents with their text after line dedup; all other columns stay, but
    ``count_col`` (if there is one) becomes the new text's number of characters."""
    names = tuple(fresh(docs, x) for x in ("lines", "dropped", "kept"))
    out = apply(build_index(docs, id_col, text_col, **params), docs, id_col, text_col, names)
    text = F.when(F.col(names[1]) > 0, F.col(names[2])).otherwise(F.col(f"`{text_col}`"))
    size = {count_col: F.when(F.col(names[1]) > 0, F.length(names[2])).otherwise(F.col(f"`{count_col}`"))
            .cast(docs.schema[count_col].dataType)} if count_col in docs.columns else {}
    return out.withColumns({text_col: text} | size).select(*[F.col(f"`{c}`") for c in docs.columns])


def q_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10 over whole ``documents``."""
    docs = table(spark, sf_dir, "documents")
    out = apply(build_index(docs), docs, keep=["doc_id"])
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT rid, doc_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS pos
  FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) t),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS m FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT min(k.doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (g.key IS NOT NULL AND g.m IS DISTINCT FROM k.doc_id) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos)
              FILTER (g.key IS NULL OR g.m IS NOT DISTINCT FROM k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN g ON g.key = k.key GROUP BY k.rid"""
