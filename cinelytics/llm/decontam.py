"""Benchmark decontamination with one Aho-Corasick automaton.

Normal form: A-Z lower-cased, words of digits, letters a-z and every non-ASCII
character, joined by one space.  The patterns are the items' windows of ``window``
words (an item of fewer words, but not none, is one window); one automaton over
all of them scans each normalised text once and reports every occurrence,
overlapping and nested ones too.  Hits map back to word numbers and to code point
offsets of the original text.

An automaton takes some 32 bytes of memory per character of its windows, so the items are
dealt into blocks whose windows have at most about ``BLOCK_CHARS`` characters (100 MB of
automaton) and a task holds one automaton at a time: with one block it is kept for all
tasks of the worker; with more, a task holds documents of ``HOLD_CHARS`` characters (or one
longer text) and passes them through the blocks' automata in turn.  The items' texts are
broadcast while they have at most ``SEND_BYTES`` bytes; a larger benchmark is dealt into
groups of that size, each a pass of its own over the documents.

Null and empty texts have no words and no hits.  Repeated item rows count once;
an item without an id marks words and is not listed.  Repeated documents are rows
of their own.  An empty benchmark leaves every document clean.
"""

from __future__ import annotations

import itertools
import uuid

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, kept, map_texts, table

WINDOW = 10
BLOCK_CHARS = 3_000_000
HOLD_CHARS = 8_000_000
SEND_BYTES = 64 << 20


def _normal_table() -> bytes:
    keep = set(range(48, 58)) | set(range(97, 123)) | set(range(128, 256))
    return bytes(c + 32 if 65 <= c <= 90 else c if c in keep else 32 for c in range(256))


_NORMAL = _normal_table()
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def item_windows(rows, window: int = WINDOW) -> dict[str, tuple[int, tuple]]:
    """normalised window -> (its number of words, ids of the items that hold it)."""
    found: dict[str, tuple[int, set]] = {}
    for item_id, text in rows:
        words = words_of(text or "")
        if not words:
            continue
        for at in range(max(1, len(words) - window + 1)):
            part = words[at:at + window]
            ids = found.setdefault((b" " + b" ".join(part) + b" ").decode("latin-1"), (len(part), set()))[1]
            if item_id is not None:
                ids.add(item_id)
    return {k: (n, tuple(ids)) for k, (n, ids) in found.items()}


def _automaton(sent: tuple[str, int, list[list]], block: int):
    """The automaton of one block of a broadcast (key, window, blocks of (id, text)); a
    Python worker holds one."""
    key, window, blocks = sent

    def make():
        made = ahocorasick.Automaton()
        windows = item_windows(blocks[block], window)
        for w, value in windows.items():
            made.add_word(w, value)
        if windows:
            made.make_automaton()
        return made

    return kept(("automaton", key, block), make)


def scan_text(text: str, automaton) -> tuple[int, list[tuple[int, int]], set]:
    """(number of words, hit runs of words as [first, last], item ids)."""
    words = words_of(text)
    if not words or not len(automaton):
        return len(words), [], set()
    norm = (b" " + b" ".join(words) + b" ").decode("latin-1")
    hits = list(automaton.iter(norm))
    if not hits:
        return len(words), [], set()
    spaces = np.flatnonzero(np.frombuffer(norm.encode("latin-1"), np.uint8) == 32)
    last = np.searchsorted(spaces, np.array([e for e, _ in hits])) - 1
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, last - np.array([n for _, (n, _) in hits]) + 1, 1)
    np.add.at(marks, last + 1, -1)
    on = np.diff(np.r_[0, np.cumsum(marks[:-1]) > 0, 0].astype(np.int8))
    runs = list(zip(np.flatnonzero(on == 1).tolist(), (np.flatnonzero(on == -1) - 1).tolist()))
    return len(words), runs, set(itertools.chain.from_iterable({v[1] for _, v in hits}))


def code_point_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word runs as [start, end) code point offsets of the original text."""
    raw = text.encode("utf-8", "surrogatepass")
    is_word = np.frombuffer(raw.translate(_NORMAL), np.uint8) != 32
    edge = np.diff(np.r_[0, is_word, 0].astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    before = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
    return [(int(before[starts[a]]), int(before[ends[b]])) for a, b in runs]


def _merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
         item_text: str = "text", keep: list[str] | None = None, window: int = WINDOW,
         block_chars: int = BLOCK_CHARS, send_bytes: int = SEND_BYTES,
         names: tuple[str, str, str, str] = ("n_words", "n_hit", "items", "spans")) -> DataFrame:
    """``keep`` columns (all by default) plus n_words, n_hit, items (ids as sorted
    strings) and spans (code point offsets of the hit passages)."""
    spark = docs.sparkSession
    items = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
    keep = docs.columns if keep is None else keep
    size = items.select(F.sum(F.octet_length("text").cast("long")).alias("s")).first()["s"] or 0
    groups = max(1, -(-size // send_bytes))
    blocks = max(1, -(-size * window // (groups * block_chars)))
    runs, ids = fresh(docs, "runs"), fresh(docs, "ids")
    rows = docs
    for g in range(groups):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(groups)) == g).select(
            "item_id", "text", F.pmod(F.xxhash64("text", F.lit("block")), F.lit(blocks)).alias("b"))
        dealt: list[list] = [[] for _ in range(blocks)]
        for r in part.toLocalIterator():  # at most about send_bytes
            dealt[r["b"]].append((r["item_id"], r["text"]))
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, window, dealt))
        if groups == 1:
            return _one_pass(rows, text_col, sent, blocks, names, keep)
        # a benchmark beyond what is broadcast: each pass is a written table
        rows = cut(_gather(rows, text_col, sent, blocks, runs, ids), "decontam-group")
    fields = _fields(names)

    def make():
        def work(texts, found):
            return _columns([(t, len(words_of(t)), [tuple(r.values()) for r in f["runs"]], f["ids"])
                             for t, f in zip(texts, found)])

        return work

    both = fresh(rows, "found")
    rows = rows.withColumn(both, F.struct(F.col(runs).alias("runs"), F.col(ids).alias("ids")))
    return map_texts(rows, text_col, make, fields, keep, extra=both)


def _scan_all(texts: list[str], sent, blocks: int) -> list[tuple[int, list, set]]:
    """scan_text over every block; the runs of several blocks one after another."""
    automaton = _automaton(sent.value, 0)
    found = [scan_text(t, automaton) for t in texts]
    for block in range(1, blocks):
        automaton = _automaton(sent.value, block)
        for i, t in enumerate(texts):
            n, runs, who = scan_text(t, automaton)
            if runs:
                found[i] = (n, found[i][1] + runs, found[i][2] | who)
    return found


def _fields(names) -> list[T.StructField]:
    return [T.StructField(names[0], T.LongType()), T.StructField(names[1], T.LongType()),
            T.StructField(names[2], T.ArrayType(T.StringType())), T.StructField(names[3], T.ArrayType(SPAN))]


def _columns(found) -> list[list]:
    out = []
    for text, n, runs, ids in found:
        runs = _merge(runs)
        spans = code_point_spans(text, runs) if runs else []
        out.append((n, sum(b - a + 1 for a, b in runs), sorted({str(i) for i in ids}),
                    [{"start": a, "end": b} for a, b in spans]))
    return [list(c) for c in zip(*out)]


def _one_pass(docs: DataFrame, text_col: str, sent, blocks: int, names, keep) -> DataFrame:
    def make():
        return lambda texts: _columns([(t, *f) for t, f in zip(texts, _scan_all(texts, sent, blocks))])

    return map_texts(docs, text_col, make, _fields(names), keep, **_held(blocks))


def _held(blocks: int) -> dict:
    """With several blocks, as many texts at a time as are worth building an automaton for."""
    return {} if blocks == 1 else {"slice_rows": HOLD_CHARS, "slice_chars": HOLD_CHARS}


def _gather(rows: DataFrame, text_col: str, sent, blocks: int, runs: str, ids: str) -> DataFrame:
    """Add one group's hits to the columns ``runs`` and ``ids``."""
    run, who = fresh(rows, "run"), fresh(rows, "who")
    fields = [T.StructField(run, T.ArrayType(SPAN)), T.StructField(who, T.ArrayType(T.StringType()))]

    def make():
        def work(texts):
            found = _scan_all(texts, sent, blocks)
            return [[[{"start": a, "end": b} for a, b in r] for _, r, _ in found],
                    [[str(i) for i in w] for _, _, w in found]]

        return work

    out = map_texts(rows, text_col, make, fields, rows.columns, **_held(blocks))
    if runs in rows.columns:
        return out.withColumns({runs: F.concat(runs, run), ids: F.concat(ids, who)}).drop(run, who)
    return out.withColumnsRenamed({run: runs, who: ids})


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **params) -> DataFrame:
    """The documents without any hit, with all their columns."""
    names = tuple(fresh(docs, x) for x in ("n_words", "n_hit", "items", "spans"))
    return scan(docs, items, text_col, names=names, **params).where(F.col(names[1]) == 0).drop(*names)


def q_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1 over whole ``documents`` and ``benchmark``."""
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH dw AS (
  SELECT doc_id, rid, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT *, row_number() OVER () AS rid FROM documents) d),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[p:p + 9], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM iw WHERE len(w) > 0) t),
sizes AS (SELECT DISTINCT k FROM win),
dgram AS (
  SELECT rid, k, p, array_to_string(w[p:p + k - 1], ' ') AS g
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM dw, sizes WHERE len(w) >= k) t),
hit AS (SELECT d.rid, d.k, d.p, x.item_id FROM dgram d JOIN win x ON x.k = d.k AND x.g = d.g),
words AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(p, p + k)) AS q FROM hit) t GROUP BY rid),
ids AS (SELECT rid, count(*) AS n, string_agg(s, ',' ORDER BY s) AS j
        FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hit WHERE item_id IS NOT NULL) t GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(x.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n, 0) AS BIGINT) AS n_items, sha256(coalesce(i.j, '')) AS items_sha256,
       coalesce(x.n, 0) > 0 AS contaminated
FROM dw d LEFT JOIN words x ON x.rid = d.rid LEFT JOIN ids i ON i.rid = d.rid"""
