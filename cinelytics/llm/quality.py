"""Quality rules by repetition coverage.

Words are runs without ASCII white space.  For every n-gram length the text's word
n-grams get 64-bit polynomial rolling hashes (one numpy pass extends length n to
n + 1), sorting finds the n-grams that occurred before, and a difference array marks
the words inside them, so overlaps count once.  A rule holds the share of the text's
word characters inside n-grams (or lines) that repeat an earlier one; the first
occurrence is no repetition.  Limits follow the published rules of Gopher
(Rae et al. 2021): 15 % for 5-grams, 13 % for 7-grams, 10 % for 10-grams, 20 % for lines.

Null and empty texts have no words and fail the base rule (too short).  Lines
without a word repeat nothing.  Every row is judged alone: repeated rows get equal
verdicts, and nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, table

GRAM_LIMITS = {5: 15, 7: 13, 10: 10}  # percent of word characters in repeated n-grams
LINE_LIMIT = 20
MIN_WORDS = 50
MAX_REPEAT_WORDS = 50
_SYMBOLS = b"#*$%&|<>"
_BLANK = b" \t\n\x0b\x0c\r"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64: a fixed pseudo-random 64-bit number for each word number."""
    x = (x.astype(np.uint64) + np.uint64(1)) * _STEP
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _covered(n_words: int, starts: np.ndarray, n: int) -> np.ndarray:
    """Mask of the words inside n-grams at ``starts``."""
    marks = np.zeros(n_words + 1, np.int32)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + n, -1)
    return np.cumsum(marks[:-1]) > 0


def repeated(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions whose value occurred before, positions whose value occurs twice or more)."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    later = order[1:][same]
    return later, np.union1d(later, order[:-1][same])


def measure(text: str, gram_lengths=tuple(GRAM_LIMITS)) -> dict:
    """All counts of one whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    out = {"n_words": 0, "word_chars": 0, "n_symbols": len(raw) - len(raw.translate(None, _SYMBOLS)),
           "n_dup_lines": 0, "dup_line_chars": 0, "n_repeat_words": 0, "gram_chars": [0] * len(gram_lengths)}
    words = raw.split()
    if not words:
        return out
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    point = np.array([len(w) if w.isascii() else len(w.decode("utf-8", "surrogatepass")) for w in numbers], np.int64)
    sizes = point[ids]
    out["n_words"], out["word_chars"] = len(words), int(sizes.sum())
    seen: set[bytes] = set()
    for line in raw.split(b"\n"):
        if line in seen:
            out["n_dup_lines"] += 1
            out["dup_line_chars"] += sum(int(point[numbers[w]]) for w in line.split())
        elif line.strip(_BLANK):
            seen.add(line)
    value = _mix(ids)
    rolling = value.copy()
    for n in range(2, max(gram_lengths) + 1):
        if len(words) < n:
            break
        rolling = rolling[:-1] * _STEP + value[n - 1:]
        if n == 3 or n in gram_lengths:
            later, both = repeated(rolling)
            if n == 3:
                if not len(later):
                    break  # no 3-gram repeats, so no longer one does
                out["n_repeat_words"] = int(_covered(len(words), both, 3).sum())
            if n in gram_lengths and len(later):
                out["gram_chars"][gram_lengths.index(n)] = int(sizes[_covered(len(words), later, n)].sum())
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram_limits: dict | None = None,
          line_limit: int = LINE_LIMIT) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the characters behind the verdict."""
    limits = dict(sorted((gram_limits or GRAM_LIMITS).items()))
    lengths = tuple(limits)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars"]
    fields = [T.StructField(n, T.LongType()) for n in names] + [T.StructField("gram_chars", T.ArrayType(T.LongType()))]

    def make():
        def work(texts):
            found = [measure(t, lengths) for t in texts]
            return [[f[n] for f in found] for n in [*names, "gram_chars"]]

        return work

    ids = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out = map_texts(ids, "text", make, fields, ["doc_id"])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_WORDS * F.col("n_words"))
    good = 100 * F.col("dup_line_chars") <= line_limit * F.col("word_chars")
    for i, limit in enumerate(limits.values()):
        good = good & (100 * F.get("gram_chars", F.lit(i)) <= limit * F.col("word_chars"))
        out = out.withColumn(f"dup_{lengths[i]}gram_chars", F.get("gram_chars", F.lit(i)))
    return out.withColumns({"base_failed": failed, "kept": ~failed & good}).drop("gram_chars")


def q_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5 over whole ``documents``."""
    return score(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "dup_line_chars", *[f"dup_{n}gram_chars" for n in GRAM_LIMITS])


def _gram_sql(n: int) -> str:
    return f"""g{n} AS (
  SELECT rid, p, row_number() OVER (PARTITION BY rid, g ORDER BY p) AS o, count(*) OVER (PARTITION BY rid, g) AS c
  FROM (SELECT rid, p, array_to_string(w[p:p + {n - 1}], ' ') AS g
        FROM (SELECT rid, w, unnest(range(1, len(w) - {n - 2})) AS p FROM d WHERE len(w) >= {n}) t) u)"""


def _cover_sql(n: int, which: str, value: str) -> str:
    return (f"SELECT rid, {value} AS x FROM (SELECT DISTINCT rid, unnest(range(p, p + {n})) AS q FROM g{n} WHERE {which}) c "
            f"JOIN d USING (rid) GROUP BY rid")


_W = "[^\\x20\\x09-\\x0D]+"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents),
lines AS (SELECT rid, line, pos, row_number() OVER (PARTITION BY rid, line ORDER BY pos) AS o
          FROM (SELECT rid, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS pos
                FROM (SELECT rid, string_split(text, chr(10)) AS parts FROM d) t) u
          WHERE regexp_matches(line, '{_W}')),
dl AS (SELECT rid, count(*) AS n, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g'))) AS ch
       FROM lines WHERE o > 1 GROUP BY rid),
{_gram_sql(3)}, {", ".join(_gram_sql(n) for n in GRAM_LIMITS)},
r3 AS ({_cover_sql(3, "c > 1", "count(*)")}),
{", ".join(f"r{n} AS ({_cover_sql(n, 'o > 1', 'sum(length(w[q]))')})" for n in GRAM_LIMITS)},
a AS (SELECT d.rid, d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(dl.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r3.x, 0) AS BIGINT) AS n_repeat_words,
        CAST(coalesce(dl.ch, 0) AS BIGINT) AS dup_line_chars,
        {", ".join(f"CAST(coalesce(r{n}.x, 0) AS BIGINT) AS dup_{n}gram_chars" for n in GRAM_LIMITS)}
      FROM d LEFT JOIN dl USING (rid) LEFT JOIN r3 USING (rid) {" ".join(f"LEFT JOIN r{n} USING (rid)" for n in GRAM_LIMITS)}),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_WORDS} * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * dup_line_chars <= {LINE_LIMIT} * word_chars
         AND {" AND ".join(f"100 * dup_{n}gram_chars <= {x} * word_chars" for n, x in GRAM_LIMITS.items())} AS kept,
       dup_line_chars, {", ".join(f"dup_{n}gram_chars" for n in GRAM_LIMITS)}
FROM b"""
