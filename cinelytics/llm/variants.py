"""Spelling variants: words one edit apart, by PartEnum signatures.

Words are the letter runs of whole texts with A-Z lower-cased, of at least ``min_length``
code points and ``min_count`` occurrences.  Two words are near if one inserted, deleted or
replaced code point makes them equal.

Search (Arasu, Ganti, Kaushik: "Efficient exact set-similarity joins").  A word's letters
with their occurrence numbers are a binary vector: one edit changes at most two of its
bits.  The bits are dealt to ``PARTS`` parts by hash; for every two parts left out, the
letters in the other parts are a signature.  Two differing bits lie in at most two parts,
so near words agree in some signature.  An edit lies in the first or in the second half of
the word, so near words also agree in the other half of the shorter one; that half and the
shorter one's length go into the signature, which keeps anagrams and small vocabularies
apart.  An equi-join of the signatures gives candidates, ``levenshtein`` checks each.

A signature shared by more than ``hot`` words is not joined: these words give every text
that lacks one of their letters, with its place, and are joined by that.  Words that agree
there are near (or one is the other without that letter), so no candidate is made in vain
and the rows grow with the words, not with their square.

A word's form is its near word of the largest count (ties: the smallest in code-point
order) if that is at least twice its own; ``root`` follows forms to the end.  Counts at
least double at each step, so there are no circles; the steps are doubled by a self-join.

Null texts have no words; a null id counts as the empty string in ``damage``; repeated rows
count again; an empty table gives no words.  Extra columns are not read.  All of it is
Spark expressions; words meet in partial counts first, so a hot word is one row a task.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .repair import SQL_CRC_TABLE, sql_crc

RUN = "[A-Za-zÀ-ÿ]+"
MIN_LENGTH = 5
MIN_COUNT = 3
PARTS = 4
HOT = 256
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (as text), word: every letter run with A-Z lower-cased."""
    found = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("doc_id"),
                        F.explode(F.regexp_extract_all(F.col(f"`{text_col}`").cast("string"), F.lit(RUN), F.lit(0))).alias("word"))
    return found.select("doc_id", F.translate("word", _UPPER, _LOWER).alias("word"))


def without(word: Column, at: Column) -> Column:
    """``word`` less its code point at ``at`` (from 0)."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def damage(words: DataFrame, every: int = 97) -> DataFrame:
    """The test damage: where ``every`` divides crc32("doc_id:word"), one code point goes."""
    h = F.crc32(F.concat("doc_id", F.lit(":"), "word").cast("binary"))
    rows = words.select("word", h.alias("h"))
    at = (F.col("h") % F.length("word")).cast("int")
    return rows.select(F.when(F.col("h") % every == 0, without(F.col("word"), at)).otherwise(F.col("word")).alias("word"))


def count_words(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n"""
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _signatures(vocabulary: DataFrame, parts: int) -> DataFrame:
    """word, n, longer, key: the signatures of each word as the shorter (or equal) and as the longer one."""
    letters = F.array_sort(F.split("word", "(?<=.)(?=.)"))
    rows = vocabulary.withColumn("letters", letters)
    numbered = F.transform("letters", lambda x, i: F.struct(x.alias("x"), (i - F.array_position("letters", x) + 1).alias("k")))
    dealt = F.transform(numbered, lambda b: F.struct(b["x"].alias("x"), F.pmod(F.xxhash64(b["x"], b["k"]), F.lit(parts)).alias("p")))
    rows = rows.withColumn("dealt", dealt)

    def part(p):
        return F.array_join(F.transform(F.filter("dealt", lambda b: b["p"] == p), lambda b: b["x"]), "")

    kept = [part(p) for p in range(parts)]
    rows = rows.select("word", "n", F.array(*kept).alias("kept"))
    bits = [F.struct(F.lit(i).alias("i"), F.xxhash64(F.lit(i), *[F.get("kept", F.lit(p)) for p in range(parts) if p not in out]).alias("s"))
            for i, out in enumerate(combinations(range(parts), 2))]
    rows = rows.select("word", "n", F.array(*bits).alias("bits"))
    half = lambda d: F.floor((F.length("word") - d) / 2).cast("int")
    sides = [F.struct(F.lit(d == 1).alias("longer"), F.xxhash64(F.length("word") - d, F.lit(side), text).alias("s"))
             for d in (0, 1) for side, text in (("first", F.substring("word", F.lit(1), half(d))), ("last", F.right("word", half(d))))]
    rows = rows.select("word", "n", "bits", F.explode(F.array(*sides)).alias("side"))
    return rows.select("word", "n", F.col("side.longer").alias("longer"), F.explode("bits").alias("b"), "side.s").select(
        "word", "n", "longer", F.xxhash64("s", "b.s").alias("key"))


def _lacking(words: DataFrame) -> DataFrame:
    """word, n, longer, key: each word as it is at every place (not longer) and without the letter there (longer)."""
    places = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("at"))
    return places.select("word", "n", "at", F.when(F.col("at") < F.length("word"), without(F.col("word"), F.col("at"))).alias("less"))


def near_words(vocabulary: DataFrame, parts: int = PARTS, hot: int = HOT) -> DataFrame:
    """a, n_a, b, n_b: each pair of near words once; a is the shorter or, at equal length, the smaller one."""
    rows = cut(_signatures(vocabulary, parts), "variants-signatures")
    busy = cut(rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").selectExpr("key AS k2", f"c > {hot} AS busy"), "variants-busy")
    rows = rows.join(busy, F.col("key") == F.col("k2"))
    calm = rows.where("NOT busy").select("word", "n", "longer", "key")
    left = calm.where("NOT longer").selectExpr("word AS a", "n AS n_a", "key")
    right = calm.selectExpr("word AS b", "n AS n_b", "longer", "key AS k2")
    pairs = left.join(right, (F.col("key") == F.col("k2")) & (F.col("longer") | (F.col("a") < F.col("b"))))
    found = pairs.where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b")
    crowded = cut(rows.where("busy").select("word", "n").distinct(), "variants-crowded")
    places = _lacking(crowded).where("less IS NOT NULL")
    gap = F.xxhash64("at", "less")
    swap = places.selectExpr("word AS a", "n AS n_a", "less", "at").withColumn("key", gap).join(
        places.selectExpr("word AS b", "n AS n_b", "less AS less2", "at AS at2").withColumn("k2", F.xxhash64("at2", "less2")),
        (F.col("key") == F.col("k2")) & (F.col("a") < F.col("b")) & (F.col("less") == F.col("less2")) & (F.col("at") == F.col("at2")))
    lack = crowded.selectExpr("word AS a", "n AS n_a").join(
        places.selectExpr("word AS b", "n AS n_b", "less"), F.col("a") == F.col("less"))
    cols = ("a", "n_a", "b", "n_b")
    return found.unionByName(swap.select(*cols)).unionByName(lack.select(*cols)).distinct()


def group_variants(vocabulary: DataFrame, parts: int = PARTS, hot: int = HOT) -> DataFrame:
    """word, form, root, n, n_near, form_n for a vocabulary (word, n)."""
    vocabulary = cut(vocabulary, "variants-words")
    pairs = cut(near_words(vocabulary, parts, hot), "variants-pairs")
    both = pairs.selectExpr("a AS word", "b AS other", "n_b AS m").union(pairs.selectExpr("b", "a", "n_a"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("w"))).alias("best"))
    rows = vocabulary.join(best.withColumnRenamed("word", "w2"), F.col("word") == F.col("w2"), "left")
    fits = -F.col("best.m") >= 2 * F.col("n")
    rows = cut(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                           F.when(fits, F.col("best.w")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n")), "variants-forms")
    # roots: every round doubles the steps followed; a word without a form is its own root
    steps = rows.where("form IS NOT NULL").selectExpr("word AS w", "form AS root")
    while True:
        ahead = steps.selectExpr("w AS w2", "root AS further")
        steps = cut(steps.join(ahead, F.col("root") == F.col("w2"), "left").select(
            "w", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variants-roots")
        if steps.where("moved").isEmpty():
            break
        steps = steps.select("w", "root")
    out = rows.join(steps.select("w", "root"), F.col("word") == F.col("w"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def q_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13 over whole ``documents``, damaged by the fixed rule."""
    return group_variants(count_words(damage(runs(table(spark, sf_dir, "documents")))))


SQL = f"""
WITH RECURSIVE tab AS ({SQL_CRC_TABLE}),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '{RUN}')), '{_UPPER}', '{_LOWER}') AS w FROM documents),
g AS (SELECT id, w, count(*) AS c FROM r GROUP BY id, w),
h AS (SELECT w, c, {sql_crc("(id || ':' || w)", "tab.t")} AS h FROM g, tab),
d AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, CAST(h % length(w) AS INT)) || substring(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word, c FROM h),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM d WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
l AS (SELECT word, n, i, left(word, CAST(i AS INT)) || substring(word, CAST(i AS INT) + 2) AS less FROM v, range(100000) t(i) WHERE i < length(word)),
p AS (SELECT a.word AS word, b.word AS near, b.n AS m FROM l a JOIN l b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT v.word, l.word, l.n FROM v JOIN l ON v.word = l.less
  UNION SELECT l.word, v.word, v.n FROM v JOIN l ON v.word = l.less),
o AS (SELECT word, near, m, row_number() OVER (PARTITION BY word ORDER BY m DESC, near) AS k, count(*) OVER (PARTITION BY word) AS c FROM p),
f AS (SELECT v.word, v.n, coalesce(o.c, 0) AS n_near, CASE WHEN o.m >= 2 * v.n THEN o.near END AS form,
  CASE WHEN o.m >= 2 * v.n THEN o.m END AS form_n FROM v LEFT JOIN o ON o.word = v.word AND o.k = 1),
s AS (SELECT word, word AS at FROM f UNION ALL SELECT s.word, f.form FROM s JOIN f ON f.word = s.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, s.at AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM f JOIN s ON s.word = f.word JOIN f e ON e.word = s.at WHERE e.form IS NULL"""
