"""Title search for a table of terms: posting lists of grams instead of a scan per term.

A title's grams are its distinct substrings of one to three characters, lower case, and
the empty one.  A trimmed, lower-case term of up to three characters is a gram itself, so
its posting list is the answer.  A longer one has several grams: it meets the titles of its
rarest, and ``contains`` checks each where they meet.  Everything is an equi-join; no term
meets a title that lacks its rarest gram.

Postings are many times the titles' size in the file, which is what a planner guesses from, so
they are never the side that is broadcast: the terms are, where they are few by count and bytes,
else both are shuffled.

``%`` and ``_`` are literal.  The empty term finds every title, null terms and titles nothing;
repeated terms give one answer, repeated movie ids with different titles are found by any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.joins import join_dimension
from ..session import stored

GRAM = 3
MAX_TERMS = 500_000  # terms that are broadcast: a table of them is held by the driver once


def _grams(text: Column, sizes) -> Column:
    def of_size(n):
        last = F.length(text) - (n - 1)
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(n)))).otherwise(
            F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of_size(n) for n in sizes]))


def title_postings(catalog: DataFrame, item_col: str = "movieid", title_col: str = "moviename") -> DataFrame:
    """gram, item, title (lower case): a row per distinct gram of each title."""
    rows = catalog.select(F.col(item_col).alias("item"), F.lower(title_col).alias("title")).where("title IS NOT NULL").distinct()
    grams = F.concat(F.array(F.lit("")), _grams(F.col("title"), range(1, GRAM + 1)))
    return rows.select(F.explode(grams).alias("gram"), "item", "title")


def search_terms(terms: DataFrame, postings: DataFrame, term_col: str = "term", item_col: str = "movieid") -> DataFrame:
    """term, item: the titles that contain each distinct term of ``terms`` (trimmed, case ignored)."""
    wanted = terms.select(F.lower(F.trim(term_col)).alias("term")).where("term IS NOT NULL").distinct()
    whole = F.length("term") <= GRAM
    grams = F.when(whole, F.array("term")).otherwise(_grams(F.col("term"), [GRAM]))
    frequency = postings.groupBy("gram").agg(F.count("*").alias("n")).hint("merge")
    # a gram that no title has makes its term's list empty: it is the rarest
    rare = wanted.select("term", F.explode(grams).alias("gram")).join(frequency, "gram", "left").groupBy("term").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram"))
    rare = stored(rare, "rare-grams")  # counted, then joined
    hits = join_dimension(postings.hint("merge"), rare, "gram", max_rows=MAX_TERMS).where(F.contains("title", "term"))
    return hits.select("term", "item").distinct().select(F.col("term").alias(term_col), F.col("item").alias(item_col))
