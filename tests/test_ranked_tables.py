"""Stored orders against plain windows: hot groups over many parts, pages by the files read,
empty tables, null groups, a write that broke off."""

import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from cinelytics.sources.ranked import open_ranked, write_ranked

SCHEMA = "userid int, seq int, v int"


def rows(n=900, seed=2):
    rng = random.Random(seed)
    return [(0 if i % 3 == 0 else None if i % 50 == 1 else rng.randint(1, 30), i, rng.randint(0, 9)) for i in range(n)]


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_positions_equal_a_window(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA)
    order = [F.desc("v"), F.asc("seq")]
    stored = write_ranked(df, str(tmp_path / "t"), order, ["userid"], num_partitions=7)
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("userid").orderBy(*order)))
    assert stored.total == 900 and len(stored.parts) > 4
    assert listed(stored.positions()) == listed(want)
    again = open_ranked(spark, str(tmp_path / "t"), df.schema, ["userid"])
    assert again.parts == stored.parts
    keys = spark.createDataFrame([(0,), (5,), (None,), (5,), (777,)], "userid int")
    some = want.where("(userid IN (0, 5) OR userid IS NULL) AND rank BETWEEN 4 AND 9")
    found = again.positions_of(keys, 4, 9)
    assert listed(found) == listed(some)
    far = again.positions_of(spark.createDataFrame([(0,)], "userid int"), 250, 251)
    assert listed(far) == listed(want.where("userid = 0 AND rank BETWEEN 250 AND 251"))
    assert len(far.inputFiles()) <= 3 < len(stored.positions().inputFiles())
    plan = stored.positions()._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "rangepartitioning" not in plan


def test_a_page_reads_the_files_that_hold_it(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA)
    stored = write_ranked(df, str(tmp_path / "t"), [F.desc_nulls_last("v"), F.asc("seq")], num_partitions=9)
    want = sorted(rows(), key=lambda r: (-r[2], r[1]))
    assert [tuple(r)[:3] for r in stored.ranked().orderBy("rank").collect()] == want
    for page in (1, 2, 17, 36, 37):
        part = stored.page(page, 25)
        assert [tuple(r) for r in part.orderBy("rank").collect()] == [(*want[i], i + 1) for i in range((page - 1) * 25, min(page * 25, 900))]
        assert len(part.inputFiles()) <= 2 + 1  # a part, its neighbour, and the slices' footers at most
    first, n = stored.parts[0][1], stored.parts[0][2]
    assert len(stored.between(first, n).inputFiles()) == 1


def test_empty_and_unfinished_tables(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    stored = write_ranked(df, str(tmp_path / "e"), [F.asc("seq")], ["userid"])
    assert stored.total == 0 and stored.page(1, 10).count() == 0 and stored.ranked().count() == 0
    assert stored.positions().columns == ["userid", "seq", "v", "rank"] and stored.positions().count() == 0
    assert stored.positions_of(spark.createDataFrame([(1,)], "userid int"), 1, 5).count() == 0
    df.write.parquet(str(tmp_path / "broken" / "rows"))
    with pytest.raises(AnalysisException):
        open_ranked(spark, str(tmp_path / "broken"), df.schema)
