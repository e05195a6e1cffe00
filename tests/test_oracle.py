"""Every registered query against its DuckDB oracle on the smallest fixture
(the driver repeats this at sf0.01).  The four queries that fit the whole ALS
grid (eight fits each) are left to ``tools/oracle_compare.py``; test_model.py runs
their operators on a small grid."""

import pytest

import __spark_entry__ as entry
from tools.oracle_compare import digest

from .conftest import SF_SMALL

SLOW = {"als_grid_search", "select_best_model", "model_report", "recommend_for_user"}
NAMES = [n for n in entry.oracle_sql() if n not in SLOW]


def test_every_query_is_registered_with_a_callable():
    qs = entry.queries()
    assert len(qs) >= 80
    assert set(entry.oracle_sql()) <= set(qs)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF_SMALL)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    res = duck.execute(entry.oracle_sql()[name])
    o_cols = [d[0] for d in res.description]
    o_rows = res.fetchall()
    assert sorted(s_cols) == sorted(o_cols)
    assert len(s_rows) == len(o_rows)
    assert digest(s_cols, s_rows)[0] == digest(o_cols, o_rows)[0]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["userid", "movieid", "moviename", "prediction", "rec_rank"]
    assert df.count() > 0
