"""Search by posting lists against a plain contains."""

import random

from cinelytics.operators import search

TITLES = [(1, "The Ring"), (2, "Ringing 100%"), (3, None), (4, ""), (5, "aaaa"), (6, "Über_ring"), (6, "Other"), (7, "The Ring"), (8, "a b")]
TERMS = ["ring", " RING ", "the r", "%", "_", "100%", "", "  ", None, "zzz", "ringx", "aaa", "aaaaa", "ü", "über", "a", "in", "g 1", "ring"]


def brute(titles, terms):
    wanted = {t.strip(" ").lower() for t in terms if t is not None}
    return sorted({(t, i) for t in wanted for i, name in titles if name is not None and t in name.lower()})


def run(spark, titles, terms):
    catalog = spark.createDataFrame([(*t, 9) for t in titles], "movieid int, moviename string, term int")
    got = search.search_terms(spark.createDataFrame([(t, 1) for t in terms], "term string, movieid int"), search.title_postings(catalog))
    assert got.columns == ["term", "movieid"]
    return sorted(map(tuple, got.collect()))


def test_equals_contains(spark):
    assert run(spark, TITLES, TERMS) == brute(TITLES, TERMS)
    assert run(spark, TITLES[:0], TERMS) == run(spark, TITLES, []) == []


def test_random_titles(spark):
    rng = random.Random(3)
    titles = [(i, "".join(rng.choice("abC ") for _ in range(rng.randint(0, 14)))) for i in range(300)]
    terms = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 7))) for _ in range(200)]
    assert run(spark, titles, terms) == brute(titles, terms)


def test_no_cross_join(spark):
    from cinelytics import fixtures as fx

    from .conftest import SF_SMALL

    catalog = fx.movieinfo_v(spark, SF_SMALL)
    plan = search.search_terms(catalog.selectExpr("moviename AS term"), search.title_postings(catalog))
    text = plan._jdf.queryExecution().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_postings_are_never_broadcast(spark, monkeypatch):
    """With more terms than are broadcast, both sides are shuffled, however small the titles' file looks."""
    from cinelytics import fixtures as fx

    from .conftest import SF_SMALL

    monkeypatch.setattr(search, "MAX_TERMS", 0, raising=False)
    catalog = fx.movieinfo_v(spark, SF_SMALL)
    found = search.search_terms(catalog.selectExpr("moviename AS term"), search.title_postings(catalog))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert run(spark, TITLES, TERMS) == brute(TITLES, TERMS)
