"""Derived views over the driver's tables, in Spark and as DuckDB SQL text.

The driver's tables hold no movies, so each operator runs on a view derived
from them.  Every view reads its whole source table and keeps all of its rows;
the CASE rules below only blank out some attribute values (to exercise NULL
defaults) and give submissions malformed, empty, repeated-id and late bodies.
Sample ratings come from orders, the users' own ratings from events, so the
validation and test splits share no row with the training union.

``view(spark, sf_dir, name)`` builds the Spark frame; ``oracle_with(names, sql)``
prefixes an oracle query with the DuckDB definitions of the views it uses
(dependencies included, in order).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import prepare

# Fixed values of the fixture (not tunables).
STATE_CUTOFF = "2024-01-16 00:00:00"  # events before it form the stored state, later ones are updates


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)  # event times are TIMESTAMP_NTZ: every epoch conversion must mean UTC
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(orders, li.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").cast("int").alias("userid"),
        F.col("l_partkey").cast("int").alias("movieid"),
        F.ceil(F.col("l_quantity") / 10).cast("double").alias("rating"),
        (F.unix_seconds(F.col("l_shipdate").cast("timestamp")) + F.col("l_orderkey") % 10).alias("ts"),
    )


def my_ratings_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The application's ``personalratings`` table: every event as an integer rating 0..5 (0: not rated)."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("int").alias("userid"),
        F.get_json_object("props", "$.k").cast("int").alias("movieid"),
        F.least(F.floor(F.col("value") / 10), F.lit(5)).cast("int").alias("rating"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"),
    )


def movieinfo_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return p.select(
        key.cast("int").alias("movieid"),
        F.col("p_name").alias("moviename"),
        F.when(key % 17 != 0, F.date_add(F.lit("1990-01-01").cast("date"), (key * 37 % 12000).cast("int"))).alias(
            "releasetime"
        ),
        F.col("p_brand").alias("director"),
        F.when(key % 7 != 0, F.concat(F.lit("Actor "), (key % 50).cast("string"), F.lit(", Actor "),
                                      (key % 31).cast("string"))).alias("leadactors"),
        F.when(key % 5 != 0, F.concat(F.lit("http://img/"), key.cast("string"))).alias("picture"),
        F.when(key % 11 != 0, F.col("p_size").cast("double") / 10).alias("averating"),
        (key * 31 % 997).cast("int").alias("numrating"),
        F.when(key % 9 != 0, F.concat(F.lit("About "), F.col("p_name"))).alias("description"),
        F.when(
            key % 13 != 0,
            F.concat_ws(", ", F.col("p_type"), F.regexp_replace(F.col("p_name"), " ", ", "), F.col("p_brand")),
        ).alias("typelist"),
    )


def favorite_rows(ev: DataFrame) -> DataFrame:
    """Favourite requests from an events frame (batch or stream)."""
    category = (
        F.when(F.col("event_type") == "view", "want_watch")
        .when(F.col("event_type") == "click", "watched")
        .when(F.col("event_type") == "purchase", "liked")
    )
    return ev.select(
        "event_id",
        F.col("user_id").cast("int").alias("userid"),
        F.get_json_object("props", "$.k").cast("int").alias("movieid"),
        category.alias("category"),
        "ts",
        F.when(F.col("event_id") % 4 != 0, (F.col("event_id") % 5 + 1).cast("int")).alias("rating"),
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("note "), F.col("event_id").cast("string"))).alias("note"),
    )


def _favorite_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return favorite_rows(table(spark, sf_dir, "events"))


def favorites_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _favorite_events(spark, sf_dir)
        .where(F.col("category").isNotNull())
        .groupBy("userid", "movieid", "category")
        .agg(F.min(F.struct("ts", "event_id", "rating", "note")).alias("f"))
        .select(F.col("f.event_id").alias("id"), "userid", "movieid", "category", F.col("f.ts").alias("createtime"),
                "f.rating", "f.note")
    )


def recommendations_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored recommendation lists: ten best-rated movies of every user."""
    from pyspark.sql import Window

    r = ratings_v(spark, sf_dir)
    per_pair = r.groupBy("userid", "movieid").agg(F.max("rating").alias("degree"))
    ranked = per_pair.withColumn(
        "rn", F.row_number().over(Window.partitionBy("userid").orderBy(F.desc("degree"), F.asc("movieid")))
    )
    return ranked.where(F.col("rn") <= 10).select("userid", "movieid", F.col("degree").cast("float").alias("degree"))


def progress_rows(ev: DataFrame) -> DataFrame:
    """Progress log rows from an events frame (batch or stream)."""
    return ev.select(
        F.col("user_id").cast("int").alias("userid"),
        "event_id",
        "ts",
        F.when(F.col("event_type") == "error", F.lit(-1))
        .otherwise(F.floor(F.col("value") / 4.9).cast("int"))
        .alias("progress"),
        F.col("event_type").alias("step"),
    )


def progress_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress_rows(table(spark, sf_dir, "events"))


def submission_rows(ev: DataFrame) -> DataFrame:
    """Rating submissions from an events frame (batch or stream): every event submits a body.
    Errors, views, purchases and every third user send bodies the endpoint rejects; clicks repeat
    an id; times are out of order with the submission ids."""
    eid, kind = F.col("event_id"), F.col("event_type")

    def s(c):
        return c.cast("string")

    two_items = F.concat(
        F.lit('[{"movieid":"'), s(eid % 200), F.lit('","rating":'), s(eid % 7),
        F.lit('},{"movieid":'), s(eid % 150 + 1), F.lit(',"rating":"'), s(eid % 5 + 1), F.lit('"}]'))
    same_id = F.concat(
        F.lit('[{"movieid":'), s(eid % 200), F.lit(',"rating":3},{"movieid":'), s(eid % 200), F.lit(',"rating":4}]'))
    body = (
        F.when(kind == "view", "[]")
        .when((kind == "error") | (F.col("user_id") % 3 == 0), "not json")
        .when(kind == "purchase", '[{"movieid":1,"rating":')
        .when(kind == "click", same_id)
        .otherwise(two_items)
    )
    pairs = (
        F.when(kind == "view", "")
        .when(kind == "error", F.concat(F.lit(" "), s(eid % 200), F.lit(":4 ,,"), s(eid % 150), F.lit(":x")))
        .when(kind == "click", F.concat(s(eid % 200), F.lit(":3,"), s(eid % 200), F.lit(":4")))
        .otherwise(F.concat(s(eid % 200), F.lit(":"), s(eid % 5 + 1), F.lit(","), s(eid % 200 + 1), F.lit(":3")))
    )
    return ev.select(
        eid.alias("submission_id"),
        F.col("user_id").cast("int").alias("userid"),
        (F.col("ts") + F.make_dt_interval(days=(eid % 5).cast("int"))).alias("ts"),
        body.alias("selecteddata"),
        pairs.alias("pairs"),
    )


def submissions_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return submission_rows(table(spark, sf_dir, "events"))


_BUILDERS = {
    "ratings_v": ratings_v,
    "my_ratings_v": my_ratings_v,
    "movieinfo_v": movieinfo_v,
    "favorites_v": favorites_v,
    "recommendations_v": recommendations_v,
    "progress_v": progress_v,
    "submissions_v": submissions_v,
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    if name in _BUILDERS:
        return _BUILDERS[name](spark, sf_dir)
    return table(spark, sf_dir, name)


# ---------------------------------------------------------------------------
# DuckDB text of the same views (the oracle only has the raw tables).
# ---------------------------------------------------------------------------

_SQL: dict[str, tuple[str, tuple[str, ...]]] = {
    "ratings_v": (
        """SELECT CAST(o_custkey AS INTEGER) AS userid, CAST(l_partkey AS INTEGER) AS movieid,
       CAST(ceil(l_quantity/10) AS DOUBLE) AS rating,
       CAST(epoch(l_shipdate) AS BIGINT) + l_orderkey % 10 AS ts
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
        (),
    ),
    "my_ratings_v": (
        """SELECT CAST(user_id AS INTEGER) AS userid, CAST(json_extract_string(props,'$.k') AS INTEGER) AS movieid,
       CAST(least(floor(value / 10), 5) AS INTEGER) AS rating, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS timestamp
FROM events""",
        (),
    ),
    "movieinfo_v": (
        """SELECT CAST(p_partkey AS INTEGER) AS movieid, p_name AS moviename,
       CASE WHEN p_partkey % 17 <> 0 THEN DATE '1990-01-01' + CAST(p_partkey*37 % 12000 AS INTEGER) END AS releasetime,
       p_brand AS director,
       CASE WHEN p_partkey % 7 <> 0 THEN concat('Actor ', CAST(p_partkey % 50 AS VARCHAR), ', Actor ',
                                                CAST(p_partkey % 31 AS VARCHAR)) END AS leadactors,
       CASE WHEN p_partkey % 5 <> 0 THEN concat('http://img/', CAST(p_partkey AS VARCHAR)) END AS picture,
       CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_size AS DOUBLE)/10 END AS averating,
       CAST(p_partkey*31 % 997 AS INTEGER) AS numrating,
       CASE WHEN p_partkey % 9 <> 0 THEN concat('About ', p_name) END AS description,
       CASE WHEN p_partkey % 13 <> 0 THEN concat_ws(', ', p_type, replace(p_name,' ',', '), p_brand) END AS typelist
FROM part""",
        (),
    ),
    "favorites_v": (
        """SELECT id, userid, movieid, category, createtime,
       CASE WHEN id % 4 <> 0 THEN CAST(id % 5 + 1 AS INTEGER) END AS rating,
       CASE WHEN id % 3 <> 0 THEN concat('note ', CAST(id AS VARCHAR)) END AS note
FROM (SELECT first(event_id ORDER BY ts, event_id) AS id, userid, movieid, category, min(ts) AS createtime
FROM (SELECT event_id, CAST(user_id AS INTEGER) AS userid,
             CAST(json_extract_string(props,'$.k') AS INTEGER) AS movieid,
             CASE event_type WHEN 'view' THEN 'want_watch' WHEN 'click' THEN 'watched'
                             WHEN 'purchase' THEN 'liked' END AS category, ts
      FROM events) e
WHERE category IS NOT NULL GROUP BY userid, movieid, category) f""",
        (),
    ),
    "recommendations_v": (
        """SELECT userid, movieid, CAST(degree AS FLOAT) AS degree
FROM (SELECT userid, movieid, degree,
             row_number() OVER (PARTITION BY userid ORDER BY degree DESC, movieid) AS rn
      FROM (SELECT userid, movieid, max(rating) AS degree FROM ratings_v GROUP BY userid, movieid) a) b
WHERE rn <= 10""",
        ("ratings_v",),
    ),
    "progress_v": (
        """SELECT CAST(user_id AS INTEGER) AS userid, event_id, ts,
       CASE WHEN event_type = 'error' THEN -1 ELSE CAST(floor(value/4.9) AS INTEGER) END AS progress,
       event_type AS step
FROM events""",
        (),
    ),
    "submissions_v": (
        """SELECT event_id AS submission_id, CAST(user_id AS INTEGER) AS userid,
       ts + to_days(CAST(event_id % 5 AS INTEGER)) AS ts,
       CASE WHEN event_type = 'view' THEN '[]'
            WHEN event_type = 'error' OR user_id % 3 = 0 THEN 'not json'
            WHEN event_type = 'purchase' THEN '[{"movieid":1,"rating":'
            WHEN event_type = 'click' THEN concat('[{"movieid":', CAST(event_id%200 AS VARCHAR),
              ',"rating":3},{"movieid":', CAST(event_id%200 AS VARCHAR), ',"rating":4}]')
            ELSE concat('[{"movieid":"', CAST(event_id%200 AS VARCHAR), '","rating":', CAST(event_id%7 AS VARCHAR),
              '},{"movieid":', CAST(event_id%150+1 AS VARCHAR), ',"rating":"', CAST(event_id%5+1 AS VARCHAR), '"}]')
       END AS selecteddata,
       CASE WHEN event_type = 'view' THEN ''
            WHEN event_type = 'error' THEN concat(' ', CAST(event_id%200 AS VARCHAR), ':4 ,,', CAST(event_id%150 AS VARCHAR), ':x')
            WHEN event_type = 'click' THEN concat(CAST(event_id%200 AS VARCHAR), ':3,', CAST(event_id%200 AS VARCHAR), ':4')
            ELSE concat(CAST(event_id%200 AS VARCHAR), ':', CAST(event_id%5+1 AS VARCHAR), ',', CAST(event_id%200+1 AS VARCHAR), ':3')
       END AS pairs
FROM events""",
        (),
    ),
}


def _closure(names: list[str]) -> list[str]:
    ordered: list[str] = []

    def visit(n: str) -> None:
        if n in ordered:
            return
        for dep in _SQL[n][1]:
            visit(dep)
        ordered.append(n)

    for n in names:
        visit(n)
    return ordered


def oracle_with(names: list[str], body: str, ctes: list[tuple[str, str]] | None = None) -> str:
    """``WITH <views>[, <ctes>] <body>`` in DuckDB dialect."""
    parts = [f"{n} AS (\n{_SQL[n][0]}\n)" for n in _closure(names)]
    parts += [f"{n} AS (\n{q}\n)" for n, q in (ctes or [])]
    return "WITH " + ",\n".join(parts) + "\n" + body
