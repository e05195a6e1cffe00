"""URL verdicts: hand-written host rules first, then mined association rules.

Tokens of a url: its host labels (``h:``), its path parts with digits folded to one
``#`` (``p:``) and its query keys (``q:``), each once.  Spark's FP-growth mines the
token sets of the labelled urls together with the label item; a rule "tokens ->
block" stays if it holds at least ``min_support`` of the labelled urls and at least
``min_confidence`` of those with its tokens are blocked, whatever its length.  Of the
rules over ``PLAIN_ITEMS`` tokens only those stay that have no rule inside them; the
others would block nothing more.

Tokens that occur in exactly the same labelled urls (a url form with 25 fixed query keys)
would give every subset of them as an itemset.  They are folded into one item, the
least of them, before mining; a rule holds for a url that has any of the tokens behind each of its
items, which is what all rules over single tokens of theirs say together.

An inverted index (each rule under its rarest item) finds the
candidate rules of a token set, whose other items are then checked.  Matching runs
once per distinct set of rule tokens, so a host with a third of all rows costs one
row there.  A url that no hand rule fits is blocked if a mined rule matches.

Only DataFrame functions and Spark ML run here.  Null urls and urls without ``://``
have an empty host and path, no tokens, and are allowed.  Rows without a label or id
don't train.  Repeated pages get equal verdicts.  Without labels nothing is mined.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, table

MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.9
PLAIN_ITEMS = 3
BLOCK = "=block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

HAND_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
              ("org", "/fr/", "allow")]


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Sorted distinct tokens; null or hostless urls have none."""
    host = F.filter(F.split(host_of(url), "\\."), lambda x: x != "")
    path = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    query = F.regexp_extract(_rest(url), "^[^?#]*\\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    found = F.concat(F.transform(host, lambda x: F.concat(F.lit("h:"), x)),
                     F.transform(path, lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "#"))),
                     F.transform(keys, lambda x: F.concat(F.lit("q:"), x)))
    return F.coalesce(F.array_sort(F.array_distinct(found)), F.array().cast("array<string>"))


def hand_rule(host: Column, path: Column, rules=tuple(HAND_RULES)) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name = F.lit(h + p)
        rule = F.when(fits, name) if rule is None else rule.when(fits, name)
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    none = F.lit(None).cast("string")
    return (none if rule is None else rule), (none if verdict is None else verdict)


def _without_inner(sets: DataFrame, plain_items: int) -> DataFrame:
    """``sets`` (body, n, n_body, passes), which hold every subset of each body, without the
    bodies over ``plain_items`` tokens that don't pass or hold a shorter one that does.
    Level by level: a body is over if it passes or one without one of its tokens is over."""
    longest = sets.agg(F.max(F.size("body"))).first()[0] or 0
    kept, over = sets.where((F.size("body") <= plain_items) & F.col("passes")), None
    for size in range(1, longest + 1 if longest > plain_items else 0):
        level = sets.where(F.size("body") == size)
        if over is None:
            level = level.withColumn("inner", F.lit(False))
        else:
            less = level.select("body", F.explode("body").alias("token")).select("body", F.array_remove("body", F.col("token")).alias("part"))
            inner = less.join(over.select(F.col("body").alias("part")), "part").select("body").distinct().withColumn("inner", F.lit(True))
            level = level.join(inner, "body", "left").withColumn("inner", F.coalesce("inner", F.lit(False)))
        level = cut(level, "url-level")
        over = level.where(F.col("passes") | F.col("inner"))
        if size > plain_items:
            kept = kept.union(level.where(F.col("passes") & ~F.col("inner")).select(*sets.columns))
    return kept


def equal_tokens(baskets: DataFrame, min_rows: float) -> dict[str, str]:
    """Token -> item (the least token of its group) for the tokens of at least ``min_rows``
    of the rows (rid, tokens) that occur in exactly the same rows as another one.

    Candidates agree in their number of rows and in two 64-bit hashes over them; a group
    then counts only if every row holds all of it or nothing.  At most (tokens per url) /
    min_support tokens are that frequent, so the mapping is a bounded list."""
    seen = baskets.select("rid", F.explode("tokens").alias("token"))
    print_of = [F.bit_xor(F.xxhash64("rid", F.lit(salt))).alias(f"x{salt}") for salt in (1, 2)]
    each = seen.groupBy("token").agg(F.count("*").alias("n"), *print_of).where(F.col("n") >= min_rows)
    groups = each.groupBy("n", "x1", "x2").agg(F.array_sort(F.collect_list("token")).alias("members")).where(F.size("members") > 1)
    members = cut(groups.select(F.explode("members").alias("token"), F.col("members")[0].alias("item"),
                                F.size("members").alias("size")), "url-equal")
    if members.isEmpty():
        return {}
    held = seen.join(F.broadcast(members), "token").groupBy("rid", "item", "size").agg(F.count("*").alias("here"))
    partly = {r["item"] for r in held.where(F.col("here") != F.col("size")).select("item").distinct().collect()}
    return {r["token"]: r["item"] for r in members.collect() if r["item"] not in partly}


def _item(equal: dict[str, str]):
    """Token column -> item column."""
    if not equal:
        return lambda token: token
    pairs = F.create_map(*[F.lit(x) for pair in sorted(equal.items()) for x in pair])
    return lambda token: F.coalesce(F.try_element_at(pairs, token), token)


def mine(labelled: DataFrame, **params) -> DataFrame:
    """The rules alone; see ``mine_items``."""
    return mine_items(labelled, **params)[0]


def mine_items(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
               plain_items: int = PLAIN_ITEMS) -> tuple[DataFrame, dict[str, str]]:
    """Rules (body, n, confidence, rarest) over items, from rows (tokens, blocked boolean);
    and the tokens that share an item."""
    spark = labelled.sparkSession
    rows = cut(labelled.where("blocked IS NOT NULL").select(F.monotonically_increasing_id().alias("rid"), "tokens", "blocked"),
               "url-labelled")
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "body array<string>, n long, confidence double, rarest string"), {}
    equal = equal_tokens(rows, min_support * total)
    label = F.when(F.col("blocked"), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>"))
    baskets = rows.select(F.concat(F.array_distinct(F.transform("tokens", _item(equal))), label).alias("items"))
    found = FPGrowth(minSupport=min_support, itemsCol="items").fit(cut(baskets, "url-baskets")).freqItemsets
    sets = cut(found.select(F.array_sort(F.array_remove("items", BLOCK)).alias("body"),
                            F.array_contains("items", BLOCK).alias("blocks"), "freq")
               .where(F.size("body") > 0), "url-itemsets")
    plain = sets.where(~F.col("blocks")).select("body", F.col("freq").alias("n_body"))
    rules = sets.where("blocks").select("body", F.col("freq").alias("n")).join(plain, "body")
    rules = cut(rules.withColumn("passes", F.col("n") / F.col("n_body") >= min_confidence), "url-blocking")
    rules = _without_inner(rules, plain_items).withColumn("confidence", F.col("n") / F.col("n_body"))
    single = plain.where(F.size("body") == 1).select(F.col("body")[0].alias("token"), F.col("n_body").alias("df"))
    rarest = (rules.select("body", F.explode("body").alias("token")).join(single, "token")
              .groupBy("body").agg(F.min(F.struct("df", "token")).alias("m")).select("body", F.col("m.token").alias("rarest")))
    return cut(rules.join(rarest, "body").select("body", "n", "confidence", "rarest"), "url-rules"), equal


def matching_sets(token_sets: DataFrame, rules: DataFrame, equal: dict[str, str] | None = None) -> DataFrame:
    """(tokens, rule, confidence): the best mined rule of each token set that one matches,
    written with the set's own tokens (of several behind one item, the largest)."""
    item = _item(equal or {})
    index = rules.select(F.col("rarest").alias("item"), "body", "confidence")
    sets = token_sets.withColumn("items", F.array_distinct(F.transform("tokens", item)))
    hits = sets.select("tokens", "items", F.explode("items").alias("item")).join(index, "item")
    hits = hits.where(F.forall("body", lambda x: F.array_contains("items", x)))
    own = F.transform("body", lambda x: F.array_max(F.filter("tokens", lambda t: item(t) == x)))
    best = F.max(F.struct("confidence", (-F.size("body")).alias("short"), F.array_join(F.array_sort(own), " ").alias("rule")))
    return hits.groupBy("tokens").agg(best.alias("b")).select("tokens", "b.rule", "b.confidence")


def judge(pages: DataFrame, labels: DataFrame | None = None, url_col: str = "url", id_col: str = "page_id",
          label_id: str = "page_id", label_col: str = "blocked", rules=tuple(HAND_RULES), keep: list[str] | None = None,
          **mining) -> DataFrame:
    """``keep`` columns (all by default) plus host, path, rule, verdict, mined_rule.

    Training rows: the urls that no hand rule fits and ``labels`` knows (id, blocked boolean; several
    rows of an id: blocked if one says so), so support and confidence are shares of those
    alone.  Without ``labels`` the urls that hand rules fit train, labelled by them."""
    keep = pages.columns if keep is None else keep
    keep = [c for c in keep if c.lower() not in {"host", "path", "rule", "verdict", "mined_rule"}]
    inner = {x: fresh(pages, x) for x in ("host", "path", "rule", "verdict", "tokens", "set", "id", "blocked")}
    url = F.col(f"`{url_col}`").cast("string")
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{id_col}`").alias(inner["id"]),
                        host_of(url).alias(inner["host"]), path_of(url).alias(inner["path"]), tokens_of(url).alias(inner["tokens"]))
    rule, verdict = hand_rule(F.col(inner["host"]), F.col(inner["path"]), rules)
    rows = rows.withColumns({inner["rule"]: rule, inner["verdict"]: verdict})
    if labels is None:
        training = rows.where(F.col(inner["verdict"]).isNotNull()).select(
            F.col(inner["tokens"]).alias("tokens"), (F.col(inner["verdict"]) == "block").alias("blocked"))
    else:
        marks = labels.select(F.col(f"`{label_id}`").alias("mark_id"), F.col(f"`{label_col}`").cast("boolean").alias("blocked"))
        marks = marks.where("mark_id IS NOT NULL AND blocked IS NOT NULL").groupBy("mark_id").agg(F.max("blocked").alias("blocked"))
        open_rows = rows.where(F.col(inner["verdict"]).isNull()).select(F.col(inner["id"]).alias("mark_id"), F.col(inner["tokens"]).alias("tokens"))
        training = open_rows.join(marks, "mark_id").select("tokens", "blocked")
    mined, equal = mine_items(training, **mining)
    # at most (tokens per url) / min_support different tokens occur in rules: a bounded list
    used = {r["t"] for r in mined.select(F.explode("body").alias("t")).distinct().collect()}
    used |= {token for token, item in equal.items() if item in used}
    known = F.array(*[F.lit(t) for t in sorted(used)]).cast("array<string>")
    rows = rows.withColumn(inner["set"], F.array_sort(F.array_intersect(inner["tokens"], known)))
    sets = rows.where(F.col(inner["verdict"]).isNull()).select(F.col(inner["set"]).alias("tokens")).distinct()
    hits = cut(matching_sets(sets, mined, equal), "url-hits").select(
        F.col("tokens").alias(inner["blocked"]), F.col("rule").alias("mined_rule"))
    out = rows.join(hits, F.col(inner["set"]) == F.col(inner["blocked"]), "left")
    found = F.when(F.col(inner["rule"]).isNull(), F.col("mined_rule"))
    return out.select(
        *[F.col(f"`{c}`") for c in keep], F.col(inner["host"]).alias("host"), F.col(inner["path"]).alias("path"),
        F.col(inner["rule"]).alias("rule"),
        F.coalesce(inner["verdict"], F.when(found.isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        found.alias("mined_rule"))


def q_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6 over whole ``pages``; ``labels`` (by page number, quality 0: blocked) label the
    urls that no hand rule fits."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("blocked"))
    return judge(table(spark, sf_dir, "pages"), labels, keep=["page_id"])


_HAND = sorted(HAND_RULES, key=lambda r: (-len(r[0]) - len(r[1]), r))
_FITS = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in _HAND]
SQL = rf"""
WITH u AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN instr(url, '://') > 0
             THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query FROM u),
r AS (SELECT *, CASE {" ".join(f"WHEN {f} THEN '{h}{p}'" for f, (h, p, _) in zip(_FITS, _HAND))} END AS rule,
        CASE {" ".join(f"WHEN {f} THEN '{v}'" for f, (_, _, v) in zip(_FITS, _HAND))} END AS hand FROM h),
tok AS (
  SELECT DISTINCT rid, t FROM (
    SELECT rid, 'h:' || unnest(string_split(host, '.')) AS t FROM r
    UNION ALL SELECT rid, 'p:' || regexp_replace(unnest(string_split(path, '/')), '[0-9]+', '#', 'g') FROM r
    UNION ALL SELECT rid, 'q:' || string_split(unnest(string_split(query, '&')), '=')[1] FROM r) x
  WHERE length(t) > 2),
marks AS (SELECT doc_id, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS b FROM labels
          WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
train AS (SELECT r.rid, m.b FROM r JOIN marks m ON m.doc_id = r.page_id WHERE r.hand IS NULL),
least_n AS (SELECT ceil({MIN_SUPPORT}::DOUBLE * count(*)) AS k FROM train),
tt AS (SELECT t.rid, t.t, x.b FROM tok t JOIN train x USING (rid)),
sets AS (
  SELECT [t] AS body, b FROM tt
  UNION ALL SELECT [a.t, c.t], a.b FROM tt a JOIN tt c ON a.rid = c.rid AND a.t < c.t
  UNION ALL SELECT [a.t, c.t, e.t], a.b FROM tt a JOIN tt c ON a.rid = c.rid AND a.t < c.t JOIN tt e ON e.rid = a.rid AND c.t < e.t),
rules AS (SELECT body, sum(b)::DOUBLE / count(*) AS conf FROM sets GROUP BY body
          HAVING sum(b) >= (SELECT k FROM least_n) AND sum(b)::DOUBLE / count(*) >= {MIN_CONFIDENCE}),
own AS (SELECT rid, list(t) AS ts FROM tok GROUP BY rid),
hit AS (SELECT o.rid, x.conf, -len(x.body) AS short, array_to_string(x.body, ' ') AS mined FROM own o JOIN rules x ON list_has_all(o.ts, x.body)),
best AS (SELECT rid, mined, row_number() OVER (PARTITION BY rid ORDER BY conf DESC, short DESC, mined DESC) AS k FROM hit)
SELECT r.page_id, r.host, r.path, r.rule,
       coalesce(r.hand, CASE WHEN b.mined IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN r.rule IS NULL THEN b.mined END AS mined_rule
FROM r LEFT JOIN best b ON b.rid = r.rid AND b.k = 1"""
