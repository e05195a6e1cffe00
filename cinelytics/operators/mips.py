"""Exact maximum inner products with norm bounds: the best unseen items of every user.

Items are ordered by falling norm and read in that order.  By Cauchy and Schwarz no item
from a place on can score more than |user| * |item there|, so a user is done as soon as
the n-th best unseen score found so far beats that.  Nothing is capped: a user whose
bound never falls below the n-th best score sees every item.

* Items come in rounds of at most ``round_bytes`` of factors (the proven size of what is
  broadcast), inside a round in blocks of ``block`` items; a block is one matrix product
  for a few hundred users.  Users that are done leave after their round.
* What a user has seen is kept as 64-bit words over item places, a row per (user, word),
  made by a partial ``bit_or``: repeated pairs fold, no row holds more than one number,
  and a user with any number of seen items adds at most ``round / 64`` rows to a round.
* A user's state is its factors and the n best found so far.

The seen words and every round's state are stored in the shared folder, in packed columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import join_dimension
from ..plans.ranking import global_rank
from ..session import stored

ROUND_BYTES = 32 << 20
BLOCK = 2_048
USERS = 512
WORDS = 1 << 18
SLACK = 1e-6  # of rounding, far above that of doubles


def _merge(users, ids, scores, n, n_users):
    """The n best (score falling, id rising) of each user, in order: users, ids, scores."""
    order = np.lexsort((ids, -scores, users))
    users, ids, scores = users[order], ids[order], scores[order]
    first = np.searchsorted(users, np.arange(n_users))
    keep = np.arange(len(users)) - first[users] < n
    return users[keep], ids[keep], scores[keep]


def best_of_blocks(factors, held, seen_user, seen_place, items, ids, norms, n, block=BLOCK):
    """Go through the items (falling norm) for some users.

    ``factors``: users x rank; ``held``: (users, ids, scores) found before; ``seen_user``,
    ``seen_place``: pairs not to count.  Returns (users, ids, scores) and the number of
    scores computed."""
    n_users, made = len(factors), 0
    own = np.sqrt((factors * factors).sum(axis=1))
    users, found, scores = held
    order = np.argsort(seen_place, kind="stable")
    seen_user, seen_place = seen_user[order], seen_place[order]
    for at in range(0, len(ids), block):
        floor = nth_best(users, scores, n, n_users)
        live = np.flatnonzero(own * norms[at] * (1 + SLACK) >= floor)
        if not len(live):
            break
        part = slice(at, min(at + block, len(ids)))
        grid = (factors[live] @ items[part].T).astype(np.float32)
        made += grid.size
        lo, hi = np.searchsorted(seen_place, [part.start, part.stop])
        row = np.full(n_users, -1)
        row[live] = np.arange(len(live))
        r = row[seen_user[lo:hi]]
        grid[r[r >= 0], seen_place[lo:hi][r >= 0] - at] = -np.inf
        least = np.maximum(floor[live], np.float32(0)).astype(np.float32)
        good = (grid >= least[:, None]) & (grid > 0) & np.isfinite(grid)
        many = np.flatnonzero(good.sum(axis=1) > n)
        if len(many):  # only the n best of the block, and what is equal to the last of them
            cut = np.partition(np.where(good[many], grid[many], -np.inf), -n, axis=1)[:, -n]
            good[many] &= grid[many] >= cut[:, None]
        u, k = np.nonzero(good)
        users, found, scores = _merge(np.r_[users, live[u]], np.r_[found, ids[part][k]], np.r_[scores, grid[u, k]], n, n_users)
    return (users, found, scores), made


def nth_best(users, scores, n, n_users):
    """The n-th best score of each user, -inf where fewer are known."""
    count = np.bincount(users, minlength=n_users)
    out = np.full(n_users, -np.inf)
    full = count >= n
    last = np.cumsum(count) - 1
    out[full] = scores[last[full]]
    return out


def known_users(b: pa.RecordBatch, last: int | None):
    """A sorted batch without the seen words of users that have no state, and its last user with one
    (``last``: that of the batches before)."""
    ids, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
    if not len(ids):
        return b, last
    head = np.maximum.accumulate(np.where(kind == 0, np.arange(len(ids)), -1))
    known = np.where(head < 0, last is not None and ids == last, ids == ids[head])
    return (b if known.all() else b.filter(pa.array(known))), int(ids[head[-1]]) if head[-1] >= 0 else last


def _round(items, n, next_norm, block):
    """mapInArrow function over a round's rows (userid, kind, features, ids, scores, word, bits),
    sorted by user with the user's state (kind 0) before its seen words (kind 1)."""
    def finish(t: pa.Table) -> pa.RecordBatch:
        kind = t.column("kind").to_numpy()
        heads = np.flatnonzero(kind == 0)
        state, words = t.take(heads), t.take(np.flatnonzero(kind == 1))
        number = np.cumsum(kind == 0) - 1           # the user of every row
        matrix, ids, norms = items.value
        n_users = len(heads)
        factors = state.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        factors = factors.reshape(n_users, -1)
        lists = state.column("ids").combine_chunks()
        users = np.repeat(np.arange(n_users), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        held = (users, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
                state.column("scores").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32))
        bits = words.column("bits").to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8)
        at, bit = np.nonzero(np.unpackbits(bits, axis=1, bitorder="little"))
        seen_user, seen_place = number[kind == 1][at], words.column("word").to_numpy()[at] * 64 + bit
        (users, found, scores), _ = best_of_blocks(factors, held, seen_user, seen_place, matrix, ids, norms, n, block)
        own = np.sqrt((factors * factors).sum(axis=1))
        done = own * next_norm * (1 + SLACK) < nth_best(users, scores, n, n_users)
        ends = pa.array(np.searchsorted(users, np.arange(n_users + 1)), pa.int32())
        return pa.RecordBatch.from_arrays(
            [state.column("userid").combine_chunks(), state.column("features").combine_chunks(),
             pa.ListArray.from_arrays(ends, pa.array(found, pa.int32())),
             pa.ListArray.from_arrays(ends, pa.array(scores, pa.float32())), pa.array(done, pa.bool_())],
            names=["userid", "features", "ids", "scores", "done"])

    def run(batches):
        held, users, words, last = [], 0, 0, None
        for b in batches:
            b, last = known_users(b, last)
            at = 0
            while at < b.num_rows:
                kind = b.column(1).to_numpy()[at:]
                heads = np.flatnonzero(kind == 0)
                # up to the state of the user that would be one too many, or, past WORDS rows, the next user's
                room = max(USERS - users, 0) if words < WORDS else 0
                if len(heads) <= room:
                    held.append(b.slice(at))
                    users, words, at = users + len(heads), words + len(kind) - len(heads), b.num_rows
                    continue
                cut = int(heads[room])
                if cut:
                    held.append(b.slice(at, cut))
                yield finish(pa.Table.from_batches(held))
                held, users, words, at = [], 0, 0, at + cut
        if held:
            yield finish(pa.Table.from_batches(held))

    return run


def best_unseen(user_factors: DataFrame, item_factors: DataFrame, seen: DataFrame, n: int, user_col: str = "userid",
                item_col: str = "movieid", round_bytes: int = ROUND_BYTES, block: int = BLOCK) -> DataFrame:
    """user, item, prediction, rank: the ``n`` items of positive inner product that rank
    first (ties by id) among those without a pair in ``seen``, for every row of ``user_factors``.

    ``user_factors``, ``item_factors``: id, features (float arrays of one length).  Null and
    repeated seen pairs, and pairs of unknown users or items, change nothing."""
    spark = item_factors.sparkSession
    out = f"{user_col} int, {item_col} int, prediction float, rank int"
    norm = F.sqrt(F.aggregate("features", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    ranked = global_rank(item_factors.select("id", "features", norm.alias("norm")),
                              [F.desc("norm"), F.asc("id")], "place").checkpoint(eager=True)
    n_items = ranked.count()
    if not n_items:
        return spark.createDataFrame([], out)
    width = len(ranked.select("features").first()[0])
    per_round = max(64, round_bytes // (8 * width + 16) // 64 * 64)
    place = F.col("place") - 1
    places = ranked.select(F.col("id").alias(item_col), place.alias("at"))
    pairs = join_dimension(seen.select(F.col(user_col).cast("int").alias(user_col), F.col(item_col).cast("int").alias(item_col)),
                           places, item_col, dim_rows=n_items)
    words = pairs.select(F.col(user_col).alias("userid"), F.floor(F.col("at") / per_round).cast("int").alias("round"),
                         F.floor(F.col("at") % per_round / 64).cast("int").alias("word"),
                         F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int")).alias("bits"))
    words = words.groupBy("userid", "round", "word").agg(F.bit_or("bits").alias("bits"))
    words = stored(words.where("userid IS NOT NULL"), "seen-words")
    no_ids, no_scores = F.array().cast("array<int>"), F.array().cast("array<float>")
    state = user_factors.select(F.col("id").alias("userid"), "features", no_ids.alias("ids"), no_scores.alias("scores"))
    parts = []
    for r in range(-(-n_items // per_round)):
        rows = ranked.where(place.between(r * per_round, (r + 1) * per_round - 1)).orderBy("place").toPandas()  # <= per_round
        matrix = np.stack([np.asarray(x, np.float64) for x in rows["features"]])
        last = (r + 1) * per_round >= n_items
        after = 0.0 if last else ranked.where(F.col("place") == (r + 1) * per_round + 1).first()["norm"]
        sent = spark.sparkContext.broadcast((matrix, rows["id"].to_numpy(np.int64), rows["norm"].to_numpy(np.float64)))
        mine = words.where(F.col("round") == r)
        if r:  # in the first round everyone is there; the few users without a state are left out by the task
            mine = mine.join(state.select("userid"), "userid", "left_semi")
        both = state.select("userid", F.lit(0).alias("kind"), "features", "ids", "scores", F.lit(0).alias("word"),
                            F.lit(0).cast("long").alias("bits")).unionByName(
            mine.select("userid", F.lit(1).alias("kind"), "word", "bits"), allowMissingColumns=True)
        # by an expression of its own: an exchange on userid itself may be left out where both sides of
        # the union are hashed by it, and their partitions then need not be merged alike at run time
        both = both.repartition(F.xxhash64("userid")).sortWithinPartitions("userid", "kind", "word")
        state = both.mapInArrow(_round(sent, n, after, block), "userid int, features array<float>, ids array<int>, "
                                "scores array<float>, done boolean")
        state = stored(state, "best-so-far")
        parts.append(state if last else state.where("done"))
        state = state.where("NOT done")
        if last or state.isEmpty():
            break
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    pairs = found.select("userid", F.posexplode(F.arrays_zip("ids", "scores")).alias("i", "x"))
    return pairs.select(F.col("userid").alias(user_col), F.col("x.ids").alias(item_col),
                        F.col("x.scores").alias("prediction"), (F.col("i") + 1).cast("int").alias("rank"))
