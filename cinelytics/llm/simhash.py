"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: text with A-Z lower-cased, words split at ASCII white space,
shingles of ``shingle`` words with repeats (fewer words: the whole sequence; no
word, also null text: fingerprint zero), XXH64 seed 42 of each; a bit is one if
it is set in over half of the hashes.  Texts of equal fingerprints fold into one
row first, so a group of copies of any size costs one row from there on.

Search: the 64 bits map to non-zero vectors of F2^(radius+1).  Table v (one per
non-zero vector v, 2^(radius+1)-1 in all) keeps the bits whose vector has an odd
inner product with v.  At most ``radius`` differing bits span a proper subspace,
so some v is orthogonal to all of them and that table's key is equal: every pair
within the radius collides in some table (Pagh, "Locality-sensitive hashing
without false negatives").  Candidates are checked by their bit distance.

A bucket of more than ``block`` fingerprints is split by the bits again: dealt into
``radius`` + 1 segments, two fingerprints within the radius are equal in one of them, so
each goes to one smaller bucket per segment, and so on with other segments while buckets
are too large.  Bits add up, so few fingerprints fit a bucket after ``LEVELS`` splits; should one
still be too large it is cut into blocks whose pairs are groups.  A group of at most two blocks
yields a spanning forest of its links, never all pairs.  Components come from randomised contraction: each node takes
the neighbour of smallest random rank, the graph shrinks by a constant factor a
round, and every round is a written table.

Null ids take part in linking; a component's id is the smallest non-null id in
it (null if it has none).  Repeated rows are rows of their own with one
fingerprint.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, map_texts, small_side, table

RADIUS = 3
SHINGLE = 3
BLOCK = 2048
LEVELS = 6
SMALL_GROUP = 32

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def text_fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text as an unsigned number."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[k:] for k in range(shingle)))))
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(grams), 32_768):
        raw = b"".join([digest(g, 42) for g in grams[at:at + 32_768]])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(grams)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", shingle: int = SHINGLE,
                 out: str = "fp") -> DataFrame:
    """``keep`` columns plus the fingerprint as a signed long."""
    def make():
        return lambda texts: [[_signed(text_fingerprint(t, shingle)) for t in texts]]

    return map_texts(docs, text_col, make, [T.StructField(out, T.LongType())], keep)


def covering_masks(radius: int = RADIUS) -> list[int]:
    """One 64-bit mask per non-zero vector of F2^(radius+1)."""
    size = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(64) if ((i % size + 1) & v).bit_count() % 2) for v in range(1, size + 1)]


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links (at most ``radius`` bits apart) of one group."""
    left, edges = np.unique(fps).view(np.uint64), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                found = left[near]
                edges += [(x, y) for y in found]
                queue += list(found)
                left = left[~near]
    return edges


def _link_groups(radius: int):
    """mapInArrow function over rows (g1, g2, g3, fp) sorted by group."""
    def links(keys: np.ndarray, fps: np.ndarray):
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        sizes = np.diff(np.r_[starts, len(keys)])
        edges = []
        small = np.repeat(sizes <= SMALL_GROUP, sizes)
        group = np.repeat(np.arange(len(starts)), sizes)
        u = fps.view(np.uint64)
        hit = np.zeros(len(starts), bool)
        for d in range(1, SMALL_GROUP):  # small groups at once: which of them hold a link at all
            same = (group[d:] == group[:-d]) & small[d:]
            if not same.any():
                break
            at = np.flatnonzero(same)
            near = np.bitwise_count(u[at + d] ^ u[at]) <= radius
            hit[group[at[near]]] = True
        for g in np.flatnonzero((hit | (sizes > SMALL_GROUP)) & (sizes > 1)):
            edges += _forest(fps[starts[g]:starts[g] + sizes[g]], radius)
        return edges

    def run(batches):
        held_k, held_f = np.zeros((0, 3), np.int64), np.zeros(0, np.int64)

        def emit(edges):
            pairs = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            lo, hi = pairs.min(axis=1), pairs.max(axis=1)
            return pa.RecordBatch.from_arrays([pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=["u", "v"])

        for b in batches:
            k = np.stack([np.asarray(b.column(i).to_numpy(zero_copy_only=False), np.int64) for i in range(3)], axis=1)
            f = np.asarray(b.column(3).to_numpy(zero_copy_only=False), np.int64)
            k, f = np.concatenate([held_k, k]), np.concatenate([held_f, f])
            if not len(k):
                continue
            last = len(k) - 1
            changed = np.flatnonzero((k != k[last]).any(axis=1))
            end = changed[-1] + 1 if len(changed) else 0  # the last group may go on
            if end:
                yield emit(links(k[:end], f[:end]))
            held_k, held_f = k[end:], f[end:]
        if len(held_k):
            yield emit(links(held_k, held_f))

    return run


def segment_masks(level: int, parts: int) -> list[int]:
    """Masks of the segments that the 64 bits are dealt into at this level of splitting; the
    bits of a segment lie in all segments of the levels before."""
    pairs = ((0, 1), (0, 2), (1, 2))

    def part(i):  # a bit's place in base ``parts``, another digit or sum of digits at each level
        digits = [i // parts ** k % parts for k in range(LEVELS)]
        return digits[level] if parts ** level < 64 else sum(digits[k] for k in pairs[level % 3]) % parts

    return [sum(1 << i for i in range(64) if part(i) == p) for p in range(parts)]


def _buckets(fps: DataFrame, radius: int, block: int) -> DataFrame:
    """bucket, fp, n (size of the bucket): buckets of two or more, split while over ``block``."""
    def as_long(m):
        return F.lit(_signed(m)).cast("long")

    keys = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(as_long(m)))
                     for t, m in enumerate(covering_masks(radius))])
    rows, done = fps.select("fp", F.explode(keys).alias("bucket")), None
    for level in range(LEVELS + 1):
        sizes = cut(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "simhash-buckets")
        rows = rows.join(sizes, "bucket")
        last = level == LEVELS or sizes.where(F.col("n") > block).isEmpty()
        found = rows if last else rows.where(F.col("n") <= block)
        done = found if done is None else done.unionByName(found)
        if last:
            return done
        finer = F.array(*[F.xxhash64(F.lit(level), F.lit(p), F.col("bucket"), F.col("fp").bitwiseAND(as_long(m)))
                          for p, m in enumerate(segment_masks(level, radius + 1))])
        rows = cut(rows.where(F.col("n") > block).select("fp", F.explode(finer).alias("bucket")), "simhash-finer")


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(u, v): links between the distinct values of ``fps.fp`` that connect exactly
    the values connected by "at most ``radius`` differing bits"."""
    rows = _buckets(fps, radius, block)
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("long")
    rows = rows.select("bucket", "fp", blocks.alias("nb"), F.pmod(F.xxhash64(F.lit("block"), "fp"), blocks).alias("b"))
    mates = F.when(F.col("nb") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.array_remove(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1), F.col("b")))
    rows = rows.select("bucket", "fp", "b", F.explode(mates).alias("m"))
    rows = rows.select("bucket", F.least("b", "m").alias("i"), F.greatest("b", "m").alias("j"), "fp")
    rows = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "fp")
    return rows.mapInArrow(_link_groups(radius), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of the nodes that have an edge (u, v).
    Randomised contraction; the number of rounds grows with the logarithm of the
    number of nodes, whatever the components' shape."""
    reps: list[DataFrame] = []
    edges = cut(edges.where("u <> v"), "components-edges")
    while not edges.isEmpty():
        rank = F.xxhash64(F.lit(len(reps)), F.col("other"))
        both = edges.selectExpr("u node", "v other").union(edges.selectExpr("v node", "u other"))
        own = F.struct(F.xxhash64(F.lit(len(reps)), F.col("node")).alias("r"), F.col("node").alias("x"))
        best = both.groupBy("node").agg(F.min(F.struct(rank.alias("r"), F.col("other").alias("x"))).alias("o"))
        rep = cut(best.select("node", F.least(own, "o")["x"].alias("rep")), "components-rep")
        reps.append(rep)
        step = (edges.join(rep.selectExpr("node u", "rep ru"), "u").join(rep.selectExpr("node v", "rep rv"), "v")
                .where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct())
        edges = cut(step, "components-edges")
    spark = edges.sparkSession
    if not reps:
        return spark.createDataFrame([], "node long, root long")
    out = reps[0].selectExpr("node", "rep root")
    for rep in reps[1:]:
        nxt = rep.selectExpr("node root", "rep nxt")
        out = out.join(nxt, "root", "left").select("node", F.coalesce("nxt", "root").alias("root"))
    return out


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, block: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id and group, a fingerprint of the
    component that no other one has (ids may repeat, so component_id doesn't name it)."""
    ids = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = cut(fingerprints(ids, ["doc_id"], "text", shingle), "simhash-fp")
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = cut(components(links(distinct, radius, block)), "simhash-roots")
    linked = roots.join(distinct.withColumnRenamed("fp", "node"), "node")
    firsts = cut(linked.groupBy("root").agg(F.min("first_id").alias("c")), "simhash-firsts")
    named = roots.join(firsts, "root").selectExpr("node AS fp", "root", "c", "true AS linked")
    class_of = cut(distinct.join(named, "fp", "left").select(
        "fp", F.when(F.col("linked"), F.col("c")).otherwise(F.col("first_id")).alias("component_id"),
        F.coalesce("root", "fp").alias("group")), "simhash-class")
    # equal null ids must not fall out: an inner join on fp keeps every row
    return rows.join(class_of, "fp").select("doc_id", "fp", "component_id", "group")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed long), component_id."""
    return _grouped(docs, id_col, text_col, shingle, radius, block).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
               radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """One document of each group, with all columns: the row whose id is the
    component's.  Of rows that repeat an id within a group one stays; rows without
    an id can't be named as copies and pass through."""
    found = cut(_grouped(docs, id_col, text_col, shingle, radius, block).where("doc_id IS NOT NULL"), "simhash-found")
    repeated = cut(found.groupBy("doc_id").count().where("count > 1").select("doc_id"), "simhash-repeated")
    once = repeated.isEmpty()
    key = fresh(docs, "dropped")
    gone = found.where("doc_id <> component_id").select("doc_id")
    gone = (gone if once else gone.union(repeated).distinct()).select(F.col("doc_id").alias(key))
    gone = small_side(gone, F.lit(64))  # else whole texts would move for a few dropped ids
    rest = docs.join(gone, docs[f"`{id_col}`"] == gone[key], "left_anti")
    if once:
        return rest
    # one fingerprint per group and id stays, then one row per fingerprint and id: chosen by
    # partial aggregates over a number for each row, so no task gathers a repeated id's texts
    fp, row, key, fp2, one = (fresh(docs, x) for x in ("fp", "row", "key", "fp2", "one"))
    stay = found.where("doc_id = component_id").groupBy("group", "doc_id").agg(F.min("fp").alias("fp"))
    again = small_side(repeated.select(F.col("doc_id").alias(key)), F.lit(64))
    rows = docs.join(again, docs[f"`{id_col}`"] == again[key], "left_semi")
    rows = fingerprints(rows, docs.columns, text_col, shingle, fp).withColumn(row, F.monotonically_increasing_id())
    rows = cut(rows, "simhash-rows")  # a row keeps its number
    held = rows.select(F.col(f"`{id_col}`").alias(key), F.col(fp).alias(fp2), F.xxhash64(f"`{text_col}`").alias("hash"), F.col(row).alias("row"))
    held = held.groupBy(key, fp2).agg(F.min(F.struct("hash", "row")).alias("best"))
    held = held.join(stay.select(F.col("doc_id").alias(key), F.col("fp").alias(fp2)), [key, fp2]).select(F.col("best.row").alias(one))
    held = small_side(held, F.lit(64))  # else whole texts would move
    columns = [F.col(f"`{c}`") for c in docs.columns]
    stay = rows.join(held, rows[row] == held[one], "left_semi").select(*columns)
    return rest.select(*columns).union(stay)


def q_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9 over whole ``documents``."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
