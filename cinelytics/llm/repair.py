"""Conversation structure repair by rank-convergence parallel Viterbi.

A conversation's rows, ordered by turn (nulls first, ties by role, then by the md5 of the
text), should have role initials ``(s?(ua)+)?``.  Each row is kept (cost 0), given the
role user or assistant (1) or deleted (2); empty user or assistant rows may be inserted
anywhere (5 each); a truncated row that stays costs 5 more; blank and duplicate rows must
go.  ``repair`` finds the cheapest edits and, among these, the ASCII-least string of
their initials (D, I, K, R).

The grammar has four states (nothing yet, after s, after u, after a), so the cost of the
best way to the end is a vector of four numbers per row, computed backwards.  A forced
deletion adds the same to all four and is left out.  What is left of a conversation is
cut into chunks of ``chunk`` rows (Maleki, Musuvathi, Mytkowicz: "Parallelizing dynamic
programming through rank convergence"):

* every chunk of a conversation with several chunks starts from a speculative vector;
* a fix-up pass reruns the chunks from the vectors that the last pass found at chunk
  borders.  A rerun ends as soon as its vector differs from an earlier run's at that row
  by a constant only, as all before it is equal then.  Vectors count without their
  constant, so there are few of them (differences are at most 12) whatever the data, and
  the passes end when no border shows a new one, not after one pass per chunk;
* the borders are stitched from the last chunk to the first, which gives each chunk its
  true backward costs, and each chunk's way through its rows from the first chunk on.

The four-number step is a lookup, since few (row code, vector) pairs exist.

Scale: rows are reduced to their distinct (conversation, turn, role, text) with a count
before they meet, so equal rows of any number are one record; only md5 digests and flags
are range-ordered; the texts move once to meet their edits and, for ``digest`` alone, once
more into the order of their conversation.  A hot conversation is spread over range
partitions and chunks.  By its contract the audit is one value with a letter a row, and a
SHA-256 has to see its text in order: ``digest`` streams a conversation through one task
in constant memory.

Nulls in any column read as one space, a null conversation id groups the rows without
one, null turns sort first and count in no gap.  Empty texts are blank.  Repeated rows are
rows of their own (duplicates after the first).  An empty table gives no conversations.
Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, small_side, table

CHUNK = 65_536
WHITE = " \t\n\x0b\f\r"
DELETE, RENAME, INSERT, STAYS = 2, 1, 5, 5
START, AFTER_S, AFTER_U, AFTER_A = range(4)
KINDS = "sua"
#: Cost from each state after the last row: start and "a" end, "u" lacks an a, "s" lacks ua.
END = (0, 2 * INSERT, INSERT, 0)
GUESS = (0, 0, 0, 0)
_NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)  # where an inserted or renamed row leads
_TAIL = 1 << 62


def _emits(state: int) -> str:
    return "a" if state == AFTER_U else "u"


@cache
def step(code: int, after: tuple[int, ...]):
    """One live row backwards: the vector before it (less its least entry) and, for each
    state, (letters, roles, next state) of the least edits up to and including this row.

    ``code`` is the kind of role (place in KINDS, 3 for others) + 4 if truncated; roles
    holds u or a for an inserted or renamed row, k for a kept one, - for a deleted one."""
    kind, stays = code % 4, STAYS * (code // 4)
    own = []
    for s in range(4):
        ways = [(DELETE + after[s], "D", "-", s)]
        keeps = (kind == 0 and s == START) or (kind < 3 and KINDS[kind] == _emits(s))
        if keeps:
            to = AFTER_S if kind == 0 else _NEXT[s]
            ways.append((stays + after[to], "K", "k", to))
        ways.append((RENAME + stays + after[_NEXT[s]], "R", _emits(s), _NEXT[s]))
        own.append(ways)
    plain = [min(w[0] for w in ways) for ways in own]
    u = min(plain[AFTER_U], INSERT + plain[AFTER_A])
    a = min(plain[AFTER_A], INSERT + plain[AFTER_U])
    best = (min(plain[START], INSERT + u), min(plain[AFTER_S], INSERT + u), u, a)

    def least(s):
        letters = roles = ""
        while True:
            ways = {w[1]: w for w in own[s] if w[0] == best[s]}
            if "D" not in ways and INSERT + best[_NEXT[s]] == best[s]:
                letters, roles, s = letters + "I", roles + _emits(s), _NEXT[s]
                continue
            _, letter, role, to = ways[min(ways)]
            return letters + letter, roles + role, to

    low = min(best)
    return tuple(x - low for x in best), tuple(least(s) for s in range(4))


def normal(vector) -> tuple[int, ...]:
    low = min(vector)
    return tuple(x - low for x in vector)


def backward(codes, end, earlier=None) -> list[tuple[int, ...]]:
    """Vectors after each row and, first, before the first one.  ``earlier`` is such a list
    of another run: where the two meet, the rest is taken from it."""
    vectors = [None] * (len(codes) + 1)
    vectors[-1] = v = normal(end)
    for i in range(len(codes) - 1, -1, -1):
        if earlier is not None and earlier[i + 1] == v:
            vectors[:i + 1] = earlier[:i + 1]
            break
        vectors[i] = v = step(codes[i], v)[0]
    return vectors


def forward(codes, vectors, state: int):
    """The least edits of each row from ``state`` on, and the state behind the last."""
    out = []
    for i, code in enumerate(codes):
        letters, roles, state = step(code, vectors[i + 1])[1][state]
        out.append((letters, roles))
    return out, state


def tail(state: int) -> tuple[str, str]:
    """Insertions behind the last row."""
    return {START: ("", ""), AFTER_S: ("II", "ua"), AFTER_U: ("I", "a"), AFTER_A: ("", "")}[state]


def _pack(vector) -> int:
    return sum(x << (8 * i) for i, x in enumerate(vector))


def _unpack(number: int) -> tuple[int, ...]:
    return tuple((number >> (8 * i)) & 255 for i in range(4))


# ------------------------------------------------------------------ records --

def _row_key(*cols: Column) -> Column:
    """md5 over columns, nulls and borders told apart."""
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in cols]
    return F.md5(F.concat(*parts).cast("binary"))


def _typed(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n (equal rows); nulls of role and text as one space."""
    space = F.lit(" ")
    cols = [F.col("conv_id"), F.col("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text")]
    return rows.select(*cols, (F.col("n") if "n" in rows.columns else F.lit(1)).cast("long").alias("n"))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", _row_key(F.col("conv_id").cast("string"), F.col("turn").cast("string"),
                                           F.col("role"), F.col("text")))


def _records(rows: DataFrame) -> DataFrame:
    """Distinct rows without their texts, in order: pos is a global order number, part
    (its upper bits) the range partition."""
    bare = F.rtrim("text", F.lit(WHITE))
    light = _keyed(rows).select(
        "conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"), "key", "n", (bare == "").alias("blank"),
        F.substring(bare, -1, 1).isin(".", "!", "?").alias("ended"))
    light = light.groupBy("conv_id", "turn", "role", "digest", "key", "blank", "ended").agg(F.sum("n").alias("n"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    ordered = light.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = cut(ordered.withColumn("pos", F.monotonically_increasing_id()), "repair-ordered")
    return ordered.withColumn("part", F.shiftright("pos", 33))


def _marked(records: DataFrame) -> DataFrame:
    """Records with ``live``: not blank, and the first of its conversation with this role and text."""
    again = records.groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("first"), F.count("*").alias("c"))
    again = again.where("c > 1").selectExpr("conv_id c2", "role r2", "digest d2", "first")
    again = small_side(cut(again, "repair-again"), F.lit(160))
    out = records.join(again, records["conv_id"].eqNullSafe(again["c2"]) & (records["role"] == again["r2"])
                       & (records["digest"] == again["d2"]), "left")
    live = ~F.col("blank") & (F.col("first").isNull() | (F.col("first") == F.col("pos")))
    return cut(out.select(*records.columns, live.alias("live"), F.substring("role", 1, 1).alias("ini")), "repair-marked")


def _pieces(marked: DataFrame) -> DataFrame:
    """One row per (conversation, range partition): its counts, borders and the number of
    live rows in the pieces before it."""
    w = Window.partitionBy("part", "conv_id").orderBy("pos")
    live = F.col("live").cast("long")
    rows = marked.select("*", F.lag("ini").over(w).alias("ini0"), F.lag("turn").over(w).alias("turn0"))
    rows = rows.withColumns({
        "bad": F.col("n") - 1 + (F.col("ini0").isNotNull() & ~F.concat("ini0", "ini").isin("su", "ua", "au")).cast("long"),
        "new": (F.col("turn").isNotNull() & ~F.coalesce(F.col("turn") == F.col("turn0"), F.lit(False))).cast("long")})
    count = {
        "blank": F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)),
        "duplicate": F.sum(F.when(F.col("blank"), 0).otherwise(F.col("n") - live)),
        "truncated": F.sum((F.col("live") & ~F.col("ended")).cast("long")),
        "illegal": F.sum("bad"), "turns": F.sum("new"), "n_live": F.sum(live),
        "low": F.min("turn"), "high": F.max("turn"), "ini1": F.min_by("ini", "pos"), "ini2": F.max_by("ini", "pos"),
        "turn1": F.min_by("turn", "pos"), "turn2": F.max_by("turn", "pos")}
    pieces = rows.groupBy("conv_id", "part").agg(*[c.alias(k) for k, c in count.items()])
    w = Window.partitionBy("conv_id").orderBy("part")
    before = F.lag("ini2").over(w)
    pieces = pieces.withColumns({
        "bad": F.coalesce((~F.concat(before, "ini1").isin("su", "ua", "au")).cast("long"), F.lit(0)),
        "same": F.coalesce((F.lag("turn2").over(w) == F.col("turn1")).cast("long"), F.lit(0)),
        "offset": F.coalesce(F.sum("n_live").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    return cut(pieces, "repair-pieces")


def _summary(pieces: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal."""
    gaps = F.coalesce(F.max("high") - F.min("low") + 1 - F.sum(F.col("turns") - F.col("same")), F.lit(0))
    return pieces.groupBy("conv_id").agg(
        gaps.cast("long").alias("gaps"), F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"),
        F.sum("truncated").alias("truncated"), F.sum(F.col("illegal") + F.col("bad")).alias("illegal"))


def _chunks(marked: DataFrame, pieces: DataFrame, chunk: int) -> DataFrame:
    """conv_id, chunk, last, codes, places: the live rows, ``chunk`` of them at most."""
    w = Window.partitionBy("part", "conv_id").orderBy("pos")
    kind = F.when(F.col("ini").isin(*KINDS), F.instr(F.lit(KINDS), F.col("ini")) - 1).otherwise(3)
    live = marked.where("live").select("conv_id", "part", "pos", (F.row_number().over(w) - 1).alias("at"),
                                       (kind + F.when(F.col("ended"), 0).otherwise(4)).cast("int").alias("code"))
    # only a conversation that goes on from the partition before has an offset: one a partition
    moved = small_side(pieces.where("offset > 0").selectExpr("conv_id c2", "part p2", "offset"), F.lit(128))
    live = live.join(moved, live["conv_id"].eqNullSafe(moved["c2"]) & (live["part"] == moved["p2"]), "left")
    number = F.col("at") + F.coalesce("offset", F.lit(0))
    groups = live.withColumn("chunk", F.floor(number / chunk).cast("long")).groupBy("conv_id", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("rows"))
    w = Window.partitionBy("conv_id")
    return cut(groups.select("conv_id", "chunk", (F.max("chunk").over(w)).alias("last"), F.col("rows.code").alias("codes"),
                             F.col("rows.pos").alias("places")), "repair-chunks")


# ------------------------------------------------------------------ Viterbi --

def _runs(ends: list[int]):
    """mapInArrow function: every chunk from each border vector of ``ends``."""
    def run(batches):
        for b in batches:
            codes_of, out = b.column(2), [[], [], [], [], []]
            for i in range(b.num_rows):
                codes, earlier = codes_of[i].as_py(), None
                for end in ends:
                    vectors = backward(codes, _unpack(end), earlier)
                    earlier = earlier or vectors
                    exits = sum(forward(codes, vectors, s)[1] << (2 * s) for s in range(4))
                    for col, x in zip(out, (b.column(0)[i].as_py(), b.column(1)[i].as_py(), end, _pack(vectors[0]), exits)):
                        col.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], b.schema.field(0).type)] + [pa.array(c, pa.int64()) for c in out[1:]],
                names=["conv_id", "chunk", "v_end", "v_begin", "exits"])

    return run


def _stitch(batches):
    """Rows (conv_id, chunk, last, v_end, v_begin, exits) by conversation, last chunk first, to
    (conv_id, chunk, v_end, entry).  Holds one pair of numbers a chunk of one conversation."""
    held, conv, seen = [], None, False
    want = None  # (chunk, vector) whose run is the true one

    def flush():
        state, cols = START, [[], [], [], []]
        for chunk, end, exits in reversed(held):
            for col, x in zip(cols, (conv, chunk, end, state)):
                col.append(x)
            state = (exits >> (2 * state)) & 3
        return cols

    def batch(cols, kind):
        return pa.RecordBatch.from_arrays([pa.array(cols[0], kind)] + [pa.array(c, pa.int64()) for c in cols[1:]],
                                          names=["conv_id", "chunk", "v_end", "entry"])

    kind = None
    for b in batches:
        kind = b.schema.field(0).type
        for c, chunk, last, end, begin, exits in zip(*[col.to_pylist() for col in b.columns]):
            if not seen or c != conv:
                if held:
                    yield batch(flush(), kind)
                held, conv, seen, want = [], c, True, (last, _pack(END))
            if (chunk, end) == want:
                held.append((chunk, end, exits))
                want = (chunk - 1, begin)
    if held:
        yield batch(flush(), kind)


def _borders(chunks: DataFrame) -> DataFrame:
    """conv_id, chunk, v_end, entry for the chunks of conversations with several chunks."""
    many = chunks.where("last > 0").select("conv_id", "chunk", "codes")
    schema = f"conv_id {chunks.schema['conv_id'].dataType.simpleString()}, chunk long, v_end long, v_begin long, exits long"
    known, new, runs = set(), {_pack(GUESS), _pack(END)}, None
    while new:
        # a few dozen vectors at most, whatever the data: entries differ by 12 at most
        found = cut(many.mapInArrow(_runs(sorted(new)), schema), "repair-runs")
        runs = found if runs is None else runs.unionByName(found)
        known |= new
        new = {r[0] for r in found.select("v_begin").distinct().collect()} - known
    lasts = runs.join(chunks.where("last > 0 AND chunk = 0").selectExpr("conv_id c2", "last"),
                      F.col("conv_id").eqNullSafe(F.col("c2")))
    order = [F.col("conv_id"), F.col("chunk").desc(), F.col("v_end")]
    rows = lasts.select("conv_id", "chunk", "last", "v_end", "v_begin", "exits").repartition("conv_id").sortWithinPartitions(*order)
    plan = f"conv_id {chunks.schema['conv_id'].dataType.simpleString()}, chunk long, v_end long, entry long"
    return cut(rows.mapInArrow(_stitch, plan), "repair-borders")


def _trace(batches):
    """Rows (conv_id, chunk, last, codes, places, v_end, entry) to edits other than a plain D."""
    for b in batches:
        convs, places, letters, roles = [], [], [], []
        for conv, chunk, last, codes, pos, end, entry in zip(*[c.to_pylist() for c in b.columns]):
            vectors = backward(codes, END if end is None else _unpack(end))
            edits, state = forward(codes, vectors, START if entry is None else entry)
            found = [(p, *e) for p, e in zip(pos, edits) if e[0] != "D"]
            if chunk == last and tail(state)[0]:
                found.append((_TAIL, *tail(state)))
            convs += [conv] * len(found)
            places += [f[0] for f in found]
            letters += [f[1] for f in found]
            roles += [f[2] for f in found]
        yield pa.RecordBatch.from_arrays([pa.array(convs, b.schema.field(0).type), pa.array(places, pa.int64()),
                                          pa.array(letters, pa.string()), pa.array(roles, pa.string())],
                                         names=["conv_id", "pos", "letters", "roles"])


def _edits(chunks: DataFrame) -> DataFrame:
    """conv_id, pos, letters, roles of each live row that isn't just deleted, and of the tail."""
    if chunks.where("last > 0").isEmpty():
        rows = chunks.withColumns({"v_end": F.lit(None).cast("long"), "entry": F.lit(None).cast("long")})
    else:
        plan = _borders(chunks).withColumnsRenamed({"conv_id": "c2", "chunk": "k2"})
        rows = chunks.join(plan, chunks["conv_id"].eqNullSafe(plan["c2"]) & (chunks["chunk"] == plan["k2"]), "left")
    rows = rows.select("conv_id", "chunk", "last", "codes", "places", "v_end", "entry")
    schema = f"conv_id {chunks.schema['conv_id'].dataType.simpleString()}, pos long, letters string, roles string"
    return cut(rows.mapInArrow(_trace, schema), "repair-edits")


# ----------------------------------------------------------------- operator --

class Repair(NamedTuple):
    #: conv_id, gaps, blank, duplicate, truncated, illegal: one row per conversation with rows
    faults: DataFrame
    #: conv_id, part, pos, turn, role, n, letters, roles, cost, key: one row per distinct row, and one for the tail
    script: DataFrame
    #: conv_id, pos, letters, roles, role, text: the records whose rows remain
    kept: DataFrame


def repair(rows: DataFrame, chunk: int = CHUNK) -> Repair:
    """``rows``: conv_id, turn, role, text and, optionally, n (equal rows)."""
    rows = _typed(rows)
    marked = _marked(_records(rows))
    pieces = _pieces(marked)
    edits = _edits(_chunks(marked, pieces, chunk))
    own = edits.where(F.col("pos") < _TAIL).select(F.col("pos").alias("p2"), "letters", "roles")
    stays = F.when(F.col("letters").rlike("[KR]") & ~F.col("ended"), STAYS).otherwise(0)
    price = (F.length(F.regexp_replace("letters", "[^I]", "")) * INSERT + F.length(F.regexp_replace("letters", "[^R]", "")) * RENAME
             + F.length(F.regexp_replace("letters", "[^D]", "")) * DELETE + stays + (F.col("n") - 1) * DELETE)
    script = marked.join(own, marked["pos"] == own["p2"], "left").withColumns(
        {"letters": F.coalesce("letters", F.lit("D")), "roles": F.coalesce("roles", F.lit("-"))})
    script = script.select("conv_id", "part", "pos", "turn", "role", "n", "letters", "roles", price.cast("long").alias("cost"), "key")
    ends = edits.where(F.col("pos") == _TAIL).select(
        "conv_id", F.shiftright(F.lit(_TAIL), 33).alias("part"), "pos", F.lit(None).cast(script.schema["turn"].dataType).alias("turn"),
        F.lit(None).cast("string").alias("role"), F.lit(1).cast("long").alias("n"), "letters", "roles",
        (F.length("letters") * INSERT).cast("long").alias("cost"), F.lit(None).cast("string").alias("key"))
    script = cut(script.unionByName(ends), "repair-script")
    texts = _keyed(rows).groupBy("key").agg(F.first("text").alias("text")).withColumnRenamed("key", "k2")
    out = script.where("roles <> '-'")
    kept = out.where(F.col("letters").rlike("[KR]")).join(texts, F.col("key") == F.col("k2"))
    kept = kept.select("conv_id", "pos", "letters", "roles", "role", "text").unionByName(
        out.where(~F.col("letters").rlike("[KR]")).select("conv_id", "pos", "letters", "roles", "role", F.lit(None).cast("string").alias("text")))
    return Repair(_summary(pieces), script, kept)


def repaired_rows(done: Repair) -> DataFrame:
    """conv_id, pos, seq, edit, role, text: the repaired conversations, a row per turn;
    (pos, seq) is their order."""
    each = done.kept.select("*", F.posexplode(F.split("letters", "(?<=.)(?=.)")).alias("seq", "edit"))
    to = F.substring(F.col("roles"), F.col("seq") + 1, F.lit(1))
    role = F.when(to == "k", F.col("role")).otherwise(F.when(to == "u", "user").otherwise("assistant"))
    return each.where("edit <> 'D'").select("conv_id", "pos", "seq", "edit", role.alias("role"),
                                            F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))


def audits(done: Repair) -> DataFrame:
    """conv_id, audit, cost.  Strings are joined per range partition first."""
    letters = F.concat("letters", F.repeat(F.lit("D"), (F.col("n") - 1).cast("int")))
    piece = done.script.groupBy("conv_id", "part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", letters.alias("x")))), lambda r: r["x"]), "").alias("x"),
        F.sum("cost").alias("cost"))
    return piece.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "x"))), lambda r: r["x"]), "").alias("audit"),
        F.sum("cost").alias("cost"))


def _hash(batches):
    """Rows (conv_id, pos, seq, role, text) in order to (conv_id, sha256 of role:text lines)."""
    conv, state, started, kind = None, None, False, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([state.hexdigest()], pa.string())],
                                          names=["conv_id", "repaired_sha256"])

    for b in batches:
        kind = b.schema.field(0).type
        for c, role, text in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
            line = f"{role}:{text}".encode("utf-8", "surrogatepass")
            if not started or c != conv:
                if started:
                    yield row()
                conv, state, started = c, hashlib.sha256(line), True
            else:
                state.update(b"\n" + line)
    if started:
        yield row()


def digest(done: Repair) -> DataFrame:
    """conv_id, repaired_sha256 of the repaired rows, for conversations that have any."""
    rows = repaired_rows(done).select("conv_id", "pos", "seq", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "seq")
    return rows.mapInArrow(_hash, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """The test damage by crc32("conv_id:turn") mod 20 (nulls read as one space): 0 drops the
    row, 1 empties its text, 2 removes its [.!?], 3 repeats it, 4 makes its role user."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    k = F.crc32(name.cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    return rows.select("conv_id", "turn", "role", "text", k.alias("k")).where("k <> 0").select(
        "conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(F.col("k") == 3, 2).otherwise(1).alias("n"))


def q_repair(spark: SparkSession, sf_dir: str, chunk: int = CHUNK) -> DataFrame:
    """op12 over whole ``conversations``: damaged by the fixed rule, then repaired."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return summary(rows, chunk)


def summary(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """op12's digest columns for every conversation id of ``rows`` (before damage)."""
    done = repair(damage(rows), chunk)
    parts = rows.select("conv_id").distinct()
    for found in (done.faults, audits(done), digest(done)):
        parts = parts.unionByName(found, allowMissingColumns=True)
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    out = parts.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
    return out.select("conv_id", *counts[:5], "cost", "audit", "repaired_sha256")


#: CRC-32 of a text in DuckDB: the table from the polynomial, then one fold over the UTF-8 bytes.
SQL_CRC_TABLE = """SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))"""


def sql_crc(text: str, t: str) -> str:
    return f"""xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({text}, ''), lambda x:
      CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [(192 + (unicode(x) >> 6))::BIGINT, (128 + (unicode(x) & 63))::BIGINT] END))),
      lambda c, b: xor(c >> 8, {t}[(xor(c, b) & 255) + 1])), 4294967295)"""


def _sql_best(*ways: str) -> str:
    return f"list_min([{', '.join(w for w in ways if w)}])"


def _sql_way(cost: str, letter: str, line: str | None, rest: str) -> str:
    """One edit before ``rest``: a struct (cost, audit, lines) compared in that order."""
    r = f"{rest}.r" if line is None else f"list_concat([{line}], {rest}.r)"
    return f"{{'c': ({cost}) + {rest}.c, 'a': '{letter}' || {rest}.a, 'r': {r}}}"


def _sql_row(state: str) -> str:
    """The best of the edits that use up the row, from ``state`` (S, P, U, A)."""
    to, initial, role = ("w.va", "a", "assistant") if state == "U" else ("w.vu", "u", "user")
    own = f"w.v{state.lower()}"
    stays = "CASE WHEN b.fault = 't' THEN 5 ELSE 0 END"
    line = "b.role || ':' || b.text"
    first = f"WHEN b.ini = 's' THEN {_sql_way(stays, 'K', line, 'w.vp')}" if state == "S" else ""
    keep = f"CASE {first} WHEN b.ini = '{initial}' THEN {_sql_way(stays, 'K', line, to)} END"
    rename = _sql_way(f"1 + {stays}", "R", f"'{role}:' || b.text", to)
    delete = _sql_way("2", "D", None, own)
    return f"CASE WHEN b.fault IN ('b', 'd') THEN {delete} ELSE {_sql_best(delete, keep, rename)} END"


_V = "{'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]}"
SQL = rf"""
WITH RECURSIVE tab AS ({SQL_CRC_TABLE}),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {sql_crc("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))", "tab.t")} % 20 AS k FROM conversations, tab),
dam AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy FROM src WHERE k <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i,
        rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM dam),
b AS (SELECT *, left(role, 1) AS ini, CASE WHEN bare = '' THEN 'b'
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
        WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS ini0 FROM num),
facts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
        count(*) FILTER (fault = 't') AS truncated,
        count(*) FILTER (ini0 IS NOT NULL AND ini0 || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM b GROUP BY conv_id),
walk AS (SELECT conv_id, n AS i, {_V} AS vs, {{'c': 10::BIGINT, 'a': 'II', 'r': ['user:', 'assistant:']}} AS vp,
        {{'c': 5::BIGINT, 'a': 'I', 'r': ['assistant:']}} AS vu, {_V} AS va FROM facts
  UNION ALL
  SELECT conv_id, i, {_sql_best('rs', _sql_way('5', 'I', "'user:'", 'u'))}, {_sql_best('rp', _sql_way('5', 'I', "'user:'", 'u'))}, u, a
  FROM (SELECT *, {_sql_best('ru', _sql_way('5', 'I', "'assistant:'", 'ra'))} AS u, {_sql_best('ra', _sql_way('5', 'I', "'user:'", 'ru'))} AS a
    FROM (SELECT w.conv_id, w.i - 1 AS i, {_sql_row('S')} AS rs, {_sql_row('P')} AS rp, {_sql_row('U')} AS ru, {_sql_row('A')} AS ra
      FROM walk w JOIN b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.i = w.i))),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(vs.c, 0) AS BIGINT) AS cost, coalesce(vs.a, '') AS audit,
  sha256(coalesce(array_to_string(vs.r, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM ids.conv_id
  LEFT JOIN (SELECT * FROM walk WHERE i = 0) w ON w.conv_id IS NOT DISTINCT FROM ids.conv_id"""
