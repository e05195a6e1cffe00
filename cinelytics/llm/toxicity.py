"""Toxicity by a factorization machine over hashed terms.

Terms: runs of digits, letters and non-ASCII characters, A-Z lower-cased, each
hashed (XXH64) into ``2**BITS`` buckets; a document is the set of its buckets.
score = sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>) over its terms, so pairs such
as an insult and the mention of a group get a weight of their own, which an
additive model can't give.

Training is bounded by its rows alone: at most about ``train_rows`` labelled documents,
chosen by a hash of their id.  Every term that ``min_df`` of them hold is a candidate, however
many there are.  Telling terms are those whose presence differs between the labels in either
direction (log-likelihood ratio from ``MIN_LLR`` on).  All pairs of candidates that occur
together are tested for a weight of their own (log-likelihood ratio of their four cells
against two additive weights, each distinct row once, from ``PAIR_LLR`` on, beyond what chance
gives over all pairs): a group's name is neutral but for an insult beside it.  A Spark task
counts the partners of some terms over the sample, a term at a time, so it holds a counter
per candidate and never a matrix.  The driver holds the sample's rows over the candidates
and fits the model by AdaGrad on the telling terms and the terms of such pairs; the others
tell nothing that the sample can show.
Scoring reads whole texts of all documents.

Labels, language, source and id are never inputs of a score.  Null or empty texts
have no terms and score sigmoid(w0).  Rows without a label or an id don't train;
several labels of one document count as toxic if one of them is.  Without any
training row, with one label only or without such a term, the score is constant, just
under 0.5: nothing is known against any one document, so none is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, enter_stage, fresh, kept, map_texts, table

BITS = 40
TRAIN_ROWS = 20_000
MIN_DF = 8
MIN_LLR = 12.0
PAIR_LLR = 40.0
FACTORS = 8
EPOCHS = 30

_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def term_hashes(text: str) -> np.ndarray:
    """The document's distinct term buckets (a collision of two terms joins them)."""
    import xxhash

    digest, mask = xxhash.xxh64_intdigest, (1 << BITS) - 1
    return np.array([digest(w) & mask for w in set(text.encode("utf-8", "surrogatepass").translate(_TERM).split())], np.int64)


@dataclass
class Model:
    terms: np.ndarray      # sorted buckets
    w0: float
    w: np.ndarray
    v: np.ndarray          # terms x factors

    def active(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.terms) or not len(hashes):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return at[self.terms[at] == hashes]

    def score(self, hashes: np.ndarray) -> float:
        at = np.sort(self.active(hashes))
        v = self.v[at]
        z = self.w0 + self.w[at].sum() + 0.5 * float((v.sum(axis=0) ** 2 - (v ** 2).sum(axis=0)).sum())
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[np.ndarray], y: np.ndarray, terms: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS,
        rate: float = 0.3, l2: float = 2e-4, seed: int = 7, batch: int = 128) -> Model:
    """AdaGrad on the logistic loss; ``rows`` hold indexes into ``terms``.  Rows of the
    rarer label weigh as much in total as the others (at most tenfold a row)."""
    rng = np.random.default_rng(seed)
    n, k = len(rows), len(terms)
    w0, w, v = 0.0, np.zeros(k), rng.normal(0, 0.02, (k, factors))
    if not n or not k or y.min() == y.max():
        return Model(terms, -1e-6, w, np.zeros((k, factors)))
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    weight = np.minimum(weight, 10 * weight.min())
    g0, gw, gv = 1e-8, np.full(k, 1e-8), np.full((k, factors), 1e-8)
    lengths = np.array([len(r) for r in rows])
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            pick = order[at:at + batch]
            cols = np.concatenate([rows[i] for i in pick]) if lengths[pick].sum() else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(len(pick)), lengths[pick])
            vc = v[cols]
            total = np.zeros((len(pick), factors))
            np.add.at(total, doc, vc)
            square = np.bincount(doc, (vc ** 2).sum(axis=1), len(pick))
            z = w0 + np.bincount(doc, w[cols], len(pick)) + 0.5 * ((total ** 2).sum(axis=1) - square)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) * weight[pick] / len(pick)
            dw = np.zeros(k)
            np.add.at(dw, cols, error[doc])
            dv = np.zeros((k, factors))
            np.add.at(dv, cols, error[doc][:, None] * (total[doc] - vc))
            seen = np.unique(cols)
            dw[seen] += l2 * w[seen]
            dv[seen] += 5 * l2 * v[seen]
            g0 += error.sum() ** 2
            w0 -= rate * error.sum() / np.sqrt(g0)
            gw[seen] += dw[seen] ** 2
            gv[seen] += dv[seen] ** 2
            w[seen] -= rate * dw[seen] / np.sqrt(gw[seen])
            v[seen] -= 0.5 * rate * dv[seen] / np.sqrt(gv[seen])
    return Model(terms, float(w0), w, v)


def _entropy(toxic, n):
    """Log-likelihood of ``toxic`` of ``n`` at their own share."""
    clean = n - toxic
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(toxic > 0, toxic * np.log(toxic / n), 0.0) + np.where(clean > 0, clean * np.log(clean / n), 0.0)


def _interaction(n: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each 2 x 2 table (documents ``n``, toxic ``a``) against two
    additive weights, which iterative proportional fitting finds."""
    seen = np.stack([n - a, a], axis=-1)          # pair, first term, second term, label
    m = np.broadcast_to(n[..., None] / 2, seen.shape).copy()
    for _ in range(50):
        for axis in (3, 2, 1):
            now = m.sum(axis=axis, keepdims=True)
            m *= np.divide(seen.sum(axis=axis, keepdims=True), now, out=np.zeros_like(now), where=now > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * np.where(seen > 0, seen * np.log(seen / m), 0.0).sum(axis=(1, 2, 3))


GATHER = 1 << 20  # terms of rows looked at in one step


class _Sample:
    """Rows of indexes as one array, and the rows of each index."""

    def __init__(self, values: np.ndarray, ends: np.ndarray, y: np.ndarray, terms: int):
        self.values, self.ends, self.y, self.terms = values, ends, y, terms
        by_term = np.argsort(values, kind="stable")
        self.docs = (np.searchsorted(ends, by_term, side="right") - 1).astype(np.int32)
        self.first = np.searchsorted(values[by_term], np.arange(terms + 1))
        self.n, self.pos = float(len(y)), float(y.sum())
        self.ni = np.diff(self.first).astype(float)
        self.ai = np.bincount(values, np.repeat(y, np.diff(ends)), terms)
        self.none = _entropy(np.float64(self.pos), np.float64(self.n))
        self.alone = _entropy(self.ai, self.ni) + _entropy(self.pos - self.ai, self.n - self.ni) - self.none

    def _held(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The indexes of some rows, one after another."""
        return self.values[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())]

    def together(self, docs: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The indexes from ``low`` on that ``docs`` hold, how many of these rows hold each and
        how many toxic ones: by sorting where the rows are short beside a counter for every index."""
        start, size = self.ends[docs], self.ends[docs + 1] - self.ends[docs]
        if size.sum() < min(self.terms // 8, GATHER):
            held, label = self._held(start, size), np.repeat(self.y[docs], size)
            later = held >= low
            j, at = np.unique(held[later], return_inverse=True)
            return j.astype(np.int64), np.bincount(at, minlength=len(j)), np.bincount(at, label[later], len(j))
        counts = np.zeros((2, self.terms))
        for label in (0, 1):
            s, n = start[self.y[docs] == label], size[self.y[docs] == label]
            upto = np.cumsum(n)
            steps = np.searchsorted(upto, np.arange(0, upto[-1] if len(upto) else 0, GATHER), side="right")
            for first, end in zip(steps, [*steps[1:], len(n)]):
                counts[label] += np.bincount(self._held(s[first:end], n[first:end]), minlength=self.terms)
        both = counts.sum(axis=0)
        j = np.flatnonzero(both[low:]) + low
        return j, both[j], counts[1][j]

    def partners(self, i: int, telling: np.ndarray, min_llr: float) -> np.ndarray:
        """The indexes after ``i`` that form a pair with it.  Two that never occur together leave
        their common cell empty, which two additive weights always fit."""
        j, n11, a11 = self.together(self.docs[self.first[i]:self.first[i + 1]], i + 1)
        if telling[i]:
            j, n11, a11 = (x[~telling[j]] for x in (j, n11, a11))
        nj, aj = self.ni[j], self.ai[j]
        ni, ai = self.ni[i], self.ai[i]
        ns = [n11, ni - n11, nj - n11, self.n - ni - nj + n11]
        as_ = [a11, ai - a11, aj - a11, self.pos - ai - aj + a11]
        # an additive model fits at least as well as the better of the two terms alone
        cells = sum((_entropy(p, q) for p, q in zip(as_, ns)), np.zeros(len(j))) - self.none
        able = np.flatnonzero(2 * (cells - np.maximum(self.alone[i], self.alone[j])) >= min_llr)
        if not len(able):
            return j[:0]
        tables = [np.stack([c[able] for c in side], axis=-1).reshape(-1, 2, 2) for side in (ns, as_)]
        return j[able[_interaction(*tables) >= min_llr]]


def paired(spark: SparkSession, rows: list[np.ndarray], y: np.ndarray, telling: np.ndarray, min_llr: float = PAIR_LLR) -> np.ndarray:
    """Which terms form a pair with a weight of its own; pairs of two ``telling`` terms,
    which stay anyway, aren't tested.  Equal rows count once."""
    out, k = np.zeros(len(telling), bool), len(telling)
    distinct = {(r.tobytes(), int(t)): r for r, t in zip(rows, y)}
    if not k or not distinct:
        return out
    values = np.concatenate(list(distinct.values())).astype(np.int32)
    ends = np.cumsum([0, *(len(r) for r in distinct.values())])
    # the sample's rows, bounded by train_rows: each task looks up all rows of its terms
    sent = spark.sparkContext.broadcast((values, ends, np.array([t for _, t in distinct], np.int8), telling))
    del distinct, values, ends

    def work(batches):
        import pyarrow as pa

        enter_stage()
        held_values, held_ends, labels, known = sent.value
        held = kept("toxic-pairs", lambda: _Sample(held_values, held_ends, labels, len(known)))
        for batch in batches:
            found = [np.zeros(0, np.int64)]
            for i in batch.column(0).to_pylist():
                with_i = held.partners(i, known, min_llr)
                found += [with_i, np.full(min(len(with_i), 1), i)]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)), pa.int64())], names=["t"])

    parts = max(1, min(k // 64, 4 * spark.sparkContext.defaultParallelism))
    found = spark.range(0, k, 1, parts).mapInArrow(work, "t long").distinct().toArrow()  # a row per term at most
    out[found.column("t").to_numpy()] = True
    sent.destroy()
    return out


def _llr(a, b, pos, neg):
    """G2 = 2 sum of o ln(o / e) for a term in ``a`` of ``pos`` toxic and ``b`` of ``neg`` clean rows."""
    n, df = pos + neg, a + b

    def part(o, e):
        return F.when(o > 0, o * F.log(o / e)).otherwise(0.0)

    return 2 * (part(a, df * pos / n) + part(b, df * neg / n) + part(pos - a, (n - df) * pos / n) + part(neg - b, (n - df) * neg / n))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
          label_col: str = "toxic", train_rows: int = TRAIN_ROWS, min_df: int = MIN_DF) -> Model:
    """Fit on the labelled rows of ``labels`` (the caller leaves held-out rows out)."""
    labels = (labels.select(F.col(f"`{label_id}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y"))
              .where("doc_id IS NOT NULL AND y IS NOT NULL").groupBy("doc_id").agg(F.max("y").alias("y")))
    total = labels.count()
    if total > train_rows:
        slot = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30))
        labels = labels.where(slot < int((1 << 30) * train_rows / total))
    ids = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    # bounded by train_rows ids, so this side may always be sent to the tasks
    rows = ids.join(F.broadcast(labels), "doc_id")
    hashes = [T.StructField("terms", T.ArrayType(T.LongType()))]
    sample = cut(map_texts(rows, "text", lambda: lambda ts: [[term_hashes(t) for t in ts]], hashes, ["y"]), "toxic-sample")
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return fit([np.zeros(0, np.int64)] * (pos + neg), np.array([1] * pos + [0] * neg), np.zeros(0, np.int64))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    tally = [F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")]
    counts = (sample.select(F.explode("terms").alias("t"), "y").groupBy("t").agg(*tally)
              .where(F.col("a") + F.col("b") >= min_df)
              .withColumn("llr", _llr(a, b, F.lit(float(pos)), F.lit(float(neg)))))
    found = counts.select("t", (F.col("llr") >= MIN_LLR).alias("telling")).toArrow()  # bounded by the sample's terms
    terms, telling = found.column("t").to_numpy(), found.column("telling").to_numpy(zero_copy_only=False)
    order = np.argsort(terms)
    terms, telling = terms[order], telling[order].astype(bool)
    rows, y = _rows(sample, terms)
    keep = telling | paired(docs.sparkSession, rows, y, telling)
    place = np.cumsum(keep) - 1
    return fit([place[r[keep[r]]] for r in rows], y, terms[keep])


def _lists(column) -> list[np.ndarray]:
    """The rows of an Arrow list column as views: no Python number per term."""
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends, ends[1:])]


def _rows(sample: DataFrame, terms: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Each row's indexes into ``terms``, and the labels."""
    model = Model(terms, 0.0, np.zeros(len(terms)), np.zeros((len(terms), 1)))

    def only_chosen(batches):
        import pyarrow as pa

        enter_stage()
        for batch in batches:
            at = [np.sort(model.active(t)).astype(np.int32) for t in _lists(batch.column(0))]
            ends = pa.array(np.cumsum([0, *map(len, at)]), pa.int32())
            values = pa.array(np.concatenate(at) if at else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, values), batch.column(1)], names=["at", "y"])

    got = sample.select("terms", "y").mapInArrow(only_chosen, "at array<int>, y int").toArrow()
    rows, y = _lists(got.column("at").combine_chunks()), got.column("y").to_numpy()  # views of the Arrow buffers
    order = sorted(range(len(rows)), key=lambda i: (rows[i].astype(">i4").tobytes(), y[i]))  # one order on any cluster
    return [rows[i] for i in order], y[order]


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) plus the score of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        held = sent.value
        return lambda texts: [[held.score(term_hashes(t)) for t in texts]]

    return map_texts(docs, text_col, make, [T.StructField(out, T.DoubleType())], docs.columns if keep is None else keep)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The documents scored under 0.5, with all their columns."""
    model = train(docs, labels.where(~held_out()), id_col, text_col, **params)
    name = fresh(docs, "score")
    return score(docs, model, text_col, name).where(F.col(name) < 0.5).drop(name)


def q_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7 over whole ``documents``; labels of held-out rows never train."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out()))
    out = score(docs, model, keep=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
