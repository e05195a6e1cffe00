"""Brute-force checks of operators 3, 6, 7 and 10 where a plain definition can be written down."""

import itertools
import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cinelytics.llm import common, licenses, linededup, toxicity, urlrules

from .test_llm_operators import ODD, _sorted, brute_lines, docs_of, line_rows, small_docs

# --------------------------------------------------------------------- op3 --


class Everywhere(licenses.Scanner):
    """No seeding: a window at every word that the template has."""

    def __init__(self, *args):
        super().__init__(*args)
        self.needed = [1] * len(self.needed)

    def regions(self, t, words, at):
        size, own = len(self.templates[t][1]), set(self.places[t])
        for lo, w in enumerate(words):
            if w in own:
                lo = max(0, lo - 2)
                yield lo, min(len(words), lo + size + max(2, size // 4))


def short_templates():
    return [(n, t) for n, t in licenses.TEMPLATES if len(licenses.words_of(t)) < licenses.LONG]


def test_seeding_loses_nothing_on_the_whole_table(spark):
    fast, plain = (kind(short_templates(), licenses.MIN_COVERAGE) for kind in (licenses.Scanner, Everywhere))
    texts = {r["text"] for r in small_docs(spark).collect() if r["text"]}
    # the scan reads words only, so each different line stands for all its copies
    lines = sorted({x for t in texts for x in t.split("\n")})
    found = 0
    for x in lines:
        want = plain.scan(x)
        assert fast.scan(x) == want, x
        found += len(want)
    assert found


def lcs(a, b):
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        hit = np.r_[0, row[:-1] + np.array([x == y for y in b])]
        row = np.maximum.accumulate(np.maximum(row, hit))
    return int(row[-1])


@pytest.mark.parametrize("seed", range(3))
def test_clustered_edits_are_found(seed):
    """A run of words replaced, dropped or put in, anywhere in a notice: coverage and place by
    the longest common subsequence."""
    rng = random.Random(seed)
    scanner = licenses.Scanner(short_templates(), licenses.MIN_COVERAGE)
    noise = [f"zz{i}" for i in range(40)]
    seen = missed = 0
    for name, text in short_templates():
        words = [w.decode() for w in licenses.words_of(text)]
        cut = int(0.1 * len(words))
        if cut < 2:
            continue
        at = rng.randrange(1, len(words) - cut)
        for edited in (words[:at] + rng.sample(noise, cut) + words[at + cut:], words[:at] + words[at + cut:],
                       words[:at] + rng.sample(noise, cut) + words[at:]):
            body = ["before", *edited, "after"]
            best = lcs([w.encode() for w in edited], licenses.words_of(text)) / len(words)
            found = [x for x in scanner.scan(" ".join(body)) if x[0] == name]
            seen += 1
            if not found:  # a decisive word (a name, a version) may be in the cluster
                missed += 1
                continue
            assert best - 0.05 <= found[0][1] <= best and found[0][2] <= 1 + cut and found[0][3] >= len(edited) - cut
    assert seen and missed <= 0.2 * seen


# --------------------------------------------------------------------- op6 --

def brute_verdicts(train, pages, min_support=0.01, min_confidence=0.9):
    """Every body of up to three tokens, as the definition says."""
    passing = {}
    for body in {c for t, _ in train for n in (1, 2, 3) for c in itertools.combinations(sorted(t), n)}:
        held = [b for t, b in train if set(body) <= t]
        if sum(held) >= min_support * len(train) and sum(held) / len(held) >= min_confidence:
            passing[body] = sum(held) / len(held)
    out = {}
    for i, t in pages:
        hits = [(c, -len(b), " ".join(b)) for b, c in passing.items() if set(b) <= t]
        out[i] = max(hits)[2] if hits else None
    return out


def tokens_of(keys, host="a.com"):
    return {*(f"h:{x}" for x in host.split(".")), *(f"q:{k}" for k in keys)}


def test_tokens_that_always_come_together(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        form = i % 3  # two forms of five fixed keys each, and loose keys
        keys = [f"f{form}k{j}" for j in range(5)] if form < 2 else rng.sample("xyz", 2)
        keys = [*keys, *rng.sample("uvw", rng.randint(0, 2))]
        rows.append((i, keys, form == 0 and "u" in keys or "x" in keys and "y" in keys))
    # parts of a form, seen in no labelled url
    loose = [(200, ["f0k1", "u"]), (201, ["f0k4", "f0k2", "u", "q"]), (202, ["f1k0", "u"]), (203, ["x", "y"]), (204, []), (205, ["f0k3"])]
    pages = docs_of(spark, [(i, f"http://a.com/?{'&'.join(f'{k}=1' for k in keys)}") for i, keys, *_ in [*rows, *loose]], "page_id long, url string")
    labels = docs_of(spark, [(i, bool(b)) for i, _, b in rows], "page_id long, blocked boolean")
    got = {r["page_id"]: r for r in urlrules.judge(pages, labels, rules=()).collect()}
    want = brute_verdicts([(tokens_of(k), bool(b)) for _, k, b in rows], [(i, tokens_of(k)) for i, k, *_ in [*rows, *loose]])
    assert {i: r["mined_rule"] for i, r in got.items()} == want
    assert all((r["verdict"] == "block") == (want[i] is not None) for i, r in got.items())
    assert want[200] and want[201] and not want[202] and want[203]


def test_forty_shared_tokens_end(spark):
    keys = "&".join(f"k{j}=1" for j in range(40))
    pages = docs_of(spark, [(i, f"http://h{i % 2}.com/?{keys}" if i % 3 else f"http://h{i % 2}.com/") for i in range(90)], "page_id long, url string")
    labels = docs_of(spark, [(i, bool(i % 3) and i % 2 == 0) for i in range(90)], "page_id long, blocked boolean")
    got = urlrules.judge(pages, labels, rules=()).collect()
    assert all((r["verdict"] == "block") == (r["page_id"] % 3 != 0 and r["page_id"] % 2 == 0) for r in got)


def test_hand_ruled_pages_change_no_mined_rule(spark):
    rows = [(i, f"http://h{i % 4}.com/p{'x' if i % 8 < 4 else 'y'}") for i in range(80)]
    labels = docs_of(spark, [(i, i % 8 == 1) for i in range(80)], "page_id long, blocked boolean")
    def judged(rows):
        found = urlrules.judge(docs_of(spark, rows, "page_id long, url string"), labels)
        return {r["page_id"]: (r["verdict"], r["mined_rule"]) for r in found.collect() if r["page_id"] < 80}
    alone = judged(rows)
    assert alone == judged(rows + [(1000 + i, f"http://x.net/p{'x' if i % 2 else 'y'}") for i in range(4000)])
    assert {v for v, _ in alone.values()} == {"allow", "block"}


# --------------------------------------------------------------------- op7 --

def test_score_is_the_sum_over_pairs(spark):
    rng, words = np.random.default_rng(5), [f"w{i}é" if i % 3 else f"w{i}" for i in range(12)]
    place = {xxhash.xxh64_intdigest(w.encode()) & ((1 << toxicity.BITS) - 1): w for w in words}
    terms = np.array(sorted(place), np.int64)
    model = toxicity.Model(terms, 0.3, rng.normal(size=12), rng.normal(scale=0.4, size=(12, 8)))
    at = {place[int(h)]: i for i, h in enumerate(terms)}
    texts = {100 + i: " ".join(rng.choice([*words, "unknown", *(w.replace("w", "W") for w in words)], size=rng.integers(0, 30))) for i in range(60)}
    docs = docs_of(spark, ODD + list(texts.items())).withColumn("score", F.lit("other"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, keep=["doc_id"]).collect()}
    for i, t in texts.items():
        own = sorted({at[w.replace("W", "w")] for w in t.split() if w != "unknown"})
        z = 0.3 + sum(model.w[a] for a in own) + sum(float(model.v[a] @ model.v[b]) for a, b in itertools.combinations(own, 2))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-9)
    assert got[1] == got[2] == got[3] == pytest.approx(1 / (1 + np.exp(-0.3)))


# -------------------------------------------------------------------- op10 --

def test_filters_by_shard_with_hot_lines_in_parts(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(linededup, "PART_REFS", 7)
    rows = line_rows(60, 9)
    docs = docs_of(spark, rows)
    index = linededup.build_index(docs, shard_keys=2)
    assert index.n_shards > 1
    out = linededup.apply(index, docs, keep=["doc_id"], filter_bytes=0)
    got = [tuple(r) for r in out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256)).collect()]
    assert _sorted(got) == _sorted(brute_lines(rows))
    # the filter decides: with empty filters nothing passes
    none = linededup.LineIndex(index.refs, index.counts, index.filters.limit(0), index.n_shards)
    assert linededup._maybe_frequent(index.refs, none, -1).count() == 0
    passing = {(bytes(r["key"]), r["doc_id"]) for r in linededup._maybe_frequent(index.refs, index, 0).collect()}
    spread = {(bytes(r["key"]), r["doc_id"]) for r in linededup._maybe_frequent(index.refs, index, 1 << 30).collect()}
    assert passing == spread and passing


def test_toxicity_tests_all_pairs(spark):
    """Terms with a pair weight against every pair's cells, fitted one by one in plain Python."""
    rng = random.Random(4)
    rows, y = [], []
    for n in range(1200):
        r = sorted(t for t in range(30) if rng.random() < (0.45 if t < 8 else 0.12)) + [30] * (n % 2) + [31] * (1 - n % 2)
        toxic = (0 in r) != (1 in r) if n % 3 else 2 in r and 9 in r
        rows.append(np.array(r, np.int32))
        y.append(int(toxic if rng.random() < 0.95 else not toxic))
    rows, y = rows + rows[:200], np.array(y + y[:200])  # copies count once
    telling = np.array([t in (4, 9, 11) for t in range(32)])
    distinct = {(tuple(r), int(t)) for r, t in zip(rows, y)}

    def gain(i, j):
        seen = {c: [0.0, 0.0] for c in itertools.product((0, 1), repeat=2)}
        for r, t in distinct:
            seen[i in r, j in r][t] += 1
        fit = {c: [sum(v) / 2] * 2 for c, v in seen.items()}
        for _ in range(50):  # margins of labels by second term, labels by first term, and rows
            for key in (lambda c, t: (c[0], t), lambda c, t: (c[1], t), lambda c, t: c):
                want, have = {}, {}
                for c in seen:
                    for t in (0, 1):
                        want[key(c, t)] = want.get(key(c, t), 0) + seen[c][t]
                        have[key(c, t)] = have.get(key(c, t), 0) + fit[c][t]
                fit = {c: [fit[c][t] * want[key(c, t)] / have[key(c, t)] if have[key(c, t)] else 0.0 for t in (0, 1)] for c in seen}
        return 2 * sum(seen[c][t] * math.log(seen[c][t] / fit[c][t]) for c in seen for t in (0, 1) if seen[c][t])

    for floor in (8.0, 40.0):
        good = [p for p in itertools.combinations(range(32), 2) if not telling[list(p)].all() and gain(*p) >= floor]
        got = toxicity.paired(spark, rows, y, telling, floor)
        assert good and set(np.flatnonzero(got)) == {t for p in good for t in p}
    assert not toxicity.paired(spark, [], np.zeros(0, int), telling).any()
    assert not len(toxicity.paired(spark, rows, y, np.zeros(0, bool)))


@pytest.mark.parametrize("step, copies", [(7, 1), (1 << 20, 1), (7, 40), (1 << 20, 40)])  # many terms beside the rows: counted by sorting
def test_toxicity_pair_counts(monkeypatch, step, copies):
    monkeypatch.setattr(toxicity, "GATHER", step)
    rng = np.random.default_rng(1)
    rows = [np.flatnonzero(rng.random(20) < 0.4).astype(np.int32) for _ in range(50)] + [np.zeros(0, np.int32)]
    y = rng.integers(0, 2, 51)
    held = toxicity._Sample(np.concatenate(rows), np.cumsum([0, *map(len, rows)]), y, 20 * copies)
    for docs in (np.arange(51), np.array([3, 9, 50]), np.array([4]), np.zeros(0, int), np.array([50])):
        for low in (0, 6, 19):
            n = {t: (sum(t in rows[d] for d in docs), sum(t in rows[d] for d in docs if y[d])) for t in range(low, 20)}
            assert [tuple(map(int, x)) for x in zip(*held.together(docs, low))] == [(t, *c) for t, c in n.items() if c[0]]
