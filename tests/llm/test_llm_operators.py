"""The training-data operators against brute force, on small fixtures with the edge
cases every operator defines: nulls, empty and long texts, ties, repeated rows,
empty tables and extra columns with clashing names."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cinelytics.llm import (chat, common, decontam, licenses, linededup, packing, quality, simhash, simple8b, tokens, toxicity,
                            urlrules)
from tools.oracle_compare import digest

from ..conftest import SF_SMALL

DOCS = "doc_id long, text string"
WS = r"[^\x20\x09-\x0D]+"


def docs_of(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def small_docs(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


def collect(df, key=0):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x) if not isinstance(x, (list, dict)) else str(x) for x in r))


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (None, "no id here"), (None, None),
       (5, "same same same"), (5, "same same same"), (6, "ü" * 3000 + " " + "x" * 70), (7, "a b\u00a0c \r\n d")]


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF_SMALL)
    res = duck.execute(entry.oracle_sql()[name])
    o_cols, o_rows = [d[0] for d in res.description], res.fetchall()
    assert sorted(df.columns) == sorted(o_cols)
    s_rows = [tuple(r) for r in df.collect()]
    assert len(s_rows) == len(o_rows) > 0
    assert digest(df.columns, s_rows)[0] == digest(o_cols, o_rows)[0]


# --------------------------------------------------------------------- op1 --

def brute_decontam(text, items, window=10):
    pat = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s or "")
    words, hit, who = pat.findall(low(text)), set(), set()
    for item_id, t in items:
        iw = pat.findall(low(t))
        for at in range(max(1, len(iw) - window + 1)) if iw else ():
            g = iw[at:at + window]
            for p in range(len(words) - len(g) + 1):
                if words[p:p + len(g)] == g:
                    hit.update(range(p, p + len(g)))
                    if item_id is not None:
                        who.add(str(item_id))
    return len(words), len(hit), sorted(who)


ITEMS = [(1, "what is the answer to the great question of life and all"), (2, "short item"), (10, "short ITEM"), (3, None),
         (4, ""), (None, "nameless thing"), (2, "short item"), (5, "the answer to the great question of life and all the rest")]


@pytest.mark.parametrize("block", [decontam.BLOCK_CHARS, 200])
def test_decontamination_brute_force(spark, block):
    rows = ODD + [(20, "So: What is the answer to the GREAT question of life, and all the rest?"), (21, "a short-item, nameless thing"),
                  (22, "short item " * 40), (23, "é short item ß")]
    docs = docs_of(spark, rows).withColumn("n_hit", F.lit("mine")).withColumn("spans", F.lit(1))
    out = decontam.scan(docs, docs_of(spark, ITEMS, "item_id long, text string"), keep=["doc_id", "text", "n_hit"],
                        block_chars=block)
    assert out.columns == ["doc_id", "text", "n_words", "n_hit", "items", "spans"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["n_hit"], r["items"]) == brute_decontam(r["text"], ITEMS)
        for s in r["spans"]:
            part = r["text"][s["start"]:s["end"]]
            assert part and brute_decontam(part, ITEMS)[1] == len(decontam.words_of(part))
    clean = decontam.drop_contaminated(docs, docs_of(spark, ITEMS, "item_id long, text string"))
    assert clean.columns == docs.columns
    assert clean.count() == sum(brute_decontam(t, ITEMS)[1] == 0 for _, t in rows)


def test_decontamination_empty_sides(spark):
    none = docs_of(spark, [], DOCS)
    items = docs_of(spark, [], "item_id long, text string")
    assert decontam.scan(none, items).count() == 0
    assert decontam.scan(docs_of(spark, ODD), items).agg(F.sum("n_hit")).first()[0] == 0


# ---------------------------------------------------------------- op2, op4 --

TRICKY = ["", " a  b", "trail ", "it's  we'll 's x", "a\n\nb", "\na\n", "x\u0085y z", "é e\u0301 ﬁ İ Σ ΑΣ", "a" * 500 + " " + "b c " * 90,
          "<|endoftext|> x <|startoftext|>", "日本 語。 x\u3000y", "x\0 y", "A.B, (c) d'e ###", "word, word. Word", "\x1c y", "\u200b z"]


@pytest.mark.parametrize("kind,name", [("byte", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")])
def test_cached_ids_equal_the_library(spark, kind, name):
    from tokenizers import Tokenizer

    texts = TRICKY + [r["text"] for r in small_docs(spark).select("text").collect()]
    plain = Tokenizer.from_file(tokens.tokenizer_path(name))
    plain.encode_special_tokens = True
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    enc = tokens.Encoder(tokens.tokenizer_path(name), kind)
    for _ in range(2):  # cold and warm
        assert [x.tolist() for x in enc.ids(texts)] == want
    small, tokens.CACHE_PIECES = tokens.CACHE_PIECES, 50
    try:
        assert [x.tolist() for at in range(0, len(texts), 7) for x in enc.ids(texts[at:at + 7])] == want
    finally:
        tokens.CACHE_PIECES = small


@pytest.mark.parametrize("kind,name", [("byte", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")])
def test_added_tokens_in_a_text_are_ordinary_text(kind, name):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.tokenizer_path(name))
    special = plain.token_to_id("<|endoftext|>")
    text = "one <|endoftext|> two"
    ids = tokens.Encoder(tokens.tokenizer_path(name), kind).ids([text])[0].tolist()
    assert special in plain.encode(text, add_special_tokens=False).ids and special not in ids  # the README states it
    plain.encode_special_tokens = True
    assert ids == plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 70000), st.integers(0, 2**64 - 1)), max_size=1500))
def test_simple8b_round_trip(ids):
    x = np.array(ids, np.uint64)
    words, offsets, escapes = simple8b.encode_ids(x)
    assert (simple8b.decode_ids(words, offsets, escapes, len(x)) == x).all()
    blocks = list(range(0, len(x), simple8b.BLOCK))
    for b, at in enumerate(blocks):  # any block alone
        end = int(offsets[b + 1]) if b + 1 < len(blocks) else len(words)
        part = x[at:at + simple8b.BLOCK]
        got = simple8b.decode_ids(words[int(offsets[b]):end], np.zeros(1, np.uint32), escapes, len(part))
        assert (got == part).all()


def _ids(text, name, kind, end):
    return [*tokens.encoder(tokens.tokenizer_path(name), kind).ids([text or ""])[0].tolist(), end]


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_brute_force(spark, tmp_path):
    rows = sorted(((i, t) for i, t in ODD if i is not None), key=lambda r: (r[0], r[1] is not None, r[1]))
    docs = docs_of(spark, rows[::-1]).withColumn("start", F.lit("x")).repartition(3)
    simple8b.write_ids(docs, str(tmp_path / "ids"), tokens.tokenizer_path("word_bpe_49k.json"))
    got = simple8b.read_ids(spark, str(tmp_path / "ids")).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
    want, at = [], 0
    for i, t in rows:
        x = _ids(t, "word_bpe_49k.json", "word", 1)
        want.append((i, at, len(x), _crc(x)))
        at += len(x)
    assert sorted(map(tuple, got)) == sorted(want)
    simple8b.write_ids(docs.limit(0), str(tmp_path / "none"), tokens.tokenizer_path("word_bpe_49k.json"))
    assert simple8b.read_ids(spark, str(tmp_path / "none")).count() == 0


def test_op2_whole_table(spark):
    want, at = {}, 0
    for r in sorted(small_docs(spark).collect(), key=lambda r: r["doc_id"]):
        x = _ids(r["text"], "word_bpe_49k.json", "word", 1)
        want[r["doc_id"]] = (at, len(x), _crc(x))
        at += len(x)
    got = {r[0]: tuple(r)[1:] for r in entry.queries()["op2_token_files"](spark, SF_SMALL).collect()}
    assert got == want


def check_pieces(rows, texts):
    by_doc, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    for d, t in texts.items():
        ids = _ids(t, "byte_bpe_50k.json", "byte", 0)
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == _crc(ids[at:at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for pieces in windows.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding


def test_packing_whole_table_and_edges(spark):
    texts = {r["doc_id"]: r["text"] for r in small_docs(spark).collect()}
    assert check_pieces(entry.queries()["op4_packing"](spark, SF_SMALL).collect(), texts) == 0
    odd = {i: t for i, t in ODD if i is not None}
    docs = docs_of(spark, list(odd.items())).withColumn("length", F.lit("x"))
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    assert check_pieces(packing.digest(packing.pack(docs, path)).collect(), odd) == 0
    assert packing.pack(docs.limit(0), path).count() == 0


@pytest.mark.parametrize("max_open", [2, 4096])
def test_sum_of_squares_choice(max_open):
    rng, out = np.random.default_rng(1), []
    p = packing.SumOfSquares(16, max_open, lambda d, s, i, n, o: out.append((d, s, len(i), n, o)))
    total = 0
    for d in range(300):
        size = int(rng.integers(1, 40))
        rest = size % 16
        if rest and max_open > 100:  # brute force over all levels
            n = p.level.copy()
            cost = {}
            for h in range(0, 16 - rest + 1):
                if h and not n[h]:
                    continue
                m = n.copy()
                if h:
                    m[h] -= 1
                if h + rest < 16:
                    m[h + rest] += 1
                cost[h] = int((m ** 2).sum())
            best = min(cost.values())
            assert p.choose(rest) == max(h for h, c in cost.items() if c == best)
        p.add(d, np.arange(size))
        total += size
    p.drain()
    assert sum(x[2] for x in out) == total
    fill = collections.Counter()
    for x in out:
        fill[x[3]] += x[2]
    assert all(v & (v - 1) == 0 for v in fill.values())


# --------------------------------------------------------------------- op3 --

def test_licenses_planted(spark):
    apache = licenses.TEMPLATES[1][1]
    words = apache.split()
    edited = " ".join(words[:9] + ["indeed"] + words[10:])
    rows = ODD + [(30, "Intro.\n" + apache + "\nend"), (31, "x " * 50 + edited + " tail"), (32, "Released under the MIT License.\n" * 3),
                  (33, "the license of the version under the and to"), (34, "Ünï Licensed under CC BY-NC 4.0. fin")]
    docs = docs_of(spark, rows).withColumn("licenses", F.lit(0))
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(docs, keep=["doc_id", "licenses"]).where("doc_id is not null").collect()}
    assert [x["license"] for x in got[30]] == ["Apache-2.0"] and got[30][0]["coverage"] == 1.0
    text = dict(r for r in rows if r[0])[30]
    assert text[got[30][0]["start"]:got[30][0]["end"]].startswith("Licensed under")
    assert [x["license"] for x in got[31]] == ["Apache-2.0"] and 0.9 < got[31][0]["coverage"] < 1.0
    assert [x["license"] for x in got[32]] == ["MIT"] * 3
    assert got[33] == [] and got[1] == [] and got[2] == []
    t34 = dict(r for r in rows if r[0])[34]
    assert t34[got[34][0]["start"]:got[34][0]["end"]] == "Licensed under CC BY-NC 4.0"
    assert licenses.scan(docs.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=25), st.lists(st.integers(0, 12), max_size=25))
def test_patience_is_a_common_subsequence(a, b):
    pairs = licenses.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    if len(set(a)) == len(a) and len(set(b)) == len(b):  # all anchors: the longest one
        lcs = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                lcs[i + 1][j + 1] = lcs[i][j] + 1 if a[i] == b[j] else max(lcs[i][j + 1], lcs[i + 1][j])
        assert len(pairs) <= lcs[-1][-1]
    if a == b:
        assert len(pairs) == len(a)


def names_of(texts):
    scanner = licenses.Scanner(licenses.TEMPLATES + licenses.whole_texts(), licenses.MIN_COVERAGE)
    return [[x[0] for x in scanner.scan(t)] for t in texts]


def test_licenses_neighbours_are_told_apart():
    gpl, header = "This work is licensed under the GNU {}General Public License, version {}.", licenses.TEMPLATES[5][1]
    cases = [("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Licensed under CC BY-SA 3.0.", "CC-BY-SA-3.0"),
             ("This work is licensed under a Creative Commons Attribution-Non-Commercial 4.0 International License.", "CC-BY-NC-4.0"),
             (gpl.format("", 2), "GPL-2.0"), (gpl.format("", 3), "GPL-3.0"), (gpl.format("Lesser ", "2.1"), "LGPL-2.1"),
             (gpl.format("Lesser ", 3), "LGPL-3.0"), (gpl.format("Affero ", 3), "AGPL-3.0"), (header, "GPL-3.0"),
             (header.replace("version 3", "version 2"), "GPL-2.0"), (header.replace("GNU", "GNU Affero"), "AGPL-3.0"),
             ("Released under the BSD 2-Clause License.", "BSD-2-Clause"), ("Licensed under the Apache License, Version 1.1.", "Apache-1.1")]
    assert names_of([f"some words {t} and more" for t, _ in cases]) == [[n] for _, n in cases]
    assert names_of([gpl.format("", 7), "Released under the Foo License.", "Licensed under CC BY-NC 9.0"]) == [[], [], []]


@pytest.mark.parametrize("every", [0, 40])
def test_licenses_whole_texts(every):
    texts = []
    for _, text in licenses.whole_texts():
        words = text.split()
        if every:  # words left out, changed and added all over the text
            words = [w for i, x in enumerate(words) for w in ([] if i % every == 7 else ["changed"] if i % every == 17 else [x, "more"] if i % every == 27 else [x])]
        texts.append("intro of the file " + " ".join(words) + " and its end")
    scanner = licenses.Scanner(licenses.TEMPLATES + licenses.whole_texts(), licenses.MIN_COVERAGE)
    for (name, whole), text in zip(licenses.whole_texts(), texts):
        best = max(scanner.scan(text), key=lambda x: x[3] - x[2])
        assert best[0] == name and best[1] > (0.9 if every else 0.999)
        assert best[3] - best[2] > 0.9 * len(licenses.words_of(whole))


def test_licenses_whole_table(spark):
    got = {r["doc_id"]: r["names"] for r in entry.queries()["op3_licenses"](spark, SF_SMALL).collect()}
    marks = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
             "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    for r in small_docs(spark).collect():
        want = sorted({v for k, v in marks.items() if k in (r["text"] or "")})
        assert got[r["doc_id"]] == ",".join(want)


# --------------------------------------------------------------------- op5 --

def test_quality_edges(spark):
    rows = ODD + [(40, "a b c " * 60), (41, "\n".join(["same line here"] * 9)), (42, " ".join(f"w{i}" for i in range(80)))]
    docs = docs_of(spark, rows).withColumn("kept", F.lit("x"))
    got = {(r["doc_id"], r["n_words"]): r for r in quality.score(docs).collect()}
    assert got[(1, 0)]["base_failed"] and not got[(1, 0)]["kept"]
    r = got[(40, 180)]
    assert r["n_repeat_words"] == 180 and r["base_failed"]
    assert got[(41, 27)]["n_dup_lines"] == 8
    assert got[(42, 80)]["kept"]
    assert got[(6, 2)]["word_chars"] == 3070
    assert quality.score(docs.limit(0)).count() == 0


# --------------------------------------------------------------------- op6 --

def test_url_rules_find_a_planted_combination(spark):
    pages = [(i, f"https://{'bad' if i % 4 == 0 else 'ok'}{i % 3}.shop.org/{'promo' if i % 2 == 0 else 'page'}/{i}?id=1") for i in range(400)]
    pages += [(900, None), (901, "no scheme"), (902, "http://EXAMPLE.NET"), (903, "http://a.example.net/en/x"), (904, "http://fake-org/fr/"),
              (905, "x://org/fr/z"), (905, "x://org/fr/z"), (906, "http://b.net/q"), (907, ""), (None, "http://c.net/")]
    df = docs_of(spark, pages, "page_id long, url string").withColumn("host", F.lit("mine")).withColumn("verdict", F.lit(1))
    labels = docs_of(spark, [(i, i % 4 == 0) for i in range(0, 400)] + [(None, True), (3, None)], "page_id long, blocked boolean")
    out = urlrules.judge(df, labels, keep=["page_id", "host"])
    assert out.columns == ["page_id", "host", "path", "rule", "verdict", "mined_rule"] or out.columns[0] == "page_id"
    got = out.collect()
    assert len(got) == len(pages)
    by = {r["page_id"]: r for r in got}
    assert all(by[i]["verdict"] == ("block" if i % 4 == 0 else "allow") for i in range(400))
    assert (by[900]["host"], by[900]["path"], by[900]["verdict"]) == ("", "", "allow")
    assert by[902]["rule"] is None and by[902]["host"] == "example.net"
    assert by[903]["rule"] == "example.net/en/" and by[903]["verdict"] == "allow"
    assert by[904]["rule"] is None and by[905]["rule"] == "org/fr/" and by[906]["rule"] == "net/"
    assert urlrules.judge(df.limit(0), labels.limit(0)).count() == 0


def test_url_rules_of_any_length(spark):
    """Blocked if and only if four tokens meet; brute force over all bodies."""
    def url(x):
        return f"http://{'a' if x & 1 else 'b'}.{'c' if x & 2 else 'd'}.org/{'e' if x & 4 else 'f'}?{'g' if x & 8 else 'h'}=1"

    def tokens(x):
        return {"h:" + ("a" if x & 1 else "b"), "h:" + ("c" if x & 2 else "d"), "h:org", "p:" + ("e" if x & 4 else "f"), "q:" + ("g" if x & 8 else "h")}

    pages = docs_of(spark, [(i, url(i % 16)) for i in range(320)], "page_id long, url string")
    labels = docs_of(spark, [(i, i % 16 == 15) for i in range(320)], "page_id long, blocked boolean")
    got = urlrules.judge(pages, labels).collect()
    assert all((r["verdict"] == "block") == (r["page_id"] % 16 == 15) for r in got)
    assert {r["mined_rule"] for r in got if r["page_id"] % 16 == 15} == {"h:a h:c p:e q:g"}
    rows = docs_of(spark, [(sorted(tokens(x)), x in (15, 14) or x == 1) for x in range(16)] * 2, "tokens array<string>, blocked boolean")
    passing = set()
    for x in range(16):
        for n in range(1, 6):
            for body in itertools.combinations(sorted(tokens(x)), n):
                held = [y in (15, 14) or y == 1 for y in range(16) if set(body) <= tokens(y)]
                if sum(held) / len(held) >= 0.9 and 2 * sum(held) >= 1:
                    passing.add(frozenset(body))
    want = {b for b in passing if len(b) <= 3 or not any(a < b for a in passing)}
    assert any(len(b) > 3 for b in want) and {frozenset(r["body"]) for r in urlrules.mine(rows).collect()} == want


# --------------------------------------------------------------------- op7 --

def test_toxicity_held_out(spark, sf="/root/testdata/sf0.1"):
    found = entry.queries()["op7_toxicity"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    both = found.join(labels, "doc_id").where("held_out").select("predicted", "toxic", "score").collect()
    right = sum(r["predicted"] == r["toxic"] for r in both) / len(both)
    toxic = [r for r in both if r["toxic"] == 1]
    clean = [r for r in both if r["toxic"] == 0]
    assert right > 0.97 and sum(r["predicted"] for r in toxic) / len(toxic) > 0.85
    assert sum(r["predicted"] for r in clean) / len(clean) < 0.01


def test_factorization_machine_learns_a_pair():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(6) < 0.5) for _ in range(3000)]
    y = np.array([int((0 in r) != (1 in r)) for r in rows])  # no additive weights can tell
    model = toxicity.fit(rows, y, np.arange(6, dtype=np.int64), epochs=60)
    hits = sum((model.score(r.astype(np.int64)) >= 0.5) == t for r, t in zip(rows, y))
    assert hits / len(rows) > 0.95


def test_toxicity_edges(spark):
    docs = docs_of(spark, ODD).withColumn("score", F.lit("x"))
    labels = docs_of(spark, [(1, 1), (2, 0), (None, 1), (4, None), (4, 0), (4, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model)
    assert got.count() == len(ODD) and got.where("score < 0 or score > 1 or score is null").count() == 0
    assert toxicity.score(docs, toxicity.train(docs, labels.limit(0))).where("score >= 0.5").count() == 0
    assert toxicity.drop_toxic(docs.limit(0), labels).columns == docs.columns


def planted_texts(n, seed, toxic):
    """Texts of filler with marks at random; label by ``toxic(marks)``."""
    rng, out = random.Random(seed), []
    for i in range(n):
        marks = {w for w, p in (("insult", 0.3), ("group", 0.3), ("slur", 0.2)) if rng.random() < p}
        out.append((i, " ".join([*marks, *(f"w{rng.randrange(60)}" for _ in range(12))]), int(toxic(marks))))
    return out


@pytest.mark.parametrize("toxic", [
    lambda m: {"insult", "group"} <= m or ("slur" in m and "group" not in m),  # a group's toxic share is the common one
    lambda m: ("insult" in m) != ("group" in m),
    lambda m: not {"insult", "group"} <= m,                                    # 91 % toxic: clean by a pair
    lambda m: "slur" in m or "insult" not in m])                               # 76 % toxic
def test_toxicity_trains_pairs_and_toxic_majorities(spark, toxic):
    rows, fresh = planted_texts(1500, 1, toxic), planted_texts(600, 2, toxic)
    docs, labels = docs_of(spark, [r[:2] for r in rows]), docs_of(spark, [(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    hits = sum((model.score(toxicity.term_hashes(t)) >= 0.5) == y for _, t, y in fresh)
    assert hits / len(fresh) > 0.95


def test_toxicity_without_terms_rejects_nothing(spark):
    docs = docs_of(spark, [(i, f"word{i}") for i in range(60)])
    for labels in ([(i, 1) for i in range(60)], [(i, int(i % 4 > 0)) for i in range(60)]):
        assert toxicity.drop_toxic(docs, docs_of(spark, labels, "doc_id long, toxic int")).count() == 60


# --------------------------------------------------------------------- op8 --

TEXTS = st.lists(st.sampled_from(["</s>", "[INST]", "[/INST]", "<<SYS>>", "<s>", "<", "[", "\\", "<\\s>", "a", " ", "\n", "é", "</SYS>>", "[\\\\INST]"]),
                 max_size=6).map("".join)


def test_chat_round_trip(spark):
    rng = random.Random(5)
    parts = ["</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "<", "[", "\\", "<\\s>", "a", " ", "\n", "é", "[\\\\INST]", "$1", "|im_end|>"]
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "assistant", "system", "to<s>ol", None])
            rows.append((c, t, role, rng.choice([None, "".join(rng.choices(parts, k=rng.randint(0, 8)))])))
    rows += [(70, 0, "user", "hi"), (70, 0, "user", "hi"), (None, 0, "assistant", "x")]
    df = docs_of(spark, rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        assert [(x["role"], x["text"]) for x in got[c]["turns"]] == [(r, x) for _, r, x in turns]
        assert got[c]["loss_text"] == "".join(x for _, r, x in turns if r == "assistant")
        blocks = 1 + sum(a[1] != b[1] for a, b in zip(turns, turns[1:]))
        assert got[c]["formatted"].count("</s>") == blocks == got[c]["formatted"].count("<s>[INST]")
        assert got[c]["formatted"].count("<<SYS>>") == len(turns) - blocks
    assert chat.format_chats(df.limit(0)).count() == 0


# --------------------------------------------------------------------- op9 --

def brute_fp(text, n=3):
    words = re.findall(WS, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows, radius=3):
    fps = [brute_fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return [(d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows)]


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_simhash_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in small_docs(spark).collect()]
    got = [tuple(r) for r in entry.queries()["op9_simhash"](spark, SF_SMALL).collect()]
    assert _sorted(got) == _sorted(brute_components(rows))


def test_simhash_edges(spark):
    docs = docs_of(spark, ODD + [(9, "same SAME same"), (8, "one")]).withColumn("fp", F.lit("x"))
    got = [(r["doc_id"], f"{r['fp'] & (2**64 - 1):016x}", r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    assert _sorted(got) == _sorted(brute_components(ODD + [(9, "same SAME same"), (8, "one")]))
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect())
    comps = {c for d, _, c in got if d is not None and c is not None}
    assert ids == sorted(comps) and kept.where("doc_id is null").count() == 2
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_keep_first_of_an_id_in_two_groups(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (2, a.upper()), (1, b), (3, b), (1, a), (1, b), (4, "alone here"), (None, a), (3, "other words of three")]
    docs = docs_of(spark, rows).withColumn("row", F.lit("mine"))
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert collect(kept.select("doc_id", "text")) == collect(docs_of(spark, [(1, a), (1, b), (4, "alone here"), (None, a), (3, "other words of three")]))


def test_covering_masks_catch_every_pair():
    rng, masks = random.Random(3), simhash.covering_masks(3)
    assert len(masks) == 15
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        assert any(m & diff == 0 for m in masks)


@pytest.mark.parametrize("block", [4, 2048])
def test_links_of_a_dense_group(spark, block):
    rng, base = random.Random(9), random.Random(1).getrandbits(63)
    fps = sorted({base ^ sum(1 << b for b in rng.sample(range(62), rng.randint(0, 5))) for _ in range(150)} | {1, 2, 4, 8 << 30})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, 3, block)).collect()}
    group = {f: f for f in fps}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                group[find(a)] = find(b)
    for a in fps:
        for b in fps:
            assert (find(a) == find(b)) == (roots.get(a, a) == roots.get(b, b))


# -------------------------------------------------------------------- op10 --

def brute_lines(rows, min_docs=3):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = collections.defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= 20:
                holders[key(x)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return out


LINES = ["this is a common line of text", "  This IS a common line of text\t", "short", "ünïcödé lines of 20 ch", "another shared line, quite long", ""]


def line_rows(n=40, seed=4):
    rng = random.Random(seed)
    rows = [(i, "\n".join(rng.choices(LINES + [f"unique line number {i} {k} here" for k in range(4)], k=rng.randint(0, 7)))) for i in range(n)]
    return rows + [(None, LINES[0]), (None, LINES[0] + "\nown line without an id at all"), (3, LINES[4]), (3, LINES[4]), (50, None), (51, "")]


@pytest.mark.parametrize("filter_bytes", [0, linededup.FILTER_BYTES])
def test_line_dedup_brute_force(spark, filter_bytes, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", filter_bytes)
    rows = line_rows()
    docs = docs_of(spark, rows).withColumn("kept", F.lit(1)).withColumn("keys", F.lit(2))
    index = linededup.build_index(docs, shard_keys=2)
    out = linededup.apply(index, docs, keep=["doc_id"], filter_bytes=filter_bytes)
    got = [tuple(r) for r in out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256)).collect()]
    assert _sorted(got) == _sorted(brute_lines(rows))
    assert linededup.apply(linededup.build_index(docs.limit(0)), docs.limit(0)).count() == 0
    again = linededup.dedup_lines(docs)
    assert again.columns == docs.columns and again.count() == len(rows)


def test_line_dedup_is_reversible(spark):
    rows, more = line_rows(20, 1), [(100 + i, t) for i, t in line_rows(15, 2) if i is not None and i < 15]
    base, extra = docs_of(spark, rows), docs_of(spark, more)
    index = linededup.build_index(base, shard_keys=2)
    grown = linededup.insert(index, extra)
    both = base.union(extra)
    got = [tuple(r) for r in linededup.apply(grown, both, keep=["doc_id"]).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256)).collect()]
    assert _sorted(got) == _sorted(brute_lines(rows + more))
    back = linededup.delete(grown, extra.select("doc_id"))
    got = [tuple(r) for r in linededup.apply(back, base, keep=["doc_id"]).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256)).collect()]
    assert _sorted(got) == _sorted(brute_lines(rows))
    assert _sorted(map(tuple, back.counts.collect())) == _sorted(map(tuple, index.counts.collect()))


def test_cuckoo_filter():
    keys = np.random.default_rng(2).integers(0, 1 << 63, (5000, 2), dtype=np.uint64)
    f = linededup.CuckooFilter.of(keys[:4000])
    assert f.contains(keys[:4000]).all() and f.contains(keys[4000:]).mean() < 0.01
    f.delete(keys[:2000])
    f = linededup.CuckooFilter.from_bytes(f.to_bytes())
    assert f.contains(keys[2000:4000]).all() and f.contains(keys[:2000]).mean() < 0.01
