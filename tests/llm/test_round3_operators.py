"""Main text, conversation repair and spelling variants against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from cinelytics.llm import htmltext, repair, variants

from ..conftest import SF_SMALL

# -------------------------------------------------------------------- op11 --


class Tree(HTMLParser):
    """Well-formed html as nested [tag, attrs, kids] lists."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = ["html", {}, []]
        self.open = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        self.open.append(node)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.open[-1][2].append(data)


def brute_text(html):
    """The paper's figures by plain recursion, for pages of div, p, a and b without hints."""
    root = Tree(html).root

    def text(x):
        return x if isinstance(x, str) else "".join(map(text, x[2]))

    def chars(x):
        return len("".join(text(x).split()))

    def tags(x):
        return 0 if isinstance(x, str) else sum(tags(k) + (not isinstance(k, str)) for k in x[2])

    def links(x):
        """(characters, tags) of links, the node itself included"""
        if isinstance(x, str):
            return 0, 0
        below = [links(k) for k in x[2]]
        if x[0] == "a":
            return chars(x), 1 + sum(b[1] for b in below)
        return sum(b[0] for b in below), sum(b[1] for b in below)

    share = links(root)[0] / chars(root) if chars(root) else 0

    def density(c, t, lc, lt):
        if not c:
            return 0.0
        if not share:
            return c / max(t, 1)
        base = math.log(math.log(c / max(c - lc, 1) * lc + share * c + math.e))
        return c / max(t, 1) * math.log(c / max(lc, 1) * max(t, 1) / max(lt, 1)) / base

    def own(x):
        return density(chars(x), tags(x), *links(x))

    def block(x):
        return not isinstance(x, str) and (x[0] in ("html", "div", "p") or any(block(k) for k in x[2]))

    def boxes(x):
        return [("block", next(iter(g))) if k[0] else ("run", list(g))
                for k, g in itertools.groupby(x[2], key=lambda y: (block(y), id(y) if block(y) else 0))]

    def weight(kind, b):
        if kind == "block":
            return own(b)
        whole = ["i", {}, b]
        return density(chars(whole), tags(whole), *links(whole))

    def total(x):
        return sum(weight(*b) for b in boxes(x))

    def blocks(x):
        return [x] + [y for k in x[2] if block(k) for y in blocks(k)]

    def best(x):
        return max(blocks(x), key=total)  # the first of equals

    top = best(root)

    def path(x, to):
        if x is to:
            return [x]
        for k in x[2]:
            if block(k) and (p := path(k, to)):
                return [x, *p]
        return None

    threshold = min(map(own, path(root, top)))
    chosen, out = [top], []

    def walk(x, kept):
        if not kept:
            if own(x) >= threshold:
                chosen.append(best(x))
            kept = any(x is c for c in chosen)
        for kind, b in boxes(x):
            if kind == "block":
                walk(b, kept)
            elif kept or weight(kind, b) >= threshold:
                out.append(" ".join("".join(map(text, b)).split()))

    walk(root, False)
    return " ".join(t for t in out if t)


def random_page(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["text", "p", "div", "a", "b"]) if depth < 4 else "text"
        if kind == "text":
            out.append(" ".join("x" * rng.randint(1, 9) for _ in range(rng.randint(1, 30))))
        elif kind == "p":
            out.append(f"<p>{'y' * rng.randint(1, 40)} <b>z</b> &amp;<a href='#'>{'l' * rng.randint(1, 9)}</a></p>")
        elif kind == "a":
            out.append(f"<a>{'m' * rng.randint(1, 30)} <b>n</b></a>")
        else:
            out.append(f"<{kind}>{random_page(rng, depth + 1)}</{kind}>")
    return " ".join(out)


def test_density_equals_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        page = random_page(rng)
        assert htmltext.main_text(page) == brute_text(page), page


ARTICLE = "<article><h1>A title</h1><p>First &amp; foremost,\n some <b>bo</b>ld   text.<p>Short.<ul><li>one<li>two</ul></article>"


@pytest.mark.parametrize("noise", [
    "<nav><ul><li><a href='/a'>A</a></ul></nav>", "<header><h1>The site</h1></header>", "<div class='sidebar-left'><p>Side</p></div>",
    "<aside>x</aside>", "<div id='cookieBanner'>We use cookies. " + "Really. " * 90 + "</div>", "<script>if (a<b) '</p>'</script>",
    "<section class='comments'>" + "<article class=comment><p>I think that this is wrong, and long. </p></article>" * 30 + "</section>",
    "<form><input name=q><button>Go</button></form>", "<style>p > a {}</style>", "<!-- <p>no</p> -->", "<div class='ad'>Buy!</div>",
    "<div hidden>x</div>", "<div style='display: none'>x</div>", "<footer>&copy; x</footer>", "<div role=alert>Note</div>"])
def test_noise_goes(noise):
    want = "A title First & foremost, some bold text. Short. one two"
    pages = [noise + ARTICLE, ARTICLE + noise, f"<div class='has-sidebar'>{noise}<form>{ARTICLE}</form>{noise}</div>"]
    if not noise.startswith("<header"):  # a header inside the article is its own
        pages.append(ARTICLE.replace("</article>", noise + "</article>"))
    for page in pages:
        assert htmltext.main_text(f"<html><head><title>t</title></head><body>{page}</body></html>") == want


def test_pages_without_article():
    text = "A sentence that goes on for quite a while, as they do in real articles. " * 3
    menu = "".join(f"<li><a href='/{i}'>Item {i}</a></li>" for i in range(9))
    page = f"<body><div><ul>{menu}</ul></div><div><div><h2>Head</h2><p>{text}</p><p>{text}</p></div></div><div><a href=x>More</a></div>"
    assert htmltext.main_text(page) == " ".join(["Head", text.strip(), text.strip()])
    assert htmltext.main_text("") == htmltext.main_text("<nav>x</nav>") == ""
    assert htmltext.main_text("no tags & 1 < 2 &lt;p&gt;") == "no tags & 1 < 2 <p>"
    assert htmltext.main_text("<p>a<br>b</p><p>c") == "a b c"
    assert htmltext.main_text("<div>" * 5000 + "deep" + "</div>" * 3) == "deep"
    assert htmltext.main_text("<p>x <a href=\"no end>y</a> z") == "x y z"
    assert len(htmltext.main_text("<p>" + "word " * 200_000)) == 999_999


def test_extract_rows(spark):
    rows = [(1, None, None, "t"), (1, None, None, "t"), (None, "u", ARTICLE, "t"), (2, "v", "", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in htmltext.extract(pages, ["page_id", "url"]).collect()), key=str)
    want = "A title First & foremost, some bold text. Short. one two"
    assert got == sorted([(1, None, "", 0), (1, None, "", 0), (0, "u", want, len(want)), (2, "v", "", 0)], key=str)
    assert htmltext.extract(pages.limit(0), ["page_id"]).count() == 0


def test_articles_of_the_pages(spark):
    """Whole table: every page's text is what stands between its article tags."""
    from html import unescape

    want = {}
    for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        inner = re.sub(r"</?b>", "", inner.replace("<br>", " "))
        parts = [" ".join(unescape(x).split()) for x in re.split(r"<[^>]*>", inner)]
        want[r.page_id] = " ".join(p for p in parts if p)
    got = entry.queries()["op11_main_text"](spark, SF_SMALL)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert {r.page_id: r.text for r in got.collect()} == want


# -------------------------------------------------------------------- op12 --

SPACE = " \t\n\x0b\f\r"


def brute_repair(rows):
    """rows: (turn, role, text) of one conversation after damage; the least (cost, audit, lines)
    from each row and state to the end, strings and all."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("b" if not bare else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t")
        seen.add((role, text))
    turns = [r[0] for r in rows if r[0] is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    best = {"0": (0, "", ()), "s": (10, "II", ("user:", "assistant:")), "u": (5, "I", ("assistant:",)), "a": (0, "", ())}
    for (_, role, text), fault in zip(reversed(rows), reversed(faults)):
        new = {}
        for state, (c, a, r) in best.items():
            ways = [(c + 2, "D" + a, r)]
            if fault not in ("b", "d"):
                extra = 5 * (fault == "t")
                for initial, name in (("s", None), ("u", "user"), ("a", "assistant")):
                    if {"0": initial in "su", "s": initial == "u", "u": initial == "a", "a": initial == "u"}[state]:
                        c2, a2, r2 = best[initial]
                        if role[:1] == initial:
                            ways.append((c2 + extra, "K" + a2, (f"{role}:{text}", *r2)))
                        if name:
                            ways.append((c2 + extra + 1, "R" + a2, (f"{name}:{text}", *r2)))
            new[state] = min(ways)
        for _ in range(3):  # insertions before the row
            for state, to, name in (("0", "u", "user"), ("s", "u", "user"), ("u", "a", "assistant"), ("a", "u", "user")):
                c, a, r = new[to]
                new[state] = min(new[state], (c + 5, "I" + a, (f"{name}:", *r)))
        best = new
    cost, audit, lines = best["0"]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"),
            faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def brute_damaged(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        out[conv]
        if k:
            role = "user" if k == 4 else role
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out[conv] += [(turn, role, text)] * (2 if k == 3 else 1)
    return out


COLS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
TURNS = "conv_id long, turn long, role string, text string"


def chats(seed, n_convs, longest):
    rng, rows = random.Random(seed), []
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", None, "x. ", "Ünd.", "a", "One.\nTwo."]
    for conv in [*range(n_convs), None]:
        for t in range(rng.randint(1, longest)):
            text = rng.choice(texts) if rng.random() < .5 else f"Words {rng.randint(0, 99)}."
            rows.append((conv, rng.choice([t, t, t, t // 2, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), text))
    return rows


@pytest.mark.parametrize("chunk", [2, 7, repair.CHUNK])
def test_repair_equals_brute_force(spark, chunk):
    rows = chats(chunk, 40, 30)
    want = {c: brute_repair(r) for c, r in brute_damaged(rows).items()}
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS + ", n string, key int")
    got = repair.summary(frame, chunk).collect()
    assert {r.conv_id: tuple(r[c] for c in COLS) for r in got} == want
    assert len(got) == len(want)


def test_repair_of_a_hot_conversation(spark):
    """One conversation over many chunks and partitions, with runs that never converge by themselves."""
    rows = [(1, t, "user", f"Row {t}.") for t in range(400)]
    rows += [(1, 400 + t, "tool", f"Cut {t}") for t in range(100)] + [(1, 500 + t, "user", "same.") for t in range(300)]
    rows += [(1, 900, "assistant", "End."), (2, 0, "system", "Only."), (3, 5, "user", "")]
    want = {c: brute_repair(r) for c, r in brute_damaged(rows).items()}
    got = repair.summary(spark.createDataFrame(rows, TURNS), 8).collect()
    assert {r.conv_id: tuple(r[c] for c in COLS) for r in got} == want


def test_repair_edges(spark):
    assert repair.summary(spark.createDataFrame([], TURNS)).count() == 0
    drop = next(t for t in range(1000) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    got = repair.summary(spark.createDataFrame([(9, drop, "user", "Hi.")], TURNS)).collect()
    assert [tuple(r) for r in got] == [(9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    done = repair.repair(spark.createDataFrame([(1, 1, "system", "Be."), (1, 2, "assistant", "Ok.")], TURNS))
    rows = sorted(((r.pos, r.seq, r.edit, r.role, r.text) for r in repair.repaired_rows(done).collect()))
    assert [r[2:] for r in rows] in ([("R", "user", "Be."), ("K", "assistant", "Ok.")],)


@given(st.lists(st.integers(0, 7), max_size=60), st.lists(st.integers(1, 59), max_size=5), st.integers(0, 3))
@settings(max_examples=300, deadline=None)
def test_reruns_meet_earlier_runs(codes, cuts, seed):
    """Chunks run from any border vector, and from an earlier run's tail, equal one run over all."""
    whole = repair.backward(codes, repair.END)
    bounds = sorted({0, len(codes), *[c for c in cuts if c < len(codes)]})
    guesses = [repair.GUESS, repair.END, (3, 1, 0, 2)]
    end, found = repair.END, []
    for lo, hi in reversed(list(itertools.pairwise(bounds))):
        guess = repair.backward(codes[lo:hi], guesses[seed % 3])
        again = repair.backward(codes[lo:hi], end, guess)
        assert again == repair.backward(codes[lo:hi], end) == whole[lo:hi + 1]
        end = again[0]
        found.insert(0, again)
    state, edits = repair.START, []
    for (lo, hi), vectors in zip(itertools.pairwise(bounds), found):
        more, state = repair.forward(codes[lo:hi], vectors, state)
        edits += more
    assert (edits, state) == repair.forward(codes, whole, repair.START)
    assert all(max(v) <= 12 for v in whole)


# -------------------------------------------------------------------- op13 --

def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(docs):
    n = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            n[low[:h % len(low)] + low[h % len(low) + 1:] if h % 97 == 0 else low] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    mates = {w: sorted(((-n[x], x) for x in n if near(w, x))) for w in n}
    form = {w: m[0][1] if m and -m[0][0] >= 2 * n[w] else None for w, m in mates.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], len(mates[w]), n[form[w]] if form[w] else None) for w in n)


def word_docs(seed):
    rng = random.Random(seed)
    base = ["colour", "color", "colours", "analyse", "analyze", "größen", "grössen", "aaaaab", "aaaaa", "aaaaaa", "baaaaa", "naïve", "über×÷", "Zürich"]
    rows = [(None, None), (1, ""), (2, "1234 -- aa bb"), (None, "colour " * 9)]
    for i in range(60):
        words = [rng.choice(base) for _ in range(20)]
        words += ["".join(rng.choice("abe") for _ in range(rng.randint(4, 7))) for _ in range(30)]
        rows.append((i, " ".join(w.upper() if rng.random() < .1 else w for w in words)))
    return rows + rows[-3:]


@pytest.mark.parametrize("hot", [1, 4, variants.HOT])
def test_variants_equal_brute_force(spark, hot):
    docs = word_docs(hot)
    frame = spark.createDataFrame([(*d, "x", 5) for d in docs], "doc_id long, text string, word string, n int")
    words = variants.count_words(variants.damage(variants.runs(frame)))
    got = variants.group_variants(words, hot=hot)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(tuple(r) for r in got.collect()) == brute_variants(docs)


def test_variants_of_an_empty_table(spark):
    words = variants.count_words(variants.damage(variants.runs(spark.createDataFrame([], "doc_id long, text string"))))
    assert variants.group_variants(words).count() == 0


def test_chain_of_forms(spark):
    words = spark.createDataFrame([("abcde" + "x" * i, 3 * 2 ** i) for i in range(12)], "word string, n long")
    got = {r.word: r.root for r in variants.group_variants(words).collect()}
    assert set(got.values()) == {"abcde" + "x" * 11}


# --------------------------------------------------------------------- op9 --

def test_hot_buckets_split_without_losing_links(spark):
    """Fingerprints that share most bits: every bucket is too large at several levels."""
    import numpy as np

    from cinelytics.llm import simhash

    rng = random.Random(4)
    low = [sum(1 << b for b in rng.sample(range(20), rng.randint(0, 5))) for _ in range(500)]
    fps = sorted({(0x5A5A << 40) ^ x for x in low} | {rng.getrandbits(63) for _ in range(50)})
    near = {f: {g for g in fps if (f ^ g).bit_count() <= 3} for f in fps}
    root, seen = {}, set()
    for f in fps:
        stack = [f] if f not in seen else []
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                root[x] = f
                stack += near[x]
    df = spark.createDataFrame([(f, f) for f in fps], "fp long, first_id long")
    for block in (2, 8, 64):
        found = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, 3, block)).collect()}
        groups = collections.defaultdict(set)
        for f in fps:
            groups[found.get(f, f)].add(f)
        want = collections.defaultdict(set)
        for f in fps:
            want[root[f]].add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    for level in range(simhash.LEVELS):
        assert np.bitwise_or.reduce(np.array(simhash.segment_masks(level, 4), np.uint64)) == np.uint64(2**64 - 1)


def test_a_hot_bucket_is_not_squared(spark):
    """All rows in one bucket of several tables: a fingerprint is sent to a few groups (a level of splitting
    more at each fourfold size, six at most), where pairs of blocks would send it to n / block."""
    from pyspark.sql import functions as F

    from cinelytics.llm import simhash

    for n in (20_000, 80_000):
        # the lower 32 bits spread, the upper ones equal
        df = spark.range(n).select((F.xxhash64("id").bitwiseAND(F.lit(0xFFFFFFFF)) + (1 << 40)).alias("fp")).distinct()
        assert simhash._buckets(df, 3, 512).count() < 16 * n < n * n // 512


# --------------------------------------------------------------------- op1 --

@pytest.mark.parametrize("block_chars,send_bytes", [(200, 1 << 20), (200, 300), (1 << 20, 300), (1 << 20, 1 << 20)])
def test_blocks_and_groups_of_items_find_the_same(spark, block_chars, send_bytes):
    """Several automata in a task and several passes equal one automaton."""
    from cinelytics.llm import decontam

    rng = random.Random(6)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 10, 14])))) for i in range(60)] + [(None, "w1 w2 w3"), (7, None)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(40)) + " " + str(items[i][1])) for i in range(50)] + [(50, None), (51, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(str, decontam.scan(d, b, window=4).collect()))
    assert any("end=" in w for w in want)
    assert sorted(map(str, decontam.scan(d, b, window=4, block_chars=block_chars, send_bytes=send_bytes).collect())) == want


# --------------------------------------------------------------------- op2 --

def test_parts_of_token_files(spark, tmp_path):
    """A doc_id that a third of the rows share, null ids and many parts: all rows, in order, starts gapless."""
    from cinelytics.llm import simple8b, tokens

    rows = [(5, f"text number {i}") for i in range(200)] + [(i, f"other {i}") for i in range(-200, 200)] + [(None, "none")] * 3
    path = str(tmp_path / "ids")
    simple8b.write_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), path,
                       tokens.tokenizer_path("word_bpe_49k.json"))
    segments = spark.read.parquet(path).collect()
    assert len({s["part"] for s in segments if 5 in s["doc_ids"]}) > 3
    got = sorted(simple8b.read_ids(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]
    encode = tokens.encoder(tokens.tokenizer_path("word_bpe_49k.json"), "word")
    want = collections.Counter((i, tuple(x.tolist()) + (1,)) for (i, _), x in zip(rows, encode.ids([t for _, t in rows])))
    import numpy as np
    assert collections.Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == want
