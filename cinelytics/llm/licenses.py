"""License scans by patience alignment.

Templates are short notices, with a line for each neighbouring license and version, and
the whole texts in ``license_texts``.  A template's occurrences are found by seeds: text
words that belong to a notice (but for very common words), or runs of three words that a
whole text has once, vote for the diagonal "text position - template position"; a band of diagonals with enough different template words is a candidate region.  In
it, patience alignment matches the text with the template: words unique to both are
anchors, the longest increasing subsequence of the anchors stays, and the gaps
between them are aligned in the same way; a gap without a word unique to both keeps its
equal first and last words.  Coverage is the share of template words matched; regions
from ``min_coverage`` on are occurrences; a notice's must also hold the template's
distinguishing words (names, variants such as NC or Lesser, versions) with none between
them left out, changed or added.  Of overlapping ones (of any templates) the one with most
matched less missing words stays.

Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased.  Null and
empty texts hold no license.  Repeated rows and licenses stated twice in a text are
all reported.  Nothing is shuffled; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from functools import cache
from pkgutil import get_data

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, table

MIN_COVERAGE = 0.8

LONG = 100          # words from which on a template is found by runs of words
LONG_WORDS = 20     # different words of long templates without which none is looked for

# Short notices and standard headers of public licenses.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not "
                "use this file except in compliance with the License."),
    ("Apache-1.0", "Licensed under the Apache License, Version 1.0."),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    *[(name, f"{verb} under the {title} License.") for verb in ("Released", "Licensed") for name, title in (
        ("ISC", "ISC"), ("BSD-2-Clause", "BSD 2-Clause"), ("BSD-3-Clause", "BSD 3-Clause"))],
    *[(f"{short}-{version if '.' in version else version + '.0'}", text.format(kind=kind, version=version))
      for short, kind, versions in (("GPL", "", ("1", "2", "3")), ("LGPL", "Library ", ("2",)), ("LGPL", "Lesser ", ("2", "2.1", "3")),
                                    ("AGPL", "Affero ", ("3",)))
      for version in versions for text in (
          "This work is licensed under the GNU {kind}General Public License, version {version}.",
          "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General "
          "Public License as published by the Free Software Foundation, either version {version} of the License, or (at your "
          "option) any later version.") if (short, version) != ("GPL", "3")],
    *[(f"CC-BY{short}-{version}", text) for short, title in (
        ("", ""), ("-NC", "-NonCommercial"), ("-SA", "-ShareAlike"), ("-ND", "-NoDerivatives"),
        ("-NC-SA", "-NonCommercial-ShareAlike"), ("-NC-ND", "-NonCommercial-NoDerivatives"))
      for version in ("1.0", "2.0", "2.5", "3.0", "4.0") for text in (
          f"Licensed under CC BY{short} {version}.",
          f"This work is licensed under a Creative Commons Attribution{title} {version} "
          f"{'International' if version == '4.0' else 'Unported' if version == '3.0' else 'Generic'} License.")
      if (short, version, title and text[0]) != ("-NC", "4.0", "L") and (short, version, text[0]) != ("", "4.0", "T")],
]
WHOLE_TEXTS = ["AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0",
               "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0"]
COMMON_WORDS = frozenset("the a an of to and or in is it this that by under with for you may not be as on at any are".split())

_WORD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD).split()


@cache
def whole_texts() -> list[tuple[str, str]]:
    return [(n, get_data(__package__, f"license_texts/{n}.txt").decode("utf-8", "replace")) for n in WHOLE_TEXTS]


_NAMES = frozenset(b"mit isc bsd apache mozilla gnu lesser affero cc cc0 creative attribution nc sa nd noncommercial sharealike "
                   b"noderivatives noderivs".split())
_SPLIT_NAMES = {(b"non", b"commercial"): b"noncommercial", (b"share", b"alike"): b"sharealike",
                (b"no", b"derivatives"): b"noderivatives", (b"no", b"derivs"): b"noderivatives"}
_BEFORE_VERSION = _NAMES | {b"version", b"v", b"license", b"by", b"commercial", b"alike", b"derivatives", b"derivs"}


def distinguishing(words: list[bytes]) -> list[bytes]:
    """Names, variants and version numbers in their order; a version's .0 is left out."""
    out, last = [], -2  # last: where a version number was
    for i, w in enumerate(words):
        before, after = words[i - 1] if i else b"", words[i + 1] if i + 1 < len(words) else b""
        if w[:1] == b"v" and w[1:].isdigit():
            w, before = w[1:], b"v"
        if (before, w) in _SPLIT_NAMES:
            out.append(_SPLIT_NAMES[before, w])
        elif w in _NAMES or (w == b"library" and after == b"general"):
            out.append(b"noderivatives" if w == b"noderivs" else w)
        elif w.isdigit() and (before in _BEFORE_VERSION or after == b"clause" or last == i - 1):
            if w != b"0" or last != i - 1:
                out.append(w)
            last = i
    return out


def _holds(found: list[bytes], wanted: list[bytes]) -> bool:
    return any(found[i:i + len(wanted)] == wanted for i in range(len(found) - len(wanted) + 1))


def _increasing(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence."""
    tails, at, back = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
        back.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched positions (in a, in b), increasing in both."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        i, j, k, m = gaps.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        in_a, in_b = Counter(a[i:j]), Counter(b[k:m])
        place = {w: p for p, w in enumerate(a[i:j], i) if in_a[w] == 1 and in_b.get(w) == 1}
        anchors = [(place[w], q) for q, w in enumerate(b[k:m], k) if w in place]
        if not anchors:
            continue
        chain = [anchors[x] for x in _increasing([p for p, _ in anchors])]
        for p, q in chain:
            gaps.append((i, p, k, q))
            out.append((p, q))
            i, k = p + 1, q + 1
        gaps.append((i, j, k, m))
    return sorted(out)


class Scanner:
    def __init__(self, templates, min_coverage: float):
        self.min_coverage = min_coverage
        self.templates = [(name, words_of(text)) for name, text in templates]
        self.templates = [(name, w) for name, w in self.templates if w]
        self.places = []                    # per template: word -> positions
        self.seeds: dict[bytes, list[int]] = defaultdict(list)
        common = {w.encode() for w in COMMON_WORDS}
        self.needed, self.marks, self.long_words = [], [], set()
        for t, (_, words) in enumerate(self.templates):
            places = defaultdict(list)
            if len(words) >= LONG:
                runs = list(zip(words, words[1:], words[2:]))
                once = {r for r, n in Counter(runs).items() if n == 1}
                for q, r in enumerate(runs):
                    if r in once:
                        places[r].append(q)
                self.long_words |= set(words) - common
                # a left out or changed word breaks three runs, an added one two, so few are asked for
                self.needed.append(max(3, len(places) // 20))
            else:
                rare = {w for w in words if w not in common} or set(words)
                for q, w in enumerate(words):
                    if w in rare:
                        places[w].append(q)
                # a match of min_coverage of the words leaves out at most the others
                self.needed.append(max(1, len(places) - int((1 - min_coverage) * len(words) + 1e-9)))
            self.marks.append(distinguishing(words) if len(words) < LONG else [])
            self.places.append(places)
            for w in places:
                self.seeds[w].append(t)

    def regions(self, t: int, words: list[bytes], at: dict[bytes, list[int]]):
        """Candidate [first, end) word ranges: bands of diagonals with enough seed words."""
        m, places = len(self.templates[t][1]), self.places[t]
        slack = max(2, m // 4)
        votes: dict[int, set] = defaultdict(set)
        exact: dict[int, set] = defaultdict(set)
        for w, qs in places.items():
            for p in at.get(w, ()):
                for q in qs:
                    votes[(p - q) // slack].add(w)
                    exact[p - q].add(w)
        for d in sorted(exact) if m < LONG else ():  # without insertions: no neighbouring copy makes its words repeat
            if len(exact[d]) >= self.needed[t]:
                yield max(0, d), min(len(words), d + m)
        for band in sorted(votes):
            near = votes[band] | votes.get(band + 1, set())
            if len(near) >= self.needed[t]:
                yield max(0, band * slack - slack), min(len(words), (band + 2) * slack + m + slack)

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, last word) of each occurrence, in text order."""
        words = words_of(text)
        different = set(words)
        known = self.seeds.keys() & different
        at: dict = {w: [] for w in known}
        if known:
            for p, w in enumerate(words):
                if w in at:
                    at[w].append(p)
        if len(self.long_words & different) >= LONG_WORDS:
            for p, r in enumerate(zip(words, words[1:], words[2:])):
                if r in self.seeds:
                    at.setdefault(r, []).append(p)
            known = at.keys()
        if not known:
            return []
        count = Counter(t for w in known for t in self.seeds[w])
        found = []
        for t, n in count.items():
            if n < self.needed[t]:
                continue
            name, template = self.templates[t]
            for lo, hi in self.regions(t, words, at):
                pairs = patience(words[lo:hi], template)
                pairs = self._compact([p for p, _ in pairs], len(template))
                if not pairs or len(pairs) / len(template) < self.min_coverage:
                    continue
                if not self.marks[t] or _holds(distinguishing(words[lo + pairs[0]:lo + pairs[-1] + 1]), self.marks[t]):
                    found.append((2 * len(pairs) - len(template), len(pairs) / len(template), name, lo + pairs[0], lo + pairs[-1]))
        chosen: list = []
        for item in sorted(found, key=lambda x: (-x[0], -x[1], x[3], x[2])):
            if all(item[4] < c[3] or c[4] < item[3] for c in chosen):
                chosen.append(item)
        return sorted((name, cov, a, b) for _, cov, name, a, b in chosen)

    @staticmethod
    def _compact(places: list[int], size: int) -> list[int]:
        """Leave out matches far from the others: the largest run within 1.5 template lengths."""
        best: list[int] = []
        lo = 0
        for hi in range(len(places)):
            while places[hi] - places[lo] > 1.5 * size:
                lo += 1
            if hi - lo + 1 > len(best):
                best = places[lo:hi + 1]
        return best


def _spans(text: str, found) -> list[dict]:
    """Occurrences with [start, end) code point offsets of the original text."""
    raw = text.encode("utf-8", "surrogatepass")
    edge = np.diff(np.r_[0, np.frombuffer(raw.translate(_WORD), np.uint8) != 32, 0].astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    before = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
    rows = [{"license": n, "coverage": c, "start": int(before[starts[a]]), "end": int(before[ends[b]])} for n, c, a, b in found]
    return sorted(rows, key=lambda r: (r["start"], r["end"], r["license"]))


FOUND = T.StructType([T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()),
                      T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def scan(docs: DataFrame, templates=None, min_coverage: float = MIN_COVERAGE, text_col: str = "text",
         keep: list[str] | None = None, out: str = "licenses") -> DataFrame:
    """``keep`` columns (all by default) plus the occurrences as an array of structs."""
    templates = TEMPLATES + whole_texts() if templates is None else templates

    def make():
        scanner = Scanner(templates, min_coverage)

        def work(texts):
            found = [scanner.scan(t) for t in texts]
            return [[_spans(t, f) if f else [] for t, f in zip(texts, found)]]

        return work

    return map_texts(docs, text_col, make, [T.StructField(out, T.ArrayType(FOUND))], docs.columns if keep is None else keep)


def q_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3 over whole ``documents``: occurrences, license names and best coverage."""
    out = scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"]))), ",").alias("names"),
        F.coalesce(F.array_max(F.transform("licenses", lambda x: x["coverage"])), F.lit(0.0)).alias("best_coverage"),
        F.coalesce(F.aggregate("licenses", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]), F.lit(0).cast("long"))
        .alias("license_chars"))
