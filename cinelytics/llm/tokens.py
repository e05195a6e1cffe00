"""Token ids of public tokenizer files, with a bounded cache of pieces.

The ``tokenizers`` library makes every id.  Both files split a text into pieces
before they merge, and no piece reaches across the boundaries used here, so each
distinct piece is encoded once and looked up afterwards:

* ``word`` (white space dropped, lower case): a piece begins at a space or line feed;
* ``byte`` (a space belongs to the next word): a piece begins at a single space and at
  either side of a single line feed; texts with other white space, or two in a row,
  are cut only before single spaces between plain signs.

Pieces of a few texts are found and hashed at once with numpy (two 64-bit polynomial
hashes with random bases; pieces over ``LONG_PIECE`` bytes are never hashed), grouped,
and only the distinct ones are looked up.  Should the second hash ever disagree, the
texts go through the library as they are.  A new piece of Latin letters, perhaps
with signs behind it, is one or two pre-tokens that go straight to the library's
model; all others go through its whole pipeline.  The cache is an open-addressing table
in numpy (some 50 bytes a piece, 100 MB in all) of two generations: when the young one holds
``CACHE_PIECES`` pieces it becomes the old one, and what is still in use moves over
when it is next seen, so frequent pieces are never encoded again.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from .common import kept

CACHE_PIECES = 1_000_000
JOINED = 64
LONG_PIECE = 64

# One pre-token of Latin letters (a space may come first), then at most one of signs.
_LETTERS = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
_SAFE_SPACE = re.compile(r"(?<=[!-~¡-ᙿ])(?= [!-~¡-ᙿ])")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# The second to last bytes of the non-ASCII white space characters, by their first byte.
_WIDE_SPACES = [c.encode() for c in
                "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]


_SPACE_KIND = np.zeros(256, np.uint8)  # 1: space and line feed, 2: other ASCII white space
_SPACE_KIND[[9, 11, 12, 13, 28, 29, 30, 31]] = 2
_SPACE_KIND[[10, 32]] = 1


def are_plain(raws: list[bytes]) -> np.ndarray:
    """For texts that aren't empty, whether their white space is single spaces and line
    feeds inside the text."""
    joined, ends = b"".join(raws), np.cumsum([len(r) for r in raws])
    kind = _SPACE_KIND[np.frombuffer(joined, np.uint8)]
    bad = kind > 1
    bad[1:] |= (kind[1:] & kind[:-1]) > 0       # two in a row; across texts one of them begins or ends
    out = np.ones(len(raws), bool)
    out[np.searchsorted(ends, np.flatnonzero(bad), side="right")] = False
    out &= (kind[ends - 1] == 0) & (kind[np.r_[0, ends[:-1]]] == 0)
    wide = [w for w in _WIDE_SPACES if w in joined]
    if wide:
        out &= [not any(w in r for w in wide) for r in raws]
    return out


class _Hash:
    """Polynomial hashes modulo 2**64 of all pieces of a byte array, by prefix sums."""

    def __init__(self, seed: int, size: int = 1 << 16):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1 << 40, 1 << 62)) * 8 + 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    @staticmethod
    def _powers(have: np.ndarray, base: int, n: int) -> np.ndarray:
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        return have

    def pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self.up = self._powers(self.up, self.base, len(data))
        self.down = self._powers(self.down, self.inverse, len(data))
        total = np.empty(len(data) + 1, np.uint64)
        total[0] = 0
        np.cumsum(self.values[data] * self.up[:len(data)], out=total[1:])
        return (total[ends] - total[starts]) * self.down[starts]


class _Pieces:
    """One generation: pieces by hash, with a second hash and their ids."""

    def __init__(self, dtype, bits: int = 14):
        self.keys = np.zeros(1 << bits, np.uint64)     # 0: free
        self.number = np.zeros(1 << bits, np.int32)
        self.shift = np.uint64(64 - bits)
        self.check = np.zeros(1 << 12, np.uint64)      # by number: second hash,
        self.start = np.zeros(1 << 12, np.int32)       # place of its ids in flat,
        self.size = np.zeros(1 << 12, np.int32)        # and how many they are
        self.flat = np.zeros(1 << 14, dtype)
        self.n = self.used = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        out, todo, slot, last = np.full(len(keys), -1, np.int64), np.arange(len(keys)), self._slot(keys), len(self.keys) - 1
        while len(todo):
            at = slot[todo]
            held = self.keys[at]
            hit = held == keys[todo]
            out[todo[hit]] = self.number[at[hit]]
            todo = todo[~hit & (held != 0)]
            slot[todo] = (slot[todo] + 1) & last
        return out

    def _place(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        todo, slot, last = np.arange(len(keys)), self._slot(keys), len(self.keys) - 1
        while len(todo):
            free = todo[self.keys[slot[todo]] == 0]
            self.keys[slot[free]] = keys[free]         # of keys for one place the last one gets it
            got = free[self.keys[slot[free]] == keys[free]]
            self.number[slot[got]] = numbers[got]
            left = np.ones(len(keys), bool)
            left[got] = False
            todo = todo[left[todo]]
            slot[todo] = (slot[todo] + 1) & last

    def store(self, ids: np.ndarray, size: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Numbers of new pieces, given their ids one after another; not yet found by a key."""
        numbers = np.arange(self.n, self.n + len(size))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(size) > len(self.start):
            self.check, self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.check, self.start, self.size))
        self.flat[self.used:self.used + len(ids)] = ids
        at = slice(self.n, self.n + len(size))
        self.check[at], self.start[at], self.size[at] = second, self.used + np.cumsum(size) - size, size
        self.used, self.n = self.used + len(ids), at.stop
        return numbers

    def add(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        while 3 * (self.n + len(keys)) > 2 * len(self.keys):
            held = self.keys != 0
            old_keys, old_numbers = self.keys[held], self.number[held]
            self.keys, self.number = (np.zeros(2 * len(x), x.dtype) for x in (self.keys, self.number))
            self.shift -= np.uint64(1)
            self._place(old_keys, old_numbers)
        self._place(keys, numbers)

    def ids(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these pieces one after another, and where each piece's end."""
        size = self.size[number]
        after = np.cumsum(size, dtype=np.int64)
        if not len(after):
            return self.flat[:0], after
        return self.flat[np.repeat(self.start[number] - (after - size), size) + np.arange(after[-1])], after


def _byte_alphabet() -> dict[int, int]:
    """Byte-level vocabularies write a byte as a visible character: itself where it is
    one, else the next free code point from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + i for i, b in enumerate(hidden)}


_ALPHABET = _byte_alphabet()


class Encoder:
    """``ids(texts)``: one array of ids per text, by the tokenizer file at ``path``."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.code = "H" if self.dtype is np.uint16 else "I"
        # a line feed stands alone between pieces that begin and end visibly; where white
        # space is dropped, a control character between spaces does
        self.mark, self.separator = ("\n", "\n") if kind == "byte" else ("\1", " \1 ")
        (self.mark_id,) = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.lower = kind == "word"  # that vocabulary is lower case
        self.signs: dict[str, bytes] = {}
        self.fold = np.arange(256, dtype=np.uint8)
        if self.lower:  # same pieces: upper case and line feeds make no difference there
            self.fold[65:91] += 32
            self.fold[10] = 32
        self.hashes = _Hash(11), _Hash(12)
        self.young = self.old = _Pieces(self.dtype)

    def _plain(self, piece: str) -> bool:
        """Whether the piece may stand between separators: visible at both ends but
        for one space before it."""
        word = piece[1:] if piece[:1] == " " else piece
        return bool(word) and word == word.strip() and self.mark not in word

    def _model(self, word: str) -> bytes:
        """Ids of one pre-token by the library's model."""
        word = word.strip(" ").lower() if self.lower else word
        if word.isascii():
            word = word.replace(" ", "Ġ")
        else:
            word = word.encode().decode("latin-1").translate(_ALPHABET)
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(word)]).tobytes()

    def _encode(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of new pieces.  Letters with signs behind them are two pre-tokens, which the
        model takes directly; of other pieces up to JOINED go to the library as one text,
        with a separator that is always one token of its own."""
        made: dict[str, bytes] = {}
        plain, rest = [], []
        whole = _LETTERS.fullmatch
        for p in pieces:
            found = whole(p)
            if found:
                core, signs = found.groups()
                ids = made.get(core)
                if ids is None:
                    ids = made[core] = self._model(core)
                if signs:
                    tail = self.signs.get(signs)
                    if tail is None:
                        if len(self.signs) > 10_000:
                            self.signs.clear()
                        tail = self.signs[signs] = self._model(signs)
                    ids += tail
                made[p] = ids
            else:
                (plain if self._plain(p) else rest).append(p)
        made.update(zip(rest, (array(self.code, e.ids).tobytes() for e in
                               self.tokenizer.encode_batch_fast(rest, add_special_tokens=False))))
        joined = [self.separator.join(plain[i:i + JOINED]) + self.separator for i in range(0, len(plain), JOINED)]
        raw = np.frombuffer(b"".join(array(self.code, e.ids).tobytes() for e in
                                     self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)), self.dtype)
        ends = np.flatnonzero(raw == self.mark_id).tolist()
        if len(ends) != len(plain):
            raise ValueError("the separator is not a token of its own in this vocabulary")
        size, raw = self.dtype().itemsize, raw.tobytes()
        made.update(zip(plain, (raw[a * size:b * size] for a, b in zip([0, *[e + 1 for e in ends]], ends))))
        return made

    def _store(self, made: list[bytes], second: np.ndarray) -> np.ndarray:
        """Numbers of new pieces, given their ids and second hashes."""
        size = np.array([len(x) for x in made], np.int64) // self.dtype().itemsize
        return self.young.store(np.frombuffer(b"".join(made), self.dtype), size, second)

    def _numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray | None:
        """The cache number of every piece; None if two pieces share a hash."""
        first, second = (h.pieces(data, starts, ends) for h in self.hashes)
        order = np.argsort(first)
        new = np.r_[True, first[order][1:] != first[order][:-1]]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        one = order[new]                              # a piece of each group
        if (second[one][group] != second).any():
            return None
        keys, seconds = np.maximum(first[one], np.uint64(1)), second[one]
        number = self.young.find(keys)
        lost = np.flatnonzero(number < 0)
        if len(lost) and self.old is not self.young:
            before = self.old.find(keys[lost])
            kept = before >= 0
            before, moved = before[kept], lost[kept]
            if (self.old.check[before] != seconds[moved]).any():
                return None
            number[moved] = self.young.store(self.old.ids(before)[0], self.old.size[before], seconds[moved])
            self.young.add(keys[moved], number[moved])
            lost = lost[~kept]
        if len(lost):
            raw = data.tobytes()
            names = [raw[starts[p]:ends[p]].decode() for p in one[lost].tolist()]
            made = self._encode(names)
            number[lost] = self._store([made[x] for x in names], seconds[lost])
            self.young.add(keys[lost], number[lost])
        if (self.young.check[number] != seconds).any():
            return None
        return number[group]

    def _fast(self, raws: list[bytes]) -> list[np.ndarray] | None:
        lengths = np.array([len(r) for r in raws])
        at = np.cumsum(lengths) - lengths
        data = self.fold[np.frombuffer(b"".join(raws), np.uint8)]
        begins = data == 32
        if not self.lower:
            feed = data == 10
            begins |= feed
            begins[1:] |= feed[:-1]
        begins[at] = True
        starts = np.flatnonzero(begins)
        ends = np.r_[starts[1:], len(data)]
        if self.young.n > CACHE_PIECES:
            self.old, self.young = self.young, _Pieces(self.dtype)
        number = np.empty(len(starts), np.int64)
        long = ends - starts > LONG_PIECE
        short = np.flatnonzero(~long)
        if len(short):
            found = self._numbers(data, starts[short], ends[short])
            if found is None:
                return None
            number[short] = found
        mark = self.young.n, self.young.used
        if long.any():  # encoded each, kept only for these texts
            names = [data[a:b].tobytes().decode() for a, b in zip(starts[long], ends[long])]
            made = self._encode(names)
            number[long] = self._store([made[x] for x in names], np.zeros(len(names), np.uint64))
        ids, after = self.young.ids(number)
        size = self.young.size[number]
        self.young.n, self.young.used = mark
        first = np.searchsorted(starts, at)           # the number of each text's first piece
        return np.split(ids, (after - size)[first[1:]])

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """One array of ids per text."""
        raws = [t.encode() for t in texts]
        fast = [i for i, r in enumerate(raws) if r]
        if fast and not self.lower:
            fast = [i for i, ok in zip(fast, are_plain([raws[i] for i in fast])) if ok]
        out: list = [None] * len(texts)
        found = self._fast([raws[i] for i in fast]) if fast else []
        if found is not None:
            for i, x in zip(fast, found):
                out[i] = x
        for i, x in enumerate(out):
            if x is None:
                pieces = _SAFE_SPACE.split(texts[i]) if texts[i] and "\0" not in texts[i] else [texts[i]]
                made = self._encode(list(dict.fromkeys(pieces)))
                out[i] = np.frombuffer(b"".join([made[p] for p in pieces]), self.dtype)
        return out


def encoder(path: str, kind: str) -> Encoder:
    """The encoder of this Python worker: a stage's tasks that follow each other share its cache."""
    return kept(("encoder", path, kind), lambda: Encoder(path, kind))
