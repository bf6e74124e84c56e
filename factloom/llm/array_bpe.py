"""Byte-pair encoding of many texts at once on numpy arrays.

Some texts are joined to one array of character codes. Their pre-tokens are found
by character classes, each is hashed to 64 bits by a sum over its characters, and
the distinct ones that are not yet known are merged together: laid out as one
ragged array of symbol ids, each takes in every round the lowest rank among its
neighbouring pairs and merges that pair wherever it stands in it. What survives are
its ids. Pair ranks are looked up in an open-addressing table held in two arrays.

A text with a special string, or a character outside a plain range (where Unicode
tables of library and Python could differ), is encoded by the library.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import regex

NONE = np.int32(2**31 - 1)
#: Characters of texts that are looked at together.
CHUNK = 1 << 20
#: Pre-tokens held between batches, about 150 bytes each; of more the later half stays.
MEMORY = 400_000
#: Bytes of new pre-tokens that are merged together.
TOGETHER = 1 << 20
#: Stands between joined texts; no plain text holds it.
SEP = "\ue000"
GAP, LETTER, NUMBER, SIGN, SPACE = range(5)
#: Fixed value: the characters of the white-space property.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in such a vocabulary: printable
    Latin-1 characters for themselves, the others from U+0100 on, in order."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}


def within(n: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n, one after the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def ragged(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, .. for n places, for each pair."""
    return np.repeat(first, n) + within(n)


class Merger:
    """Merges of one vocabulary (a tokenizers file) as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocab, merges = told["model"]["vocab"], told["model"]["merges"]
        end = told["model"].get("end_of_word_suffix") or ""
        self.special = sorted((t["content"] for t in told["added_tokens"]), key=len, reverse=True)
        self.dtype = np.uint16 if max(vocab.values()) < 1 << 16 else np.uint32
        #: ids of a byte inside a pre-token, and of its last one
        self.first, self.last = np.zeros(256, np.int32), np.zeros(256, np.int32)
        for c, b in byte_symbols().items():
            self.first[b], self.last[b] = vocab[c], vocab[c + end]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[x] << 32 | vocab[y] for x, y in pairs], np.int64)
        self.made = np.array([vocab[x + y] for x, y in pairs], np.int32)
        self.bits = int(len(keys) * 4).bit_length()
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, NONE, np.int32)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at] == -1
            slots, who = np.unique(at[free], return_index=True)
            placed = todo[free][who]
            self.keys[slots], self.rank[slots] = keys[placed], placed
            rest = ~np.isin(todo, placed)
            todo, at = todo[rest], (at[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.rank[at], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            got = self.keys[at[open_]]
            hit = got == keys[open_]
            out[open_[hit]] = self.rank[at[open_[hit]]]
            open_ = open_[~hit & (got != -1)]
        return out

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(surviving symbols of each of these non-empty pre-tokens, all of them one
        after the other)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.first[raw]
        ends = np.cumsum(size) - 1
        sym[ends] = self.last[raw[ends]]
        row = np.repeat(np.arange(len(words), dtype=np.int32), size)
        left = size.copy()
        out_rows, out_syms = [row[ends[size == 1]]], [sym[ends[size == 1]]]
        keep = (size > 1)[row]
        sym, row = sym[keep], row[keep]
        pair = np.full(len(sym), NONE, np.int32)
        if len(sym):
            same = row[1:] == row[:-1]
            pair[:-1][same] = self.ranks(sym[:-1][same], sym[1:][same])
        while len(sym):
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            low = np.minimum.reduceat(pair, starts)
            lengths = np.diff(np.r_[starts, len(sym)])
            done = low == NONE
            if done.any():
                left[row[starts[done]]] = lengths[done]
                keep = np.repeat(~done, lengths)
                out_rows.append(row[~keep])
                out_syms.append(sym[~keep])
                sym, row, pair = sym[keep], row[keep], pair[keep]
                low, lengths = low[~done], lengths[~done]
                if not len(sym):
                    break
            at = np.flatnonzero(pair == np.repeat(low, lengths))
            # of overlapping equal pairs (aaa) every second one, from the left
            chain = np.flatnonzero(np.r_[True, np.diff(at) != 1])
            at = at[(np.arange(len(at)) - np.repeat(chain, np.diff(np.r_[chain, len(at)]))) % 2 == 0]
            sym[at] = self.made[pair[at]]
            gone = np.zeros(len(sym), bool)
            gone[at + 1] = True
            fresh = np.zeros(len(sym), bool)  # pairs to rank anew: of the merged symbol and of the one before it
            fresh[at] = True
            keep = ~gone
            sym, row, pair, fresh = sym[keep], row[keep], pair[keep], fresh[keep]
            fresh[:-1] |= fresh[1:]
            todo = np.flatnonzero(fresh)
            pair[todo] = NONE
            todo = todo[todo + 1 < len(sym)]
            todo = todo[row[todo] == row[todo + 1]]
            pair[todo] = self.ranks(sym[todo], sym[todo + 1])
        rows = np.concatenate(out_rows)
        return left, np.concatenate(out_syms)[np.argsort(rows, kind="stable")]

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of each of these non-empty pre-tokens."""
        return self.merged(words)[0]


# --- pre-tokens ---------------------------------------------------------------


def classes() -> np.ndarray:
    """The class of each character of the basic plane, GAP for what is between texts."""
    out = np.full(1 << 16, SIGN, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 1 << 16)]))
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
        out[[ord(c) for c in regex.findall(pattern, every)]] = kind
    out[[ord(c) for c in WHITE]] = SPACE
    out[ord(SEP)] = GAP
    return out


def _contractions(codes: np.ndarray, kind: np.ndarray, start: np.ndarray) -> None:
    """A pre-token that begins with an apostrophe takes s, t, m, d, re, ve or ll after
    it and no more."""
    at = np.flatnonzero((codes[:-2] == ord("'")) & start[:-2] & (kind[1:-1] == LETTER))
    a, b = codes[at + 1], codes[at + 2]
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))
    for hit, n in ((one, 1), (two, 2)):
        here = at[hit]
        start[here + 1] = False
        after = here + 1 + n
        start[after[kind[after] == LETTER]] = True


def word_cuts(codes: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, after the last character) of the pre-tokens of lower-cased text: runs of
    letters, single numbers, runs of signs; white space is none."""
    kept = (kind != GAP) & (kind != SPACE)
    start = np.r_[True, kind[1:] != kind[:-1]] | (kind == NUMBER)
    start &= kept
    _contractions(codes, kind, start)
    return _bounds(start, kept)


def byte_cuts(codes: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same where runs of letters, numbers or signs take one space before them, and
    white space is a pre-token without its last character if a run follows."""
    start = np.r_[True, kind[1:] != kind[:-1]]
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != GAP))
    start[last] = True
    start[last[codes[last] == ord(" ")] + 1] = False
    kept = kind != GAP
    start &= kept
    _contractions(codes, kind, start)
    return _bounds(start, kept)


def _bounds(start: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    end = kept.copy()
    end[:-1] &= start[1:] | ~kept[1:]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def _mixed(n: int) -> np.ndarray:
    """A 64-bit number for each of 0 .. n-1."""
    with np.errstate(over="ignore"):
        x = (np.arange(1, n + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


BASE = 0xD1342543DE82EF95
BASE_BACK = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


class ArrayTokenizer:
    """Ids of one vocabulary, as its library gives them without added tokens."""

    def __init__(self, path: str, cuts: Callable, lower: bool, plain: tuple, special: bool, whole: Callable[[str], list[int]]):
        self.merger, self.cuts, self.lower, self.special, self.whole = Merger(path), cuts, lower, special, whole
        self.odd = np.ones(1 << 16, bool)
        for a, b in plain:
            self.odd[a : b + 1] = False
        self.odd[ord(SEP)] = False
        self.kind = classes()
        self.number = _mixed(1 << 16)
        self.number[self.kind == GAP] = 0
        if cuts is word_cuts:
            self.number[self.kind == SPACE] = 0
        self.powers, self.back = _powers(BASE, CHUNK * 2), _powers(BASE_BACK, CHUNK * 2)
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.memory = MEMORY
        self.at, self.n, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.merger.dtype)

    def _evict(self) -> None:
        keep = len(self.known) // 2
        cut = int(self.at[keep])
        self.known = {h: i - keep for h, i in self.known.items() if i >= keep}
        self.at, self.n, self.ids = self.at[keep:] - cut, self.n[keep:], self.ids[cut:]

    def _learn(self, hashes: np.ndarray, codes: np.ndarray, first: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Numbers of new pre-tokens, merged TOGETHER bytes at a time."""
        base, size = len(self.known), after - first
        ends = np.flatnonzero(np.diff(np.cumsum(size) // TOGETHER, append=-1)) + 1
        counts, found, lo = [], [], 0
        for hi in ends.tolist():
            n = size[lo:hi]
            spaced = np.full(int(n.sum()) + hi - lo, ord(SEP), np.uint16)
            spaced[ragged(np.cumsum(n + 1) - n - 1, n)] = codes[ragged(first[lo:hi], n)]
            words = spaced[:-1].tobytes().decode("utf-16-le").encode().split(SEP.encode())
            count, ids = self.merger.merged(words)
            counts.append(count)
            found.append(ids.astype(self.merger.dtype))
            lo = hi
        count, numbers = np.concatenate(counts), np.arange(base, base + len(hashes))
        self.known.update(zip(hashes.tolist(), numbers.tolist()))
        self.at = np.r_[self.at, len(self.ids) + np.cumsum(count) - count]
        self.n, self.ids = np.r_[self.n, count], np.concatenate([self.ids, *found])
        return numbers

    def _codes(self, texts: list[str]) -> np.ndarray | None:
        """The codes of texts with SEP after each and at the end; None if one is not plain."""
        joined = SEP.join(texts) + SEP + SEP
        codes = np.frombuffer(joined.encode("utf-16-le", "surrogatepass"), np.uint16)
        if self.odd[codes].any() or (self.special and "<|" in joined) or joined.count(SEP) != len(texts) + 1:
            return None
        return codes

    def _tokens(self, texts: list[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known number of each pre-token, pre-tokens of each text) of plain texts."""
        kind = self.kind[codes]
        first, after = self.cuts(codes, kind)
        length = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        begins = np.searchsorted(first, np.r_[0, np.cumsum(length)])
        if not len(first):
            return np.zeros(0, np.int64), np.diff(begins)
        powers, back = self.powers, self.back
        if len(codes) > len(powers):  # a very long text
            powers, back = _powers(BASE, len(codes)), _powers(BASE_BACK, len(codes))
        with np.errstate(over="ignore"):
            h = np.add.reduceat(self.number[codes] * powers[: len(codes)], first) * back[first]
        order = np.argsort(h)
        sorted_ = h[order]
        new = np.r_[True, sorted_[1:] != sorted_[:-1]]
        which = np.empty(len(h), np.int64)
        which[order] = np.cumsum(new) - 1
        kinds, one = sorted_[new], order[new]
        if len(self.known) > self.memory:
            self._evict()
        told = np.fromiter(map(self.known.get, kinds.tolist(), repeat(-1)), np.int64, len(kinds))
        unknown = np.flatnonzero(told < 0)
        if len(unknown):
            told[unknown] = self._learn(kinds[unknown], codes, first[one[unknown]], after[one[unknown]])
        return told[which], np.diff(begins)

    def _parts(self, texts: list[str]) -> Iterator[tuple[list[int], tuple | None]]:
        """Places of some texts, and what _tokens gives for them; a text that is not
        plain comes alone with None."""
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and size < CHUNK:
                size += len(texts[hi])
                hi += 1
            places = list(range(lo, hi))
            some = [t.lower() for t in texts[lo:hi]] if self.lower else texts[lo:hi]
            codes = self._codes(some)
            if codes is None:
                fine = [self._codes([t]) is not None for t in some]
                yield from (([i], None) for i, ok in zip(places, fine) if not ok)
                places, some = [i for i, ok in zip(places, fine) if ok], [t for t, ok in zip(some, fine) if ok]
                codes = self._codes(some) if some else None
            if codes is not None:
                yield places, self._tokens(some, codes)
            lo = hi

    def counts(self, texts: list[str]) -> np.ndarray:
        """Ids of each text."""
        out = np.zeros(len(texts), np.int64)
        for at, told in self._parts(texts):
            if told is None:
                out[at[0]] = len(self.whole(texts[at[0]]))
                continue
            which, tokens = told
            total = np.r_[0, np.cumsum(self.n[which])]
            ends = np.cumsum(tokens)
            out[at] = total[ends] - total[ends - tokens]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text (Merger.dtype)."""
        out: list = [None] * len(texts)
        for at, told in self._parts(texts):
            if told is None:
                out[at[0]] = np.array(self.whole(texts[at[0]]), self.merger.dtype)
                continue
            which, tokens = told
            n = self.n[which]
            ids = self.ids[ragged(self.at[which], n)]
            total = np.r_[0, np.cumsum(n)]
            ends = total[np.cumsum(tokens)].tolist()
            lo = 0
            for i, hi in zip(at, ends):
                out[i] = ids[lo:hi]
                lo = hi
        return out


#: Ranges of characters that no release of Unicode has changed.
LATIN = ((0x09, 0x0A), (0x0D, 0x0D), (0x20, 0x7E), (0xA1, 0xB1), (0xB4, 0xB8), (0xBA, 0xBB), (0xBF, 0x24F), (0x2010, 0x2027), (0x20AC, 0x20AC))
WIDER = ((0x00, 0x1F), (0x85, 0x85), (0xA0, 0xBE), (0x400, 0x52F), (0x3000, 0x3002), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))

_made: dict[tuple, ArrayTokenizer] = {}


def word_tokenizer(path: str) -> ArrayTokenizer:
    """Of a lower-casing BPE with word ends. One per Python worker: its tables and
    memory serve later batches."""
    if ("word", path) not in _made:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        _made["word", path] = ArrayTokenizer(path, word_cuts, True, LATIN, True, lambda t: tok.encode(t, add_special_tokens=False).ids)
    return _made["word", path]


def byte_tokenizer(path: str, special: bool = True) -> ArrayTokenizer:
    """Of a byte-level BPE. special: special strings in texts are their tokens, else
    ordinary text."""
    if ("byte", path, special) not in _made:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = not special
        _made["byte", path, special] = ArrayTokenizer(path, byte_cuts, False, LATIN + WIDER, special, lambda t: tok.encode(t, add_special_tokens=False).ids)
    return _made["byte", path, special]
