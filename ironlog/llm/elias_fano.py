"""Compact monotone sequences and a two-level n-gram trie over them, searched for whole arrays of queries at once."""

from __future__ import annotations

import tempfile
from typing import BinaryIO

import numpy as np

_U = np.uint64
_ONE = _U(1)
#: Values whose low bits are spread out at a time; a multiple of 8, so that their bits fill whole bytes.
SPREAD = 1 << 13


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) set bit of each word."""
    place = np.zeros(len(word), _U)
    k = k.astype(_U)
    for width in (32, 16, 8, 4, 2, 1):
        w = _U(width)
        low = np.bitwise_count(word & ((_ONE << w) - _ONE)).astype(_U)
        up = k >= low
        k = np.where(up, k - low, k)
        place += np.where(up, w, _U(0))
        word = np.where(up, word >> w, word)
    return place


class Sequence:
    """A non-decreasing sequence: low bits packed side by side, high bits as gaps in unary (Elias-Fano).

    ``words`` holds four parts one after another: low bits, high bits, and the ones and the zeros before each word of the high
    bits.  It may lie in a memory-mapped file.
    """

    def __init__(self, n: int, shift: int, words: np.ndarray) -> None:
        self.n, self.shift, self.words = n, shift, words
        lows = (n * shift + 63) // 64 + 1
        highs = (len(words) - lows) // 3
        self.low, self.high = words[:lows], words[lows : lows + highs]
        self.ones, self.zeros = words[lows + highs : lows + 2 * highs], words[lows + 2 * highs :]

    @classmethod
    def of(cls, values: np.ndarray) -> Sequence:
        values = values.astype(_U)
        n = len(values)
        top = int(values[-1]) if n else 0
        shift = max(0, (top // max(n, 1)).bit_length() - 1) if n else 0
        low = np.zeros(((n * shift + 63) // 64 + 1) * 8, np.uint8)
        for a in range(0, n if shift else 0, SPREAD):
            bits = (values[a : a + SPREAD, None] >> np.arange(shift, dtype=_U)) & _ONE
            part = np.packbits(bits.astype(np.uint8), bitorder="little")
            low[a * shift // 8 : a * shift // 8 + len(part)] = part
        places = (values >> _U(shift)).astype(np.int64) + np.arange(n)
        high = np.zeros(((int(places[-1]) + 2 if n else 2) + 63) // 64 * 64 + 64, np.uint8)
        high[places] = 1
        low, high = low.view(_U), np.packbits(high, bitorder="little").view(_U)
        ones = np.cumsum(np.concatenate([[0], np.bitwise_count(high)]))[:-1].astype(_U)
        zeros = np.arange(len(high), dtype=_U) * _U(64) - ones
        return cls(n, shift, np.concatenate([low, high, ones, zeros]))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.shift:
            return np.zeros(len(i), _U)
        bit = i.astype(_U) * _U(self.shift)
        word, off = (bit >> _U(6)).astype(np.int64), bit & _U(63)
        value = self.low[word] >> off
        rest = np.where(off > 0, self.low[word + 1] << ((_U(64) - off) & _U(63)), _U(0))
        return (value | rest) & ((_ONE << _U(self.shift)) - _ONE)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places ``i``."""
        i = i.astype(_U)
        word = np.searchsorted(self.ones, i, "right") - 1
        place = _select_in_word(self.high[word], i - self.ones[word])
        gap = word.astype(_U) * _U(64) + place - i
        return (gap << _U(self.shift)) | self._low(i)

    def _before(self, high: np.ndarray) -> np.ndarray:
        """How many values have a smaller high part."""
        k = high - _ONE  # the zero that ends the part before
        word = np.searchsorted(self.zeros, k, "right") - 1
        word = np.clip(word, 0, len(self.high) - 1)
        place = word.astype(_U) * _U(64) + _select_in_word(~self.high[word], k - self.zeros[word])
        return np.where(high == 0, 0, (place - k).astype(np.int64))

    def find(self, values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The first place in [begin, end) that holds at least the value, ``end`` if none: successor search.

        The high part names a short stretch; a bisection over its low bits finishes.
        """
        values = values.astype(_U)
        high = values >> _U(self.shift)
        most = _U(self.n and int(self.get(np.array([self.n - 1]))[0]) >> self.shift)
        inside = high <= most
        safe = np.where(inside, high, most)
        lo = np.where(inside, self._before(safe), self.n)
        hi = np.where(inside, np.where(safe == most, self.n, self._before(np.minimum(safe + _ONE, most))), self.n)
        lo, hi = np.clip(lo, begin, end), np.clip(hi, begin, end)
        want = values & ((_ONE << _U(self.shift)) - _ONE)
        while (open_ := np.flatnonzero(lo < hi)).size:
            middle = (lo[open_] + hi[open_]) // 2
            less = self._low(middle) < want[open_]
            lo[open_] = np.where(less, middle + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], middle)
        return lo


class Trie:
    """Words that follow each context, with a code of some bits each.

    Contexts are a sequence; pointers, another, say where a context's followers begin; followers are made one
    monotone sequence by adding to each the last value of the context before, and are searched relative to that.
    """

    def __init__(self, contexts: Sequence, pointers: Sequence, followers: Sequence, codes: np.ndarray) -> None:
        self.contexts, self.pointers, self.followers, self.codes = contexts, pointers, followers, codes

    @classmethod
    def of(cls, contexts: np.ndarray, degrees: np.ndarray, followers: np.ndarray, codes: np.ndarray) -> Trie:
        """Contexts in order, how many followers each has (at least one), and these in order per context."""
        ends = np.cumsum(degrees)
        last = followers[ends - 1].astype(np.int64) + 1 if len(ends) else np.zeros(0, np.int64)
        base = np.cumsum(last) - last
        shifted = followers.astype(np.int64) + 1 + np.repeat(base, degrees)
        return cls(Sequence.of(contexts), Sequence.of(np.concatenate([[0], ends])), Sequence.of(shifted), codes)

    def mapped(self, file: BinaryIO) -> Trie:
        """The same trie with its levels in a memory-mapped file."""
        parts = [self.contexts.words, self.pointers.words, self.followers.words]
        codes = np.zeros(-(-len(self.codes) // 8) * 8, np.uint8)
        codes[: len(self.codes)] = self.codes
        for p in parts:
            file.write(p.data)
        file.write(codes.data)
        file.flush()
        size = sum(map(len, parts)) + len(codes) // 8
        words = np.memmap(file, _U, "r", shape=(size,)) if size else np.zeros(0, _U)
        cuts = np.cumsum([0, *map(len, parts)])
        levels = [Sequence(s.n, s.shift, words[a:b]) for s, a, b in zip((self.contexts, self.pointers, self.followers), cuts, cuts[1:], strict=False)]
        return Trie(*levels, words[cuts[-1] :].view(np.uint8))

    def look_up(self, contexts: np.ndarray, followers: np.ndarray) -> np.ndarray:
        """The code of each (context, follower), 0 where the trie has none."""
        n, m = len(contexts), self.contexts.n
        out = np.zeros(n, np.uint8)
        if not n or not m:
            return out
        at = self.contexts.find(contexts, np.zeros(n, np.int64), np.full(n, m))
        hit = np.flatnonzero(at < m)
        hit = hit[self.contexts.get(at[hit]) == contexts[hit].astype(_U)]
        if not len(hit):
            return out
        node = at[hit]
        begin, end = self.pointers.get(node).astype(np.int64), self.pointers.get(node + 1).astype(np.int64)
        base = np.where(begin > 0, self.followers.get(np.maximum(begin - 1, 0)), _U(0))
        want = base + followers[hit].astype(_U) + _ONE
        place = self.followers.find(want, begin, end)
        there = np.flatnonzero(place < end)
        there = there[self.followers.get(place[there]) == want[there]]
        out[hit[there]] = self.codes[place[there]]
        return out


def temporary() -> BinaryIO:
    """A file without a name: it is gone when it is closed."""
    return tempfile.TemporaryFile(prefix="ngrams-")
