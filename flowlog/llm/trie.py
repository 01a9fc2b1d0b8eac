"""An n-gram trie in Elias-Fano levels that tasks map from a file."""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass

import numpy as np

U = np.uint64
_ONE = U(1)


def _select(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the set bit with each rank inside a 64-bit word, by halving."""
    words, rank, place = words.copy(), rank.astype(np.int64), np.zeros(len(words), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        below = np.bitwise_count(words & ((_ONE << U(width)) - _ONE)).astype(np.int64)
        go = rank >= below
        rank -= np.where(go, below, 0)
        place += np.where(go, width, 0)
        words = np.where(go, words >> U(width), words)
    return place


@dataclass
class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits as a unary bit vector with a count per word."""

    size: int
    width: int  # low bits of a value
    low: np.ndarray
    high: np.ndarray
    ones: np.ndarray  # set bits before each word of ``high``

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (top // max(1, n)).bit_length() - 1)
        low = np.zeros((n * width >> 6) + 2, np.uint64)
        if width and n:
            at = np.arange(n, dtype=np.int64) * width
            part, shift = values & ((_ONE << U(width)) - _ONE), (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, at >> 6, part << shift)
            over = (at & 63) + width > 64
            np.bitwise_or.at(low, (at[over] >> 6) + 1, part[over] >> (U(64) - shift[over]))
        bits = np.zeros(((top >> width) + n + 2 + 63) // 64 * 64, bool)
        bits[(values >> U(width)).astype(np.int64) + np.arange(n)] = True
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.int64)[:-1]))
        return cls(n, width, low, high, ones)

    def _low(self, index: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(index), np.uint64)
        at = index * self.width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        value = self.low[word] >> shift
        over = (at & 63) + self.width > 64
        value[over] |= self.low[word[over] + 1] << (U(64) - shift[over])
        return value & ((_ONE << U(self.width)) - _ONE)

    def at(self, index: np.ndarray) -> np.ndarray:
        """The values at ``index``."""
        word = np.searchsorted(self.ones, index, side="right") - 1
        place = word * 64 + _select(self.high[word], index - self.ones[word])
        return (place - index).astype(np.uint64) << U(self.width) | self._low(index)

    def _below(self, high: np.ndarray) -> np.ndarray:
        """How many values have high bits less than ``high``."""
        zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        inside = np.minimum(high, len(self.high) * 64 - int(self.ones[-1]) - int(np.bitwise_count(self.high[-1])))
        rank = np.maximum(inside - 1, 0)
        word = np.searchsorted(zeros, rank, side="right") - 1
        place = word * 64 + _select(~self.high[word], rank - zeros[word])
        return np.where(high <= 0, 0, np.minimum(place - rank, self.size))

    def successor(self, values: np.ndarray) -> np.ndarray:
        """Index of the first element that is at least each value; ``size`` if there is none."""
        values = values.astype(np.uint64)
        high = (values >> U(self.width)).astype(np.int64)
        least, greatest = self._below(high), self._below(high + 1)
        wanted = values & ((_ONE << U(self.width)) - _ONE)
        open_ = np.flatnonzero(least < greatest)
        while len(open_):
            middle = (least[open_] + greatest[open_]) // 2
            small = self._low(middle) < wanted[open_]
            least[open_[small]] = middle[small] + 1
            greatest[open_[~small]] = middle[~small]
            open_ = open_[least[open_] < greatest[open_]]
        return least

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value, -1 if it is not there."""
        index = self.successor(values)
        inside = np.minimum(index, max(0, self.size - 1))
        good = (index < self.size) & (self.at(inside) == values) if self.size else np.zeros(len(values), bool)
        return np.where(good, inside, -1)


#: Stored log10 probabilities are multiples of a step below 0.
QUANTUM = 12 / 255


def quantize(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 / QUANTUM), 0, 255).astype(np.uint8)


class NgramTrie:
    """Words with counts, and under some of them followers with quantised probabilities.

    The words are one Elias-Fano sequence. A second one points from a word to where its followers begin. The followers of
    all words are a third: each is stored relative to its context, added to the last value of the context before, so that
    the whole level ascends; a follower is found as the successor of its value and must lie in its context's range.
    """

    def __init__(self, words: EliasFano, counts: np.ndarray, starts: EliasFano, followers: EliasFano, logs: np.ndarray):
        self.words, self.counts, self.starts, self.followers, self.logs = words, counts, starts, followers, logs

    @classmethod
    def build(
        cls, words: np.ndarray, counts: np.ndarray, contexts: np.ndarray, follows: np.ndarray, log10: np.ndarray
    ) -> NgramTrie:
        """``words`` ascend; pairs ``contexts``, ``follows`` ascend and every context is one of ``words``."""
        level = EliasFano.build(words)
        begin = np.searchsorted(contexts, np.append(words, words[-1:] + _ONE if len(words) else words))
        relative = follows.astype(np.uint64) + _ONE
        if len(contexts):
            new = np.flatnonzero(np.append(True, contexts[1:] != contexts[:-1]))
            last = relative[np.append(new[1:], len(contexts)) - 1]
            base = np.concatenate((np.zeros(1, np.uint64), np.cumsum(last)[:-1]))
            relative = relative + np.repeat(base, np.diff(np.append(new, len(contexts))))
        return cls(level, counts.astype(np.int64), EliasFano.build(begin), EliasFano.build(relative), quantize(log10))

    def count(self, words: np.ndarray) -> np.ndarray:
        """Stored counts, 0 for other words."""
        index = self.words.find(words)
        if not self.words.size:
            return np.zeros(len(words), np.int64)
        return np.where(index >= 0, self.counts[np.maximum(index, 0)], 0)

    def log_probability(self, contexts: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Stored log10 probabilities, NaN for pairs that are not stored."""
        out = np.full(len(contexts), np.nan)
        index = self.words.find(contexts)
        known = np.flatnonzero(index >= 0)
        if not self.followers.size or not len(known):
            return out
        begin = self.starts.at(index[known]).astype(np.int64)
        end = self.starts.at(index[known] + 1).astype(np.int64)
        base = np.where(begin > 0, self.followers.at(np.maximum(begin - 1, 0)), U(0))
        place = self.followers.find(base + follows[known].astype(np.uint64) + _ONE)
        good = (place >= begin) & (place < end)
        out[known[good]] = -QUANTUM * self.logs[place[good]]
        return out

    def _arrays(self) -> dict[str, np.ndarray]:
        out = {"counts": self.counts, "logs": self.logs}
        for name in ("words", "starts", "followers"):
            part = getattr(self, name)
            out |= {f"{name}.low": part.low, f"{name}.high": part.high, f"{name}.ones": part.ones}
            out[f"{name}.shape"] = np.array([part.size, part.width], np.int64)
        return out

    def packed(self) -> tuple[list[tuple[str, str, int, int]], bytes]:
        """A layout (name, type, offset, length) and the bytes of all levels."""
        layout, parts, at = [], [], 0
        for name, values in self._arrays().items():
            raw = values.tobytes()
            layout.append((name, values.dtype.str, at, len(values)))
            raw += b"\0" * (-len(raw) % 8)
            parts.append(raw)
            at += len(raw)
        return layout, b"".join(parts)

    @classmethod
    def mapped(cls, layout: list[tuple[str, str, int, int]], data: bytes) -> NgramTrie:
        """The trie over a memory-mapped file of the levels; the file's name is gone at once."""
        handle, path = tempfile.mkstemp(prefix="trie-")
        try:
            with os.fdopen(handle, "wb") as out:
                out.write(data or b"\0" * 8)
            file = np.memmap(path, np.uint8, "r")
        finally:
            os.unlink(path)
        arrays = {n: file[at : at + size * np.dtype(kind).itemsize].view(kind) for n, kind, at, size in layout}
        level = lambda n: EliasFano(
            *(int(x) for x in arrays[f"{n}.shape"]), arrays[f"{n}.low"], arrays[f"{n}.high"], arrays[f"{n}.ones"]
        )
        return cls(level("words"), arrays["counts"], level("starts"), level("followers"), arrays["logs"])
