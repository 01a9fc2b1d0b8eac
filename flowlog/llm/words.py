"""Words of many texts at once, as numpy arrays with a 64-bit hash each."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\f"))


def finish(h: np.ndarray) -> np.ndarray:
    """Mix all bits of 64-bit hashes."""
    h = h ^ h >> U(33)
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ h >> U(33)
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ h >> U(33)


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as were asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = U(base), U(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            steps = np.full(n, self.base, np.uint64), np.full(n, self.inverse, np.uint64)
            for step in steps:
                step[0] = 1
            self.up, self.down = (np.multiply.accumulate(step) for step in steps)
        return self.up[:n], self.down[:n]


@dataclass
class Words:
    """The words of some texts, one after the other."""

    data: np.ndarray  # bytes of all texts
    begin: np.ndarray  # of each word in ``data``
    end: np.ndarray
    first: np.ndarray  # first word of each text, and the number of all words
    hashes: np.ndarray

    @property
    def text(self) -> np.ndarray:
        """The number of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


class WordHasher:
    """Splits texts at ASCII blanks and hashes the words by tabulation: a random number per byte and place, summed."""

    def __init__(self):
        self.table = np.random.default_rng(35).integers(0, 2**64, (256, 256), np.uint64)
        self.power = Powers(0x9E3779B97F4A7C15)

    def __call__(self, values: list[bytes]) -> Words:
        data = np.frombuffer(b"\n" + b"\n".join(values) + b"\n", np.uint8)
        space = _SPACE[data]
        begin = np.flatnonzero(~space[1:] & space[:-1]) + 1
        end = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        first = np.searchsorted(begin, np.cumsum([1, *(len(v) + 1 for v in values)]))
        length = end - begin
        inside = np.flatnonzero(~space)
        place = inside - np.repeat(begin, length)
        mixed = self.table[place & 255, data[inside]]
        if len(place) and place.max() > 255:
            mixed = mixed * self.power.upto(int(place.max() >> 8) + 1)[0][place >> 8]
        hashes = np.zeros(len(begin), np.uint64)
        if len(begin):
            hashes = finish(np.add.reduceat(mixed, np.concatenate(([0], np.cumsum(length)[:-1]))))
        return Words(data, begin, end, first, hashes)
