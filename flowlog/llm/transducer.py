"""A minimal acyclic transducer from terms to their lexicographic ordinals, walked by many terms at once."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np


@dataclass
class Transducer:
    """States with ascending edges. An edge's output counts the terms that its siblings before it, and its state, end.

    The outputs along a term's path add up to the number of terms before it, so ordinals need no table and states with equal
    futures are one.
    """

    start: np.ndarray  # first edge of each state, and the number of edges
    edge: np.ndarray  # state * 256 + byte, ascending
    target: np.ndarray
    output: np.ndarray
    final: np.ndarray  # whether a term ends at the state
    root: int
    size: int  # terms

    @classmethod
    def build(cls, terms: Iterable[bytes]) -> Transducer:
        """From different terms in ascending order. A state is shared as soon as no later term can change it."""
        known: dict[tuple, int] = {}
        edges: list[tuple] = []  # of each finished state, as (byte, target) pairs
        finals: list[bool] = []
        open_: list[list] = [[False, []]]  # the states on the path of the last term
        last = b""

        def finish(depth: int) -> None:
            while len(open_) > depth:
                final, out = open_.pop()
                signature = (final, *out)
                state = known.get(signature)
                if state is None:
                    state = known[signature] = len(edges)
                    edges.append(signature[1:])
                    finals.append(final)
                if open_:
                    open_[-1][1].append((last[len(open_) - 1], state))

        for term in terms:
            common = 0
            for a, b in zip(last, term, strict=False):
                if a != b:
                    break
                common += 1
            if common == len(term) and (term or open_[0][0]):
                raise ValueError("terms must be different and ascend")
            if common < len(last) and term[common] < last[common]:
                raise ValueError("terms must be different and ascend")
            finish(common + 1)
            open_.extend([False, []] for _ in range(len(term) - common))
            open_[-1][0] = True
            last = term
        finish(0)

        degree = np.fromiter(map(len, edges), np.int64, len(edges))
        start = np.concatenate(([0], np.cumsum(degree)))
        flat = [pair for out in edges for pair in out]
        label = np.fromiter((a for a, _ in flat), np.int64, len(flat))
        target = np.fromiter((b for _, b in flat), np.int32, len(flat))
        below = np.zeros(len(edges), np.int64)  # terms from each state on; targets come before the states that lead to them
        output = np.zeros(len(flat), np.int64)
        for state, out in enumerate(edges):
            total = int(finals[state])
            for at, (_, to) in enumerate(out, int(start[state])):
                output[at] = total
                total += below[to]
            below[state] = total
        edge = np.repeat(np.arange(len(edges)), degree) * 256 + label
        root = len(edges) - 1
        return cls(start, edge, target, output, np.array(finals, bool), root, int(below[root]))

    def ordinals(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The ordinal of each term ``data[begin:end]``, -1 for others."""
        out = np.full(len(begin), -1, np.int64)
        live = np.arange(len(begin))
        state = np.full(len(begin), self.root, np.int64)
        total = np.zeros(len(begin), np.int64)
        place = begin.astype(np.int64)
        while len(live):
            done = place == end[live]
            good = done & self.final[state]
            out[live[good]] = total[good]
            going = ~done
            live, state, total, place = live[going], state[going], total[going], place[going]
            if not len(live) or not len(self.edge):
                break
            key = state * 256 + data[place]
            at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            hit = self.edge[at] == key
            live, at = live[hit], at[hit]
            state, total, place = self.target[at].astype(np.int64), total[hit] + self.output[at], place[hit] + 1
        return out

    def term(self, ordinal: int) -> bytes:
        """The term with this ordinal."""
        if not 0 <= ordinal < self.size:
            raise IndexError(ordinal)
        state, out = self.root, bytearray()
        while ordinal or not self.final[state]:
            a, b = self.start[state], self.start[state + 1]
            at = a + int(np.searchsorted(self.output[a:b], ordinal, side="right")) - 1
            ordinal -= int(self.output[at])
            out.append(int(self.edge[at]) & 255)
            state = int(self.target[at])
        return bytes(out)
