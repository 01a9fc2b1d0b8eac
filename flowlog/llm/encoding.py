"""Token ids of many texts at once: every different chunk of a slice is tokenized once, all the rest is array work.

A text is cut where no pre-token can cross: before a run of ASCII blanks, and before punctuation that ends such a chunk and
follows a letter or digit. The chunks of a slice become a dictionary; chunks not met before go to the tokenizer, the ids of
all others are kept by the worker from slice to slice and task to task, the less used half of them dropped at ``KEPT``
chunks. The result is what the tokenizer gives for the whole text.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Sequence
from types import ModuleType

import numpy as np
import pyarrow as pa

from .batches import WORKER_STATE

KEPT = 300_000  # chunks whose ids a worker keeps
KEPT_BYTES = 48  # longer chunks are not kept
BLOCK_BYTES = 2 << 20  # of a long text that are encoded at a time

_BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\f"))
# apostrophes may begin a pre-token of letters, and angles and bars belong to special tokens, so they are no marks
_MARK = np.isin(np.arange(256), list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"))
_ASCII = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
_LATIN = np.isin(np.arange(256), [b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)])  # letters after byte C3
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPECIAL = b"<|"


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions ``starts[i], starts[i] + 1, ...`` of all runs, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class TextEncoder:
    """Token ids of texts by one tokenizer file.

    ``blanks`` says whether blanks are part of the vocabulary; if not, they only part words. ``lower`` says that the tokenizer
    lower-cases, so that chunks may be shared across cases.
    """

    def __init__(self, path: str, blanks: bool, lower: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.blanks, self.lower = blanks, lower
        self.code: dict[bytes, int] = {}
        self.start = np.zeros(1024, np.int64)
        self.length = np.zeros(1024, np.int64)
        self.hits = np.zeros(1024, np.int64)
        self.pool = np.zeros(4096, np.uint32)
        self.used = 0  # of the pool

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def encode(self, texts: Sequence[bytes]) -> list[np.ndarray]:
        """Ids of each text of UTF-8 bytes."""
        parts, owner = [], []
        for i, text in enumerate(texts):
            for part in _blocks(text):
                parts.append(part)
                owner.append(i)
        out: list[list[np.ndarray]] = [[] for _ in texts]
        at = 0
        while at < len(parts):
            size, end = 0, at
            while end < len(parts) and (end == at or size + len(parts[end]) <= BLOCK_BYTES):
                size += len(parts[end])
                end += 1
            for i, ids in zip(owner[at:end], self._encode(parts[at:end]), strict=True):
                out[i].append(ids)
            at = end
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, np.uint32) for x in out]

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        raw = b"".join(texts)
        if self.lower and _SPECIAL not in raw:  # special tokens are told by their case
            raw = raw.translate(_LOWER)
        data = np.frombuffer(raw, np.uint8)
        text_at = np.cumsum([0, *map(len, texts)])
        begin, end = self._chunks(data, text_at)
        if not len(begin):
            return [np.zeros(0, np.uint32) for _ in texts]
        first = np.searchsorted(begin, text_at)  # first chunk of each text
        if self.blanks:
            edges = np.append(begin, len(data)).astype(np.int64)
        else:  # only what lies in chunks is kept
            edges = np.concatenate(([0], np.cumsum(end - begin)))
            raw = data[~_BLANK[data]].tobytes()
        chunks = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(begin), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(raw)]
        ).dictionary_encode()
        which = chunks.indices.to_numpy()
        codes = self._codes(chunks.dictionary.to_pylist())[which]
        starts, lengths = self.start[codes], self.length[codes]
        ids = self.pool[spread(starts, lengths)]
        bounds = np.concatenate(([0], np.cumsum(lengths)))[first]
        self._forget()
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _chunks(self, data: np.ndarray, text_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of all chunks; where blanks count, chunks follow each other without gaps."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        blank = _BLANK[data]
        text_starts = text_at[:-1][text_at[:-1] < len(data)]
        if self.blanks:
            cut = np.empty(len(data), bool)
            cut[0] = True
            cut[1:] = blank[1:] & ~blank[:-1]
            cut[text_starts] = True
            begin = np.flatnonzero(cut)
            end = np.append(begin[1:], len(data))
        else:
            before = np.empty(len(data), bool)  # nothing of the same word before
            before[0] = True
            before[1:] = blank[:-1]
            before[text_starts] = True
            begin = np.flatnonzero(~blank & before)
            after = np.empty(len(data), bool)
            after[-1] = True
            after[:-1] = blank[1:]
            after[text_starts[text_starts > 0] - 1] = True
            end = np.flatnonzero(~blank & after) + 1
        # marks that end a chunk, as many as there are, after a letter or digit
        mark = _MARK[data]
        last = np.flatnonzero(~mark)  # the last byte that is no mark, before each chunk's end
        place = np.searchsorted(last, end) - 1
        stem = np.where(place >= 0, last[np.maximum(place, 0)] if len(last) else 0, -1)
        good = (stem >= begin) & (stem < end - 1)
        at = stem[good]
        latin = np.zeros(len(at), bool)
        inside = at > begin[good]
        latin[inside] = (data[at[inside] - 1] == 0xC3) & _LATIN[data[at[inside]]]
        good[np.flatnonzero(good)[~(_ASCII[data[at]] | latin)]] = False
        middle = stem[good] + 1
        return np.sort(np.concatenate((begin, middle))), np.sort(np.concatenate((end, middle)))

    def _codes(self, chunks: list[bytes]) -> np.ndarray:
        found = list(map(self.code.get, chunks))
        fresh = [i for i, code in enumerate(found) if code is None]
        if fresh:
            coded = self.tokenizer.encode_batch_fast([chunks[i].decode() for i in fresh], add_special_tokens=False)
            ids = [encoding.ids for encoding in coded]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((x for row in ids for x in row), np.uint32, int(lengths.sum()))
            count = len(self.code)
            self.start, self.length, self.hits = (
                _room(x, count + len(fresh)) for x in (self.start, self.length, self.hits)
            )
            self.pool = _room(self.pool, self.used + len(flat))
            new = slice(count, count + len(fresh))
            self.start[new] = self.used + np.cumsum(lengths) - lengths
            self.length[new], self.hits[new] = lengths, 0
            self.pool[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
            for i, code in zip(fresh, range(count, count + len(fresh)), strict=True):
                self.code[chunks[i]] = found[i] = code
        codes = np.array(found, np.int64)
        self.hits[codes] += 1
        return codes

    def _forget(self) -> None:
        """Keep the more used half of the chunks once there are too many, and no long ones."""
        if len(self.code) <= KEPT:
            return
        names = list(self.code)
        size = np.fromiter(map(len, names), np.int64, len(names))
        hits = np.where(size > KEPT_BYTES, 0, self.hits[: len(names)])
        keep = np.sort(np.argsort(-hits, kind="stable")[: KEPT // 2])
        keep = keep[size[keep] <= KEPT_BYTES]
        self.code = {names[i]: n for n, i in enumerate(keep.tolist())}
        start, length = self.start[keep], self.length[keep]
        pool = self.pool[spread(start, length)]
        self.start = np.cumsum(length) - length
        self.length, self.hits, self.pool, self.used = length, self.hits[keep] // 2, pool, len(pool)


def _room(x: np.ndarray, size: int) -> np.ndarray:
    if size <= len(x):
        return x
    out = np.zeros(max(size, 2 * len(x)), x.dtype)
    out[: len(x)] = x
    return out


def _blocks(text: bytes) -> list[bytes]:
    """A long text in parts of about ``BLOCK_BYTES``, cut before a blank that follows something else."""
    if len(text) <= BLOCK_BYTES:
        return [text]
    data = np.frombuffer(text, np.uint8)
    blank = _BLANK[data]
    cuts = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    parts, at = [], 0
    while at < len(text):
        i = np.searchsorted(cuts, at + BLOCK_BYTES)
        end = int(cuts[i]) if i < len(cuts) and len(text) - at > BLOCK_BYTES else len(text)
        parts.append(text[at:end])
        at = end
    return parts


def worker_encoder(path: str, blanks: bool, lower: bool) -> TextEncoder:
    """The encoder that the tasks of this worker process share, with the chunks that it keeps.

    Task code comes to a worker by value, so that its module variables last for one task; the encoders hang on a module of
    their own, until a task of another kind runs in the worker (see ``slices``).
    """
    state = sys.modules.setdefault(WORKER_STATE, ModuleType(WORKER_STATE))
    encoders = state.__dict__.setdefault("encoders", {})
    if (path, blanks, lower) not in encoders:
        encoders.clear()  # one at a time
        encoders[path, blanks, lower] = TextEncoder(path, blanks, lower)
    return encoders[path, blanks, lower]


def tokenizer_path(name: str, path: str | None = None) -> str:
    """The given file, or the public one with this name."""
    if path is not None:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)
