"""Quality rules with compression bands.

A text is compressed as a whole and in fixed chunks with zstandard. The ratio of raw to compressed size says how much of
it repeats: repeated lines and word lists compress far better than prose, random bytes and base64 hardly at all. Hexadecimal
digits compress nearly as well as prose (1.84 against 1.88 in a chunk) and are not told from it by ratios. Short texts
compress less than long ones, so the limits follow the length: the least ratio by bands of lengths, the greatest along a line
through the ratios of natural text. A text is rejected when its whole ratio leaves these limits, or when more than ``MAX_BAD_CHUNKS`` of its chunks leave the chunk band.

A text needs 50 words or more and few repeated phrases before the bands are asked (``base_failed``). Null and empty texts
have no words and fail. Texts are handled whole, one at a time; repeated rows get the same answer; no rows give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices, texts

MIN_WORDS = 50
MAX_REPEATED = 50  # percent of words in repeated three-word windows
LEVEL = 3
CHUNK_BYTES = 1024
MAX_BAD_CHUNKS = 0.2
#: Bytes below which a row holds, and the least ratio. The least ratios lie between random letters and digits (1.12 at
#: 300 bytes, 1.26 at 700, 1.36 at 4,000, 1.37 above; base64 a little less) and the least of the documents of sf0.1 with 50
#: words or more (1.34 from 300 bytes, 1.43 from 500, 1.57 from 700, 1.69 from 1,000, 1.92 from 2,000, 2.09 from 4,000). From
#: 4,000 bytes on they also lie above a text that is half base64 (about 1.6).
LEAST = (
    (300, 1.13),
    (500, 1.25),
    (700, 1.32),
    (1_000, 1.4),
    (2_000, 1.45),
    (4_000, 1.55),
    (20_000, 1.7),
    (100_000, 1.75),
    (float("inf"), 1.8),
)
#: Greatest ratio at powers of two of bytes, straight lines between. Up to 2**14.5 bytes each lies about 0.02 to 0.1 above all
#: documents of sf0.1 that are labelled good (1.84 at 2**8.5 bytes, 1.99 at 2**10, 2.15 at 2**11, 2.24 at 2**12, 2.36 at 2**13,
#: 2.44 at 2**14); labelled junk of lists and symbols reaches 2.02 in the middle at 2**10, 2.26 at 2**11, 2.44 at 2**12, 2.57 at
#: 2**13, 2.70 at 2**14. Longer texts have more to repeat.
GREATEST = (
    (8.0, 1.9),
    (9.0, 1.9),
    (9.5, 1.96),
    (10.0, 2.02),
    (10.5, 2.1),
    (11.0, 2.17),
    (11.5, 2.23),
    (12.0, 2.29),
    (13.0, 2.42),
    (14.0, 2.54),
    (14.5, 2.62),
    (16.0, 3.0),
    (20.0, 3.6),
)
#: Random letters and digits reach 1.30 in a chunk, base64 1.25, lines of which 70 % are base64 1.39; the least chunk of the
#: documents of sf0.1 has 1.66. Good documents of about a chunk's size have up to 1.99.
CHUNK_BAND = (1.45, 2.4)
# fixed value: the counted symbols
SYMBOLS = b"#*$%&|<>"

_SYMBOL = re.compile(b"[" + re.escape(SYMBOLS) + b"]")


def _repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more."""
    counts = Counter(zip(words, words[1:], words[2:], strict=False))
    if len(counts) == max(0, len(words) - 2):
        return 0
    starts = [counts[window] > 1 for window in zip(words, words[1:], words[2:], strict=False)]
    marked = np.zeros(len(words), bool)
    hits = np.array(starts)
    for shift in range(3):
        marked[shift : shift + len(hits)] |= hits
    return int(marked.sum())


def _repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.split()]
    return len(lines) - len(set(lines))


def _code_points(data: bytes) -> int:
    codes = np.frombuffer(data, np.uint8)
    return int(((codes & 0xC0) != 0x80).sum())


def limits(size: int) -> tuple[float, float]:
    """Least and greatest ratio of a text of ``size`` bytes."""
    least = next(low for limit, low in LEAST if size < limit)
    return least, float(np.interp(np.log2(max(1, size)), *zip(*GREATEST, strict=True)))


def verdict(text: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Whole ratio, share of chunks outside the chunk band, and whether the text passes."""
    ratio = len(text) / len(compressor.compress(text))
    least, greatest = limits(len(text))
    # the last chunk takes what is left, so that no chunk is shorter than the fixed size unless the text is
    cuts = list(range(0, max(1, len(text) - CHUNK_BYTES + 1), CHUNK_BYTES))
    chunks = [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)] if len(text) >= CHUNK_BYTES else []
    ratios = [len(chunk) / len(compressor.compress(chunk)) for chunk in chunks]
    bad = sum(not CHUNK_BAND[0] <= r <= CHUNK_BAND[1] for r in ratios) / max(1, len(ratios))
    return ratio, bad, least <= ratio <= greatest and bad <= MAX_BAD_CHUNKS


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", level: int = LEVEL) -> DataFrame:
    """Word, line and compression measures of every row of ``docs``, ``base_failed`` and ``kept``."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=level)
        for batch in slices(batches, "text"):
            rows = []
            for value in texts(batch, "text"):
                words = value.split()
                n_words, repeated = len(words), _repeated_words(words)
                failed = n_words < MIN_WORDS or 100 * repeated > MAX_REPEATED * n_words
                ratio, bad, passed = verdict(value, compressor) if value else (0.0, 0.0, False)
                rows.append(
                    (
                        n_words,
                        _code_points(b"".join(words)),
                        len(_SYMBOL.findall(value)),
                        _repeated_lines(value),
                        repeated,
                        failed,
                        passed and not failed,
                        ratio,
                        bad,
                    )
                )
            columns = list(zip(*rows, strict=True))
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            arrays = [pa.array(column, kind) for column, kind in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *arrays],
                ["key", *names, "base_failed", "kept", "ratio", "bad_chunks"],
            )

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, {', '.join(f'{n} bigint' for n in names)}, " + (
        "base_failed boolean, kept boolean, ratio double, bad_chunks double"
    )
    return rows.mapInArrow(measure, schema).withColumnRenamed("key", key)
