"""Token-id files: ids in the fewest bits that the vocabulary needs, read back by block.

Documents are sorted by key over all tasks; each task encodes its range and streams it into one file, so ids of the corpus lie
in ascending key order over the files in their order. A file holds

* blocks of ``BLOCK`` ids, each packed from a 64-bit word boundary on at ``bits`` bits an id, lowest bits first;
* the footer: ids of each document, the documents' keys as text, the place of every block, and a fixed tail that says where
  these are.

64 ids fill exactly ``bits`` words, so a block is packed and unpacked lane by lane over whole arrays. The block places give
random access: a range of ids reads and unpacks its blocks only.

A manifest row names each file that a task has finished. A task that is run again writes another file and the manifest names
one of them; files that no manifest row names are never read.

Null and empty texts are the end id alone. Null keys come first; rows with one key are ordered by a hash of their text, and
repeated rows are written as often as they come. Keys go through their text form and are cast back. No rows give no files and
no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .batches import slices, texts
from .encoding import tokenizer_path, worker_encoder

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
BLOCK = 1 << 14
_SLICE = 2 << 20
_MAGIC = b"TOKBITS1"
_TAIL = "<QQQQQII8s"  # places of the three footer parts, documents, ids, bits, ids of a block, magic
_NULL = 0xFFFFFFFF
_READ = 1 << 21  # ids that a reader holds at a time

MANIFEST = "part int, path string, n_docs bigint, n_ids bigint"


def bits_for(vocabulary: int) -> int:
    """The fewest bits that tell ``vocabulary`` ids apart."""
    return max(1, (max(1, vocabulary) - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids at ``bits`` bits each, filled up with zeros to a multiple of 64 ids."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    lanes = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    lanes.ravel()[: len(ids)] = ids
    words = np.zeros((len(lanes), bits), np.uint64)
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        words[:, word] |= lanes[:, lane] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= lanes[:, lane] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    """The first ``count`` ids of packed ``data``."""
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    lanes = np.empty((len(words), 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | words[:, word + 1] << np.uint64(64 - shift)
        lanes[:, lane] = value & mask
    return lanes.ravel()[:count]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(url.path) if url.scheme else path
    return fs.FileSystem.from_uri(path)


class TokenFileWriter:
    """Writes documents one after the other; holds less than a block of ids beside the index."""

    def __init__(self, path: str, bits: int, block: int = BLOCK):
        if block % 64:
            raise ValueError("a block holds a multiple of 64 ids")
        self.path, self.bits, self.block = path, bits, block
        system, place = _open(path)
        if isinstance(system, fs.LocalFileSystem):
            system.create_dir(place.rsplit("/", 1)[0], recursive=True)
        self.out = system.open_output_stream(place)
        self.at = self.out.write(_MAGIC)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.blocks: list[int] = []
        self.sizes: list[int] = []
        self.keys: list[bytes | None] = []

    def add(self, key: str | None, ids: np.ndarray) -> None:
        self.keys.append(None if key is None else key.encode())
        self.sizes.append(len(ids))
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block:
            ids = np.concatenate(self.waiting)
            whole = len(ids) // self.block * self.block
            for start in range(0, whole, self.block):
                self._write_block(ids[start : start + self.block])
            self.waiting, self.n_waiting = [ids[whole:].copy()], len(ids) - whole

    def _write_block(self, ids: np.ndarray) -> None:
        self.blocks.append(self.at)
        self.at += self.out.write(pack(ids, self.bits))

    def close(self) -> None:
        if self.n_waiting:
            self._write_block(np.concatenate(self.waiting))
        places = []
        lengths = np.array([_NULL if key is None else len(key) for key in self.keys], "<u4")
        parts = (
            np.array(self.sizes, "<u8").tobytes(),
            lengths.tobytes() + b"".join(key or b"" for key in self.keys),
            np.array(self.blocks, "<u8").tobytes(),
        )
        for part in parts:
            places.append(self.at)
            self.at += self.out.write(part)
        self.out.write(struct.pack(_TAIL, *places, len(self.sizes), self.n_ids, self.bits, self.block, _MAGIC))
        self.out.close()


class TokenFile:
    """A written file: its documents, and any range of its ids."""

    def __init__(self, path: str):
        system, place = _open(path)
        self.file = system.open_input_file(place)
        end = self.file.size()
        sizes, keys, blocks, documents, self.n_ids, self.bits, self.block, magic = struct.unpack(
            _TAIL, self.file.read_at(struct.calcsize(_TAIL), end - struct.calcsize(_TAIL))
        )
        if magic != _MAGIC:
            raise ValueError(f"{path} is no token file")
        self.starts = np.concatenate(
            ([0], np.cumsum(np.frombuffer(self.file.read_at(keys - sizes, sizes), "<u8"), dtype=np.int64))
        )
        index = self.file.read_at(blocks - keys, keys)
        lengths = np.frombuffer(index, "<u4", documents)
        at = 4 * documents
        self.keys: list[str | None] = []
        for n in lengths.tolist():
            if n == _NULL:
                self.keys.append(None)
            else:
                self.keys.append(index[at : at + n].decode())
                at += n
        self.blocks = np.frombuffer(self.file.read_at(end - struct.calcsize(_TAIL) - blocks, blocks), "<u8")
        self.end = sizes  # of the last block

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to before ``stop``; reads the blocks that hold them."""
        stop = min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        at = int(self.blocks[first])
        till = int(self.blocks[last + 1]) if last + 1 < len(self.blocks) else self.end
        base = first * self.block
        # all blocks but a file's last are full, and so follow each other without a gap
        found = unpack(self.file.read_at(till - at, at), self.bits, stop - base)
        return found[start - base :]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def close(self) -> None:
        self.file.close()


def write_token_files(
    docs: DataFrame,
    folder: str,
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    end_id: int = END_ID,
    files: int | None = None,
) -> DataFrame:
    """Write all documents into token files below ``folder``; the manifest of the files, in their order by ``part``.

    There are as many files as the scan of ``docs`` has tasks, unless ``files`` says otherwise. The tokenizer is one that
    drops blanks and lower-cases.
    """
    rows = docs.select(
        F.col(key).alias("key"),
        F.col(key).cast("string").alias("name"),
        F.col(text).cast("string").alias("text"),
        F.xxhash64(F.col(text).cast("string")).alias("tie"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["key", "tie", "row"]
    tasks = files or max(1, rows.rdd.getNumPartitions())
    ranges = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("name", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer_path(TOKENIZER, tokenizer), False, True)
        part = TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        writer = None
        for batch in slices(batches, "text", _SLICE, keep=True):
            if writer is None:
                bits = bits_for(max(encoder.vocabulary, end_id + 1))
                writer = TokenFileWriter(f"{folder}/part-{part:05d}-{uuid.uuid4().hex}.ids", bits)
            names = batch.column("name").to_pylist()
            for name, ids in zip(names, encoder.encode(texts(batch, "text")), strict=True):
                writer.add(name, np.concatenate((ids, end)))
        if writer is not None:
            writer.close()
            row = {"part": [part], "path": [writer.path], "n_docs": [len(writer.sizes)], "n_ids": [writer.n_ids]}
            yield pa.RecordBatch.from_pydict(row, schema=_MANIFEST_ARROW)

    path = scratch_path(docs.sparkSession, "manifest")
    ranges.mapInArrow(write, MANIFEST).write.parquet(path)
    return docs.sparkSession.read.schema(MANIFEST).parquet(path)


_MANIFEST_ARROW = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def read_token_files(manifest: DataFrame, key: str = "doc_id", key_type: str = "bigint") -> DataFrame:
    """``<key>, start, n_tokens, ids_crc32`` of every document in the files of a manifest.

    ``start`` counts the ids of all documents before; the manifest has a row per file, so its prefix sum is small.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", "n_docs", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                file = TokenFile(path)
                yield from _documents(file, start)
                file.close()

    found = files.repartition(max(1, manifest.count())).mapInArrow(
        read, "name string, start bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return found.select(F.col("name").cast(key_type).alias(key), "start", "n_tokens", "ids_crc32")


def _documents(file: TokenFile, before: int) -> Iterator[pa.RecordBatch]:
    """Checksums of the documents, from ranges of about ``_READ`` ids; a longer document is summed range by range."""
    sizes = np.diff(file.starts)
    at = 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(file.starts, file.starts[at] + _READ, side="right")) - 1)
        base = int(file.starts[at])
        sums = []
        if stop == at + 1:
            crc, end = 0, int(file.starts[stop])
            for start in range(base, end, _READ):
                crc = zlib.crc32(file.ids(start, min(start + _READ, end)).astype("<u4").tobytes(), crc)
            sums.append(crc)
        else:
            ids = file.ids(base, int(file.starts[stop])).astype("<u4")
            edges = file.starts[at : stop + 1] - base
            sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(file.keys[at:stop], pa.string()),
                pa.array(file.starts[at:stop] + before),
                pa.array(sizes[at:stop]),
                pa.array(sums, pa.int64()),
            ],
            ["name", "start", "n_tokens", "ids_crc32"],
        )
        at = stop


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Encode ``docs`` into token files in the scratch folder and describe each document from the files."""
    folder = scratch_path(docs.sparkSession, "token-files")
    manifest = write_token_files(docs, folder, key, text, tokenizer)
    return read_token_files(manifest, key, docs.select(key).schema[0].dataType.simpleString())

