from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowlog.llm import encoding, token_files
from flowlog.llm.queries import QUERIES

from .data import awkward, awkward_rows, empty

SF = "/root/testdata/sf0.001"
FILES = [("byte_bpe_50k.json", True, False), ("word_bpe_49k.json", False, True)]


def hard_texts() -> list[str]:
    rng = random.Random(5)
    pieces = list("aZé9 \t\n.,'!<|>") + ["'s", "'ll", "don't", "<|endoftext|>", "<|ENDOFTEXT|>", "é", " ", "　"]
    pieces += ["\x1c", "\x85", "  ", " \n", "日本", "😀", "×", "÷", "ﬁ", "İ", "Σς", "1", "22", "the", "Word", "K"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    return [*texts, "", "x" * 5000, "a, " * 4000, " . ".join(str(i) for i in range(3000))]


@pytest.mark.parametrize("name,blanks,lower", FILES)
def test_chunks_give_the_ids_of_whole_texts(name, blanks, lower, monkeypatch):
    monkeypatch.setattr(encoding, "KEPT", 500)
    monkeypatch.setattr(encoding, "BLOCK_BYTES", 2000)
    encoder = encoding.TextEncoder(encoding.tokenizer_path(name), blanks, lower)
    plain = Tokenizer.from_file(encoding.tokenizer_path(name))
    values = [row[1] or "" for row in awkward_rows()] + hard_texts()
    for at in range(0, len(values), 40):
        part = values[at : at + 40]
        for text, ids in zip(part, encoder.encode([t.encode() for t in part]), strict=True):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    assert len(encoder.code) <= 500 + 1000


@pytest.mark.parametrize("bits", [1, 7, 15, 16, 17, 31, 32])
def test_packed_ids_come_back(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << bits, n).astype(np.uint32)
        data = token_files.pack(ids, bits)
        assert len(data) == -(-n // 64) * 8 * bits
        assert (token_files.unpack(data, bits, n) == ids).all()
    with pytest.raises(ValueError):
        token_files.pack(np.array([1 << bits], np.uint64), bits)


def test_bits_are_the_fewest():
    assert [token_files.bits_for(n) for n in (1, 2, 3, 32_000, 49_408, 65_536, 65_537)] == [1, 1, 2, 15, 16, 16, 17]


def test_any_range_of_a_file(tmp_path):
    rng = np.random.default_rng(1)
    documents = [rng.integers(0, 49_408, n).astype(np.uint32) for n in (0, 1, 300, 64, 0, 1000, 7)]
    writer = token_files.TokenFileWriter(f"file:{tmp_path}/a b/x.ids", 16, 128)
    for i, ids in enumerate(documents):
        writer.add(None if i == 3 else f"ключ {i}", ids)
    writer.close()
    file = token_files.TokenFile(f"file:{tmp_path}/a b/x.ids")
    assert file.keys == ["ключ 0", "ключ 1", "ключ 2", None, "ключ 4", "ключ 5", "ключ 6"]
    flat = np.concatenate(documents)
    for i, ids in enumerate(documents):
        assert (file.document(i) == ids).all()
    for a, b in [(0, 0), (0, len(flat)), (127, 129), (128, 256), (200, 10**9), (len(flat) - 1, len(flat))]:
        assert (file.ids(a, b) == flat[a:b]).all()


def expected(rows: list[tuple]) -> list[tuple]:
    """By key, nulls first; rows with one key in any order must have equal sums."""
    plain = Tokenizer.from_file(encoding.tokenizer_path("word_bpe_49k.json"))
    out = []
    for key, text in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return out


def check(got: list, rows: list[tuple]) -> None:
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted(x[1:] for x in expected(rows))
    at = 0
    last = None
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and (last is None or (r.doc_id is not None and r.doc_id >= last))
        at += r.n_tokens
        last = r.doc_id
    by_key = lambda x: (x[0] is not None, x)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=by_key) == sorted(expected(rows), key=by_key)


def test_awkward_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "_READ", 500)
    rows = [(r[0], r[1]) for r in awkward_rows()]
    check(token_files.token_ids(awkward(spark)).collect(), rows)
    manifest = token_files.write_token_files(awkward(spark), f"{tmp_path}/few", files=3)
    assert manifest.count() <= 3 and manifest.agg(F.sum("n_docs")).first()[0] == len(rows)
    check(token_files.read_token_files(manifest).collect(), rows)
    assert token_files.token_ids(empty(spark)).collect() == []
    clash = awkward(spark).selectExpr("doc_id", "text", "1 as row", "2 as tie", "3 as name", "4 as part", "5 as start")
    check(token_files.token_ids(clash).collect(), rows)
    assert token_files.token_ids(awkward(spark), key="key").schema["key"].dataType.simpleString() == "string"


def test_registered_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(QUERIES["op11_token_ids"](spark, SF).collect(), rows)
