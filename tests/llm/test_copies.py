from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from flowlog.llm import minhash, packing, simhash, substring
from flowlog.llm.encoding import TextEncoder, tokenizer_path
from flowlog.llm.components import components

from .data import awkward, awkward_rows, empty, recurring, rows_by_id, words_of

SF = "/root/testdata/sf0.001"


def simhash_of(text: str | None) -> int:
    w = [x.lower() for x in words_of(text)]
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_components_match_brute_force(spark):
    rows = awkward_rows()
    prints = [simhash_of(r[1]) for r in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    members = defaultdict(list)
    for i, r in enumerate(root):
        members[r].append(rows[i][0])
    got = rows_by_id(simhash.simhash_components(awkward(spark)))
    for i, row in enumerate(rows):
        ids = [x for x in members[root[i]] if x is not None]
        assert all(g.fingerprint == f"{prints[i]:016x}" for g in got[row[0]])
        assert all(g.component_id == min(ids, default=None) for g in got[row[0]])
    assert simhash.simhash_components(empty(spark)).count() == 0


def test_one_document_of_each_group_stays(spark):
    docs = awkward(spark)
    kept = simhash.drop_near_duplicates(docs)
    ids = [r.doc_id for r in kept.collect()]
    want = {r.component_id for r in simhash.simhash_components(docs).collect()}
    assert kept.columns == docs.columns and len(ids) == len(want) and set(ids) == want
    assert simhash.drop_near_duplicates(empty(spark)).count() == 0


def test_links_of_a_group_larger_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    rng = np.random.default_rng(4)
    start = int(rng.integers(2**62))
    prints = {start}
    value = start
    for _ in range(150):  # a chain of small steps, and a few far away
        value ^= 1 << int(rng.integers(64))
        prints.add(value)
    prints |= {int(x) for x in rng.integers(0, 2**63, 30)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "print long"))
    roots = {r.node: r.root for r in components(links).collect()}
    todo, seen, parts = set(prints), set(), 0
    while todo:
        stack, parts = [todo.pop()], parts + 1
        while stack:
            a = stack.pop()
            near = {b for b in todo if (a ^ b).bit_count() <= 4}
            todo -= near
            stack += near
        seen.add(parts)
    assert len({roots.get(s, s) for (s,) in signed}) == parts


def test_components_of_a_long_path(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    roots = components(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("b"))))
    assert {r.root for r in roots.collect()} == {0} and roots.count() == 200


def check_passages(docs, rows):
    got = rows_by_id(substring.remove_passages(docs))
    texts = [words_of(t) for _, t in rows]
    for (doc_id, _), words, gone in zip(rows, texts, recurring(texts, 35), strict=True):
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()
        for row in got[doc_id]:
            assert (row.n_words, row.n_removed, row.kept_text) == (len(words), sum(gone), kept)


def test_passages_match_brute_force(spark):
    check_passages(awkward(spark), [(r[0], r[1]) for r in awkward_rows()])
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_passages(docs, [(r.doc_id, r.text) for r in docs.collect()])
    assert substring.remove_passages(empty(spark)).count() == 0


def test_passages_shared_in_part(spark):
    rng = np.random.default_rng(6)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(60):
        a = int(rng.integers(0, 120))
        own = [f"o{i}_{j}" for j in range(40)]
        rows.append((i, " ".join(own[:20] + base[a : a + int(rng.integers(20, 80))] + own[20:])))
    rows += [(90, "x " * 90), (91, " ".join(["p", "q"] * 40)), (92, " ".join(base[3:38])), (93, " ".join(base[3:37]))]
    check_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)


def shingles(text: str) -> set:
    w = words_of(text)
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a: str, b: str) -> float:
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_fingerprints_estimate_similarity(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    errors = []
    got = rows_by_id(minhash.fingerprint_edits(docs))
    for i, following in zip(ids, [*ids[1:], ids[0]], strict=True):
        text, half = texts[i], len(texts[i]) // 2
        edited = text[: len(text) - half] + texts[following][:half]
        (row,) = got[i]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [row.near_edited - similarity(text, edited), row.near_next - similarity(text, texts[following])]
    assert np.abs(errors).mean() < 0.03 and abs(np.mean(errors)) < 0.01 and np.abs(errors).max() < 0.2
    same = defaultdict(set)
    for rows in got.values():
        same[texts[rows[0].doc_id]].add(rows[0].fingerprint)
    assert all(len(prints) == 1 for prints in same.values())


def test_fingerprints_of_awkward_rows(spark):
    got = minhash.fingerprint_edits(awkward(spark)).collect()
    assert len(got) == len(awkward_rows())
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    blank = {r.fingerprint for r in got if r.doc_id in (0, 1, 2)}
    assert blank == {""} and all(len(r.fingerprint) == 2 * minhash.BINS for r in got if r.doc_id not in (0, 1, 2))
    assert minhash.fingerprint_edits(empty(spark)).count() == 0
    (one,) = minhash.fingerprint_edits(spark.createDataFrame([(5, "a b c d e f")], "doc_id long, text string")).collect()
    assert one.near_next == 1.0


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    rows = awkward_rows()
    got = packing.pack_documents(awkward(spark)).collect()
    by_id, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc_id, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        times = sum(row[0] == doc_id for row in rows)
        starts = sorted({r.start for r in by_id[doc_id]})
        assert starts == list(range(0, len(ids), 2048)) and len(by_id[doc_id]) == times * len(starts)
        for r in by_id[doc_id]:
            assert r.length == min(2048, len(ids) - r.start) and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert packing.pack_documents(empty(spark)).count() == 0


def test_plan_uses_up_any_histogram_with_little_padding():
    rng = np.random.default_rng(8)
    for histogram in (
        np.bincount(rng.integers(1, 2049, 60_000), minlength=2049),
        np.bincount(np.r_[np.full(20_000, 330), rng.integers(1, 2048, 40_000)], minlength=2049),
        np.bincount([2047] * 3 + [5], minlength=2049),
        np.zeros(2049, np.int64),
    ):
        left = histogram.copy()
        used = total = 0
        for pattern, times in packing.plan_windows(histogram):
            assert sum(pattern) <= 2048 and times > 0
            for n in pattern:
                left[n] -= times
            used += times
            total += times * sum(pattern)
        assert not left.any()
        if histogram.sum() > 1000:
            assert total > 0.97 * used * 2048


def test_encoder_equals_the_tokenizer():
    encoder = TextEncoder(tokenizer_path(packing.TOKENIZER), True, False)
    rng = np.random.default_rng(9)
    parts = ["a", "B", "é", " ", "  ", "\n", "\t", "\x1c", "'s", "!", "*", "1", "　", "\xa0", "😀", "<|endoftext|>", "\0"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(2000)]
    for text, ids in zip(texts, encoder.encode([text.encode() for text in texts]), strict=True):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
