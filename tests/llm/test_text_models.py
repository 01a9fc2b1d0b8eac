from __future__ import annotations

import base64
import math
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from flowlog.llm import langid, lm, quality, rules
from flowlog.llm.trie import QUANTUM, EliasFano, NgramTrie

from .data import awkward, awkward_rows, crc_fold, empty, rows_by_id, words_of

SF = "/root/testdata/sf0.01"


def test_quality_is_right_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.quality_scores(docs, labels)
    both = scored.where("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert len(both) > 80 and np.mean([r.predicted == r.quality for r in both]) > 0.95
    kept = {r.doc_id for r in quality.keep_quality(docs, labels).select("doc_id").collect()}
    assert kept == {r.doc_id for r in scored.where("predicted = 1").collect()}


def test_quality_gradient_matches_differences():
    rng = np.random.default_rng(3)
    x, first, y = rng.normal(size=(9, 5)), np.array([0, 2, 3]), np.array([1.0, 0.0, 1.0])
    model = quality.AttentionModel(5)
    loss = lambda: -np.log(np.where(y > 0, model.forward(x, first)[0], 1 - model.forward(x, first)[0])).sum()
    score, kept = model.forward(x, first)
    slope = model.gradient(kept, score - y, first)
    for name, w in model.w.items():
        i = np.unravel_index(rng.integers(w.size), w.shape)
        before = w[i]
        w[i] = before + 1e-6
        up = loss()
        w[i] = before - 1e-6
        down = loss()
        w[i] = before
        assert slope[name][i] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-7)


def test_language_decision_is_that_of_plain_sets(spark):
    """Each language's grams as sets, without filters: the language that holds most grams of a text, and its share."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang is not null and text is not null").collect()
    learn = [r for r in rows if crc_fold(r.doc_id, 3) != 1]
    grams = lambda text: [g for g in zip(*(("\n" + text.lower() + "\n")[i:] for i in range(3)), strict=False) if g[1].isalpha()]
    kind = lambda g: tuple(c if c.isalpha() else "" for c in g)
    counts: dict = {}
    for r in learn:
        counts.setdefault(r.lang, Counter()).update(map(kind, grams(r.text)))
    share = {lang: {g: n / c.total() for g, n in c.items()} for lang, c in counts.items()}
    top: dict = {}
    for c in share.values():
        for g, x in c.items():
            top[g] = max(top.get(g, 0), x if x >= langid.MIN_SHARE else 0)
    sets = {lang: {g for g, x in c.items() if x >= max(langid.MIN_SHARE, langid.MIN_RATIO * top[g])} for lang, c in share.items()}
    docs = spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in rows], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.language_id(docs).collect()}
    for r in rows:
        own = [kind(g) for g in grams(r.text)]
        if not own:
            assert got[r.doc_id].lang_pred == "und"
            continue
        held = {lang: sum(g in s for g in own) for lang, s in sorted(sets.items())}
        best, total = max(held.values()), sum(held.values())
        # the filters' corrected counts stray by a few grams
        assert held[got[r.doc_id].lang_pred] >= best - 0.02 * len(own) - 1
        if len(own) > 300:
            assert got[r.doc_id].score == pytest.approx(best / total, abs=0.02)


def test_quality_score_is_the_formula():
    """Gated attention over passages, one by one and in plain Python."""
    rng = np.random.default_rng(4)
    model = quality.AttentionModel(5)
    x = rng.normal(size=(7, 5))
    w = {k: v.tolist() for k, v in model.w.items()}
    assert {k: np.shape(v) for k, v in w.items()} == {k: v.shape for k, v in model.w.items()}
    scores = model.forward(x, np.array([0, 3]))[0]
    alone = [model.forward(part, np.array([0]))[0][0] for part in (x[:3], x[3:])]
    assert scores == pytest.approx(alone)
    # the order of passages does not matter, a copy of all of them neither
    assert model.forward(x[:3][::-1], np.array([0]))[0][0] == pytest.approx(alone[0])
    assert model.forward(np.concatenate((x[:3], x[:3])), np.array([0]))[0][0] == pytest.approx(alone[0])


def test_long_texts_have_the_passages_of_their_blocks(monkeypatch):
    rng = np.random.default_rng(6)
    text = " ".join("".join(rng.choice(list("abcXY12,."), rng.integers(1, 9))) for _ in range(5000)).encode()
    whole, _ = quality.passage_features([text])
    monkeypatch.setattr(quality, "BLOCK_BYTES", 3000)
    parts, first = quality.passage_features([b"short one", text, b"", b"x" * 9000])
    assert first.tolist() == [0, 1, 1 + len(whole), 2 + len(whole)]
    assert np.allclose(parts[1 : 1 + len(whole)], whole, atol=1e-5)


def test_quality_learns_from_whole_documents(spark):
    rows = [(i, 1, f"{i} " * (64 * n)) for i, n in enumerate([5, 200, 3, 4, 9])] + [(0, 1, "0 " * 320)]
    docs = spark.createDataFrame(rows, "hash long, label int, text string")
    sample = quality._sample(docs, 4, 20).collect()
    assert sorted((r.hash, len(r.text.split()) // 64) for r in sample) == [(0, 5), (2, 3), (3, 4)]


def test_quality_of_awkward_rows(spark):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (None, 0, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(awkward(spark), labels).collect()
    assert len(got) == len(awkward_rows()) and {r.score for r in got} <= {0.5, 1.0}
    none = labels.limit(0)
    assert {r.score for r in quality.quality_scores(awkward(spark), none).collect()} == {0.5}
    real = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.learn_quality(spark.read.parquet(f"{SF}/documents.parquet"), real)
    scored = quality.score_quality(awkward(spark), model, "text", "s").collect()
    assert all(0 <= r.s <= 1 for r in scored)
    assert quality.quality_scores(empty(spark), none).count() == 0


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    both = langid.language_id(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(both) > 200 and np.mean([r.lang_pred == r.lang for r in both]) > 0.99


def test_languages_of_awkward_rows(spark):
    got = rows_by_id(langid.language_id(awkward(spark)))
    for doc_id, text, *_ in awkward_rows():
        for row in got[doc_id]:
            has_letter = any(c.isalpha() for c in (text or "").lower())
            assert (row.lang_pred == "und") == (not has_letter) and 0 <= row.score <= 1
            assert row.held_out == (crc_fold(doc_id, 3) == 1)
    unlabelled = awkward(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.language_id(unlabelled).collect()} == {"und"}
    assert langid.language_id(empty(spark)).count() == 0


def test_bloom_masks_have_every_gram_and_few_others():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 4000).astype(np.uint64)
    members = rng.integers(0, 70, 4000)
    model = langid.LanguageFilter.build([str(i) for i in range(70)], keys, members)
    found = model.hits(keys)
    assert all(int(found[i, m // 64]) >> (m % 64) & 1 for i, m in enumerate(members.tolist()))
    other = model.hits(rng.integers(0, 2**63, 4000).astype(np.uint64))
    assert np.bitwise_count(other).sum() < 400


def test_rules_match_brute_force(spark):
    got = rows_by_id(rules.quality_rules(awkward(spark)))
    compressor = zstandard.ZstdCompressor(level=rules.LEVEL)
    for doc_id, text, *_ in awkward_rows():
        words = [w.decode() for w in words_of(text)]
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if words_of(x)]
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        for row in got[doc_id]:
            assert (row.n_words, row.word_chars) == (len(words), sum(map(len, words)))
            assert row.n_symbols == sum((text or "").count(c) for c in "#*$%&|<>")
            assert (row.n_dup_lines, row.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
            assert row.base_failed == failed
            verdict = bool(text) and rules.verdict(text.encode(), compressor)[2]
            assert row.kept == (not failed and verdict)
    assert rules.quality_rules(empty(spark)).count() == 0


def test_bands_decide_on_the_given_documents(spark):
    """The verdict of every document, computed anew; labelled junk goes that the base rules keep, good documents stay."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = rules.quality_rules(docs).join(docs.select("doc_id", "text"), "doc_id").join(labels, "doc_id", "left").collect()
    pack = zstandard.ZstdCompressor(level=3).compress
    for r in rows:
        raw = (r.text or "").encode()
        size = len(raw)
        kept = not r.base_failed
        if kept:
            ratio = size / len(pack(raw))
            least = 0.0
            for limit, low in sorted(rules.LEAST, reverse=True):
                least = low if size < limit else least
            at = math.log2(size)
            above = next((i for i, (x, _) in enumerate(rules.GREATEST) if x >= at), None)
            if above in (0, None):
                most = rules.GREATEST[0 if above == 0 else -1][1]
            else:
                (x0, y0), (x1, y1) = rules.GREATEST[above - 1 : above + 1]
                most = y0 + (y1 - y0) * (at - x0) / (x1 - x0)
            parts = [raw[i * 1024 : (i + 1) * 1024] for i in range(size // 1024)]
            if parts:
                parts[-1] += raw[len(parts) * 1024 :]
            bad = [p for p in parts if not 1.45 <= len(p) / len(pack(p)) <= 2.4]
            kept = least <= ratio <= most and 5 * len(bad) <= len(parts)
        assert r.kept == kept, r.doc_id
    passed = [r for r in rows if not r.base_failed]
    junk, good = ([r.kept for r in passed if r.quality == label] for label in (0, 1))
    assert len(junk) > 15 and np.mean(junk) < 0.45 and np.mean(good) == 1


def test_bands_reject_repetition_and_noise():
    compressor = zstandard.ZstdCompressor(level=rules.LEVEL)
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(3000)]
    assert rules.verdict(" ".join(words).encode(), compressor)[2]
    assert not rules.verdict(b"buy now and save more today\n" * 200, compressor)[2]
    noise = "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 9000))
    assert not rules.verdict(noise.encode(), compressor)[2]


def _noise(rng: np.random.Generator, n: int) -> bytes:
    """Random letters and digits in words of four to twelve."""
    symbols = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    return " ".join("".join(rng.choice(symbols, rng.integers(4, 13))) for _ in range(n // 5)).encode()[:n]


def test_bands_reject_mixed_and_encoded_text():
    compressor = zstandard.ZstdCompressor(level=rules.LEVEL)
    rng = np.random.default_rng(6)
    passes = lambda text: rules.verdict(text, compressor)[2]
    lists = [list("etaoinshrdlu"), list("etaoinshrdluéß")]
    prose = [" ".join("".join(rng.choice(x, rng.integers(2, 9))) for _ in range(12)).encode() for x in lists * 1500]
    for n in (700, 1500, 3000, 3900, 20_000):
        assert passes(b"\n".join(prose)[:n])
        assert not passes(_noise(rng, n))
        assert not passes(base64.encodebytes(rng.bytes(n))[:n])
    for n, share in ((60_000, 0.7), (120_000, 0.7), (20_000, 0.5)):
        lines = [base64.b64encode(rng.bytes(57)) if rng.random() < share else line[:76] for line in prose]
        assert not passes(b"\n".join(lines)[:n])
    # one random block in prose
    for n in (4_000, 20_000, 60_000):
        random_part = int(0.45 * n)
        assert not passes(b"\n".join(prose)[: n - random_part] + b"\n" + _noise(rng, random_part))


@pytest.mark.parametrize(
    "shares, pair_share, shard", [((1e-6, 1e-5), 1e-5, 10**6), ((2e-3, 5e-3), 1e-3, 5000), ((2e-3, 1e-5), 1e-2, 900), ((1.0, 1e-5), 1.0, 5000)]
)
def test_language_model_matches_brute_force(spark, shares, pair_share, shard):
    frequent, context = shares
    got = rows_by_id(
        lm.score_documents(awkward(spark), frequent_share=frequent, context_share=context, pair_share=pair_share, shard=shard)
    )
    rows = [(i, [*words_of((t or "").lower() if (t or "").isascii() else _ascii_lower(t)), None]) for i, t, *_ in awkward_rows()]
    counts = Counter(w for i, tokens in rows if crc_fold(i, 7) != 2 for w in tokens)
    total, words = sum(counts.values()), len(counts)
    share = lambda w: (counts[w] + 1) / (total + words + 1)
    known = {w for w, n in counts.items() if n >= context * total}
    other = max(1 - sum(map(share, known)), 1 / (total + words + 1))
    kind = lambda w: ("word", w) if w in known else "other"
    pairs = Counter(
        (a, kind(b)) for i, t in rows if crc_fold(i, 7) != 2 for a, b in zip(t, t[1:], strict=False) if a in known
    )
    for doc_id, tokens in rows:
        base = sum(math.log10(share(w)) for w in tokens)
        score = math.log10(share(tokens[0]))
        for a, b in zip(tokens, tokens[1:], strict=False):
            of_kind = share(b) if b in known else other
            p = share(b)
            if a in known:
                mass = (pairs[a, kind(b)] + lm.SMOOTHING * of_kind) / (counts[a] + lm.SMOOTHING)
                p = mass * share(b) / of_kind
            score += math.log10(p)
        for row in got[doc_id]:
            assert row.held_out == (crc_fold(doc_id, 7) == 2) and row.train_tokens == total
            assert (row.n_tokens, row.n_known) == (len(tokens), sum(counts[w] > 0 for w in tokens))
            assert row.base_score == pytest.approx(base, rel=1e-9)
            assert row.score == pytest.approx(score, abs=QUANTUM / 2 * len(tokens) + 1e-6)
    assert lm.score_documents(empty(spark)).count() == 0


def test_language_model_has_pairs_of_rare_words(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 5000)
    common = " ".join(["the", "of"] * 75_000)
    texts = [common] * 4 + ["velvet quorum"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [(i, [*words_of(t), None]) for i, t in enumerate(texts)]
    learn = [t for i, t in rows if crc_fold(i, 7) != 2]
    counts = Counter(w for t in learn for w in t)
    pairs = Counter(p for t in learn for p in zip(t, t[1:], strict=False))
    total, words = sum(counts.values()), len(counts)
    share = lambda w: (counts[w] + 1) / (total + words + 1)
    assert 0 < counts[b"quorum"] < 1e-5 * total
    got = rows_by_id(lm.score_documents(docs, frequent_share=1e-4))
    for doc_id, tokens in rows[4:]:
        score = math.log10(share(tokens[0]))
        for a, b in zip(tokens, tokens[1:], strict=False):
            score += math.log10((pairs[a, b] + lm.SMOOTHING * share(b)) / (counts[a] + lm.SMOOTHING))
        assert got[doc_id][0].score == pytest.approx(score, abs=QUANTUM / 2 * len(tokens) + 1e-6)


def _ascii_lower(text: str | None) -> str:
    return (text or "").encode().lower().decode()


@pytest.mark.parametrize(("n", "top"), [(0, 9), (1, 0), (5, 3), (900, 10), (900, 2**62), (5000, 9000)])
def test_elias_fano_finds_successors(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top + 1, n).astype(np.uint64))
    level = EliasFano.build(values)
    asked = np.concatenate([values, rng.integers(0, top + 3, 300).astype(np.uint64)])
    assert (level.successor(asked) == np.searchsorted(values, asked)).all()
    assert not n or (level.at(np.arange(n)) == values).all()


def test_trie_returns_what_it_stores():
    rng = np.random.default_rng(2)
    words = np.unique(rng.integers(0, 2**63, 2000).astype(np.uint64))
    counts = rng.integers(1, 99, len(words))
    pairs = np.unique(np.stack([rng.choice(words[:90], 5000), rng.integers(0, 300, 5000).astype(np.uint64)]), axis=1)
    logs = -rng.random(pairs.shape[1]) * 9
    trie = NgramTrie.mapped(*NgramTrie.build(words, counts, pairs[0], pairs[1], logs).packed())
    assert (trie.count(words) == counts).all() and not trie.count(words + np.uint64(1)).any()
    assert np.abs(trie.log_probability(pairs[0], pairs[1]) - logs).max() <= QUANTUM / 2 + 1e-9
    stored = set(zip(pairs[0].tolist(), pairs[1].tolist(), strict=True))
    a, b = rng.choice(words[:200], 3000), rng.integers(0, 400, 3000)
    missing = np.isnan(trie.log_probability(a, b))
    assert all(m == ((x, y) not in stored) for m, x, y in zip(missing, a.tolist(), b.tolist(), strict=True))
