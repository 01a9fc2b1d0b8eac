from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlog.llm import divergence
from flowlog.llm.transducer import Transducer

from .data import awkward, awkward_rows, empty

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lookup(transducer: Transducer, terms: list[bytes]) -> list[int]:
    data = np.frombuffer(b"".join(terms) + b"\0", np.uint8)
    edges = np.cumsum([0, *map(len, terms)])
    return transducer.ordinals(data, edges[:-1], edges[1:]).tolist()


def test_transducer_numbers_terms():
    rng = random.Random(2)
    for size in (0, 1, 2, 50, 3000):
        terms = sorted({bytes(rng.choice(b"abc\xc3\xa9") for _ in range(rng.randint(1, 9))) for _ in range(size)})
        found = Transducer.build(terms)
        assert found.size == len(terms)
        assert lookup(found, terms) == list(range(len(terms)))
        assert [found.term(i) for i in range(len(terms))] == terms
        others = [t + b"x" for t in terms[:40]] + [t[:-1] for t in terms[:40]] + [b"", b"zz"]
        known = {t: i for i, t in enumerate(terms)}
        assert lookup(found, others) == [known.get(t, -1) for t in others]
    with pytest.raises(IndexError):
        found.term(found.size)


def test_transducer_is_minimal():
    terms = sorted({a + b + c for a in (b"x", b"yy", b"z") for b in (b"one", b"two") for c in (b"", b"s", b"ed")})
    found = Transducer.build(terms)
    # states with equal futures are one: futures of all prefixes, counted
    futures = {
        frozenset(t[len(p) :] for t in terms if t.startswith(p)) for t in terms for p in (t[:i] for i in range(len(t) + 1))
    }
    assert len(found.final) == len(futures)
    with pytest.raises(ValueError):
        Transducer.build([b"b", b"a"])
    with pytest.raises(ValueError):
        Transducer.build([b"a", b"a"])


def brute(rows: list[tuple], min_docs: int, top: int) -> set[tuple]:
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for lang, source, text in rows]
    in_docs: dict = defaultdict(Counter)
    for lang, _, terms in docs:
        in_docs[lang].update(set(terms))
    out = set()
    for lang in {d[0] for d in docs}:
        kept = [t for t, n in in_docs[lang].items() if n >= min_docs]
        sources = sorted({d[1] for d in docs if d[0] == lang}, key=lambda s: s.encode())
        count = {s: Counter() for s in sources}
        for of, source, terms in docs:
            if of == lang:
                count[source].update(t for t in terms if in_docs[lang][t] >= min_docs)
        whole = sum(count.values(), Counter())

        def shares(c: Counter, kept=kept) -> dict:
            total = c.total() + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        p, q = {s: shares(count[s]) for s in sources}, shares(whole)
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            out |= {(lang, s, "pair", o.decode(), -v, i) for i, (v, o) in enumerate(pairs, 1)}
            more = sorted((-gap(p[s][t], q[t]), t.encode()) for t in kept if count[s][t] and p[s][t] > q[t])
            out |= {(lang, s, "term", t.decode(), -v, i) for i, (v, t) in enumerate(more[:top], 1)}
    return out


def same(got, rows, min_docs=10, top=10):
    got = [tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, min_docs, top)


def sourced_rows() -> list[tuple]:
    rng = random.Random(7)
    words = [f"w{chr(97 + i % 26)}{'é' * (i % 3)}{chr(97 + i // 26)}" for i in range(300)] + ["AbC", "ÄÖ", "日本"]
    rows = []
    for i in range(240):
        text = " ".join(rng.choice(words[: 20 + 40 * (i % 7)]) for _ in range(rng.randint(0, 60)))
        rows.append((["en", "de", None, "en"][i % 4], [None, "", "a", "b", "c", "ß"][i % 6], text))
    return rows + [("xx", "only", "alone"), ("yy", "p", "one"), ("yy", "q", None), rows[3], rows[3]]


@pytest.mark.parametrize("frequent,shard,terms,sources", [(10**6, 10**6, 4096, 256), (100, 7, 16, 2), (1, 50, 5, 3)])
def test_same_as_brute_force(spark, frequent, shard, terms, sources):
    rows = sourced_rows()
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    out = divergence.source_divergence(docs, min_docs=3, frequent=frequent, shard=shard, terms=terms, sources=sources)
    same(out, rows, 3)


def test_shards_know_what_the_frequent_terms_do_not(spark):
    rows = spark.createDataFrame(sourced_rows(), "lang string, source string, text string").fillna("")
    kept = divergence._numbered(divergence._term_documents(rows).where("n_docs >= 3"))
    ways = [divergence.source_counts(rows, kept, frequent, 9, 50) for frequent in (10**6, 100, 1)]
    found = [{tuple(r) for r in way.collect()} for way in ways]
    assert found[0] == found[1] == found[2] and len(found[0]) > 300


def test_long_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "_SLICE", 300)
    rows = [("en", "a", "x" * 1000 + " alpha beta"), ("en", "b", "alpha, " * 200), ("en", "a", "beta " * 150 + "x" * 1000)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").coalesce(1)
    same(divergence.source_divergence(docs, min_docs=2), rows, 2)


def test_awkward_rows(spark):
    rows = [(r[2], r[3], r[1]) for r in awkward_rows()]
    same(divergence.source_divergence(awkward(spark)), rows)
    same(divergence.source_divergence(awkward(spark), min_docs=2), rows, 2)
    assert divergence.source_divergence(empty(spark)).collect() == []
    clash = awkward(spark).withColumns({c: F.lit(1) for c in ("i", "n", "d", "v", "lang2", "ordinal", "term", "rank", "p")})
    same(divergence.source_divergence(clash), rows)


def test_large_counts_stay_exact(spark):
    rows = [(3, 5), (4 * 10**9, 9 * 10**14), (10**15, 10**15), (2, 2 + 10**12)]
    got = spark.createDataFrame(rows, "n long, d long").select("n", "d", divergence._share(F.col("n"), F.col("d")).alias("p"))
    assert all(r.p == 1 + 10**9 * r.n // r.d for r in got.collect())
