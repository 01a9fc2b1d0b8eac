from __future__ import annotations

import random

import corpus_pipeline
from flowlog.llm import components as graph
from flowlog.llm import near_copies, simhash

from .data import SCHEMA, awkward, awkward_rows, empty


def shingle_set(text: str | None) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similar(a: frozenset, b: frozenset) -> bool:
    return 5 * len(a & b) >= 4 * len(a | b)


def kept_by_brute_force(rows: list[tuple]) -> set:
    """Keys that stay, of ``key, text``: the least of each part."""
    todo, kept = {(k, shingle_set(t)) for k, t in rows}, set()
    while todo:
        part = stack = [todo.pop()]
        stack = list(part)
        while stack:
            own = stack.pop()
            near = {x for x in todo if x[1] == own[1] or similar(x[1], own[1])}
            todo -= near
            stack += near
            part = [*part, *near]
        kept.add(min((k is None, k) for k, _ in part)[1])
    return kept


def planted() -> list[tuple]:
    """Texts with copies of which up to a tenth is replaced at one place, so that many bits of a SimHash differ."""
    rng = random.Random(4)
    rows = []
    for _ in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 400))]
        rows.append(" ".join(words))
        for share in (0.02, 0.06, 0.09, 0.1, 0.15):
            n, copy = max(1, int(share * len(words))), list(words)
            at = rng.randrange(len(words) - n)
            copy[at : at + n] = [f"v{rng.randrange(5000)}" for _ in range(n)]
            rows.append(" ".join(copy))
    return list(enumerate(rows))


def test_pipeline_stage_drops_planted_near_copies(spark):
    rows = planted()
    docs = spark.createDataFrame([(i, t, "en", "a", len(t), "k", 1.0, 1, 0) for i, t in rows], SCHEMA).repartition(4)
    stage = dict(corpus_pipeline.STAGES)["near duplicates"]
    want = kept_by_brute_force(rows)
    assert len(want) < len(rows) * 0.6
    assert {r.doc_id for r in stage(spark, docs, "").collect()} == want


def test_chunks_give_the_same_parts(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "CHUNK", 2)
    rows = planted()[:60] + [(1000 + i, " ".join(f"x{j}" for j in range(200 + i))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_copies.drop_near_copies(docs).collect()
    assert {r.doc_id for r in got} == kept_by_brute_force(rows) and len(got) == len({r.doc_id for r in got})


def test_awkward_rows(spark):
    want = kept_by_brute_force([(r[0], r[1]) for r in awkward_rows()])
    got = near_copies.drop_near_copies(awkward(spark))
    assert got.columns == awkward(spark).columns
    assert {r.doc_id for r in got.collect()} == want and got.count() == len(want)
    assert near_copies.drop_near_copies(empty(spark)).count() == 0


def test_simhash_finds_candidates(spark):
    """Fingerprints that differ in four bits or fewer are candidates without a common band; the empty set is none."""
    rows = [(1, 9, 0b1111), (2, 9, 0b1111), (3, 9, 0), (4, 9, 2**40 - 1), (5, 9, 2**40 - 8), (6, 0, 0), (7, 9, 2**62 - 2**30)]
    sets = spark.createDataFrame([(*r, []) for r in rows], "print long, size long, simhash long, bands array<bigint>")
    groups: dict[int, set] = {}
    for r in near_copies._candidates(sets).collect():
        groups.setdefault(r.group, set()).add(r.print)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3], [4, 5]]


def test_one_shuffle_of_whole_rows(spark, monkeypatch):
    """Rows chosen by key and text are shuffled once, though repeated ones are dropped; the other shuffle is of what is chosen."""
    monkeypatch.setattr(near_copies, "components", lambda links: spark.createDataFrame([], "node long, root long"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([(i % 7 or None, f"a b {i % 9}") for i in range(90)], "doc_id long, text string")
        out = near_copies.drop_near_copies(docs)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert sum("Exchange hashpartitioning(" in line and "digest#" in line for line in plan.splitlines()) == 1, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sorted(r.text for r in out.collect()) == [f"a b {i}" for i in range(9)]


def test_candidates_are_shuffled_once(spark):
    """Rows of blocks, and those of neighbours, meet their key's others without a second shuffle."""
    prints = spark.createDataFrame([(i,) for i in range(40)], "print long")
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)], "u long, v long")
    for df, key in ((simhash.fingerprint_links(prints), "key"), (graph._large_star(edges), "u"), (graph._small_star(edges), "u")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert sum(f"Exchange hashpartitioning({key}#" in line and ", v#" not in line for line in plan.splitlines()) == 1, plan
    assert {r.root for r in graph.components(edges).collect()} == {0}
