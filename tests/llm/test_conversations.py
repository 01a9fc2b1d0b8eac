from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from flowlog.llm import conversations as C
from flowlog.llm.sql import REPAIR_SQL

SCHEMA = "conv_id long, turn long, role string, text string"
TARGET = re.compile(r"(s?(ua)+)?\Z")
#: Edits lead from state to state of the target by initials.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def damage(rows: list[tuple]) -> dict:
    convs: dict = {}
    for conv, turn, role, text in rows:
        out = convs.setdefault(conv, [])
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        way = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if way == 1:
            text = ""
        if way == 2:
            text = re.sub("[.!?]", "", text)
        if way == 4:
            role = "user"
        out += [(turn, role, text)] * {0: 0, 3: 2}.get(way, 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest())
    return {conv: sorted(out, key=key) for conv, out in convs.items()}


def brute(rows: list[tuple]) -> tuple:
    """Least cost and least audit by a search over (row, state), cheapest first and then by audit."""
    seen: set = set()
    faults = []
    for _, role, text in rows:
        body = text.strip(C.BLANKS)
        if not body:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    heap = [(0, "", 0, 0, ())]
    done = set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        if i == len(rows) and state in (0, 3):
            break
        done.add((i, state))
        push = lambda c, e, at, to, line=None: heapq.heappush(
            heap, (cost + c, audit + e, at, to, lines if line is None else (*lines, line))  # noqa: B023
        )
        for name in ("user", "assistant"):
            if (state, name[0]) in MOVES:
                push(2, "I", i, MOVES[state, name[0]], f"{name}:")
        if i == len(rows):
            continue
        _, role, text = rows[i]
        push(3, "D", i + 1, state)
        if faults[i] in ("blank", "duplicate"):
            continue
        more = faults[i] == "truncated"
        if (state, role[:1]) in MOVES:
            push(more, "K", i + 1, MOVES[state, role[:1]], f"{role}:{text}")
        for name in ("user", "assistant"):
            if (state, name[0]) in MOVES:
                push(2 + more, "R", i + 1, MOVES[state, name[0]], f"{name}:{text}")
    assert TARGET.match("".join(line[0] for line in lines))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [role[:1] for _, role, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        cost,
        audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def expected(rows: list[tuple]) -> dict:
    return {conv: brute(left) for conv, left in damage(rows).items()}


def got(df) -> dict:
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    out = {r.conv_id: tuple(r[n] for n in names) for r in rows}
    assert len(out) == len(rows)
    return out


def talk(seed: int, convs: int, longest: int) -> list[tuple]:
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "usher"]
    words = ["yes.", "no", "why?", " ", "", None, "é ß!", "well \n", "a.\t", "x y z."]
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            turn = rng.choice([t, t, t, t + 1, None, t * 3])
            text = rng.choice(words)
            rows.append((c if c else None, turn, rng.choice(roles), text and f"{text} {rng.randint(0, 9)}{text}"))
    return rows + rows[3:9] + rows[3:5]


@pytest.mark.parametrize("seed,convs,longest,chunk", [(1, 150, 12, 50_000), (2, 40, 30, 7), (3, 3, 200, 11), (4, 2, 300, 5)])
def test_same_as_brute_force(spark, seed, convs, longest, chunk):
    rows = talk(seed, convs, longest)
    out = C.repair_conversations(spark.createDataFrame(rows, SCHEMA).repartition(3), chunk=chunk)
    assert got(out) == expected(rows)


def test_sql_says_the_same():
    rows = talk(5, 120, 9)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    found = con.execute(REPAIR_SQL)
    names = [c[0] for c in found.description]
    assert names[0] == "conv_id"
    assert {r[0]: r[1:] for r in found.fetchall()} == expected(rows)


def elements(seed: int, n: int) -> list[C.Element]:
    rng = random.Random(seed)
    return [(rng.choice([-1, 0, 1, 2, 3]), rng.choice([0, 1]), rng.choice([0, 0, 2])) for _ in range(n)]


def test_refit_stops_where_vectors_differ_by_a_constant():
    for seed in range(30):
        row = elements(seed, 400)
        former = C.backward(row, C._END)
        for right in [(0, 2, 0, 2), (3, 1, 0, 2), (0, 4, 2, 0)]:
            vector, again = C.refit(row, former, right)
            assert vector == C.backward(row, right)[0]
            assert again < 100


def test_chain_takes_fix_up_passes(spark):
    """A conversation over many ranges, in which speculation is wrong: the last rows leave a turn open."""
    rows = [(7, t, "assistant" if t % 2 else "user", f"turn {t}.") for t in range(3, 400)]
    df = spark.createDataFrame(rows, SCHEMA)
    outline = C._outline(C.damaged(df))
    order = ["conv", "turn", "role", "digest"]
    ranges = outline.repartitionByRange(12, *order).sortWithinPartitions(*order)
    chain = C._Chain(C.materialize(ranges.withColumn("part", F.spark_partition_id())))
    assert len(chain.after) == 11 and chain.passes >= 1
    assert got(C.repair_conversations(df, chunk=30)) == expected(rows)


def test_edges(spark):
    assert C.repair_conversations(spark.createDataFrame([], SCHEMA)).collect() == []
    many = [(1, 1, "user", "same.")] * 3000 + [(1, 2, "assistant", "long " * 50_000 + ".")] + [(None, None, None, None)] * 5
    df = spark.createDataFrame(many, SCHEMA).withColumns({c: F.lit(1) for c in ("conv", "way", "n", "part", "seq", "copies")})
    assert got(C.repair_conversations(df)) == expected(many)
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    gone = [(dropped, 0, "user", "Hi.")]
    found = got(C.repair_conversations(spark.createDataFrame(gone, SCHEMA)))
    assert found == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    text_ids = spark.createDataFrame(talk(8, 5, 5), SCHEMA).withColumn("conv_id", F.concat(F.lit("c"), "conv_id"))
    assert C.repair_conversations(text_ids).schema["conv_id"].dataType.simpleString() == "string"
