"""Splits of CSV files: rows, numbers and headers are those of the whole file."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlog.operators import normalize
from flowlog.operators.normalize import normalize_csv
from flowlog.sources.csv_files import CORRUPT, _scan, read_log_csv, scan_bytes
from flowlog.sources.csv_splits import Lines, _texts


def by_character(data: bytes, inside: bool) -> tuple[list[int], bool]:
    """Row ends by walking all characters: S at a cell's start, U in a bare cell, Q in quotes, E after a quote in them."""
    state, ends = "Q" if inside else "S", []
    for i, byte in enumerate(data):
        c = chr(byte)
        if state == "Q":
            state = "E" if c == '"' else "Q"
        elif c == "\n":
            ends.append(i)
            state = "S"
        elif c == ",":
            state = "S"
        elif c == '"':
            state = "Q" if state in "SE" else "U"
        else:
            state = "U"
    return ends, state == "Q"


@pytest.mark.parametrize("alphabet", [b'a",\n\r"', b'"\n', b'aaaa,,\n"'])
def test_rows_end_where_a_character_walk_says(alphabet):
    rng = random.Random(len(alphabet))
    for i in range(3000):
        raw = bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) + b"\n" * (i % 2)
        data = np.frombuffer(raw, np.uint8)
        for inside in (False, True):
            lines = Lines(data)
            assert (lines.row_ends(inside).tolist(), lines.ends_inside(inside)) == by_character(raw, inside), (raw, inside)
            begin, end = lines.rows(inside)
            if len(begin):
                assert _texts(data, begin, end).to_pylist() == [raw[a:b].decode() for a, b in zip(begin, end)]


def test_stray_quotes_are_walked_only_until_both_starts_agree():
    data = np.frombuffer(b'1,"a ""b"" c",x\n' * 50_000, np.uint8)
    lines = Lines(data)
    assert len(lines.rows(True)[0]) == 49_999 and not lines.ends_inside(True)


def hard_file(seed: int, rows: int) -> str:
    rng = random.Random(seed)
    cells = ["1", "", "x y", '"a\nb"', '"q ""r"" s"', '"\n\n"', '"a,b"', 'st"ray', '"', '"ab"cd', '"long ' + "z,\n" * 60 + '"', "é", " "]
    out = ["src,len,flag"]
    for _ in range(rows):
        out.append(",".join(rng.choice(cells[:8] + cells[9:]) for _ in range(rng.choice([3, 3, 3, 3, 2, 4]))))
        if rng.random() < 0.1:
            out.append("")
    return "\n".join(out) + rng.choice(["", "\n", '\n"open,\nto the end'])


@pytest.mark.parametrize("seed, split", [(1, 37), (2, 500), (3, 41), (4, 500), (1, 1 << 20)])
def test_same_rows_as_one_task(spark, tmp_path, seed, split):
    text = hard_file(seed, 300)
    if seed == 2:
        text = text.replace("\n", "\r\n")
    if seed == 3:
        text = "\ufeff" + text
    if seed == 4:
        text = "\n\n" + text
    (tmp_path / "a.csv").write_bytes(text.encode())
    layout = read_log_csv(spark, str(tmp_path), split_bytes=split)[0]
    names = [*layout.cells, CORRUPT]
    assert layout.header == ("src", "len", "flag")
    got = [tuple(r) for r in layout.rows.orderBy("row_index").select("row_index", *names).collect()]
    whole = _scan(spark, layout.header, [f"{tmp_path}/a.csv"], True, False).orderBy("_pos").select(*names).collect()
    # the text of a row with a wrong number of cells has plain line ends
    assert got == [(i, *row[:-1], row[-1] and row[-1].replace("\r\n", "\n")) for i, row in enumerate(whole)]
    assert layout.rows.rdd.getNumPartitions() >= min(8, len(text) // split)


def test_files_of_one_name_are_one_source(spark, tmp_path):
    for i, folder in enumerate(("a", "b", "c")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x y.csv").write_text("src,flag\n" + "".join(f'{i}.{n},"A\n{n}"\n' for n in range(50)))
    (tmp_path / "c" / "x y.csv").write_text("flag,src\nSYN,9.9\n")
    records = normalize_csv(read_log_csv(spark, str(tmp_path), recursive=True, split_bytes=100)).orderBy("row_index").collect()
    assert [r.id for r in records] == [f"x_y.csv:{i}" for i in range(101)]
    assert [r.src_ip for r in records] == [f"{i}.{n}" for i in (0, 1) for n in range(50)] + ["9.9"]


def test_broken_bytes_and_long_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'src,flag\n\xff\xfe,x\n1,"' + b"y\n" * 100_000 + b'"\n2,z\n')
    layout = read_log_csv(spark, str(tmp_path), split_bytes=1000)[0]
    rows = layout.rows.orderBy("row_index").collect()
    assert [(r.row_index, len(r.c1)) for r in rows] == [(0, 1), (1, 200_000), (2, 1)]
    assert rows[0].c0 == "\ufffd\ufffd"


def test_no_exchange_above_the_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("src,len\n" + "".join(f"1.1.1.{i % 250},{i}\n" for i in range(5000)))
    records = normalize_csv(read_log_csv(spark, str(tmp_path), split_bytes=4000))
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")] and "Join" not in plan
    assert records.where("row_index <> bytes").count() == 0 and records.count() == 5000


def test_offsets_of_many_splits_do_not_shuffle_rows(spark):
    """Without a first pass, rows meet a million offsets in the tasks that read them."""
    blocks = spark.range(1_000_000).select(
        F.lit("a.csv").alias("source_file"),
        F.concat(F.lit("hdfs://a/very/long/folder/name/"), F.col("id") % 1000).alias("_path"),
        F.floor(F.col("id") / 1000).alias("_block"),
        F.lit(3).cast("bigint").alias("_n"),
        (F.col("id") * 3).alias("_first"),
    )
    rows = blocks.where("_block < 3").select("source_file", "_path", "_block", (F.col("_first") + 1).alias("_pos"))
    numbered = normalize._numbered(rows, blocks)
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    got = numbered.agg(F.count("*"), F.count_distinct("row_index"), F.max(F.col("row_index") % 3)).first()
    assert tuple(got) == (3000, 3000, 1)
    twice = blocks.limit(10).unionByName(blocks.limit(10))
    with pytest.raises(ValueError, match="one hash"):
        normalize._numbered(rows, twice)


def test_split_size_of_the_session(spark):
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    try:
        for text, size in (("20000", 20_000), ("16m", 16 << 20), ("2g", 2 << 30), ("128MB", 128 << 20), ("7b", 7)):
            spark.conf.set(setting, text)
            assert scan_bytes(spark) == size
    finally:
        spark.conf.set(setting, before)


def test_small_splits_share_tasks(spark, tmp_path):
    """Tasks follow the bytes, as in Spark's own scans, not the number of splits."""
    path = tmp_path / "many.csv"
    path.write_text("src,flag\n" + "".join(f'{i},"a\n{i}"\n' for i in range(5000)))
    layout = read_log_csv(spark, str(path), split_bytes=100)[0]
    rows = layout.rows.select("row_index", "c0", "c1")
    assert rows.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert sorted(tuple(r) for r in rows.collect()) == [(i, f"{i}", f"a\n{i}") for i in range(5000)]
