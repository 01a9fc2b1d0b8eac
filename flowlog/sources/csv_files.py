"""CSV log files whose headers differ from file to file."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .csv_splits import cut_rows, list_splits, resolve, survey

CSV_GLOB = "*.[cC][sS][vV]"
CORRUPT = "_corrupt_record"
# schemes pyarrow opens with the executors' own credentials, and its names for them
_DIRECT_SCHEMES = {s: s for s in ("", "file", "hdfs", "viewfs", "s3", "gs", "abfs", "abfss")} | {"s3a": "s3", "s3n": "s3"}
# a line of these only is blank
_BLANKS = " \t\v\f\r\n"
_FILES = "source_file string, filled boolean"


@dataclass(frozen=True)
class Layout:
    """All files with one header line.

    ``rows`` has text columns ``c0..cn`` by position, the corrupt-record column, ``source_file``, and what orders the rows of a
    file: ``row_index``, their number in it, if ``numbered``, else ``_path, _block, _pos``. ``files`` has ``source_file, filled``,
    whether the file has rows.
    """

    header: tuple[str, ...]
    rows: DataFrame
    files: DataFrame
    numbered: bool

    @property
    def cells(self) -> list[str]:
        return [f"c{i}" for i in range(len(self.header))]

    @property
    def place(self) -> list[str]:
        """Columns that order the rows of a file."""
        return ["row_index"] if self.numbered else ["_path", "_block", "_pos"]

    @property
    def sources(self) -> tuple[str, ...]:
        """Names of the files, fetched to the driver."""
        return tuple(sorted(row.source_file for row in self.files.collect()))

    @property
    def empty(self) -> tuple[str, ...]:
        """Names of the files without rows, fetched to the driver."""
        return tuple(sorted(row.source_file for row in self.files.where(~F.col("filled")).collect()))


def read_log_csv(
    spark: SparkSession,
    paths: str | list[str],
    recursive: bool = False,
    multi_line: bool = True,
    fail_fast: bool = False,
    split_bytes: int | None = None,
) -> list[Layout]:
    """Scan the ``.csv`` files below ``paths``, one scan per distinct header.

    One scan over mixed headers would assign cells by the position of the first file's names. Rows with too few or too many
    cells are kept and flagged in the corrupt-record column, or fail the job with ``fail_fast``. Line breaks in quotes are part
    of a cell. Large files are cut into splits of ``split_bytes`` (as Spark's own scans if not given) at true row ends, for which
    all bytes are read once before. Files without any line are named in a last layout without columns.

    Without ``multi_line`` the files are cut at any line end, without a first pass; a row that a line break cuts then fails
    the job. File systems that pyarrow cannot open are read by Spark's reader, a file by one task.
    """
    if multi_line and _opened_directly(paths):
        return _split_layouts(spark, paths, recursive, fail_fast, split_bytes or scan_bytes(spark))
    by_header: dict[str, list[Row]] = {}
    # a scan skips files of size 0, so those are known from the listing only
    blank = {_plain(uri) for uri in _listed(spark, paths, recursive).inputFiles()}
    # One row per file: the same list the driver keeps to plan a file scan.
    for row in header_lines(spark, paths, recursive).orderBy("path").toLocalIterator():
        if row.header is not None:
            blank.discard(_plain(quote(row.path, safe=":/")))
            by_header.setdefault(row.header, []).append(row)
    layouts = []
    for header, files in sorted(by_header.items()):
        names = tuple(next(csv.reader([header])))
        rows = _scan(spark, names, [f.path for f in files], multi_line, fail_fast)
        known = spark.createDataFrame([(_source_name(f.path), f.filled) for f in files], _FILES)
        layouts.append(Layout(names, rows, known, False))
    if blank:
        layouts.append(_blank_layout(spark, spark.createDataFrame([(_source_name(p), False) for p in sorted(blank)], _FILES)))
    return layouts


def _split_layouts(
    spark: SparkSession, paths: str | list[str], recursive: bool, fail_fast: bool, split_bytes: int
) -> list[Layout]:
    listed = _listed(spark, paths, recursive)
    files = listed.select("path", "length")
    opened = _open
    cut = list_splits(files, split_bytes)
    name = F.replace(F.substring_index("path", "/", -1), F.lit(" "), F.lit("_"))
    splits = resolve(survey(_spread(cut, _tasks(spark, cut.count())), opened), name)
    known = splits.groupBy("path").agg(
        F.first("source_file").alias("source_file"), F.max("rows").alias("rows"), F.first("header").alias("header")
    )
    # a row per distinct header
    headers = splits.where("header is not null").groupBy("header")
    headers = headers.agg(F.count("*").alias("n"), F.sum(F.col("stop") - F.col("start")).alias("bytes")).collect()
    layouts = []
    for row in sorted(headers, key=lambda row: row.header):
        names = tuple(next(csv.reader(row.header.splitlines(keepends=True))))
        mine = F.col("header") == row.header
        # small splits share a task, as small files do in Spark's own scans
        tasks = min(row.n, max(_tasks(spark, row.n), -(-row.bytes // max(split_bytes, scan_bytes(spark)))))
        rows = _cells(cut_rows(_spread(splits.where(mine), tasks), opened), names, fail_fast)
        of_layout = known.where(mine).select("source_file", (F.col("rows") > 0).alias("filled"))
        layouts.append(Layout(names, rows, of_layout, True))
    blank = known.where("header is null").select("source_file", F.lit(False).alias("filled"))
    # a scan skips files of size 0, so those are known from the listing only
    uris = listed.inputFiles()
    if len(uris) > known.count():
        paths_ = spark.createDataFrame([(_plain(uri),) for uri in uris], "plain string")
        seen = known.select(F.regexp_replace("path", r"^(\w+):/*", "$1:/").alias("plain"))
        left = paths_.join(seen, "plain", "left_anti")
        last = F.replace(F.substring_index("plain", "/", -1), F.lit(" "), F.lit("_"))
        blank = blank.unionByName(left.select(last.alias("source_file"), F.lit(False).alias("filled")))
    if not blank.isEmpty():
        layouts.append(_blank_layout(spark, blank))
    return layouts


def _tasks(spark: SparkSession, splits: int) -> int:
    """Tasks for some splits: at least as many as there are cores, if there are as many splits."""
    return max(1, min(splits, spark.sparkContext.defaultParallelism))


def _spread(splits: DataFrame, tasks: int) -> DataFrame:
    """Splits dealt out evenly; these are small rows, which one task can hand out."""
    return splits.coalesce(1).repartition(tasks)


def _blank_layout(spark: SparkSession, files: DataFrame) -> Layout:
    none = spark.createDataFrame([], f"{CORRUPT} string, source_file string, row_index bigint")
    return Layout((), none, files, True)


def _cells(rows: DataFrame, names: tuple[str, ...], fail_fast: bool) -> DataFrame:
    """Cells of whole rows by position."""
    schema = ", ".join([*(f"c{i} string" for i in range(len(names))), f"{CORRUPT} string"])
    parsed = F.from_csv("value", schema, {**_options(fail_fast), "maxColumns": str(max(20480, 2 * len(names)))})
    return rows.select(parsed.alias("r"), "source_file", "row_index").select("r.*", "source_file", "row_index")


def scan_bytes(spark: SparkSession) -> int:
    """The size of a split in Spark's own file scans."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", spark.conf.get("spark.sql.files.maxPartitionBytes").lower()).groups()
    return int(number) << 10 * " kmgt".index(unit or " ")


def _options(fail_fast: bool) -> dict[str, str]:
    return {"mode": "FAILFAST" if fail_fast else "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "escape": '"'}


def _source_name(path: str) -> str:
    return path.rsplit("/", 1)[-1].replace(" ", "_")


def _plain(uri: str) -> str:
    """A path that does not depend on how its URI is written."""
    return re.sub(r"^(\w+):/*", r"\1:/", unquote(uri))


def _listed(spark: SparkSession, paths: str | list[str], recursive: bool) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", CSV_GLOB)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(paths)
        .select("path", "length")  # the content column is pruned, so nothing is opened here
    )


def header_lines(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> DataFrame:
    """``path, header, filled`` of every CSV file.

    The header is the first line that is not blank, ``filled`` tells whether
    rows follow. Reads the start of each file only. File systems that pyarrow cannot open
    are read through Spark's text source instead.
    """
    listed = _listed(spark, paths, recursive).select("path")
    if not _opened_directly(paths):
        return _header_lines_from_text(spark, paths, recursive)

    def open_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = [_filled_lines(p, 2) for p in b.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("path"),
                    pa.array([h[0] if h else None for h in heads], pa.string()),
                    pa.array([len(h) > 1 for h in heads], pa.bool_()),
                ],
                ["path", "header", "filled"],
            )

    return listed.mapInArrow(open_all, "path string, header string, filled boolean")


def _opened_directly(paths: str | list[str]) -> bool:
    given = [paths] if isinstance(paths, str) else paths
    return all(urlsplit(p).scheme.lower() in _DIRECT_SCHEMES for p in given)


def _open(path: str) -> pa.NativeFile:
    """A file, as Spark names it, for reading at any place."""
    scheme, rest = ("file", path.removeprefix("file:")) if path.startswith("file:") else ("", path)
    if scheme or "://" not in path:
        system, name = fs.LocalFileSystem(), re.sub("^//+", "/", rest)
    else:
        system, name = fs.FileSystem.from_uri(quote(direct_uri(path), safe=":/@"))
    return system.open_input_file(name)


def _filled_lines(path: str, n: int) -> list[str]:
    """The first ``n`` lines of a file that are not blank."""
    found: list[str] = []
    with _open(path) as stream:
        pending = b""
        while len(found) < n and (chunk := stream.read(1 << 16)):
            *lines, pending = (pending + chunk).split(b"\n")
            found += [text for line in lines if (text := _line_text(line))]
        if len(found) < n and (text := _line_text(pending)):
            found.append(text)
    return found[:n]


def direct_uri(path: str) -> str:
    """The path under the name that pyarrow has for its file system."""
    scheme, _, rest = path.partition("://")
    return f"{_DIRECT_SCHEMES[scheme.lower()]}://{rest}"


def _line_text(line: bytes) -> str:
    text = line.decode("utf-8", errors="replace").removeprefix("\ufeff").rstrip("\r")
    return text if text.strip(_BLANKS) else ""


def _header_lines_from_text(spark: SparkSession, paths: str | list[str], recursive: bool) -> DataFrame:
    reader = spark.read.option("pathGlobFilter", CSV_GLOB)
    lines = reader.option("recursiveFileLookup", str(recursive).lower()).text(paths)
    numbered = lines.select(
        F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias("path"),
        F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"),
        F.regexp_replace("value", "^\ufeff", "").alias("value"),
    ).where(F.btrim("value", F.lit(_BLANKS)) != "")
    return numbered.groupBy("path").agg(
        F.min_by("value", "at").alias("header"), (F.count("*") > 1).alias("filled")
    )


def _scan(
    spark: SparkSession, names: tuple[str, ...], files: list[str], multi_line: bool, fail_fast: bool
) -> DataFrame:
    _pin_splits(spark)
    cells = [T.StructField(f"c{i}", T.StringType()) for i in range(len(names))]
    schema = T.StructType([*cells, T.StructField(CORRUPT, T.StringType())])
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .options(**_options(fail_fast))
        .option("multiLine", multi_line)
        .csv([glob_escape(f) for f in files])
    )
    # A name arrives URL-encoded, but with a bare plus sign.
    name = F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B")))
    corrupt = F.col(CORRUPT)
    if not multi_line:
        # a row with an odd number of quotes is half of one
        cut = F.raise_error(F.concat(F.lit("line break in quotes, read with multi_line: "), corrupt))
        halved = F.length(F.regexp_replace(corrupt, '[^"]', "")) % 2 == 1
        corrupt = F.when(halved, cut.cast("string")).otherwise(corrupt)
    return rows.select(
        *[c.name for c in cells],
        corrupt.alias(CORRUPT),
        F.replace(name, F.lit(" "), F.lit("_")).alias("source_file"),
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_pos"),
    )


def _pin_splits(spark: SparkSession) -> None:
    """Keep the way files are cut into splits fixed for this session.

    Row numbers come from two scans that must cut a file alike, also when the
    number of executors changes in between.
    """
    setting = "spark.sql.files.minPartitionNum"
    if spark.conf.get(setting, None) is None:
        spark.conf.set(setting, str(spark.sparkContext.defaultParallelism))


def glob_escape(path: str) -> str:
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def raw_rows(layout: Layout) -> DataFrame:
    """Rows of one layout under their header names, for previews.

    Names that repeat, or differ only in case, are kept apart by their position.
    """
    seen: set[str] = set()
    names = []
    for i, name in enumerate(layout.header):
        unique = name.strip() or f"c{i}"
        while unique.lower() in seen:
            unique = f"{unique}.{i}"
        seen.add(unique.lower())
        names.append(unique)
    return layout.rows.select(
        "source_file",
        F.struct(*layout.place).alias("row_order"),
        *[F.col(c).alias(n) for c, n in zip(layout.cells, names)],
    )


def corrupt_counts(layouts: list[Layout]) -> DataFrame:
    """Rows and rows with a wrong number of cells, per file."""
    parts = [
        layout.rows.groupBy("source_file").agg(
            F.count("*").alias("rows"),
            F.count(F.col(CORRUPT)).alias("corrupt"),
            # naming all cells keeps the parser from skipping any
            F.count(F.coalesce(*layout.cells)).alias("filled"),
        )
        for layout in layouts
        if layout.header
    ]
    if not parts:
        raise ValueError("no CSV files with a header")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("source_file").agg(
        F.sum("rows").alias("rows"), F.sum("corrupt").alias("corrupt"), F.sum("filled").alias("filled")
    )
