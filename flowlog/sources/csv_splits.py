"""CSV files cut into splits at true row ends, though cells may hold line breaks.

A split cannot know from its own bytes whether it starts inside quotes. So a first pass reads every split once and finds, for
either start, how many rows start in it and whether it ends inside quotes. Composed along each file, these answers say how
every split starts, and their row counts where its rows stand. A second pass cuts the rows: a split skips the end of a row that began before, and reads on
beyond its own end until its last row is whole.

A quote opens a cell only as its first character; elsewhere it is text, as for the CSV parser that reads the rows then. Quotes
are told apart by arrays; only where a stray quote breaks their even rhythm are they walked one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_BREAK, _QUOTE, _COMMA, _RETURN = 10, 34, 44, 13
_TAIL = 1 << 16  # bytes that a split reads at a time beyond its end
_ROWS = 20_000  # of a batch of cut rows
_BOM = b"\xef\xbb\xbf"
# a line of these only is no header
_BLANKS = " \t\v\f\r\n"

#: ``n`` counts the rows that start in the split, ``to`` says whether it ends in quotes; 0 for a start outside, 1 inside.
SPLITS = (
    "path string, size bigint, start bigint, stop bigint, n0 bigint, n1 bigint, to0 boolean, to1 boolean, "
    "header string, header_at bigint, crlf boolean"
)


class Lines:
    """Whole lines of a file, and where rows begin and end in them if they start outside quotes or inside."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.quotes = np.flatnonzero(data == _QUOTE)
        self.breaks = np.flatnonzero(data == _BREAK)
        self._real: dict[bool, np.ndarray] = {}

    def real_quotes(self, inside: bool) -> np.ndarray:
        """Places of the quotes that open, close or escape."""
        if inside not in self._real:
            self._real[inside] = self._told_apart(inside)
        return self._real[inside]

    def _told_apart(self, inside: bool) -> np.ndarray:
        data, quotes = self.data, self.quotes
        opening = quotes[int(inside) :: 2]
        before = data[np.maximum(opening - 1, 0)]
        fits = (opening == 0) | (before == _BREAK) | (before == _COMMA)
        # an opening quote right after a closing one is the second half of an escaped quote
        if inside:
            fits |= opening == quotes[0:-1:2] + 1
        else:
            fits[1:] |= opening[1:] == quotes[1:-1:2] + 1
        wrong = np.flatnonzero(~fits)
        if not len(wrong):
            return quotes
        at = int(np.searchsorted(quotes, opening[wrong[0]]))  # all before are real
        return self._walked(quotes[:at].tolist(), at, inside)

    def _walked(self, kept: list[int], at: int, inside: bool) -> np.ndarray:
        """Quotes one by one from the first stray one on, until a line that both starts see from outside begins."""
        data, open_, last = self.data, False, kept[-1] if kept else -2
        for step, place in enumerate(self.quotes[at:].tolist()):
            if open_:
                open_, last = False, place
                kept.append(place)
                continue
            if inside and (step < 1000 or step % 64 == 0):
                line = int(np.searchsorted(self.breaks, place)) - 1
                if line >= 0 and self.breaks[line] > last:
                    other = self.real_quotes(False)
                    same = int(np.searchsorted(other, self.breaks[line]))
                    if same % 2 == 0:
                        return np.concatenate((np.array(kept, np.int64), other[same:]))
            if place == 0 or data[place - 1] in (_BREAK, _COMMA) or place == last + 1:
                open_ = True
                kept.append(place)
        return np.array(kept, np.int64)

    def ends_inside(self, inside: bool) -> bool:
        return (len(self.real_quotes(inside)) + int(inside)) % 2 == 1

    def row_ends(self, inside: bool) -> np.ndarray:
        """Places of the line breaks that end a row."""
        in_quotes = (np.searchsorted(self.real_quotes(inside), self.breaks) + int(inside)) % 2 == 1
        return self.breaks[~in_quotes]

    def rows(self, inside: bool) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end, without the line end, of the rows that start here; the last may go on. Empty lines are no rows."""
        data, ends = self.data, self.row_ends(inside)
        begin = ends + 1 if inside else np.concatenate((np.zeros(1, np.int64), ends + 1))
        end = np.append(ends[1:] if inside else ends, len(data))[: len(begin)]
        here = begin < len(data)
        begin, end = begin[here], end[here]
        end = end - ((end > begin) & (data[np.maximum(end - 1, 0)] == _RETURN))
        full = end > begin
        return begin[full], end[full]


@dataclass
class Region:
    """The whole lines of a split: from its first line start to the first one behind it."""

    file: pa.NativeFile
    size: int
    start: int
    stop: int

    def read(self) -> np.ndarray:
        """Bytes of all lines that start in the split."""
        start = max(0, self.start - 1)
        raw = self.file.read_at(self.stop - start, start)
        if self.start:
            cut = raw.find(b"\n")
            if cut < 0 or start + cut + 1 >= self.stop:
                return np.zeros(0, np.uint8)  # one line covers the split
            raw = raw[cut + 1 :]
        parts, end = [raw], min(self.stop, self.size)
        while not parts[-1].endswith(b"\n") and end < self.size:
            more = self.file.read_at(_TAIL, end)
            cut = more.find(b"\n") + 1
            parts.append(more[:cut] if cut else more)
            end += len(parts[-1])
        self.end = end
        return np.frombuffer(b"".join(parts), np.uint8)

    def rest(self, data: np.ndarray, inside: bool) -> np.ndarray:
        """``data`` with the end of the row that goes on behind it, if it ends in quotes."""
        step, end = _TAIL, self.end
        while end < self.size and Lines(data).ends_inside(inside):
            more = np.frombuffer(self.file.read_at(step, end), np.uint8)
            data, end, step = np.concatenate((data, more)), end + len(more), 2 * step
        return data


def list_splits(files: DataFrame, split_bytes: int) -> DataFrame:
    """``path, size, start, stop`` of ``files`` with ``path, length``, each split in a task's reach."""
    places = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes).cast("bigint"))
    cut = files.select("path", F.col("length").alias("size"), F.explode(places).alias("start"))
    return cut.withColumn("stop", F.least(F.col("start") + F.lit(split_bytes), F.col("size")))


def survey(splits: DataFrame, opened) -> DataFrame:
    """The first pass: ``SPLITS``. ``opened`` opens a path for reading."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                with opened(row["path"]) as file:
                    region = Region(file, row["size"], row["start"], row["stop"])
                    lines = Lines(region.read())
                    found = {}
                    for name, inside in (("0", False), ("1", True)):
                        found["n" + name] = len(lines.rows(inside)[0])
                        found["to" + name] = lines.ends_inside(inside)
                    header, at = _header(region, lines) if row["start"] == 0 else (None, None)
                    # a file's line ends, also those in its cells, are read as plain ones
                    crlf = len(lines.breaks) > 0 and lines.breaks[0] > 0 and lines.data[lines.breaks[0] - 1] == _RETURN
                rows.append({**row, **found, "header": header, "header_at": at, "crlf": bool(crlf and row["start"] == 0)})
            yield pa.RecordBatch.from_pylist(rows, schema=_SPLITS_ARROW)

    return splits.mapInArrow(look, SPLITS)


_SPLITS_ARROW = pa.schema(
    [
        ("path", pa.string()),
        ("size", pa.int64()),
        ("start", pa.int64()),
        ("stop", pa.int64()),
        ("n0", pa.int64()),
        ("n1", pa.int64()),
        ("to0", pa.bool_()),
        ("to1", pa.bool_()),
        ("header", pa.string()),
        ("header_at", pa.int64()),
        ("crlf", pa.bool_()),
    ]
)


def _header(region: Region, lines: Lines) -> tuple[str | None, int | None]:
    """The first row that is not blank, and how many rows are before it."""
    data = lines.data
    for i, (begin, end) in enumerate(zip(*lines.rows(False), strict=True)):
        if end == len(data):
            data = region.rest(data, False)
            begin, end = (x[i] for x in Lines(data).rows(False))
        text = data[begin:end].tobytes().removeprefix(_BOM).decode("utf-8", "replace")
        if text.strip(_BLANKS):
            return text, i
    return None, None


def resolve(surveyed: DataFrame, source_name) -> DataFrame:
    """How every split starts and which numbers its rows have; a row per split, cut off from the files by a checkpoint.

    ``inside``: whether it starts in quotes. ``first``: rows of the file before it. ``base``: number in its source of the
    file's row after the header. ``source_name`` makes a source file's name of a path; files of one name are one source, in the order of paths.
    """
    in_file = Window.partitionBy("path").orderBy("start")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    # a split hands its start on, turns it round, or fixes it; a fixed end holds until the next fixed end but for the turns between
    turns = F.col("to0") & ~F.col("to1")
    fixed = F.col("to0") == F.col("to1")
    step = surveyed.withColumns({"turn": turns.cast("int"), "fixed": fixed})
    step = step.withColumn("turned", F.sum("turn").over(in_file))
    mark = F.when(F.col("fixed"), (F.col("to0").cast("int") + F.col("turned")) % 2)
    step = step.withColumn("mark", mark)
    since = F.coalesce(F.last("mark", ignorenulls=True).over(before), F.lit(0))
    start = (since + F.coalesce(F.sum("turn").over(before), F.lit(0))) % 2 == 1
    step = step.withColumn("inside", start)
    step = step.withColumn("n", F.when(F.col("inside"), F.col("n1")).otherwise(F.col("n0")))
    step = step.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    whole = Window.partitionBy("path")
    step = step.withColumns(
        {
            "source_file": source_name,
            "header": F.max("header").over(whole),
            "crlf": F.max("crlf").over(whole),
            "skip": F.coalesce(F.max("header_at").over(whole) + 1, F.lit(0)),
            "rows": F.greatest(F.sum("n").over(whole) - F.coalesce(F.max("header_at").over(whole) + 1, F.lit(0)), F.lit(0)),
        }
    )
    files = step.groupBy("source_file", "path").agg(F.max("rows").alias("rows"))
    earlier = Window.partitionBy("source_file").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(
        F.col("path").alias("path2"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("base")
    )
    out = step.join(files, F.col("path") == F.col("path2"))
    return materialize(
        out.select("source_file", "path", "size", "start", "stop", "inside", "n", "first", "skip", "base", "rows", "header", "crlf")
    )


def cut_rows(splits: DataFrame, opened) -> DataFrame:
    """The second pass: ``value, source_file, row_index`` of all rows behind the headers, a row's text each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with opened(row["path"]) as file:
                    region = Region(file, row["size"], row["start"], row["stop"])
                    data = region.read()
                    lines = Lines(data)
                    begin, end = lines.rows(row["inside"])
                    n = len(begin)
                    if n != row["n"]:
                        raise ValueError(f"{row['path']} changed while it was read")
                    if not n:
                        continue
                    if lines.ends_inside(row["inside"]):  # the last row goes on
                        data = region.rest(data, row["inside"])
                        begin, end = (x[:n] for x in Lines(data).rows(row["inside"]))
                number = row["base"] + row["first"] + np.arange(n) - row["skip"]
                keep = row["first"] + np.arange(n) >= row["skip"]
                begin, end, number = begin[keep], end[keep], number[keep]
                for at in range(0, len(begin), _ROWS):
                    part = slice(at, at + _ROWS)
                    values = _texts(data, begin[part], end[part])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pc.replace_substring(values, "\r\n", "\n") if row["crlf"] else values,
                            pa.array([row["source_file"]]).take(pa.array(np.zeros(len(begin[part]), np.int64))),
                            pa.array(number[part]),
                        ],
                        ["value", "source_file", "row_index"],
                    )

    return splits.mapInArrow(cut, "value string, source_file string, row_index bigint")


def _texts(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """Texts between places; bytes that are no UTF-8 are replaced."""
    low, high = int(begin[0]), int(end[-1])
    edge = np.zeros(high - low + 1, np.int8)
    edge[begin - low] += 1
    edge[end - low] -= 1  # a row is never empty, and line ends lie between rows
    inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    offsets = np.concatenate(([0], np.cumsum(end - begin)))
    return _decoded(
        pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(begin), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[low:high][inside].tobytes())]
        )
    )


def _decoded(raw: pa.Array) -> pa.Array:
    try:
        return raw.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([value.decode("utf-8", "replace") for value in raw.to_pylist()], pa.string())
