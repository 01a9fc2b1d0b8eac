"""Conversations repaired by the cheapest edits, by a Viterbi search whose chunks run side by side.

Rows are damaged, told apart by (conversation, turn, role, text hash) with a number of copies, sorted over all tasks and cut into
ranges. A range is a chunk of each conversation that it touches; a conversation of any length is a chain of chunks. Texts wait
until the edits are known.

A chunk's costs are four numbers before every row: the least cost of the rest from each state of ``(s?(ua)+)?``. Chunks run
from their last row back, all at once. A chunk that does not hold its conversation's end starts from a speculative vector, as if
the conversation ended there. In fix-up passes a chunk runs again from what its right neighbour found, until its vector
differs from its former one only by a constant; all before then differs by this constant too. Passes end when no neighbour's
vector changes its shape. The constants are added up along the chain, and so are the states that the cheapest edits reach:
a chunk is traced from each of the four states, then from the one that is reached. What the driver holds is a row per range.

Ties between rows of one turn go by role, then by SHA-256 of the text; equal rows are copies. Null conversations are one conversation.
A null turn comes first and counts for no gap; a null role or text is a space. Roles go by their first character. Rows of
a conversation that has none left give zeros. An empty table gives no rows. The hash of a repaired conversation is taken in one
stream, row by row, since SHA-256 knows no other way; so a conversation's kept texts pass through one task, without being held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import materialize, scratch_path

# fixed values
FOLDS = 20
DROP, EMPTY, UNSTOP, REPEAT, USER = range(5)
DELETE_COST, EDIT_COST, TRUNCATED_COST = 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"

CHUNK = 50_000  # different rows of a range
#: States: at the start, after a system row, after a user row, after an assistant row.
_END = (0, 4, 2, 0)  # what completing costs from each
_NEXT = (2, 2, 3, 2)  # where a user or assistant row leads
_INITIALS = {"s": 0, "u": 1, "a": 2}
_LEGAL = {(0, 1), (1, 2), (2, 1)}
_LINES = 10_000

Vector = tuple[int, int, int, int]
#: A row that may stay (its initial, -1 if none may), what keeping it costs, and how many rows after it must go.
Element = tuple[int, int, int]


def damaged(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text, copies`` of every row after damage; dropped rows have no copies."""
    named = rows.select(
        F.col(key).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.col(role).cast("string").alias("role"),
        F.col(text).cast("string").alias("text"),
    )
    space = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    name = F.concat(space(F.col("conv")), F.lit(":"), space(F.col("turn")))
    named = named.withColumn("way", F.crc32(name.cast("binary")) % F.lit(FOLDS))
    way = F.col("way")
    text_ = space(F.col("text"))
    return named.select(
        "conv",
        "turn",
        F.when(way == USER, F.lit("user")).otherwise(space(F.col("role"))).alias("role"),
        F.when(way == EMPTY, F.lit("")).when(way == UNSTOP, F.regexp_replace(text_, "[.!?]", "")).otherwise(text_).alias("text"),
        F.when(way == DROP, 0).when(way == REPEAT, 2).otherwise(1).cast("bigint").alias("copies"),
    )


def _digest() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")


def _outline(rows: DataFrame) -> DataFrame:
    """``conv, turn, role, digest, n, blank, truncated, first``: the different rows without their texts.

    ``first`` says that no earlier row of the conversation has this role and text.
    """
    stripped = F.rtrim(F.col("text"), F.lit(BLANKS))
    key = ["conv", "turn", "role", "digest"]
    light = rows.select(
        "conv",
        "turn",
        "role",
        _digest(),
        "copies",
        (stripped == "").alias("blank"),
        (~F.right(stripped, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )
    light = light.groupBy(*key, "blank", "truncated").agg(F.sum("copies").alias("n"))
    path = scratch_path(rows.sparkSession, "outline")
    light.write.parquet(path)
    light = rows.sparkSession.read.schema(light.schema).parquet(path)
    place = F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn"))
    first = light.where((F.col("n") > 0) & ~F.col("blank")).groupBy("conv", "role", "digest").agg(place.alias("place"))
    first = first.select("conv", F.col("place.turn").alias("turn"), "role", "digest", F.lit(True).alias("first"))
    both = light.withColumn("first", F.lit(False)).unionByName(first, allowMissingColumns=True)
    return both.groupBy(*key).agg(
        F.sum("n").alias("n"), F.max("blank").alias("blank"), F.max("truncated").alias("truncated"), F.max("first").alias("first")
    )


def step(after: Vector, element: Element) -> Vector:
    """Costs before an element, from the costs after it."""
    initial, extra, deletes = element
    if deletes:
        more = DELETE_COST * deletes
        after = (after[0] + more, after[1] + more, after[2] + more, after[3] + more)
    if initial < 0:
        return after
    a, b, c, d = after
    edit = EDIT_COST + extra
    user = c + (extra if initial == 1 else edit)  # becomes or stays a user row
    assistant = d + (extra if initial == 2 else edit)
    start = min(DELETE_COST + a, user)
    if initial == 0:
        start = min(start, b + extra)
    system, user_, assistant_ = min(DELETE_COST + b, user), min(DELETE_COST + c, assistant), min(DELETE_COST + d, user)
    c, d = min(user_, EDIT_COST + assistant_), min(assistant_, EDIT_COST + user_)
    return (min(start, EDIT_COST + c), min(system, EDIT_COST + c), c, d)


def backward(elements: list[Element], right: Vector) -> list[Vector]:
    """Costs before each element and, last, after all."""
    out = [right]
    for element in reversed(elements):
        out.append(step(out[-1], element))
    out.reverse()
    return out


def shape(vector: Vector) -> Vector:
    """A vector less its least number: vectors that differ by a constant have one shape."""
    least = min(vector)
    return tuple(x - least for x in vector)


def refit(elements: list[Element], former: list[Vector], right: Vector) -> tuple[Vector, int]:
    """Costs before all elements if ``right`` comes after them, and how many elements ran again.

    ``former`` are the vectors of the run before; as soon as the new one differs only by a constant, the rest follows.
    """
    vector = right
    for i in range(len(elements), -1, -1):
        if shape(vector) == shape(former[i]):
            constant = vector[0] - former[i][0]
            return tuple(x + constant for x in former[0]), len(elements) - i
        if i:
            vector = step(vector, elements[i - 1])
    return vector, len(elements)


def trace(elements: list[Element], costs: list[Vector], state: int, ends: bool) -> tuple[str, list[tuple[int, int]], int]:
    """The least of the cheapest edits from ``state`` on, the rows that are left, and the state reached.

    A row that is left is an element's number, -1 for an inserted one, and the state after it.
    """
    audit, left = [], []

    def insert() -> None:
        nonlocal state
        state = _NEXT[state]
        audit.append("I")
        left.append((-1, state))

    for i, (initial, extra, deletes) in enumerate(elements):
        here = costs[i]
        after = [x + DELETE_COST * deletes for x in costs[i + 1]]
        while initial >= 0:
            if DELETE_COST + after[state] == here[state]:
                audit.append("D")
                break
            to = _NEXT[state]
            if EDIT_COST + here[to] == here[state]:
                insert()
                continue
            if initial == 0 and state == 0 and extra + after[1] == here[0]:
                to, edit = 1, "K"
            else:
                edit = "K" if initial == (1 if to == 2 else 2) and extra + after[to] == here[state] else "R"
            state = to
            audit.append(edit)
            left.append((i, state))
            break
        if deletes:
            audit.append("D" * deletes)
    while ends and _END[state]:
        insert()
    return "".join(audit), left, state


class _Chunk:
    """The rows of one conversation in one range."""

    def __init__(self, conv):
        self.conv = conv
        self.elements: list[Element] = []
        self.names: list[tuple] = []  # turn, role and digest of each element
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.first = self.last = None

    def add(self, turn, role, digest, n, blank, truncated, first) -> None:
        if not n:
            return
        initial = _INITIALS.get(role[:1], 3)
        if self.rows and (self.last, initial) not in _LEGAL:
            self.illegal += 1
        self.illegal += n - 1  # no initial may follow itself
        self.rows += n
        self.first = initial if self.first is None else self.first
        self.last = initial
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.names.append((turn, role, digest))
        if blank:
            self.blank += n
            self.elements.append((-1, 0, n))
        elif not first:
            self.duplicate += n
            self.elements.append((-1, 0, n))
        else:
            self.duplicate += n - 1
            self.truncated += truncated
            self.elements.append((initial, TRUNCATED_COST * truncated, n - 1))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Chunk, bool]]:
    """``range, chunk, whether it is the range's last`` of a sorted range."""
    part, chunk = -1, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "role", "digest", "n", "blank", "truncated", "first")]
        if batch.num_rows:
            part = batch.column("part")[0].as_py()
        for conv, *row in zip(*columns, strict=True):
            if chunk is None or conv != chunk.conv:
                if chunk is not None:
                    yield part, chunk, False
                chunk = _Chunk(conv)
            chunk.add(*row)
    if chunk is not None:
        yield part, chunk, True


def _run(ranges: DataFrame, wanted: set[int] | None, work: Callable[[int, list], Iterator[dict]], schema: str) -> list:
    """``work`` on the first and last chunk of each range (of ``wanted`` if given); a few rows per range."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        part = -1
        if wanted is not None:
            batches = (b for b in batches if b.num_rows and b.column("part")[0].as_py() in wanted)
        for part, chunk, is_last in _chunks(batches):
            first = first or chunk
            last = chunk if is_last else last
        if first is not None:
            rows = list(work(part, [first, last]))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return ranges.mapInArrow(ends, schema).collect()


class _Chain:
    """The ranges in their order, and how the conversations that cross them are solved; a row per range."""

    def __init__(self, ranges: DataFrame):
        self.passes = 0
        self.right: dict[int, Vector] = {}  # shape after the last chunk of a range, where its conversation goes on
        self.entry: dict[int, int] = {}  # state before the first chunk of a range, where it comes from another
        self.offset: dict[int, int] = {}  # what the later ranges of its last conversation cost
        kind = ranges.schema["conv"].dataType.simpleString()

        def speculate(part: int, chunks: list[_Chunk]) -> Iterator[dict]:
            first, last = chunks
            yield {
                "part": part, "first": first.conv, "last": last.conv, "one": first is last,
                "left": list(backward(first.elements, _END)[0]),
            }

        found = _run(ranges, None, speculate, f"part int, first {kind}, last {kind}, one boolean, left array<bigint>")
        rows = {row["part"]: row for row in found}
        order = sorted(rows)
        self.after = {a: b for a, b in zip(order, order[1:], strict=False) if rows[a]["last"] == rows[b]["first"]}
        if not self.after:
            return
        self.before = {b: a for a, b in self.after.items()}
        left = {part: tuple(rows[part]["left"]) for part in order}
        used = {part: shape(_END) for part in self.after}
        # a range of one chunk hands the change of its right neighbour on; others end it
        while True:
            rerun = {part: shape(left[to]) for part, to in self.after.items() if shape(left[to]) != used[part]}
            if not rerun:
                break
            self.passes += 1
            for part, vector in self._fix(ranges, rerun, used):
                if rows[part]["one"]:
                    left[part] = vector
            used |= rerun
        self.right = used
        for part in sorted(self.after, reverse=True):
            to = self.after[part]
            self.offset[part] = min(left[to]) + (self.offset.get(to, 0) if rows[to]["one"] else 0)
        exits = self._exits(ranges)
        for part in order:
            if part in self.after:
                start = self.entry.get(part, 0) if rows[part]["one"] else 0
                self.entry[self.after[part]] = exits[part][start]

    def _fix(self, ranges: DataFrame, rerun: dict[int, Vector], used: dict[int, Vector]) -> list:
        def fix(part: int, chunks: list[_Chunk]) -> Iterator[dict]:
            elements = chunks[1].elements
            vector, again = refit(elements, backward(elements, used[part]), rerun[part])
            yield {"part": part, "left": list(vector), "again": again}

        found = _run(ranges, set(rerun), fix, "part int, left array<bigint>, again bigint")
        return [(row["part"], tuple(row["left"])) for row in found]

    def _exits(self, ranges: DataFrame) -> dict[int, list[int]]:
        right = self.right

        def exits(part: int, chunks: list[_Chunk]) -> Iterator[dict]:
            elements = chunks[1].elements
            costs = backward(elements, right[part])
            yield {"part": part, "exits": [trace(elements, costs, state, False)[2] for state in range(4)]}

        found = _run(ranges, set(self.after), exits, "part int, exits array<int>")
        return {row["part"]: row["exits"] for row in found}


_SUMMARY = (
    "cost bigint, audit string, rows bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "turns bigint, low bigint, high bigint, first int, last int"
)


def _solved(ranges: DataFrame, chain: _Chain) -> DataFrame:
    """A row without ``seq`` for each chunk, with its sums, and one for each row that is left, with its new role."""
    kind = ranges.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, part int, seq bigint, turn bigint, role string, digest binary, new_role string, {_SUMMARY}"
    right, entry, offset = chain.right, chain.entry, chain.offset
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        opening = True
        for part, chunk, is_last in _chunks(batches):
            goes_on = is_last and part in right
            comes = opening and part in entry
            opening = False
            costs = backward(chunk.elements, right[part] if goes_on else _END)
            audit, left, _ = trace(chunk.elements, costs, entry[part] if comes else 0, not goes_on)
            cost = None if comes else costs[0][0] + (offset[part] if goes_on else 0)
            sums = (
                cost, audit, chunk.rows, chunk.blank, chunk.duplicate, chunk.truncated, chunk.illegal,
                chunk.turns, chunk.low, chunk.high, chunk.first, chunk.last,
            )
            out.append((chunk.conv, part, None, None, None, None, None, *sums))
            nothing = (None,) * len(sums)
            for seq, (i, state) in enumerate(left):
                role = "assistant" if state == 3 else "user"
                if i < 0:
                    out.append((chunk.conv, part, seq, None, None, None, role, *nothing))
                else:
                    turn, old, digest = chunk.names[i]
                    kept = chunk.elements[i][0] == state - 1  # states follow the initials
                    out.append((chunk.conv, part, seq, turn, old, digest, old if kept else role, *nothing))
                if len(out) >= _LINES:
                    yield _batch(out, arrow)
                    out = []
        if out:
            yield _batch(out, arrow)

    return ranges.mapInArrow(solve, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class _Conversation:
    """Sums over the chunks of a conversation, and the hash of its repaired rows."""

    def __init__(self, conv):
        self.conv = conv
        self.cost, self.audit, self.rows, self.last, self.low, self.high = 0, [], 0, None, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.hash, self.any, self.seen = hashlib.sha256(), False, None

    def add_chunk(self, r: dict) -> None:
        if r["cost"] is not None:
            self.cost = r["cost"]
        self.audit.append(r["audit"])
        self.blank += r["blank"]
        self.duplicate += r["duplicate"]
        self.truncated += r["truncated"]
        self.illegal += r["illegal"]
        if r["rows"]:
            if self.rows and (self.last, r["first"]) not in _LEGAL:
                self.illegal += 1
            self.last = r["last"]
        self.rows += r["rows"]
        if r["low"] is not None:
            self.turns += r["turns"] - (r["low"] == self.high)
            self.low = r["low"] if self.low is None else self.low
            self.high = r["high"]

    def add_line(self, place: tuple, role: str, text: str | None) -> None:
        if place == self.seen:
            return
        self.seen = place
        self.hash.update((("\n" if self.any else "") + f"{role}:{text or ''}").encode())
        self.any = True

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (
            self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit),
            self.hash.hexdigest(),
        )


def repair_conversations(
    rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK
) -> DataFrame:
    """``<key>, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation."""
    rows = damaged(rows, key, turn, role, text)
    outline = _outline(rows)
    kind = outline.schema["conv"].dataType.simpleString()
    order = ["conv", "turn", "role", "digest"]
    tasks = max(1, -(-outline.count() // chunk))
    ranges = outline.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    ranges = materialize(ranges.withColumn("part", F.spark_partition_id()))
    solved = _solved(ranges, _Chain(ranges))

    texts = rows.where("copies > 0").select("conv", "turn", "role", _digest(), "text")
    texts = texts.groupBy(*order).agg(F.first("text").alias("text"))
    texts = texts.select(*(F.col(c).alias(f"{c}_") for c in order), "text")
    same = F.col("conv").eqNullSafe(F.col("conv_")) & F.col("turn").eqNullSafe(F.col("turn_"))
    same = same & (F.col("role") == F.col("role_")) & (F.col("digest") == F.col("digest_"))
    lines = solved.join(texts, same, "left")
    sums = [field.split()[0] for field in _SUMMARY.split(", ")]
    lines = lines.select("conv", "part", "seq", "new_role", "text", *sums)
    dealt = lines.repartition("conv").sortWithinPartitions("conv", F.col("seq").isNotNull(), "part", "seq")
    schema = (
        f"conv {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
        "audit string, repaired_sha256 string"
    )
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv", "part", "seq", "new_role", "text")]
            for i, (conv, part, seq, new_role, value) in enumerate(zip(*columns, strict=True)):
                if now is None or conv != now.conv:
                    if now is not None:
                        out.append(now.result())
                    now = _Conversation(conv)
                if seq is None:
                    now.add_chunk({c: batch.column(c)[i].as_py() for c in sums})
                else:
                    now.add_line((part, seq), new_role, value)
            if len(out) >= _LINES:
                yield _batch(out, arrow)
                out = []
        if now is not None:
            out.append(now.result())
            yield _batch(out, arrow)

    return dealt.mapInArrow(assemble, schema).withColumnRenamed("conv", key)
