"""Keyword search for a whole table of queries."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import haystack, search_terms, term_found
from ..schema import SEARCH_COLUMNS
from ..session import materialize
from .ranking import first_per_key

COMPILED_QUERIES = 512
AUTOMATON_BYTES = 32 << 20  # of query text
MAX_BROADCAST_QUERIES = 50_000
_GRAM = 3


def keyword_search_batch(
    logs: DataFrame,
    queries: DataFrame,
    limit: int = 10,
    columns: Sequence[str] = SEARCH_COLUMNS,
    compiled: int = COMPILED_QUERIES,
) -> DataFrame:
    """Newest ``limit`` hits per query; ``queries`` has ``query_id, query``.

    One scan of the records answers all queries. The predicates of up to
    ``compiled`` queries become part of the plan. The terms of more, up to ``AUTOMATON_BYTES`` of text, become one
    automaton that finds all of them in a record at once; a record is a hit of a query if the terms found are all that the
    query has. A still longer query table is joined: each query is filed under one three-character piece of
    its terms, the piece that the fewest queries have, and a record only meets the queries filed under
    a piece of its text. All ways give the same hits: the columns of ``logs``, ``query_id`` and ``rank``.
    """
    asked = materialize(queries.select("query_id", "query"))
    head = asked.limit(compiled + 1).collect()
    if len(head) <= compiled:
        hits = _one_pass(logs, queries, head, limit, columns)
    elif asked.agg(F.sum(F.octet_length("query") + 16)).first()[0] <= AUTOMATON_BYTES:
        hits = _by_automaton(logs, asked, limit, columns)
    else:
        hits = _joined(logs, asked, limit, columns)
    return hits.select(*logs.columns, "query_id", "rank")


def _terms() -> Column:
    return F.filter(F.split(F.lower("query"), r"(?U)[\s\x1c-\x1f]+"), lambda t: t != "")


class TermMatcher:
    """All term sets that a text holds completely."""

    def __init__(self, sets: list[tuple[str, ...]]):
        import ahocorasick

        uses: dict[str, int] = {}
        for terms in sets:
            for term in terms:
                uses[term] = uses.get(term, 0) + 1
        self.numbers = {term: i for i, term in enumerate(uses)}
        self.patterns = {i: _like(term) for term, i in self.numbers.items() if _WILD.search(term)}
        self.automaton = ahocorasick.Automaton()
        for term, i in self.numbers.items():
            if i not in self.patterns:
                self.automaton.add_word(term, i)
        if len(self.automaton):
            self.automaton.make_automaton()
        # a set is looked at where its term that the fewest sets have is found
        self.filed: dict[int, list[tuple[int, frozenset[int]]]] = {}
        for n, terms in enumerate(sets):
            rarest = min(terms, key=lambda t: (uses[t], -len(t)))
            others = frozenset(self.numbers[t] for t in terms if t != rarest)
            self.filed.setdefault(self.numbers[rarest], []).append((n, others))

    def sets(self, text: str, fields: list[str | None]) -> list[int]:
        """``text`` has all ``fields``; those are tried one by one for terms with wildcards."""
        found = {i for _, i in self.automaton.iter(text)} if len(self.automaton) else set()
        found.update(i for i, like in self.patterns.items() if any(f is not None and like.search(f) for f in fields))
        return [n for i in found & self.filed.keys() for n, others in self.filed[i] if others <= found]


_WILD = re.compile("[%_]")


def _like(term: str) -> re.Pattern:
    parts = {"%": ".*", "_": "."}
    return re.compile("".join(parts.get(c) or re.escape(c) for c in term.strip("%")), re.DOTALL)


def _by_automaton(logs: DataFrame, asked: DataFrame, limit: int, columns: Sequence[str]) -> DataFrame:
    wanted = asked.select("query_id", F.array_sort(F.array_distinct(_terms())).alias("terms")).where(F.size("terms") > 0)
    wanted = materialize(wanted)
    # queries with the same terms have the same hits, and are found once
    sets = sorted(tuple(row.terms) for row in wanted.select("terms").distinct().collect())
    sent = logs.sparkSession.sparkContext.broadcast(sets)
    searched = logs.withColumns({"_text": haystack(columns), "_fields": F.array(*[F.lower(c) for c in columns])})
    kept = logs.columns

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = TermMatcher(sent.value)
        for batch in batches:
            rows, hits = [], []
            fields = batch.column("_fields").to_pylist() if matcher.patterns else [[]] * batch.num_rows
            for i, text in enumerate(batch.column("_text").to_pylist()):
                for n in matcher.sets(text, fields[i]):
                    rows.append(i)
                    hits.append(n)
            if hits:
                found = batch.select(kept).take(pa.array(rows, pa.int64()))
                yield found.append_column("_query", pa.array(hits, pa.int32()))

    schema = T.StructType([*logs.schema.fields, T.StructField("_query", T.IntegerType())])
    hits = searched.mapInArrow(match, schema)
    top = first_per_key(hits, ["_query"], [F.desc("event_ts"), F.desc("id")], limit, "id")
    numbered = [(n, list(terms)) for n, terms in enumerate(sets)]
    names = logs.sparkSession.createDataFrame(numbered, "_set int, _terms array<string>")
    names = wanted.join(names, F.col("terms") == F.col("_terms")).select("query_id", "_set")
    return top.join(names, F.col("_query") == F.col("_set")).drop("_query", "_set")


def _pieces(text: Column, size: Column) -> Column:
    """All pieces of a text that have ``size`` characters; a shorter text is one piece."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.transform(places, lambda i: F.substr(text, i, size))


def _joined(logs: DataFrame, asked: DataFrame, limit: int, columns: Sequence[str]) -> DataFrame:
    wanted = asked.select(F.monotonically_increasing_id().alias("_query"), "query_id", _terms().alias("_terms"))
    wanted = materialize(wanted.where(F.size("_terms") > 0))
    # wildcards are left out of the pieces; a query of wildcards only is filed under the empty text
    literal = F.flatten(F.transform("_terms", lambda t: F.split(t, "[%_]+")))
    longest = F.array_max(F.transform(literal, F.length))
    size = F.least(longest, F.lit(_GRAM))
    pieces = F.array_distinct(
        F.flatten(
            F.transform(
                F.filter(literal, lambda t: F.length(t) >= size),
                lambda t: _pieces(t, size),
            )
        )
    )
    filed = wanted.select("_query", F.explode(F.when(longest > 0, pieces).otherwise(F.array(F.lit("")))).alias("_piece"))
    shared = filed.groupBy("_piece").agg(F.count("*").alias("n")).withColumnRenamed("_piece", "_p")
    filed = filed.join(shared, F.col("_piece") == F.col("_p"))
    best = filed.groupBy("_query").agg(F.min(F.struct("n", "_piece")).alias("_best"))
    best = best.select(F.col("_query").alias("_q"), F.col("_best._piece").alias("_piece"))
    wanted = materialize(wanted.join(best, F.col("_query") == F.col("_q")).drop("_q"))
    sizes = [row[0] for row in wanted.select(F.length("_piece")).distinct().collect()]  # four at most

    text = F.col("_text")
    own = [_pieces(text, F.lit(n)) if n else F.array(F.lit("")) for n in sorted(sizes)]
    # only ids are copied to the pieces of their text; records come back for the pairs that meet
    named = logs.withColumn("_text", haystack(columns))
    pieces = named.select(F.col("id").alias("_id"), F.explode(F.array_distinct(F.concat(*own))).alias("_own")) if own else (
        named.select(F.col("id").alias("_id"), F.lit("").alias("_own"))
    )
    filed_under = wanted.select("_query", "_piece")
    if wanted.count() <= MAX_BROADCAST_QUERIES:
        filed_under, wanted = F.broadcast(filed_under), F.broadcast(wanted)
    pairs = pieces.join(filed_under, F.col("_own") == F.col("_piece")).select("_id", "_query").distinct()
    met = named.join(pairs, F.col("id") == F.col("_id")).drop("_id").join(wanted, "_query")

    def holds(term: Column) -> Column:
        pattern = F.concat(F.lit("%"), F.replace(term, F.lit("\\"), F.lit("\\\\")), F.lit("%"))
        by_field = [F.coalesce(F.call_function("ilike", F.col(c), pattern), F.lit(False)) for c in columns]
        return F.when(term.rlike("[%_]"), reduce(or_, by_field)).otherwise(F.contains(text, term))

    hits = met.where(F.forall("_terms", holds)).drop("_text", "_piece", "_terms")
    top = first_per_key(hits, ["_query"], [F.desc("event_ts"), F.desc("id")], limit, "id")
    return top.drop("_query")


def _one_pass(
    logs: DataFrame, queries: DataFrame, rows: Iterable[Row], limit: int, columns: Sequence[str]
) -> DataFrame:
    id_type = queries.schema["query_id"].dataType
    wanted = [(row.query_id, terms) for row in rows if (terms := search_terms(row.query))]
    if not wanted:
        none = logs.where(F.lit(False)).withColumn("query_id", F.lit(None).cast(id_type))
        return none.withColumn("rank", F.lit(1))
    # each distinct term is looked for once per record, however many queries use it
    place = {t: i for i, t in enumerate(dict.fromkeys(t for _, terms in wanted for t in terms))}
    found = F.array(*[term_found(t, columns, F.col("_text")) for t in place])
    # Queries share a branch by their longest term: a record only enters the
    # branches of terms it holds. SQL text stands in for thousands of columns.
    branches: dict[str, list[str]] = {}
    for n, (_, terms) in enumerate(wanted):
        longest, *others = sorted(dict.fromkeys(terms), key=len, reverse=True)
        also = " AND ".join(["true", *[f"_found[{place[t]}]" for t in others]])
        branches.setdefault(longest, []).append(f"CASE WHEN {also} THEN {n} END")
    matched = ", ".join(
        f"CASE WHEN _found[{place[term]}] THEN array_compact(array({', '.join(cases)})) END"
        for term, cases in branches.items()
    )
    hits = (
        logs.withColumn("_text", haystack(columns))
        .withColumn("_found", found)
        .withColumn("_query", F.explode(F.expr(f"flatten(array_compact(array({matched})))")))
        .drop("_text", "_found")
    )
    top = first_per_key(hits, ["_query"], [F.desc("event_ts"), F.desc("id")], limit, "id")
    # as many rows as queries were compiled
    names = logs.sparkSession.createDataFrame(
        [(n, query_id) for n, (query_id, _) in enumerate(wanted)],
        f"_query int, query_id {id_type.simpleString()}",
    )
    return top.join(F.broadcast(names), "_query").drop("_query")
