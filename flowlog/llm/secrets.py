"""Secret scans with corpus-wide ownership frequency.

Texts are matched in one pass of built-in expressions. Assignments, access keys and long hex runs are always reported.
Looser kinds of candidates (long mixed tokens, passwords in URLs, private key blocks, long runs of capital hex digits) are
decided by ownership: the hashes of all candidates are aggregated by distinct repository and owner. A candidate that
``WIDE_OWNERS`` owners or more share, or ``WIDE_REPOS`` repositories of however few owners, is a widely copied example; any other is
an owner-specific credential that looks live. Only the latter is added to the spans.

Null and empty texts have no spans. A null repository or owner counts as one of its own. Spans count code points; the end
is exclusive. Repeated rows are scanned each; for ownership they are one repository and owner. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .columns import text_or_empty

# fixed values: the patterns and least lengths of the reported kinds, in the order of their rank
KINDS = ("assign", "access", "hex", "token", "url", "block", "key")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24

BASE_KINDS = 3
#: Looser kinds. Tokens: 20 characters or more in one run, with a digit, a capital and a small letter.
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}"
URL = r"://[^\s/:@]{1,256}:([^\s/:@]{1,256})(?=@)"
BLOCK = r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----([^-]{1,65536}-----END)"
#: Runs of capital hex digits, which may be the value of an assignment, as those of small ones may.
KEY = r"(?<![A-Za-z0-9])(?=[A-F]*[0-9])[0-9A-F]{24,}(?![A-Za-z0-9])"
WIDE_OWNERS, WIDE_REPOS = 3, 6
_CHUNK = 256
#: A table of live candidates is sent to all tasks up to this many documents.
MAX_BROADCAST_DOCS = 5_000
REDACTED = "[redacted]"

_SPAN = "struct<start:int,kind:int,end:int,chars:int,hash:bigint>"


def _matches(text: Column, kind: int, pattern: str, group: int, keep: Callable[[Column], Column]) -> Column:
    """Spans of the matches whose value passes ``keep``; ``chars`` is the length of the value, which ends the match.

    The text between matches and the matches themselves, by turns, give the positions as running lengths: of chunks of
    matches first, then inside each, so that the work grows little faster than the number of matches.
    """
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    hits = F.zip_with(whole, value, lambda w, v: F.struct(F.length(w).alias("whole"), v.alias("value")))
    lengths = F.slice(F.transform(gaps, F.length), F.lit(1), F.size(hits))
    steps = F.zip_with(lengths, hits, lambda g, h: F.struct(g.alias("gap"), h["whole"].alias("whole"), h["value"].alias("value")))
    none = F.array().cast(f"array<{_SPAN}>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + x["whole"]
        span = F.struct(
            start.alias("start"),
            F.lit(kind).alias("kind"),
            end.alias("end"),
            F.length(x["value"]).alias("chars"),
            F.xxhash64(x["value"]).alias("hash"),
        ).cast(_SPAN)
        spans = F.when(keep(x["value"]), F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.cast("int").alias("at"), spans.alias("spans"))

    def chunk(i: Column) -> Column:
        return F.slice(steps, i * _CHUNK + 1, F.lit(_CHUNK))

    def placed(totals: Column) -> Column:
        """Where each chunk begins."""
        state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        grow = lambda st, n: F.struct((st["at"] + n).alias("at"), F.concat(st["starts"], F.array(st["at"])).alias("starts"))
        return F.aggregate(totals, state, grow, lambda st: st["starts"])

    def spans_of(part: Column, at: Column) -> Column:
        return F.aggregate(part, F.struct(at.alias("at"), none.alias("spans")), step, lambda st: st["spans"])

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _CHUNK).cast("int")), chunk)
    total = lambda part: F.aggregate(part, F.lit(0), lambda n, x: n + x["gap"] + x["whole"])
    many = F.flatten(F.zip_with(parts, placed(F.transform(parts, total)), spans_of))
    few = spans_of(steps, F.lit(0))
    return F.when(text.rlike(pattern), F.when(F.size(steps) > _CHUNK, many).otherwise(few)).otherwise(none)


def base_spans(text: Column) -> Column:
    """Assignments, access keys and hex runs, sorted by start and kind."""
    long_enough = [lambda v, n=n: F.length(v) >= n for n in (ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS)]
    # runs are matched whole, so asking for the length inside the pattern finds the same spans without the short ones
    hex_run = HEX.replace("+", f"{{{HEX_CHARS},}}")
    access = ACCESS.replace("+", f"{{{ACCESS_CHARS - 4},}}")
    return F.array_sort(
        F.concat(
            _matches(text, 0, ASSIGN, 2, long_enough[0]),
            _matches(text, 1, access, 0, long_enough[1]),
            _matches(text, 2, hex_run, 0, long_enough[2]),
        )
    )


def loose_spans(text: Column, base: Column) -> Column:
    """Candidates of the looser kinds; all but keys touch no base span, and no key is a base span."""
    mixed = lambda v: v.rlike("[a-z]") & v.rlike("[A-Z]")
    any_ = lambda v: F.length(v) > 0
    touches = lambda b, t: (b["start"] < t["end"]) & (t["start"] < b["end"])
    apart = F.concat(_matches(text, 3, TOKEN, 0, mixed), _matches(text, 4, URL, 1, any_), _matches(text, 5, BLOCK, 1, any_))
    apart = F.filter(apart, lambda t: ~F.exists(base, lambda b: touches(b, t)))
    capital = lambda v: v.rlike("[A-F]")
    assign = lambda b: b["kind"] == 0
    keys = F.filter(
        _matches(text, 6, KEY, 0, capital), lambda t: ~F.exists(base, lambda b: ~assign(b) & touches(b, t))
    )
    return F.concat(apart, keys)


def looks_live(owners: Column, repos: Column, wide_owners: int, wide_repos: int) -> Column:
    """Whether so few owners and repositories share a candidate that it is no copied example."""
    return (owners < wide_owners) & (repos < wide_repos)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def ownership(candidates: DataFrame) -> DataFrame:
    """``hash, owners, repos, uses`` from ``hash, repo, owner``, a row per use.

    Uses are summed before they are shuffled, so that a copied example sends a row per task, repository and owner.
    """
    by_repo = candidates.groupBy("hash", "owner", "repo").agg(F.count("*").alias("uses"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("uses").alias("uses"))
    return by_owner.groupBy("hash").agg(
        F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("uses").alias("uses")
    )


def _scanned(docs: DataFrame, key: str, text: str, repo: list[str], owner: str) -> DataFrame:
    """A narrow, stored row per document: ``id, key, repo, owner, digest, base, loose``."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("id"),
        F.col(key).alias("key"),
        F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in repo]).alias("repo"),
        F.col(owner).cast("string").alias("owner"),
        text_or_empty(text).alias("text"),
    )
    rows = rows.select("id", "key", "repo", "owner", "text", base_spans(F.col("text")).alias("base"))
    loose = loose_spans(F.col("text"), F.col("base"))
    digest = F.xxhash64("text").alias("digest")
    return materialize(rows.select("id", "key", "repo", "owner", digest, "base", loose.alias("loose")))


def find_secrets(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    repo: tuple[str, ...] = ("source", "lang"),
    owner: str = "source",
    wide_owners: int = WIDE_OWNERS,
    wide_repos: int = WIDE_REPOS,
) -> DataFrame:
    """Spans and ownership of every row of ``docs``.

    ``<key>, n_assign, n_access, n_hex, base_sha256`` describe the base spans; ``spans`` also lists looser candidates
    that look live. ``n_live`` and ``n_copied`` count the spans by ownership; ``n_examples`` counts looser candidates
    that were left out as widely copied.
    """
    rows = _scanned(docs, key, text, list(repo), owner)
    uses = rows.select("id", "repo", "owner", F.explode(F.concat("base", "loose")).alias("span"))
    uses = uses.select("id", "repo", "owner", "span", F.col("span.hash").alias("hash"))
    shared = ownership(uses).withColumnRenamed("hash", "hash2")
    judged = uses.join(shared, F.col("hash") == F.col("hash2"))
    live = looks_live(F.col("owners"), F.col("repos"), wide_owners, wide_repos)
    loose = F.col("span.kind") >= BASE_KINDS
    verdicts = judged.groupBy("id").agg(
        F.count(F.when(live, 1)).alias("n_live"),
        F.count(F.when(~live & ~loose, 1)).alias("n_copied"),
        F.count(F.when(~live & loose, 1)).alias("n_examples"),
        F.collect_list(F.when(live & loose, F.col("span"))).alias("added"),
    )
    out = rows.join(verdicts.withColumnRenamed("id", "id2"), F.col("id") == F.col("id2"), "left")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    none = F.array().cast(f"array<{_SPAN}>")
    spans = F.array_sort(F.concat(F.col("base"), F.coalesce(F.col("added"), none)))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).alias(name)
    return out.select(
        F.col("key").alias(key),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
        zero("n_live"),
        zero("n_copied"),
        zero("n_examples"),
    )


def redact_secrets(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    repo: tuple[str, ...] = ("source", "lang"),
    owner: str = "source",
    wide_owners: int = WIDE_OWNERS,
    wide_repos: int = WIDE_REPOS,
) -> DataFrame:
    """``docs`` with the value of every span of :func:`find_secrets` replaced; a column ``n_chars`` follows.

    Base spans go whoever owns them, looser candidates only if they look live. Texts without spans stay as they are.
    """
    rows = _scanned(docs, key, text, list(repo), owner)
    loose = rows.select("digest", "repo", "owner", F.explode("loose").alias("span"))
    loose = loose.select("digest", "repo", "owner", F.col("span.hash").alias("hash"))
    live = ownership(loose.drop("digest")).where(looks_live(F.col("owners"), F.col("repos"), wide_owners, wide_repos))
    live = loose.join(live.select(F.col("hash").alias("hash2")), F.col("hash") == F.col("hash2"))
    # by text, not by id: rows without an id, or with one id, have lists of their own
    live = materialize(live.groupBy("digest").agg(F.collect_set("hash").alias("live")).withColumnRenamed("digest", "digest2"))
    marked = docs.select(F.struct("*").alias("row"), text_or_empty(text).alias("text"))
    if live.count() <= MAX_BROADCAST_DOCS:
        live = F.broadcast(live)
    marked = marked.join(live, F.xxhash64("text") == F.col("digest2"), "left")
    marked = marked.withColumn("base", base_spans(F.col("text")))
    is_live = lambda s: F.array_contains(F.col("live"), s["hash"])
    added = F.when(F.col("live").isNull(), F.array().cast(f"array<{_SPAN}>")).otherwise(
        F.filter(loose_spans(F.col("text"), F.col("base")), is_live)
    )
    values = F.array_sort(
        F.transform(
            F.concat("base", added),
            lambda s: F.struct((s["end"] - s["chars"]).alias("start"), s["end"].alias("end")),
        )
    )

    def cut(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        before = F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"])
        parts = F.when(fresh, F.concat(state["parts"], F.array(before, F.lit(REDACTED)))).otherwise(state["parts"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), parts.alias("parts"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    rest = lambda state: F.substring(F.col("text"), state["at"] + 1, F.length("text"))
    rebuilt = F.aggregate(
        "values", start, cut, lambda state: F.array_join(F.concat(state["parts"], F.array(rest(state))), "")
    )
    hit = F.size("values") > 0
    marked = marked.withColumn("values", values)
    marked = marked.withColumn("new_text", F.when(hit, rebuilt).otherwise(F.col("row")[text]))
    out = {text: F.col("new_text")}
    if "n_chars" in docs.columns:
        size = F.length("new_text").cast(docs.schema["n_chars"].dataType)
        out["n_chars"] = F.when(hit, size).otherwise(F.col("row")["n_chars"])
    return marked.select(*[out.get(name, F.col("row")[name]).alias(name) for name in docs.columns])
