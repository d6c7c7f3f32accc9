"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Base patterns give spans by position. Long key-like tokens are further candidates. Every
candidate's value is hashed, counted by distinct repository and owner, and told apart:
a value of several owners, or in many repositories of one, is a copied example; one that a
single owner has in few repositories and that looks random is live and becomes an extra span.
Rows of equal text are one repository (that of the smallest owner), so copying a document
neither makes an example of a key nor hides one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.session import materialize

#: Fixed values of the contract: kind, pattern, group that holds the value, its least length.
#: ``access`` and ``hex`` carry their least length in the pattern: their matches are maximal runs.
BASE = (
    ("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"(AKIA[A-Z0-9]{14,})", 1, 18),
    ("hex", r"([0-9a-f]{16,})", 1, 16),
)
#: Key-like tokens outside the base patterns: letters, digits, ``_`` and ``-``, at least this long.
EXTRA = ("owned", r"([A-Za-z0-9_-]{20,})", 1, 20)
#: A value of so many owners, or in so many repositories, is an example.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 2, 10
#: Distinct characters that a live-looking value has at least.
LIVE_DISTINCT = 10


def matches(text: Column, pattern: str, group: int, least: int, kind: str, rank: int) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, rank, kind, end, value>>, code points."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(whole))
    parts = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), value.alias("value"))
    none = F.array().cast("array<struct<start:long,rank:int,kind:string,end:long,value:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["whole"])
        span = F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value")
        )
        kept = F.when(F.length(x["value"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.alias("at"), kept.alias("out"))

    first = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))
    # the first test spares most documents the splitting
    return F.when(F.regexp_like(text, F.lit(pattern)), F.aggregate(parts, first, step, lambda a: a["out"])).otherwise(none)


def _listed(spans: Column) -> Column:
    part = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.concat_ws(",", F.transform(F.array_sort(spans), part))


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str, keep: tuple[str, ...]) -> DataFrame:
    """The scan, written once: row, id, owner, repo, base and extra spans with hashed values, kept columns."""
    text = F.coalesce(F.col("__text"), F.lit(""))
    found = docs.select(
        F.col(id_col).alias("__id"),
        F.col(owner_col).cast("string").alias("__owner"),
        F.col(repo_col).cast("string").alias("__repo"),
        F.col(text_col).alias("__text"),
        *keep,
    )
    for rank, (kind, pattern, group, least) in enumerate((*BASE, EXTRA)):
        found = found.withColumn(f"__{kind}", matches(text, pattern, group, least, kind, rank))
    base = F.concat(*(F.col(f"__{kind}") for kind, *_ in BASE))
    alone = F.filter("__owned", lambda x: _live(x["value"]) & ~F.exists("__base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    hashed = lambda spans: F.transform(spans, lambda x: x.withField("value", F.sha2(x["value"], 256)))
    found = found.withColumn("__base", base).withColumn("__extra", hashed(alone)).withColumn("__base", hashed(F.col("__base")))
    found = found.drop("__owned", *(f"__{kind}" for kind, *_ in BASE))
    found = found.withColumn("__copy", F.when(F.size("__base") + F.size("__extra") > 0, F.sha2(text, 256)))
    return materialize(found.drop("__text").withColumn("__row", F.monotonically_increasing_id()))


def _live(value: Column) -> Column:
    mixed = F.regexp_like(value, F.lit("[0-9]")) & F.regexp_like(value, F.lit("[A-Za-z]"))
    return mixed & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_DISTINCT)


def ownership(found: DataFrame) -> DataFrame:
    """(value, n_repos, n_owners) of every candidate hash; a hot value is counted per task first.

    Of rows of equal text the smallest (owner, repository) counts; NULL owners count as empty ones."""
    spans = F.explode(F.concat("__base", "__extra")).alias("s")
    own = F.struct(F.coalesce("__owner", F.lit("")).alias("owner"), F.coalesce("__repo", F.lit("")).alias("repo"))
    one = found.select("__copy", own.alias("own"), spans).select(F.col("s.value").alias("value"), "__copy", "own")
    by_text = one.groupBy("value", "__copy").agg(F.min("own").alias("own"))
    by_repo = by_text.groupBy("value", "own").agg(F.lit(1).alias("one"))
    by_owner = by_repo.groupBy("value", "own.owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("value").agg(F.sum("n").alias("n_repos"), F.count("*").alias("n_owners"))


def judged(found: DataFrame) -> DataFrame:
    """Per row with candidates: the extra spans that stay, and how many spans are live or examples."""
    spans = found.select("__row", F.explode(F.concat("__base", "__extra")).alias("s"))
    spans = spans.withColumn("value", F.col("s.value")).join(ownership(found), "value")
    live = (F.col("n_owners") < EXAMPLE_OWNERS) & (F.col("n_repos") < EXAMPLE_REPOS)
    extra = (F.col("s.kind") == EXTRA[0]) & live
    return spans.groupBy("__row").agg(
        F.collect_list(F.when(extra, F.col("s"))).alias("__owned"),
        F.count_if(live).alias("__live"),
        F.count_if(~live).alias("__example"),
    )


def scan(
    docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Rows of ``docs``: ``__id``, ``__base`` and ``__all`` (start, rank, kind, end, value hash), counts, ``keep``."""
    found = candidates(docs, id_col, text_col, owner_col, repo_col, keep)
    return found.join(judged(found), "__row", "left").select(
        "__id",
        *keep,
        F.col("__base"),
        F.concat("__base", F.coalesce("__owned", F.array().cast(found.schema["__base"].dataType))).alias("__all"),
        F.coalesce("__live", F.lit(0)).cast("long").alias("__live"),
        F.coalesce("__example", F.lit(0)).cast("long").alias("__example"),
    )


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str = "doc_id",
) -> DataFrame:
    """One row per row of ``docs``: id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example.

    NULL text counts as empty: no spans, the hash of the empty string. A NULL owner or repository
    counts as an empty one. Repeated rows stay repeated; rows of equal text are one repository.
    ``n_live`` and ``n_example`` count the row's candidates, base ones too, whose value is live or an
    example by its owners and repositories. An empty table gives an empty result.
    """
    out = scan(docs, id_col, text_col, owner_col, repo_col)

    def count(kind: str) -> Column:
        return F.size(F.filter("__base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select(
        F.col("__id").alias(id_col),
        *(count(kind) for kind, *_ in BASE),
        F.sha2(_listed(F.col("__base")), 256).alias("base_sha256"),
        _listed(F.col("__all")).alias("spans"),
        F.col("__live").alias("n_live"),
        F.col("__example").alias("n_example"),
    )


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; overlapping spans are one. Columns and rows stay.

    NULL texts stay NULL, texts without spans stay unchanged.
    """
    keep = tuple(docs.columns)
    out = scan(docs, id_col, text_col, owner_col, id_col, keep)
    text = F.col(text_col)

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        gap = F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit(mark))).alias("out"),
        )

    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    finish = lambda a: F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int")))
    done = F.when(F.size("__all") > 0, F.aggregate(F.array_sort("__all"), first, step, finish)).otherwise(text)
    return out.withColumn(text_col, done).select(*keep)
