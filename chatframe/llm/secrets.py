"""Secret scans with corpus-wide ownership frequency.

Values found in texts are hashed and counted over the whole corpus by distinct owners and
repositories.  A value that many owners or repositories have is an example that was copied;
one that stays with few and looks like a credential is live; others are neither.  A
credential has ``ENTROPY`` bits a character or more, and a letter and a digit, or is a whole
access key.  Where a live value occurs outside any pattern, its occurrence is added as a
span of kind ``known``: a whole run of one of the alphabets ``EDGES``, of any length.  A value
is not found inside a word, or where marks of its own kind join it to a neighbour.

Base kinds, leftmost non-overlapping matches each: ``assign`` (a name, ``:`` or ``=``, a
value of 6 or more characters), ``access`` (20 or more characters), ``hex`` (24 or more).
Spans are code points of the whole match, end exclusive.

A null text is an empty text and has no spans; a null owner or repository counts as one
owner or repository; equal rows each keep a row; an empty table gives no rows; other
columns are ignored.  Only DataFrame functions are used: the text is split at the matches,
and the lengths of pieces and matches add up to their places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatframe.llm.common import stored

#: Kind, pattern, group with the value, least length of the value.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
#: Every run of a pattern that is long enough to count, for the kinds without a context.
RUNS = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
#: Long runs of characters of values, as the DuckDB statement knows bare values.
BARE = r"[A-Za-z0-9+/_=-]{16,}"
#: The marks in the runs that may be bare values: all, all within, and without those that often join a value to a name.
EDGES = (("+/_.=-", ""), ("+/_.=-", r"(?<!\.)"), ("+/_=-", ""), ("+_.-", r"(?<!\.)"), ("+_-", ""), ("+/=-", ""), ("+.-", r"(?<!\.)"), ("", ""))
ENTROPY = 2.5
PIECES = "array<struct<before:int,size:int,hash:string,look:boolean>>"


def bare(marks: str, end: str) -> str:
    """Whole runs of letters, digits and ``marks`` with a letter and a digit, 6 characters or more."""
    letters, digits = "A-Za-z", "0-9"
    return (
        f"(?<![{letters}{digits}{marks}])(?=[{letters}{marks}]*+[{digits}])(?=[{digits}{marks}]*+[{letters}])"
        f"[{letters}{digits}{marks}]{{6,}}{end}"
    )


def looks(value: Column) -> Column:
    """Whether a value looks like a credential."""
    n = F.length(value)
    shares = F.transform(
        F.array_distinct(F.split(value, "")), lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n
    )
    entropy = F.aggregate(shares, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return (entropy >= ENTROPY) & (
        (value.rlike("[A-Za-z]") & value.rlike("[0-9]")) | value.rlike(f"^{RUNS['access']}$")
    )


def matches(text: Column, pattern: str, group: int, least: int, judged: bool = True) -> Column:
    """The matches in order: characters since the match before, length, hash and look of the value.

    Values of ``group`` with fewer than ``least`` characters have no hash.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    zipped = F.arrays_zip(
        F.slice(F.split(text, pattern, -1), 1, F.size(whole)).alias("before"), whole.alias("match"), values.alias("value")
    )
    pieces = F.transform(
        zipped,
        lambda x: F.struct(
            F.length(x["before"]).alias("before"), F.length(x["match"]).alias("size"),
            F.when(F.length(x["value"]) >= least, F.sha2(x["value"], 256)).alias("hash"),
            (looks(x["value"]) if judged else F.lit(None).cast("boolean")).alias("look"),
        ),
    )
    return F.when(F.regexp_like(text, F.lit(pattern)), pieces).otherwise(F.array().cast(PIECES))


def found(docs: DataFrame, owner: str, repository: Column) -> DataFrame:
    """``(row, doc_id, owner, repository, pieces)``; pieces: the matches of each kind.

    Stored, so that the texts are read once and ``row`` stays the same for all that follows.
    """
    text = F.coalesce("text", F.lit(""))
    pieces = [matches(text, RUNS.get(kind, pattern), group, least) for kind, pattern, group, least in KINDS]
    pieces += [matches(text, bare(*edges), 0, 6, judged=False) for edges in EDGES]
    return stored(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.col(owner).cast("string").alias("owner"),
            repository.cast("string").alias("repository"), F.array(*pieces).alias("pieces"),
        ),
        "secrets",
    )


def placed(rows: DataFrame) -> DataFrame:
    """``(row, owner, repository, rank, start, end, hash, look)``: running sums of pieces are places.

    All bare runs have the rank after those of the patterns, and equal places count once.
    """
    kinds = rows.filter(F.exists("pieces", lambda p: F.size(p) > 0)).select(
        "row", "owner", "repository", F.posexplode("pieces").alias("rank", "kind")
    )
    each = kinds.select("row", "owner", "repository", "rank", F.posexplode("kind").alias("nth", "piece"))
    so_far = Window.partitionBy("row", "rank").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("piece.before") + F.col("piece.size")).over(so_far)
    return stored(
        each.withColumn("end", end).filter(F.col("piece.hash").isNotNull()).select(
            "row", "owner", "repository", F.least("rank", F.lit(len(KINDS))).alias("rank"),
            (F.col("end") - F.col("piece.size")).alias("start"), "end", F.col("piece.hash").alias("hash"), F.col("piece.look").alias("look"),
        ).distinct(),
        "spans",
    )


def ownership(spans: DataFrame) -> DataFrame:
    """``(hash, occurrences, owners, repositories, look)`` of every value in a base span of the corpus."""
    pairs = spans.filter(F.col("rank") < len(KINDS)).groupBy("hash", "owner", "repository").agg(
        F.count("*").alias("n"), F.max("look").alias("look")
    )
    per_owner = pairs.groupBy("hash", "owner").agg(
        F.sum("n").alias("n"), F.count("*").alias("repositories"), F.max("look").alias("look")
    )
    return per_owner.groupBy("hash").agg(
        F.sum("n").alias("occurrences"), F.count("*").alias("owners"), F.sum("repositories").alias("repositories"),
        F.max("look").alias("look"),
    )


def scan(
    docs: DataFrame, owner: str = "source", repository: Column | None = None, live_owners: int = 1,
    live_repositories: int = 2,
) -> DataFrame:
    """``(doc_id, base, spans, n_live, n_copied)`` for every document.

    ``base``: the spans of the patterns; ``spans``: these and the bare occurrences of live
    values; ``n_copied``: base spans whose value more than ``live_owners`` owners or
    ``live_repositories`` repositories have; ``n_live``: of the others, those that look like a
    credential.
    """
    repository = F.concat_ws("/", owner, "lang") if repository is None else repository
    rows = found(docs, owner, repository)
    spans = placed(rows)
    few = (F.col("owners") <= live_owners) & (F.col("repositories") <= live_repositories)
    values = stored(ownership(spans).select("hash", (few & F.col("look")).alias("live"), (~few).alias("copied")), "ownership")
    judged = stored(spans.join(values, "hash").select("row", "rank", "start", "end", "live", "copied"), "judged")
    base = F.col("rank") < len(KINDS)
    in_text = Window.partitionBy("row").orderBy("start")
    covered = F.max(F.when(base, F.col("end"))).over(in_text.rangeBetween(Window.unboundedPreceding, 0)) > F.col("start")
    meets = F.min(F.when(base, F.col("start"))).over(in_text.rangeBetween(0, Window.unboundedFollowing)) < F.col("end")
    outside = ~F.coalesce(covered, F.lit(False)) & ~F.coalesce(meets, F.lit(False))
    kind = F.element_at(F.array(*(F.lit(k) for k, *_ in KINDS), F.lit("known")), F.col("rank") + 1)
    span = F.struct("start", "rank", kind.alias("kind"), "end")
    status = (
        judged.withColumn("stays", base | (F.col("live") & outside)).filter("stays").groupBy("row").agg(
            F.count_if(base & F.col("live")).alias("n_live"), F.count_if(base & F.col("copied")).alias("n_copied"),
            F.array_sort(F.collect_list(F.when(base, span))).alias("base"), F.array_sort(F.collect_list(span)).alias("spans"),
        )
    )
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return rows.join(status, "row", "left").select(
        "doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
    )


def listed(spans: str) -> Column:
    """``kind:start:end`` in order of start and kind, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def report(scanned: DataFrame) -> DataFrame:
    def n(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(listed("base"), 256).alias("base_sha256"),
        listed("spans").alias("spans"), "n_live", "n_copied",
    )
