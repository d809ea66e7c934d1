"""Boilerplate lines by their frequency within a site.

The lines of a page are the texts between its block-level tags, without scripts, styles and
comments.  For every host and line, the pages that contain the line are divided by the pages
of the host; lines on at least ``min_pages`` pages and above ``max_share`` of them are
dropped.  A script, style, comment or tag that is not closed ends with the page.  All patterns read
a page once, whatever it holds, so a very long one costs in proportion to its length.

A null page has no lines; pages without a host in their address keep all lines; a line that
a page repeats counts once for the page and is dropped everywhere in it; equal rows are
pages of their own; an empty table gives no rows; other columns are ignored.  Only DataFrame
functions are used; counts are taken in the tasks before hosts or lines are brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatframe.llm.common import stored

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]*)"
# Every alternative can end at the end of the page, so no opening is looked at twice.
UNSEEN = (
    r"(?is)<script.*?(?:</script[^>]*+(?:>|\z)|\z)|<style.*?(?:</style[^>]*+(?:>|\z)|\z)|<!--.*?(?:-->|\z)"
)
TAG = r"<[^>]*+(?:>|\z)"
BLANK = r"[\x20\x09-\x0D]"
BLOCK_TAGS = (
    "address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|li|"
    "main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul"
)
BLOCK = rf"(?i)</?(?:{BLOCK_TAGS})(?:[\x20\x09-\x0D/][^>]*+(?:>|\z)|>)"


def host(url: str = "url") -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def lines_of(html: str = "html") -> Column:
    seen = F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, " ")
    blocks = F.regexp_replace(F.regexp_replace(seen, rf"{BLANK}+", " "), BLOCK, "\n")
    plain = F.regexp_replace(F.regexp_replace(blocks, TAG, ""), " *\n *| {2,}", "\n")
    return F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def page_lines(pages: DataFrame) -> DataFrame:
    """``(row, page_id, host, lines)``, stored: ``row`` stays the same for all that follows."""
    return stored(
        pages.select(
            F.monotonically_increasing_id().alias("row"), "page_id", host().alias("host"), lines_of().alias("lines")
        ),
        "page-lines",
    )


def boilerplate(rows: DataFrame, max_share: float, min_pages: int) -> DataFrame:
    """``(host, line)`` of the lines to drop; line: the MD5 of its text."""
    sited = rows.filter("host <> ''")
    totals = stored(sited.groupBy("host").agg(F.count("*").alias("host_pages")), "hosts")
    counts = stored(
        sited.select("host", F.explode(F.array_distinct("lines")).alias("line"))
        .groupBy("host", F.md5("line").alias("line")).agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages),
        "line-pages",
    )
    return stored(
        counts.join(totals, "host").filter(F.col("pages") > F.col("host_pages") * max_share).select("host", "line"),
        "boilerplate",
    )


def drop_boilerplate(pages: DataFrame, max_share: float = 0.2, min_pages: int = 3) -> DataFrame:
    """``(page_id, host, lines, kept)`` for every page; ``kept``: the lines that stay."""
    rows = page_lines(pages)
    common = boilerplate(rows, max_share, min_pages)
    places = rows.filter("host <> ''").select("row", "host", F.posexplode("lines").alias("at", "line")).select(
        "row", "host", "at", F.md5("line").alias("line")
    )
    dropped = stored(
        places.join(common, ["host", "line"]).groupBy("row").agg(F.collect_list("at").alias("dropped")), "dropped"
    )
    kept = F.filter("lines", lambda x, i: ~F.coalesce(F.array_contains("dropped", i), F.lit(False)))
    return rows.join(dropped, "row", "left").select("page_id", "host", "lines", kept.alias("kept"))


def report(pages: DataFrame) -> DataFrame:
    return pages.select(
        "page_id", "host", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"),
    )
