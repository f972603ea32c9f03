"""Removal of boilerplate lines by their frequency within a host, in DataFrame functions only.

A line counts once per page of a host, without blanks around it; copies of a page count as
one page. A line is boilerplate on a host if it is on at least ``min_pages`` of the host's
pages and on more than ``ratio`` of them. Blank lines never are.

Null texts stay null and have no lines. A null host is a host of its own. Pages that lose all
lines stay, with an empty text. Repeated rows are copies and all stay; extra columns pass
through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfrank.llm.common import saved

RATIO = 0.05
MIN_PAGES = 5
# Boilerplate lines (16 bytes each, with their host) up to which they are broadcast.
BROADCAST_LINES = 50_000


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def line_key(line: Column) -> Column:
    """64-bit key of a line without blanks around it."""
    return F.xxhash64(F.btrim(line, F.lit(" \t\r")))


def is_blank(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r")) == ""


def boilerplate(
    pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """``host, line`` (keys), with the ``pages`` that have it and the host's ``total``."""
    keys = F.array_distinct(
        F.transform(F.filter(lines_of(F.col(text)), lambda x: ~is_blank(x)), line_key)
    )
    contents = (
        pages.where(F.col(text).isNotNull())
        .select(F.col(host).alias("host"), F.xxhash64(text).alias("page"), keys.alias("lines"))
        .groupBy("host", "page")
        .agg(F.any_value("lines").alias("lines"))
    )
    contents = saved(contents, "page-lines")
    totals = contents.groupBy("host").agg(F.count("*").alias("total"))
    counts = (
        contents.select("host", F.explode("lines").alias("line"))
        .groupBy("host", "line")
        .agg(F.count("*").alias("pages"))
        .where(F.col("pages") >= min_pages)
    )
    same = counts["host"].eqNullSafe(totals["host"])
    return (
        counts.join(totals, same)
        .where(F.col("pages") > ratio * F.col("total"))
        .select(counts["host"], "line", "pages", "total")
    )


def drop_boilerplate(
    pages: DataFrame,
    host: str = "source",
    text: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    counts: bool = True,
) -> DataFrame:
    """``pages`` with boilerplate lines taken out of ``text``.

    With ``counts``, ``n_lines`` (blank ones too) and ``n_dropped`` are added; columns of
    these names give way.
    """
    lines = saved(boilerplate(pages, host, text, ratio, min_pages).select("host", "line"), "lines")
    # A host has at most (lines per page / ratio) of them, so an array holds them.
    by_host = lines.groupBy(F.col("host").alias("lines_host")).agg(
        F.collect_set("line").alias("bad")
    )
    if lines.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES:
        by_host = F.broadcast(by_host)
    kept = F.filter(
        lines_of(F.col("row")[text]),
        lambda x: is_blank(x) | ~F.array_contains(F.col("bad"), line_key(x)),
    )
    # In a struct the pages' own columns can't clash with those needed here.
    rows = pages.select(F.struct("*").alias("row"))
    placed = rows.join(by_host, F.col("row")[host].eqNullSafe(F.col("lines_host")), "left").select(
        "row",
        F.coalesce(F.size(lines_of(F.col("row")[text])), F.lit(0)).cast("bigint").alias("n_lines"),
        F.when(F.col("bad").isNotNull(), kept).alias("kept"),
    )
    dropped = F.coalesce(F.col("n_lines") - F.size("kept"), F.lit(0)).cast("bigint")
    dropped = F.when(F.col("kept").isNull(), F.lit(0)).otherwise(dropped)
    new_text = F.when(dropped > 0, F.array_join("kept", "\n")).otherwise(F.col("row")[text])
    added = {"n_lines": F.greatest("n_lines", F.lit(0)), "n_dropped": dropped} if counts else {}
    return placed.select(
        *[
            (new_text if c == text else F.col("row")[c]).alias(c)
            for c in pages.columns
            if c not in added
        ],
        *[v.alias(c) for c, v in added.items()],
    )
