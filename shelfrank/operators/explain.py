"""Facets, explanations and panel numbers over ranked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfrank.functions import labels as L
from shelfrank.functions import text as X
from shelfrank.operators import scoring as S
from shelfrank.operators.index import TextIndex, text_or_blank
from shelfrank.runtime import broadcast_if_small

MAX_MATCHES = 6
# Bounds shown when the catalogue has no usable year.
DEFAULT_FIRST_YEAR, DEFAULT_LAST_YEAR = 1980, 2026


# ---------------------------------------------------------------- facets and panels


def facet_values(catalog: DataFrame, column: str) -> DataFrame:
    terms = catalog.select(F.explode(X.split_terms(F.col(column))).alias("term")).distinct()
    return terms.orderBy(F.lower("term"), "term")


def top_facets(catalog: DataFrame, column: str, limit: int = 250) -> DataFrame:
    """Number of rows having each term; a row counts once per term."""
    return (
        catalog.select(F.explode(X.split_terms(F.col(column))).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("n_rows"))
        .orderBy(F.desc("n_rows"), F.lower("term"), "term")
        .limit(limit)
    )


def year_bounds(catalog: DataFrame) -> DataFrame:
    year = F.col("release_year")
    last = F.max(year)
    return catalog.agg(
        F.coalesce(F.min(F.when(year > 0, year)), F.lit(DEFAULT_FIRST_YEAR)).alias("min_year"),
        F.when(last.isNull() | (last == 0), DEFAULT_LAST_YEAR).otherwise(last).alias("max_year"),
    )


def panel_stats(catalog: DataFrame, ranked: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request, also those without rows: catalogue size, shown rows, best score (0 without)."""
    size = catalog.agg(F.count("*")).scalar()
    shown = ranked.groupBy("request_id").agg(
        F.count("item_id").alias("n_shown"), F.max("score").alias("best_score")
    )
    return (
        requests.select("request_id").distinct().join(shown, "request_id", "left")
        .na.fill({"n_shown": 0, "best_score": 0.0})
        .withColumn("n_catalog", size)
    )


def all_ids_prefixed(catalog: DataFrame, prefix: str) -> DataFrame:
    return catalog.agg(
        F.coalesce(F.bool_and(F.col("item_id").startswith(prefix)), F.lit(True)).alias(
            "all_prefixed"
        )
    )


# ---------------------------------------------------------------- term contributions


def explain_terms(
    index: TextIndex, pairs: DataFrame, requests: DataFrame, k: int = 5
) -> DataFrame:
    """The terms that make up the content cosine of each pair, strongest first.

    The source vector is the request's query, else its reference item
    (``reference_id``), else the item itself. Products sum to the cosine.
    """
    asked = requests.where(S.has_query())
    liked = requests.where(~S.has_query() & F.col("reference_id").isNotNull())
    alone = requests.where(~S.has_query() & F.col("reference_id").isNull())
    side = index.side("content")
    query_side = S.query_vectors(asked, index, "content").select(
        "request_id", "term", F.col("qw").alias("sw")
    )
    refs = broadcast_if_small(
        liked.select("request_id", F.col("reference_id").cast("string").alias("item_id"))
    )
    ref_side = side.join(refs, "item_id").select("request_id", "term", F.col("w").alias("sw"))
    pairs = broadcast_if_small(pairs.select("request_id", "item_id"))
    rows = side.join(pairs, "item_id").select("request_id", "item_id", "term", "w")
    from_source = rows.join(query_side.unionByName(ref_side), ["request_id", "term"]).select(
        "request_id", "item_id", "term", (F.col("w") * F.col("sw")).alias("contribution")
    )
    lonely = broadcast_if_small(alone.select("request_id"))
    from_self = rows.join(lonely, "request_id").select(
        "request_id", "item_id", "term", (F.col("w") * F.col("w")).alias("contribution")
    )
    best = Window.partitionBy("request_id", "item_id").orderBy(
        F.desc(F.round("contribution", S.RANK_DIGITS)), "term"
    )
    return (
        from_source.unionByName(from_self)
        .where(F.col("contribution") > 0)
        .withColumn("term_rank", F.row_number().over(best))
        .where(F.col("term_rank") <= k)
    )


# ---------------------------------------------------------------- reasons


def _joined(df: DataFrame, *names: str) -> Column:
    parts = [text_or_blank(df, n) for n in names]
    return F.concat_ws(", ", *parts)


def query_term_matches(ranked: DataFrame) -> Column:
    """Item terms that occur in the query as substrings."""
    terms = X.split_terms(_joined(ranked, "genres", "tags", "review_keywords"))
    query = X.collapse_lower(F.coalesce("query", F.lit("")))
    hits = F.filter(
        terms, lambda t: (X.collapse_lower(t) != "") & F.contains(query, X.collapse_lower(t))
    )
    return F.slice(hits, 1, MAX_MATCHES)


def reference_terms(references: DataFrame, items: DataFrame) -> DataFrame:
    """(request_id, reference_terms): genres and tags of the liked items, normalised."""
    terms = X.split_terms(_joined(items, "genres", "tags"))
    slim = items.select("item_id", F.transform(terms, X.collapse_lower).alias("terms"))
    return (
        slim.join(broadcast_if_small(references.distinct()), "item_id")
        .select("request_id", F.explode("terms").alias("term"))
        .groupBy("request_id")
        .agg(F.collect_set("term").alias("reference_terms"))
    )


def reference_term_matches(ranked: DataFrame) -> Column:
    """Item terms shared with the liked items; needs ``reference_terms``."""
    terms = X.split_terms(_joined(ranked, "genres", "tags"))
    shared = F.filter(
        terms,
        lambda t: (X.collapse_lower(t) != "")
        & F.array_contains(F.col("reference_terms"), X.collapse_lower(t)),
    )
    empty = F.array().cast("array<string>")
    return F.coalesce(F.slice(shared, 1, MAX_MATCHES), empty)


def reason_codes(
    query_matches: Column,
    reference_matches: Column,
    query: Column,
    has_reference_rows: Column,
    ratio: Column,
    has_sentiment: bool = True,
    limit: int = 3,
) -> Column:
    """Ordered reasons ``code`` or ``code: arguments``; at most ``limit`` are shown."""
    asked = X.collapse_lower(F.coalesce(query, F.lit(""))) != ""
    by_query = F.when(
        F.size(query_matches) > 0,
        F.concat(F.lit("query_terms: "), F.array_join(query_matches, ", ")),
    ).when(asked, "query_text")
    by_reference = F.when(
        F.size(reference_matches) > 0,
        F.concat(F.lit("shared_terms: "), F.array_join(reference_matches, ", ")),
    ).when(has_reference_rows, "reference_text")
    generic = F.when(by_query.isNull() & by_reference.isNull(), "catalogue_favourite")
    closing = (
        F.lit("community_sentiment")
        if has_sentiment
        else F.format_string("approval: %.0f%%", F.bround(ratio, 0))  # ties to even
    )
    return F.slice(F.array_compact(F.array(by_query, by_reference, generic, closing)), 1, limit)


def signal_summary() -> Column:
    """Signals above zero with 3 decimals; quality is always listed."""

    def part(name: str, column: str, always: bool = False) -> Column:
        text = F.format_string(f"{name}=%.3f", F.col(column))
        return text if always else F.when(F.col(column) > 0, text)

    return F.concat_ws(
        ", ",
        part("content", "content_score"),
        part("semantic", "semantic_score"),
        part("search", "opinion_score"),
        part("quality", "quality_score", always=True),
    )


def score_breakdown(ranked: DataFrame) -> DataFrame:
    names = ("score", "content_score", "semantic_score", "opinion_score", "quality_score")
    return ranked.select("request_id", "item_id", *[S.clip01(F.col(n)).alias(n) for n in names])


# ---------------------------------------------------------------- local texts


def local_explanation(reference_label: Column) -> Column:
    """One sentence per ranked row; works without any language model."""
    genres, tags = L.short_field(F.col("genres")), L.short_field(F.col("tags"))
    query = F.coalesce("query", F.lit(""))
    asked = (
        F.when(query != "", F.concat(F.lit("asked: "), query))
        .when(reference_label.isNotNull(), F.concat(F.lit("liked: "), reference_label))
        .otherwise("nothing asked")
    )
    facts = F.concat_ws(
        "; ",
        asked,
        F.when(genres != "", F.concat(F.lit("shelf: "), genres)),
        F.when(tags != "", F.concat(F.lit("labels: "), tags)),
    )
    return F.concat(F.col("title"), F.lit(" ("), facts, F.lit(")"))


EMPTY_ANSWER = "Nothing on the shelves fits this request."
ANSWER_HEAD = "Found:"


def local_answer(requests: DataFrame, ranked: DataFrame, limit: int = 5) -> DataFrame:
    """A numbered list per request (request_id, prompt), or the empty-result text."""
    genres, tags = L.short_field(F.col("genres")), L.short_field(F.col("tags"))
    reason = F.when(tags != "", tags).when(genres != "", genres).otherwise("no labels")
    lines = ranked.where(F.col("rank") <= limit).join(
        requests.select("request_id", "prompt"), "request_id"
    )
    line = F.concat(
        F.lit("#"), F.col("rank").cast("string"), F.lit(" "), F.col("title"), F.lit(" ["), reason,
        F.lit("] for: "), F.col("prompt"),
    )
    # At most ``limit`` rows per request are left to collect.
    listed = lines.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines")
    )
    body = F.array_join(F.transform("lines", lambda s: s["line"]), "\n")
    answer = F.when(
        F.col("lines").isNotNull(), F.concat(F.lit(ANSWER_HEAD + "\n"), body)
    ).otherwise(EMPTY_ANSWER)
    return (
        requests.select("request_id")
        .join(listed, "request_id", "left")
        .select("request_id", answer.alias("answer"))
    )
