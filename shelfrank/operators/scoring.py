"""Scores of (request, item) pairs: text, liked items, coverage, quality, hybrid.

Requests are tables: ``request_id, query, reference_ids``. Postings are bucketed
by item, so a broadcast table of query terms is matched and summed without any
shuffle of postings; query tables too large for that take a salted term join.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfrank.functions import text as X
from shelfrank.functions.lexicon import Lexicon
from shelfrank.operators.index import TextIndex, text_or_blank
from shelfrank.runtime import broadcast_if_small, fits, write_parquet

# Scores that differ by less than this many decimals are ties: sums in another
# order must not change a ranking.
RANK_DIGITS = 9
# Postings of one term beyond this count are spread over several tasks.
ROWS_PER_SALT = 2_000_000
# Words whose variants a task remembers.
KNOWN_WORDS = 200_000


# ---------------------------------------------------------------- requests

_expressions: dict[tuple, tuple] = {}


def expression(lexicon: Lexicon, name: str, build) -> Column:
    """An expression over columns of fixed names, built once per application and lexicon.

    Those with a lexicon's tables inside take longer to build than a small request to rank.
    """
    key = (SparkContext._active_spark_context.applicationId, id(lexicon), name)
    if key not in _expressions:
        _expressions[key] = (lexicon, build())
    return _expressions[key][1]


def normalise_requests(requests: DataFrame) -> DataFrame:
    """A filled list of liked ids wins over the legacy single id; blanks become NULL."""
    ids = F.col("reference_ids").cast("array<string>")
    if "reference_id" in requests.columns:
        single = F.col("reference_id").cast("string")
        ids = F.when(F.size(ids) > 0, ids).when(~X.is_blank(single), F.array(single))
    else:
        ids = F.when(F.size(ids) > 0, ids)
    return requests.select(
        "request_id", F.coalesce("query", F.lit("")).alias("query"), ids.alias("reference_ids")
    )


def has_query() -> Column:
    return ~X.is_blank(F.col("query"))


def has_references() -> Column:
    return F.coalesce(F.size("reference_ids") > 0, F.lit(False))


def request_references(requests: DataFrame) -> DataFrame:
    """(request_id, item_id), duplicates kept."""
    return requests.select("request_id", F.explode("reference_ids").alias("item_id"))


# ---------------------------------------------------------------- query vectors


def expanded_query(lexicon: Lexicon) -> Column:
    """Of ``query``."""
    return expression(lexicon, "expanded", lambda: X.expand_query(F.col("query"), lexicon.expansions))


def index_tokens(lexicon: Lexicon) -> Column:
    """Of ``expanded``."""
    build = lambda: X.tokenize(F.col("expanded"), lexicon.index_stop_words)
    return expression(lexicon, "tokens", build)


def query_vectors(requests: DataFrame, index: TextIndex, kind: str) -> DataFrame:
    """Unit TF-IDF vectors of the expanded queries: (request_id, term, qw, df)."""
    toks = requests.where(has_query()).select("request_id", expanded_query(index.lexicon).alias("expanded"))
    toks = toks.select("request_id", index_tokens(index.lexicon).alias("toks"))
    terms = toks.select(
        "request_id", F.explode(X.ngrams(F.col("toks"), index.low, index.high)).alias("term")
    )
    tf = terms.groupBy("request_id", "term").agg(F.count("*").alias("tf"))
    x = F.col("tf") * F.col("idf")
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("request_id")))
    return (
        tf.join(index.terms(kind).select("term", "df", "idf"), "term")
        .withColumn("x", x)
        .select("request_id", "term", (F.col("x") / norm).alias("qw"), "df")
    )


def centroid_vectors(requests: DataFrame, index: TextIndex, kind: str = "content") -> DataFrame:
    """Unit vectors of the mean of the liked items' rows: (request_id, term, qw, df).

    Repeated ids weigh repeatedly, unknown ids drop out, and the divisor of the
    mean cancels in the cosine.
    """
    refs = broadcast_if_small(request_references(requests))
    sums = (
        index.side(kind)
        .join(refs, "item_id")
        .groupBy("request_id", "term")
        .agg(F.sum("w").alias("x"))
    )
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("request_id")))
    return sums.join(index.terms(kind).select("term", "df"), "term").select(
        "request_id", "term", (F.col("x") / norm).alias("qw"), "df"
    )


# ---------------------------------------------------------------- matching


def match_scores(
    queries: DataFrame, postings: DataFrame, sums: dict[str, Column], small: bool | None = None
) -> DataFrame:
    """Sums over shared terms per (request_id, item_id)."""
    small = fits(queries) if small is None else small
    if small:
        pairs = postings.join(F.broadcast(queries), "term")
    else:
        pairs = _salted_join(queries, postings)
    return pairs.groupBy("request_id", "item_id").agg(*[c.alias(n) for n, c in sums.items()])


def _salted_join(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """Join on term; the postings of frequent terms are dealt out over salts.

    A term has one number of salts on both sides, from the largest ``df`` any query has
    for it; queries of different kinds may carry different ones.
    """
    salts = F.ceil(F.max("df") / ROWS_PER_SALT).cast("int")
    hot = queries.groupBy("term").agg(salts.alias("salts")).where("salts > 1")
    # Distinct hot terms are few: each holds more than ROWS_PER_SALT postings.
    hot = broadcast_if_small(hot)
    count = F.coalesce("salts", F.lit(1))
    left = queries.join(hot, "term", "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), count - 1))
    )
    right = postings.join(hot, "term", "left").withColumn(
        "salt", F.pmod(F.xxhash64("item_id"), count).cast("int")
    )
    return right.drop("salts").join(left.drop("salts"), ["term", "salt"])


def text_scores(requests: DataFrame, index: TextIndex, kind: str = "content") -> DataFrame:
    """Cosine of the expanded query and every matching row; others score 0."""
    return match_scores(
        query_vectors(requests, index, kind),
        index.side(kind),
        {f"{kind}_score": F.sum(F.col("qw") * F.col("w"))},
    )


def reference_scores(requests: DataFrame, index: TextIndex) -> DataFrame:
    """Cosine of the liked items' centroid and every row; liked items score 0."""
    scores = match_scores(
        centroid_vectors(requests, index),
        index.side("content"),
        {"content_score": F.sum(F.col("qw") * F.col("w"))},
    )
    own = broadcast_if_small(request_references(requests).distinct())
    return scores.join(own, ["request_id", "item_id"], "left_anti")


def top_k(scores: DataFrame, score: str, k: int, tie_break: list[Column]) -> DataFrame:
    """The k best rows of each request as ``rank`` 1..k."""
    order = [F.desc(F.round(score, RANK_DIGITS)), *tie_break]
    ranked = F.row_number().over(Window.partitionBy("request_id").orderBy(*order))
    return scores.withColumn("rank", ranked).where(F.col("rank") <= k)


# ---------------------------------------------------------------- quality


@dataclass(frozen=True)
class SentimentStats:
    """Catalogue-wide numbers, taken before any filter."""

    n_rated: int
    median: float | None
    low: float | None
    high: float | None


DIGIT_BITS = 16


def ordered_bits(value: Column) -> Column:
    """A bigint per double that sorts as the doubles do; both zeros give one."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("bigint")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(2**63 - 1)))


def from_ordered_bits(key: int) -> float:
    return struct.unpack("<d", struct.pack("<q", key if key >= 0 else key ^ (2**63 - 1)))[0]


def exact_median(df: DataFrame, name: str) -> float | None:
    """Exact median by radix selection: nothing is sorted and no task sees all rows.

    Each pass counts the values by their next 16 bits, among those that share the bits found
    so far, and brings at most 2 * 65 536 counts to the driver. The two middle ranks are
    followed together. Nulls don't count.
    """
    keys = df.where(F.col(name).isNotNull()).select(ordered_bits(F.col(name).cast("double")).alias("key"))
    targets: list[tuple[int | None, int]] = []
    for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        rows = keys
        if targets:
            found = F.shiftright("key", shift + DIGIT_BITS)
            rows = keys.where(found.isin(*{prefix for prefix, _ in targets}))
        counts = sorted(map(tuple, rows.groupBy(F.shiftright("key", shift).alias("d")).count().collect()))
        if not counts:
            return None
        if not targets:
            n = sum(c for _, c in counts)
            targets = [(None, (n - 1) // 2), (None, n // 2)]
        targets = [_next_digit(counts, prefix, rank) for prefix, rank in targets]
    low, high = (from_ordered_bits(prefix) for prefix, _ in targets)
    return low if low == high else (low + high) / 2


def _next_digit(counts: list[tuple[int, int]], prefix: int | None, rank: int) -> tuple[int, int]:
    """The longer prefix that holds a rank (from 0) among those of ``prefix``, and its rank there."""
    for found, count in counts:
        if prefix is None or found >> DIGIT_BITS == prefix:
            if rank < count:
                return found, rank
            rank -= count
    raise ValueError("rank beyond the values")


def sentiment_stats(catalog: DataFrame) -> SentimentStats | None:
    """None if the catalogue has no sentiment column."""
    if "sentiment_score" not in catalog.columns:
        return None
    number = F.col("sentiment_score").cast("double")
    # Written once: the passes over it don't repeat the catalogue's joins.
    col = catalog.select(F.when(~F.isnan(number), number).alias("s")).where("s IS NOT NULL")
    col = write_parquet(col, "sentiment")
    row = col.agg(F.count("s"), F.min("s"), F.max("s")).first()
    if row[0] == 0:
        return SentimentStats(0, None, None, None)
    return SentimentStats(row[0], exact_median(col, "s"), row[1], row[2])


def clip01(col: Column) -> Column:
    return F.greatest(F.least(col, F.lit(1.0)), F.lit(0.0))


def popularity() -> Column:
    return clip01(F.coalesce(F.col("positive_ratio"), F.lit(0.0)) / 100)


def normalised_sentiment(stats: SentimentStats | None) -> Column:
    """The catalogue's scale decides: -1..1, 0..5, 0..100 or already 0..1."""
    if stats is None or stats.n_rated == 0:
        return popularity()
    shift, span = sentiment_scale(stats)
    number = F.col("sentiment_score").cast("double")
    known = F.coalesce(F.when(~F.isnan(number), number), F.lit(stats.median))
    return clip01((known + shift) / span)


def sentiment_scale(stats: SentimentStats) -> tuple[float, float]:
    """What to add to a score and what to divide it by, read off the catalogue's range."""
    scales = [
        (stats.high > 5, (0.0, 100.0)),
        (stats.high > 1, (0.0, 5.0)),
        (stats.low < 0, (1.0, 2.0)),
    ]
    return next((scale for fits_range, scale in scales if fits_range), (0.0, 1.0))


def quality(stats: SentimentStats | None) -> Column:
    if stats is None:
        return popularity()
    return clip01(0.55 * popularity() + 0.45 * normalised_sentiment(stats))


# ---------------------------------------------------------------- weights


@dataclass(frozen=True)
class Weights:
    content: float = 0.50
    semantic: float = 0.25
    opinion: float = 0.15
    quality: float = 0.10


def active_weights(weights: Weights = Weights(), semantic_active: bool = False) -> dict[str, Column]:
    """Shares of the signals a request uses; they sum to 1.

    Ids that resolve to nothing still switch the content signal on. A request has two yes/no
    facts, liked items and a query, so there are four rows of shares.
    """

    def shares(liked: bool, asked: bool) -> dict[str, float]:
        used = {"quality": weights.quality}
        if liked:
            used["content"] = weights.content
        if asked:
            used["opinion"] = weights.opinion
        if semantic_active and (liked or asked):
            used["semantic"] = weights.semantic
        if sum(used.values()) == weights.quality:
            return {"quality": 1.0}
        return {name: weight / sum(used.values()) for name, weight in used.items()}

    both, liked, asked, none = shares(True, True), shares(True, False), shares(False, True), shares(False, False)
    return {
        f"weight_{n}": F.when(has_references() & has_query(), both.get(n, 0.0))
        .when(has_references(), liked.get(n, 0.0))
        .when(has_query(), asked.get(n, 0.0))
        .otherwise(none.get(n, 0.0))
        for n in ("content", "semantic", "opinion", "quality")
    }


# ---------------------------------------------------------------- coverage


def searchable_text(catalog: DataFrame) -> Column:
    names = ("title", "genres", "tags", "description", "review_keywords")
    joined = F.concat_ws(" ", *[text_or_blank(catalog, n) for n in names])
    return F.lower(X.strip_accents(joined))


def distinct_words(text: Column) -> Column:
    """Each ASCII word of ``text`` once, blank-separated: shorter to search than the text."""
    found = F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_join(F.array_distinct(found), " ")


def coverage(text: Column, concepts: Column, words: Column | None = None) -> Column:
    """Share of concepts with any variant inside ``text`` as a substring.

    A variant is ``text`` and whether it is ``plain``: of ASCII letters and digits. Such a one
    lies inside one run of them, so the distinct words decide for it; others need the whole text.
    """

    def found(v: Column) -> Column:
        where = text if words is None else F.when(v["plain"], words).otherwise(text)
        return F.contains(where, v["text"])

    hits = F.filter(concepts, lambda variants: F.exists(variants, found))
    return F.when(F.size(concepts) > 0, F.size(hits) / F.size(concepts)).otherwise(0.0)


def concepts_found(concepts: list[list[list]]) -> Callable[[Column, Column], Column]:
    """Column of an item's words and whole text: per request the number of its concepts found.

    ``concepts`` are those of few requests, as of ``request_concepts``. Each item is searched
    once for all of them: its words are looked up, and of a new word all its parts.
    """
    names: dict[tuple[str, bool], int] = {}
    flat = [[names.setdefault((v["text"], v["plain"]), len(names)) for v in c] for r in concepts for c in r]
    flat = [c for c in flat if c]
    places = np.array([n for c in flat for n in c], np.int64)
    starts = np.cumsum([0, *map(len, flat)])[:-1]
    owner = np.array([i for i, r in enumerate(concepts) for c in r if c], np.int64)
    n_requests, n_names = len(concepts), len(names)
    inside = {text: n for (text, plain), n in names.items() if plain}
    lengths = sorted({len(text) for text in inside})
    whole = [(text, n) for (text, plain), n in names.items() if not plain]

    @F.pandas_udf("array<int>")
    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, list[int]] = {}
        for words, texts in batches:
            out = []
            for line, text in zip(words, texts, strict=True):
                has = np.zeros(n_names, bool)
                for word in (line or "").split():
                    hits = known.get(word)
                    if hits is None:
                        if len(known) >= KNOWN_WORDS:
                            known.clear()
                        parts = (word[i : i + n] for n in lengths for i in range(len(word) - n + 1))
                        hits = known[word] = list({inside[part] for part in parts if part in inside})
                    has[hits] = True
                has[[n for v, n in whole if v in (text or "")]] = True
                met = np.logical_or.reduceat(has[places], starts) if len(places) else np.zeros(0, bool)
                out.append(np.bincount(owner[met], minlength=n_requests).astype(np.int32))
            yield pd.Series(out, dtype=object)

    return found


def request_concepts(lexicon: Lexicon) -> Column:
    """Of ``query``: per concept its variants, each with ``text`` and ``plain``."""

    def marked(v: Column) -> Column:
        return F.struct(v.alias("text"), v.rlike("^[a-z0-9]+$").alias("plain"))

    def build() -> Column:
        concepts = X.query_concepts(F.col("query"), lexicon.concepts, lexicon.query_stop_words)
        return F.transform(concepts, lambda variants: F.transform(variants, marked))

    return expression(lexicon, "concepts", build)
