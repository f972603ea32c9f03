"""TF-IDF text index: tokens, n-grams, postings, vocabulary, weights, fingerprints.

One pass over the text builds two indexes that differ only in field weights:
``content`` (item to item) and ``opinion`` (query to item, with review keywords).

The catalogue is hash-partitioned by ``item_id`` once, while it is still compact
text; counting, normalising and writing then need no further shuffle of postings.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfrank.functions import text as X
from shelfrank.functions.lexicon import Lexicon
from shelfrank.operators import grams as G
from shelfrank.runtime import (
    broadcast_if_small,
    drop_written,
    parallelism,
    write_bucketed,
    write_parquet,
)

# How often each field counts in the two corpora.
CONTENT_RECIPE = (
    ("title", 1),
    ("genres", 5),
    ("tags_clean", 9),
    ("semantic_hints", 8),
    ("description", 1),
)
OPINION_RECIPE = (
    ("title", 1),
    ("genres", 2),
    ("tags_clean", 2),
    ("semantic_hints", 3),
    ("description", 1),
    ("review_keywords", 5),
)
KINDS = ("content", "opinion")
MAX_FEATURES = 30_000
INDEX_VERSION = "2"
# Places of a leaf of the fingerprint tree, and nodes below a node.
RANGE_ITEMS = 1_024
TREE_LEVELS = 2

# About one item in this many lies in the probe part of the postings table. Rankings
# read it first for a threshold; what they return always comes from all parts.
PROBE_SHARE = 8

# A vocabulary this large still broadcasts; beyond it the join shuffles.
BROADCAST_TERMS = 400_000


@dataclass(frozen=True)
class TextIndex:
    """``postings``: item_id, term, tf_*, w_*, probe; ``vocab``: kind, term, df, ctf, idf.

    ``rows`` is what is stored: a row per item, with arrays of what ``postings`` has as rows.
    """

    postings: DataFrame
    vocab: DataFrame
    n_items: int
    lexicon: Lexicon = field(repr=False)
    low: int = 1
    high: int = 2
    max_features: int | None = MAX_FEATURES
    min_df: int = 1
    rows: DataFrame | None = field(default=None, repr=False)

    def side(self, kind: str) -> DataFrame:
        p = self.reading(f"tf_{kind}", f"w_{kind}").select(
            "item_id", "term", F.col(f"tf_{kind}").alias("tf"), F.col(f"w_{kind}").alias("w")
        )
        return p.where(F.col("w") > 0)

    def reading(self, *names: str) -> DataFrame:
        """``item_id, probe, term`` and ``names`` of the postings; other arrays aren't read."""
        if self.rows is None:
            return self.postings.select("item_id", "probe", "term", *names)
        return flat_terms(self.rows.select("item_id", "probe", "term", *names))

    def terms(self, kind: str) -> DataFrame:
        return self.vocab.where(F.col("kind") == kind).drop("kind")


def text_or_blank(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit("")
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _keys(df: DataFrame) -> list[str]:
    return ["item_id", "probe"] if "probe" in df.columns else ["item_id"]


def text_features(catalog: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Text fields without NULLs plus cleaned tags and inferred hints."""
    names = ("title", "genres", "tags", "description", "review_keywords")
    base = catalog.select(*_keys(catalog), *[text_or_blank(catalog, n).alias(n) for n in names])
    hints = X.infer_hints(F.col("hint_text"), lexicon.hint_rules, lexicon.hint_combos)
    return (
        base.withColumn("hint_text", X.hint_text(*[F.col(n) for n in names[:4]]))
        .withColumn("semantic_hints", F.array_join(hints, " "))
        .withColumn("tags_clean", X.clean_tags(F.col("tags"), lexicon.noisy_tags))
        .drop("hint_text")
    )


def weighted_corpus(recipe=CONTENT_RECIPE) -> Column:
    """The corpus as one string: each field repeated by its weight."""
    parts = []
    for i, (name, times) in enumerate(recipe):
        last_once = times == 1 and i == len(recipe) - 1
        copy = F.col(name) if last_once else F.concat(F.col(name), F.lit(" "))
        parts.append(copy if times == 1 else F.repeat(copy, F.lit(times)))
    return F.concat(*parts)


def _weighted_tokens(recipe) -> Column:
    """Tokens of the repeated fields; equals tokenising ``weighted_corpus``."""
    parts = [
        F.col(f"tok_{name}") if n == 1 else F.flatten(F.array_repeat(F.col(f"tok_{name}"), n))
        for name, n in recipe
    ]
    return F.concat(*parts) if parts else F.array().cast("array<string>")


def _tagged(grams: Column, content: int, opinion: int) -> Column:
    return F.transform(
        grams,
        lambda t: F.struct(
            t.alias("term"), F.lit(content).alias("c"), F.lit(opinion).alias("o")
        ),
    )


def _bigrams(tokens: Column) -> Column:
    return X.ngrams(tokens, 2, 2)


def field_tokens(features: DataFrame, lexicon: Lexicon) -> DataFrame:
    names = sorted({n for n, _ in CONTENT_RECIPE + OPINION_RECIPE})
    return features.select(
        *_keys(features),
        *[X.tokenize(F.col(n), lexicon.index_stop_words).alias(f"tok_{n}") for n in names],
    )


def flat_terms(rows: DataFrame) -> DataFrame:
    """A row per term from rows of items with arrays."""
    arrays = [f.name for f in rows.schema if f.dataType.typeName() == "array"]
    rest = [c for c in rows.columns if c not in arrays]
    return rows.select(*rest, F.inline(F.arrays_zip(*arrays)))


def count_terms(features: DataFrame, lexicon: Lexicon, low: int = 1, high: int = 2) -> DataFrame:
    """(item_id, term, tf_content, tf_opinion).

    The description counts once in both corpora, so its n-grams are emitted once
    and shared; only the short fields and the borders differ.
    """
    keys = _keys(features)
    tokens = field_tokens(features, lexicon)
    recipes = {"content": CONTENT_RECIPE, "opinion": OPINION_RECIPE}
    flags = {"content": (1, 0), "opinion": (0, 1)}
    if (low, high) == (1, 2):
        for kind, recipe in recipes.items():
            cut = [n for n, _ in recipe].index("description")
            tokens = tokens.withColumn(f"{kind}_before", _weighted_tokens(recipe[:cut]))
            tokens = tokens.withColumn(f"{kind}_after", _weighted_tokens(recipe[cut + 1 :]))
        body = F.col("tok_description")
        grams = [_tagged(X.ngrams(body, 1, 2), 1, 1)]
        for kind in KINDS:
            before, after = F.col(f"{kind}_before"), F.col(f"{kind}_after")
            grams.append(_tagged(F.concat(before, after), *flags[kind]))
            around = F.when(
                F.size(body) > 0,
                F.concat(
                    _bigrams(F.concat(before, F.slice(body, 1, 1))),
                    _bigrams(F.concat(F.slice(body, -1, 1), after)),
                ),
            ).otherwise(_bigrams(F.concat(before, after)))
            grams.append(_tagged(around, *flags[kind]))
    else:
        grams = [
            _tagged(X.ngrams(_weighted_tokens(r), low, high), *flags[k])
            for k, r in recipes.items()
        ]
    return (
        tokens.select(*keys, F.explode(F.concat(*grams)).alias("g"))
        .groupBy(*keys, F.col("g.term").alias("term"))
        .agg(
            F.sum("g.c").cast("int").alias("tf_content"),
            F.sum("g.o").cast("int").alias("tf_opinion"),
        )
    )


# Counts above this many rows have their vocabulary found through cells, of which so many.
DIRECT_ROWS = 50_000_000
CELLS = 1 << 20


def term_totals(counts: DataFrame) -> DataFrame:
    """``term, df_*, ctf_*`` of every term."""
    totals = [
        f
        for kind in KINDS
        for f in (
            F.count_if(F.col(f"tf_{kind}") > 0).alias(f"df_{kind}"),
            F.sum(f"tf_{kind}").alias(f"ctf_{kind}"),
        )
    ]
    return counts.groupBy("term").agg(*totals)


def frequent_totals(counts: DataFrame, k: int, min_df: int = 1, cells: int = CELLS) -> DataFrame:
    """``term_totals`` of a few terms, among them the ``k`` with the largest count of each kind.

    Terms are hashed into cells, and a cell's sum is at least the count of any term in it. The
    terms of the k largest cells are counted; the k-th of those is at most the k-th of all, so
    cells with a smaller sum hold none of the k. Only terms of the others are shuffled; if the
    counts are too even for that, these are all terms. Exact in any case.
    """
    cell = F.pmod(F.xxhash64("term"), F.lit(cells)).cast("int")
    marked = counts.withColumn("cell", cell)
    sums = marked.groupBy("cell").agg(*[F.sum(f"tf_{x}").alias(f"sum_{x}") for x in KINDS])
    sums = write_parquet(sums, "cells")

    def within(wanted: DataFrame) -> DataFrame:
        # At most ``cells`` numbers.
        return term_totals(marked.join(F.broadcast(wanted.select("cell").distinct()), "cell", "left_semi"))

    largest = [sums.orderBy(F.desc(f"sum_{x}"), "cell").limit(k) for x in KINDS]
    trial = write_parquet(within(largest[0].unionByName(largest[1])), "trial-terms")
    enough = []
    for kind in KINDS:
        known = trial.where((F.col(f"df_{kind}") >= min_df) & (F.col(f"df_{kind}") > 0))
        last = known.orderBy(F.desc(f"ctf_{kind}")).offset(k - 1).limit(1).select(f"ctf_{kind}").collect()
        enough.append(F.col(f"sum_{kind}") >= (last[0][0] if last else 1))
    return within(sums.where(enough[0] | enough[1]))


def vocabulary(
    counts: DataFrame,
    n_items: int,
    max_features: int | None = MAX_FEATURES,
    min_df: int = 1,
    n_rows: int = 0,
) -> DataFrame:
    """(kind, term, df, ctf, idf): the terms with the largest corpus count, or all (None).

    Counts of many rows (``n_rows``) are searched through cells, with the same result.
    """
    if max_features and n_rows > DIRECT_ROWS:
        per_term = frequent_totals(counts, max_features, min_df)
    else:
        per_term = term_totals(counts)
    # Stored, as both kinds read it.
    per_term = write_parquet(per_term, "totals")
    sides = [
        per_term.select(
            F.lit(kind).alias("kind"),
            "term",
            F.col(f"df_{kind}").alias("df"),
            F.col(f"ctf_{kind}").alias("ctf"),
        )
        .where((F.col("df") >= min_df) & (F.col("df") > 0))
        for kind in KINDS
    ]
    if max_features is not None:
        sides = [s.orderBy(F.desc("ctf"), "term").limit(max_features) for s in sides]
    both = sides[0].unionByName(sides[1])
    both = both.withColumn("idf", F.log((1.0 + n_items) / (1.0 + F.col("df"))) + 1.0)
    # Totals hold every term of the catalogue, the vocabulary a few of them.
    kept = write_parquet(both, "vocab")
    drop_written(per_term)
    return kept


def wide_vocabulary(vocab: DataFrame) -> DataFrame:
    return vocab.groupBy("term").agg(
        *[F.max(F.when(F.col("kind") == k, F.col("idf"))).alias(f"idf_{k}") for k in KINDS]
    )


def weigh(counts: DataFrame, vocab: DataFrame, max_features: int | None = MAX_FEATURES) -> DataFrame:
    """Add w_* = tf * idf / row norm; terms outside both vocabularies go."""
    wide = wide_vocabulary(vocab)
    if max_features is not None and 2 * max_features <= BROADCAST_TERMS:
        wide = F.broadcast(wide)
    row = Window.partitionBy("item_id")
    out = counts.join(wide, "term").withColumns(
        {f"x_{k}": F.col(f"tf_{k}") * F.coalesce(F.col(f"idf_{k}"), F.lit(0.0)) for k in KINDS}
    )
    out = out.withColumns(
        {f"n_{k}": F.sqrt(F.sum(F.col(f"x_{k}") * F.col(f"x_{k}")).over(row)) for k in KINDS}
    )
    out = out.withColumns(
        {
            f"w_{k}": F.when(F.col(f"n_{k}") > 0, F.col(f"x_{k}") / F.col(f"n_{k}")).otherwise(0.0)
            for k in KINDS
        }
    )
    return out.select(
        *_keys(counts), "term", "tf_content", "tf_opinion", "w_content", "w_opinion"
    )


def fit(
    catalog: DataFrame,
    lexicon: Lexicon,
    max_features: int | None = MAX_FEATURES,
    min_df: int = 1,
    ngram_range: tuple[int, int] = (1, 2),
    probe: Column | None = None,
    placed: bool = False,
) -> TextIndex:
    """Build both indexes and leave them in the shared folder, bucketed by item.

    ``probe`` marks the items of the probe part, best those likely to rank high;
    ``placed`` says that the catalogue is a table bucketed by item already.

    An item is counted, weighed and stored as one row, so no terms are sorted to be written.
    Catalogues that repeat ids, n-grams other than words and pairs, and vocabularies too large
    for a broadcast are counted and weighed over single terms.
    """
    spark = catalog.sparkSession
    low, high = ngram_range
    buckets = parallelism(spark)
    if probe is None:
        probe = F.pmod(F.xxhash64("item_id"), F.lit(PROBE_SHARE)) == 0
    rows = catalog.withColumn("probe", probe)
    if not placed:
        rows = rows.repartition(buckets, "item_id")
    features = text_features(rows, lexicon)
    n_items = catalog.count()
    bounded = max_features is not None and 2 * max_features <= BROADCAST_TERMS
    by_item = bounded and (low, high) == (1, 2) and not repeats_ids(catalog)
    if by_item:
        recipes = [CONTENT_RECIPE, OPINION_RECIPE]
        counts = G.item_counts(field_tokens(features, lexicon), ["item_id", "probe"], recipes)
    else:
        counts = count_terms(features, lexicon, low, high)
    counts = write_bucketed(counts, "counts", "item_id", buckets, "item_id")
    flat = flat_terms(counts) if by_item else counts
    n_rows = counts.agg(F.sum(F.size("term"))).first()[0] or 0 if by_item else counts.count()
    vocab = vocabulary(flat, n_items, max_features, min_df, n_rows)
    if by_item:
        known = wide_vocabulary(vocab).na.fill(0.0).collect()
        terms = [r["term"] for r in known]
        idf = {k: [r[f"idf_{k}"] for r in known] for k in KINDS}
        weighed = G.item_weights(counts, terms, idf)
    else:
        names = ("term", "tf_content", "tf_opinion", "w_content", "w_opinion")
        cells = F.collect_list(F.struct(*names)).alias("cells")
        weighed = weigh(counts, vocab, max_features).groupBy("item_id", "probe").agg(cells)
        weighed = weighed.select("item_id", "probe", *[F.col(f"cells.{n}").alias(n) for n in names])
    stored = write_bucketed(weighed, "postings", "item_id", buckets, "item_id", "probe")
    drop_written(counts)
    postings = flat_terms(stored)
    return TextIndex(postings, vocab, n_items, lexicon, low, high, max_features, min_df, stored)


def repeats_ids(catalog: DataFrame) -> bool:
    return bool(catalog.groupBy("item_id").count().where("count > 1").take(1))


# ---------------------------------------------------------------- reading the index


def vocab_stats(index: TextIndex) -> DataFrame:
    return index.vocab.groupBy("kind").agg(F.count("*").alias("vocabulary_size"))


def top_terms_of_item(
    index: TextIndex, items: DataFrame, k: int = 10, kind: str = "content"
) -> DataFrame:
    """The strongest terms of each wanted item: (item_id, term_rank, term, weight)."""
    wanted = broadcast_if_small(items.select("item_id").distinct())
    rows = index.side(kind).join(wanted, "item_id", "left_semi")
    return top_terms(rows, k)


def top_terms(rows: DataFrame, k: int) -> DataFrame:
    ranked = Window.partitionBy("item_id").orderBy(F.desc(F.round("w", 9)), "term")
    return (
        rows.withColumn("term_rank", F.row_number().over(ranked))
        .where(F.col("term_rank") <= k)
        .select("item_id", "term_rank", "term", F.col("w").alias("weight"))
    )


def simple_tfidf(
    catalog: DataFrame, recipe, stop_words: list[str], max_features: int | None = MAX_FEATURES
) -> DataFrame:
    """Unigram TF-IDF over one recipe of raw fields: (item_id, term, tf, w)."""
    spark = catalog.sparkSession
    n_items = catalog.count()
    placed = catalog.repartition(parallelism(spark), "item_id")
    fields = [text_or_blank(catalog, n).alias(n) for n, _ in recipe]
    toks = placed.select("item_id", *fields).select(
        "item_id", *[X.tokenize(F.col(n), stop_words).alias(f"tok_{n}") for n, _ in recipe]
    )
    tf = (
        toks.select("item_id", F.explode(_weighted_tokens(recipe)).alias("term"))
        .groupBy("item_id", "term")
        .agg(F.count("*").alias("tf"))
    )
    vocab = (
        tf.groupBy("term")
        .agg(F.count("*").alias("df"), F.sum("tf").alias("ctf"))
    )
    if max_features is not None:
        vocab = vocab.orderBy(F.desc("ctf"), "term").limit(max_features)
    vocab = vocab.select("term", (F.log((1.0 + n_items) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    if max_features is not None and max_features <= BROADCAST_TERMS:
        vocab = F.broadcast(vocab)
    x = F.col("tf") * F.col("idf")
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("item_id")))
    return tf.join(vocab, "term").withColumn("x", x).select(
        "item_id", "term", "tf", (F.col("x") / norm).alias("w")
    )


# ---------------------------------------------------------------- validity of stored data


def fingerprint_tree(catalog: DataFrame, size: int = RANGE_ITEMS) -> DataFrame:
    """(level, node, n_items, digest): hashes over the ids in the catalogue's order.

    A node of level 0 is the MD5 of ``size`` consecutive places of ``catalog_pos`` with their
    ids, one of a higher level that of ``size`` nodes below. The top level, ``TREE_LEVELS``, is
    one node up to ``size ** (TREE_LEVELS + 1)`` places. A group has at most ``size`` rows, as
    places are unique.
    """
    nothing = F.coalesce(F.col("item_id"), F.lit(""))
    level = catalog.groupBy(F.expr(f"catalog_pos div {size}").alias("node")).agg(
        F.count("*").alias("n_items"),
        F.collect_list(F.struct("catalog_pos", nothing.alias("id"))).alias("parts"),
    )
    line = lambda p: F.concat_ws(":", p["catalog_pos"], p["id"])
    level = level.select("node", "n_items", _digest(F.transform(F.array_sort("parts"), line)))
    levels = [level]
    for _ in range(TREE_LEVELS):
        level = level.groupBy(F.expr(f"node div {size}").alias("node")).agg(
            F.sum("n_items").alias("n_items"),
            F.collect_list(F.struct("node", "digest")).alias("parts"),
        )
        line = lambda p: F.concat_ws(":", p["node"], p["digest"])
        level = level.select("node", "n_items", _digest(F.transform(F.array_sort("parts"), line)))
        levels.append(level)
    rows = [one.select(F.lit(n).alias("level"), "node", "n_items", "digest") for n, one in enumerate(levels)]
    return reduce(DataFrame.unionByName, rows)


def _digest(lines: Column) -> Column:
    return F.md5(F.array_join(lines, "\n")).alias("digest")


def changed_ranges(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Level-0 nodes of two trees that differ: (node, items_before, items_after)."""
    a = stored.where("level = 0").select("node", F.col("n_items").alias("items_before"), F.col("digest").alias("a"))
    b = current.where("level = 0").select("node", F.col("n_items").alias("items_after"), F.col("digest").alias("b"))
    both = a.join(b, "node", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("node", "items_before", "items_after")


def catalog_fingerprint(catalog: DataFrame) -> DataFrame:
    """One row, ``n_items, digest``: the hash over the tops of the tree, one but for huge catalogues."""
    top = fingerprint_tree(catalog).where(F.col("level") == TREE_LEVELS)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda p: p["digest"])
    return top.agg(F.coalesce(F.sum("n_items"), F.lit(0)).alias("n_items"), _digest(parts))


def index_metadata(
    catalog: DataFrame, version: str = INDEX_VERSION, provider: str = "", dimension: int = 0
) -> DataFrame:
    """The one-row description stored beside an index or an embedding table."""
    return catalog_fingerprint(catalog).select(
        F.lit(version).alias("version"),
        F.lit(provider).alias("provider"),
        F.lit(dimension).alias("dimension"),
        "n_items",
        "digest",
    )


def is_valid(stored: DataFrame, current: DataFrame, stored_at=None, data_at=None) -> bool:
    """Stored data may be used: same metadata, and not older than the catalogue."""
    if stored_at is not None and data_at is not None and stored_at < data_at:
        return False
    keys = ["version", "provider", "dimension", "n_items", "digest"]
    same = stored.select(*keys).intersect(current.select(*keys))
    return bool(same.take(1))


def smooth_idf(n_items: int, df: int) -> float:
    return math.log((1 + n_items) / (1 + df)) + 1
