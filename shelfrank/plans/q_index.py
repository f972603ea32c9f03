"""Text index: tokens to weights, persistence, validity."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfrank.functions import text as X
from shelfrank.functions.lexicon import SHOP
from shelfrank.operators import index as I
from shelfrank.operators import ranking as R
from shelfrank.operators import semantic as V
from shelfrank.plans import fixtures as D
from shelfrank.plans import oracle as O
from shelfrank.plans import session_cache as C
from shelfrank.plans.oracle import CTES
from shelfrank.plans.q_ranking import RECOMMEND_SQL, recommended
from shelfrank.plans.registry import query
from shelfrank.runtime import shared_dir, write_parquet
from shelfrank.sources import model_store as MS

DIAGNOSTIC_RECIPE = (("title", 1), ("genres", 3), ("description", 1))


@query(
    "tokenize", "I1",
    O.sql(
        "SELECT item_id, CAST(len(t) AS INTEGER) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 "
        f"FROM (SELECT item_id, {O.tokenize('corpus')} AS t FROM corpus_content_v)"
    ),
)
def _(spark, d):
    features = I.text_features(D.catalog(spark, d), SHOP)
    toks = features.select(
        "item_id", X.tokenize(I.weighted_corpus(), SHOP.index_stop_words).alias("t")
    )
    return toks.select(
        "item_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5")
    )


@query(
    "ngrams", "I2",
    O.sql(
        "SELECT doc_id, CAST(len(g) AS INTEGER) AS n_grams, md5(array_to_string(g, '|')) AS grams_md5 FROM ("
        "SELECT doc_id, list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]), "
        "list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS g "
        f"FROM (SELECT doc_id, {O.tokenize('text')} AS t FROM documents))"
    ),
)
def _(spark, d):
    toks = D.table(spark, d, "documents").select(
        "doc_id", X.tokenize(F.col("text"), SHOP.index_stop_words).alias("t")
    )
    grams = toks.select("doc_id", X.ngrams(F.col("t"), 1, 3).alias("g"))
    return grams.select(
        "doc_id", F.size("g").alias("n_grams"), F.md5(F.array_join("g", "|")).alias("grams_md5")
    )


@query(
    "build_postings", "I3",
    O.sql(
        "SELECT item_id, c.n_content, c.tf_content, c.chars_content, o.n_opinion, o.tf_opinion, o.chars_opinion FROM ("
        "SELECT item_id, count(*) AS n_content, CAST(sum(tf) AS BIGINT) AS tf_content, CAST(sum(tf * length(term)) AS BIGINT) AS chars_content FROM tf_content_v GROUP BY 1) c JOIN ("
        "SELECT item_id, count(*) AS n_opinion, CAST(sum(tf) AS BIGINT) AS tf_opinion, CAST(sum(tf * length(term)) AS BIGINT) AS chars_opinion FROM tf_opinion_v GROUP BY 1) o USING (item_id)"
    ),
)
def _(spark, d):
    cat = D.catalog(spark, d).repartition(I.parallelism(spark), "item_id")
    counts = I.count_terms(I.text_features(cat, SHOP), SHOP)
    return counts.groupBy("item_id").agg(
        *[
            f
            for k in I.KINDS
            for f in (
                F.count_if(F.col(f"tf_{k}") > 0).alias(f"n_{k}"),
                F.sum(f"tf_{k}").alias(f"tf_{k}"),
                F.sum(F.col(f"tf_{k}") * F.length("term")).alias(f"chars_{k}"),
            )
        ]
    )


@query(
    "build_vocabulary", "I4",
    O.sql(
        "SELECT 'content' AS kind, term, df, ctf, round(idf, 6) AS idf FROM vocab_content_v UNION ALL "
        "SELECT 'opinion', term, df, ctf, round(idf, 6) FROM vocab_opinion_v"
    ),
)
def _(spark, d):
    return C.model(spark, d).index.vocab.select(
        "kind", "term", "df", "ctf", F.round("idf", 6).alias("idf")
    )


@query(
    "weight_and_normalise", "I5 I6",
    O.sql(
        "SELECT 'content' AS kind, item_id, term, CAST(tf AS INTEGER) AS tf, round(w, 6) AS w FROM index_content_v"
    ),
)
def _(spark, d):
    side = C.model(spark, d).index.side("content")
    return side.select(
        F.lit("content").alias("kind"), "item_id", "term", "tf", F.round("w", 6).alias("w")
    )


@query(
    "fit_indexes", "I6",
    O.sql(
        "SELECT 'content' AS kind, count(*) AS n_rows, count(DISTINCT item_id) AS n_items, round(sum(w * w), 6) AS squares, round(sum(w), 4) AS total FROM index_content_v UNION ALL "
        "SELECT 'opinion', count(*), count(DISTINCT item_id), round(sum(w * w), 6), round(sum(w), 4) FROM index_opinion_v"
    ),
)
def _(spark, d):
    index = C.model(spark, d).index
    parts = [
        index.side(k)
        .groupBy("item_id")
        .agg(F.count("*").alias("n"), F.sum(F.col("w") * F.col("w")).alias("q"), F.sum("w").alias("s"))
        .agg(
            F.lit(k).alias("kind"),
            F.sum("n").alias("n_rows"),
            F.count("*").alias("n_items"),
            F.round(F.sum("q"), 6).alias("squares"),
            F.round(F.sum("s"), 4).alias("total"),
        )
        for k in I.KINDS
    ]
    return parts[0].unionByName(parts[1])


@query(
    "top_terms_of_item", "I7",
    O.sql(
        "SELECT item_id, CAST(r AS INTEGER) AS term_rank, term, round(w, 6) AS weight FROM (SELECT *, row_number() OVER "
        "(PARTITION BY item_id ORDER BY round(w, 9) DESC, term) AS r FROM index_content_v) WHERE r <= 10"
    ),
)
def _(spark, d):
    model = C.model(spark, d)
    terms = I.top_terms_of_item(model.index, model.items, 10)
    return terms.withColumn("weight", F.round("weight", 6))


CTES["diag_tf_v"] = f"""
SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({O.tokenize("concat(title, ' ', repeat(concat(genres, ' '), 3), description)")}) AS term
FROM catalog_v) GROUP BY 1, 2
"""
CTES["diag_v"] = """
SELECT item_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS w FROM (
  SELECT item_id, term, tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM catalog_v)) / (1.0::DOUBLE + df)) + 1.0::DOUBLE) AS x
  FROM diag_tf_v JOIN (SELECT term, count(*) AS df FROM diag_tf_v GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 30000) USING (term))
"""


@query(
    "top_terms_diagnostic", "I7",
    O.sql(
        "SELECT item_id, CAST(r AS INTEGER) AS term_rank, term, round(w, 6) AS weight FROM (SELECT *, row_number() OVER "
        "(PARTITION BY item_id ORDER BY round(w, 9) DESC, term) AS r FROM diag_v) WHERE r <= 10"
    ),
)
def _(spark, d):
    rows = I.simple_tfidf(D.catalog(spark, d), DIAGNOSTIC_RECIPE, SHOP.index_stop_words)
    return I.top_terms(rows, 10).withColumn("weight", F.round("weight", 6))


# A reopened model ranks as the fitted one: the oracle is that of ``recommend``.
@query("persist_and_load_index", "I8", O.sql(RECOMMEND_SQL))
def _(spark, d):
    cat = D.catalog(spark, d)
    root = f"{shared_dir(spark)}/model-{uuid.uuid4().hex[:8]}"
    MS.save_model(C.model(spark, d), cat, root)
    opened = MS.open_model(spark, root, SHOP, cat, f"{d}/documents.parquet", ngram_range=(1, 2))
    return recommended(R.recommend(opened, D.requests(spark, d), 10))


# Leaves of 64 places give a tree of three levels at the test sizes.
TREE_SIZE = 64


def _node(source, key, line):
    digest = f"md5(string_agg({line}, chr(10) ORDER BY {key}))"
    items = "count(*)" if key == "pos" else "sum(n_items)"
    return (
        f"SELECT {key} // {TREE_SIZE} AS node, CAST({items} AS BIGINT) AS n_items, {digest} AS digest "
        f"FROM {source} GROUP BY 1"
    )


CTES["fp_rows_v"] = "SELECT CAST(catalog_pos AS BIGINT) AS pos, item_id FROM catalog_v"
CTES["fp0_v"] = _node("fp_rows_v", "pos", "concat(pos, ':', item_id)")
CTES["fp1_v"] = _node("fp0_v", "node", "concat(node, ':', digest)")
CTES["fp2_v"] = _node("fp1_v", "node", "concat(node, ':', digest)")


@query(
    "catalog_fingerprint", "I9",
    O.sql(" UNION ALL ".join(
        f"SELECT CAST({n} AS INTEGER) AS level, node, n_items, digest FROM fp{n}_v" for n in range(3)
    )),
)
def _(spark, d):
    return I.fingerprint_tree(D.catalog(spark, d), TREE_SIZE)


def _metadata_sql(version, provider, dimension, keep):
    return (
        f"SELECT '{version}' AS version, '{provider}' AS provider, {dimension} AS dimension, count(*) AS n, "
        f"string_agg(concat(catalog_pos, ':', item_id), chr(10) ORDER BY catalog_pos) AS ids FROM catalog_v WHERE {keep}"
    )


CHANGES = {
    "same": ("1", "table", 64, "TRUE"),
    "other provider": ("1", "x", 64, "TRUE"),
    "other version": ("2", "table", 64, "TRUE"),
    "other dimension": ("1", "table", 32, "TRUE"),
    "other items": ("1", "table", 64, "catalog_pos <> 0"),
}


@query(
    "embedding_table_validity", "I10",
    O.sql(" UNION ALL ".join(
        f"SELECT '{name}' AS change, (SELECT count(*) FROM (({_metadata_sql(*CHANGES['same'])}) INTERSECT ({_metadata_sql(*facts)}))) = 1 AS valid"
        for name, facts in CHANGES.items()
    )),
)
def _(spark, d):
    cat = D.catalog(spark, d)

    def metadata(version, provider, dimension, keep):
        return write_parquet(I.index_metadata(cat.where(keep), version, provider, dimension), "meta")

    stored = metadata(*CHANGES["same"])
    rows = [(name, I.is_valid(stored, metadata(*facts))) for name, facts in CHANGES.items()]
    return spark.createDataFrame(rows, "change string, valid boolean")


@query(
    "vocab_stats", "I11",
    O.sql(
        "SELECT 'content' AS kind, count(*) AS vocabulary_size FROM vocab_content_v UNION ALL "
        "SELECT 'opinion', count(*) FROM vocab_opinion_v"
    ),
)
def _(spark, d):
    return I.vocab_stats(C.model(spark, d).index)


@query(
    "attach_embeddings", "I12",
    O.sql(
        "SELECT item_id, v IS NOT NULL AS has_vector, round(coalesce(list_dot_product(v, v), 0), 4) AS norm "
        "FROM catalog_v LEFT JOIN ivec_v USING (item_id)"
    ),
)
def _(spark, d):
    rows = V.attach_embeddings(D.catalog(spark, d), D.item_vectors(spark, d))
    norm = F.coalesce(V.dot(F.col("vector"), F.col("vector")), F.lit(0.0))
    return rows.select(
        "item_id", F.col("vector").isNotNull().alias("has_vector"), F.round(norm, 4).alias("norm")
    )
