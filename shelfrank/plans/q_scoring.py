"""Scores of requests against the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfrank.operators import cells as N
from shelfrank.operators import ranking as R
from shelfrank.operators import scoring as S
from shelfrank.operators import semantic as V
from shelfrank.plans import fixtures as D
from shelfrank.plans import oracle as O
from shelfrank.plans import session_cache as C
from shelfrank.plans.oracle import CTES
from shelfrank.plans.registry import query


def _r(*names):
    return [F.round(n, 6).alias(n) for n in names]


def _score_query(name, ids, kind):
    @query(
        name, ids,
        O.sql(f"SELECT request_id, item_id, round(s, 6) AS {kind}_score FROM text_{kind}_v"),
    )
    def _(spark, d):
        scores = R.text_matches(C.model(spark, d), D.text_requests(spark, d), kind)
        return scores.select("request_id", "item_id", *_r(f"{kind}_score"))


_score_query("score_by_text", "R1", "content")
_score_query("score_by_opinion_text", "R2", "opinion")


@query(
    "score_by_references", "R3",
    O.sql("SELECT request_id, item_id, round(s, 6) AS content_score FROM ref_scores_v"),
)
def _(spark, d):
    scores = S.reference_scores(
        S.normalise_requests(D.requests(spark, d)), C.model(spark, d).index
    )
    return scores.select("request_id", "item_id", *_r("content_score"))


@query(
    "score_by_reference", "R4",
    O.sql(
        "SELECT concat('b', b.item_id) AS request_id, i.item_id, round(sum(a.w * i.w), 6) AS content_score "
        "FROM benchmark b JOIN index_content_v a ON a.item_id = CAST(b.item_id AS VARCHAR) "
        "JOIN index_content_v i ON i.term = a.term AND i.item_id <> a.item_id GROUP BY 1, 2"
    ),
)
def _(spark, d):
    bench = D.table(spark, d, "benchmark")
    reqs = bench.select(
        F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("request_id"),
        F.lit("").alias("query"),
        F.array().cast("array<string>").alias("reference_ids"),
        F.col("item_id").cast("string").alias("reference_id"),
    )
    scores = S.reference_scores(S.normalise_requests(reqs), C.model(spark, d).index)
    return scores.select("request_id", "item_id", *_r("content_score"))


@query(
    "top_by_text", "R5",
    O.sql(
        "SELECT request_id, CAST(r AS INTEGER) AS rank, item_id, round(s, 6) AS content_score FROM (SELECT *, row_number() OVER "
        "(PARTITION BY request_id ORDER BY round(s, 9) DESC, CAST(item_id AS BIGINT)) AS r FROM text_content_v) WHERE r <= 10"
    ),
)
def _(spark, d):
    model = C.model(spark, d)
    scores = R.text_matches(model, D.text_requests(spark, d))
    rows = scores.join(model.items.select("item_id", "catalog_pos"), "item_id")
    best = S.top_k(rows, "content_score", 10, [F.col("catalog_pos")])
    return best.select("request_id", "rank", "item_id", *_r("content_score"))


@query(
    "similar_items", "R5",
    O.sql(
        "SELECT request_id, CAST(r AS INTEGER) AS rank, item_id, round(s, 6) AS content_score FROM (SELECT *, row_number() OVER "
        "(PARTITION BY request_id ORDER BY round(s, 9) DESC, CAST(item_id AS BIGINT)) AS r FROM ref_scores_v) WHERE r <= 10"
    ),
)
def _(spark, d):
    model = C.model(spark, d)
    scores = S.reference_scores(S.normalise_requests(D.requests(spark, d)), model.index)
    rows = scores.join(model.items.select("item_id", "catalog_pos"), "item_id")
    best = S.top_k(rows, "content_score", 10, [F.col("catalog_pos")])
    return best.select("request_id", "rank", "item_id", *_r("content_score"))


CTES["sem_rank_v"] = """
SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(s, 9) DESC, CAST(item_id AS BIGINT)) AS r FROM sem_v
WHERE item_id IN (SELECT item_id FROM catalog_v)
"""
CTES["asked_sem_v"] = """
SELECT q.item_id AS qid, i.item_id, list_dot_product(q.v, i.v) AS s FROM ivec_v q, ivec_v i
WHERE CAST(q.item_id AS BIGINT) IN (SELECT item_id FROM benchmark) AND i.item_id IN (SELECT item_id FROM catalog_v)
"""


def _dense_items(spark, d):
    positions = D.table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("item_id"), F.col("doc_id").alias("catalog_pos")
    )
    return positions.join(D.item_vectors(spark, d), "item_id")


def _nearest(spark, d, requests):
    items = _dense_items(spark, d)
    cells = N.build_cells(V.plain_items(items))
    return V.semantic_top_k(items, requests, 10, lambda asked, k: N.search_cells(cells, asked, k))


@query(
    "semantic_by_text", "R7",
    O.sql(
        "SELECT concat('b', qid) AS request_id, CAST(r AS INTEGER) AS rank, item_id, round(s, 6) AS semantic_score FROM (SELECT *, row_number() OVER "
        "(PARTITION BY qid ORDER BY round(s, 9) DESC, CAST(item_id AS BIGINT)) AS r FROM asked_sem_v) WHERE r <= 10"
    ),
)
def _(spark, d):
    asked = D.request_vectors(spark, d).withColumn("own_ids", F.lit(None).cast("array<string>"))
    best = _nearest(spark, d, asked)
    return best.select("request_id", "rank", "item_id", *_r("semantic_score"))


@query(
    "semantic_by_references", "R8",
    O.sql(
        "SELECT request_id, CAST(r AS INTEGER) AS rank, item_id, round(s, 6) AS semantic_score FROM sem_rank_v "
        "WHERE r <= 10 AND request_id IN (SELECT request_id FROM cvec_v)"
    ),
)
def _(spark, d):
    reqs = S.normalise_requests(D.requests(spark, d))
    liked = V.reference_vectors(S.request_references(reqs), D.item_vectors(spark, d))
    own = reqs.select("request_id", F.col("reference_ids").alias("own_ids"))
    best = _nearest(spark, d, liked.join(own, "request_id"))
    return best.select("request_id", "rank", "item_id", *_r("semantic_score"))


@query(
    "semantic_selection", "R9",
    O.sql(
        "SELECT request_id, CASE WHEN v IS NULL THEN 'none' WHEN has_references THEN 'references' ELSE 'query' END AS source, "
        "round(coalesce(v[1], 0), 6) AS first_value FROM rvec_v JOIN req_v USING (request_id)"
    ),
)
def _(spark, d):
    reqs = S.normalise_requests(D.requests(spark, d)).withColumns(
        {"has_query": S.has_query(), "has_references": S.has_references()}
    )
    rows = V.select_vectors(
        reqs, S.request_references(reqs), D.item_vectors(spark, d), D.request_vectors(spark, d)
    )
    source = (
        F.when(F.col("vector").isNull(), "none")
        .when(F.col("has_references"), "references")
        .otherwise("query")
    )
    return rows.select(
        "request_id",
        source.alias("source"),
        F.round(F.coalesce(F.get("vector", 0), F.lit(0.0)), 6).alias("first_value"),
    )


def _matches(spark, d):
    return R.score_matches(C.model(spark, d), D.requests(spark, d))


# Pairs that share a term with the request in either index.
_MATCHED = "FROM scored_v WHERE (request_id, item_id) IN (SELECT request_id, item_id FROM hit_v)"
CTES["hit_v"] = """
SELECT request_id, item_id FROM match_opinion_v UNION
SELECT request_id, item_id FROM centroid_v JOIN index_content_v USING (term)
"""


@query(
    "concept_coverage", "R10",
    O.sql(f"SELECT request_id, item_id, round(query_coverage_score, 6) AS query_coverage_score {_MATCHED}"),
)
def _(spark, d):
    return _matches(spark, d).select("request_id", "item_id", *_r("query_coverage_score"))


@query(
    "opinion_damping", "R11",
    O.sql(f"SELECT request_id, item_id, round(opinion_score, 6) AS text_search_score {_MATCHED}"),
)
def _(spark, d):
    return _matches(spark, d).select("request_id", "item_id", *_r("text_search_score"))


@query(
    "popularity_score", "R12",
    O.sql("SELECT item_id, round(popularity_score, 6) AS popularity_score FROM items_v"),
)
def _(spark, d):
    return D.catalog(spark, d).select("item_id", F.round(S.popularity(), 6).alias("popularity_score"))


def _sql_sentiment(scale):
    return (
        "SELECT item_id, round(greatest(least(CASE WHEN lo < 0 AND hi <= 1 THEN (fs + 1) / 2 WHEN hi > 1 THEN "
        "fs / (CASE WHEN hi <= 5 THEN 5.0::DOUBLE ELSE 100.0::DOUBLE END) ELSE fs END, 1), 0), 6) AS v FROM ("
        f"SELECT item_id, coalesce(s, m) AS fs, min(coalesce(s, m)) OVER () AS lo, max(coalesce(s, m)) OVER () AS hi FROM ("
        f"SELECT item_id, {scale} AS s, (SELECT median({scale}) FROM catalog_v) AS m FROM catalog_v))"
    )


_SCALES = {
    "signed": "sentiment_score",
    "five": "(sentiment_score + 1) * 2.5::DOUBLE",
    "hundred": "(sentiment_score + 1) * 50",
    "unit": "abs(sentiment_score)",
}


@query(
    "normalise_sentiment", "R13",
    O.sql(
        " UNION ALL ".join(f"SELECT '{n}' AS scale, * FROM ({_sql_sentiment(x)})" for n, x in _SCALES.items())
        + " UNION ALL SELECT 'absent', item_id, round(popularity_score, 6) FROM items_v"
    ),
)
def _(spark, d):
    cat = D.catalog(spark, d)
    s = F.col("sentiment_score")
    scales = {"signed": s, "five": (s + 1) * 2.5, "hundred": (s + 1) * 50, "unit": F.abs(s)}
    out = None
    for name, expr in scales.items():
        scaled = cat.withColumn("sentiment_score", expr)
        v = S.normalised_sentiment(S.sentiment_stats(scaled))
        part = scaled.select(F.lit(name).alias("scale"), "item_id", F.round(v, 6).alias("v"))
        out = part if out is None else out.unionByName(part)
    absent = cat.drop("sentiment_score")
    v = S.normalised_sentiment(S.sentiment_stats(absent))
    return out.unionByName(
        absent.select(F.lit("absent").alias("scale"), "item_id", F.round(v, 6).alias("v"))
    )


@query(
    "quality_score", "R14",
    O.sql("SELECT item_id, round(quality_score, 6) AS quality_score FROM items_v"),
)
def _(spark, d):
    cat = D.catalog(spark, d)
    score = S.quality(S.sentiment_stats(cat))
    return cat.select("item_id", F.round(score, 6).alias("quality_score"))


_W = ("weight_content", "weight_semantic", "weight_opinion", "weight_quality")


@query(
    "active_weights", "R15",
    O.sql(
        "SELECT FALSE AS semantic, request_id, " + ", ".join(f"round({w}, 6) AS {w}" for w in _W) + " FROM weights_v UNION ALL "
        "SELECT TRUE, request_id, " + ", ".join(f"round({w}, 6)" for w in _W) + " FROM weights_sem_v"
    ),
)
def _(spark, d):
    reqs = S.normalise_requests(D.requests(spark, d))
    parts = []
    for semantic in (False, True):
        shares = S.active_weights(semantic_active=semantic)
        parts.append(
            reqs.select(
                F.lit(semantic).alias("semantic"),
                "request_id",
                *[F.round(shares[w], 6).alias(w) for w in _W],
            )
        )
    return parts[0].unionByName(parts[1])


_SIGNALS = ("score", "content_score", "opinion_score", "quality_score")


@query(
    "hybrid_score", "R16",
    O.sql(
        "SELECT request_id, item_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _SIGNALS) + f" {_MATCHED}"
    ),
)
def _(spark, d):
    return _matches(spark, d).select("request_id", "item_id", *_r(*_SIGNALS))
