"""Facets, explanations and panel numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfrank.operators import explain as P
from shelfrank.operators import ranking as R
from shelfrank.operators import scoring as S
from shelfrank.plans import fixtures as D
from shelfrank.plans import oracle as O
from shelfrank.plans import session_cache as C
from shelfrank.plans.oracle import CTES
from shelfrank.plans.q_columns import _sql_short
from shelfrank.plans.registry import query


@query(
    "facet_values", "A1",
    O.sql(f"SELECT DISTINCT unnest({O.split_raw('tags')}) AS term FROM catalog_v"),
)
def _(spark, d):
    return P.facet_values(D.catalog(spark, d), "tags")


def _top_sql(column, limit):
    return O.sql(
        f"SELECT term, count(*) AS n_rows FROM (SELECT unnest(list_distinct({O.split_raw(column)})) AS term FROM catalog_v) "
        f"GROUP BY term ORDER BY n_rows DESC, lower(term), term LIMIT {limit}"
    )


@query("top_tags", "A2", _top_sql("tags", 160))
def _(spark, d):
    return P.top_facets(D.catalog(spark, d), "tags", 160)


@query("top_developers", "A2", _top_sql("developer", 180))
def _(spark, d):
    return P.top_facets(D.catalog(spark, d), "developer", 180)


@query(
    "year_bounds", "A3",
    O.sql(
        "SELECT CAST(coalesce(min(release_year) FILTER (release_year > 0), 1980) AS INTEGER) AS min_year, "
        "CAST(CASE WHEN coalesce(max(release_year), 0) = 0 THEN 2026 ELSE max(release_year) END AS INTEGER) AS max_year FROM catalog_v"
    ),
)
def _(spark, d):
    return P.year_bounds(D.catalog(spark, d))


@query(
    "panel_stats", "A4",
    O.sql(
        "SELECT request_id, count(item_id) AS n_shown, round(coalesce(max(score), 0), 6) AS best_score, "
        "(SELECT count(*) FROM catalog_v) AS n_catalog FROM req_v LEFT JOIN (SELECT request_id, item_id, score FROM rec_v "
        "WHERE positive_ratio >= 99) USING (request_id) GROUP BY request_id"
    ),
)
def _(spark, d):
    model, requests = C.model(spark, d), D.requests(spark, d)
    ranked = R.recommend(model, requests, 10).where("positive_ratio >= 99")
    return P.panel_stats(model.items, ranked, requests).withColumn("best_score", F.round("best_score", 6))


@query(
    "all_ids_prefixed", "A5",
    O.sql(
        "SELECT '1' AS prefix, bool_and(starts_with(item_id, '1')) AS all_prefixed FROM catalog_v UNION ALL "
        "SELECT '', bool_and(starts_with(item_id, '')) FROM catalog_v"
    ),
)
def _(spark, d):
    cat = D.catalog(spark, d)
    parts = [P.all_ids_prefixed(cat, p).select(F.lit(p).alias("prefix"), "all_prefixed") for p in ("1", "")]
    return parts[0].unionByName(parts[1])


CTES["source_terms_v"] = """
SELECT request_id, term, qw FROM qv_content_v UNION ALL
SELECT request_id, term, w FROM requests_v r JOIN index_content_v i ON i.item_id = r.reference_ids[1]
WHERE trim(r.query) = ''
"""
CTES["contribution_v"] = """
SELECT r.request_id, r.item_id, i.term, i.w * CASE WHEN q.has_query OR q.has_references THEN s.qw ELSE i.w END AS c
FROM rec_v r JOIN req_v q USING (request_id) JOIN index_content_v i ON i.item_id = r.item_id
LEFT JOIN source_terms_v s ON s.request_id = r.request_id AND s.term = i.term
"""


@query(
    "explain_terms", "A6",
    O.sql(
        "SELECT request_id, item_id, CAST(k AS INTEGER) AS term_rank, term, round(c, 6) AS contribution FROM (SELECT *, row_number() OVER ("
        "PARTITION BY request_id, item_id ORDER BY round(c, 9) DESC, term) AS k FROM contribution_v WHERE c > 0) WHERE k <= 5"
    ),
)
def _(spark, d):
    model = C.model(spark, d)
    reqs = S.normalise_requests(D.requests(spark, d)).withColumn(
        "reference_id", F.get("reference_ids", 0)
    )
    ranked = R.recommend(model, D.requests(spark, d), 10)
    rows = P.explain_terms(model.index, ranked, reqs, 5)
    return rows.select(
        "request_id", "item_id", "term_rank", "term", F.round("contribution", 6).alias("contribution")
    )


def _ranked_rows(spark, d, k=10):
    """Ranked rows with item texts, query and liked items' terms."""
    model = C.model(spark, d)
    reqs = S.normalise_requests(D.requests(spark, d))
    items = model.items.select(
        "item_id", "genres", "tags", "review_keywords"
    )
    liked = P.reference_terms(S.request_references(reqs), items)
    ranked = R.recommend(model, D.requests(spark, d), k)
    return (
        ranked.join(items, "item_id")
        .join(reqs.select("request_id", "query", "reference_ids"), "request_id")
        .join(liked, "request_id", "left")
    )


CTES["shown_v"] = f"""
SELECT v.request_id, v.item_id, v.rank, v.title, v.genres, v.tags, v.review_keywords, v.positive_ratio, v.score, v.content_score,
  v.semantic_score, v.opinion_score, v.quality_score, q.query, q.reference_ids, {O.collapse_lower('q.query')} AS asked,
  {O.split_terms("concat(v.genres, ', ', v.tags, ', ', v.review_keywords)")} AS all_terms,
  {O.split_terms("concat(v.genres, ', ', v.tags)")} AS own_terms
FROM rec_v v JOIN requests_v q USING (request_id)
"""
CTES["liked_v"] = f"""
SELECT request_id, list(DISTINCT t) AS liked FROM (SELECT request_id, {O.collapse_lower('t')} AS t FROM (
  SELECT request_id, unnest({O.split_raw("concat(genres, ', ', tags)")}) AS t FROM refs_v JOIN catalog_v USING (item_id)))
GROUP BY request_id
"""
CTES["reasons_v"] = f"""
SELECT s.*, (list_filter(all_terms, lambda x: contains(asked, {O.collapse_lower('x')})))[1:6] AS qm,
  (list_filter(own_terms, lambda x: list_contains(coalesce(liked, []), {O.collapse_lower('x')})))[1:6] AS rm, liked
FROM shown_v s LEFT JOIN liked_v USING (request_id)
"""


@query(
    "query_term_matches", "A7",
    O.sql("SELECT request_id, item_id, array_to_string(CASE WHEN asked = '' THEN [] ELSE qm END, '|') AS matches FROM reasons_v"),
)
def _(spark, d):
    rows = _ranked_rows(spark, d)
    return rows.select(
        "request_id", "item_id", F.array_join(P.query_term_matches(rows), "|").alias("matches")
    )


@query(
    "reference_term_matches", "A8",
    O.sql("SELECT request_id, item_id, array_to_string(rm, '|') AS matches FROM reasons_v"),
)
def _(spark, d):
    rows = _ranked_rows(spark, d)
    return rows.select(
        "request_id", "item_id", F.array_join(P.reference_term_matches(rows), "|").alias("matches")
    )


@query(
    "reason_codes", "A9",
    O.sql(
        "SELECT request_id, item_id, array_to_string((list_filter([a, b, CASE WHEN a IS NULL AND b IS NULL THEN 'catalogue_favourite' END, "
        "'community_sentiment'], lambda x: x IS NOT NULL))[1:3], ' / ') AS reasons, "
        "printf('approval: %.0f%%', positive_ratio + 0.25) AS approval FROM (SELECT *, "
        "CASE WHEN asked <> '' AND len(qm) > 0 THEN concat('query_terms: ', array_to_string(qm, ', ')) WHEN asked <> '' THEN 'query_text' END AS a, "
        "CASE WHEN len(rm) > 0 THEN concat('shared_terms: ', array_to_string(rm, ', ')) WHEN liked IS NOT NULL THEN 'reference_text' END AS b FROM reasons_v)"
    ),
)
def _(spark, d):
    rows = _ranked_rows(spark, d)
    rows = rows.withColumns({"qm": P.query_term_matches(rows), "rm": P.reference_term_matches(rows)})
    known = F.col("reference_terms").isNotNull()
    ratio = F.col("positive_ratio") + 0.25

    def codes(sentiment):
        return P.reason_codes(F.col("qm"), F.col("rm"), F.col("query"), known, ratio, sentiment, 4)

    return rows.select(
        "request_id",
        "item_id",
        F.array_join(F.slice(codes(True), 1, 3), " / ").alias("reasons"),
        F.element_at(codes(False), -1).alias("approval"),
    )


@query(
    "signal_summary", "A10",
    O.sql(
        "SELECT request_id, item_id, concat_ws(', ', CASE WHEN content_score > 0 THEN printf('content=%.3f', content_score) END, "
        "CASE WHEN semantic_score > 0 THEN printf('semantic=%.3f', semantic_score) END, "
        "CASE WHEN opinion_score > 0 THEN printf('search=%.3f', opinion_score) END, printf('quality=%.3f', quality_score)) AS summary FROM rec_v"
    ),
)
def _(spark, d):
    ranked = R.recommend(C.model(spark, d), D.requests(spark, d), 10)
    return ranked.select("request_id", "item_id", P.signal_summary().alias("summary"))


_SIGNALS = ("score", "content_score", "semantic_score", "opinion_score", "quality_score")


@query(
    "score_breakdown", "A11",
    O.sql(
        "SELECT request_id, item_id, "
        + ", ".join(f"round(greatest(least({c}, 1), 0), 6) AS {c}" for c in _SIGNALS)
        + f" FROM ({O.ranked('scored_sem_v', 10)})"
    ),
)
def _(spark, d):
    ranked = R.recommend(
        C.semantic_model(spark, d), D.requests(spark, d), 10,
        query_vectors=D.request_vectors(spark, d),
    )
    rows = P.score_breakdown(ranked)
    return rows.select("request_id", "item_id", *[F.round(c, 6).alias(c) for c in _SIGNALS])


def _short(x):
    return _sql_short(O.collapse(x), 260, 259)


@query(
    "local_explanation", "A12",
    O.sql(
        "SELECT request_id, item_id, concat(title, ' (', concat_ws('; ', CASE WHEN query <> '' THEN concat('asked: ', query) WHEN lbl IS NOT NULL THEN concat('liked: ', lbl) "
        f"ELSE 'nothing asked' END, CASE WHEN {_short('genres')} <> '' THEN concat('shelf: ', {_short('genres')}) END, "
        f"CASE WHEN {_short('tags')} <> '' THEN concat('labels: ', {_short('tags')}) END), ')') AS explanation "
        "FROM (SELECT *, array_to_string(reference_ids, ', ') AS lbl FROM shown_v)"
    ),
)
def _(spark, d):
    rows = _ranked_rows(spark, d)
    label = F.when(F.col("reference_ids").isNotNull(), F.array_join("reference_ids", ", "))
    return rows.select("request_id", "item_id", P.local_explanation(label).alias("explanation"))


@query(
    "local_answer", "A12",
    O.sql(
        f"SELECT request_id, CASE WHEN body IS NULL THEN {O.q(P.EMPTY_ANSWER)} ELSE concat({O.q(P.ANSWER_HEAD)}, chr(10), body) END AS answer FROM ("
        "SELECT q.request_id, string_agg(CASE WHEN v.rank IS NOT NULL THEN concat('#', CAST(v.rank AS VARCHAR), ' ', v.title, ' [', "
        f"CASE WHEN {_short('v.tags')} <> '' THEN {_short('v.tags')} ELSE {_short('v.genres')} END, '] for: ', q.query) END, chr(10) ORDER BY v.rank) AS body "
        "FROM requests_v q LEFT JOIN (SELECT * FROM rec_v WHERE rank <= 5 AND request_id <> 'none') v USING (request_id) GROUP BY q.request_id)"
    ),
)
def _(spark, d):
    # request "none" is left without results to show the empty-result text
    rows = _ranked_rows(spark, d, 5).where(F.col("request_id") != "none")
    prompts = D.requests(spark, d).select("request_id", F.col("query").alias("prompt"))
    return P.local_answer(prompts, rows)
