"""Ranked lists, facets, titles, comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfrank.operators import ranking as R
from shelfrank.operators.similar import similar_items_all
from shelfrank.plans import fixtures as D
from shelfrank.plans import oracle as O
from shelfrank.plans import session_cache as C
from shelfrank.plans.oracle import CTES
from shelfrank.plans.registry import query

SIGNALS = ("score", "content_score", "semantic_score", "opinion_score", "quality_score")


def _r(*names):
    return [F.round(n, 6).alias(n) for n in names]


def _sql_r(*names):
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def recommended(df):
    return df.select("request_id", "rank", "item_id", *_r(*SIGNALS))


def _sql_out(source):
    return (
        f"SELECT request_id, CAST(rank AS INTEGER) AS rank, item_id, {_sql_r(*SIGNALS)} FROM ({source})"
    )


@query(
    "similar_items_all", "R6",
    O.sql(
        "SELECT item_id, CAST(r AS INTEGER) AS rank, similar_id, round(s, 6) AS score FROM (SELECT *, row_number() OVER ("
        "PARTITION BY item_id ORDER BY round(s, 9) DESC, CAST(similar_id AS BIGINT)) AS r FROM ("
        "SELECT a.item_id, b.item_id AS similar_id, sum(a.w * b.w) AS s FROM index_content_v a JOIN index_content_v b "
        "ON a.term = b.term AND a.item_id <> b.item_id GROUP BY 1, 2)) WHERE r <= 10"
    ),
)
def _(spark, d):
    model = C.model(spark, d)
    rows = similar_items_all(model.index, model.items, 10)
    return rows.select("item_id", "rank", "similar_id", *_r("score"))


RECOMMEND_SQL = _sql_out("SELECT * FROM rec_v")


@query("recommend", "R17 R12 R14 R15 R16", O.sql(RECOMMEND_SQL))
def _(spark, d):
    return recommended(R.recommend(C.model(spark, d), D.requests(spark, d), 10))


@query(
    "recommend_semantic", "R9 R17", O.sql(_sql_out(O.ranked("scored_sem_v", 10))),
)
def _(spark, d):
    return recommended(
        R.recommend(
            C.semantic_model(spark, d), D.requests(spark, d), 10,
            query_vectors=D.request_vectors(spark, d),
        )
    )


FACETS = {
    "min_ratio": 60,
    "years": (1980, 2020),
    "prices": (0.0, 950.0),
    "genres": ["economy", "Promo", "FR"],
    "tags": ["POPULAR", "src3"],
}


def _sql_any(column, wanted):
    low = O.str_list([w.lower() for w in wanted])
    return f"list_has_any(list_transform({O.split_raw(column)}, lambda fa: lower(fa)), {low})"


_FACET_SQL = (
    "positive_ratio >= 60 AND release_year BETWEEN 1980 AND 2020 AND price BETWEEN 0 AND 950 AND "
    f"{_sql_any('genres', FACETS['genres'])} AND {_sql_any('tags', FACETS['tags'])}"
)


@query("facet_filter", "R18", O.sql(f"SELECT item_id, title, genres, tags FROM catalog_v WHERE {_FACET_SQL}"))
def _(spark, d):
    rows = D.catalog(spark, d).where(R.facet_filter(**FACETS))
    return rows.select("item_id", "title", "genres", "tags")


@query(
    "recommend_filtered", "R18 R19", O.sql(_sql_out(O.ranked("scored_v", 10, _FACET_SQL))),
)
def _(spark, d):
    keep = R.facet_filter(**FACETS)
    return recommended(R.recommend(C.model(spark, d), D.requests(spark, d), 10, keep=keep))


@query("has_reviews", "R20", O.sql("SELECT item_id, has_reviews FROM items_v"))
def _(spark, d):
    cat = D.catalog(spark, d)
    return cat.select("item_id", R.has_reviews(cat).alias("has_reviews"))


@query(
    "browse_order", "R21 C20",
    O.sql(
        "SELECT item_id, has_reviews, round(adj, 6) AS adjusted_ratio, release_year FROM (SELECT *, "
        "CASE WHEN positive_ratio <= 97 THEN positive_ratio ELSE 97 - (positive_ratio - 97) END AS adj FROM items_v "
        f"WHERE {_FACET_SQL}) ORDER BY has_reviews DESC, round(adj, 6) DESC, release_year DESC, catalog_pos LIMIT 50"
    ),
)
def _(spark, d):
    items = C.model(spark, d).items
    return R.browse(items, 50, R.facet_filter(**FACETS)).select(
        "item_id", "has_reviews", *_r("adjusted_ratio"), "release_year"
    )


@query(
    "intent_order", "R22",
    O.sql(_sql_out(O.ranked("scored_v", 10, "release_year >= 1990", by_reviews=True))),
)
def _(spark, d):
    keep = F.col("release_year") >= 1990
    return recommended(
        R.recommend(C.model(spark, d), D.requests(spark, d), 10, keep=keep, by_reviews=True)
    )


@query(
    "search", "R21 R22",
    O.sql(
        "SELECT request_id, CAST(rank AS INTEGER) AS rank, item_id, true AS by_intent, round(score, 6) AS score FROM ("
        f"{O.ranked('scored_v', 10, 'release_year >= 1990', by_reviews=True)}) WHERE request_id NOT IN ('none') "
        "UNION ALL SELECT 'none', CAST(row_number() OVER (ORDER BY has_reviews DESC, round(adj, 6) DESC, release_year DESC, catalog_pos) AS INTEGER) AS rank, "
        "item_id, false, NULL FROM (SELECT *, CASE WHEN positive_ratio <= 97 THEN positive_ratio ELSE 97 - (positive_ratio - 97) END AS adj "
        "FROM items_v WHERE release_year >= 1990) QUALIFY rank <= 10"
    ),
)
def _(spark, d):
    keep = F.col("release_year") >= 1990
    found = R.search(C.model(spark, d), D.requests(spark, d), 10, keep)
    return found.select("request_id", "rank", "item_id", "by_intent", *_r("score"))


CTES["cases_v"] = """
SELECT concat('case', CAST(b.item_id AS VARCHAR)) AS case_id, CASE WHEN b.item_id % 2 = 0 THEN b.text ELSE '' END AS query,
  CASE b.item_id % 4 WHEN 0 THEN [upper(p_name)] WHEN 1 THEN [substr(p_name, 2, 5)]
    WHEN 2 THEN ['nothing here', p_name] ELSE ['nothing', 'q'] END AS titles
FROM benchmark b JOIN part ON p_partkey = b.item_id
"""
CTES["resolved_v"] = f"""
SELECT case_id, arg_min(item_id, (no, part, catalog_pos)) AS item_id FROM (
  SELECT w.case_id, w.no, c.item_id, c.catalog_pos, CASE WHEN c.norm = w.wanted THEN 0 ELSE 1 END AS part
  FROM (SELECT case_id, i AS no, {O.ascii_norm('titles[i]')} AS wanted FROM
      (SELECT case_id, titles, unnest(range(1, len(titles) + 1)) AS i FROM cases_v)) w
  JOIN (SELECT item_id, catalog_pos, {O.ascii_norm('title')} AS norm FROM catalog_v) c ON contains(c.norm, w.wanted))
GROUP BY case_id
"""


def _cases(spark, d):
    bench = D.table(spark, d, "benchmark")
    part = D.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), "p_name")
    n, name = F.col("item_id") % 4, F.col("p_name")
    titles = (
        F.when(n == 0, F.array(F.upper(name)))
        .when(n == 1, F.array(F.substring(name, 2, 5)))
        .when(n == 2, F.array(F.lit("nothing here"), name))
        .otherwise(F.array(F.lit("nothing"), F.lit("q")))
    )
    return bench.join(part, "item_id").select(
        F.concat(F.lit("case"), F.col("item_id").cast("string")).alias("case_id"),
        F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise("").alias("query"),
        titles.alias("titles"),
    )


@query("resolve_titles", "R23", O.sql("SELECT case_id, item_id FROM resolved_v"))
def _(spark, d):
    rows = _cases(spark, d).select(
        "case_id", F.posexplode("titles").alias("candidate_no", "title")
    )
    return R.resolve_titles(rows, D.catalog(spark, d))


@query(
    "rank_of_target", "R24",
    O.sql(
        "SELECT request_id, CAST(coalesce(min(CASE WHEN regexp_matches(title, '(?i)BLUE (ring|bolt)') THEN rank END), -1) AS INTEGER) AS target_rank "
        f"FROM ({O.ranked('scored_v', 100)}) GROUP BY request_id"
    ),
)
def _(spark, d):
    model = C.model(spark, d)
    deep = R.recommend(model, D.requests(spark, d), 100)
    found = R.rank_of_target(deep, model.items, "BLUE (ring|bolt)")
    return found.fillna(-1, ["target_rank"])


@query(
    "compare_rankers", "R25",
    O.sql(
        "SELECT request_id, count(a.rank) FILTER (b.rank IS NOT NULL) AS shared, count(a.rank) AS n_a, count(b.rank) AS n_b, "
        "CAST(coalesce(max(abs(a.rank - b.rank)), -1) AS INTEGER) AS max_shift FROM rec_v a FULL JOIN "
        f"({O.ranked('scored_trial_v', 10)}) b USING (request_id, item_id) GROUP BY request_id"
    ),
)
def _(spark, d):
    reqs = D.requests(spark, d)
    plain = R.recommend(C.model(spark, d), reqs, 10)
    semantic = R.recommend(
        C.semantic_model(spark, d), reqs, 10, R.SEMANTIC_TRIAL_WEIGHTS,
        query_vectors=D.request_vectors(spark, d),
    )
    return R.compare_rankers(plain, semantic).fillna(-1, ["max_shift"])


# The same scoring SQL, asked with the cases as requests.
def _case_sql() -> str:
    text = O.sql(
        f"SELECT request_id, CAST(rank AS INTEGER) AS rank, item_id, {_sql_r(*SIGNALS)} "
        f"FROM ({O.ranked('scored_v', 5)})"
    )
    cases = (
        "SELECT case_id AS request_id, query, CASE WHEN item_id IS NULL THEN NULL ELSE [item_id] END AS reference_ids "
        "FROM cases_v LEFT JOIN resolved_v USING (case_id)"
    )
    return O.with_requests(text, cases, ("cases_v", "resolved_v"))


@query("run_cases", "R26", _case_sql())
def _(spark, d):
    return recommended(R.run_cases(C.model(spark, d), _cases(spark, d), D.catalog(spark, d), 5))
