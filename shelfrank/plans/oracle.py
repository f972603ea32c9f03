"""SQL twins of the registered queries: shared CTEs and a small composer.

``sql(final)`` puts the CTEs that ``final`` names (and those they name) in front.
The SQL is written independently of the DataFrame code: brute force where the
Spark plan prunes.
"""

from __future__ import annotations

import re

from shelfrank.functions.lexicon import SHOP
from shelfrank.functions.text import WS, fold

CTES: dict[str, str] = {}


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return strip_ws(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def collapse_lower(x: str) -> str:
    return collapse(f"lower({x})")


def ascii_norm(x: str) -> str:
    return collapse(f"lower(regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g'))")


def split_raw(x: str, seps: str = "[,|;/]") -> str:
    return (
        f"list_filter(list_transform(regexp_split_to_array(coalesce({x}, ''), '{seps}'), "
        f"lambda sr: {strip_ws('sr')}), lambda sr: sr <> '')"
    )


def split_terms(x: str) -> str:
    """Distinct terms by lower case then exact text, via a sorted list of pairs."""
    return (
        f"list_transform(list_sort(list_transform(list_distinct({split_raw(x)}), "
        "lambda st: {'l': lower(st), 't': st})), lambda st: st.t)"
    )


def tag_key(x: str) -> str:
    return collapse(f"regexp_replace(lower(strip_accents({x})), '[-_/]+', ' ', 'g')")


def unicode_borders(pattern: str) -> str:
    r"""RE2's \b knows ASCII only; outer word borders spelled out."""
    outside = "[^\\p{L}\\p{N}_]"
    if pattern.startswith(r"\b"):
        pattern = f"(?:^|{outside})" + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + f"(?:$|{outside})"
    return pattern


def labels(text: str, rules: dict[str, list[str]], borders=lambda p: p) -> str:
    cases = []
    for label, patterns in rules.items():
        alternatives = "|".join(f"(?:{borders(p)})" for p in patterns)
        cases.append(f"CASE WHEN regexp_matches({text}, {q(alternatives)}) THEN {q(label)} END")
    return f"list_filter([{', '.join(cases)}], lambda lb: lb IS NOT NULL)"


def str_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def combos(lbl: str) -> str:
    parts = [
        f"CASE WHEN list_contains({lbl}, {q(need)}) AND list_has_any({lbl}, {str_list(any_of)}) "
        f"THEN {str_list(extra)} ELSE [] END"
        for need, any_of, extra in SHOP.hint_combos
    ]
    return f"flatten([{', '.join(parts)}])"


STOP = in_list(SHOP.index_stop_words)


def tokenize(x: str) -> str:
    found = f"regexp_extract_all(strip_accents(lower({x})), '[\\p{{L}}\\p{{N}}_]{{2,}}')"
    return f"list_filter({found}, lambda tk: tk NOT IN {STOP})"


def grams12(toks: str) -> str:
    return (
        f"list_concat({toks}, list_transform(range(1, len({toks})), "
        f"lambda gi: {toks}[gi] || ' ' || {toks}[gi + 1]))"
    )


def query_tokens(x: str) -> str:
    return f"regexp_extract_all(lower(strip_accents({x})), '[a-z0-9]+')"


def expand_query(x: str) -> str:
    mapped = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in SHOP.expansions.items())
    return (
        f"array_to_string(flatten(list_transform({query_tokens(x)}, lambda et: list_filter(["
        "et, CASE WHEN ends_with(et, 's') AND length(et) > 3 THEN left(et, length(et) - 1) END, "
        f"CASE et {mapped} END], lambda ev: ev IS NOT NULL))), ' ')"
    )


def query_concepts(x: str) -> str:
    mapped = " ".join(
        f"WHEN {q(k)} THEN {str_list(sorted({fold(v) for v in vs}))}"
        for k, vs in SHOP.concepts.items()
    )
    own = (
        "list_sort(list_distinct([CASE WHEN ends_with(ct, 's') AND length(ct) > 3 "
        "THEN left(ct, length(ct) - 1) ELSE ct END, ct]))"
    )
    return (
        f"list_transform(list_filter({query_tokens(x)}, lambda ct: ct NOT IN "
        f"{in_list(SHOP.query_stop_words)}), lambda ct: CASE ct {mapped} ELSE {own} END)"
    )


def sql(final: str) -> str:
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit_one(name)

    def visit_one(name: str) -> None:
        visit(CTES[name])
        if name not in needed:
            needed.append(name)

    visit(final)
    if not needed:
        return final
    body = ",\n".join(f"{n} AS MATERIALIZED (\n{CTES[n]}\n)" for n in needed)
    return f"WITH {body}\n{final}"


# ---------------------------------------------------------------- derived views

CTES["catalog_v"] = """
SELECT CAST(d.doc_id AS VARCHAR) AS item_id, d.doc_id AS catalog_pos, p.p_name AS title,
  concat(p.p_type, ', ', d.lang) AS genres,
  concat(p.p_brand, '|', d.source, '; ', coalesce(r.mode_tag, '')) AS tags,
  d.text AS description,
  CASE WHEN p.p_size % 10 = 0 THEN 0 ELSE 1975 + p.p_size END AS release_year,
  coalesce(r.positive_ratio, CAST(0 AS DOUBLE)) AS positive_ratio,
  CASE WHEN p.p_partkey % 7 = 0 THEN CAST(0 AS DOUBLE) ELSE p.p_retailprice END AS price,
  s.s_name AS developer,
  CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE coalesce(e.kw, '') END AS review_keywords,
  CAST(l.quality - l.toxic AS DOUBLE) AS sentiment_score
FROM documents d JOIN part p ON p.p_partkey = d.doc_id
LEFT JOIN (SELECT l_partkey,
    round(100 * avg(CASE WHEN l_returnflag <> 'R' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 2) AS positive_ratio,
    min(l_suppkey) AS suppkey,
    CASE WHEN count(*) >= 30 THEN 'popular' ELSE 'steam cloud' END AS mode_tag
  FROM lineitem GROUP BY l_partkey) r ON r.l_partkey = d.doc_id
LEFT JOIN supplier s ON s.s_suppkey = r.suppkey
LEFT JOIN (SELECT user_id, concat(min(event_type), ', ', max(event_type)) AS kw
  FROM events WHERE value > 100 GROUP BY user_id) e ON e.user_id = d.doc_id % 150
LEFT JOIN labels l ON l.doc_id = d.doc_id
"""

CTES["requests_v"] = """
SELECT concat('b', CAST(item_id AS VARCHAR)) AS request_id,
  CASE WHEN item_id % 3 = 1 THEN '' ELSE text END AS query,
  CASE WHEN item_id % 3 = 0 THEN NULL
       ELSE [CAST(item_id AS VARCHAR), CAST(item_id + 1 AS VARCHAR)] END AS reference_ids
FROM benchmark
UNION ALL SELECT 'none', '', NULL
UNION ALL SELECT 'unknown', '', ['-1']
UNION ALL SELECT 'dup', '', ['3', '3', '7']
"""

CTES["text_requests_v"] = """
SELECT concat('t', CAST(item_id AS VARCHAR)) AS request_id, text AS query,
  CAST(NULL AS VARCHAR[]) AS reference_ids FROM benchmark
"""

_hint_src = (
    "lower(strip_accents(concat_ws(' ', coalesce(title, ''), coalesce(genres, ''), "
    "coalesce(tags, ''), coalesce(description, ''))))"
)
_noise = in_list(SHOP.noisy_tags)
CTES["features_v"] = f"""
SELECT item_id, title, genres, description, review_keywords,
  array_to_string(list_filter({split_raw('tags')}, lambda ft: {tag_key('ft')} NOT IN {_noise}), ' ') AS tags_clean,
  array_to_string(list_concat(lbls, {combos('lbls')}), ' ') AS semantic_hints
FROM (SELECT *, {labels('hint_src', SHOP.hint_rules)} AS lbls
      FROM (SELECT *, {_hint_src} AS hint_src FROM catalog_v))
"""

CTES["corpus_content_v"] = """
SELECT item_id, concat(title, ' ', repeat(concat(genres, ' '), 5), repeat(concat(tags_clean, ' '), 9),
  repeat(concat(semantic_hints, ' '), 8), description) AS corpus FROM features_v
"""
CTES["corpus_opinion_v"] = """
SELECT item_id, concat(title, ' ', repeat(concat(genres, ' '), 2), repeat(concat(tags_clean, ' '), 2),
  repeat(concat(semantic_hints, ' '), 3), description, ' ', repeat(concat(review_keywords, ' '), 5)) AS corpus
FROM features_v
"""
CTES["stats_v"] = """
SELECT count(*) AS n_items, median(sentiment_score) AS med, min(coalesce(sentiment_score, m)) AS lo,
  max(coalesce(sentiment_score, m)) AS hi
FROM (SELECT *, (SELECT median(sentiment_score) FROM catalog_v) AS m FROM catalog_v)
"""
for _k in ("content", "opinion"):
    CTES[f"tf_{_k}_v"] = f"""
SELECT item_id, term, count(*) AS tf FROM (
  SELECT item_id, unnest({grams12('toks')}) AS term
  FROM (SELECT item_id, {tokenize('corpus')} AS toks FROM corpus_{_k}_v))
GROUP BY item_id, term
"""
    CTES[f"vocab_{_k}_v"] = f"""
SELECT term, df, ctf, ln((1.0::DOUBLE + (SELECT n_items FROM stats_v)) / (1.0::DOUBLE + df)) + 1.0::DOUBLE AS idf
FROM (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS ctf FROM tf_{_k}_v GROUP BY term
      ORDER BY ctf DESC, term LIMIT 30000)
"""
    CTES[f"index_{_k}_v"] = f"""
SELECT item_id, term, tf, x / sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS w
FROM (SELECT t.item_id, t.term, t.tf, t.tf * v.idf AS x FROM tf_{_k}_v t JOIN vocab_{_k}_v v USING (term))
"""


def query_vec(requests: str, kind: str) -> str:
    return f"""
SELECT request_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY request_id)) AS qw FROM (
  SELECT request_id, term, count(*) * max(v.idf) AS x FROM (
    SELECT request_id, unnest({grams12('toks')}) AS term FROM (
      SELECT request_id, {tokenize(expand_query('query'))} AS toks FROM {requests}
      WHERE {strip_ws('query')} <> ''))
  JOIN vocab_{kind}_v v USING (term) GROUP BY request_id, term)
"""


for _k in ("content", "opinion"):
    CTES[f"qv_{_k}_v"] = query_vec("requests_v", _k)
    CTES[f"tqv_{_k}_v"] = query_vec("text_requests_v", _k)
    CTES[f"text_{_k}_v"] = f"""
SELECT request_id, item_id, sum(qw * w) AS s FROM tqv_{_k}_v JOIN index_{_k}_v USING (term) GROUP BY 1, 2
"""
    CTES[f"match_{_k}_v"] = f"""
SELECT request_id, item_id, sum(qw * w) AS s FROM qv_{_k}_v JOIN index_{_k}_v USING (term) GROUP BY 1, 2
"""

CTES["refs_v"] = "SELECT request_id, unnest(reference_ids) AS item_id FROM requests_v"
CTES["centroid_v"] = """
SELECT request_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY request_id)) AS qw FROM (
  SELECT request_id, term, sum(w) / max(n) AS x
  FROM refs_v JOIN index_content_v USING (item_id)
  JOIN (SELECT request_id, count(*) AS n FROM refs_v JOIN catalog_v USING (item_id) GROUP BY 1) USING (request_id)
  GROUP BY 1, 2)
"""
CTES["ref_scores_v"] = """
SELECT request_id, item_id, sum(qw * w) AS s FROM centroid_v JOIN index_content_v USING (term)
WHERE (request_id, item_id) NOT IN (SELECT request_id, item_id FROM refs_v) GROUP BY 1, 2
"""
CTES["items_v"] = f"""
SELECT *, pop AS popularity_score, {'{sent}'} AS sentiment_score_normalized,
  greatest(least(CAST(0.55 AS DOUBLE) * pop + CAST(0.45 AS DOUBLE) * {'{sent}'}, 1), 0) AS quality_score
FROM (SELECT c.*, {strip_ws("coalesce(review_keywords, '')")} <> '' AS has_reviews,
  greatest(least(positive_ratio / 100, CAST(1 AS DOUBLE)), CAST(0 AS DOUBLE)) AS pop,
  lower(strip_accents(concat_ws(' ', title, genres, tags, description, review_keywords))) AS searchable,
  coalesce(sentiment_score, med) AS fs, lo, hi FROM catalog_v c, stats_v)
""".replace(
    "{sent}",
    "greatest(least(CASE WHEN lo < 0 AND hi <= 1 THEN (fs + 1) / 2 "
    "WHEN hi > 1 THEN fs / (CASE WHEN hi <= 5 THEN 5.0::DOUBLE ELSE 100.0::DOUBLE END) ELSE fs END, 1), 0)",
)
CTES["req_v"] = f"""
SELECT request_id, query, coalesce(len(reference_ids), 0) > 0 AS has_references,
  {strip_ws('query')} <> '' AS has_query, {query_concepts('query')} AS concepts FROM requests_v
"""


def weights_cte(content=0.5, semantic=0.25, opinion=0.15, quality=0.10, active=False) -> str:
    w = {"content": content, "semantic": semantic, "opinion": opinion, "quality": quality}
    w = {k: f"CAST({v} AS DOUBLE)" for k, v in w.items()}
    sem = f"CASE WHEN has_references OR has_query THEN {w['semantic']} ELSE 0 END" if active else "0"
    return f"""
SELECT *, CASE WHEN idle THEN 0 ELSE rc / tot END AS weight_content,
  CASE WHEN idle THEN 0 ELSE rs / tot END AS weight_semantic,
  CASE WHEN idle THEN 0 ELSE ro / tot END AS weight_opinion,
  CASE WHEN idle THEN 1 ELSE rq / tot END AS weight_quality
FROM (SELECT *, rc + rs + ro + rq AS tot, rc + rs + ro = 0 AS idle FROM (
  SELECT *, CASE WHEN has_references THEN {w['content']} ELSE 0 END AS rc,
    CAST({sem} AS DOUBLE) AS rs,
    CASE WHEN has_query THEN {w['opinion']} ELSE 0 END AS ro, {w['quality']} AS rq FROM req_v))
"""


CTES["weights_v"] = weights_cte()
CTES["weights_sem_v"] = weights_cte(active=True)
CTES["weights_trial_v"] = weights_cte(0.35, 0.35, 0.15, 0.15, active=True)

# Embeddings: query vector of request b<i> is vector i, liked items average.
CTES["ivec_v"] = "SELECT CAST(vec_id AS VARCHAR) AS item_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
CTES["cvec_v"] = """
SELECT request_id, list(x / CASE WHEN nrm > 0 THEN nrm ELSE 1 END ORDER BY i) AS v FROM (
  SELECT *, sqrt(sum(x * x) OVER (PARTITION BY request_id)) AS nrm FROM (
    SELECT request_id, i, avg(v[i]) AS x
    FROM refs_v JOIN ivec_v USING (item_id), generate_series(1, 64) AS g(i) GROUP BY 1, 2))
GROUP BY request_id
"""
CTES["rvec_v"] = """
SELECT r.request_id, CASE WHEN r.has_references THEN c.v WHEN r.has_query THEN b.v END AS v
FROM req_v r LEFT JOIN cvec_v c USING (request_id)
LEFT JOIN (SELECT concat('b', item_id) AS request_id, v FROM ivec_v
           WHERE CAST(item_id AS BIGINT) IN (SELECT item_id FROM benchmark)) b USING (request_id)
"""
CTES["sem_v"] = """
SELECT request_id, item_id, CASE WHEN (request_id, item_id) IN (SELECT request_id, item_id FROM refs_v)
  THEN 0 ELSE list_dot_product(r.v, i.v) END AS s
FROM rvec_v r, ivec_v i WHERE r.v IS NOT NULL
"""


def scored_cte(weights: str, semantic: bool) -> str:
    """Brute force: every request with every item."""
    sem = "coalesce(m.s, 0)" if semantic else "CAST(0 AS DOUBLE)"
    join = "LEFT JOIN sem_v m ON m.request_id = r.request_id AND m.item_id = i.item_id" if semantic else ""
    return f"""
SELECT *, content_score * weight_content + semantic_score * weight_semantic
  + opinion_score * weight_opinion + quality_score * weight_quality AS score
FROM (SELECT *, CASE WHEN has_query THEN opinion_raw * (CAST(0.35 AS DOUBLE) + CAST(0.65 AS DOUBLE) * query_coverage_score)
        ELSE opinion_raw END AS opinion_score
  FROM (SELECT r.request_id, r.has_query, r.has_references, i.item_id, i.title, i.genres, i.tags, i.review_keywords, i.developer, i.price,
      i.catalog_pos, i.release_year, i.positive_ratio, i.has_reviews, i.popularity_score,
      i.sentiment_score_normalized, i.quality_score, r.weight_content, r.weight_semantic,
      r.weight_opinion, r.weight_quality,
      coalesce(c.s, 0) AS content_score, coalesce(o.s, 0) AS opinion_raw, {sem} AS semantic_score,
      CASE WHEN len(concepts) > 0 THEN len(list_filter(concepts, lambda vs: len(list_filter(vs, lambda v: contains(i.searchable, v))) > 0))
        / CAST(len(concepts) AS DOUBLE) ELSE 0 END AS query_coverage_score
    FROM {weights} r CROSS JOIN items_v i
    LEFT JOIN ref_scores_v c ON c.request_id = r.request_id AND c.item_id = i.item_id
    LEFT JOIN match_opinion_v o ON o.request_id = r.request_id AND o.item_id = i.item_id
    {join}))
"""


CTES["scored_v"] = scored_cte("weights_v", False)
CTES["scored_sem_v"] = scored_cte("weights_sem_v", True)
CTES["scored_trial_v"] = scored_cte("weights_trial_v", True)


def ranked(scored: str, k: int, where: str = "TRUE", by_reviews: bool = False) -> str:
    reviews = "has_reviews DESC, " if by_reviews else ""
    return f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 9) DESC, {reviews}
  positive_ratio DESC, release_year DESC, catalog_pos) AS rank FROM {scored} WHERE {where}) WHERE rank <= {k}
"""


CTES["rec_v"] = ranked("scored_v", 10)


def with_requests(text: str, requests: str, before: tuple[str, ...]) -> str:
    """A composed query with another request table in place of ``requests_v``."""
    old = f"requests_v AS MATERIALIZED (\n{CTES['requests_v']}\n)"
    assert old in text
    extra = [n for n in before if f"{n} AS MATERIALIZED" not in text]
    new = ",\n".join(f"{n} AS MATERIALIZED (\n{CTES[n]}\n)" for n in extra)
    body = text.replace(old, f"{new},\nrequests_v AS MATERIALIZED (\n{requests}\n)")
    catalog = f"catalog_v AS MATERIALIZED (\n{CTES['catalog_v']}\n)"
    # the cases read the catalogue, so it comes first
    body = body.replace(catalog + ",\n", "")
    return body.replace("WITH ", f"WITH {catalog},\n", 1)
