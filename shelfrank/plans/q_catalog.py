"""Sources, sinks and catalogue building."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfrank.functions import text as X
from shelfrank.functions.lexicon import SHOP_BLOCKLIST, SHOP_PRIORITY
from shelfrank.operators import etl as E
from shelfrank.plans import fixtures as D
from shelfrank.plans import oracle as O
from shelfrank.plans.oracle import CTES
from shelfrank.plans.registry import query
from shelfrank.runtime import shared_dir
from shelfrank.sources import catalog_io as IO
from shelfrank.sources.catalog_job import run_catalog_job

CTES["raw_items_v"] = """
SELECT page_id AS catalog_pos, CASE WHEN page_id % 11 = 0 THEN '  ' ELSE p_name END AS name,
  CASE WHEN page_id % 6 = 0 THEN NULL ELSE round(CAST(page_id % 51 AS DOUBLE) / 10, 2) END AS rating,
  CASE WHEN page_id % 9 = 0 THEN NULL ELSE concat('released ', CAST(1890 + p_size * 3 AS VARCHAR), '-05') END AS released,
  CASE WHEN page_id % 8 = 0 THEN '<p>short</p>' ELSE html END AS description,
  p_type AS genres, CASE WHEN page_id % 4 = 0 THEN '' ELSE p_brand END AS tags,
  p_brand AS developers, CAST(NULL AS VARCHAR) AS publishers
FROM pages JOIN part ON p_partkey = page_id
"""
CTES["enrichment_v"] = """
SELECT item_id AS enrich_pos, p_name AS name, text AS summary FROM benchmark JOIN part ON p_partkey = item_id
"""
CTES["images_v"] = """
SELECT page_id AS image_pos, concat(upper(p_name), ' ') AS name, CAST(page_id AS VARCHAR) AS app_id,
  CASE WHEN page_id % 3 = 0 THEN NULL
    WHEN page_id % 3 = 1 THEN concat('https://img.example.com/steam/apps/', CAST(page_id AS VARCHAR), '/header.jpg')
    ELSE url END AS header_image
FROM pages JOIN part ON p_partkey = page_id
"""


def _draw(words, bucket, n):
    return (
        f"list_transform(list_sort(list_transform({O.str_list(words)}, "
        f"lambda dw: {{'h': md5(concat({bucket}, '|', dw)), 'w': dw}}))[1:{n}], lambda dw: dw.w)"
    )


def _keywords(ratio):
    b = f"CAST(CAST(floor({ratio} * 100) AS BIGINT) AS VARCHAR)"
    return (
        f"array_to_string(CASE WHEN {ratio} >= 80 THEN list_concat({_draw(D.REVIEW_WORDS.good, b, 2)}, {_draw(D.REVIEW_WORDS.mixed, b, 1)}) "
        f"WHEN {ratio} <= 40 THEN list_concat({_draw(D.REVIEW_WORDS.bad, b, 2)}, {_draw(D.REVIEW_WORDS.mixed, b, 1)}) "
        f"ELSE list_concat({_draw(D.REVIEW_WORDS.mixed, b, 2)}, {_draw(D.REVIEW_WORDS.good, b, 1)}) END, ', ')"
    )




def _clean_html(x):
    return O.strip_ws(f"regexp_replace(coalesce({x}, ''), '<.*?>', '', 'g')")


_year = (
    "coalesce(TRY_CAST(regexp_extract(coalesce(released, ''), '(?:19|20)[0-9]{2}', 0) AS INTEGER), 0)"
)
CTES["usable_v"] = f"""
SELECT md5(lower(title)) AS item_id, *, round(rating0 / 5 * 100, 2) AS positive_ratio,
  {_keywords('(rating0 / 5 * 100)')} AS review_keywords,
  concat('https://store.example/items/', replace(lower(title), ' ', '-')) AS url_store,
  concat('https://wiki.example/search?q=', replace(title, ' ', '+')) AS url_ref
FROM (SELECT catalog_pos, {O.strip_ws("coalesce(name, '')")} AS title, coalesce(rating, 0) AS rating0,
    {_year} AS release_year, {_clean_html('description')} AS description, genres, tags
  FROM raw_items_v)
WHERE title <> '' AND NOT (rating0 = 0 AND catalog_pos > 100) AND (length(description) >= 20 OR tags <> '')
"""
CTES["built_v"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY catalog_pos) AS rn FROM usable_v)
WHERE rn = 1
"""


def _built(spark, d):
    # The test source is small, so the position rule starts at 100 here.
    return E.build_catalog(D.raw_items(spark, d), D.REVIEW_WORDS, unrated_after=100)


_ROW = "item_id, title, genres, tags, md5(description) AS description_md5, release_year, positive_ratio, price, coalesce(developer, '') AS developer, review_keywords, sentiment_score"


def _row(df):
    return df.select(
        "item_id", "title", "genres", "tags", F.md5("description").alias("description_md5"),
        "release_year", "positive_ratio", "price", "developer", "review_keywords",
        "sentiment_score",
    )


@query("load_catalog", "S1", O.sql(f"SELECT {_ROW} FROM catalog_v"))
def _(spark, d):
    path = f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex[:8]}.csv"
    IO.write_catalog(D.catalog(spark, d), path, "csv")
    return _row(E.validate_contract(IO.load_catalog(spark, path)))


@query("write_catalog", "S2", O.sql(f"SELECT {_ROW} FROM catalog_v"))
def _(spark, d):
    path = f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex[:8]}"
    IO.write_catalog(D.catalog(spark, d), path)
    # reads and replaces the same place
    IO.write_catalog(E.validate_contract(IO.load_catalog(spark, path)), path)
    return _row(IO.load_catalog(spark, path))


@query(
    "source_tables", "S5",
    O.sql(
        "SELECT 'raw' AS source, count(*) AS n_rows, count(name) AS n_names FROM raw_items_v UNION ALL "
        "SELECT 'enrichment', count(*), count(name) FROM enrichment_v UNION ALL "
        "SELECT 'images', count(*), count(name) FROM images_v"
    ),
)
def _(spark, d):
    root = f"{shared_dir(spark)}/sources-{uuid.uuid4().hex[:8]}"
    wanted = {
        "raw": (D.raw_items, ["name", "rating", "released", "description", "genres", "tags", "developers", "publishers"]),
        "enrichment": (D.enrichment, ["name", "summary", "storyline", "rating"]),
        "images": (D.images, ["name", "appID", "header_image"]),
    }
    out = None
    for name, (make, columns) in wanted.items():
        make(spark, d).write.parquet(f"{root}/{name}")
        part = IO.read_table(spark, f"{root}/{name}", columns).agg(
            F.lit(name).alias("source"), F.count("*").alias("n_rows"), F.count("name").alias("n_names")
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "clean_html", "E1",
    f"SELECT page_id, md5(t) AS text_md5, CAST(length(t) AS INTEGER) AS n_chars FROM (SELECT page_id, {_clean_html('html')} AS t FROM pages)",
)
def _(spark, d):
    clean = D.table(spark, d, "pages").select("page_id", X.clean_html(F.col("html")).alias("t"))
    return clean.select("page_id", F.md5("t").alias("text_md5"), F.length("t").alias("n_chars"))


@query(
    "rating_to_ratio", "E2",
    O.sql("SELECT catalog_pos, round(coalesce(rating, 0) / 5 * 100, 2) AS positive_ratio FROM raw_items_v"),
)
def _(spark, d):
    return D.raw_items(spark, d).select(
        "catalog_pos", E.rating_to_ratio(F.col("rating")).alias("positive_ratio")
    )


@query("extract_year", "E3", O.sql(f"SELECT catalog_pos, {_year} AS release_year FROM raw_items_v"))
def _(spark, d):
    return D.raw_items(spark, d).select(
        "catalog_pos", E.extract_year(F.col("released")).alias("release_year")
    )


@query("usable_items", "E4", O.sql("SELECT catalog_pos, title, md5(description) AS description_md5, positive_ratio, release_year FROM usable_v"))
def _(spark, d):
    return E.clean_raw_items(D.raw_items(spark, d), D.REVIEW_WORDS, unrated_after=100).select(
        "catalog_pos", "title", F.md5("description").alias("description_md5"), "positive_ratio", "release_year"
    )


@query("stable_item_id", "E5", O.sql("SELECT catalog_pos, md5(lower(title)) AS item_id FROM catalog_v"))
def _(spark, d):
    return D.catalog(spark, d).select(
        "catalog_pos", E.stable_item_id(F.col("title")).alias("item_id")
    )


@query(
    "derive_urls", "E6",
    O.sql("SELECT catalog_pos, url_store, url_ref FROM usable_v"),
)
def _(spark, d):
    return E.clean_raw_items(D.raw_items(spark, d), D.REVIEW_WORDS, unrated_after=100).select(
        "catalog_pos", "url_store", "url_ref"
    )


@query(
    "synthetic_review_keywords", "E7",
    O.sql(f"SELECT item_id, {_keywords('positive_ratio')} AS words FROM catalog_v"),
)
def _(spark, d):
    return D.catalog(spark, d).select(
        "item_id", E.synthetic_review_keywords(F.col("positive_ratio"), D.REVIEW_WORDS).alias("words")
    )


@query(
    "dedupe_keep_first", "E8",
    O.sql(
        "SELECT title, item_id, catalog_pos FROM (SELECT *, row_number() OVER (PARTITION BY title "
        "ORDER BY catalog_pos) AS rn FROM catalog_v) WHERE rn = 1"
    ),
)
def _(spark, d):
    rows = D.catalog(spark, d).select("title", "item_id", "catalog_pos")
    return E.keep_first(rows, ["title"], [F.col("catalog_pos")])


@query(
    "top_k_by_quality", "E9",
    O.sql("SELECT item_id, positive_ratio, release_year FROM catalog_v ORDER BY positive_ratio DESC, release_year DESC, item_id LIMIT 400"),
)
def _(spark, d):
    return E.top_k_by_quality(D.catalog(spark, d), 400).select(
        "item_id", "positive_ratio", "release_year"
    )


@query(
    "build_catalog", "E1 E2 E3 E4 E5 E6 E7 E8 E9",
    O.sql("SELECT item_id, catalog_pos, title, release_year, positive_ratio, review_keywords, url_store FROM built_v"),
)
def _(spark, d):
    return _built(spark, d).select(
        "item_id", "catalog_pos", "title", "release_year", "positive_ratio", "review_keywords", "url_store"
    )


_longer = (
    "CASE WHEN length(c.description) < 100 AND length(coalesce(e.summary, '')) > 100 "
    "THEN e.summary ELSE c.description END"
)


@query(
    "merge_enrichment", "E10 E11",
    O.sql(
        f"SELECT c.item_id, c.title, md5({_longer}) AS description_md5 FROM catalog_v c LEFT JOIN ("
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY enrich_pos) AS rn FROM enrichment_v) WHERE rn = 1) e "
        "ON e.name = c.title"
    ),
)
def _(spark, d):
    merged = E.merge_enrichment(D.catalog(spark, d), D.enrichment(spark, d))
    return merged.select("item_id", "title", F.md5("description").alias("description_md5"))


@query(
    "prefer_longer_text", "E11",
    "SELECT d.doc_id, md5(CASE WHEN length(d.text) < 100 AND length(b.text) > 100 THEN b.text ELSE d.text END) AS text_md5 "
    "FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)",
)
def _(spark, d):
    docs = D.table(spark, d, "documents")
    bench = D.table(spark, d, "benchmark").select("item_id", F.col("text").alias("other"))
    size = bench.agg(F.count("*")).scalar()
    joined = docs.withColumn("item_id", F.col("doc_id") % size).join(bench, "item_id")
    return joined.select(
        "doc_id", F.md5(E.prefer_longer_text(F.col("text"), F.col("other"))).alias("text_md5")
    )


CTES["imaged_v"] = f"""
SELECT c.*, i.app_id, coalesce(i.header_image, {O.q(E.PLACEHOLDER_IMAGE)}) AS header_image FROM catalog_v c LEFT JOIN (
  SELECT * FROM (SELECT {O.strip_ws('lower(name)')} AS key, *, row_number() OVER (
    PARTITION BY {O.strip_ws('lower(name)')} ORDER BY image_pos) AS rn FROM images_v) WHERE rn = 1) i
ON i.key = {O.strip_ws('lower(c.title)')}
"""


@query(
    "left_join_normalised_title", "E12 E13",
    O.sql("SELECT item_id, title, app_id, header_image FROM imaged_v"),
)
def _(spark, d):
    return E.add_images(D.catalog(spark, d), D.images(spark, d)).select(
        "item_id", "title", "app_id", "header_image"
    )


@query(
    "fill_default_image", "E13",
    O.sql(f"SELECT image_pos, coalesce(header_image, {O.q(E.PLACEHOLDER_IMAGE)}) AS header_image FROM images_v"),
)
def _(spark, d):
    return D.images(spark, d).select(
        "image_pos", E.fill_default_image(F.col("header_image")).alias("header_image")
    )


_blocked = " OR ".join(
    f"contains(lower(concat_ws(' ', title, genres, tags)), {O.q(w.lower())})" for w in SHOP_BLOCKLIST
)


@query("blocklist_filter", "E14", O.sql(f"SELECT item_id, title, tags FROM catalog_v WHERE NOT ({_blocked})"))
def _(spark, d):
    return E.blocklist_filter(D.catalog(spark, d), SHOP_BLOCKLIST).select("item_id", "title", "tags")


_priority = " OR ".join(f"contains(lower(title), {O.q(n.lower())})" for n in SHOP_PRIORITY)


@query(
    "priority_flag", "E15",
    O.sql(f"SELECT item_id, CASE WHEN {_priority} THEN 1 ELSE 0 END AS is_priority, positive_ratio FROM catalog_v"),
)
def _(spark, d):
    return E.order_by_priority(D.catalog(spark, d), SHOP_PRIORITY).select(
        "item_id", "is_priority", "positive_ratio"
    )


def _sql_url(raw, app):
    own = f"CASE WHEN contains(lower({raw}), 'placeholder.com') THEN '' ELSE {raw} END"
    prefix, suffix = E.APP_IMAGE_URL
    number = f"TRY_CAST(TRY_CAST(TRY_CAST({app} AS DOUBLE) AS BIGINT) AS VARCHAR)"
    return (
        f"CASE WHEN regexp_extract({own}, '/steam/apps/([0-9]+)/', 1) <> '' THEN concat('{prefix}', "
        f"CAST(CAST(regexp_extract({own}, '/steam/apps/([0-9]+)/', 1) AS BIGINT) AS VARCHAR), '{suffix}') "
        f"WHEN regexp_matches({own}, '^(?i:https?)://[^/?#]') THEN {own} "
        f"ELSE coalesce('{prefix}' || {number} || '{suffix}', '') END"
    )


@query(
    "validate_contract", "E16",
    O.sql(
        f"SELECT {_ROW}, app_id, header_image, {_sql_url('header_image', 'app_id')} <> '' AS has_cover_image FROM ("
        "SELECT * EXCLUDE (app_id, header_image, release_year, positive_ratio), coalesce(app_id, '') AS app_id, header_image, "
        "coalesce(TRY_CAST(CASE WHEN catalog_pos % 10 = 0 THEN 'soon' ELSE CAST(release_year AS VARCHAR) END AS INTEGER), 0) AS release_year, "
        "CASE WHEN catalog_pos % 7 = 0 THEN 0 ELSE least(greatest(positive_ratio * 2 - 40, 0), 100) END AS positive_ratio FROM imaged_v)"
    ),
)
def _(spark, d):
    rough = E.add_images(D.catalog(spark, d), D.images(spark, d)).withColumns(
        {
            "release_year": F.when(F.col("catalog_pos") % 10 == 0, "soon").otherwise(
                F.col("release_year").cast("string")
            ),
            "positive_ratio": F.when(F.col("catalog_pos") % 7 == 0, float("nan")).otherwise(
                F.col("positive_ratio") * 2 - 40
            ),
            "left_over": F.lit(1),
        }
    )
    clean = E.validate_contract(rough)
    return clean.select(
        *_row(clean).columns[:4], F.md5("description").alias("description_md5"),
        *_row(clean).columns[5:], "app_id", "header_image", "has_cover_image",
    )


@query(
    "resolve_image_url", "E17",
    O.sql(f"SELECT item_id, {_sql_url('header_image', 'app_id')} AS image_url FROM imaged_v"),
)
def _(spark, d):
    rows = E.add_images(D.catalog(spark, d), D.images(spark, d))
    url = E.resolve_image_url(F.col("header_image"), F.col("app_id"))
    return rows.select("item_id", url.alias("image_url"))


@query(
    "finish_catalog", "E8 E12 E13 E14 E15",
    O.sql(
        "SELECT *, row_number() OVER (ORDER BY is_priority DESC, positive_ratio DESC, old_pos) - 1 AS catalog_pos FROM ("
        f"SELECT item_id, title, header_image, CASE WHEN {_priority} THEN 1 ELSE 0 END AS is_priority, positive_ratio, catalog_pos AS old_pos "
        f"FROM imaged_v WHERE NOT ({_blocked}))"
    ),
)
def _(spark, d):
    done = E.finish_catalog(
        D.catalog(spark, d), D.images(spark, d), SHOP_BLOCKLIST, SHOP_PRIORITY
    )
    old = D.catalog(spark, d).select("item_id", F.col("catalog_pos").alias("old_pos"))
    return done.join(old, "item_id").select(
        "item_id", "title", "header_image", "is_priority", "positive_ratio", "old_pos", "catalog_pos"
    )


# The words blocked and the names put first are those of the raw items here.
_JOB_BLOCK, _JOB_FIRST = ["promo", "tin"], ["blue", "almond"]
_job_blocked = " OR ".join(f"contains(lower(concat_ws(' ', title, genres, tags)), {O.q(w)})" for w in _JOB_BLOCK)
_job_first = " OR ".join(f"contains(lower(title), {O.q(w)})" for w in _JOB_FIRST)


@query(
    "catalog_job", "E1 E2 E3 E4 E5 E6 E7 E8 E9 E10 E11 E12 E13 E14 E15 E16 S2",
    O.sql(
        "SELECT item_id, title, genres, tags, md5(description) AS description_md5, release_year, positive_ratio, "
        "coalesce(app_id, '') AS app_id, header_image, "
        f"{_sql_url('header_image', 'app_id')} <> '' AS has_cover_image, "
        "row_number() OVER (ORDER BY first DESC, positive_ratio DESC, old_pos) - 1 AS catalog_pos FROM ("
        f"SELECT c.item_id, c.title, c.genres, c.tags, {_longer} AS description, c.release_year, c.positive_ratio, "
        f"i.app_id, coalesce(i.header_image, {O.q(E.PLACEHOLDER_IMAGE)}) AS header_image, c.catalog_pos AS old_pos, "
        f"CASE WHEN {_job_first.replace('title', 'c.title')} THEN 1 ELSE 0 END AS first FROM built_v c "
        "LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY enrich_pos) AS rn FROM enrichment_v) WHERE rn = 1) e "
        "ON e.name = c.title "
        f"LEFT JOIN (SELECT * FROM (SELECT {O.strip_ws('lower(name)')} AS key, *, row_number() OVER ("
        f"PARTITION BY {O.strip_ws('lower(name)')} ORDER BY image_pos) AS rn FROM images_v) WHERE rn = 1) i "
        f"ON i.key = {O.strip_ws('lower(c.title)')} WHERE NOT ({_job_blocked.replace('title, genres, tags', 'c.title, c.genres, c.tags')})) "
    ),
)
def _(spark, d):
    path = f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex[:8]}"
    done = run_catalog_job(
        D.raw_items(spark, d), D.enrichment(spark, d), D.images(spark, d), path,
        D.REVIEW_WORDS, _JOB_BLOCK, _JOB_FIRST, unrated_after=100,
    )
    return done.select(
        "item_id", "title", "genres", "tags", F.md5("description").alias("description_md5"),
        "release_year", "positive_ratio", "app_id", "header_image", "has_cover_image", "catalog_pos",
    )
