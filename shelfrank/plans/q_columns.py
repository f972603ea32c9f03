"""Column functions over the whole catalogue, pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfrank.functions import labels as L
from shelfrank.functions import text as X
from shelfrank.functions.lexicon import SHOP, SHOP_TAG_RULES
from shelfrank.operators import index as I
from shelfrank.operators import ranking as R
from shelfrank.operators import scoring as S
from shelfrank.operators import semantic as V
from shelfrank.plans import fixtures as D
from shelfrank.plans import oracle as O
from shelfrank.plans.registry import query


def _digest(col):
    return F.md5(col)


@query(
    "strip_accents", "C1",
    O.sql("SELECT item_id, md5(strip_accents(description)) AS plain FROM catalog_v"),
)
def _(spark, d):
    return D.catalog(spark, d).select(
        "item_id", _digest(X.strip_accents(F.col("description"))).alias("plain")
    )


@query(
    "ascii_normalise", "C2",
    O.sql(f"SELECT item_id, md5({O.ascii_norm('description')}) AS plain FROM catalog_v"),
)
def _(spark, d):
    return D.catalog(spark, d).select(
        "item_id", _digest(X.ascii_normalise(F.col("description"))).alias("plain")
    )


@query(
    "collapse_lower", "C3",
    O.sql(f"SELECT item_id, md5({O.collapse_lower('description')}) AS plain FROM catalog_v"),
)
def _(spark, d):
    return D.catalog(spark, d).select(
        "item_id", _digest(X.collapse_lower(F.col("description"))).alias("plain")
    )


@query(
    "split_terms", "C4",
    O.sql(
        "SELECT item_id, array_to_string("
        + O.split_terms("concat(genres, ', ', tags, ',', review_keywords, '/', title, '|', title)")
        + ", '|') AS terms FROM catalog_v"
    ),
)
def _(spark, d):
    joined = F.concat(
        "genres", F.lit(", "), "tags", F.lit(","), "review_keywords", F.lit("/"), "title",
        F.lit("|"), "title",
    )
    return D.catalog(spark, d).select(
        "item_id", F.array_join(X.split_terms(joined), "|").alias("terms")
    )


@query(
    "ordered_terms", "C5",
    O.sql(
        "SELECT item_id, array_to_string(("
        + O.split_raw("concat(tags, '/x; ', genres, ',', title)", "[,|;]")
        + ")[1:4], '|') AS terms FROM catalog_v"
    ),
)
def _(spark, d):
    joined = F.concat("tags", F.lit("/x; "), "genres", F.lit(","), "title")
    return D.catalog(spark, d).select(
        "item_id", F.array_join(X.ordered_terms(joined, 4), "|").alias("terms")
    )


@query("clean_tags", "C6", O.sql("SELECT item_id, tags_clean FROM features_v"))
def _(spark, d):
    return D.catalog(spark, d).select(
        "item_id", X.clean_tags(F.col("tags"), SHOP.noisy_tags).alias("tags_clean")
    )


@query(
    "infer_hints", "C7",
    O.sql(
        f"SELECT item_id, array_to_string({O.labels('hint_src', SHOP.hint_rules)}, '|') AS hints "
        f"FROM (SELECT *, {O._hint_src} AS hint_src FROM catalog_v)"
    ),
)
def _(spark, d):
    cat = D.catalog(spark, d)
    text = cat.select(
        "item_id",
        X.hint_text(*[F.col(c) for c in ("title", "genres", "tags", "description")]).alias("t"),
    )
    return text.select(
        "item_id", F.array_join(X.rule_labels(F.col("t"), SHOP.hint_rules), "|").alias("hints")
    )


@query("combo_hints", "C8", O.sql("SELECT item_id, semantic_hints FROM features_v"))
def _(spark, d):
    return I.text_features(D.catalog(spark, d), SHOP).select("item_id", "semantic_hints")


@query(
    "weighted_corpus", "C9",
    O.sql(
        "SELECT item_id, md5(c.corpus) AS content_md5, md5(o.corpus) AS opinion_md5 "
        "FROM corpus_content_v c JOIN corpus_opinion_v o USING (item_id)"
    ),
)
def _(spark, d):
    features = I.text_features(D.catalog(spark, d), SHOP)
    return features.select(
        "item_id",
        _digest(I.weighted_corpus(I.CONTENT_RECIPE)).alias("content_md5"),
        _digest(I.weighted_corpus(I.OPINION_RECIPE)).alias("opinion_md5"),
    )


@query(
    "expand_query", "C10",
    O.sql(
        f"SELECT request_id, {O.expand_query('query')} AS expanded FROM "
        "(SELECT * FROM text_requests_v UNION ALL SELECT concat('c', CAST(conv_id AS VARCHAR), '-', "
        "CAST(turn AS VARCHAR)), text, NULL FROM conversations)"
    ),
)
def _(spark, d):
    chat = D.table(spark, d, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("request_id"),
        F.col("text").alias("query"),
    )
    both = D.text_requests(spark, d).select("request_id", "query").unionByName(chat)
    return both.select(
        "request_id", X.expand_query(F.col("query"), SHOP.expansions).alias("expanded")
    )


@query(
    "query_concepts", "C11",
    O.sql(
        "SELECT request_id, CAST(i AS INTEGER) AS concept_no, array_to_string(cs[i], '|') AS variants FROM ("
        "SELECT request_id, cs, unnest(range(1, len(cs) + 1)) AS i FROM ("
        f"SELECT request_id, {O.query_concepts('query')} AS cs FROM text_requests_v))"
    ),
)
def _(spark, d):
    concepts = X.query_concepts(F.col("query"), SHOP.concepts, SHOP.query_stop_words)
    rows = D.text_requests(spark, d).select(
        "request_id", F.posexplode(concepts).alias("pos", "variants")
    )
    return rows.select(
        "request_id",
        (F.col("pos") + 1).alias("concept_no"),
        F.array_join("variants", "|").alias("variants"),
    )


@query(
    "tag_rules_extract", "C12",
    O.sql(
        f"SELECT doc_id, array_to_string({O.labels('lower(text)', SHOP_TAG_RULES, O.unicode_borders)}, '|') AS labels "
        "FROM documents"
    ),
)
def _(spark, d):
    docs = D.table(spark, d, "documents")
    found = X.rule_labels(F.lower("text"), SHOP_TAG_RULES)
    return docs.select("doc_id", F.array_join(found, "|").alias("labels"))


@query(
    "embedding_text", "C13",
    O.sql(
        "SELECT item_id, md5(concat_ws(' ', "
        + O.strip_ws("title") + ", "
        + ", ".join(
            f"CASE WHEN {O.strip_ws(c)} <> '' THEN {w} END"
            for c, w in (
                ("genres", f"concat('Genres: ', {O.strip_ws('genres')}, '.')"),
                ("tags", f"concat('Tags: ', regexp_replace({O.strip_ws('tags')}, '[|;/]', ',', 'g'), '.')"),
                ("description", O.strip_ws("description")),
            )
        )
        + ")) AS embedding_md5 FROM catalog_v"
    ),
)
def _(spark, d):
    text = V.embedding_text(F.col("title"), F.col("genres"), F.col("tags"), F.col("description"))
    return D.catalog(spark, d).select("item_id", _digest(text).alias("embedding_md5"))


def _sql_display(x: str) -> str:
    plain = f"coalesce({x}, '')"
    for entity, char in L.ENTITIES.items():
        plain = f"replace({plain}, {O.q(entity)}, {O.q(char)})"
    return O.collapse(f"regexp_replace({plain}, '<[^>]+>', ' ', 'g')")


def _sql_short(x: str, limit: int, kept: int) -> str:
    return (
        f"CASE WHEN length({x}) <= {limit} THEN {x} ELSE "
        f"concat(regexp_replace(left({x}, {kept}), '{O.WS}+$', ''), '...') END"
    )


@query(
    "display_clean", "C14",
    "SELECT page_id, md5(t) AS clean_md5, " + _sql_short("t", 190, 187)
    + f" AS short FROM (SELECT page_id, {_sql_display('html')} AS t FROM pages)",
)
def _(spark, d):
    pages = D.table(spark, d, "pages")
    return pages.select(
        "page_id",
        _digest(L.display_clean(F.col("html"))).alias("clean_md5"),
        L.truncate(F.col("html"), 190).alias("short"),
    )


@query(
    "short_field", "C15",
    "SELECT doc_id, " + _sql_short("t", 260, 259)
    + f" AS short FROM (SELECT doc_id, {O.collapse('text')} AS t FROM documents)",
)
def _(spark, d):
    docs = D.table(spark, d, "documents")
    return docs.select("doc_id", L.short_field(F.col("text"), 260).alias("short"))


@query(
    "price_year_labels", "C16",
    O.sql(
        "SELECT item_id, CASE WHEN price IS NULL THEN 'N/D' WHEN price <= 0 THEN 'Free' "
        "ELSE printf('$%.2f', price) END AS price_label, "
        "CASE WHEN release_year > 0 THEN CAST(release_year AS VARCHAR) ELSE 'N/D' END AS year_label "
        "FROM catalog_v"
    ),
)
def _(spark, d):
    return D.catalog(spark, d).select(
        "item_id",
        L.price_label(F.col("price")).alias("price_label"),
        L.year_label(F.col("release_year")).alias("year_label"),
    )


@query(
    "sentiment_band", "C17",
    O.sql(
        "SELECT item_id, CASE WHEN v >= 0.82::DOUBLE THEN 'very positive' WHEN v >= 0.65::DOUBLE THEN 'positive' "
        "WHEN v >= 0.45::DOUBLE THEN 'mixed' ELSE 'critical' END AS band, "
        "CASE WHEN r >= 0.82::DOUBLE THEN 'very positive' WHEN r >= 0.65::DOUBLE THEN 'positive' "
        "WHEN r >= 0.45::DOUBLE THEN 'mixed' ELSE 'critical' END AS ratio_band "
        "FROM (SELECT item_id, sentiment_score_normalized AS v, positive_ratio / 100 AS r FROM items_v)"
    ),
)
def _(spark, d):
    cat = D.catalog(spark, d)
    stats = S.sentiment_stats(cat)
    ratio = F.col("positive_ratio")
    return cat.select(
        "item_id",
        L.sentiment_band(S.normalised_sentiment(stats), ratio).alias("band"),
        L.sentiment_band(F.lit(None).cast("double"), ratio).alias("ratio_band"),
    )


@query(
    "community_keywords", "C18",
    O.sql(
        "SELECT item_id, array_to_string(("
        + O.split_terms(f"CASE WHEN {O.strip_ws('review_keywords')} = '' THEN tags ELSE review_keywords END")
        + ")[1:4], '|') AS keywords FROM catalog_v"
    ),
)
def _(spark, d):
    words = L.community_keywords(F.col("review_keywords"), F.col("tags"), 4)
    return D.catalog(spark, d).select("item_id", F.array_join(words, "|").alias("keywords"))


@query(
    "item_label", "C19",
    O.sql(
        "SELECT item_id, CASE WHEN release_year > 0 THEN concat(t, ' (', CAST(release_year AS VARCHAR), ')') "
        f"ELSE t END AS label FROM (SELECT *, {_sql_display('title')} AS t FROM catalog_v)"
    ),
)
def _(spark, d):
    return (
        D.catalog(spark, d)
        .orderBy("title", "release_year", "item_id")
        .select("item_id", L.item_label(F.col("title"), F.col("release_year")).alias("label"))
    )


@query(
    "adjusted_ratio", "C20",
    O.sql(
        "SELECT item_id, round(CASE WHEN x <= 97 THEN x ELSE 97 - (x - 97) END, 6) AS adjusted_ratio "
        "FROM (SELECT item_id, least(positive_ratio + 30, 100::DOUBLE) AS x FROM catalog_v)"
    ),
)
def _(spark, d):
    raised = F.least(F.col("positive_ratio") + 30, F.lit(100.0))
    return D.catalog(spark, d).select(
        "item_id", F.round(R.adjusted_ratio(raised), 6).alias("adjusted_ratio")
    )
