"""Catalogue building: cleaning, deduplication, enrichment, contract."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfrank.functions import text as X
from shelfrank.runtime import write_parquet

REQUIRED_COLUMNS = [
    "item_id", "title", "genres", "tags", "description", "release_year", "positive_ratio",
]
OPTIONAL_COLUMNS = [
    "price", "developer", "publisher", "url_store", "url_ref", "header_image", "app_id",
    "review_keywords", "sentiment_score",
]
TEXT_COLUMNS = [
    "item_id", "title", "genres", "tags", "description", "developer", "publisher", "url_store",
    "url_ref", "header_image", "app_id", "review_keywords",
]
# Formats of image addresses.
APP_IMAGE_PATTERN = r"/steam/apps/([0-9]+)/"
APP_IMAGE_URL = ("https://cdn.akamai.steamstatic.com/steam/apps/", "/header.jpg")
PLACEHOLDER_HOST = "placeholder.com"
PLACEHOLDER_IMAGE = "https://via.placeholder.com/460x215"

# Borders and limits of the cleaning rules.
MAX_RATING = 5.0
MIN_DESCRIPTION = 20
SHORT_TEXT = LONG_TEXT = 100

@dataclass(frozen=True)
class ReviewWords:
    """Words that synthetic review keywords are drawn from, by the rating's band."""

    good: tuple[str, ...]
    bad: tuple[str, ...]
    mixed: tuple[str, ...]


class ContractError(ValueError):
    """The table lacks required columns."""


def check_columns(df: DataFrame, required=REQUIRED_COLUMNS) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ContractError(f"missing required columns: {', '.join(missing)}")


# ---------------------------------------------------------------- column rules


def rating_to_ratio(rating: Column) -> Column:
    return F.round(F.coalesce(rating.try_cast("double"), F.lit(0.0)) / MAX_RATING * 100, 2)


def extract_year(col: Column) -> Column:
    found = F.regexp_extract(F.coalesce(col, F.lit("")), "(?:19|20)[0-9]{2}", 0)
    return F.coalesce(found.try_cast("int"), F.lit(0))


def stable_item_id(title: Column) -> Column:
    """128 bits of the lower-cased title: the same in every run, no collisions at scale."""
    return F.md5(F.lower(title))


def store_url(title: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.replace(F.lower(title), F.lit(" "), F.lit("-")))


def reference_url(title: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.replace(title, F.lit(" "), F.lit("+")))


def _draw(words: tuple[str, ...], bucket: Column, n: int) -> Column:
    """The n words with the smallest hash of (bucket, word): equal bucket, equal words."""
    keyed = F.transform(
        F.array(*[F.lit(w) for w in words]),
        lambda w: F.struct(F.md5(F.concat(bucket, F.lit("|"), w)).alias("h"), w.alias("w")),
    )
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda s: s["w"])


def synthetic_review_keywords(ratio: Column, words: ReviewWords) -> Column:
    """Three words: two of the band of ``ratio`` (0 to 100) and one beside it."""
    bucket = F.floor(ratio * 100).cast("string")
    good, bad, mixed = words.good, words.bad, words.mixed
    drawn = (
        F.when(ratio >= 80, F.concat(_draw(good, bucket, 2), _draw(mixed, bucket, 1)))
        .when(ratio <= 40, F.concat(_draw(bad, bucket, 2), _draw(mixed, bucket, 1)))
        .otherwise(F.concat(_draw(mixed, bucket, 2), _draw(good, bucket, 1)))
    )
    return F.array_join(drawn, ", ")


def prefer_longer_text(original: Column, other: Column) -> Column:
    original, other = F.coalesce(original, F.lit("")), F.coalesce(other, F.lit(""))
    swap = (F.length(original) < SHORT_TEXT) & (F.length(other) > LONG_TEXT)
    return F.when(swap, other).otherwise(original)


def contains_any(text: Column, words: list[str]) -> Column:
    return text.rlike(X.contains_any_regex(words)) if words else F.lit(False)


def priority_flag(title: Column, names: list[str]) -> Column:
    lowered = F.lower(F.coalesce(title, F.lit("")))
    return F.when(contains_any(lowered, names), 1).otherwise(0)


def valid_url(url: Column) -> Column:
    candidate = X.strip_ws(F.coalesce(url, F.lit("")))
    return F.when(candidate.rlike("^(?i:https?)://[^/?#]"), candidate).otherwise("")


def app_image_url(app_id: Column) -> Column:
    raw = X.strip_ws(F.coalesce(app_id.cast("string"), F.lit("")))
    number = F.when(raw.rlike("^[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?$"), raw).try_cast("double")
    whole = number.try_cast("bigint")
    url = F.concat(F.lit(APP_IMAGE_URL[0]), whole.cast("string"), F.lit(APP_IMAGE_URL[1]))
    return F.coalesce(url, F.lit(""))


def resolve_image_url(header_image: Column, app_id: Column) -> Column:
    raw = X.strip_ws(F.coalesce(header_image, F.lit("")))
    own = F.when(~F.contains(F.lower(raw), F.lit(PLACEHOLDER_HOST)), raw).otherwise("")
    in_url = F.regexp_extract(own, APP_IMAGE_PATTERN, 1)
    return (
        F.when(in_url != "", app_image_url(in_url))
        .when(valid_url(own) != "", valid_url(own))
        .otherwise(app_image_url(app_id))
    )


# ---------------------------------------------------------------- table rules


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order``.

    ``min_by`` over whole rows combines map-side, so a key holding a third of all
    rows costs one row per task in the shuffle.
    """
    ordered = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*df.columns), ordered).alias("row")
    )
    return picked.select("row.*")


def top_k_by_quality(df: DataFrame, k: int | None = None) -> DataFrame:
    """The ``k`` best rows; all of them, in no order, if there is no limit."""
    if k is None:
        return df
    return df.orderBy(F.desc("positive_ratio"), F.desc("release_year"), "item_id").limit(k)


def clean_raw_items(
    raw: DataFrame,
    words: ReviewWords,
    unrated_after: int | None = None,
    store_prefix: str = "https://store.example/items/",
    reference_prefix: str = "https://wiki.example/search?q=",
) -> DataFrame:
    """Usable rows of a raw source as catalogue rows; ``catalog_pos`` is the input position.

    With ``unrated_after``, unrated rows behind that position are left out.
    """
    text = {n: F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ("genres", "tags")}
    rating = F.coalesce(F.col("rating"), F.lit(0)).try_cast("double")
    rows = raw.select(
        "catalog_pos",
        X.strip_ws(F.coalesce("name", F.lit(""))).alias("title"),
        rating.alias("rating"),
        extract_year(F.col("released")).alias("release_year"),
        X.clean_html(F.col("description")).alias("description"),
        text["genres"].alias("genres"),
        text["tags"].alias("tags"),
        F.coalesce("developers", F.lit("")).alias("developer"),
        F.coalesce("publishers", F.lit("")).alias("publisher"),
    )
    late_unrated = (F.col("rating") == 0) & (F.col("catalog_pos") > (unrated_after or 0))
    usable = rows.where(
        (F.col("title") != "")
        & F.col("rating").isNotNull()
        & (F.lit(True) if unrated_after is None else ~late_unrated)
        & ((F.length("description") >= MIN_DESCRIPTION) | (F.col("tags") != ""))
    )
    return usable.select(
        stable_item_id(F.col("title")).alias("item_id"),
        "catalog_pos",
        "title",
        "genres",
        "tags",
        "description",
        "release_year",
        rating_to_ratio(F.col("rating")).alias("positive_ratio"),
        synthetic_review_keywords(F.col("rating") / MAX_RATING * 100, words).alias("review_keywords"),
        F.lit(0.0).alias("price"),
        "developer",
        "publisher",
        store_url(F.col("title"), store_prefix).alias("url_store"),
        reference_url(F.col("title"), reference_prefix).alias("url_ref"),
    )


def build_catalog(raw: DataFrame, words: ReviewWords, k: int | None = None, **options) -> DataFrame:
    """Clean and keep the first row per title; with ``k`` the k best."""
    items = clean_raw_items(raw, words, **options)
    return top_k_by_quality(keep_first(items, ["title"], [F.col("catalog_pos")]), k)


def merge_enrichment(catalog: DataFrame, extra: DataFrame) -> DataFrame:
    """Longer summaries replace short descriptions; ``extra`` has name, summary, enrich_pos.

    ``extra`` is reduced to one row per title first, so no row fans out.
    """
    slim = extra.select(F.col("name").alias("title"), "summary", "enrich_pos")
    one = keep_first(slim, ["title"], [F.col("enrich_pos")]).drop("enrich_pos")
    joined = catalog.join(one, "title", "left")
    merged = joined.withColumn(
        "description", prefer_longer_text(F.col("description"), F.col("summary"))
    )
    return merged.drop("summary")


def fill_default_image(url: Column) -> Column:
    return F.coalesce(url, F.lit(PLACEHOLDER_IMAGE))


def title_key(title: Column) -> Column:
    return X.strip_ws(F.lower(title))


def add_images(catalog: DataFrame, images: DataFrame) -> DataFrame:
    """Image columns by normalised title; ``images`` has name, appID, header_image, image_pos."""
    slim = images.select(
        title_key(F.col("name")).alias("title_key"),
        F.col("appID").alias("app_id"),
        "header_image",
        "image_pos",
    )
    one = keep_first(slim, ["title_key"], [F.col("image_pos")]).drop("image_pos")
    base = catalog.drop("app_id", "header_image")
    joined = base.withColumn("title_key", title_key(F.col("title"))).join(one, "title_key", "left")
    return joined.withColumn("header_image", fill_default_image(F.col("header_image"))).drop("title_key")


def blocklist_filter(df: DataFrame, words: list[str]) -> DataFrame:
    """Drop rows with a listed word anywhere in title, genres or tags (substring)."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "genres", "tags") if c in df.columns]
    return df.where(~contains_any(F.lower(F.concat_ws(" ", *parts)), words))


def order_by_priority(df: DataFrame, names: list[str]) -> DataFrame:
    flagged = df.withColumn("is_priority", priority_flag(F.col("title"), names))
    return flagged.orderBy(F.desc("is_priority"), F.desc("positive_ratio"), "item_id")


def finish_catalog(
    catalog: DataFrame, images: DataFrame, blocklist: list[str], priority: list[str]
) -> DataFrame:
    """Images, block list, one row per id; ``catalog_pos`` numbers them, priority titles first."""
    safe = blocklist_filter(add_images(catalog, images), blocklist)
    flagged = safe.withColumn("is_priority", priority_flag(F.col("title"), priority))
    one = keep_first(
        flagged, ["item_id"], [-F.col("is_priority"), -F.col("positive_ratio"), F.col("catalog_pos")]
    )
    order = [F.desc("is_priority"), F.desc("positive_ratio"), F.asc("catalog_pos"), F.asc("item_id")]
    return renumbered(one, order)


def renumbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """``catalog_pos`` anew as 0, 1, ... in ``order``: a range sort, then counts per partition.

    The sorted rows are stored, so that both readings see the same partitions.
    """
    spark = df.sparkSession
    part = F.spark_partition_id()
    placed = df.orderBy(*order).withColumns(
        {"part": part, "row": F.monotonically_increasing_id() - F.shiftleft(part.cast("bigint"), 33)}
    )
    placed = write_parquet(placed, "ordered")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()
    starts, total = [], 0
    for r in sizes:  # one number per partition
        starts.append((r["part"], total))
        total += r["n"]
    starts = spark.createDataFrame(starts, "part int, start bigint")
    return (
        placed.join(F.broadcast(starts), "part")
        .withColumn("catalog_pos", F.col("start") + F.col("row"))
        .drop("part", "row", "start")
    )


def validate_contract(df: DataFrame, id_column: str = "item_id") -> DataFrame:
    """The fixed catalogue schema: text without NULLs, clipped numbers, no extra columns."""
    if id_column != "item_id" and id_column in df.columns:
        df = df.withColumnRenamed(id_column, "item_id")
    check_columns(df)
    names = ("release_year", "positive_ratio", "price", "sentiment_score")
    number = {n: F.col(n).try_cast("double") for n in names}
    number = {n: F.when(~F.isnan(c), c) for n, c in number.items()}
    zero = F.lit(0.0)
    rules = {
        "release_year": lambda: F.coalesce(number["release_year"].try_cast("int"), F.lit(0)),
        "positive_ratio": lambda: F.greatest(
            F.least(F.coalesce(number["positive_ratio"], zero), F.lit(100.0)), zero
        ),
        "price": lambda: F.coalesce(number["price"], zero),
        "sentiment_score": lambda: number["sentiment_score"],
    }
    out = []
    for name in REQUIRED_COLUMNS + [c for c in OPTIONAL_COLUMNS if c in df.columns]:
        text = F.coalesce(F.col(name).cast("string"), F.lit(""))
        out.append((rules[name]() if name in rules else text).alias(name))
    if "catalog_pos" in df.columns:
        out.append(F.col("catalog_pos").cast("bigint").alias("catalog_pos"))
    image = F.col("header_image") if "header_image" in df.columns else F.lit("")
    app = F.col("app_id") if "app_id" in df.columns else F.lit("")
    return df.select(*out, (resolve_image_url(image, app) != "").alias("has_cover_image"))
