"""The catalogue from raw sources to the stored table, in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shelfrank.operators import etl as E
from shelfrank.sources.catalog_io import load_catalog, write_catalog


def run_catalog_job(
    raw: DataFrame,
    enrichment: DataFrame,
    images: DataFrame,
    path: str,
    words: E.ReviewWords,
    blocklist: list[str] = (),
    priority: list[str] = (),
    k: int | None = None,
    **options,
) -> DataFrame:
    """Clean, keep one row per title, merge summaries and images, block, order, check, replace.

    ``raw``, ``enrichment`` and ``images`` are as ``clean_raw_items``, ``merge_enrichment`` and
    ``add_images`` take them; the last two may be empty. Review keywords are drawn from ``words``. ``k`` keeps the best rows only,
    ``options`` go to ``clean_raw_items``. The catalogue at ``path`` is replaced as a whole, and
    only after all of it is written; the result reads it back.
    """
    items = E.build_catalog(raw, words, k, **options)
    items = E.merge_enrichment(items, enrichment)
    items = E.finish_catalog(items, images, list(blocklist), list(priority))
    write_catalog(E.validate_contract(items), path)
    return load_catalog(raw.sparkSession, path)
