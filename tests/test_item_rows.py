"""Rows of items and coverage of local requests against the ways over single terms."""

import pyspark.sql.functions as F

from shelfrank.functions.lexicon import SHOP
from shelfrank.operators import grams as G
from shelfrank.operators import index as I
from shelfrank.operators import scoring as S

COLUMNS = ["item_id", "term", "tf_content", "tf_opinion", "w_content", "w_opinion"]


def catalog(spark, repeat=False):
    rows = [
        ("1", "Red ring", "a, b", "new; b", "the ring of the ring, and ÉCROU ecrou", "crisp"),
        ("2", "", "", None, None, None),
        ("3", "x", "a", "", "one", ""),
        ("4", "Red ring", "a, b", "new; b", "ring " * 300, "dull, crisp"),
        ("5", "bolt", "", "", "pour la que la bolt rods hot red", None),
    ]
    names = "item_id string, title string, genres string, tags string, description string, review_keywords string"
    return spark.createDataFrame(rows + rows[:1] * repeat, names)


def stored(index):
    rows = index.postings.select(*COLUMNS[:4], *[F.round(c, 9).alias(c) for c in COLUMNS[4:]])
    return sorted(map(tuple, rows.collect()))


def test_items_are_counted_as_single_terms_are(spark, monkeypatch):
    cat = catalog(spark)
    features = I.text_features(cat.withColumn("probe", F.lit(True)), SHOP)
    recipes = [I.CONTENT_RECIPE, I.OPINION_RECIPE]
    want = sorted(map(tuple, I.count_terms(features, SHOP).drop("probe").collect()))
    monkeypatch.setattr(G, "SLICE", 20)
    rows = G.item_counts(I.field_tokens(features, SHOP), ["item_id", "probe"], recipes)
    assert rows.count() == 5
    assert sorted(map(tuple, I.flat_terms(rows).drop("probe").collect())) == want
    by_item = I.fit(cat, SHOP)
    monkeypatch.setattr(I, "repeats_ids", lambda _: True)
    assert stored(by_item) == stored(I.fit(cat, SHOP))


def test_repeated_items_are_summed(spark):
    once = {r[:2]: r[2:4] for r in stored(I.fit(catalog(spark), SHOP))}
    twice = {r[:2]: r[2:4] for r in stored(I.fit(catalog(spark, repeat=True), SHOP))}
    assert all(twice[k] == ((2 * v[0], 2 * v[1]) if k[0] == "1" else v) for k, v in once.items())


def test_concepts_of_all_requests_in_one_search(spark):
    texts = ["the rings of cafe au lait x1", "", "red ring, small loop!", "über 12"]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id int, searchable string")
    items = items.withColumn("words", S.distinct_words(F.col("searchable")))
    wanted = [
        [[("ring", True), ("small loop", False)], [("zz", True)], []],
        [],
        [[("ü", False)], [("1", True)], [("caf", True), ("nothing", True)]],
    ]
    concepts = [[[{"text": t, "plain": p} for t, p in c] for c in r] for r in wanted]
    found = items.select("item_id", S.concepts_found(concepts)("words", "searchable").alias("n")).collect()
    for item, n in found:
        assert n == [sum(any(t in texts[item] for t, _ in c) for c in r) for r in wanted]
