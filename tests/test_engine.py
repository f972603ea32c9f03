"""Properties and brute-force checks of index, ranking, similarity and sources."""

import hashlib
import math
import os
from collections import defaultdict
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfrank.functions import text as T
from shelfrank.functions.lexicon import SHOP
from shelfrank.operators import blocks as B
from shelfrank.operators import cells as N
from shelfrank.operators import chat as H
from shelfrank.operators import etl as E
from shelfrank.operators import explain as P
from shelfrank.operators import index as I
from shelfrank.operators import quality as Q
from shelfrank.operators import ranking as R
from shelfrank.operators import scoring as S
from shelfrank.operators import semantic as V
from shelfrank.operators import similar
from shelfrank.plans import fixtures as D
from shelfrank.plans import session_cache as C
from shelfrank.runtime import write_parquet
from shelfrank.sources import catalog_io as IO
from shelfrank.sources import model_store as MS
from shelfrank.sources import versions
from shelfrank.sources.catalog_job import run_catalog_job


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return C.model(spark, sf_dir)


def listed(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def ranking(df):
    return listed(df, "request_id", "rank", "item_id", F.round("score", 8))


# ---------------------------------------------------------------- index


def test_rows_have_length_one(model):
    for kind in I.KINDS:
        norms = model.index.side(kind).groupBy("item_id").agg(F.sum(F.col("w") ** 2).alias("n"))
        assert norms.where(F.abs(F.col("n") - 1) > 1e-9).count() == 0


@pytest.mark.parametrize("ngram_range", [(1, 2), (1, 3)])
def test_counts_equal_repeated_text(spark, sf_dir, ngram_range):
    cat = D.catalog(spark, sf_dir).where("length(description) < 600").limit(25)
    features = write_parquet(I.text_features(cat, SHOP), "features")
    counts = defaultdict(dict)
    for r in I.count_terms(features, SHOP, *ngram_range).collect():
        for kind, tf in (("content", r.tf_content), ("opinion", r.tf_opinion)):
            if tf:
                counts[kind][r.item_id, r.term] = tf
    for kind, recipe in (("content", I.CONTENT_RECIPE), ("opinion", I.OPINION_RECIPE)):
        toks = T.tokenize(I.weighted_corpus(recipe), SHOP.index_stop_words)
        want = defaultdict(int)
        for r in features.select("item_id", toks.alias("t")).collect():
            for n in range(ngram_range[0], ngram_range[1] + 1):
                for i in range(len(r.t) - n + 1):
                    want[r.item_id, " ".join(r.t[i : i + n])] += 1
        assert counts[kind] == want


@pytest.mark.parametrize(("k", "min_df", "cells"), [(5, 1, 64), (40, 3, 16), (40, 2, 1 << 20), (10_000, 1, 64)])
def test_vocabulary_through_cells_equals_the_direct_one(spark, monkeypatch, k, min_df, cells):
    rng = np.random.default_rng(k)
    rows = [
        (f"i{i}", f"t{t}", int(rng.integers(0, 4)), int(rng.integers(0, 3)))
        for i in range(60)
        for t in sorted({int(x) for x in rng.zipf(1.4, 40) if x < 3_000})
    ]
    counts = spark.createDataFrame(rows, "item_id string, term string, tf_content int, tf_opinion int")
    counts = write_parquet(counts, "counts")
    cols = ("kind", "term", "df", "ctf")
    want = listed(I.vocabulary(counts, 60, k, min_df), *cols)
    few = I.frequent_totals(counts, k, min_df, cells)
    if (k, cells) == (5, 64):
        assert few.count() < I.term_totals(counts).count() / 2
    monkeypatch.setattr(I, "DIRECT_ROWS", 0)
    monkeypatch.setattr(I, "frequent_totals", lambda *_: few)
    assert listed(I.vocabulary(counts, 60, k, min_df, len(rows)), *cols) == want
    monkeypatch.undo()
    assert I.frequent_totals(counts.limit(0), k, min_df, cells).count() == 0


def test_idf_and_vocabulary_limit(spark, model):
    row = model.index.terms("content").orderBy("term").first()
    assert math.isclose(row.idf, I.smooth_idf(model.index.n_items, row.df))
    counts = spark.createDataFrame(
        [("1", "a", 3, 1), ("1", "b", 1, 1), ("2", "b", 1, 1), ("2", "c", 2, 1)],
        "item_id string, term string, tf_content int, tf_opinion int",
    )
    vocab = I.vocabulary(counts, 2, max_features=2)
    assert listed(vocab.where("kind = 'content'"), "term", "df", "ctf") == [("a", 1, 3), ("b", 2, 2)]
    common = I.vocabulary(counts, 2, min_df=2)
    assert listed(common.where("kind = 'content'"), "term") == [("b",)]


def test_stored_model_is_refused_when_data_changes(spark, sf_dir, model, tmp_path):
    cat = D.catalog(spark, sf_dir)
    path = str(tmp_path / "model")
    assert MS.open_model(spark, path, SHOP, cat) is None
    MS.save_model(model, cat, path)
    assert MS.open_model(spark, path, SHOP, cat).index.n_items == model.index.n_items
    assert MS.open_model(spark, path, SHOP, cat.where("catalog_pos > 0")) is None
    swapped = cat.withColumn("catalog_pos", F.when(F.col("catalog_pos") < 2, 1 - F.col("catalog_pos")).otherwise(F.col("catalog_pos")))
    assert MS.open_model(spark, path, SHOP, swapped) is None
    newer = tmp_path / "newer.csv"
    newer.write_text("x")
    os.utime(newer, (2e9, 2e9))
    reasons = {
        "older than its data": {"data_path": str(newer)},
        "options": {"ngram_range": (1, 3)},
    }
    for reason, asked in reasons.items():
        assert MS.refusal(spark, path, SHOP, cat, **asked) == reason
    assert MS.refusal(spark, path, SHOP, cat, ngram_range=(1, 2), min_df=1) is None
    words = replace(SHOP, noisy_tags=[*SHOP.noisy_tags, "more"])
    assert MS.refusal(spark, path, words, cat) == "lexicon"
    changed = MS.changed_ranges(spark, path, swapped).collect()
    assert [r.node for r in changed] == [0] and MS.changed_ranges(spark, path, cat).count() == 0


def test_a_changed_recipe_refuses_a_stored_model(spark, sf_dir, model, tmp_path, monkeypatch):
    cat = D.catalog(spark, sf_dir)
    MS.save_model(model, cat, str(tmp_path / "model"))
    monkeypatch.setattr(I, "CONTENT_RECIPE", I.CONTENT_RECIPE[1:])
    assert MS.refusal(spark, str(tmp_path / "model"), SHOP, cat) == "recipe"


def test_a_reopened_model_ranks_alike_and_shuffles_no_postings(spark, sf_dir, tmp_path, capsys):
    cat = D.catalog(spark, sf_dir).where("length(description) < 900")
    fitted = R.build_model(cat, SHOP, ngram_range=(1, 3), max_features=None)
    path = str(tmp_path / "model")
    MS.save_model(fitted, cat, path)
    opened = MS.open_model(spark, path, SHOP, cat, ngram_range=(1, 3), max_features=None)
    assert (opened.index.low, opened.index.high, opened.index.max_features) == (1, 3, None)
    assert opened.stats == fitted.stats and opened.blocks.n_postings == fitted.blocks.n_postings
    reqs = D.requests(spark, sf_dir)
    assert ranking(R.recommend(opened, reqs, 5)) == ranking(R.recommend(fitted, reqs, 5))
    opened.index.postings.groupBy("item_id").count().explain()
    assert "Exchange" not in capsys.readouterr().out


def test_a_lost_save_leaves_the_old_model(spark, sf_dir, model, tmp_path, monkeypatch):
    cat = D.catalog(spark, sf_dir)
    path = str(tmp_path / "model")
    first = MS.save_model(model, cat, path)
    with monkeypatch.context() as patch:
        patch.setattr(versions, "publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            MS.save_model(model, cat, path)
    assert versions.current(spark, path) == first
    assert MS.open_model(spark, path, SHOP, cat) is not None


@pytest.mark.parametrize("size", [1, 3, 64])
def test_fingerprint_tree_equals_its_definition(spark, size):
    rows = [(p, f"id{p}" if p % 5 else None) for p in range(40)]
    cat = spark.createDataFrame(rows, "catalog_pos bigint, item_id string").repartition(3)
    level = [f"{p}:{i or ''}" for p, i in rows]
    want, n_items = [], [1] * len(level)
    for n in range(I.TREE_LEVELS + 1):
        nodes = range(-(-len(level) // size))
        digests = [hashlib.md5("\n".join(level[x * size : (x + 1) * size]).encode()).hexdigest() for x in nodes]
        n_items = [sum(n_items[x * size : (x + 1) * size]) for x in nodes]
        want += [(n, x, n_items[x], digests[x]) for x in nodes]
        level = [f"{x}:{d}" for x, d in enumerate(digests)]
    assert listed(I.fingerprint_tree(cat, size), "level", "node", "n_items", "digest") == sorted(want)


def test_fingerprint_of_no_items(spark):
    none = spark.createDataFrame([], "catalog_pos bigint, item_id string")
    assert I.fingerprint_tree(none).count() == 0
    assert tuple(I.catalog_fingerprint(none).first()) == (0, hashlib.md5(b"").hexdigest())


# ---------------------------------------------------------------- scores


def test_contributions_sum_to_cosine(spark, sf_dir, model):
    reqs = D.text_requests(spark, sf_dir).limit(5)
    reqs = reqs.withColumn("reference_id", F.lit(None).cast("string"))
    scores = S.text_scores(reqs, model.index)
    parts = P.explain_terms(model.index, scores, reqs, k=10**6)
    total = parts.groupBy("request_id", "item_id").agg(F.sum("contribution").alias("s"))
    off = scores.join(total, ["request_id", "item_id"], "left").where(
        F.abs(F.col("content_score") - F.coalesce("s", F.lit(0.0))) > 1e-9
    )
    assert off.count() == 0


def test_weights_sum_to_one(spark, sf_dir):
    reqs = S.normalise_requests(D.requests(spark, sf_dir))
    for active in (False, True):
        total = sum(S.active_weights(semantic_active=active).values())
        assert reqs.where(F.abs(total - 1) > 1e-12).count() == 0


def test_list_wins_over_single_reference(spark):
    rows = spark.createDataFrame(
        [("a", "", ["1"], "9"), ("b", None, [], "9"), ("c", "q", None, None)],
        "request_id string, query string, reference_ids array<string>, reference_id string",
    )
    got = {r.request_id: r.reference_ids for r in S.normalise_requests(rows).collect()}
    assert got == {"a": ["1"], "b": ["9"], "c": None}


def test_all_ways_to_match_give_one_ranking(spark, sf_dir, model, monkeypatch):
    """Blocks with and without a floor, postings, local and written requests."""
    reqs = D.requests(spark, sf_dir)
    keep = R.facet_filter(min_ratio=60)
    want = [(f, ranking(R.recommend(model, reqs, 7, keep=f))) for f in (None, keep)]
    ways = [
        {"PROBE_FROM_ROWS": 0, "DENSE": 10**9},
        {"PROBE_FROM_ROWS": 0, "DENSE": 0},
        {"DENSE": 0, "FEW_PAIRS": 0},
        {"LOCAL_REQUESTS": 0, "PROBE_FROM_ROWS": 0, "DENSE": 10**9},
        {"LOCAL_TERMS": 0, "DENSE": 10**9, "FEW_PAIRS": 0},
    ]
    for way in ways:
        with monkeypatch.context() as patch:
            for name, value in way.items():
                patch.setattr(R, name, value)
            for f, rows in want:
                assert ranking(R.recommend(model, reqs, 7, keep=f)) == rows, way


def test_blocks_give_the_cosines_of_the_postings(spark, sf_dir, model):
    reqs = D.text_requests(spark, sf_dir)
    for kind in I.KINDS:
        cols = ("request_id", "item_id", F.round(f"{kind}_score", 9))
        assert listed(R.text_matches(model, reqs, kind), *cols) == listed(
            S.text_scores(reqs, model.index, kind), *cols
        )


def test_blocks_hold_all_postings_once(model):
    table = model.blocks.table
    assert table.selectExpr("sum(size(cells))").first()[0] == model.index.postings.count() == model.blocks.n_postings
    cells = table.select("block", "term", "max_content", F.explode("cells").alias("x"))
    assert cells.where(F.col("x.c") > F.col("max_content")).count() == 0
    per_block = cells.groupBy("block").agg(F.count_distinct("x.item_id").alias("n"))
    assert per_block.agg(F.max("n")).first()[0] <= B.BLOCK_ITEMS


def test_a_request_reads_only_the_parts_of_its_terms(spark, sf_dir, model, capsys):
    one = D.text_requests(spark, sf_dir).where("request_id = 't0'")
    asked = R.asked_requests(model, one, S.Weights())
    terms = R.asked_terms(model, asked)
    assert asked.rows and 0 < len(terms.parts) < B.TERM_PARTS
    pairs = B.block_pairs(model.blocks, terms.table, terms.parts, asked.table, None)
    pairs.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [part" in plan
    # Sums per block and item follow the buckets: only the request's terms are exchanged.
    assert "Exchange hashpartitioning" not in plan


def test_a_floor_drops_blocks_and_pairs(spark, sf_dir, model):
    reqs = D.text_requests(spark, sf_dir)
    asked = R.asked_requests(model, reqs, S.Weights())
    terms = R.asked_terms(model, asked)
    top = asked.table.withColumn("top_factor", F.lit(1.0))
    ranked = R.recommend(model, reqs, 5)
    floor = ranked.groupBy("request_id").agg(F.min("score").alias("floor"))
    every = B.block_pairs(model.blocks, terms.table, terms.parts, top, None)
    some = B.block_pairs(model.blocks, terms.table, terms.parts, top, floor)
    assert some.count() < every.count() / 2
    matched = ranked.where((F.col("content_score") > 0) | (F.col("text_search_score") > 0))
    assert matched.join(some, ["request_id", "item_id"], "left_anti").count() == 0


def test_salted_join_equals_broadcast(spark, sf_dir, model, monkeypatch):
    monkeypatch.setattr(S, "ROWS_PER_SALT", 20)
    vectors = S.query_vectors(D.text_requests(spark, sf_dir), model.index, "content")
    sums = {"s": F.sum(F.col("qw") * F.col("w"))}
    side = model.index.side("content")
    cols = ("request_id", "item_id", F.round("s", 9))
    assert listed(S.match_scores(vectors, side, sums, True), *cols) == listed(
        S.match_scores(vectors, side, sums, False), *cols
    )


def test_exact_median(spark):
    rng = np.random.default_rng(1)
    for values in (rng.normal(size=5001), rng.integers(0, 9, 4000) * 1.0, [3.0, 1.0], [5.0]):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        assert S.exact_median(df, "v") == pytest.approx(float(np.median(values)))
    assert S.exact_median(spark.createDataFrame([(None,)], "v double"), "v") is None


def test_ordered_bits_sort_as_doubles(spark):
    values = [float("-inf"), -1e300, -2.5, -2.0, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1.5, 1e300, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("k", S.ordered_bits(F.col("v")))
    rows = sorted((r.k, r.v) for r in df.collect())
    assert [S.from_ordered_bits(k) for k, _ in rows] == values
    assert len({k for k, _ in rows}) == len(values) - 1


def test_panel_counts_requests_without_rows(spark):
    items = spark.createDataFrame([("a",), ("b",)], "item_id string")
    ranked = spark.createDataFrame([("r1", "a", 0.4), ("r1", "b", 0.2)], "request_id string, item_id string, score double")
    reqs = spark.createDataFrame([("r1",), ("r2",)], "request_id string")
    got = listed(P.panel_stats(items, ranked, reqs), "request_id", "n_shown", "best_score", "n_catalog")
    assert got == [("r1", 2, 0.4, 2), ("r2", 0, 0.0, 2)]


def test_vectors_of_another_width_are_refused():
    with pytest.raises(ValueError, match="3 numbers among those of 2"):
        V._matrix([None, [1.0, 2.0], [1.0, 2.0, 3.0]], 2)


# ---------------------------------------------------------------- ranking


def test_probe_never_changes_results(spark, sf_dir, model, monkeypatch):
    reqs = D.requests(spark, sf_dir)
    plain = ranking(R.recommend(model, reqs, 7))
    monkeypatch.setattr(R, "PROBE_FROM_ROWS", 0)
    assert ranking(R.recommend(model, reqs, 7)) == plain


def test_broadcast_limits_never_change_results(spark, sf_dir, model, monkeypatch):
    reqs = D.requests(spark, sf_dir)
    semantic = C.semantic_model(spark, sf_dir)
    vectors = D.request_vectors(spark, sf_dir)
    plain = ranking(R.recommend(model, reqs, 5))
    dense = ranking(R.recommend(semantic, reqs, 5, query_vectors=vectors))
    monkeypatch.setattr(R, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(R, "fits", lambda df, rows=0: False)
    monkeypatch.setattr(R, "broadcast_if_small", lambda df, rows=0: df)
    monkeypatch.setattr(V, "fits", lambda df, rows=0: False)
    assert ranking(R.recommend(model, reqs, 5)) == plain
    assert ranking(R.recommend(semantic, reqs, 5, query_vectors=vectors)) == dense


def test_one_partition_gives_the_same(spark, sf_dir, model):
    reqs = D.requests(spark, sf_dir)
    plain = ranking(R.recommend(model, reqs, 5))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        other = R.build_model(D.catalog(spark, sf_dir), SHOP)
        assert ranking(R.recommend(other, reqs, 5)) == plain
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_liked_items_score_zero_but_stay(spark, sf_dir, model):
    reqs = D.requests(spark, sf_dir).where("request_id = 'dup'")
    rows = R.recommend(model, reqs, 200).where(F.col("item_id").isin("3", "7")).collect()
    assert len(rows) == 2 and all(r.content_score == 0 for r in rows)


def test_scoring_has_no_shuffle_of_postings(spark, sf_dir, model):
    scores = S.text_scores(D.text_requests(spark, sf_dir).limit(3), model.index)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "BroadcastHashJoin" in plan
    above_join = plan[: plan.index("BroadcastHashJoin")]
    assert "Exchange" not in above_join


def test_grid_equals_broadcast_and_brute_force(spark):
    rng = np.random.default_rng(3)
    items = rng.normal(size=(300, 8))
    asked = rng.normal(size=(7, 8))
    item_df = spark.createDataFrame(
        [(f"i{n}", [float(x) for x in v], float(n % 5) / 5, bool(n % 2), 1.0, 2000, n) for n, v in enumerate(items)],
        "item_id string, vector array<double>, quality_score double, has_reviews boolean, positive_ratio double, release_year int, catalog_pos bigint",
    )
    ask_df = spark.createDataFrame(
        [(f"r{n}", [float(x) for x in v], ["i3"] if n else None, 0.7, 0.3) for n, v in enumerate(asked)],
        "request_id string, vector array<double>, own_ids array<string>, weight_semantic double, weight_quality double",
    )
    grid = V.grid_top_k(item_df, ask_df, 5, request_block=2, item_block=40)
    flat = V.dense_top_k(item_df, ask_df, 5)
    for part in (grid, flat):
        found = defaultdict(dict)
        for r in part.collect():
            found[r.request_id][r.item_id] = r.semantic_score
        for n, v in enumerate(asked):
            sem = items @ v
            if n:
                sem[3] = 0.0
            total = np.round(0.7 * sem + 0.3 * (np.arange(300) % 5) / 5, 9)
            best = np.lexsort((np.arange(300), -total))[:5]
            assert {f"i{b}" for b in best} <= set(found[f"r{n}"])


def test_similar_items_with_many_copies(spark):
    cat = [(str(i), i, "bolt", "", "", "red hot iron" if i % 3 else "red cold steel", "") for i in range(40)]
    cat += [("90", 90, "ring", "", "", "iron ring blue", ""), ("91", 91, "", "", "", "", "")]
    df = spark.createDataFrame(
        cat, "item_id string, catalog_pos bigint, title string, genres string, tags string, description string, review_keywords string"
    )
    index = I.fit(df, SHOP)
    rows = defaultdict(dict)
    for r in index.side("content").collect():
        rows[r.item_id][r.term] = r.w
    got = defaultdict(list)
    result = similar.similar_items_all(index, df.select("item_id", "catalog_pos"), 4, block_items=1)
    for r in result.orderBy("item_id", "rank").collect():
        got[r.item_id].append(r.similar_id)
    for a in rows:
        scores = []
        for b in rows:
            s = round(sum(w * rows[b].get(t, 0) for t, w in rows[a].items()), 9)
            if b != a and s > 0:
                scores.append((-s, int(b)))
        assert got[a] == [str(b) for _, b in sorted(scores)[:4]], a


def test_similar_items_store_each_row_once(spark):
    rng = np.random.default_rng(3)
    weights = {f"i{n}": {f"t{t}": float(t % 5 + 1) / 5 for t in rng.choice(30, 4, False).tolist()} for n in range(60)}
    rows = [(i, t, w) for i, ts in weights.items() for t, w in ts.items()]
    table = spark.createDataFrame(rows, "item_id string, term string, w double")

    class Index:
        side = staticmethod(lambda name: table)
        terms = staticmethod(lambda name: table.select("term").distinct())

    items = spark.createDataFrame([(i, n) for n, i in enumerate(weights)], "item_id string, catalog_pos bigint")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        result = similar.similar_items_all(Index, items, 3, block_items=7)
        got = listed(result, "item_id", "similar_id")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    place = {i: n for n, i in enumerate(weights)}
    wanted = []
    for a in weights:
        scores = {b: round(sum(w * weights[b].get(t, 0) for t, w in weights[a].items()), 9) for b in weights if b != a}
        best = sorted((b for b in scores if scores[b] > 0), key=lambda b: (-scores[b], place[b]))[:3]
        wanted += [(a, b) for b in best]
    assert sorted(got) == sorted(wanted)
    plan = result._jdf.queryExecution().toString()
    assert "Cogroup" not in plan and "CoGroup" not in plan and "sequence(" not in plan


def test_resolve_titles_by_brute_force(spark):
    titles = ["Blue Bolt", "blue bolt x", "Ré", "a", "Zed 12", "", "blue bolt"]
    cat = spark.createDataFrame([(str(i), i, t) for i, t in enumerate(titles)], "item_id string, catalog_pos bigint, title string")
    wanted = {"c1": ["BLUE  bolt"], "c2": ["lt x", "a"], "c3": ["nope", "re"], "c4": ["q"], "c5": ["d 1"], "c6": [" "], "c7": ["e"]}
    rows = [(c, n, t) for c, ts in wanted.items() for n, t in enumerate(ts)]
    got = dict(listed(R.resolve_titles(spark.createDataFrame(rows, "case_id string, candidate_no int, title string"), cat), "case_id", "item_id"))
    assert got == {"c1": "0", "c2": "1", "c3": "2", "c5": "4", "c6": "5", "c7": "0"}


def test_titles_with_hot_grams_by_brute_force(spark):
    rng = np.random.default_rng(5)
    # Half of all titles repeat one hot gram; picks are salted and never broadcast.
    titles = ["".join(rng.choice(list("ab "), 12)) + f"{n % 7}" if n % 2 else "aaaa" * (n % 5) + f" {n}" for n in range(300)]
    texts = ["aaa", "aaaa", "aaaaaaa", "a", "ab", "a b", "b 3", " 28", "aaaa 298", "zzz", "aab", "", "ba6", None]
    texts += [t[2:9] for t in titles[:60]]
    cat = spark.createDataFrame([(str(i), i, t) for i, t in enumerate(titles)], "item_id string, catalog_pos bigint, title string")
    asked = spark.createDataFrame([(f"c{n}", 0, t) for n, t in enumerate(texts)], "case_id string, candidate_no int, title string")
    norm = [" ".join(t.split()) for t in titles]
    want = {}
    for n, t in enumerate(texts):
        t = " ".join((t or "").split())
        hits = sorted((x != t, i) for i, x in enumerate(norm) if t in x)
        if hits:
            want[f"c{n}"] = str(hits[0][1])
    for options in ({}, {"rows_per_salt": 40, "broadcast_rows": 0}):
        got = dict(listed(R.resolve_titles(asked, cat, **options), "case_id", "item_id"))
        assert got == want
    none = R.resolve_titles(asked, cat.limit(0))
    assert none.collect() == []
    assert R.resolve_titles(asked.limit(0), cat).collect() == []


def test_search_lists_requests_without_intent_in_browse_order(spark, model):
    rows = [("q", "blue bolt", None), ("l", None, ["3"]), ("n1", " ", None), ("n2", None, [])]
    reqs = spark.createDataFrame(rows, "request_id string, query string, reference_ids array<string>")
    got = listed(R.search(model, reqs, 5), "request_id", "rank", "item_id", "by_intent")
    plain = [r.item_id for r in R.browse(model.items, 5).collect()]
    for n in ("n1", "n2"):
        assert [r[2:] for r in got if r[0] == n] == [(i, False) for i in plain]
    alone = R.recommend(model, reqs.where("request_id IN ('q', 'l')"), 5, by_reviews=True)
    assert [r[:3] for r in got if r[3]] == listed(alone, "request_id", "rank", "item_id")
    assert R.search(model, reqs.limit(0), 5).collect() == []
    assert R.search(model, reqs, 5, keep=F.lit(False)).collect() == []


def test_catalog_job_replaces_a_catalogue_it_reads(spark, tmp_path):
    raw = [
        (0, "Low", 1.0, "2001", "a description of some length", "", "x", "", ""),
        (1, "Top", 5.0, "2002", "short", "rpg", "y", "", ""),
        (2, "top", 4.0, "2003", "another description, long enough", "", "z", "", ""),
        (3, "Bad word", 5.0, "2003", "another description, long enough", "", "z", "", ""),
        (4, "First one", 2.0, None, "another description, long enough", "", "z", "", ""),
        (5, None, 5.0, "2003", "without a name it is not usable", "", "z", "", ""),
    ]
    raw = spark.createDataFrame(raw, "catalog_pos bigint, name string, rating double, released string, description string, tags string, genres string, developers string, publishers string")
    extra = spark.createDataFrame([("Top", "s" * 120, 0), ("Top", "t" * 130, 1)], "name string, summary string, enrich_pos int")
    images = spark.createDataFrame([(" LOW ", "7", None, 0)], "name string, appID string, header_image string, image_pos int")
    path = str(tmp_path / "catalog")
    first = run_catalog_job(raw, extra, images, path, D.REVIEW_WORDS, ["BAD"], ["first"])
    want = [(0, "First one"), (1, "Top"), (2, "Low")]
    # Titles that differ in case only share an id; the better rated one stays.
    assert listed(first, "catalog_pos", "title") == want
    by_title = {r.title: r for r in first.collect()}
    assert by_title["Top"].description == "s" * 120 and by_title["Low"].app_id == "7"
    again = run_catalog_job(raw, extra.limit(0), images.limit(0), path, D.REVIEW_WORDS, ["BAD"], ["first"], k=10)
    assert listed(again, "catalog_pos", "title") == want
    assert {r.title: r.description for r in again.collect()}["Top"] == "short"
    assert run_catalog_job(raw.limit(0), extra, images, path, D.REVIEW_WORDS).count() == 0


# ---------------------------------------------------------------- quality


def test_profile_reads_its_table_once_and_merges(spark):
    rows = [(n % 40 if n % 9 else None, f"v{n % 50}" if n % 4 else None, float(n), n % 3) for n in range(900)]
    df = spark.createDataFrame(rows, "n int, t string, x double, day int")
    df = write_parquet(df, "profiled")
    rules = {"x range": Q.in_range("x", 0, 500), "t form": Q.matches("t", "^v[0-4]")}
    keys = ["n", "t"]
    got = listed(Q.profile(df, keys, rules), "indicator", "subject", "n_checked", "n_bad", "good_percent")
    apart = Q.completeness(df).unionByName(Q.uniqueness(df, keys)).unionByName(Q.validity(df, rules))
    assert got == listed(apart, "indicator", "subject", "n_checked", "n_bad", "good_percent")
    plan = Q.profile(df, keys, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1
    slim = df.drop("day")
    distinct = len({r[:2] for r in rows})
    for states in (Q.measured(slim, keys, rules), Q.merged(Q.measured(df, keys, rules, ["day"]))):
        # Counters are exact however the table was cut, the distinct keys within the sketch's error.
        state = {(r.indicator, r.subject): r for r in Q.profile_of(states).collect()}
        for r in Q.profile(slim, keys, rules).collect():
            one = state[r.indicator, r.subject]
            assert one.n_checked == r.n_checked
            if r.indicator != "uniqueness":
                assert one.n_bad == r.n_bad
        assert abs(900 - state["uniqueness", "n+t"].n_bad - distinct) <= 0.04 * distinct
    empty = {(r.indicator, r.subject): r for r in Q.profile(df.limit(0), keys, rules).collect()}
    assert all((r.n_checked, r.n_bad, r.good_percent) == (0, 0, 0.0) for r in empty.values())
    assert Q.profile_of(Q.measured(df.limit(0), keys, rules)).where("n_checked + n_bad > 0").count() == 0


# ---------------------------------------------------------------- chat


def test_long_conversations_are_split_without_loss(spark):
    rows = [("a", t, "user" if t % 3 else "assistant", f"m{t}") for t in range(40)] + [("b", 5, "user", None)]
    df = spark.createDataFrame(rows, "conv_id string, turn bigint, role string, text string")
    want = listed(H.conversation_queries(df), "conv_id", "turn", "query")
    assert listed(H.conversation_queries(df, block=4), "conv_id", "turn", "query") == want
    users = [f"m{t}" for t in range(40) if t % 3]
    assert want[0][2] == users[0] and want[5][2] == " ".join(users[3:6])


# ---------------------------------------------------------------- dense cells


def dense_fixture(spark, rng, clustered):
    middle = rng.normal(size=(8, 6)) * 4
    x = rng.normal(size=(600, 6)) + (middle[rng.integers(0, 8, 600)] if clustered else 0)
    items = [
        (f"i{n}", [float(v) for v in x[n]] if n % 50 else None, float(n % 7) / 7, n % 3 == 0, float(n % 11), 2000 + n % 5, n)
        for n in range(600)
    ]
    cols = "item_id string, vector array<double>, quality_score double, has_reviews boolean, positive_ratio double, release_year int, catalog_pos bigint"
    q = rng.normal(size=(30, 6)) + (middle[rng.integers(0, 8, 30)] if clustered else 0)
    asked = [
        (f"q{n}", [float(v) for v in q[n]] if n % 9 else None, [f"i{3 * n}", "i7"] if n % 2 else None, 0.6, 0.4)
        for n in range(30)
    ]
    reqs = "request_id string, vector array<double>, own_ids array<string>, weight_semantic double, weight_quality double"
    return spark.createDataFrame(items, cols), spark.createDataFrame(asked, reqs), items, asked


@pytest.mark.parametrize("clustered", [True, False])
@pytest.mark.parametrize("by_reviews", [True, False])
def test_cells_give_the_exact_top_k(spark, clustered, by_reviews):
    items, reqs, item_rows, asked_rows = dense_fixture(spark, np.random.default_rng(5), clustered)
    log = []
    found = N.search_cells(N.build_cells(items, 20), reqs, 5, by_reviews, log)
    plain = V.dense_top_k(items, reqs, 5, by_reviews)
    for df in (found, plain):
        got = defaultdict(set)
        for r in df.collect():
            got[r.request_id].add(r.item_id)
        for rid, vector, own, ws, wq in asked_rows:
            def key(row):
                zero = row[1] is None or vector is None or row[0] in (own or [])
                sem = 0.0 if zero else float(np.dot(vector, row[1]))
                ties = ([-row[3]] if by_reviews else []) + [-row[4], -row[5], row[6]]
                return [-round(ws * sem + wq * row[2], 9), *ties]
            best = [r[0] for r in sorted(item_rows, key=key)[:5]]
            assert set(best) <= got[rid], (rid, best)
    first, second, every = log
    assert every == 21 * 30 and first == 2 * 30
    if clustered:
        assert second < every / 2


def test_a_search_reads_only_some_cells(spark, capsys):
    items, reqs, _, _ = dense_fixture(spark, np.random.default_rng(6), True)
    cells = N.build_cells(items, 20)
    frame = reqs.where("request_id = 'q1'").toPandas()
    wanted = np.zeros((1, len(cells.ids)), bool)
    wanted[0, 4] = True
    scan = N._scanned(cells, spark.sparkContext.broadcast(frame), wanted, 3, False)
    scan.explain("formatted")
    assert "PartitionFilters: [isnotnull(cell" in capsys.readouterr().out
    items_of = {r.item_id for r in cells.table.where(f"cell = {cells.ids[4]}").collect()}
    assert {r.item_id for r in scan.collect()} <= items_of


def test_cells_of_nothing(spark):
    items, reqs, _, _ = dense_fixture(spark, np.random.default_rng(7), False)
    none = N.build_cells(items.where("false"))
    assert N.search_cells(none, reqs, 3).count() == 0
    bare = N.build_cells(items.where("vector is null"))
    assert N.search_cells(bare, reqs, 3).groupBy("request_id").count().where("count >= 3").count() == 30
    assert N.search_cells(N.build_cells(items), reqs.where("false"), 3).count() == 0


# ---------------------------------------------------------------- sources


CATALOG = (
    "item_id string, title string, genres string, tags string, description string, "
    "release_year int, positive_ratio double"
)


def some_catalog(spark, *ids):
    return spark.createDataFrame([(i, f"t{i}", "g", "x", "two\nlines", 2000, 50.0) for i in ids], CATALOG)


@pytest.mark.parametrize("step", ["publish", "drop_old"])
@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_a_lost_replacement_keeps_rows(spark, tmp_path, monkeypatch, step, fmt):
    path = str(tmp_path / f"catalog.{fmt}")
    IO.write_catalog(some_catalog(spark, "1", "2"), path, fmt)
    with monkeypatch.context() as patch:
        patch.setattr(versions, step, lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            IO.write_catalog(some_catalog(spark, "3"), path, fmt)
    left = [("1",), ("2",)] if step == "publish" else [("3",)]
    assert listed(IO.load_catalog(spark, path), "item_id") == left
    IO.write_catalog(IO.load_catalog(spark, path).unionByName(some_catalog(spark, "4")), path, fmt)
    assert listed(IO.load_catalog(spark, path), "item_id") == [*left, ("4",)]


def test_readers_keep_the_version_before_and_folders_change_over(spark, tmp_path):
    path = str(tmp_path / "catalog")
    some_catalog(spark, "0").write.parquet(path)
    assert listed(IO.load_catalog(spark, path), "item_id") == [("0",)]
    IO.write_catalog(some_catalog(spark, "1"), path)
    open_one = IO.load_catalog(spark, path)
    IO.write_catalog(some_catalog(spark, "2"), path)
    assert listed(open_one, "item_id") == [("1",)]
    for i in "345":
        IO.write_catalog(some_catalog(spark, i), path)
    names = sorted(p.name for p in (tmp_path / "catalog").iterdir() if not p.name.startswith("."))
    assert len(names) == 3 and names[0] == versions.POINTER
    assert listed(IO.load_catalog(spark, path), "item_id") == [("5",)]
    (tmp_path / "one.csv").write_text("item_id\n1\n")
    with pytest.raises(ValueError, match="single file"):
        IO.write_catalog(some_catalog(spark, "1"), str(tmp_path / "one.csv"), "csv")


def test_csv_without_line_ends_is_split(spark, tmp_path):
    path = str(tmp_path / "flat.csv")
    rows = spark.range(20_000).selectExpr(
        "cast(id as string) item_id", "'t, \"x\"' title", "'g' genres", "'a' tags", "'d' description",
        "2000 release_year", "1.0 positive_ratio",
    )
    IO.write_catalog(rows.coalesce(1), path, "csv")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        flat = IO.load_catalog(spark, path, multiline=False)
        assert flat.rdd.getNumPartitions() > 1 and flat.distinct().count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_load_catalog_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        IO.load_catalog(spark, str(tmp_path / "none.csv"))
    (tmp_path / "empty.csv").write_text("\n")
    with pytest.raises(ValueError, match="empty"):
        IO.load_catalog(spark, str(tmp_path / "empty.csv"))
    (tmp_path / "part.csv").write_text("item_id,title,tags\n1,x,y\n")
    with pytest.raises(E.ContractError, match="genres, description, release_year, positive_ratio"):
        IO.load_catalog(spark, str(tmp_path / "part.csv"))


def test_contract_coercions(spark):
    df = spark.createDataFrame(
        [(None, "t", None, "a", None, "soon", "120", "x"), ("2", None, "g", None, "d", "1999.7", "-4", None)],
        "game string, title string, genres string, tags string, description string, release_year string, positive_ratio string, sentiment_score string",
    )
    rows = E.validate_contract(df, id_column="game").orderBy("item_id").collect()
    assert [(r.item_id, r.title, r.release_year, r.positive_ratio, r.sentiment_score) for r in rows] == [
        ("", "t", 0, 100.0, None), ("2", "", 1999, 0.0, None)
    ]
    assert "has_cover_image" in rows[0].asDict()


def test_image_urls(spark):
    rows = [
        ("https://x.example/steam/apps/42/pic.jpg", None), ("https://x.example/a.jpg", "7"),
        ("https://via.placeholder.com/1", "12.9"), ("ftp://x", "nan"), (None, "abc"), ("http:///p", " 5 "),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, h string, a string")
    got = [r.u for r in df.select("i", E.resolve_image_url(F.col("h"), F.col("a")).alias("u")).orderBy("i").collect()]
    base = E.APP_IMAGE_URL
    assert got == [
        base[0] + "42" + base[1], "https://x.example/a.jpg", base[0] + "12" + base[1], "", "", base[0] + "5" + base[1]
    ]


def test_keep_first_and_keywords_are_stable(spark):
    df = spark.createDataFrame([("a", 3, "z"), ("a", 1, "y"), (None, 2, "x"), (None, 9, "w")], "k string, o int, v string")
    got = {(r.k, r.v) for r in E.keep_first(df, ["k"], [F.col("o")]).collect()}
    assert got == {("a", "y"), (None, "x")}
    ratios = spark.range(0, 101).select(F.col("id").cast("double").alias("r"))
    words = ratios.select("r", E.synthetic_review_keywords(F.col("r"), D.REVIEW_WORDS).alias("w")).collect()
    for r in words:
        parts = r.w.split(", ")
        pools = (D.REVIEW_WORDS.good, 2) if r.r >= 80 else (D.REVIEW_WORDS.bad, 2) if r.r <= 40 else (D.REVIEW_WORDS.mixed, 2)
        assert len(parts) == 3 and all(p in pools[0] for p in parts[:2])
