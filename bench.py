"""Time the headline jobs; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from shelfrank.functions.lexicon import SHOP
from shelfrank.operators import chat as H
from shelfrank.operators import etl as E
from shelfrank.operators import explain as P
from shelfrank.operators import quality as Q
from shelfrank.operators import ranking as R
from shelfrank.operators import training as G
from shelfrank.plans import fixtures as D
from shelfrank.plans import q_ranking
from shelfrank.runtime import new_folder
from shelfrank.sources import model_store as MS

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session()
    times: dict[str, float] = {}

    def timed(name, job):
        start = time.perf_counter()
        result = job()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
        return result

    catalog = D.catalog(spark, SF_DIR)
    timed("load_catalog", lambda: run(catalog))
    model = timed("fit_both_indexes", lambda: R.build_model(catalog, SHOP))
    semantic = replace(model, vectors=D.item_vectors(spark, SF_DIR))
    requests = D.requests(spark, SF_DIR)
    texts = D.text_requests(spark, SF_DIR)
    liked = requests.where(F.size("reference_ids") > 0).withColumn("query", F.lit(""))
    one = texts.limit(1)

    timed("recommend_one_text", lambda: R.recommend(model, one, 5).collect())
    timed("recommend_texts", lambda: run(R.recommend(model, texts, 5)))
    timed("recommend_references", lambda: run(R.recommend(model, liked, 5)))
    timed("recommend_mixed", lambda: run(R.recommend(model, requests, 10)))
    timed(
        "recommend_semantic",
        lambda: run(
            R.recommend(semantic, requests, 10, query_vectors=D.request_vectors(spark, SF_DIR))
        ),
    )
    keep = R.facet_filter(**q_ranking.FACETS)
    timed("recommend_filtered", lambda: run(R.recommend(model, requests, 10, keep=keep)))
    timed("browse", lambda: run(R.browse(model.items, 50)))

    chats = H.conversation_queries(D.table(spark, SF_DIR, "conversations"))

    def assistant():
        ranked = H.retrieve_context(model, chats)
        rows = ranked.join(model.items.select("item_id", "genres", "tags"), "item_id")
        run(P.local_answer(H.chat_requests(chats), rows))

    timed("assistant_all_turns", assistant)
    root = new_folder(spark, "bench_model")
    timed("save_model", lambda: MS.save_model(model, catalog, root))

    def reopen():
        opened = MS.open_model(spark, root, SHOP, catalog)
        return R.recommend(opened, one, 5).collect()

    timed("reopen_and_recommend_one", reopen)
    timed("build_catalog", lambda: run(E.build_catalog(D.raw_items(spark, SF_DIR), D.REVIEW_WORDS)))
    timed("top_facets", lambda: run(P.top_facets(catalog, "tags", 160)))
    timed("training_rows", lambda: run(G.instruction_rows(G.training_candidates(catalog))))
    docs = D.table(spark, SF_DIR, "documents")
    rules = {"length": F.length("text") >= 200}
    timed("quality_profile", lambda: run(Q.profile(docs, ["text"], rules)))

    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "rows": {
                    "catalog": model.index.n_items,
                    "text_requests": texts.count(),
                    "mixed_requests": requests.count(),
                    "chat_turns": chats.count(),
                },
            }
        )
    )


if __name__ == "__main__":
    main()
