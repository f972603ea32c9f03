"""Queries of the operators, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, rn, unnest(w) AS word, generate_subscripts(w, 1) AS pos, len(w) AS n
  FROM (SELECT doc_id, row_number() OVER () AS rn, regexp_extract_all(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)),
items AS (
  SELECT item_id, regexp_extract_all(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size,
         array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i
        FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
lists AS (SELECT rn, list(word ORDER BY pos) AS w FROM words GROUP BY rn),
places AS (
  SELECT rn, size, i, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT rn, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM lists, sizes
        WHERE len(w) >= size)),
hits AS (SELECT rn, i, size, item_id FROM places JOIN windows USING (size, phrase)),
hit_words AS (SELECT DISTINCT rn, unnest(range(i, i + size)) AS pos FROM hits),
n_hits AS (SELECT rn, count(*) AS n_hit FROM hit_words GROUP BY rn),
n_items AS (SELECT rn, count(DISTINCT item_id) AS n_items,
              string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
            FROM hits GROUP BY rn),
docs AS (SELECT doc_id, row_number() OVER () AS rn FROM documents),
sizes_of AS (SELECT rn, count(*) AS n FROM words GROUP BY rn)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(n, 0) AS contaminated
FROM docs LEFT JOIN sizes_of USING (rn) LEFT JOIN n_hits USING (rn) LEFT JOIN n_items USING (rn)
"""


@query("op1_decontamination", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfrank.llm.decontam import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query("op6_simhash_near_duplicates")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfrank.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfrank.llm import toxicity as X

    docs = table(spark, sf_dir, "documents")
    model = X.fit(docs, table(spark, sf_dir, "labels"))
    return X.score(docs, model, ["doc_id"]).select(
        "doc_id",
        X.held_out().alias("held_out"),
        "score",
        (F.col("score") >= X.THRESHOLD).cast("int").alias("predicted"),
    )


OP10_SQL = r"""
WITH pages AS (
  SELECT row_number() OVER () AS rn, doc_id, source, text, string_split(text, chr(10)) AS lines
  FROM documents),
contents AS (SELECT DISTINCT source, text, lines FROM pages WHERE text IS NOT NULL),
totals AS (SELECT source, count(*) AS total FROM contents GROUP BY source),
counts AS (
  SELECT source, line, count(*) AS n FROM (
    SELECT source, unnest(list_distinct(list_filter(
      list_transform(lines, lambda x: trim(x, chr(32) || chr(9) || chr(13))), lambda x: x <> ''))) AS line
    FROM contents)
  GROUP BY ALL HAVING count(*) >= 5),
bad AS (SELECT counts.source, list(line) AS bad FROM counts JOIN totals ON counts.source IS NOT DISTINCT FROM totals.source
        WHERE n > 0.05 * total GROUP BY ALL),
cut AS (
  SELECT doc_id, p.source, text, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []::VARCHAR[]),
           trim(x, chr(32) || chr(9) || chr(13)))) AS kept
  FROM pages p LEFT JOIN bad ON p.source IS NOT DISTINCT FROM bad.source)
SELECT doc_id, source, array_to_string(kept, chr(10)) AS text,
       coalesce(len(lines), 0)::BIGINT AS n_lines,
       coalesce(len(lines) - len(kept), 0)::BIGINT AS n_dropped
FROM cut
"""


@query("op10_line_dedup", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfrank.llm.line_dedup import drop_boilerplate

    docs = table(spark, sf_dir, "documents")
    return drop_boilerplate(docs).select("doc_id", "source", "text", "n_lines", "n_dropped")


OP3_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS d
           FROM pages),
kept AS (SELECT d, max(page_id) AS k, count(*) AS c FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN c > 1 AND page_id <> k THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN c > 1 AND page_id <> k THEN k END AS refers_to
FROM p LEFT JOIN kept ON p.d = kept.d AND n >= 1000
"""


@query("op3_warc", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfrank.llm.common import new_path
    from shelfrank.llm.warc import read_warc, write_warc

    folder = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(table(spark, sf_dir, "documents"))


def packed_digest(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    from shelfrank.llm.packing import packed_sequences

    packed = packed_sequences(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )


@query("op5_token_files")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from shelfrank.llm.common import new_path
    from shelfrank.llm.token_files import read_tokens, write_tokens

    folder = new_path(spark, "tokens")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    write_tokens(table(spark, sf_dir, "documents"), folder, tokenizer)
    return read_tokens(spark, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@query("op8_language")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfrank.llm import langid as L

    docs = table(spark, sf_dir, "documents")
    found = L.identify(docs, L.fit(docs))
    return found.select("doc_id", L.held_out().alias("held_out"), "lang_pred", "score")


@query("op2_nearest_neighbours")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfrank.llm.hnsw import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@query("op9_near_passages")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfrank.llm.passages import near_passages

    return near_passages(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS rn, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
docs AS (SELECT rn, doc_id, len(w)::BIGINT AS n, w FROM texts WHERE len(w) > 0),
totals AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM docs),
items AS (
  SELECT item_id, term, count(*)::BIGINT AS repeats FROM (
    SELECT item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL))
  GROUP BY ALL),
counts AS (
  SELECT rn, term, count(*)::BIGINT AS tf FROM (SELECT rn, unnest(w) AS term FROM docs)
  WHERE term IN (SELECT term FROM items) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight
  FROM counts, totals GROUP BY term, nn),
scores AS (
  SELECT item_id, rn, sum(repeats * weight * ((1000000000 * tf) // (1000 * tf + 12 *
           (100 - 25 + (25 * n * nn) // ll))))::BIGINT AS score
  FROM counts JOIN docs USING (rn) JOIN weights USING (term) JOIN items USING (term), totals
  GROUP BY ALL),
ranked AS (
  SELECT item_id, doc_id, score, (row_number() OVER (
    PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST))::INTEGER AS rank
  FROM scores JOIN docs USING (rn) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


@query("op11_ranked_search", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfrank.llm.bag_search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfrank.llm.runs import periodic_runs, planted

    return runs_digest(periodic_runs(table(spark, sf_dir, "documents"), planted))


def runs_digest(found: DataFrame) -> DataFrame:
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.col("strongest")
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        *[best[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias(
            "runs_sha256"
        ),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


@query("op13_byte_bpe")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from shelfrank.llm.bpe import decode, encode

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return decode(coded, ranks, public_tokenizers.PATTERN).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
