"""Data-quality profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfrank.operators import etl as E
from shelfrank.operators import quality as Q
from shelfrank.plans import fixtures as D
from shelfrank.plans import oracle as O
from shelfrank.plans.registry import query
from shelfrank.runtime import write_parquet

_COLUMNS = ["doc_id", "text", "lang", "quality", "toxic"]


def _labelled(spark, d):
    docs = D.table(spark, d, "documents").select("doc_id", "text", "lang")
    return docs.join(D.table(spark, d, "labels"), "doc_id", "left")


O.CTES["labelled_v"] = "SELECT d.doc_id, d.text, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)"


def _row_sql(indicator, subject, n, bad, source):
    return (
        f"SELECT '{indicator}' AS indicator, '{subject}' AS subject, CAST({n} AS BIGINT) AS n_checked, CAST({bad} AS BIGINT) AS n_bad, "
        f"round(CASE WHEN {n} > 0 THEN 100.0::DOUBLE * ({n} - {bad}) / {n} ELSE 0 END, 6) AS good_percent FROM {source}"
    )


def _complete_sql(columns, source):
    rows = [_row_sql("completeness", c, "count(*)", f"(count(*) - count({c}))", source) for c in columns]
    missing = " + ".join(f"(count(*) - count({c}))" for c in columns)
    rows.append(_row_sql("completeness", "(table)", f"(count(*) * {len(columns)})", f"({missing})", source))
    return " UNION ALL ".join(rows)


def _unique_sql(keys, source):
    distinct = f"(SELECT count(*) FROM (SELECT DISTINCT {', '.join(keys)} FROM {source}))"
    return _row_sql("uniqueness", "+".join(keys), "count(*)", f"(count(*) - {distinct})", source)


def _valid_sql(rules, source):
    return " UNION ALL ".join(
        _row_sql("validity", name, f"count({rule})", f"(count({rule}) FILTER (NOT ({rule})))", source)
        for name, rule in rules.items()
    )


def _rounded(df):
    return df.withColumn("good_percent", F.round("good_percent", 6))


@query("completeness", "Q1", O.sql(_complete_sql(_COLUMNS, "labelled_v")))
def _(spark, d):
    return _rounded(Q.completeness(_labelled(spark, d).select(*_COLUMNS)))


@query("uniqueness", "Q2", _unique_sql(["text"], "documents") + " UNION ALL " + _unique_sql(["lang", "source"], "documents"))
def _(spark, d):
    docs = D.table(spark, d, "documents")
    both = Q.uniqueness(docs, ["text"]).unionByName(Q.uniqueness(docs, ["lang", "source"]))
    return _rounded(both)


_CUSTOMER_SQL = {
    "name format": "regexp_matches(c_name, '^Customer#[0-9]*[02468]$')",
    "balance range": "(c_acctbal BETWEEN 0 AND 5000)",
    "segment format": "regexp_matches(c_mktsegment, '^[A-Z]+$')",
}


def _customer_rules():
    return {
        "name format": Q.matches("c_name", "^Customer#[0-9]*[02468]$"),
        "balance range": Q.in_range("c_acctbal", 0, 5000),
        "segment format": Q.matches("c_mktsegment", "^[A-Z]+$"),
    }


@query("validity", "Q3", _valid_sql(_CUSTOMER_SQL, "customer"))
def _(spark, d):
    return _rounded(Q.validity(D.table(spark, d, "customer"), _customer_rules()))


_CUSTOMER_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query(
    "quality_profile", "Q4",
    " UNION ALL ".join(
        [
            _complete_sql(_CUSTOMER_COLUMNS, "customer"),
            _unique_sql(["c_name", "c_nationkey"], "customer"),
            _valid_sql(_CUSTOMER_SQL, "customer"),
        ]
    ),
)
def _(spark, d):
    customers = D.table(spark, d, "customer").select(*_CUSTOMER_COLUMNS)
    return _rounded(Q.profile(customers, ["c_name", "c_nationkey"], _customer_rules()))


_TEXT_SQL = {"text length": "(length(text) >= 200)", "quality range": "(quality BETWEEN 0 AND 1)"}


def _profile_sql(source):
    return " UNION ALL ".join(
        [_complete_sql(_COLUMNS, source), _unique_sql(["text"], source), _valid_sql(_TEXT_SQL, source)]
    )


O.CTES["cleaned_v"] = """
SELECT doc_id, text, lang, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM labelled_v) WHERE rn = 1 AND length(text) >= 200
"""


@query(
    "before_after", "Q5",
    O.sql(
        "SELECT indicator, subject, b.good_percent AS before_percent, a.good_percent AS after_percent FROM "
        f"({_profile_sql('labelled_v')}) b FULL JOIN ({_profile_sql('cleaned_v')}) a USING (indicator, subject)"
    ),
)
def _(spark, d):
    before = _labelled(spark, d).select(*_COLUMNS)
    after = (
        E.keep_first(before, ["text"], [F.col("doc_id")])
        .fillna(0, ["quality", "toxic"])
        .where(F.length("text") >= 200)
    )

    def profiled(df):
        rules = {
            "text length": F.length("text") >= 200,
            "quality range": Q.in_range("quality", 0, 1),
        }
        return _rounded(Q.profile(df, ["text"], rules))

    return Q.before_after(profiled(before), profiled(after))


# A profile from stored states of parts. Only the estimate of a sketch differs from the exact
# profile; it is compared with the exact number here.
@query(
    "merged_profile", "Q2 Q4",
    O.sql(
        "SELECT indicator, subject, n_checked, CASE WHEN indicator = 'uniqueness' THEN 0 ELSE n_bad END AS n_bad, "
        f"true AS close FROM ({_profile_sql('labelled_v')})"
    ),
)
def _(spark, d):
    rows = _labelled(spark, d)
    parts = rows.select(*_COLUMNS, (F.col("doc_id") % 7).alias("day"))
    rules = {"text length": F.length("text") >= 200, "quality range": Q.in_range("quality", 0, 1)}
    states = write_parquet(Q.measured(parts, ["text"], rules, ["day"]), "profiles")
    found = Q.profile_of(Q.merged(states))
    exact = rows.agg(F.countDistinct("text")).scalar()
    keys = F.col("n_checked") - F.col("n_bad")
    unique = F.col("indicator") == "uniqueness"
    near = F.abs(keys - exact) <= 0.04 * exact + 1
    return found.select(
        "indicator", "subject", "n_checked",
        F.when(unique, 0).otherwise(F.col("n_bad")).alias("n_bad"), (~unique | near).alias("close"),
    )
