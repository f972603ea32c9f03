"""Data-quality profile: completeness, uniqueness, validity, before/after.

``profile`` is exact and reads its table once: rows are counted by key, with all other counters
beside, and then summed. ``measured`` keeps a small mergeable state instead, with a sketch for
the distinct keys: profiles of parts (days, sources) are stored, merged and read as one.
Nulls are values of a key, as in ``SELECT DISTINCT``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE = "(table)"


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100.0 * part / whole).otherwise(0.0)


def _is_filled(df: DataFrame, name: str) -> Column:
    return F.col(name).isNotNull()


def _long_form(one_row: DataFrame, names: list[str], indicator: str) -> DataFrame:
    """Turn the n_<i>/bad_<i> columns of one aggregated row into rows."""
    entries = F.array(
        *[
            F.struct(
                F.lit(n).alias("subject"),
                F.col(f"bad_{i}").cast("bigint").alias("n_bad"),
                F.col(f"n_{i}").cast("bigint").alias("n_checked"),
            )
            for i, n in enumerate(names)
        ]
    )
    rows = one_row.select(F.inline(entries))
    return rows.select(
        F.lit(indicator).alias("indicator"),
        "subject",
        "n_checked",
        "n_bad",
        _percent(F.col("n_checked") - F.col("n_bad"), F.col("n_checked")).alias("good_percent"),
    )


def completeness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Filled cells of each column and of the table, in one pass."""
    columns = columns or df.columns
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.count("*").alias(f"n_{i}"), F.count_if(~_is_filled(df, c)).alias(f"bad_{i}")]
    one = df.agg(*aggs)
    last = len(columns)
    one = one.withColumns(
        {
            f"n_{last}": sum((F.col(f"n_{i}") for i in range(last)), F.lit(0)),
            f"bad_{last}": sum((F.col(f"bad_{i}") for i in range(last)), F.lit(0)),
        }
    )
    return _long_form(one, [*columns, TABLE], "completeness")


def uniqueness(df: DataFrame, keys: list[str], approximate: bool = False) -> DataFrame:
    """Distinct keys among all rows; ``approximate`` trades exactness for one small state."""
    if approximate:
        distinct = F.approx_count_distinct(F.struct(*keys))
        one = df.agg(F.count("*").alias("n_0"), distinct.alias("d"))
    else:
        per_key = df.groupBy(*keys).agg(F.count("*").alias("c"))
        one = per_key.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_0"), F.count("*").alias("d"))
    one = one.select("n_0", F.greatest(F.col("n_0") - F.col("d"), F.lit(0)).alias("bad_0"))
    return _long_form(one, ["+".join(keys)], "uniqueness")


def matches(column: str, pattern: str) -> Column:
    return F.col(column).rlike(pattern)


def in_range(column: str, low: float, high: float) -> Column:
    return F.col(column).between(low, high)


def validity(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Values that satisfy each rule among the values present, in one pass."""
    aggs = []
    for i, rule in enumerate(rules.values()):
        aggs += [F.count(rule).alias(f"n_{i}"), F.count_if(~rule).alias(f"bad_{i}")]
    return _long_form(df.agg(*aggs), list(rules), "validity")


# Buckets of a distinct-count sketch, as a power of two: about 0.8 % standard error in 16 KB.
SKETCH_BITS = 14


def _counters(columns: list[str], rules: dict[str, Column]) -> list[Column]:
    """Sums that any profile needs: rows, empty cells, values and violations of each rule."""
    found = [F.count("*").alias("n")]
    found += [F.count_if(F.col(c).isNull()).alias(f"null_{i}") for i, c in enumerate(columns)]
    for i, rule in enumerate(rules.values()):
        found += [F.count(rule).alias(f"seen_{i}"), F.count_if(~rule).alias(f"wrong_{i}")]
    return found


def _entries(columns: list[str], keys: list[str], rules: dict[str, Column], bad_keys: Column) -> Column:
    """Rows ``indicator, subject, n_checked, n_bad`` of one row of counters."""

    def entry(indicator: str, subject: str, checked: Column, bad: Column) -> Column:
        return F.struct(
            F.lit(indicator).alias("indicator"), F.lit(subject).alias("subject"),
            checked.cast("bigint").alias("n_checked"), bad.cast("bigint").alias("n_bad"),
        )

    n, nulls = F.col("n"), [F.col(f"null_{i}") for i in range(len(columns))]
    cells = sum(nulls, F.lit(0))
    return F.array(
        *[entry("completeness", c, n, bad) for c, bad in zip(columns, nulls, strict=True)],
        entry("completeness", TABLE, n * len(columns), cells),
        entry("uniqueness", "+".join(keys), n, bad_keys),
        *[
            entry("validity", name, F.col(f"seen_{i}"), F.col(f"wrong_{i}"))
            for i, name in enumerate(rules)
        ],
    )


def _with_percent(rows: DataFrame) -> DataFrame:
    good = _percent(F.col("n_checked") - F.col("n_bad"), F.col("n_checked"))
    return rows.withColumn("good_percent", good)


def profile(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """All indicators in one scan; counters are combined per key before the shuffle."""
    columns = df.columns
    counters = _counters(columns, rules)
    named = [F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)]
    per_key = df.groupBy(*named).agg(*counters)
    names = ["n", *[f"null_{i}" for i in range(len(columns))]]
    names += [f"{x}_{i}" for i in range(len(rules)) for x in ("seen", "wrong")]
    one = per_key.agg(
        F.count("*").alias("n_keys"),
        *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in names],
    )
    rows = one.select(F.inline(_entries(columns, keys, rules, F.col("n") - F.col("n_keys"))))
    return _with_percent(rows)


def measured(
    df: DataFrame, keys: list[str], rules: dict[str, Column], by: list[str] = (), bits: int = SKETCH_BITS
) -> DataFrame:
    """The mergeable state of a profile, or of one for each group of ``by``, in one scan.

    ``*by, indicator, subject, n_checked, n_bad, sketch``: uniqueness has the sketch of its
    keys and no ``n_bad``.
    """
    columns = [c for c in df.columns if c not in by]
    # Hashes skip nulls, so each value goes with a flag.
    key = F.xxhash64(*[x for k in keys for x in (F.col(k).isNull(), F.col(k))])
    parts = [F.col(c).alias(f"by_{i}") for i, c in enumerate(by)]
    one = df.groupBy(*parts).agg(*_counters(columns, rules), F.hll_sketch_agg(key, F.lit(bits)).alias("keys"))
    rows = one.select(
        *[F.col(f"by_{i}").alias(c) for i, c in enumerate(by)],
        "keys",
        F.inline(_entries(columns, keys, rules, F.lit(None))),
    )
    sketch = F.when(F.col("indicator") == "uniqueness", F.col("keys"))
    return rows.withColumn("sketch", sketch).drop("keys")


def merged(states: DataFrame, by: list[str] = ()) -> DataFrame:
    """States of parts as one state, or as one for each group of ``by``."""
    return states.groupBy(*by, "indicator", "subject").agg(
        F.sum("n_checked").alias("n_checked"),
        F.sum("n_bad").alias("n_bad"),
        F.hll_union_agg("sketch").alias("sketch"),
    )


def profile_of(states: DataFrame) -> DataFrame:
    """The profile that a state holds; distinct keys are the estimate of its sketch."""
    keys = F.least(F.hll_sketch_estimate("sketch"), F.col("n_checked"))
    bad = F.when(F.col("indicator") == "uniqueness", F.col("n_checked") - keys).otherwise(F.col("n_bad"))
    return _with_percent(states.withColumn("n_bad", bad).drop("sketch"))


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two profiles side by side."""
    a = before.select("indicator", "subject", F.col("good_percent").alias("before_percent"))
    b = after.select("indicator", "subject", F.col("good_percent").alias("after_percent"))
    return a.join(b, ["indicator", "subject"], "full_outer")
