"""Rules decided by plain searches first give what their patterns alone give."""

from pyspark.sql import functions as F

from shelfrank.functions import text as X
from shelfrank.functions.lexicon import SHOP, SHOP_TAG_RULES

OTHER = {
    "flags": [r"(?i)BOLT"], "none": [r"x{2}|bolts?"], "many": [r"\bbo+lt"], "dot": [r"a.c"], "sharp": [r"gr[oö]ße"],
    "gap": [r"\bof the\b.{0,5}\bend\b"], "letter": [r"größe?s"], "empty": [r""], "open": [r"\b"], "blank": [r" "],
}
TEXTS = [
    "", " ", "bolt", "bolts", "boltss", "a red rod", "shared hotel", "of the or so with the", "of the end", "of the long end",
    "größ", "größs", "größes", "BOLT", "boooolt", "abc", "xx", "thin inin", "éhot", "hot\nred", "of the\nend", None, "new_gizmo", "bolts-rod",
]


def test_needed_parts_of_simple_patterns_only():
    assert X.needed_parts(r"\bbolts?\b") == ["bolt"]
    assert X.needed_parts(r"\bof the\b.{0,80}\bwith the\b") == ["of the", "with the"]
    for pattern in (r"(?i)bolt", r"bo+lt", r"a.c", r"x{2}", r"a|b", r"\d", r"gr[oö]ße", r"a*", r"ab??", r"ab?+", r"a ?b"):
        assert X.needed_parts(pattern) == [], pattern


def test_labels_are_those_of_the_patterns(spark):
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(TEXTS)], "n int, text string")
    rules = {**SHOP.hint_rules, **SHOP_TAG_RULES, **OTHER}
    text = F.col("text")
    plain = F.array_compact(F.array(*[F.when(text.rlike(X._any_pattern(p)), F.lit(x)) for x, p in rules.items()]))
    found = rows.select(X.rule_labels(text, rules).alias("a"), plain.alias("b")).collect()
    assert [r.a for r in found] == [r.b for r in found]


def test_rare_rules_cost_no_pattern_search(spark, capsys):
    rows = spark.range(1).select(F.col("id").cast("string").alias("text"))
    rows.select(X.rule_labels(F.col("text"), {"a": [r"\bbolts?\b"]}).alias("r")).explain()
    plan = capsys.readouterr().out.lower()
    assert "contains" in plan and "rlike" in plan
