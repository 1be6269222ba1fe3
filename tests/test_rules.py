from pyspark.sql import functions as F

from lodestrata.functions import rules, shaping
from lodestrata.operators import fuse


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("v")).first().v


def test_facts_need_a_unit_beside_the_number():
    found = rules.facts("Pay 1 200.50 EUR within 30 days, not 7 apples; € 15 and 2 years.")
    assert [(k, v) for k, v, _ in found] == [("money", 1200.5), ("day", 30.0), ("money", 15.0), ("year", 2.0)] and found[1][2] == 24
    assert rules.facts("") == []


def test_years_and_the_one_that_counts(spark):
    assert value(spark, rules.years(F.col("t")), "2010, 1998 and 12345 and 1700") == [1998, 2010]
    assert value(spark, rules.relevant_year(F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(2001), 2026), "") == 2001


def test_tags_keep_protocols(spark):
    assert value(spark, rules.tag_list(F.col("t")), "6-1; 8,p1-1 ,6") == ["6", "8", "P1-1"]
    assert value(spark, rules.tag_list(F.col("t")), None) == []


def test_longest_alias_wins(spark):
    texts = spark.createDataFrame([(1, "All Rights Reserved here"), (2, "nothing")], "id int, t string")
    aliases = spark.createDataFrame([("rights", "rights"), ("rights", "rights reserved")], "name string, alias string")
    assert [tuple(r) for r in rules.alias_references(texts, aliases, "id", "t").collect()] == [(1, "rights", "rights reserved")]


def test_loose_json(spark):
    parse = shaping.loose_json(F.col("t"), "k int", "k")["k"]
    assert [value(spark, parse, t) for t in ('{"k": 1}', '```json\n{"k": 2}\n```', 'so: {"k": 3}.', '{"x": 1}', "none", None)] == [1, 2, 3, None, None, None]


def test_expansion_is_capped_and_unique(spark):
    out = value(spark, shaping.expanded(F.col("t"), [("tax", ["levy", "duty", "tax"])], most=4), "The tax law tax")
    assert out == ["the", "tax", "law", "levy"]


def test_issue_coverage(spark):
    seen = lambda answer: value(spark, shaping.issue_addressed(F.col("t"), F.lit("Limitation of claims"), F.array(F.lit("due"), F.lit("no"))), answer)
    assert seen("the claims lapse") and seen("it is due") and not seen("no, never of") and not seen(None)


def test_fallback_only_for_keys_without_rows(spark):
    df = lambda *rows: spark.createDataFrame(rows, "key string, id int")
    out = fuse.with_fallback(df(("a", 1)), df(("a", 2), ("b", 3)), ["key"])
    assert sorted(map(tuple, out.collect())) == [("a", 1), ("b", 3)]
