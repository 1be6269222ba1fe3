import datetime as dt
import re

from pyspark.sql import functions as F

from lodestrata.functions import chunkers, parsing, rules, text
from lodestrata.operators import verify


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("v")).first().v


def test_numbers_years_and_names(spark):
    assert [value(spark, parsing.case_number(F.col("t")), t) for t in ("see AB-123 (x1) now", "c/12", "none", None)] == ["AB-123 (x1)", None, None, None]
    assert [value(spark, parsing.application_number(F.col("t")), t) for t in ("No. 16812/11.", "12/34")] == ["16812/11", None]
    years = lambda t: tuple(value(spark, y, t) for y in parsing.year_range(F.col("t"), 2026))
    assert years("from 1995 - 2004") == (1995, 2004) and years("in 2001, 2003") == (2001, None) and years("1980-2030") == (None, None) and years(None) == (None, None)
    assert [value(spark, parsing.judge(F.col("t")), t) for t in ("by Judge Ann Lee, yes", "judge Xy")] == ["Ann Lee", None]
    assert value(spark, parsing.first_named(F.col("t"), [("b", "second"), ("a", "first")]), "A and B") == "second"


def test_laws_and_articles(spark):
    anchors = {"code": "code", "codes": "code"}
    name = lambda t: value(spark, parsing.law_name(F.col("t"), anchors, ("and",)), t)
    assert name("what of the general administrative codes here") == "The General Administrative Code" and name("Code of law") == "code" and name("the tax and code") == "The Tax Code" and name("no law") is None and name(None) is None
    assert [value(spark, parsing.article_number(F.col("t")), t) for t in ("Article 37 of", "the 37th article", "37 article", "none")] == ["37", "37", "37", None]
    assert [value(spark, parsing.convention_article(F.col("t"), [("fair trial", "6")]), t) for t in ("a fair trial", "article 8 of it", "p1-1 claims", "x")] == ["6", "8", "P1-1", None]
    assert value(spark, parsing.hierarchy_level(F.col("t"), F.lit("Organic law"), [("constitution", 1), ("organic", 2)]), "x") == 2 and value(spark, parsing.specificity_level(F.col("t"), ["civil code"]), "The Civil Code") == 2
    assert [value(spark, parsing.effective_year(F.col("t"), 2026), t) for t in ("1999-05-01", "1980-01-01", "soon", None)] == [1999, None, None, None]


def test_issues_and_focus(spark):
    issue = lambda t: value(spark, parsing.labelled_issue(F.col("t"), ["main issue", "question"], "Category:"), t)
    assert issue("Facts\n\nMain issue is so: who pays? Category: tax\nmore") == "who pays?" and issue("Question\n\n  who owns it") == "who owns it" and issue("nothing") is None and issue("Question:") is None
    use = lambda q, f, level="normal": spark.range(1).select(parsing.use_focused(F.lit(q), F.lit(f), F.lit(level))).first()[0]
    assert not use("short", "other") and use("short", "other", "full") and not use("same  Text", "same text", "full") and use("q" * 900, "f" * 700) and not use("q" * 800, "f" * 701)


def test_context_by_role_mode_and_number(spark):
    def told(excerpt, full, role=None, mode="explain", total=1):
        told_text, name = parsing.context_text(F.lit(excerpt).cast("string"), F.lit(full).cast("string"), F.lit(role).cast("string"), F.lit(mode), F.lit(total))
        r = spark.range(1).select(told_text, name).first()
        return len(r[0]), r[1]

    e, f = "e" * 3000, "f" * 9000
    assert told(e, f, "supporting", "find") == (1200, "SUPPORTING-COMPACT") and told(e, f, "supporting") == (2000, "SUPPORTING-COMPACT") and told(e, f, mode="find") == (1200, "COMPACT")
    assert told(e, f, total=6, mode="summarize") == (1200, "COMPACT") and told(None, f, total=4) == (7000, "PRIMARY-CONTEXT") and told(e, f, total=4, mode="summarize") == (7000, "TRUNCATED") and told(e, None, mode="summarize") == (3000, "FULL")
    assert told("e" * 5000, f, mode="compare", total=2) == (3500, "COMPARE") and told("e" * 5000, f, mode="compare", total=3) == (2000, "COMPARE")
    assert told(e, f) == (7000 + len("\n\n---\n"), "MATCHED+CONTEXT") and told("e" * 6600, f) == (6600, "MATCHED+CONTEXT") and told("e" * 8000, "f") == (7000, "FULL") and told(None, f) == (7000, "TRUNCATED")


def test_reviews_labels_and_due_dates(spark):
    faults = lambda **c: spark.range(1).select(parsing.review_faults({k: F.lit(v) for k, v in c.items()})).first()[0]
    assert faults(overall_score=10, verdict="unsafe", clarity_score=1, notes="x" * 8000) == [] and faults(overall_score=0, verdict="good", clarity_score=11, reviewer_name="x" * 121) == ["overall_score", "clarity_score", "verdict", "reviewer_name"]
    assert faults(overall_score=None, verdict=None) == ["overall_score", "verdict"]
    assert [value(spark, parsing.labels(F.col("t"), {"a": "alpha"}), t) for t in ("a", "b", None)] == ["alpha", "b", None]
    now = dt.datetime(2024, 3, 1)
    rows = spark.createDataFrame([(now - dt.timedelta(days=30),), (now - dt.timedelta(days=29, hours=23),), (None,)], "t timestamp")
    assert [r[0] for r in rows.select(parsing.due(F.col("t"), F.lit(now))).collect()] == [True, False, True]
    assert value(spark, parsing.styled(F.col("t"), F.lit("big"), {"big": "Case: {query}{category}\n"}, F.lit(" tax ")), " who? ") == "Case: who?\nCategory: tax" and value(spark, parsing.styled(F.col("t"), F.lit("x"), {}, F.lit(None).cast("string")), " who? ") == "who?"


def test_phrase_flags(spark):
    texts = spark.createDataFrame([(1, "We always win, says nobody"), (2, "always, but this is far from the word " + "x" * 50 + " win"), (3, "always win, we guess"), (4, None)], "id int, t string")
    assert [tuple(r) for r in verify.phrase_flags(texts, "id", "t", [("sure", "high", "always", "win", 10, "guess")]).collect()] == [(1, "sure", "high")]


def test_rich_text_dates_and_parts(spark):
    html = "<div>1. The x<sup>2</sup>&nbsp;law<br/>\u10d2 \u10d0 \u10dc is</div><p>a  b c</p><p></p><p></p>\x01end"
    assert value(spark, text.rich_text(F.col("t")), html) == "1. The x^2 law\n\u10d2\u10d0\u10dc is\n\na b c\n\nend"
    assert value(spark, text.rich_text(F.lit("<p> </p>"), F.col("t")), "plain") == "plain"
    fragments = re.compile("(?:[\u10d0-\u10ff] ){2,}[\u10d0-\u10ff]")
    for t in ("\u10d0 \u10d1", "\u10d0 \u10d1 \u10d2 x \u10d3", "\u10d0\u10d1 \u10d2 \u10d3\u10d4 \u10d5", "\u10d0  \u10d1 \u10d2", "\u10d0 \u10d1 \u10d2 \u10d3 \u10d4\u10d5 \u10d6 \u10d7"):
        assert value(spark, text.rich_text(F.col("t")), t) == re.sub(" +", " ", fragments.sub(lambda m: m[0].replace(" ", ""), t))
    assert [value(spark, text.last_date(F.col("t")), t) for t in ("a 21/11/1997, b 1/2/2003.", "none", None)] == ["2003-02-01", None, None]
    df = spark.createDataFrame([(1, "x" * 40 + " " * 40 + "y" * 50)], "id int, t string")
    assert [(r.part, r.content) for r in text.numbered_parts(df, "id", "t", 40, 30).orderBy("part").collect()] == [(1, "x" * 40), (2, "y" * 40)]
    assert chunkers.buffered_paragraphs("a" * 19 + "\n" + "b" * 30 + "\n" + "c  c" * 10, 60) == ["b" * 30 + " " + "c c" * 10] and chunkers.buffered_paragraphs("b" * 50) == [] and chunkers.buffered_paragraphs("b" * 51) == ["b" * 51]


def test_tags_and_claims(spark):
    assert value(spark, rules.tagged(F.col("t"), [("a", ["x", "y"]), ("b", ["x", "z"])], ("b",)), "X only") == ["a"] and value(spark, rules.tagged(F.col("t"), [("a", ["x"])]), None) == []
    told = {"currency": ("gel",), "context": ("claim",), "kinds": [("counter", ("counter",)), ("main", ("main",))], "default": "claim"}
    t = "The main claim is 1 500 GEL, the counter claim 200.75 gel; 300 apples; 0 gel" + " " * 300 + "of 40 gel here"
    assert rules.claims(t, **told) == [("main", 1500, 18), ("counter", 200, 47), ("counter", 300, 59)]  # the currency behind 0 counts for 300 too
    assert rules.claims("claim of 70 gel", **told) == [("claim", 70, 9)] and rules.claims("70 gel", **told) == [] == rules.claims("", **told)
    assert [c[1] for c in rules.claims(f"{'7' * 400} gel: claim of {'7' * 19} gel and 12.75 gel", **told)] == [12] and len(rules.claims(f"claim of {'7' * 19} gel, {'7' * 15} gel", **told)) == 1


def test_numbers_stand_by_themselves():
    found = lambda t: [(s, w) for s, _, w in rules.numbers(t)]
    assert found("1 500 and 20 30, 1234 567 x") == [(0, "1500"), (10, "20"), (13, "30"), (17, "1234"), (22, "567")]
    assert found("3,50 4.5a 7b c8 12 345abc 1.2.3 9") == [(0, "3.50"), (5, "4"), (16, "12"), (26, "1.2"), (30, "3"), (32, "9")]
    assert found("1\u00a0000\u00a0000.25") == [(0, "1000000.25")] and found("") == [] and found("5") == [(0, "5")]
    pattern = re.compile(r"(?<![^\W_])((?:\d{1,3}(?:\s\d{3})+|\d+)(?:[.,]\d+)?)(?![^\W_])")  # the rule as one pattern
    import random

    rng = random.Random(3)
    for _ in range(3000):
        t = "".join(rng.choice("0123456789  .,ab-") for _ in range(rng.randint(0, 24)))
        assert [(m.start(), re.sub(r"\s", "", m[1]).replace(",", ".")) for m in pattern.finditer(t)] == found(t), t


def test_deadlines(spark):
    told = {"units": {"day": ("day", "days"), "month": ("month", "months")}, "kinds": [("appeal", ("appeal",)), ("limitation", ("lapse",))], "default": "procedural"}
    assert rules.deadlines("An appeal within 14 days." + " " * 120 + "claims lapse after 36-months; 0 days, 12345 days, 1.5 days, 3 dayss", **told) == [("appeal", 14, "day", 17), ("limitation", 36, "month", 164)]
    assert rules.deadlines("7 – day", **told) == [("procedural", 7, "day", 0)] and rules.deadlines("", **told) == []


def test_coverage_gaps(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    issues = df([(1, "tax"), (1, "tax"), (2, "tax"), (2, "harm"), (3, "none")], "key int, issue string")
    found = df([(1, "A", "1"), (1, "A", "1"), (2, "A", "1"), (2, "A", "2"), (2, "B", "9"), (3, "A", "1")], "key int, law string, article string")
    expected = df([("tax", "A", "1"), ("tax", "A", "2"), ("tax", "A", "3"), ("tax", "B", None), ("harm", "C", "5")], "issue string, law string, article string")
    out = sorted((r.key, r.issue, r.law, r.missing) for r in rules.coverage_gaps(issues, found, expected).collect())
    assert out == [(1, "tax", "A", ["2", "3"]), (1, "tax", "B", []), (2, "harm", "C", ["5"]), (2, "tax", "A", ["3"])]
