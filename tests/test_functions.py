import math

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import chunkers, scores, text
from lodestrata.operators import keyword


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'boolean' if isinstance(v, bool) else 'int'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], kinds).select(column.alias("v")).first().v


def test_tokens_are_distinct_long_and_not_stop_words(spark):
    assert one(spark, text.tokens(F.col("t")), t="That LAW law, with Words; words été2 ab") == ["words", "été2"]
    assert one(spark, text.tokens(F.col("t")), t=None) == []


def test_stem_takes_the_first_suffix_that_leaves_three(spark):
    assert [one(spark, text.stem(F.col("w")), w=w) for w in ("nation", "running", "bed", "taxes")] == ["nat", "runn", "bed", "tax"]


@pytest.mark.parametrize(("length", "expected"), [(0, []), (8, [8]), (10, [10, 2]), (13, [10, 5]), (17, [10, 9, 1])])
def test_fixed_chunks_keep_the_contained_tail(spark, length, expected):
    docs = spark.createDataFrame([(1, "x" * length)], "id int, t string")
    found = text.fixed_chunks(docs, "id", "t", 10, 2).orderBy("chunk_index").collect()
    assert [len(r.content) for r in found] == expected


def test_fixed_chunks_drop_white_tails_and_count_code_points(spark):
    docs = spark.createDataFrame([(1, "éü" * 5 + " " * 8), (2, None)], "id int, t string")
    assert [r.content for r in text.fixed_chunks(docs, "id", "t", 10, 0).collect()] == ["éü" * 5]


@pytest.mark.parametrize(
    ("window", "end"),
    [
        ("a" * 70 + "\n\n" + "b. c" + "d" * 24, 72),  # a paragraph break before any sentence end
        ("a" * 70 + "! b. c" + "d" * 24, 75),  # a full stop before an exclamation mark, though not the last mark
        ("a" * 80 + ". b! c" + "d" * 14, 82),
        ("a" * 50 + ". " + "b" * 48, 100),  # too far ahead
        ("a" * 70 + "\n" + "b" * 29, 71),  # a line break only if there is no sentence end
        ("a" * 65 + ". " + "b" * 10 + "\n" + "c" * 22, 67),
        ("a" * 65 + ".\n" + "b" * 33, 67),
    ],
)
def test_chunk_ends(window, end):
    assert chunkers.chunk_end(window) == end


def plain_sentence_chunks(text, size, overlap):
    out, offset = [], 0
    while offset < len(text):
        piece = text[offset : offset + size] if offset + size >= len(text) else text[offset : offset + chunkers.chunk_end(text[offset : offset + size])]
        piece = piece.strip()
        out += [piece] if len(piece) > 20 else []
        offset += max(100, len(piece) - overlap)
    return out


def test_sentence_chunks_end_at_a_sentence_and_overlap():
    t = "One two three. " * 40
    parts = chunkers.sentence_chunks(t, 200, 50)
    assert all(len(p) <= 200 and p.endswith(".") for p in parts[:-1]) and parts == plain_sentence_chunks(t, 200, 50)
    assert len(parts[0]) == 194 and t[144:].startswith(parts[1]) and chunkers.sentence_chunks("") == [] and chunkers.sentence_chunks("a" * 20) == [] and chunkers.sentence_chunks("a" * 21) == ["a" * 21]


def test_paragraphs_are_packed_with_a_carry():
    parts = chunkers.packed_paragraphs("\n\n".join(["a" * 30, " b\nb" + "b" * 26, "", "c" * 30, "d" * 90]), 65, 5)
    assert parts == ["a" * 30 + "\n\n" + "b\nb" + "b" * 26, "b" * 5 + "\n" + "c" * 30, "c" * 5 + "\n" + "d" * 90]
    assert chunkers.packed_paragraphs(" x \n\n y ") == [" x \n\n y "] and chunkers.packed_paragraphs("") == [""] and chunkers.packed_paragraphs(" \n" * 80) == []


def test_headed_chunks_repeat_the_header_and_do_not_cross_articles(spark):
    rows = [(48, "Article 48\nTermination", "The text of the first article. " * 100), (49, "Article 49\nMass dismissal", "The text of the second article."), (50, "H", "  "), (51, "", "x" * 20), (52, None, "y" * 21), (53, "L" * 1600, "z" * 500)]
    df = spark.createDataFrame(rows, "id int, h string, b string")
    found = {}
    for r in text.headed_chunks(df, "id", F.col("h"), F.col("b")).orderBy("id", "chunk_index").collect():
        found.setdefault(r.id, []).append(r.content)
    expected = {}
    for i, h, b in rows:
        limit = max(200, 1500 - len(h or "") - 1)
        pieces = [f"{h or ''}\n{b.strip()[a : a + limit].strip()}".strip() for a in range(0, len(b.strip()), max(100, limit - 200))]
        if kept := [p for p in pieces if len(p) > 20]:
            expected[i] = kept
    assert found == expected and all(c.startswith("Article 48\n") and "49" not in c for c in found[48]) and len(found[49]) == 1 and 50 not in found and 51 not in found


def test_sub_chunks_name_their_parts(spark):
    df = spark.createDataFrame([(1, "x" * 750), (2, "y" * 1500), (3, None), (4, "")], "id int, t string")
    found = {r.part_id: len(r.content) for r in text.sub_chunks(df, "id", "t").collect()}
    assert found == {"1": 750, "2": 750, "2.2": 750, "2.3": 200, "4": 0}


def test_windows_and_needles(spark):
    words = " ".join(f"word{i}" for i in range(40))
    tokens = text.meaningful(F.col("t"))
    assert one(spark, tokens, t="The law-of 12/345, (Words). a\u00a0b with x.y..") == ["law-of", "12/345", "words"]
    starts = [0, 8, 18, 14, 23]  # of 33: 45 per cent is 14, 70 per cent 23
    assert one(spark, keyword.token_windows(tokens), t=words) == [" ".join(f"word{i + k}" for k in range(7)) for i in starts]
    assert one(spark, keyword.token_windows(tokens), t="word1 word2 word3 word4 word5") == [] and len(one(spark, keyword.token_windows(tokens), t="word1 word2 word3 word4 word5 word6")) == 1
    found = one(spark, keyword.needles(F.col("t")), t="№ 12/34567-8 and\nThis line names several meaningful things here\nshort\n" + "long enough words " * 12)
    assert found == ["№ 12/34567-8", "12/34567-8", "This line names several meaningful things here"]


def test_complexity_adds_its_signals(spark):
    def score(length, **other):
        base = {k: F.lit(False) for k in ("exact_article", "exact_number", "simple_rule", "complex_", "norms_and_cases", "fact_pattern")} | {k: F.lit(0) for k in ("issues", "domains", "sources", "questions")} | {"mode": F.lit("other")}
        value, level = scores.complexity(F.lit(length), **(base | {k: F.lit(v) for k, v in other.items()}))
        return tuple(spark.range(1).select(value, level).first())

    assert score(100) == (30, "fast") and score(161) == (48, "normal") and score(251) == (55, "normal") and score(501) == (65, "full")
    assert score(100, exact_article=True, exact_number=True, simple_rule=True) == (0, "fast") and score(501, issues=3, domains=2, norms_and_cases=True, sources=3, mode="compare", fact_pattern=True, questions=2) == (100, "full")
    assert score(200, issues=1, sources=1, mode="find") == (43, "normal") and score(200, fact_pattern=True, simple_rule=True) == (30, "fast")


def test_card_scores_take_the_best_field(spark):
    a = lambda *w: F.array(*(F.lit(x) for x in w)).cast("array<string>")
    assert spark.range(1).select(scores.card_score(a("x", "y"), a("x"), a("x", "y"), a())).first()[0] == 0.75
    assert spark.range(1).select(scores.card_score(a("x", "y"), a(), a(), a("x", "y"))).first()[0] == 0.45


def test_numbers_titles_and_dates(spark):
    assert [one(spark, text.normal_number(F.col("n")), n=n) for n in ("1 200,50", "7,00", "15")] == ["1200.5", "7", "15"]
    assert one(spark, text.short_title(F.col("t")), t="word " * 30).endswith("word…")
    assert [str(one(spark, text.any_date(F.col("t")), t=t)) for t in ("2001", "2001-05", "2001-05-07", "07/05/2001", "soon")] == ["2001-01-01", "2001-05-01", "2001-05-07", "2001-05-07", "None"]


def test_html_text_drops_scripts_and_decodes(spark):
    assert one(spark, text.html_text(F.col("h")), h="<p>a&amp;b</p><script>x()</script><!-- c --><b>d</b>") == "a&b d"


def test_evidence_goes_term_by_term(spark):
    t = "The second term stands in this sentence. The first term stands in this one here. Short."
    assert one(spark, text.evidence(F.col("t"), ["first", "second"]), t=t)[0].startswith("The first")


def test_parent_score_boosts_a_hit_on_the_parent(spark):
    boosted = one(spark, scores.parent_score(F.col("m"), F.col("a"), F.col("p")), m=0.70, a=0.70, p=0.70)
    plain = one(spark, scores.parent_score(F.col("m"), F.col("a"), F.col("p")), m=0.72, a=0.72, p=0.0)
    assert boosted > plain and math.isclose(boosted, 0.805)


def test_confidence_needs_score_and_lead(spark):
    rows = [(75.0, 9.0, "high"), (75.0, 2.0, "medium"), (46.0, 15.0, "high"), (40.0, 30.0, "low")]
    assert all(one(spark, scores.match_confidence(F.col("s"), F.col("l"), F.lit(0)), s=s, l=gap) == label for s, gap, label in rows)


def test_negated_outcomes_are_denied(spark):
    assert [one(spark, scores.outcome(F.col("t")), t=t) for t in ("Not granted", "was granted", "stopped", None)] == ["denied", "granted", "stopped", ""]


def test_flag_score_has_a_floor_and_high_flags_fail(spark):
    assert one(spark, scores.flag_score(F.lit(5), F.lit(0), F.lit(0))) == 0
    assert one(spark, scores.flag_verdict(F.lit(95), F.lit(0), F.lit(1))) == "warn"
