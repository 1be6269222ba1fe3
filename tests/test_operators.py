import numpy as np
from pyspark.sql import functions as F

from lodestrata.operators import evaluate, fuse, keyword, vector, verify, windows
from lodestrata.sources import readers, sinks


def test_knn_matches_numpy(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 8))
    corpus = spark.createDataFrame([(i, i % 4, v.tolist()) for i, v in enumerate(m)], "vec_id long, parent long, vector array<double>")
    queries = corpus.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), "vector")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    found = {(r.query_id, r["rank"]): r.vec_id for r in vector.knn(queries, corpus, 5).collect()}
    assert all(found[q, k + 1] == np.argsort(-(u @ u[q]))[k] for q in range(3) for k in range(5))
    stats = {(r.query_id, r.parent): r for r in vector.parent_statistics(queries, corpus).collect()}
    assert abs(stats[0, 1].mean - (u @ u[0])[1::4].mean()) < 1e-12 and stats[0, 0].nearest == 0


def test_ladder_takes_the_first_step_that_is_reached(spark):
    rows = spark.createDataFrame([(k, s) for k, top in enumerate((0.62, 0.50, 0.36, 0.10)) for s in (top, top - 0.3)], "query_id int, similarity double")
    steps = {r.query_id: r.step for r in vector.ladder(rows, (0.60, 0.45, 0.35)).collect()}
    assert steps == {0: 0.60, 1: 0.45, 2: 0.35}


def test_priority_union_keeps_the_first_stage_and_the_constant_ones(spark):
    df = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int")
    out = fuse.priority_union([("vector", df(1, 2)), ("number", df(1, 3)), ("card", df(1))], "id", always=("card",))
    assert sorted((r.id, r.stage) for r in out.collect()) == [(1, "card"), (1, "vector"), (2, "vector"), (3, "number")]


def test_outliers_need_four_rows_and_a_share_below_a_fifth(spark):
    rows = [(1, "g")] * 5 + [(1, "d")] + [(2, "g")] * 4 + [(2, "d")] + [(3, "g")] * 2 + [(3, "d")]
    flagged = windows.outliers(spark.createDataFrame(rows, "k int, v string"), ["k"], "v").where("outlier")
    assert [(r.k, r.v) for r in flagged.collect()] == [(1, "d")]


def test_gaps_and_budget(spark):
    g = windows.gaps(spark.createDataFrame([(1, 1), (1, 2), (1, 5)], "k int, i int"), "k", "i").first()
    assert (g.starts_at, g.missing) == (1, "3,4")
    rows = spark.createDataFrame([(1, i, 5, c) for i, c in enumerate((3, 3, 2, 2, 1, 1))], "k int, i int, n int, cap int")
    for total, expected in ((5, [3, 2, 0, 0, 0, 0]), (8, [3, 3, 2, 0, 0, 0])):
        out = windows.budget(rows, ["k"], [F.col("i")], F.least("n", "cap"), total).orderBy("i")
        assert [r.taken for r in out.collect()] == expected


def test_retrieval_metrics(spark):
    ranks = spark.createDataFrame([(1,), (3,), (6,), (11,), (None,)], "rank int")
    r = evaluate.retrieval_metrics(ranks).first()
    assert (r.p_at_1, r.p_at_3, r.p_at_5) == (0.2, 0.4, 0.4) and abs(r.mrr_at_10 - (1 + 1 / 3 + 1 / 6) / 5) < 1e-12


def test_unsupported_citations_and_rewrites(spark):
    df = spark.createDataFrame([("see A-1-20 and B-2-21", ["A-1-20"])], "t string, valid array<string>")
    assert df.select(verify.unsupported(verify.extracted(F.col("t"), "[A-Z]-[0-9]-[0-9]+"), F.col("valid")).alias("v")).first().v == ["B-2-21"]
    new, names = verify.rewrite(F.col("t"), [("a", "see", "cf."), ("b", "none", "x")])
    assert tuple(df.select(new.alias("n"), names.alias("m")).first()) == ("cf. A-1-20 and B-2-21", ["a"])


def test_threshold_boundaries(spark):
    df = spark.createDataFrame([(49999,), (50000,), (50001,)], "v int")
    assert [r.x for r in df.select(verify.threshold_holds(F.col("v"), F.lit("<="), F.lit(50000)).alias("x")).collect()] == [True, True, False]


def test_keyword_needles_are_literal(spark):
    df = spark.createDataFrame([("100% sure",), ("1000 sure",), (None,)], "t string")
    assert df.where(keyword.contains(F.col("t"), "100%")).count() == 1


def test_merges(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    incoming = spark.createDataFrame([(2, "x"), (3, "c"), (3, "d"), (2, "y")], "k int, v string")
    kept = lambda df: sorted(map(str, map(tuple, df.collect())))
    rows = lambda *r: sorted(map(str, r))
    assert kept(sinks.insert_ignore(target, incoming, ["k"])) == rows((1, "a"), (2, "b"), (3, "c"), (None, "n"))
    assert kept(sinks.upsert(target, incoming, ["k"])) == rows((1, "a"), (2, "x"), (3, "c"), (None, "n"))
    assert kept(sinks.upsert(target, incoming, ["k"], -F.ascii("v"))) == rows((1, "a"), (2, "y"), (3, "d"), (None, "n"))
    assert kept(sinks.update_columns(target, incoming, "k", ["v"])) == rows((1, "a"), (2, "x"), (None, "n"))
    assert kept(sinks.replace_children(incoming, target, target.where("k = 2"), "k")) == rows((1, "a"), (2, "b"), (3, "c"), (3, "d"), (None, "n"))


def test_request_lines_and_jdbc(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    sinks.request_lines(rows, str(tmp_path / "lines"), "id", "v")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "lines")).collect()) == ['{"id":1,"v":"a"}', '{"id":2}']
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark.range(50).select(F.col("id").cast("int").alias("ID"), F.lit("x").alias("V")).write.jdbc(url, "T", properties={"driver": driver})
    found = readers.jdbc(spark, url, "T", "ID", 0, 50, 4, driver=driver)
    assert found.rdd.getNumPartitions() == 4 and sorted(r.ID for r in found.collect()) == list(range(50))


def plain_rerank(rows, k, advocate):
    """Rows (id, priority, pin order, score, asked, outlier) in their order."""
    if len(rows) <= k:
        return [r[0] for r in rows]
    inf = float("inf")
    pins = sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[1], inf if r[2] is None else r[2], -r[3]))
    if len(pins) >= k:
        return [r[0] for r in pins[:k]]
    rest, slots = [r for r in rows if r[1] is None], k - len(pins)
    heard = lambda rs: sorted(rs, key=lambda r: inf if r[4] is None else r[4])
    if not advocate:
        return [r[0] for r in pins + heard(rest)[:slots]]
    out, plain = [r for r in rest if r[5]], [r for r in rest if not r[5]]
    free = slots - min(1, len(out))
    return [r[0] for r in pins + (plain if len(plain) <= free else heard(plain)[:free]) + out[:1]]


def test_rerank_against_a_plain_version(spark):
    import random

    rng = random.Random(3)
    cases = {}
    for q in range(120):
        n = rng.randint(1, 12)
        asked = rng.sample(range(n), n)
        cases[q] = [(100 * q + i, rng.choice([None, None, None, 1, 2, 3]), rng.choice([None, i]), rng.randint(0, 5), asked[i] if rng.random() < 0.6 else None, rng.random() < 0.2) for i in range(n)]
    df = spark.createDataFrame([(q, i, *r) for q, rows in cases.items() for i, r in enumerate(rows)], "q int, place int, id int, p int, o int, s int, asked int, out boolean")
    for advocate in (False, True):
        found = {}
        ties = [F.desc_nulls_last(F.when(F.col("p").isNotNull(), F.col("s")))]
        for r in fuse.rerank(df, ["q"], 5, "p", "o", ties, "place", "asked", "out" if advocate else None).orderBy("q", "rank").collect():
            found.setdefault(r.q, []).append((r["rank"], r.id))
        for q, rows in cases.items():
            expected = plain_rerank(rows, 5, advocate)
            assert [i for _, i in found[q]] == expected and [k for k, _ in found[q]] == list(range(1, len(expected) + 1)), rows


def test_pins(spark):
    rows = [(["case_number"], 0.1, None, 0, False, 9), (["pasted_text"], 0.94, None, 0, False, 1), (["pasted_text"], 0.95, None, 0, False, 1), (["case_card_keyword"], 0.1, None, 0, True, 5), (["case_card_keyword"], 0.1, None, 0, True, 6), ([], 0.1, "high", 50, False, 2), ([], 0.9, "high", 49, False, 2), (["fingerprint"], None, None, None, None, None)]
    df = spark.createDataFrame(rows, "s array<string>, r double, c string, n int, e boolean, p int")
    priority, order = fuse.pinned(*(F.col(c) for c in "srcnep"))
    assert [tuple(r) for r in df.select(priority, order).collect()] == [(3, None), (None, None), (1, None), (1, 5), (None, None), (1, None), (None, None), (2, None)]


def test_group_chunks(spark):
    rows = spark.createDataFrame([(1, i, 0.1 * i, f"t{i}") for i in range(6)] + [(2, 9, 0.5, "only")], "p int, i int, s double, t string")
    found = {r.p: r for r in fuse.group_chunks(rows, "p", "s", "i", "t").collect()}
    assert (found[1].most, found[1].n, found[1].excerpt, found[2].excerpt) == (0.5, 6, "t5\nt4\nt3", "only")


def test_readers(spark, tmp_path):
    (tmp_path / "l.json").write_text('[{"law": "A", "articles": [{"n": "1"}, {"n": "2"}]}]')
    rows = readers.nested_json(spark, str(tmp_path / "l.json"), "law string, articles array<struct<n:string>>", "articles").collect()
    assert [(r.law, r.place, r.n) for r in rows] == [("A", 0, "1"), ("A", 1, "2")]
    (tmp_path / "r.jsonl").write_text('{"custom_id": "case-7", "body": "{\\"o\\": \\"upheld\\"}"}\n{"custom_id": "case-8", "error": "x"}\nbroken\n')
    assert [tuple(r) for r in readers.json_lines(spark, str(tmp_path / "r.jsonl"), "o string").collect()] == [(7, "upheld")]


def test_with_advocate_keeps_the_last_place(spark):
    rows = spark.createDataFrame([(1, i, 10 - i, i == 5) for i in range(6)], "g int, i int, s int, o boolean")
    assert sorted(r.i for r in fuse.with_advocate(rows, ["g"], 3, F.col("o"), F.desc("s")).collect()) == [0, 1, 5]


def test_longest_prefix_wins(spark):
    rows = spark.createDataFrame([("gpt-4o-mini", 1), ("gpt-4", 2), ("gpt-3", 3), ("o1", 4), ("", 5), (None, 6), ("gpt-4o-mini", 7)], "model string, n int")
    rates = spark.createDataFrame([("gpt-4", 1.0), ("gpt-4o", 2.0), ("gpt", 3.0), ("default", 9.0)], "prefix string, rate double")
    found = evaluate.by_longest_prefix(rows, rates, "model", "prefix", default="default")
    assert {r.n: (r.prefix, r.rate) for r in found.collect()} == {1: ("gpt-4o", 2.0), 2: ("gpt-4", 1.0), 3: ("gpt", 3.0), 4: ("default", 9.0), 5: ("default", 9.0), 6: ("default", 9.0), 7: ("gpt-4o", 2.0)}
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    assert {r.n: r.rate for r in evaluate.by_longest_prefix(rows, rates, "model", "prefix").collect()} == {1: 2.0, 2: 1.0, 3: 3.0, 4: None, 5: None, 6: None, 7: 2.0}


def test_same_issue(spark):
    from lodestrata.functions import scores, text

    same = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(scores.same_issue(text.words(F.col("a")), text.words(F.col("b")))).first()[0]
    assert same("Limitation  of claims!", "limitation of claims") and not same("limitation claims", "limitation of claims")
    assert same("limitation claims damage contract", "contract damage about limitation claims") and not same("limitation claims damage the", "limitation claims damage the more")
    assert not same("", "") and not same(None, "a") and not same("limitation claims damage contract", "limitation claims damage")
