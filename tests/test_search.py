"""Pasted text, containment, card search, staged cascades and the cell index against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata import storage
from lodestrata.operators import cells, fuse, keyword, vector


def plain_density(found, terms):
    """All intervals that hold every term and no smaller one that does."""
    spans = [(a, b) for a in range(len(found)) for b in range(a, len(found)) if set(terms) <= set(found[a : b + 1])]
    least = [(a, b) for a, b in spans if not any(c >= a and d <= b and (c, d) != (a, b) for c, d in spans)]
    return sum(0.1 / (1 + sum(w not in terms for w in found[a : b + 1])) for a, b in least)


def test_cover_density():
    rng = random.Random(1)
    assert keyword.cover_density("a b".split(), frozenset("ab")) == pytest.approx(0.1) and keyword.cover_density(["a"], frozenset("ab")) == 0
    for _ in range(300):
        found = [rng.choice("abcdefg") for _ in range(rng.randint(0, 25))]
        terms = frozenset(rng.sample("abcdefg", rng.randint(1, 4)))
        assert keyword.cover_density(found, terms) == pytest.approx(plain_density(found, terms))


def prose(rng, n):
    return [rng.choice("alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo".split()) + rng.choice(["", "ward", "ness"]) for _ in range(n)]


def test_pasted_search_against_a_plain_version(spark):
    rng = random.Random(2)
    texts = {(d, i): " ".join(prose(rng, 60)) + ("" if d % 3 else ". No 12/34567-8 stands here") for d in range(20) for i in range(3)}
    pasted = {1: " ".join(texts[4, 1].split()[5:50]), 2: "see № 12/34567-8, please", 3: texts[7, 0][:160] + "\n" + texts[7, 2][:100].upper(), 4: None, 5: "", 6: " ".join(prose(rng, 40))}
    items = spark.createDataFrame(list(pasted.items()), "item_id long, text string")
    asked = {r.item_id: (r.w, r.n) for r in items.select("item_id", keyword.token_windows(keyword.meaningful(F.col("text"))).alias("w"), keyword.needles(F.col("text")).alias("n")).collect()}
    expected = {}
    for item, (windows, needles) in asked.items():
        for key, text in texts.items():
            found = [w.strip(".") for w in text.lower().replace(",", " ").split()]
            score = sum(plain_density(found, set(w.split())) for w in set(windows)) + sum(4 for n in set(needles) if n.lower() in text.lower())
            if score or any(set(w.split()) <= set(found) for w in windows):
                expected.setdefault(item, {}).setdefault(key[0], []).append((-round(score, 9), key[1]))
    chunks = spark.createDataFrame([(d, i, t) for (d, i), t in texts.items()] + [(90, 0, None), (91, 0, "")], "parent long, chunk_index int, content string")
    for most in (keyword.ENTRIES, 2):  # few and many blocks
        keyword.ENTRIES, before = most, keyword.ENTRIES
        out = keyword.pasted_search(items, chunks, 5).collect()
        keyword.ENTRIES = before
        for item in pasted:
            best = sorted((*min(own), d) for d, own in expected.get(item, {}).items())
            best = sorted(best, key=lambda x: (x[0], x[2]))[:5]
            told = sorted((r for r in out if r.item_id == item), key=lambda r: r["rank"])
            assert [(r.parent, r.chunk_index) for r in told] == [(d, i) for _, i, d in best]
            assert all(abs(r.text_rank + s) < 1e-8 and abs(r.similarity - min(1.0, 0.58 + np.log1p(r.text_rank) / 2.5)) < 1e-8 for r, (s, _, _) in zip(told, best, strict=True))
    assert {r.item_id for r in out} >= {1, 2, 3}


@pytest.mark.parametrize("entries", [keyword.ENTRIES, 700])
def test_terms_in_finds_ten_thousand_terms_without_nested_loops(spark, entries, monkeypatch):
    monkeypatch.setattr(keyword, "ENTRIES", entries)
    rng = random.Random(3)
    terms = {"".join(rng.choice("abcdeé") for _ in range(rng.randint(3, 7))) for _ in range(9000)} | {f"{a} {b}" for a in prose(rng, 40) for b in prose(rng, 25)}
    texts = ["".join(rng.choice("abcdeéABC ") for _ in range(rng.randint(0, 300))) + " " + " ".join(prose(rng, 20)) for _ in range(60)] + ["", None]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n int")
    told = spark.createDataFrame([(t, len(t)) for t in terms] + [(None, 0), ("ABC", 3)], "term string, size int")
    found = keyword.terms_in(told, docs, "term", "text")
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    expected = sorted((i, t) for i, x in enumerate(texts) for t in [*terms, "ABC"] if x and t.lower() in x.lower())
    assert sorted((r.doc_id, r.term) for r in found.collect()) == expected and len(expected) > 2000
    every = keyword.terms_in(spark.createDataFrame([("",)], "term string"), docs, "term", "text")
    assert every.count() == len(texts)


def test_card_search_against_a_plain_version(spark):
    rng = random.Random(4)
    cards = [" ".join(prose(rng, 12)) for _ in range(80)] + ["", None]
    queries = {i: list(dict.fromkeys(prose(rng, rng.randint(1, 14)))) for i in range(30)}
    asked = spark.createDataFrame(list(queries.items()), "query_id long, tokens array<string>")
    docs = spark.createDataFrame(list(enumerate(cards)), "doc_id long, text string")
    expected = []
    for q, t in queries.items():
        if len(t) >= 3:
            t = t[:10]
            hits = [(sum(w in (c or "") for w in t), d) for d, c in enumerate(cards)]
            good = sorted(((-n, -d) for n, d in hits if n >= max(3, -(-7 * len(t) // 10))))[:4]
            expected += [(q, -d, -n, len(t), k + 1) for k, (n, d) in enumerate(good)]
    out = keyword.card_search(asked, docs, "doc_id", "text", 4).collect()
    assert sorted((r.query_id, r.doc_id, r.hits, r.query_n, r["rank"]) for r in out) == sorted(expected) and len(expected) > 20
    assert all(abs(r.score - min(0.99, 0.68 + 0.31 * r.hits / r.query_n)) < 1e-12 for r in out)


def test_cascade_asks_later_stages_for_short_keys_only(spark):
    df = lambda rows: spark.createDataFrame(rows, "key string, id long")
    tables = [df([("a", 7), ("b", 1), ("b", 2), ("b", 3)]), df([("a", 7), ("a", 3), ("b", 9), (None, 1)]), df([("a", 1), ("a", 2), ("c", 5)]), df([("a", 8), ("c", 6), ("c", 4), ("c", 3)])]
    asked = []

    def stage(k):
        def of(open_):
            asked.append(sorted(r.key for r in open_.collect()))
            return tables[k].join(open_, "key")

        return of

    keys = df([("a", 0), ("b", 0), ("c", 0), (None, 0), ("a", 1)])
    out = fuse.cascade(keys, [stage(k) for k in range(4)], ["key"], "id", 3).collect()
    assert sorted((r.key, r["rank"], r.id, r.stage) for r in out) == [("a", 1, 7, 0), ("a", 2, 3, 1), ("a", 3, 1, 2), ("b", 1, 1, 0), ("b", 2, 2, 0), ("b", 3, 3, 0), ("c", 1, 5, 2), ("c", 2, 3, 3), ("c", 3, 4, 3)]
    assert asked == [["a", "b", "c"], ["a", "c"], ["a", "c"], ["c"]]
    asked.clear()
    assert fuse.cascade(keys.where("key = 'b'"), [stage(k) for k in range(4)], ["key"], "id", 3).count() == 3 and asked == [["b"]]
    assert fuse.cascade(keys.where("false"), [stage(0)], ["key"], "id", 3).count() == 0


def test_scan_releases_blocks(spark, monkeypatch):
    """More query blocks than may be held together give what one block gives."""
    rng = np.random.default_rng(5)
    corpus = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 5)))], "vec_id long, parent long, vector array<double>")
    queries = corpus.where("vec_id < 60").select(F.col("vec_id").alias("query_id"), "vector")
    whole = sorted(map(tuple, vector.knn(queries, corpus, 4).collect()))
    monkeypatch.setattr(vector, "BLOCK", 10)
    monkeypatch.setattr(storage, "TOGETHER", 2)
    assert sorted(map(tuple, vector.knn(queries, corpus, 4).collect())) == whole and len(whole) == 240
    assert vector.knn(queries.where("false"), corpus, 4).count() == 0


def clustered(spark, n=4000, groups=40, size=16):
    rng = np.random.default_rng(6)
    middle = rng.normal(size=(groups, size))
    v = middle[rng.integers(0, groups, n)] + 0.35 * rng.normal(size=(n, size))
    return spark.createDataFrame([(i, i % 7, x.tolist()) for i, x in enumerate(v)], "vec_id long, parent long, vector array<double>").repartition(4).cache()


def test_cells_reach_their_recall(spark, tmp_path):
    corpus = clustered(spark)
    queries = corpus.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    cells.build(corpus, str(tmp_path / "i"), 32)
    assert cells.lists(spark, str(tmp_path / "i")).count() == 4000  # every row is indexed
    told = cells.measured(queries, corpus, str(tmp_path / "i"), 20, 4)
    assert told["recall"] >= 0.9 and told["cells_share"] == 0.125 and told["rows_share"] < 0.25
    assert cells.measured(queries, corpus, str(tmp_path / "i"), 20, 32)["recall"] == 1.0
    one = cells.search(queries.where("query_id = 50"), str(tmp_path / "i"), 5, 2)
    assert one.count() == 5 and sorted(r["rank"] for r in one.collect()) == [1, 2, 3, 4, 5]


def test_cells_read_the_asked_partitions_and_fall_back(spark, tmp_path):
    corpus = clustered(spark, 600, 6)
    path = str(tmp_path / "i")
    cells.build(corpus.unionByName(spark.createDataFrame([(9000, 1, None)], corpus.schema)), path, 6)
    queries = corpus.where("vec_id = 3").select(F.col("vec_id").alias("query_id"), "vector")
    kept = cells.lists(spark, path).where(F.col("cell").isin([2]))
    assert "PartitionFilters: [isnotnull(cell" in kept._jdf.queryExecution().toString() or "PartitionFilters: [(cell" in kept._jdf.queryExecution().toString() or "PartitionFilters: [cell" in kept._jdf.queryExecution().toString()
    exact = [(r.query_id, r.vec_id, r["rank"]) for r in vector.knn(queries, corpus, 590).collect()]
    assert sorted((r.query_id, r.vec_id, r["rank"]) for r in cells.search(queries, path, 590, 1).collect()) == sorted(exact)  # more than a cell has
    few = cells.search(queries, path, 20, 6, least=0.9).collect()
    assert few and all(r.similarity >= 0.9 for r in few)
    cells.build(corpus.where("false"), str(tmp_path / "none"), 4)
    assert cells.search(queries, str(tmp_path / "none"), 3, 2).count() == 0


def test_a_task_hands_on_its_best_once(spark, monkeypatch):
    """However many batches a task reads, in pieces of few similarities, it hands on k rows of a query; copies of a vector
    are equally similar and count by id; results that are handed on early are the same in the end."""
    rng = np.random.default_rng(8)
    m = rng.normal(size=(400, 7))
    m[100:160] = m[5]
    corpus = spark.createDataFrame([(i * 37 % 400, None if i % 5 == 4 else i % 5, v.tolist()) for i, v in enumerate(m)], "vec_id long, parent long, vector array<double>").coalesce(1).cache()
    queries = corpus.where("vec_id % 20 = 5").select(F.col("vec_id").alias("query_id"), "vector")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    ids, parents = np.array([i * 37 % 400 for i in range(400)]), np.array([-1 if i % 5 == 4 else i % 5 for i in range(400)])
    sims = {int(q): np.array([float(np.dot(u[i], u[k])) for k in range(400)]).round(12) for i, q in enumerate(ids) if q % 20 == 5}
    nearest = lambda q, of: [int(ids[x]) for x in sorted(of, key=lambda x: (-sims[q][x], ids[x]))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        for held in (vector.HELD, 60):
            monkeypatch.setattr(vector, "HELD", held)
            handed = vector._scan(queries, corpus, vector._Nearest, k=4, least=-1.0, apart=False)
            assert handed.count() == 20 * 4
            found = vector.knn(queries, corpus, 4).orderBy("query_id", "rank").collect()
            assert [r.vec_id for r in found] == [x for q in sorted(sims) for x in nearest(q, range(400))[:4]]
            apart = vector.knn_by_parent(queries, corpus, 3).orderBy("query_id", F.coalesce("parent", F.lit(-1)), "rank").collect()
            assert [r.vec_id for r in apart] == [x for q in sorted(sims) for p in (-1, 0, 1, 2, 3) for x in nearest(q, np.flatnonzero(parents == p))[:3]]
            stats = {(r.query_id, -1 if r.parent is None else r.parent): (r.n, r.nearest) for r in vector.parent_statistics(queries, corpus).collect()}
            assert stats == {(q, p): (80, nearest(q, np.flatnonzero(parents == p))[0]) for q in sims for p in (-1, 0, 1, 2, 3)}
            ranks = {r.query_id: r["rank"] for r in vector.rank_of(queries.select("query_id", (F.col("query_id") + 1).alias("item_id")), queries, corpus).collect()}
            assert ranks == {q: 1 + int((sims[q] > sims[q][ids == q + 1] + 1e-12).sum()) for q in sims}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_what_is_kept_is_bounded(monkeypatch):
    """Of more parents than may be kept, what is found is handed on in between; nothing is lost."""
    monkeypatch.setattr(vector, "KEPT", 100)
    rng = np.random.default_rng(9)
    m = rng.normal(size=(500, 5))
    u, ids, parents, own = m / np.linalg.norm(m, axis=1, keepdims=True), np.arange(500), np.arange(500) % 97, np.arange(6) + 1000
    for made in (lambda: vector._Nearest(own, u[:6], 2, -np.inf, True), lambda: vector._Statistics(own, u[:6])):
        state, out = made(), []
        for at in range(0, 500, 20):
            state.add(ids[at : at + 20], parents[at : at + 20], u[at : at + 20], u[:6] @ u[at : at + 20].T)
            assert sum(len(x) if isinstance(x, np.ndarray) else 1 for b in getattr(state, "best", {}).values() for x in b.kept[:1]) <= 600
            if state.full():
                out.append([r for b in state.out() for r in b.to_pylist()])
                state = made()
        out.append([r for b in state.out() for r in b.to_pylist()])
        assert len(out) > 2
        every = [r for part in out for r in part]
        for q in range(6):
            for p in range(97):
                rows = [r for r in every if (r["query_id"], r["parent"]) == (1000 + q, p)]
                best = sorted((i for i in range(500) if i % 97 == p), key=lambda i: -(u[i] @ u[q]))
                if "n" in rows[0]:
                    assert sum(r["n"] for r in rows) == len(best) and max(rows, key=lambda r: r["most"])["vec_id"] == best[0]
                else:
                    assert [r["vec_id"] for r in sorted(rows, key=lambda r: -r["similarity"])][:2] == best[:2]


def test_windows_are_compared_in_texts_that_may_hold_them_only(spark):
    """Tokens inside words, in another case or missing; null texts; a text is tokenised once and not counted before."""
    texts = spark.createDataFrame([(0, "Alpha beta, GAMMA. delta!"), (1, "alphabet betas gammas deltas"), (2, "delta x gamma beta alpha alpha"), (3, None), (4, "alpha beta gamma"), (5, ""), (6, "one a/b-c.")], "id int, t string")
    windows = spark.createDataFrame([("alpha beta gamma delta",), ("delta beta",), ("a/b-c one",), ("",), (None,), ("no such",)], "win string")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(t):
        seen.add(1)
        return t

    out = keyword.windows_in(windows, texts.withColumn("t", counted("t")), "t")
    assert seen.value == 0  # texts are not read to count tokens first
    out = keyword.windows_in(windows, texts, "t")
    scanned = out._jdf.queryExecution().optimizedPlan().toString().count("likely(")
    found = {(r.id, r.win): r.density for r in out.collect()}
    plain = {0: "alpha beta gamma delta", 1: "alphabet betas gammas deltas", 2: "delta x gamma beta alpha alpha", 4: "alpha beta gamma", 6: "one a/b-c"}
    expected = {(i, w): keyword.cover_density(t.split(), frozenset(w.split())) for i, t in plain.items() for w in ("alpha beta gamma delta", "delta beta", "a/b-c one", "no such") if set(w.split()) <= set(t.split())}
    assert found == expected and len(found) == 5 and scanned == 1
