import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestrata.llm import near_dedup
from lodestrata.llm.components import components
from lodestrata.llm.exact_dedup import exact_dedup, filled, keep_one, may_repeat
from lodestrata.llm.simhash import shingle_hashes

from .common import CLASH, empty_documents, odd_documents, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def brute_fingerprint(text):
    w = words(text)
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_exact_dedup_against_brute_force(spark):
    docs = odd_documents(spark)
    texts = defaultdict(list)
    for r in docs.collect():
        texts[re.sub(r"[\x20\x09-\x0D]+", "", r.text or "")].append((-len(r.text or ""), r.doc_id is None, r.doc_id))
    keeper = {k: min(v)[2] for k, v in texts.items()}
    found = exact_dedup(docs).collect()
    assert len(found) == docs.count() and sum(r.kept for r in found) == len(texts)
    by_sha = defaultdict(set)
    for r in found:
        by_sha[r.text_sha256].add((r.keep_id, r.group_size))
    assert sorted((str(k), n) for v in by_sha.values() for k, n in v) == sorted((str(keeper[k]), len(v)) for k, v in texts.items())


@pytest.mark.parametrize("size", [1 << 14, 1 << 22])
def test_exact_dedup_is_exact_with_a_full_filter(spark, size):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2000).cast("string").alias("text"))
    found = exact_dedup(docs, max_filter_bytes=size)
    assert found.where("kept").count() == 2000 and found.where("group_size = 2").count() == 2000


def test_exact_keep_one(spark):
    docs = odd_documents(spark)
    kept = keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == exact_dedup(docs).where("kept").count()


def test_keep_one_of_an_id_with_two_spellings(spark):
    docs = spark.createDataFrame([(5, "ab"), (5, "a b"), (6, "a b"), (7, "c")], "doc_id long, text string")
    assert sorted(map(tuple, keep_one(docs).collect())) == [(5, "a b"), (7, "c")]
    docs = spark.createDataFrame([(5, "a b", 3), (5, "ab ", 2), (5, "a b", 1)], "doc_id long, text string, sha int")
    assert [tuple(r) for r in keep_one(docs).collect()] == [(5, "a b", 1)]


@pytest.mark.parametrize("parts", [1, 7])
def test_filter_finds_every_repeat_and_few_others(spark, parts):
    rows = [(f"{i % 3000 if i < 3300 else i:064x}",) for i in range(20000)] + [("f" * 64,)] * 5000
    digests = spark.createDataFrame(rows, "d string").repartition(parts).sortWithinPartitions("d")
    found = {r.d: r.again for r in may_repeat(digests)(digests, "d", "again").collect()}
    repeats = {f"{i:064x}" for i in range(300)} | {"f" * 64}
    assert len(found) == 19701 and all(found[d] for d in repeats)
    assert sum(found.values()) - len(repeats) < 0.02 * len(found)
    sent = filled(digests, 2).select(F.sum(F.length("once") + F.length("twice")).alias("n")).first().n
    assert sent <= 8 * (len(found) + parts * len(repeats))  # a repeated digest comes from a few tasks, the others from one


def test_near_dedup_against_brute_force(spark):
    docs = odd_documents(spark)
    rows = [r for r in docs.collect() if r.doc_id is not None]
    fp = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    expected = groups([(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4], fp)
    found = near_dedup.near_dedup(docs).collect()
    assert len(found) == docs.count()
    assert all(r.fp % (1 << 64) == fp[r.doc_id] and r.component_id == expected[r.doc_id] for r in found if r.doc_id is not None)


@pytest.mark.parametrize("n", [50, 900])
def test_tree_links_chains_and_dense_groups(n):
    rng = np.random.default_rng(n)
    centre = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    fp = np.unique([c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False))) for c in np.repeat(centre, n)] + list(rng.integers(0, 1 << 63, n, dtype=np.uint64)))
    links = near_dedup._Links(fp[:, None], 4)
    links.within(np.arange(len(fp)))
    close = [(i, j) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 4) if i < j]
    expected = groups(close, range(len(fp)))
    assert links.roots(np.arange(len(fp))).tolist() == [expected[i] for i in range(len(fp))]
    assert len(links.made) == len(fp) - len(set(expected.values()))


@pytest.mark.parametrize("crowded", [20, 200, 1 << 17])
def test_near_links_in_rings_and_trees(spark, crowded):
    """Shards of any size, split into rings or not, give the links of all pairs."""
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    fp = np.unique([c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False))) for c in np.repeat(centre, 500)] + list(rng.integers(0, 1 << 63, 500, dtype=np.uint64)))
    nodes = spark.createDataFrame([(int(x), i) for i, x in enumerate(fp.view(np.int64).tolist())], "fp long, node long")
    close = [(i, int(j)) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 4) if i < j]
    expected = {k: v for k, v in groups(close, range(len(fp))).items() if k != v}
    assert {r.node: r.component for r in components(near_dedup.near_links(nodes, 4, crowded)).collect()} == expected


def test_similar_groups_find_edited_texts(spark):
    import random

    rng = random.Random(3)
    texts = {}
    for k in range(60):
        w = prose(rng, 200).split()
        texts[3 * k] = " ".join(w)
        texts[3 * k + 1] = " ".join(x if i not in (20, 90) else "changed" for i, x in enumerate(w))  # similar
        texts[3 * k + 2] = " ".join(x if i % 9 else "changed" for i, x in enumerate(w))  # not similar
    texts |= {500: None, 501: "", 502: "one two", 503: "one two"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = {k: set(shingle_hashes(t or "", 5)) for k, t in texts.items()}
    close = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    expected = {k: v for k, v in groups(close, sets).items() if k != v}
    assert {r.doc_id: r.component_id for r in near_dedup.similar_groups(docs).collect()} == expected
    assert near_dedup.keep_one(docs).count() == len(texts) - len(expected)


def brute_groups(texts):
    sets = {k: set(shingle_hashes(t or "", 5)) for k, t in texts.items()}
    close = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return {k: v for k, v in groups(close, sets).items() if k != v}


def test_similar_groups_round_the_threshold(spark):
    import random

    rng, texts = random.Random(12), {}
    for k in range(4):
        w = prose(rng, 300).split()
        for i in range(40):
            at = set(rng.sample(range(300), rng.randint(3, 7)))
            texts[100 * k + i] = " ".join(f"new{i}" if j in at else x for j, x in enumerate(w))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.similar_groups(docs).collect()} == brute_groups(texts)


@pytest.mark.parametrize("shared", [4, 80, 400])
def test_bands_miss_few_pairs_at_the_least_similarity(shared):
    """Whatever the number of rows: the bands don't depend on it."""
    rng, n = np.random.default_rng(shared), 4000
    h = rng.integers(0, 1 << 64, (n, shared + shared // 4), dtype=np.uint64)
    half = shared // 8
    a, b = h[:, : shared + half], np.concatenate([h[:, :shared], h[:, shared + half :]], axis=1)
    chosen = near_dedup.bands_for(0.8)
    shares = near_dedup.band_keys(list(a), chosen) == near_dedup.band_keys(list(b), chosen)
    assert abs(shares.mean() - 0.8**8) < 0.01
    assert (~shares.any(axis=1)).mean() < 0.004
    far = np.bitwise_count(near_dedup.long_prints(list(a)) ^ near_dedup.long_prints(list(b))).sum(axis=1, dtype=int)
    assert (far > near_dedup.LADDER[-1]).mean() < 0.001


def test_repeated_lines_do_not_hide_similar_texts(spark):
    import random

    rng, texts = random.Random(14), {}
    for k in range(8):
        body, line = prose(rng, 300), prose(rng, 8) + " "
        texts |= {3 * k: line * 3 + body, 3 * k + 1: line * 23 + body, 3 * k + 2: line * 40 + body + " end"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.similar_groups(docs).collect()} == {i: i // 3 * 3 for i in texts if i % 3} == brute_groups(texts)


@pytest.mark.parametrize("copies", [30, 150])
def test_large_groups_round_the_threshold(spark, copies):
    """Copies of an original with few to many edits, more than a leaf holds, with and without the original."""
    import random

    rng, texts = random.Random(copies), {}
    for k in range(3):
        w = prose(rng, 150).split()
        texts |= {1000 * k + 999: " ".join(w)} if k else {}
        for i in range(copies):
            at = set(rng.sample(range(150), rng.randint(1, 9)))
            texts[1000 * k + i] = " ".join(f"new{i}w{j}" if j in at else x for j, x in enumerate(w))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.similar_groups(docs).collect()} == brute_groups(texts)


def test_crowded_bands_are_dealt_over_parts(spark, monkeypatch):
    import random

    rng, texts = random.Random(21), {}
    for k in range(2):
        w = prose(rng, 150).split()
        texts |= {1000 * k + 999: " ".join(w)} if k else {}
        for i in range(800 if k else 100):
            at = set(rng.sample(range(150), rng.randint(1, 4)))
            texts[1000 * k + i] = " ".join(f"new{i}w{j}" if j in at else x for j, x in enumerate(w))
    monkeypatch.setattr(near_dedup, "LOOKED_AT", 2)
    own, told = near_dedup.cut, []

    def watched(df, name="part"):
        out = own(df, name)
        told.extend([out] if name == "told" else [])
        return out

    monkeypatch.setattr(near_dedup, "cut", watched)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.similar_groups(docs, crowded=200).collect()} == brute_groups(texts)
    middles = told[0].where("of <> 0")
    assert middles.groupBy("of").count().where("count > 1").count() > 1


@pytest.mark.parametrize("failing", [False, True])
def test_crowded_bands_lose_no_pair_far_from_the_middle(spark, monkeypatch, failing):
    """All documents in one band, dealt over parts: pairs whose ends fall into different parts, near to nothing else,
    are found, whether or not a candidate of the parts failed its check."""
    import random

    rng, texts = random.Random(22), {}
    for k in range(60):
        w = prose(rng, 120).split()
        texts[2 * k] = " ".join(w)
        texts[2 * k + 1] = " ".join(f"new{k}" if j == 60 else x for j, x in enumerate(w))
    if failing:
        w = prose(rng, 200).split()
        texts |= {500 + i: " ".join(f"n{i}w{j}" if j % 20 == i % 20 else x for j, x in enumerate(w)) for i in range(6)}
    monkeypatch.setattr(near_dedup, "LOOKED_AT", 1)
    monkeypatch.setattr(near_dedup, "band_keys", lambda hashes, chosen: np.zeros((len(hashes), len(chosen)), dtype=np.int64))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    expected = brute_groups(texts)
    assert {r.doc_id: r.component_id for r in near_dedup.similar_groups(docs, crowded=20).collect()} == expected and len(expected) >= 60


def test_rare_shingle_pairs_miss_none(spark):
    rng = np.random.default_rng(2)
    sets = {}
    for k in range(6):
        base = rng.integers(0, 1 << 40, 60)
        for i in range(12):
            keep = base[rng.random(60) > rng.choice([0.0, 0.05, 0.1, 0.2])]
            sets[100 * k + i] = set(keep.tolist()) | set(rng.integers(0, 1 << 40, rng.integers(0, 12)).tolist())
    sets[900], sets[901] = {1, 2, 3, 4}, {1, 2, 3, 4, 5}
    sets[902], sets[903] = set(), {1}
    rest = {n: int(n % 3 > 0) for n in sets}
    members = spark.createDataFrame([(n, n, rest[n], sorted(s)) for n, s in sets.items()], "node long, label long, rest long, shingles array<long>")
    found = {(r.a, r.b) for r in near_dedup.rare_shingle_pairs(members, 0.8).collect()}
    close = {(a, b) for a in sets for b in sets if a > b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and rest[a] + rest[b]}
    assert close <= found and len(found) < 3 * len(close)


def test_keep_one_with_clashing_names_and_repeated_ids(spark):
    rng = np.random.default_rng(4)
    w = [f"w{x}" for x in rng.integers(0, 1000, 80)]
    text, other = " ".join(w), " ".join(reversed(w))
    rows = [(1, text, 0), (2, text + " more", 0), (3, other, 1), (3, text + " end", 1), (4, other + " end", 2), (5, None, 3), (5, None, 3), (None, text, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _drop_id int")
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted([("1", text), ("3", other), ("3", text + " end"), ("4", other + " end"), ("5", ""), ("5", ""), ("None", text)])


def test_equal_fingerprints_are_linked_to_each_other(spark, monkeypatch):
    import random

    rng = random.Random(13)
    texts = {0: prose(rng, 100), 1: prose(rng, 100)}
    texts |= {2: texts[1] + " more", 3: texts[1] + " again"}
    monkeypatch.setattr(near_dedup, "long_prints", lambda hashes: np.zeros((len(hashes), near_dedup.WORDS), np.uint64))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.similar_groups(docs).collect()} == {2: 1, 3: 1} == brute_groups(texts)


def test_components_of_a_long_path(spark):
    links = spark.range(300).select(((F.col("id") * 7) % 301).alias("a"), (((F.col("id") + 1) * 7) % 301).alias("b"))
    assert {r.component for r in components(links).collect()} == {0}


def test_empty_tables(spark):
    docs = empty_documents(spark)
    assert exact_dedup(docs).count() == near_dedup.near_dedup(docs).count() == keep_one(docs).count() == near_dedup.keep_one(docs).count() == 0
    assert CLASH.count(",") + 1 == len(keep_one(docs).columns)
