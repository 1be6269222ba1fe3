import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from lodestrata.llm import chat, fingerprint, pieces

from .common import empty_documents, odd_documents, prose


@pytest.mark.parametrize("text", ["", "<|end|>", "<\\|end|>", "</s>[INST] ok [/INST]", "<<|turn|>", "a<", "[\\\\INST]", "<|text|><|text|>", "\n<s>\n"])
def test_escape_is_reversible_and_hides_control_strings(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text and not any(c in safe for c in (chat.TURN, chat.TEXT, chat.STOP, "</s>", "<s>", "[INST]", "[/INST]"))
    assert chat.WRITTEN.findall(chat.write_turn(text, text)) == [(safe, safe)]


def conversations(spark):
    rng = random.Random(1)
    shared = [("system", "be kind"), ("user", "hello <|end|>")]
    rows = []
    for c in range(40):
        own = shared[: rng.randint(0, 2)] + [(rng.choice(["user", "assistant"]), rng.choice(["yes", "no", prose(rng, 5)])) for _ in range(rng.randint(1, 5))]
        rows += [(c, t, role, text, "x") for t, (role, text) in enumerate(own)]
    rows += [(100, None, None, None, None), (None, 1, "assistant", "", None), (101, 3, "user", "a", "x"), (101, 3, "assistant", "b", "x"), (101, 3, "assistant", "b", "x")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string")


def check_tree(spark, rows):
    told = chat.turns(rows).cache()
    tree = chat.prefix_tree(told).cache()
    nodes = {bytes(r.node): r for r in tree.collect()}
    assert len(nodes) == tree.count()
    assert sorted(r.offset for r in nodes.values()) == np.r_[0, np.cumsum([r["size"] for r in sorted(nodes.values(), key=lambda r: r.offset)])[:-1]].tolist()
    by_conv: dict = {}
    for r in sorted(told.collect(), key=lambda r: r.place):
        by_conv.setdefault(r.conv_id, []).append(r)
    for own in by_conv.values():
        spans = []
        for r in own:
            n = nodes[bytes(r.node)]
            assert [(s.start, s.end) for s in n.attends] == chat._merged(spans) and n.position == sum(b - a for a, b in spans) and n.depth == r.place
            spans.append((n.offset, n.offset + n["size"]))
    back = {r.conv_id: r for r in chat.read_back(told, tree).collect()}
    rows = rows.collect()
    for c in {r.conv_id for r in rows}:
        own = sorted(((-1 if r.turn is None else r.turn, r.role or "", r.text or "") for r in rows if r.conv_id == c))
        assert back[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in own).encode()).hexdigest()
        assert back[c].loss_sha256 == hashlib.sha256("".join(t for _, a, t in own if a == "assistant").encode()).hexdigest() and back[c].n_turns == len(own)
        sizes = [len(chat.write_turn(a, t)) for _, a, t in own]
        assert back[c].formatted_chars == sum(sizes) and back[c].position_sum == sum(sum(sizes[:i]) for i in range(len(sizes)))
    return told, tree


def test_tree_reads_back_and_attends_to_ancestors(spark):
    check_tree(spark, conversations(spark))


@pytest.mark.parametrize("seed", range(3))
def test_trees_of_long_chains_that_branch_late(spark, seed):
    rng = random.Random(seed)
    trunk = [(rng.choice(["user", "assistant"]), prose(rng, rng.randint(1, 40))) for _ in range(60)]
    rows = []
    for c in range(40):
        own = trunk[: rng.choice([0, 5, 30, 60])] + [("user", rng.choice("abc")) for _ in range(rng.randint(1, 6))]
        rows += [(c, t, role, text) for t, (role, text) in enumerate(own)]
    told, tree = check_tree(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    tokens = chat.tokens(tree).orderBy("offset").collect()
    stream = "".join(r.written for r in tree.orderBy("offset").collect())
    assert "".join(t.token for t in tokens) == stream and [t.offset for t in tokens] == list(range(len(stream)))
    for r in tree.limit(20).collect():
        assert [t.position for t in tokens[r.offset : r.offset + r["size"]]] == list(range(r.position, r.position + r["size"]))


def test_reading_back_depends_on_the_intervals(spark):
    told = chat.turns(conversations(spark)).cache()
    tree = chat.prefix_tree(told).cache()
    good = {r.conv_id: r.turns_sha256 for r in chat.read_back(told, tree).collect()}
    worse = chat.read_back(told, tree.withColumn("attends", F.slice("attends", 1, F.greatest(F.size("attends") - 1, F.lit(0))))).collect()
    several = {r.conv_id for r in told.groupBy("conv_id").count().where("count > 1").collect()}
    assert all((good[r.conv_id] != r.turns_sha256) == (r.conv_id in several) for r in worse)


def test_tree_of_nothing(spark):
    told = chat.turns(conversations(spark).where("false"))
    assert chat.read_back(told, chat.prefix_tree(told)).count() == 0


def test_pieces_are_the_librarys(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    encoder = pieces.Encoder(pieces.Vocabulary())
    rng = random.Random(3)
    alphabet = [*"abcdeithe  \n\t▁.,'é中文日本的0123😀<s>Ωж\x00", "  ", "ing", "tion", "http://", " " * 19, prose(rng, 20)]
    texts = ["", "".join(alphabet) * 50] + ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(400)]
    assert all(list(found) == model.encode(t) for found, t in zip(encoder.encode(texts), texts, strict=True))
    docs = odd_documents(spark)
    found = pieces.encode(docs, decoded_into="decoded")
    assert found.columns == [*(c for c in docs.columns if c != "ids"), "ids", "decoded"] and found.where(~(F.col("decoded") == F.coalesce("text", F.lit("")))).count() == 0
    assert pieces.decode(found.drop("decoded")).where(~(F.col("decoded") == F.coalesce("text", F.lit("")))).count() == 0
    assert pieces.encode(empty_documents(spark)).count() == 0


def test_fingerprints_of_edits_against_brute_force(spark):
    docs = odd_documents(spark)
    rows = sorted(((fingerprint.LEAST if r.doc_id is None else r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (-r[0], r[1]))
    expect = []
    for i, (d, t) in enumerate(rows):
        changed = fingerprint.edited(t, rows[(i + 1) % len(rows)][1])
        fp = fingerprint.weighted_simhash([t, changed, rows[(i + 1) % len(rows)][1]]).view(np.int64).tolist()
        expect.append((str(None if d == fingerprint.LEAST else d), len(t), hashlib.sha256(changed.encode()).hexdigest(), *fp))
    found = [(str(r.doc_id), *r[1:]) for r in fingerprint.fingerprints_of_edits(docs).collect()]
    assert sorted(found) == sorted(expect)
    assert fingerprint.edited("abcde", "xyz") == "abcxy" and fingerprint.edited("abcd", "x") == "abx"
    assert fingerprint.fingerprints_of_edits(empty_documents(spark)).count() == 0


def test_block_tables_find_all_within_the_radius(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(-(1 << 63), 1 << 63 - 1, 40)
    fps = np.unique(np.r_[base, [b ^ sum(1 << int(x) for x in rng.choice(63, k, replace=False)) for b in base for k in (1, 3, 4)]])
    prints = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    found = {(r.query_fp, r.fp) for r in fingerprint.within(prints.where("fp % 2 = 0"), prints, 3).collect()}
    u = fps.view(np.uint64)
    assert found == {(int(fps[i]), int(fps[j])) for i in range(len(fps)) if fps[i] % 2 == 0 for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= 3)}
