"""Small tables for the operators' tests, with every odd case: nulls, empty and long texts, repeats, clashing names."""

import random

#: Columns whose names operators use inside.
CLASH = "doc_id long, text string, lang string, fp long, row long, word string, node long, n long, ids string, key int, kept boolean"


def prose(rng, n, syllables="the an er on re at en nd ti es or".split()):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def odd_documents(spark):
    rng = random.Random(5)
    base = prose(rng, 60)
    texts = [base, base, base.replace(" ", "\n ", 3), base.upper(), None, "", " \t\n", "word", "two words", "!!! 123", prose(rng, 3000), base + " extra", "é日本😀 ok", "x" * 5000]
    texts += [prose(rng, rng.randint(5, 80)) for _ in range(30)]
    rows = [(i, t, rng.choice(["en", "de", "fr", None]), None if i % 3 else i, i, "w", 1, None, "z", i % 2, None) for i, t in enumerate(texts)]
    rows += [rows[0], (None, base, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, CLASH)


def empty_documents(spark):
    return spark.createDataFrame([], CLASH)
