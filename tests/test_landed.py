"""Landed pages: taken up in parts, out of order, twice and with gaps."""

import json
import random

import pytest

from lodestrata.sources import landed

ITEM = "id long, name string"


def land(path, name, cursor, next_, ids, **more):
    path.mkdir(exist_ok=True)
    (path / f"{name}.json").write_text(json.dumps({"cursor": cursor, "next": next_, "items": [{"id": i, "name": f"n{i}", "blob": "x" * 50} for i in ids], "noise": 1, **more}, indent=1))


def state(spark, tmp_path, first="c0"):
    landed.take(spark, str(tmp_path / "in"), str(tmp_path / "pages"), ITEM, str(tmp_path / "checkpoint"), 2).awaitTermination()
    told = landed.pages(spark, str(tmp_path / "pages"), ITEM)
    items = landed.delivered(told, first).orderBy("page", "place").collect()
    return [r.id for r in items], landed.progress(told, first)


def test_pages_are_delivered_without_gaps_or_repeats(spark, tmp_path):
    order = list(range(11))
    random.Random(4).shuffle(order)
    own = lambda k: list(range(3 * k, 3 * k + (k % 4)))  # noqa: E731  pages of none to three items
    (tmp_path / "in").mkdir()
    assert state(spark, tmp_path) == ([], (0, "c0"))
    landing = set()
    for part in (order[:4], order[4:8], order[8:]):
        for k in part:
            land(tmp_path / "in", f"page-{k}", f"c{k}", f"c{k + 1}" if k < 10 else None, own(k))
            landing.add(k)
        if 2 in landing:
            land(tmp_path / "in", f"again-{len(landing)}", "c2", "c3", own(2))  # fetched again
        reach = next(k for k in range(12) if k not in landing)
        assert state(spark, tmp_path) == ([i for k in range(reach) for i in own(k)], (reach, f"c{reach}" if reach < 11 else None))
    told = landed.pages(spark, str(tmp_path / "pages"), ITEM)
    assert told.count() == 11 and told.schema["items"].dataType.elementType.names == ["id", "name"]


def test_strays_forks_and_rings(spark, tmp_path):
    land(tmp_path / "in", "a", "c0", "c1", [1])
    land(tmp_path / "in", "b", "c1", "c2", [2])
    land(tmp_path / "in", "x", "z0", "c2", [9])  # another page that names c2: the smaller cursor's chain is followed
    land(tmp_path / "in", "c", "c2", "c0", [3])  # runs into itself
    land(tmp_path / "in", "r1", "r1", "r2", [7])
    land(tmp_path / "in", "r2", "r2", "r1", [8])  # a ring apart
    (tmp_path / "in" / "none.json").write_text('{"error": "busy"}')
    ids, (n, _) = state(spark, tmp_path)
    assert ids == [1, 2, 3] and n == 3


@pytest.mark.parametrize("n", [1, 2, 33])
def test_long_chains(spark, n):
    told = spark.createDataFrame([(f"c{k}", f"c{k + 1}", [(k, "x")]) for k in range(n)], f"cursor string, next string, items array<struct<{ITEM}>>")
    assert [(r.page, r.id) for r in landed.delivered(told, "c0").orderBy("page").collect()] == [(k, k) for k in range(n)]
    assert landed.progress(told, "c0") == (n, f"c{n}") and landed.progress(told, "c5")[0] == max(0, n - 5 if n > 5 else 0)
