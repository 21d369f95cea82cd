"""Nearest neighbours against brute force in double precision."""

import numpy as np
import pytest

from prismalake.llm import neighbours

KIND = "vec_id long, embedding array<double>, label int, list long, rank string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if y is None else float(y) for y in x], 1, 2, "r") for i, x in rows], KIND).repartition(3)


def brute(rows, top=10):
    by_id = {}
    for i, x in rows:
        if i is None or x is None or not len(x) or any(y is None for y in x) or not np.isfinite(np.array(x, float)).all() or not np.any(x):
            continue
        raw = (np.array(x, "<f8") + 0.0).tobytes()
        by_id[i] = min(by_id.get(i, raw), raw)
    out = {}
    for q, raw in by_id.items():
        if q % 100 == 0:
            x = np.frombuffer(raw)
            own = sorted((float(np.sqrt(((x - np.frombuffer(y)) ** 2).sum())), i) for i, y in by_id.items() if i != q and len(y) == len(raw))
            out[q] = own[:top]
    return out


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        own = out.setdefault(r.query_id, [])
        assert r["rank"] == len(own) + 1
        own.append((r.score, r.vec_id))
    return out


def recall(got, want):
    hits = total = 0
    for q, best in want.items():
        true = {i: s for s, i in best}
        hits += sum(i in true for _, i in got.get(q, []))
        total += len(best)
    return hits / total


def test_small_odd_tables_are_exact(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.standard_normal(20).tolist()) for i in range(5, 40)] + [(0, [1.0] * 20), (100, [1.0] * 20), (100, [1.0] * 20), (200, None), (300, [0.0] * 20), (400, [None] + [1.0] * 19), (500, [float("nan")] * 20), (600, [float("inf")] * 20), (None, [1.0] * 20), (700, [1.0, 2.0, 3.0]), (41, [1.0, 2.0, 4.0]), (42, []), (800, [5.0]), (43, [1.0] * 20), (44, [1.0] * 20), (-100, [2.0] * 20), (45, [1e120] * 20), (46, [-1e120] * 20)]
    got = collected(neighbours.nearest(table(spark, rows), probe=1.0))
    want = brute(rows)
    assert set(got) == {q for q, best in want.items() if best}
    for q, own in got.items():
        assert [i for _, i in own] == [i for _, i in want[q]], q
        assert np.allclose([s for s, _ in own], [s for s, _ in want[q]], rtol=1e-12, atol=0)
    assert neighbours.nearest(table(spark, []), probe=1.0).count() == 0


def test_hot_copies_and_ties(spark):
    """A third of the rows is one vector: ties go to the smaller ids."""
    r = np.random.default_rng(2)
    rows = [(i, (np.ones(16) if i % 3 == 0 else r.standard_normal(16)).tolist()) for i in range(900)]
    got, want = collected(neighbours.nearest(table(spark, rows))), brute(rows)
    for q in range(0, 900, 300):
        assert got[q] == want[q]
    assert recall(got, want) >= 0.9


@pytest.mark.parametrize("kind", ["sphere", "clusters"])
def test_recall(spark, kind):
    r = np.random.default_rng(3)
    x = r.standard_normal((6000, 64))
    if kind == "clusters":
        x = r.standard_normal((30, 64))[r.integers(0, 30, 6000)] + 0.2 * x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = collected(neighbours.nearest(table(spark, rows))), brute(rows)
    assert set(got) == set(want) and all(len(own) == 10 for own in got.values())
    assert recall(got, want) >= 0.9
    true = {q: dict((i, s) for s, i in best) for q, best in want.items()}
    for q, own in got.items():
        assert own == sorted(own) and all(abs(s - true[q][i]) < 1e-12 for s, i in own if i in true[q])


def test_hypothesis_tests_give_up_candidates():
    """Most candidates of a list are left before the last column, and those within the limit stay."""
    r = np.random.default_rng(4)
    x = r.standard_normal((2000, 128))
    q = x[:5] + 0.01 * r.standard_normal((5, 128))
    i, j, score = neighbours.scan(q, np.full(5, -1), np.full(5, 1.0), x, np.arange(2000), neighbours.turned(128), 3)
    assert i.tolist() == list(range(5)) and j.tolist() == list(range(5))
    assert np.allclose(score, np.linalg.norm(q - x[:5], axis=1))


def test_query_recall_on_the_test_table(spark):
    import os

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = collected(neighbours.op11_nearest_neighbours(spark, sf)), brute(rows)
    assert set(got) == set(want) and recall(got, want) >= 0.9
