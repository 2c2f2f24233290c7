import numpy as np
import pytest

from tidewheel.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, rank int, v string"


def truth(rows, k, pick=lambda i: i % 20 == 0):
    out = {}
    for q, v in rows:
        if pick(q):
            near = sorted((-float(np.dot(np.float64(v), np.float64(w))), i) for i, w in rows if i != q)
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in out.values())
    return {q: [x[i] for i in sorted(x)] for q, x in out.items()}


def test_groups_of_leaves():
    counts = np.array([5, 4, 0, 30, 2, 2, 9, 10])
    group, parts = neighbours.grouped(counts, 10)
    assert group.tolist() == [0, 0, 0, 1, 2, 2, 3, 4] and parts.tolist() == [1, 3, 1, 1, 1]
    assert all(counts[group == g].sum() <= 10 * p for g, p in enumerate(parts))


@pytest.mark.parametrize("size", [None, 48])
def test_recall_on_clusters_and_noise(spark, monkeypatch, size):
    """Whole, and with leaves and their queries cut into small parts."""
    if size:
        monkeypatch.setattr(neighbours, "X_BLOCK", size)
        monkeypatch.setattr(neighbours, "Q_BLOCK", 16)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16)) * 3
    v = np.concatenate([centres[rng.integers(20, size=3000)] + rng.normal(size=(3000, 16)), rng.normal(size=(1000, 16))]).astype(np.float32)
    rows = [(i, x) for i, x in enumerate(v)]
    df = spark.createDataFrame([(i, x.tolist(), 0, "x") for i, x in rows], SCHEMA).repartition(4)
    got, want = found(neighbours.search(df, leaf_rows=100)), truth(rows, 20)
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    for q, near in got.items():
        assert [s for _, s in near] == sorted((s for _, s in near), reverse=True)
        for i, s in near:
            assert s == pytest.approx(float(np.dot(np.float64(v[q]), np.float64(v[i]))), abs=1e-9)


def test_odd_vectors_ties_and_a_very_common_one(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(0, 90)] + [(200, [0.0, 1.0]), (201, [0.0, -1.0])]
    odd = [(300, None), (320, []), (340, [0.0, 0.0]), (360, [nan, 1.0]), (380, [inf, 1.0]), (400, [None, 1.0]), (420, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows + odd], SCHEMA).repartition(3)
    assert found(neighbours.search(df)) == {q: [(i, s) for i, s in near] for q, near in truth(rows, 20).items()}


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 0, ""), (5, [2.0, 1.0], 0, "")], SCHEMA)
    assert found(neighbours.search(df)) == {0: [(5, 4.0)]}
    assert neighbours.search(df.where("vec_id < 0")).count() == 0
    assert neighbours.search(df.where("vec_id = 0")).count() == 0
