import numpy as np
import pytest

from strataforge.operators import ann

ROWS = "id long, embedding array<float>, list int, piece int, query int, asked int"


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def clustered(n, size, groups, seed):
    rng = np.random.default_rng(seed)
    return unit(rng.normal(size=(groups, size))[rng.integers(0, groups, n)] + 0.35 * rng.normal(size=(n, size)))


def found(spark, vectors, k, lists, asked=None):
    df = spark.createDataFrame([(i, [float(x) for x in v], 1, 2, 3, 4) for i, v in enumerate(vectors)], ROWS)
    index = ann.build(df, "id", lists=lists)
    queries = df.where("id % 100 = 0").selectExpr("id AS query_id", "embedding AS query") if asked is None else asked
    return index, ann.nearest(index, queries, k).collect()


@pytest.mark.parametrize("crowd", [20_000, 150])
def test_recall_against_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(ann, "PIECE", crowd)
    monkeypatch.setattr(ann, "BLOCK", 7)
    vectors = np.concatenate([clustered(2400, 16, 30, 1), np.tile(clustered(1, 16, 1, 2), (600, 1))]).astype(np.float32)
    index, got = found(spark, vectors, 5, 32)
    assert index.vectors().count() == 3000 and index.vectors().select("key").distinct().count() == 3000 and max(index.pieces) >= 600 // crowd
    near = unit(vectors.astype(float))
    hits = wanted = 0
    for q in range(0, 3000, 100):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 6)) and all(abs(r.score - near[q] @ near[r.key]) < 1e-4 for r in own)
        best = sorted(near @ near[q])[-5]
        hits += sum(near[q] @ near[r.key] >= best - 1e-9 for r in own)
        wanted += 5
    assert hits / wanted >= 0.9 and {(r.probes, r.recall >= 0.9) for r in got} == {(got[0].probes, True)} and got[0].probes < 32


def test_probes_widen_until_the_audit_passes(spark):
    """Vectors without any groups: few lists don't hold the neighbours, so more are probed."""
    vectors = unit(np.random.default_rng(3).normal(size=(1500, 24)))
    _, got = found(spark, vectors, 5, 32)
    assert got[0].probes > ann.FIRST and got[0].recall >= 0.9


def test_odd_vectors_and_empty_tables(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [2.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (None, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], ROWS)
    index = ann.build(df, "id")
    got = ann.nearest(index, df.selectExpr("id AS query_id", "embedding AS query"), 9)
    assert sorted((str(r.query_id), r["rank"], str(r.key), r.score) for r in got.collect() if r.query_id == 1) == [("1", 1, "1", 1.0), ("1", 2, "4", 1.0), ("1", 3, "None", 0.0)]
    assert {r.query_id for r in got.collect()} == {1, 4, None} and {r.recall for r in got.collect()} == {1.0}
    assert ann.nearest(ann.build(df.limit(0), "id"), df.selectExpr("id AS query_id", "embedding AS query"), 3).count() == 0
    with pytest.raises(ValueError, match="several sizes"):
        ann.build(spark.createDataFrame([(1, [1.0], 1, 1, 1, 1), (2, [1.0, 2.0], 1, 1, 1, 1)], ROWS), "id")


def test_centroids():
    sample = clustered(900, 8, 9, 5)
    held = ann.centroids(sample, 9)
    assert held.shape == (9, 8) and np.allclose(np.linalg.norm(held, axis=1), 1) and (sample @ held.T).max(1).mean() > 0.7
    assert len(ann.centroids(np.tile(sample[:1], (50, 1)), 8)) == 8
