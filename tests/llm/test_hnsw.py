import numpy as np
import pytest

from strataforge.llm import hnsw


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def crowd(lone, groups, size, seed):
    """Lone vectors and tight groups, shuffled."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal(size=(lone, size))] + [rng.normal(size=(1, size)) + 0.02 * rng.normal(size=(n, size)) for n in groups]
    return unit(rng.permutation(np.concatenate(parts)))


@pytest.mark.parametrize("groups", [(200,), (33,), (40, 200, 700)])
def test_crowded_vectors_are_linked_by_the_graph(monkeypatch, groups):
    x = crowd(2500, groups, 64, len(groups))
    monkeypatch.setattr(hnsw, "_scan", lambda *a: pytest.fail("compared with the whole shard"))
    near = x @ x.T >= 0.98
    np.fill_diagonal(near, False)
    q, m = hnsw.search_shard(hnsw.Graph(x), x, x, 0.98, np.arange(len(x)))
    found = np.zeros_like(near)
    found[q, m] = True
    np.fill_diagonal(found, False)
    assert near.sum() >= sum(n * (n - 1) for n in groups) * 0.99
    assert not (found & ~near).any() and (found | found.T)[near].mean() > 0.999 and found[near].mean() > 0.98


def test_a_shard_of_partners_only():
    """The beam grows to the shard's size, where it is a comparison with all."""
    x = crowd(0, (300,), 32, 9)
    near = x @ x.T >= 0.98
    q, m = hnsw.search_shard(hnsw.Graph(x), x, x, 0.98, np.arange(len(x)))
    assert len(set(zip(q.tolist(), m.tolist())) - {(i, i) for i in range(len(x))}) == near.sum() - len(x)


@pytest.mark.parametrize("shard", [40, 90, 130, 1000])
def test_shards_in_a_ring(spark, monkeypatch, shard):
    """Every pair of shards of a label is searched once, whether their number is odd or even."""
    monkeypatch.setattr(hnsw, "SHARD", shard)
    x = crowd(150, (60, 30, 9, 2, 2, 2), 24, 4)
    labels = [1] * 200 + [2] * (len(x) - 200)
    df = spark.createDataFrame([(i, v.tolist(), label) for i, (v, label) in enumerate(zip(x, labels, strict=True))], "vec_id long, embedding array<double>, label int")
    got = hnsw.near_duplicates(df).toPandas().set_index("vec_id").sort_index()
    near = (x @ x.T >= 0.98) & (np.array(labels)[:, None] == np.array(labels)[None])
    np.fill_diagonal(near, False)
    reach = near | np.eye(len(x), dtype=bool)
    for _ in range(6):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    assert got.n_links.tolist() == near.sum(1).tolist() and got.component_id.tolist() == reach.argmax(1).tolist()
