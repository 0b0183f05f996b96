"""Gradients of the field against differences, and what order along the curve gives."""

import itertools
import zlib

import numpy as np

from strataforge.llm import language_id, packing


def partition(emit, trans, start):
    """log of the sum over all labellings, and the score of each."""
    n, k = emit.shape
    scores = {}
    for path in itertools.product(range(k), repeat=n):
        scores[path] = start[path[0]] + sum(emit[i, y] for i, y in enumerate(path)) + sum(trans[a, b] for a, b in itertools.pairwise(path))
    top = max(scores.values())
    return top + np.log(sum(np.exp(s - top) for s in scores.values())), scores


def test_gradient_of_a_training_step_equals_differences():
    """What a step subtracts from the gold counts is the derivative of the log-likelihood, over segments of one text too."""
    rng = np.random.default_rng(2)
    for n, k, length in ((1, 2, 4), (5, 3, 2), (6, 2, 4), (7, 3, 3)):
        emit, trans, start = rng.normal(size=(n, k)), rng.normal(size=(k, k)), rng.normal(size=k)
        gold = tuple(rng.integers(0, k, n))
        words, _, number = language_id._laid_out([np.arange(n)], length)
        mask = words >= 0
        marginal, pairs = language_id.forward_backward(np.where(mask[:, :, None], emit[words], 0), trans, start, mask, number)
        got = marginal[mask]
        got[np.arange(n), gold] -= 1
        for a, b in itertools.pairwise(gold):
            pairs[a, b] -= 1

        def loss(e, t, s, gold=gold):
            log_z, scores = partition(e, t, s)
            return log_z - scores[gold]

        h = 1e-5
        for array, grad in ((emit, got), (trans, pairs), (start, got[0])):
            for at in np.ndindex(array.shape):
                up, down = (np.array(array) for _ in range(2))
                up[at] += h
                down[at] -= h
                put = lambda x: [x if a is array else a for a in (emit, trans, start)]  # noqa: B023, E731
                assert abs((loss(*put(up)) - loss(*put(down))) / (2 * h) - grad[at]) < 1e-6


def test_training_lowers_the_loss_of_its_own_texts():
    docs = [("de", "der die und das nicht mit einer der und die " * 6), ("en", "the of and that with this the and of that " * 6), ("fr", "le la et des une dans pour le et la des " * 6)] * 4
    field = language_id.train(docs)
    assert [x[0] for x in field.predict([t for _, t in docs])] == [lang for lang, _ in docs]
    mixed = field.predict(["der die und das nicht mit einer the of"])[0]
    assert mixed[0] == "de" and 0.5 < mixed[1] < 1


def test_neighbours_in_sequences_are_alike(spark):
    """Documents that follow one another along the curve share more words than documents in another order."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    pieces = packing.pack_documents(docs).where("start = 0").orderBy("sequence_id", "offset").collect()
    order = [r.doc_id for r in pieces]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(order) == sorted(texts)
    vectors = np.zeros((len(order), 4096))
    for i, d in enumerate(order):
        for w in (texts[d] or "").lower().split():
            vectors[i, zlib.crc32(w.encode()) % 4096] += 1
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = vectors / np.where(norm > 0, norm, 1)
    along = (vectors[1:] * vectors[:-1]).sum(1).mean()
    chance = vectors[np.random.default_rng(0).permutation(len(order))]
    other = (chance[1:] * chance[:-1]).sum(1).mean()
    print(along, other)
    assert along > 1.5 * other
