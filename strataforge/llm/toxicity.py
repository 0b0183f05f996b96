"""Toxicity by a counterfactual-regularised classifier.

Logistic regression over the words of a text and the beginnings of its words. Labelled sentences that mention a group are
copied with the identity term swapped for other ones and for none; the squared change of the score between a sentence and
its copy is penalised, so that a group's name alone moves no score and neutral mentions aren't false positives.

The classifier learns from a bounded sample of the labelled rows (``POSITIVES`` and ``NEGATIVES`` documents, ``SENTENCES``
sentences that mention a group, ``PAIRS`` pairs with a copy, the smallest seeded hashes); everything else reads all rows. Weights go to the tasks: at
most ``FEATURES`` of them. Where no labelled sentence mentions a group, nothing is swapped, and what remains is logistic
regression.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bounds of the labelled sample, of the weights, and documents that must hold a feature; swaps of a term, besides none.
POSITIVES, NEGATIVES, SENTENCES, FEATURES, SUPPORT, SWAPS = 4000, 8000, 8192, 4096, 4, 4
#: Pairs of a sentence and its copy that are learned from, by hash, and words of a sentence: a longer one is cut into some.
PAIRS, SENTENCE_WORDS = 32_768, 128
#: Groups that texts mention neutrally; swapped for one another.
IDENTITY_TERMS = (
    "women", "men", "woman", "man", "girls", "boys", "female", "male", "transgender", "gay", "lesbian", "bisexual", "queer",
    "straight", "heterosexual", "homosexual", "muslim", "muslims", "islam", "christian", "christians", "catholic", "jewish",
    "jews", "hindu", "buddhist", "atheist", "black", "white", "asian", "african", "latino", "hispanic", "european", "american",
    "mexican", "chinese", "indian", "arab", "immigrant", "immigrants", "refugee", "refugees", "migrants", "deaf", "blind",
    "disabled", "autistic", "elderly", "young", "old", "teenagers", "frauen", "männer", "juden", "muslime", "christen",
    "femmes", "hommes", "juifs", "musulmans", "mujeres", "hombres", "judíos", "musulmanes",
)
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def features(text: str | None) -> set[str]:
    """Distinct lower-case words, and their first four and five letters (marked by a trailing ``*``)."""
    words = set(_WORD.findall(text.lower())) if text else set()
    return words | {w[:4] + "*" for w in words if len(w) > 4} | {w[:5] + "*" for w in words if len(w) > 5}


def mentioning(text: str | None, terms: frozenset[str]) -> list[str]:
    """The sentences of a text in which an identity term stands, lower-case; of one of very many words the runs that hold one."""
    low = (text or "").lower()
    if not terms & set(_WORD.findall(low)):
        return []
    out = []
    for s in _SENTENCE.split(low):
        words = s.split()
        runs = [s] if len(words) <= SENTENCE_WORDS else [" ".join(words[i : i + SENTENCE_WORDS]) for i in range(0, len(words), SENTENCE_WORDS)]
        out += [r for r in runs if terms & set(_WORD.findall(r))]
    return out


def swapped(sentence: str, terms: frozenset[str], swaps: int = SWAPS) -> list[str]:
    """Copies of a sentence: each of its identity terms, in turn, swapped for ``swaps`` seeded others and left out."""
    out, others = [], sorted(terms)
    for t in sorted(terms & set(_WORD.findall(sentence))):
        start = zlib.crc32(f"{t} {sentence}".encode("utf-8", "replace"))
        new = [others[(start + i) % len(others)] for i in range(min(swaps + 1, len(others)))]
        out += [_WORD.sub(lambda m, t=t, n=n: n if m[0] == t else m[0], sentence) for n in [*[x for x in new if x != t][:swaps], ""]]
    return out


class Classifier:
    """names: features with a weight; score: 0 to 1."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str | None) -> float:
        words = set(_WORD.findall(text.lower())) if text else ()
        w = self.weights
        found = {x for x in words if x in w}
        found.update(x for x in {v[:4] + "*" for v in words if len(v) > 4} if x in w)
        found.update(x for x in {v[:5] + "*" for v in words if len(v) > 5} if x in w)
        z = self.bias + sum(w[x] for x in sorted(found))
        return float(1 / (1 + np.exp(-min(max(z, -30), 30))))


class Objective:
    """Weighted log loss of the documents and ``fairness`` times the mean squared change of the score in the swapped pairs."""

    def __init__(self, size: int, rows: list[np.ndarray], labels: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], fairness: float):
        n1, n0 = labels.sum(), (1 - labels).sum()
        self.size, self.labels, self.weight = size, labels, np.where(labels == 1, 0.5 / max(n1, 1), 0.5 / max(n0, 1))
        self.rows, self.sides = self._flat(rows), [self._flat([p[i] for p in pairs]) for i in (0, 1)]
        self.pull = fairness / max(len(pairs), 1)

    @staticmethod
    def _flat(rows):
        sizes = np.array([len(i) for i in rows], np.int64)
        return np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(rows)), sizes), len(rows)

    def _score(self, side, w, b):
        flat, of, n = side
        return 1 / (1 + np.exp(-np.clip(np.bincount(of, w[flat], n) + b, -30, 30)))

    def _spread(self, side, err):
        return np.bincount(side[0], err[side[1]], self.size)

    def __call__(self, w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
        """Value and gradient."""
        p = np.clip(self._score(self.rows, w, b), 1e-12, 1 - 1e-12)
        value = -(self.weight * (self.labels * np.log(p) + (1 - self.labels) * np.log(1 - p))).sum()
        err = (p - self.labels) * self.weight
        grad, at = self._spread(self.rows, err), err.sum()
        if self.sides[0][2]:
            a, c = (self._score(s, w, b) for s in self.sides)
            value += self.pull * ((a - c) ** 2).sum()
            for side, q, sign in ((self.sides[0], a, 1), (self.sides[1], c, -1)):
                err = 2 * self.pull * sign * (a - c) * q * (1 - q)
                grad, at = grad + self._spread(side, err), at + err.sum()
        return value, grad, at


def train(names: list[str], rows: list[np.ndarray], labels: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], prior: float, fairness: float = 20.0, rounds: int = 100, l1: float = 2e-4) -> Classifier:
    """Proximal gradient with momentum. rows: places in ``names`` of a document's features; pairs: those of a sentence and
    of its swapped copy; prior: share of toxic rows in all labels."""
    if len(rows) == 0 or labels.min() == labels.max():
        p = (labels.sum() + 0.5) / (len(labels) + 2) if len(rows) else 0.25
        return Classifier({}, float(np.log(p / (1 - p))))
    goal = Objective(len(names), rows, labels, pairs, fairness)
    w, b = np.zeros(len(names)), 0.0
    v, vb = w.copy(), b
    flat, of, _ = goal.rows
    rate = 4.0 / (np.bincount(flat, goal.weight[of], len(names)).max(initial=0) * max(np.median([len(i) for i in rows]), 1) + 1)
    for k in range(rounds):
        value, grad, at = goal(v, vb)
        for _ in range(30):  # the penalty makes the slope steeper where it acts: shorter steps there
            new, nb = np.sign(v - rate * grad) * np.maximum(np.abs(v - rate * grad) - rate * l1, 0), vb - rate * at
            step, bias = new - v, nb - vb
            if not pairs or goal(new, nb)[0] <= value + grad @ step + at * bias + (step @ step + bias * bias) / (2 * rate) + 1e-12:
                break
            rate /= 2
        momentum = k / (k + 3)
        v, vb = new + momentum * (new - w), nb + momentum * (nb - b)
        w, b = new, nb
    shift = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))) * 0.5
    return Classifier({f: float(x) for f, x in zip(names, w, strict=True) if x}, float(b + shift))


def _read(terms: frozenset[str]):
    def run(batches):
        for b in batches:
            for part in common.slices(b["text"]):
                texts = b["text"].iloc[part]
                yield pd.DataFrame({"k": b["k"].iloc[part], "y": b["y"].iloc[part], "names": [sorted(features(t)) for t in texts], "sentences": [mentioning(t, terms) for t in texts]})

    return run


def _placed(names: list[str]):
    place = {f: i for i, f in enumerate(names)}

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "y": b["y"], "i": [sorted(place[f] for f in fs if f in place) for fs in b["names"]]})

    return run


def _paired(names: list[str], terms: frozenset[str]):
    place = {f: i for i, f in enumerate(names)}
    of = lambda s: sorted(place[f] for f in features(s) if f in place)

    def run(batches):
        for b in batches:
            pairs = [(x, y) for s in b["s"] for t in swapped(s, terms) if (x := of(s)) != (y := of(t))]
            yield pd.DataFrame({c: pd.Series([p[i] for p in pairs], dtype=object) for i, c in enumerate("ij")})

    return run


def score_documents(docs: DataFrame, labels: DataFrame, learn_from, held_out, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", groups: Sequence[str] = IDENTITY_TERMS, seed: int = 11) -> DataFrame:
    """doc_id, held_out, score, predicted of every document. learn_from: condition on the id column of ``labels``; groups:
    the identity terms, lower-case words.

    Defined cases: null and empty texts have no features; an id labelled more than once is toxic if one label says so; of
    rows that share a labelled id, the one with the smallest text hash is learned from; a label that is neither 0 nor 1,
    or whose id is null or has no document, is not learned from; without labels of both kinds all scores are the share of
    toxic labels, and 0.25 without any; repeated rows are scored each; an empty table gives an empty result; other columns
    are ignored.
    """
    terms = frozenset(groups)
    known = labels.where(learn_from & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("k")).agg(F.max(label_col).cast("int").alias("y"))
    known = known.withColumn("h", F.xxhash64(F.col("k").cast("string"), F.lit(seed)))
    totals = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    sample = [known.where(F.col("y") == y).orderBy("h", "k").limit(n) for y, n in ((1, POSITIVES), (0, NEGATIVES))]
    picked = sample[0].unionByName(sample[1]).select("k", "y")  # at most POSITIVES + NEGATIVES rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), F.col("id") == F.col("k"))
    texts = texts.groupBy("k", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("k", "y", "t.text")
    seen = common.materialise(texts.mapInPandas(_read(terms), "k long, y int, names array<string>, sentences array<string>"), "toxicity-sample")
    n1, n0 = ((seen.where(F.col("y") == y).count()) for y in (1, 0))
    # the features with the most evidence: difference of their shares in toxic and other documents, and their number
    tally = seen.select("y", F.explode("names").alias("f")).groupBy("f").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where(F.col("a") + F.col("b") >= SUPPORT)
    evidence = F.abs(F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))) * F.sqrt(F.least(F.col("a") + F.col("b"), F.lit(400)))
    names = [r.f for r in tally.select("f", F.round(evidence, 9).alias("e")).orderBy(F.desc("e"), "f").limit(FEATURES).collect()]
    held = seen.select("k", "y", "names").mapInPandas(_placed(names), "k long, y int, i array<int>").toPandas().sort_values("k")
    spoken = seen.select(F.explode("sentences").alias("s")).distinct().orderBy(F.xxhash64("s", F.lit(seed)), "s").limit(SENTENCES)
    pairs = spoken.mapInPandas(_paired(names, terms), "i array<int>, j array<int>").orderBy(F.xxhash64("i", "j", F.lit(seed)), "i", "j").limit(PAIRS)
    pairs = pairs.toPandas().sort_values(["i", "j"], key=lambda c: c.map(tuple))
    n = sum(totals.values())
    index = lambda c: [np.asarray(i, np.int64) for i in c]
    model = train(names, index(held["i"]), held["y"].to_numpy(np.float64), list(zip(index(pairs["i"]), index(pairs["j"]), strict=True)), totals.get(1, 0) / n if n else 0.25)

    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype=float)

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.pandas_udf(score, "double")(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))


def op5_toxicity(spark, sf_dir):
    rest = common.crc_mod("doc_id", 5)
    return score_documents(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), rest != 0, rest == 0)
