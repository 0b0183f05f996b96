"""Language identification by a linear-chain conditional random field over words.

Each word of a text gets a language, so code-switched texts fall into their parts. Features of a word are its affixes, its
character trigrams, itself, and the languages in whose lexicon it stands; transitions between neighbouring words are
learned. Forward-backward gives each word's language distribution; a text's language is the one with most of it.

A text is one chain, however long. It is worked through in segments of CHAIN words side by side; the product of a
segment's transitions and features carries the messages over it, so that a word hears of all others. With many languages,
where such products would cost too much, chains run uncut.

The field learns from a bounded sample of labelled documents, whole texts: ``PER_LANGUAGE`` documents a language, fewer
where ``DOCUMENTS`` in all would be passed (two at least), of ``WORDS`` words a language in all (one document at least),
the smallest seeded hashes, one row an id. All languages are learned. Pieces of training texts are spliced into others, so
that transitions see switches.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

PER_LANGUAGE, DOCUMENTS, WORDS, PIECE, CHAIN = 250, 3000, 400_000, 32, 64
#: Languages up to which segments are joined by products; numbers (words times languages) worked through at once; words of
#: a training step; training steps, at least (each word is seen twice, or more).
FEW, AREA, STEP, STEPS = 16, 800_000, 32_000, 40
#: Hashed features and words of a language's lexicon; words whose scores a task remembers.
WIDTH, LEXICON, REMEMBERED = 1 << 15, 400, 150_000


#: ASCII characters that stand in no word: all but letters and the apostrophe.
_APART = bytes(b if b > 127 or chr(b).isalpha() or b == 39 else 32 for b in range(256))


def split(text: str | None) -> list[bytes]:
    """Lower-case words as UTF-8: runs of ASCII letters, apostrophes and characters beyond ASCII."""
    return text.lower().encode("utf-8", "replace").translate(_APART).split() if text else []


def word_features(word: bytes) -> list[int]:
    """Hashed affixes to three letters, trigrams, and the word."""
    w = word.decode("utf-8", "replace")
    marked = f"^{w}$"
    names = [f"p{w[:k]}" for k in (1, 2, 3)] + [f"s{w[-k:]}" for k in (1, 2, 3)] + [marked]
    names += [marked[i : i + 3] for i in range(len(marked) - 2)]
    return sorted({zlib.crc32(n.encode("utf-8", "replace")) % WIDTH for n in names})


def _normal(x: np.ndarray) -> np.ndarray:
    return x / x.sum(-1, keepdims=True)


def _boundaries(e, mask, t, s, number):
    """Messages into each segment from what stands before it and after it, of segments in order, ``number`` in their text."""
    n, length, k = e.shape
    before, after = np.ones((n, k)), np.ones((n, k))
    follows = np.flatnonzero(number > 0)
    if not len(follows):
        return before, after
    product = np.broadcast_to(np.eye(k), (len(follows), k, k))
    for i in range(length):
        new = (product @ t) * e[follows, i][:, None, :]
        new = new / new.max((1, 2), keepdims=True)
        product = new if mask[follows, i].all() else np.where(mask[follows, i, None, None], new, product)
    heads = follows[number[follows] == 1] - 1
    a = _normal(s * e[heads, 0])
    for i in range(1, length):
        a = _normal((a @ t) * e[heads, i])
    before[heads + 1] = a
    place = np.full(n, -1)
    place[follows] = np.arange(len(follows))
    order = follows[np.argsort(number[follows], kind="stable")]
    steps = np.split(order, np.flatnonzero(np.diff(number[order])) + 1)
    for rows in steps[1:]:
        before[rows] = _normal(np.einsum("na,nab->nb", before[rows - 1], product[place[rows - 1]]))
    for rows in steps[::-1]:
        after[rows - 1] = _normal(np.einsum("nab,nb->na", product[place[rows]], after[rows]))
    return before, after


def forward_backward(emit: np.ndarray, trans: np.ndarray, start: np.ndarray, mask: np.ndarray, number: np.ndarray | None = None, pairs: bool = True):
    """emit (segments, words, labels), mask (segments, words) -> marginals, expected transitions.

    number: of a segment in its text, from 0; segments of a text follow one another. Without it each is a text.
    """
    e = np.exp(emit - emit.max(2, keepdims=True))
    t, s = np.exp(trans), np.exp(start)
    n, length, k = e.shape
    number = np.zeros(n, np.int64) if number is None else number
    before, after = _boundaries(e, mask, t, s, number)
    alpha, beta = np.empty_like(e), np.empty_like(e)
    alpha[:, 0] = _normal(np.where(number[:, None] > 0, before @ t, s) * e[:, 0])
    whole = mask.all(0)
    for i in range(1, length):
        a = _normal((alpha[:, i - 1] @ t) * e[:, i])
        alpha[:, i] = a if whole[i] else np.where(mask[:, i, None], a, alpha[:, i - 1])
    beta[:, length - 1] = after
    pair = np.zeros((k, k))
    for i in range(length - 2, -1, -1):
        ahead = e[:, i + 1] * beta[:, i + 1]
        if pairs:
            total = ((alpha[:, i] @ t) * ahead).sum(1)
            pair += t * ((alpha[:, i] * (mask[:, i + 1] / total)[:, None]).T @ ahead)
        b = _normal(ahead @ t.T)
        beta[:, i] = b if whole[i + 1] else np.where(mask[:, i + 1, None], b, after)
    later = number > 0
    if pairs and later.any():
        ahead = e[later, 0] * beta[later, 0]
        total = ((before[later] @ t) * ahead).sum(1)
        pair += t * ((before[later] / total[:, None]).T @ ahead)
    return _normal(alpha * beta), pair


def _laid_out(ids: list[np.ndarray], length: int):
    """Texts as segments of ``length`` words -> words (-1: none), text of each segment, its number in the text."""
    sizes = np.array([len(i) for i in ids])
    per = -(-sizes // length)
    words = np.full((int(per.sum()), length), -1, np.int64)
    first = np.cumsum(per) - per
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first * length, sizes)
    words.reshape(-1)[place] = np.concatenate(ids) if len(ids) else 0
    text = np.repeat(np.arange(len(ids)), per)
    return words, text, np.arange(len(text)) - first[text]


def _sums(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of ``values`` by their number in ``of``."""
    out = np.zeros((n, values.shape[1]))
    if len(of):
        order = np.argsort(of, kind="stable")
        begins = np.flatnonzero(np.concatenate([[True], np.diff(of[order]) > 0]))
        out[of[order][begins]] = np.add.reduceat(values[order], begins)
    return out


def _groups(sizes: np.ndarray, labels: int):
    """(places, segment length) of texts that are worked through together; texts without words are in none."""
    if labels <= FEW:
        order = np.flatnonzero(sizes)
        length = np.full(len(order), CHAIN)
        area = -(-sizes[order] // CHAIN) * CHAIN * labels
    else:  # uncut; texts of like length together
        order = np.argsort(sizes, kind="stable")[(sizes == 0).sum() :]
        length = 1 << np.ceil(np.log2(np.maximum(sizes[order], 1))).astype(np.int64)
        area = length * labels
    begin, held = 0, 0
    for i in range(len(order)):
        if i > begin and (held + area[i] > AREA or length[i] != length[begin]):
            yield order[begin:i], int(min(length[begin], sizes[order[begin:i]].max()) if labels > FEW else CHAIN)
            begin, held = i, 0
        held += area[i]
    if len(order):
        yield order[begin:], int(min(length[begin], sizes[order[begin:]].max()) if labels > FEW else CHAIN)


class Field:
    """A trained field: labels, feature weights, lexicons, transitions and starts."""

    def __init__(self, labels, weights, lexicon, lexicon_weights, trans, start):
        self.labels, self.weights, self.lexicon, self.lexicon_weights, self.trans, self.start = labels, weights, lexicon, lexicon_weights, trans, start

    def _emit(self, words: list[bytes]) -> np.ndarray:
        lists = [word_features(w) for w in words]
        sizes = np.array([len(x) for x in lists])
        flat = np.fromiter((f for x in lists for f in x), np.int64, sizes.sum())
        out = np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes)
        known = np.array([self.lexicon.get(w, -1) for w in words])
        return out + np.where(known[:, None] >= 0, self.lexicon_weights[known], 0)

    def predict(self, texts) -> list[tuple[str, float]]:
        """(language, mean probability of it over the words with letters); ``und``, 0 without a letter."""
        held = self.__dict__.setdefault("_held", defaultdict())
        if len(held) > REMEMBERED:
            held.clear()
        held.default_factory = held.__len__
        if not held:
            self._table = np.zeros((0, len(self.labels)), np.float32)
        ids = [np.fromiter(map(held.__getitem__, split(t)), np.int64) for t in texts]
        if len(held) > len(self._table):
            new = list(held)[len(self._table) :]
            self._table = np.concatenate([self._table, self._emit(new).astype(np.float32)])
            lettered = np.array([any(c.isalpha() for c in w.decode("utf-8", "replace")) for w in new])
            self._letters = np.concatenate([self._letters, lettered]) if len(self._table) > len(new) else lettered
        out = [("und", 0.0)] * len(ids)
        if not self.labels or not held:
            return out
        for places, length in _groups(np.array([len(i) for i in ids]), len(self.labels)):
            for i, found in zip(places, self._some([ids[i] for i in places], length), strict=True):
                out[i] = found
        return out

    def _some(self, ids, length: int) -> list[tuple[str, float]]:
        words, text, number = _laid_out(ids, length)
        mask = words >= 0
        marginal, _ = forward_backward(self._table[words].astype(np.float64), self.trans, self.start, mask, number, pairs=False)
        counts = (mask & self._letters[words])[:, :, None]
        per_segment = np.concatenate([(marginal * counts).sum(1), counts.sum(1)], 1)
        sums = np.stack([np.bincount(text, per_segment[:, c], len(ids)) for c in range(per_segment.shape[1])], 1)
        n = sums[:, -1]
        share = sums[:, :-1] / np.maximum(n, 1)[:, None]
        best = share.argmax(1)
        return [(self.labels[b], float(min(max(share[i, b], 0.0), 1.0))) if n[i] else ("und", 0.0) for i, b in enumerate(best)]


def spliced(texts: list[tuple[int, list]], rng) -> list[tuple[list, list[int]]]:
    """Chains (words, labels) that hold every word of the texts once: the tails of two texts change places now and then, at
    the ends of pieces."""
    order, out = rng.permutation(len(texts)), []
    for x, y in zip(order[::2], [*order[1::2], None], strict=False):
        a, left = texts[x]
        b, right = texts[y] if y is not None else (a, [])
        one, two = ([], []), ([], [])
        for at in range(0, max(len(left), len(right)), PIECE):
            if rng.random() < 0.25:
                one, two = two, one
            for (words, gold), part, label in ((one, left[at : at + PIECE], a), (two, right[at : at + PIECE], b)):
                words += part
                gold += [label] * len(part)
        out += [one, two]
    return [c for c in out if c[0]]


def train(docs: list[tuple[str, str]], rate: float = 0.08, decay: float = 1e-4, seed: int = 3) -> Field:
    """docs: (language, text). Adam on the conditional likelihood; each step takes the next part of the chains."""
    rng = np.random.default_rng(seed)
    labels = sorted({lang for lang, _ in docs})
    number = {lang: i for i, lang in enumerate(labels)}
    counts: list[Counter] = [Counter() for _ in labels]
    vocab: defaultdict = defaultdict()
    vocab.default_factory = vocab.__len__
    texts: list[tuple[int, list[int]]] = []
    for lang, text in docs:
        words = split(text)
        counts[number[lang]].update(words)
        texts.append((number[lang], [vocab[w] for w in words]))
    k = len(labels)
    if k == 0 or not vocab:
        return Field(labels, np.zeros((WIDTH, k)), {}, np.zeros((1, k)), np.zeros((k, k)), np.zeros(k))
    # lexicons: a word's class is the set of languages among whose commonest words it is
    common_in: dict[bytes, set[int]] = defaultdict(set)
    for i, held in enumerate(counts):
        for w, _ in sorted(held.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            common_in[w].add(i)
    classes = {c: i for i, c in enumerate(sorted({tuple(sorted(s)) for s in common_in.values()}))}
    lexicon = {w: classes[tuple(sorted(s))] for w, s in common_in.items()}
    chains = spliced(texts, rng)
    lists = [word_features(w) for w in vocab]
    sizes = np.array([len(x) for x in lists])
    flat = np.concatenate([np.array(x, np.int32) for x in lists])
    del lists, texts, counts
    lex = np.array([lexicon.get(w, -1) for w in vocab])
    used, flat = np.unique(flat, return_inverse=True)  # the features that occur
    flat = flat.astype(np.int32)
    params = [np.zeros((len(used), k)), np.zeros((len(classes), k)), np.zeros((k, k)), np.zeros(k)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    starts = np.cumsum(sizes) - sizes
    many = max(1, min(len(chains), sum(len(w) for w, _ in chains) // STEP))
    parts = []
    for i in range(many):  # the words of a part are numbered in it; only they are worked on in its steps
        here = np.unique(np.concatenate([np.array(w, np.int32) for w, _ in chains[i::many]]))
        parts.append((here, [(np.searchsorted(here, w).astype(np.int32), np.array(y, np.int32)) for w, y in chains[i::many]]))
    del chains
    for t in range(1, max(STEPS, 2 * many) + 1):
        here, part = parts[t % len(parts)]
        ends, known = np.cumsum(sizes[here]), lex[here]
        of = np.repeat(np.arange(len(here)), sizes[here])
        features = flat[np.arange(ends[-1]) + (starts[here] - ends + sizes[here])[of]]
        emit = np.add.reduceat(params[0][features], ends - sizes[here]) + np.where(known[:, None] >= 0, params[1][known], 0)
        per_word, trans, begins, n = np.zeros((len(here), k)), np.zeros((k, k)), np.zeros(k), 0
        for places, length in _groups(np.array([len(w) for w, _ in part]), k):
            words, _, place = _laid_out([part[i][0] for i in places], length)
            gold = _laid_out([part[i][1] for i in places], length)[0]
            mask = words >= 0
            err, pair = forward_backward(np.where(mask[:, :, None], emit[words], 0), params[2], params[3], mask, place)
            r, c = np.nonzero(mask)
            err[r, c, gold[r, c]] -= 1
            per_word += _sums(err[mask], words[mask], len(here))
            steps = [(part[i][1][:-1], part[i][1][1:]) for i in places]
            np.add.at(pair, (np.concatenate([x for x, _ in steps]), np.concatenate([x for _, x in steps])), -1)
            trans, begins, n = trans + pair, begins + err[place == 0, 0].sum(0), n + len(r)
        grads = [_sums(per_word[of], features, len(used)), _sums(per_word[known >= 0], known[known >= 0], len(classes)), trans, begins]
        for p, g, (m, v) in zip(params, grads, moments, strict=True):
            g = g / n + decay * p / WIDTH
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros((WIDTH, k))
    weights[used] = params[0]
    return Field(labels, weights, lexicon, *params[1:])


def learn(docs: DataFrame, learn_from, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", seed: int = 17) -> Field:
    """A field from a bounded sample of the rows where ``learn_from`` holds and neither language nor text is null.

    Of rows that share language and id, the one with the smallest text hash is learned from.
    """
    rows = docs.where(learn_from & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    keys = (F.col(lang_col).alias("l"), F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)).alias("h"), F.xxhash64(text_col).alias("t"))
    size = F.regexp_count(F.col(text_col), F.lit(common.WORD)).cast("long")
    ids = rows.select(*keys, size.alias("n")).groupBy("l", "h").agg(F.min(F.struct("t", "n")).alias("x"))
    # first inside sixty-four parts of a language, so that no task gets one with very many rows
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("h"))
    ids = ids.withColumn("part", F.shiftrightunsigned("h", 58)).withColumn("r", first("l", "part")).where(F.col("r") <= PER_LANGUAGE).drop("part", "r")
    ids = common.materialise(ids.withColumn("r", first("l")).where(F.col("r") <= PER_LANGUAGE), "language-sample")
    many = max(2, min(PER_LANGUAGE, DOCUMENTS // max(ids.where("r = 1").count(), 1)))
    so_far = F.sum("x.n").over(Window.partitionBy("l").orderBy("r"))
    picked = ids.where(F.col("r") <= many).withColumn("w", so_far).where((F.col("w") <= WORDS) | (F.col("r") == 1)).select(F.col("l").alias("pl"), F.col("h").alias("ph"), F.col("x.t").alias("pt"))
    texts = rows.select(*keys, F.col(text_col).alias("text"))
    same = (F.col("l") == F.col("pl")) & (F.col("h") == F.col("ph")) & (F.col("t") == F.col("pt"))
    # copies of a picked row fall together before they move
    got = texts.join(F.broadcast(picked), same).groupBy("l", "h").agg(F.min("text").alias("text")).toPandas().sort_values(["l", "h"])
    return train(list(zip(got["l"], got["text"], strict=True)))


def predict(docs: DataFrame, field: Field, text_col: str = "text", name: str = "_language") -> DataFrame:
    """``docs`` with a struct column, called ``name``, of lang and score."""
    def typed(batches):
        for texts in batches:
            texts = list(texts)
            found = [x for part in common.slices(texts) for x in field.predict(texts[part])]
            yield pd.DataFrame(found, columns=["lang", "score"])

    typed.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    # not deterministic, to the optimiser: so that it runs once, however often its column is used
    return docs.withColumn(name, F.pandas_udf(typed, "lang string, score double").asNondeterministic()(F.col(text_col)))


def identify(docs: DataFrame, learn_from, held_out, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; ``learn_from`` and ``held_out`` are conditions on it.

    Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is every text when there is nothing
    to learn from; null conditions are false; ties go to the first language by code point; repeated rows are predicted
    each; an empty table gives an empty result; other columns are ignored.
    """
    field = learn(docs, learn_from, id_col, text_col, lang_col)
    out = predict(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text")), field)
    return out.select("doc_id", "held_out", F.col("_language.lang").alias("lang_pred"), F.col("_language.score").alias("score"))


def op8_language_id(spark, sf_dir):
    rest = common.crc_mod("doc_id", 4)
    return identify(common.table(spark, sf_dir, "documents"), rest != 2, rest == 2)
