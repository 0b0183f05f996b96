"""Language-model scores by deleted interpolation.

A trigram model whose maximum-likelihood estimates (trigram, bigram, unigram, uniform) are mixed with weights that depend on
how often the two contexts were seen. The weights come from expectation-maximisation on held-out counts: a tenth of the
training documents is kept out of the counts while the weights are learned, and counted in when texts are scored.

How it runs. Documents are packed into blocks of about a million tokens; a block knows its distinct words, bigrams
and trigrams and asks for the corpus count of each of them once, as a hash with its own count. Questions are routed by the
leading bits of the hash in levels: each level splits a question into as many parts as there are blocks (8192 at most) and merges the parts that as
many askers sent, so a node holds about as many entries as a block, and the rows sent at a level are in proportion to the
blocks; the levels grow with the logarithm of the corpus. The last level adds up and answers go back the same way. So an
n-gram that is in a third of all documents is one entry per block, and no task sees more than one block or node; nothing
is broadcast but the mixture weights, and the driver gets only totals and sums per bucket.

Hashes are as wide as the corpus asks for: ``SPARE_BITS`` bits more than it takes to number its tokens, so that an n-gram
shares its hash with another one with a probability of some ``2 ** -(SPARE_BITS - 2)``. Such pairs are taken as equal.
"""

from __future__ import annotations

import pickle
from collections import defaultdict

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Tokens of a block, at least, when it is closed; bits of a level; bits of a hash beyond those that number the tokens.
BLOCK_TOKENS, FAN_BITS, SPARE_BITS = 1_200_000, 8, 24
#: A level has as many ways as there are blocks, from 2 ** FAN_BITS to 2 ** FAN_MOST: each level more moves all questions again.
FAN_MOST = 13
#: Tokens of a block that are scored at a time.
SLICE = 200_000
#: Rounds of expectation-maximisation, at most; the largest change of a weight at which they end.
ROUNDS, STILL = 20, 1e-3
MAIN, DEV, NONE = 0, 1, 2
_END = b""  # no word is empty
_MIX, _MIX3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BUCKETS = 64


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned 64-bit numbers, byte by byte of equal weight, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps([(len(a), np.ascontiguousarray(a.astype("<u8")).view(np.uint8).reshape(-1, 8).T.tobytes()) for a in arrays]))


def unpack(data: bytes) -> list[np.ndarray]:
    out = []
    for n, raw in pickle.loads(zstandard.ZstdDecompressor().decompress(data)):
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view("<u8").reshape(n))
    return out


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(words) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


class Entries:
    """Words, bigrams and trigrams of a block's token stream, which starts with the end token, as each document ends with it.

    hashes, counts: of the distinct entries, in order of their hashes; the last two bits tell the kind. ``of(...)`` gives
    each token its corpus counts. A trigram needs three tokens of one document: the first token of a document, after an
    end token, is left to its bigram.
    """

    def __init__(self, stream: np.ndarray, words: np.ndarray, bits: int):
        self.prev, self.cur = stream[:-1].astype(np.uint32), stream[1:].astype(np.uint32)
        n, low = len(words), lambda h: h ^ (h >> np.uint64(17))
        keys2, self.two, n2 = _distinct(self.prev.astype(np.int64) * n + self.cur)
        h2 = _scramble(words[keys2 // n] * _MIX + low(words[keys2 % n]))
        inside = np.flatnonzero(self.prev)
        keys3, three, n3 = _distinct(self.two[inside - 1].astype(np.int64) * n + self.cur[inside])
        self.three = np.zeros(len(self.cur), np.uint32)
        self.three[inside] = three
        h3 = _scramble(h2[keys3 // n] * _MIX3 + low(words[keys3 % n]))
        every = np.concatenate([(h >> np.uint64(64 - bits)) & ~np.uint64(3) | np.uint64(i) for i, h in enumerate((_scramble(words), h2, h3))])
        del keys3, h2, h3, three, inside
        order = np.argsort(every, kind="stable")
        self.hashes, self.counts = every[order], np.concatenate([np.bincount(self.cur, minlength=n), n2, n3])[order]
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        self.places = np.split(place, [n, n + len(keys2)])

    def by_kind(self, counts: np.ndarray) -> list[np.ndarray]:
        """Counts of the words, of the bigrams and of the trigrams, from those of all entries."""
        return [counts[p] for p in self.places]

    def of(self, counts: list[np.ndarray], begin: int = 0, end: int | None = None):
        """Per token from ``begin`` to ``end``: counts of the word, its context, the bigram, its context and the trigram."""
        one, two, three = counts
        end = len(self.cur) if end is None else end
        word, before, pair = one[self.cur[begin:end]], one[self.prev[begin:end]], two[self.two[begin:end]]
        before2, triple = before.copy(), pair.copy()
        inside = np.flatnonzero(self.prev[begin:end])
        before2[inside], triple[inside] = two[self.two[inside + begin - 1]], three[self.three[inside + begin]]
        return word, before, pair, before2, triple


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, which of them each key is, and how often each occurs; in little memory."""
    order = np.argsort(keys)
    sorted_ = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(sorted_[1:], sorted_[:-1], out=new[1:])
    at, inverse = np.flatnonzero(new), np.empty(len(keys), np.uint32)
    inverse[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    return sorted_[at], inverse, np.diff(at, append=len(keys))


def _blocks(block_tokens: int):
    def run(batches):
        return _block_stream(batches, block_tokens)

    return run


def _block_stream(batches, block_tokens: int):
    """Documents (doc_id, text, role) -> blocks (role, tokens, payload), each of documents of one role."""
    open_: dict[int, tuple] = {}
    tokens: dict[int, int] = {}

    def close(role):
        vocab, streams, ids, sizes, held = open_.pop(role)
        stream = np.concatenate([np.zeros(1, np.uint32), *streams])
        return pack(_word_hashes(list(vocab)), stream), pickle.dumps((ids, sizes, held)), len(stream) - 1

    for b in batches:
        out = []
        for doc_id, text, role, held in zip(b["doc_id"], b["text"], b["role"], b["held"], strict=True):
            if role not in open_:
                vocab: defaultdict = defaultdict()
                vocab.default_factory = vocab.__len__
                vocab[_END]  # the end token is 0
                open_[role] = (vocab, [], [], [], [])
                tokens[role] = 0
            vocab, streams, ids, sizes, helds = open_[role]
            words = common.words_of(text)
            streams.append(np.fromiter(map(vocab.__getitem__, words + [_END]), np.uint32, len(words) + 1))
            ids.append(None if pd.isna(doc_id) else doc_id)
            sizes.append(len(words) + 1)
            helds.append(bool(held))
            tokens[role] += len(words) + 1
            if tokens[role] >= block_tokens or len(vocab) >= block_tokens // 4:
                out.append((role, *close(role)))
        if out:
            yield _block_rows(out)
    if open_:
        yield _block_rows([(role, *close(role)) for role in list(open_)])


def _block_rows(rows) -> pd.DataFrame:
    return pd.DataFrame([{"block": common.next_name(), "role": int(role), "tokens": n, "data": data, "meta": meta} for role, data, meta, n in rows])


def _parts(path: int, level: int, hashes: np.ndarray, bits: int, fan: int):
    """Sorted hashes under a path of ``level`` digits -> (path of one digit more, from, to) of those that are not empty."""
    shift = bits - fan * (level + 1)
    bounds = np.array([(((path << fan) + d) << shift) for d in range(1, 1 << fan)], np.uint64)
    at = [0, *np.searchsorted(hashes, bounds).tolist(), len(hashes)]
    return [((path << fan) + d, at[d], at[d + 1]) for d in range(1 << fan) if at[d] < at[d + 1]]


def _question(path: int, level: int, asker: int, hashes, main, dev, bits: int, fan: int):
    rows = []
    for under, a, b in _parts(path, level, hashes, bits, fan):
        base = np.uint64(under << (bits - fan * (level + 1)))
        rows.append((under, asker, pack(np.diff(hashes[a:b], prepend=base), main[a:b], dev[a:b])))
    return pd.DataFrame(rows, columns=["path", "asker", "asked"])


def _ask(bits: int, fan: int):
    def run(batches):
        for b in batches:
            for block, role, data in zip(b["block"], b["role"], b["data"], strict=True):
                words, stream = unpack(data)
                own = Entries(stream, words, bits)
                none = np.zeros(len(own.hashes), np.uint64)
                yield _question(0, 0, block, own.hashes, own.counts if role == MAIN else none, own.counts if role == DEV else none, bits, fan)

    return run


def _pass_on(level: int, bits: int, fan: int):
    def run(batches):
        for b in batches:
            for node, path, data in zip(b["node"], b["path"], b["data"], strict=True):
                deltas, main, dev = unpack(data)
                yield _question(path, level, node, np.cumsum(deltas, dtype=np.uint64), main, dev, bits, fan)

    return run


def _merged(path: int, level: int, frame: pd.DataFrame, bits: int, fan: int):
    """Questions under one path -> distinct hashes, their main and held-out counts, and where each asker's lie among them."""
    base = np.uint64(path << (bits - fan * (level + 1)))
    asked = [unpack(x) for x in frame["asked"]]
    ends = np.cumsum([len(q[0]) for q in asked])
    hashes, inverse = np.unique(np.concatenate([np.cumsum(q[0], dtype=np.uint64) + base for q in asked]), return_inverse=True)
    main, dev = (np.bincount(inverse, np.concatenate([q[i] for q in asked]).astype(np.float64), len(hashes)).astype(np.uint64) for i in (1, 2))  # exact to 2 ** 53
    return hashes, main, dev, np.split(inverse, ends[:-1])


def _answer(level: int, bits: int, fan: int):
    """The corpus counts of all that is under one path, for every asker; and the number of distinct training words."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        hashes, main, dev, places = _merged(int(key[0]), level, frame, bits, fan)
        words = int(((hashes & np.uint64(3) == 0) & (main + dev > 0)).sum())
        rows = [(key[0], asker, pack(main[p], dev[p]), words if i == 0 else 0) for i, (asker, p) in enumerate(zip(frame["asker"], places, strict=True))]
        return pd.DataFrame(rows, columns=["path", "asker", "counts", "words"])

    return run


def _merge(level: int, bits: int, fan: int):
    """What some of the askers ask under one path, as one question; and where each asker's entries lie in it."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        path, above = int(key[0]), int(key[1])
        hashes, main, dev, places = _merged(path, level, frame, bits, fan)
        askers = pickle.dumps((frame["asker"].tolist(), pack(*[np.diff(p, prepend=0).astype(np.uint64) for p in places])))
        return pd.DataFrame([{"node": (above << (fan * (level + 1))) + path, "path": path, "data": pack(np.diff(hashes, prepend=np.uint64(0)), main, dev), "askers": askers}])

    return run


def _send_back(node: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    if not len(node):
        return pd.DataFrame(columns=["path", "asker", "counts", "words"])
    main, dev = _assembled(answers)
    askers, places = pickle.loads(node["askers"].iloc[0])
    words, rows = int(answers["words"].sum()), []
    for i, (asker, p) in enumerate(zip(askers, unpack(places), strict=True)):
        at = np.cumsum(p.astype(np.int64))
        rows.append((node["path"].iloc[0], asker, pack(main[at], dev[at]), words if i == 0 else 0))
    return pd.DataFrame(rows, columns=["path", "asker", "counts", "words"])


def _assembled(answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = [unpack(x) for x in answers.sort_values("path")["counts"]]
    return tuple(np.concatenate([g[i] for g in got]) for i in range(2))


_QUESTIONS, _ANSWERS = "path long, asker long, asked binary", "path long, asker long, counts binary, words long"


def corpus_counts(questions: DataFrame, askers: int, bits: int, fan: int = FAN_BITS, level: int = 0) -> DataFrame:
    """Questions (path, asker, asked) of ``askers`` askers -> answers (path, asker, counts, words), level by level."""
    if askers <= 1 << fan or fan * (level + 2) > bits - 2:
        return common.materialise(questions.groupBy("path").applyInPandas(_answer(level, bits, fan), _ANSWERS), "lm-counts", compression="none")
    above = -(-askers // (1 << fan))
    dealt = questions.withColumn("above", F.pmod(F.xxhash64("asker"), F.lit(above)))
    nodes = common.materialise(dealt.groupBy("path", "above").applyInPandas(_merge(level, bits, fan), "node long, path long, data binary, askers binary"), "lm-nodes", compression="none")
    more = corpus_counts(nodes.select("node", "path", "data").mapInPandas(_pass_on(level + 1, bits, fan), _QUESTIONS), above, bits, fan, level + 1)
    back = nodes.select("node", "path", "askers").groupBy("node").cogroup(more.groupBy("asker")).applyInPandas(_send_back, _ANSWERS)
    return common.materialise(back, "lm-counts", compression="none")


def context_bucket(counts: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, then one bucket for each doubling of the count."""
    return np.minimum(np.frexp(counts.astype(np.float64))[1].astype(np.int64), _BUCKETS - 1)


def _estimates(word, before, pair, before2, triple, n: int):
    """Per token: the bucket of its two contexts and the three estimates."""
    bucket = context_bucket(before2) * _BUCKETS + context_bucket(before)
    return bucket, np.stack([triple / np.maximum(before2, 1), pair / np.maximum(before, 1), word / max(n, 1)], 1)


def _block(blocks: pd.DataFrame, bits: int) -> Entries:
    words, stream = unpack(blocks["data"].iloc[0])
    return Entries(stream, words, bits)


def _events(n_main: int, bits: int):
    """Held-out tokens of a block: bucket and estimates of each, from the counts without held-out documents."""

    def run(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks):
            return pd.DataFrame({"data": []})
        own = _block(blocks, bits)
        bucket, f = _estimates(*own.of(own.by_kind(_assembled(answers)[0].astype(np.int64))), n_main)
        order = np.lexsort((f[:, 2], f[:, 1], bucket))  # like ones together: smaller files
        return pd.DataFrame({"data": [pack(bucket[order], *(np.ascontiguousarray(f[order, i]).view(np.uint64) for i in range(3)))]})

    return run


def expected(bucket: np.ndarray, f: np.ndarray, weights: np.ndarray, uniform: float) -> np.ndarray:
    """(buckets, 4): how many of the events come from each estimate, as the weights have it."""
    p = np.concatenate([f, np.full((len(f), 1), uniform)], 1) * weights[bucket]
    p /= p.sum(1, keepdims=True)
    return np.stack([np.bincount(bucket, p[:, i], len(weights)) for i in range(4)], 1)


def improved(counts: np.ndarray, strength: float = 10.0) -> np.ndarray:
    """Weights from expected counts. Those of all buckets together count as ``strength`` events in each bucket; without
    events all four weigh alike."""
    total = counts.sum()
    whole = (counts.sum(0) + strength / 4) / (total + strength)
    w = np.maximum((counts + strength * whole) / (counts.sum(1, keepdims=True) + strength), 1e-9)
    return w / w.sum(1, keepdims=True)


def learn_weights(expect, rounds: int = ROUNDS, still: float = STILL) -> np.ndarray:
    """Expectation-maximisation; expect: weights -> expected counts."""
    weights = np.full((_BUCKETS * _BUCKETS, 4), 0.25)
    for _ in range(rounds):
        new = np.round(improved(expect(weights)), 9)  # so that the order of sums does not show
        change, weights = np.abs(new - weights).max(), new
        if change < still:
            break
    return weights


def _expect(events: DataFrame, uniform: float):
    def of(weights: np.ndarray) -> np.ndarray:
        def run(batches):
            total = np.zeros_like(weights)
            for b in batches:
                for data in b["data"]:
                    bucket, *f = unpack(data)
                    total += expected(bucket.astype(np.int64), np.stack([x.view(np.float64) for x in f], 1), weights, uniform)
            rows = np.flatnonzero(total.any(1))
            yield pd.DataFrame({"bucket": rows, **{f"e{i}": total[rows, i] for i in range(4)}})

        sums = events.mapInPandas(run, "bucket long, e0 double, e1 double, e2 double, e3 double").groupBy("bucket").agg(*[F.sum(f"e{i}").alias(f"e{i}") for i in range(4)])
        out = np.zeros_like(weights)
        for r in sums.collect():  # a row a bucket
            out[r.bucket] = r[1:]
        return out

    return of


def mixture(bucket: np.ndarray, weights: np.ndarray, before: np.ndarray, before2: np.ndarray) -> np.ndarray:
    """Weights of each token's four estimates; a context that was not seen gives none."""
    lam = weights[bucket].copy()
    lam[before2 == 0, 0] = 0
    lam[before == 0, 1] = 0
    return lam / lam.sum(1, keepdims=True)


def _scorer(weights: np.ndarray, n_train: int, vocab: int, bits: int):
    def score(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        ids, sizes, held = pickle.loads(blocks["meta"].iloc[0]) if len(blocks) else ([], [], [])
        if not ids:
            return pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        main, dev = _assembled(answers)
        own, ends = _block(blocks, bits), np.cumsum(sizes)
        counts = own.by_kind((main + dev).astype(np.int64))
        del main, dev
        known, base, p = np.empty(ends[-1], np.int64), np.empty(ends[-1]), np.empty(ends[-1])
        for a in range(0, len(p), SLICE):
            b = min(a + SLICE, len(p))
            word, before, pair, before2, triple = own.of(counts, a, b)
            bucket, f = _estimates(word, before, pair, before2, triple, n_train)
            lam = mixture(bucket, weights, before, before2) if n_train else np.array([[0.0, 0.0, 0.0, 1.0]])
            p[a:b] = (lam[:, :3] * f).sum(1) + lam[:, 3] / (vocab + 1)
            known[a:b], base[a:b] = word > 0, np.log10((word + 0.1) / (n_train + 0.1 * (vocab + 1)))
        starts = ends - np.array(sizes)
        per = lambda x: np.add.reduceat(x, starts)
        return pd.DataFrame({
            "doc_id": pd.array(ids, "Int64"), "held_out": held, "n_tokens": np.array(sizes, np.int64), "n_known": per(known),
            "train_tokens": np.int64(n_train), "base_score": per(base), "score": per(np.log10(p)),
        })

    return score


def score_documents(docs: DataFrame, learn_from, held_out, held_in, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, fan: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    learn_from, held_out, held_in: Boolean columns: documents that are learned from, that are reported as held out, and
    those of the learned ones whose counts are held out to learn the mixture weights. Defined cases: a null text is empty
    and consists of its end token; a null condition is false; repeated rows count each time; with nothing to learn from
    every token has probability 1 / (V + 1) = 1; an empty table gives an empty result; other columns are ignored.
    """
    no = F.lit(False)
    role = F.when(~F.coalesce(learn_from, no), NONE).when(F.coalesce(held_in, no), DEV).otherwise(MAIN)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), role.alias("role"), F.coalesce(held_out, no).alias("held"))
    blocks = common.materialise(rows.mapInPandas(_blocks(block_tokens), "block long, role int, tokens long, data binary, meta binary"), "lm-blocks", compression="none")
    totals = {r.role: (r.t, r.n) for r in blocks.groupBy("role").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()}
    n_main, n_dev = totals.get(MAIN, (0, 0))[0], totals.get(DEV, (0, 0))[0]
    askers = sum(n for _, n in totals.values())
    fan = min(FAN_MOST, max(FAN_BITS, max(askers - 1, 1).bit_length())) if fan is None else fan
    bits = min(62, max(fan * 2 + 4, SPARE_BITS + 2 + sum(t for t, _ in totals.values()).bit_length()))
    asked = blocks.select("block", "role", "data").mapInPandas(_ask(bits, fan), _QUESTIONS)
    answers = corpus_counts(asked, askers, bits, fan)
    vocab = answers.agg(F.sum("words")).first()[0] or 0

    def joined(wanted: DataFrame, f, schema: str, only: bool = False) -> DataFrame:
        of = answers.select("path", "asker", "counts")
        of = of.join(wanted.select("block"), F.col("asker") == F.col("block"), "left_semi") if only else of
        return wanted.groupBy("block").cogroup(of.groupBy("asker")).applyInPandas(f, schema)

    weights = learn_weights(lambda w: np.zeros_like(w), 1)
    if n_dev:
        events = common.materialise(joined(blocks.where(F.col("role") == DEV), _events(n_main, bits), "data binary", True), "lm-events", compression="none")
        weights = learn_weights(_expect(events, 1 / (vocab + 1)))
    return joined(blocks, _scorer(weights, n_main + n_dev, vocab, bits), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op2_lm_scoring(spark, sf_dir):
    rest = common.crc_mod("doc_id", 10)
    return score_documents(common.table(spark, sf_dir, "documents"), rest != 0, rest == 0, rest == 1)
