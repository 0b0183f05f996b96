"""Packing documents into sequences along a space-filling curve.

Each document becomes token ids and a point: its hashed bag of tokens, projected to three dimensions. Points get a place
on a Hilbert curve, documents are range-sorted by it, and pieces are cut along the curve, so a sequence holds documents
that are alike. Ranges of the curve are cut where they hold about ``RANGE_TOKENS`` tokens, from a histogram of
``2 ** FINE`` cells of the curve, whose prefix sums are taken in groups; a cell that holds more than a range by itself (one
text a million times, or a corpus beyond a trillion tokens) is dealt out by a hash of id, content and row. So ranges are
of about one size, whatever the number of copies, and follow the table as it is read, not the cluster's partitions of a
shuffle. What is broadcast is where a new range begins, ``2 ** FINE`` entries at most, whatever the number of documents.

In a range all sequences are full but the last ones: what is left is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import itertools
import os
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

LENGTH, END, VOCABULARY = 2048, 1, "word_bpe_49k.json"
#: Tokens of a range, about; buckets of the hashed vector; bits of each of the three dimensions.
RANGE_TOKENS, HASHED, BITS = 1_500_000, 256, 10
#: Leading bits of a place on the curve that number a cell of the histogram, a row of the broadcast, a group of prefix sums.
FINE, COARSE, GROUP = 20, 14, 10
#: Words whose ids a task remembers.
REMEMBERED = 400_000
_ENCODERS: dict[str, Encoder] = {}


#: Byte-level models read bytes as characters: printable ones as themselves, the others from 256 on, in order.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_AS_CHARACTERS = {b: b for b in _PRINTABLE} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_STOPS = re.compile(rb"([.,])(?=[ \n])(?<=[a-z].)")
#: Texts on which words apart and whole texts must give the same ids, or else whole texts are encoded.
_PROBES = (
    "The valve. the Valve, THE valve.\nthe", "a b  c\td", " x", "x ", "1,000.5 12 a1b. 3", "don't 'S we'll I'D", "ÉTUDE\xa0İx\u2028ΣΣ e\u0301 \x1cy Ǆ 漢字 ไทย",
    "word." * 9 + " hyphen-ated (and) [so] on... ??", "<|x|> Ab.b", "unbelievably " * 5 + "internationalisation", "a,b ,c . d", "Straße straße naïve 🙂 🙂🙂",
)


def _units(text: str) -> list[bytes]:
    """Parts of a text that are tokenised apart, for fewer different ones: words, and the stop after a word.

    The vocabulary lower-cases and cuts there by itself. Where a special token may stand, nothing but white space counts.
    """
    data = text.encode("utf-8", "replace")
    return data.split() if b"<|" in data else _STOPS.sub(rb" \1", data.lower()).split()


class Encoder:
    """Ids of whole texts. Where no token of a vocabulary crosses white space, words are encoded once and remembered.

    Another vocabulary, one that gives other ids for the probes so, encodes whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # a task has one core; threads of the library would only wait for each other
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self._forget()
        rng = np.random.default_rng(29)
        self.axes = rng.normal(0, 1, (HASHED, 3)).astype(np.float32)
        self.slot = rng.integers(0, HASHED, 1 << 17)
        probes = [*_PROBES, " ".join(_PROBES), *(f"A{t.content} b{t.content}." for t in self.tokenizer.get_added_tokens_decoder().values())]
        self.whole = any(not np.array_equal(a, b) for a, b in zip(self._by_words(probes), self._by_texts(probes), strict=True))
        self._forget()

    def encode(self, texts) -> list[np.ndarray]:
        """Ids of each text and the end id."""
        return self._by_texts(texts) if self.whole else self._by_words(texts)

    def _by_texts(self, texts) -> list[np.ndarray]:
        clean = [(t or "").encode("utf-8", "replace").decode("utf-8") for t in texts]
        return [np.array([*e.ids, END], np.uint32) for e in self.tokenizer.encode_batch(clean, add_special_tokens=False)]

    def _by_words(self, texts) -> list[np.ndarray]:
        if len(self.place) > REMEMBERED:
            self._forget_rare()
        words = [np.fromiter(map(self.place.__getitem__, _units(t) if t else ()), np.int64) for t in texts]
        self._learn()
        counts = [len(w) + 1 for w in words]
        flat = np.zeros(sum(counts), np.int64)  # word 0 stands for the end id
        for w, at in zip(words, np.cumsum(counts) - counts, strict=True):
            flat[at : at + len(w)] = w
        self.hits += np.bincount(flat, minlength=len(self.hits))
        sizes = self.sizes[flat]
        ends = np.cumsum(sizes)
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.starts[flat] - (ends - sizes), sizes)] if len(flat) else np.zeros(0, np.uint32)
        return np.split(ids, ends[np.cumsum(counts) - 1][:-1]) if counts else []

    def _forget(self):
        """Words are numbered as they come; starts, sizes and flat hold the ids of each number."""
        self.place = defaultdict()
        self.place.default_factory = self.place.__len__
        self.place[b""]  # no word is empty
        self.sizes, self.starts, self.flat, self.hits = np.array([1]), np.array([0]), np.array([END], np.uint32), np.array([0])

    def _forget_rare(self):
        """Keep the words seen more than once, and of these at most half of what may be remembered."""
        keep = np.flatnonzero(self.hits[1:] > 1) + 1
        keep = np.sort(keep[np.argsort(-self.hits[keep], kind="stable")[: REMEMBERED // 2]])
        words, sizes, starts, flat, hits = list(self.place), self.sizes[keep], self.starts[keep], self.flat, self.hits[keep]
        self._forget()
        for i in keep.tolist():
            self.place[words[i]]
        ends = np.cumsum(sizes)
        part = flat[np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)] if len(keep) else flat[:0]
        self.starts = np.concatenate([self.starts, len(self.flat) + ends - sizes])
        self.sizes, self.hits = np.concatenate([self.sizes, sizes]), np.concatenate([self.hits, hits // 2 + 1])
        self.flat = np.concatenate([self.flat, part])

    def _learn(self):
        new = list(itertools.islice(self.place, len(self.sizes), None))
        found = []
        for w in new:
            text = w.decode("utf-8")
            # lower-case letters alone are one word to the model, which reads bytes as characters; else the whole way
            if text.isalpha() and text.lower() == text and unicodedata.is_normalized("NFC", text):
                found.append([t.id for t in self.model.tokenize(text if text.isascii() else w.decode("latin-1").translate(_AS_CHARACTERS))])
            else:
                found.append(self.tokenizer.encode(text, add_special_tokens=False).ids)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.hits = np.concatenate([self.hits, np.zeros(len(sizes), np.int64)])
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(sizes.sum()))])

    def point(self, ids: np.ndarray) -> np.ndarray:
        """Three numbers in 0 .. 2 ** BITS - 1: the projected hashed vector of a document."""
        bag = np.bincount(self.slot[ids & (len(self.slot) - 1)], minlength=HASHED).astype(np.float32)
        bag = np.sqrt(bag)
        x = bag @ self.axes / max(float(np.linalg.norm(bag)), 1e-9)
        # the projections of a unit vector on normal axes lie about 0 with deviation 1
        return np.clip((np.tanh(x * 0.8) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def encoder(path: str | None = None) -> Encoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each point (rows of small integers) on the Hilbert curve, by Skilling's transposition."""
    x = points.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[:, i] & q) != 0
            t = np.where(on, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] = np.where(on, x[:, 0] ^ p, x[:, 0] ^ t)
            x[:, i] ^= t
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[:, n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    out = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[:, i] >> b & 1)
    return out


def cuts(counts: list[int], size: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Documents of ``counts`` tokens in order -> pieces (document, start, length, sequence, offset).

    Sequences of ``size``; the rest of the stream in sequences whose lengths are its powers of two, longest first.
    """
    total = sum(counts)
    lengths = [size] * (total // size) + [1 << b for b in range(size.bit_length() - 1, -1, -1) if total % size >> b & 1]
    out, at, used = [], 0, 0
    for d, n in enumerate(counts):
        start = 0
        while start < n:
            k = min(n - start, lengths[at] - used)
            out.append((d, start, k, at, used))
            start, used = start + k, used + k
            if used == lengths[at]:
                at, used = at + 1, 0
    return out


def _tokenise(path: str | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for b in batches:
            for part in common.slices(b["text"]):
                ids = enc.encode(b["text"].iloc[part])
                keys = hilbert(np.array([enc.point(i) for i in ids]).reshape(-1, 3))
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[part].astype("Int64").array, "n": [len(i) for i in ids], "key": keys, "crc": [zlib.crc32(i.tobytes()) for i in ids], "row": [common.next_name() for _ in ids], "ids": [i.astype("<u2" if i.max() < 1 << 16 else "<u4").tobytes() for i in ids]})

    return run


def _pack(size: int):
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["key", "doc_id", "crc", "row"], kind="stable", na_position="last")
        counts, rng = frame["n"].tolist(), int(frame["range"].iloc[0])
        ids = [np.frombuffer(x, "<u2" if len(x) == 2 * n else "<u4") for x, n in zip(frame["ids"], counts, strict=True)]
        pieces = cuts(counts, size)
        d = np.array([p[0] for p in pieces])
        crc = [zlib.crc32(ids[i][s : s + k].astype("<u4").tobytes()) for i, s, k, *_ in pieces]
        doc = frame["doc_id"].astype("Int64").array
        return pd.DataFrame({
            "doc_id": doc[d], "start": [p[1] for p in pieces], "length": [p[2] for p in pieces], "ids_crc32": crc, "doc_tokens": np.array(counts)[d],
            "sequence_id": [rng << 32 | p[3] for p in pieces], "offset": [p[4] for p in pieces],
        })

    return pack


def _ranges(table: DataFrame) -> DataFrame:
    """(coarse, steps): for each coarse cell the fine cells at which another range begins, its number, and over how many
    ranges from there on the cell is dealt. Tokens are counted along the curve; a range begins at each multiple of
    ``RANGE_TOKENS``, and a fine cell lies in the range in which it begins."""
    spark, up = table.sparkSession, lambda c, bits: F.shiftright(c, FINE - bits)
    held = common.materialise(table.groupBy(F.shiftright("key", 3 * BITS - FINE).alias("cell")).agg(F.sum("n").alias("t")), "packing-cells")
    groups = sorted(held.groupBy(up("cell", GROUP).alias("g")).agg(F.sum("t").alias("t")).collect())  # 2 ** GROUP rows at most
    above = itertools.accumulate((r.t for r in groups), initial=0)
    before = spark.createDataFrame([(r.g, a) for r, a in zip(groups, above)], "g long, above long")
    along = Window.partitionBy("g").orderBy("cell")
    at = F.col("above") + F.sum("t").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("t")
    cells = held.withColumn("g", up("cell", GROUP)).join(F.broadcast(before), "g").select(
        "g", "cell", up("cell", COARSE).alias("coarse"), F.floor(at / RANGE_TOKENS).alias("first"), F.ceil(F.col("t") / RANGE_TOKENS).alias("many")
    )
    last = lambda c: F.lag(c).over(along)
    same = (last("coarse") == F.col("coarse")) & (last("first") == F.col("first")) & (last("many") == 1) & (F.col("many") == 1)
    steps = cells.withColumn("same", F.coalesce(same, F.lit(False))).where(~F.col("same"))
    return steps.groupBy("coarse").agg(F.array_sort(F.collect_list(F.struct("cell", "first", "many"))).alias("steps"))


def pack_documents(docs: DataFrame, size: int = LENGTH, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    size: a power of two. tokenizer: path of the vocabulary file. Defined cases: a null or empty text is its end token; a
    document longer than a sequence runs on in the next; repeated rows and null ids are documents of their own; an empty
    table gives an empty result; other columns are ignored.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    table = common.materialise(rows.mapInPandas(_tokenise(tokenizer), "doc_id long, n long, key long, crc long, row long, ids binary"), "packing", compression="zstd")
    cell = F.shiftright("key", 3 * BITS - FINE)
    step = F.element_at(F.filter("steps", lambda s: s["cell"] <= cell), -1)
    dealt = table.join(F.broadcast(_ranges(table)), F.shiftright("key", 3 * BITS - COARSE) == F.col("coarse")).withColumn("step", step)
    dealt = dealt.select("doc_id", "n", "key", "crc", "row", "ids", (F.col("step.first") + F.pmod(F.xxhash64("doc_id", "crc", "row"), F.col("step.many"))).alias("range"))
    return dealt.groupBy("range").applyInPandas(_pack(size), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op9_packing(spark, sf_dir):
    return pack_documents(common.table(spark, sf_dir, "documents"))
