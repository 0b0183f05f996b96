"""Removal of passages that stand elsewhere, by Burrows-Wheeler transforms of collections, built column by column.

A passage is a string of ``length`` bytes. Each window of that length has an anchor: the first of its k-grams with the
least hash. Windows that are equal have equal anchors in equal places, so windows that share an anchor in a document form a
context, and only contexts with equal anchors have to be compared:

1. Documents are read in slices. Hashes of anchors, once a slice, are counted over the table; anchors that stand only once
   are done.
2. Contexts of the others (at most twice the length) are cut out of the texts, equal ones of a slice once.
3. Contexts with the same anchor meet in a shard and become a collection of documents of its own. One symbol of every one
   of them is inserted a round, from the last to the first; transform and common prefixes are read from and written to
   sequential files, merged with what is new (``Collection``). In the end neighbours with a common prefix of ``length``
   bytes are equal windows. Equal contexts are one document with a number; an anchor with one such document needs no
   transform.
4. An anchor with too many contexts for one shard is split: the windows of its contexts are halved by their distance from
   the anchor, which gives each half more bytes in common, and their hash is the new key; after the last halving all
   windows of a key are equal.

Texts move twice, and only those of documents that have a repeated anchor; a filter of fixed size tells which.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from . import common

LENGTH = 200
#: Bytes of text of one partition of anchors; bytes of contexts of one shard, and of one anchor at most.
PART_BYTES, SHARD_BYTES, ANCHOR_BYTES = 64 << 20, 1 << 20, 8 << 20
#: Windows of a long document that are hashed at once.
_BLOCK = 1 << 19
_PLACE = 20  # low bits of a hash that are given to the place in a block

_SLICES = "kind int, slice long, part int, hashes binary, many binary, keys binary, counts binary, sizes binary, runs binary, index binary"
_FLAGS = "slice long, part int, flags binary"
_CANDIDATES = "key binary, runs binary"
_CONTEXTS = "kind int, h long, slice long, idx int, base int, at int, low int, high int, content binary, size int, times int, keys binary, counts binary, starts binary, index binary"
_FOUND = "slice long, spans binary"
_SPANS = "key binary, spans binary"


# ------------------------------------------------------------ anchors


def _mixed(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


_BYTES = _mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def gram(length: int) -> int:
    """Bytes of an anchor for windows of ``length``: the largest power of two within a third of it."""
    return 1 << max(length // 3, 1).bit_length() - 1


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams along the last axis; k is a power of two."""
    h, base, n = _BYTES[data], np.uint64(0x9E3779B97F4A7C15), 1
    with np.errstate(over="ignore"):
        while n < k:
            h, base, n = h[..., :-n] * base + h[..., n:], base * base, 2 * n
    return _mixed(h)


def _runs(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """First window, number of windows, place of the anchor behind the first window and its hash, of each run of windows with one anchor."""
    k, out = gram(length), []
    width, low = length - k + 1, np.uint64((1 << _PLACE) - 1)
    until = np.repeat(ends, np.diff(ends, prepend=0))
    for begin in range(0, len(data) - length + 1, _BLOCK):
        h = _grams(data[begin : begin + _BLOCK + length - 1], k)
        least, n = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
        while 2 * n <= width:
            least, n = np.minimum(least[:-n], least[n:]), 2 * n
        if n < width:
            least = np.minimum(least[: n - width], least[width - n :])
        place = (least & low).astype(np.int64)
        place[np.arange(len(place)) + begin + length > until[begin : begin + len(place)]] = -1
        first = np.flatnonzero(np.diff(place, prepend=-2))
        count = np.diff(first, append=len(place))
        first, count = first[place[first] >= 0], count[place[first] >= 0]
        out.append((first + begin, count, place[first] - first, h[place[first]]))
    empty = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(empty)


def anchors(texts: Sequence[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Document, first window, number of windows, place of the anchor and its hash: in the order of texts. What a text gives does not depend on the others."""
    parts, i = [], 0
    while i < len(texts):
        j, size = i + 1, len(texts[i])
        while j < len(texts) and size + len(texts[j]) <= _BLOCK:
            size, j = size + len(texts[j]), j + 1
        ends = np.cumsum([len(t) for t in texts[i:j]])
        first, count, at, h = _runs(np.frombuffer(b"".join(texts[i:j]), np.uint8), ends, length)
        doc = np.searchsorted(ends, first, side="right")
        parts.append((doc + i, first - np.append(0, ends)[doc], count, at, h))
        i = j
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


# ------------------------------------------------------------ the collection


class Collection:
    """Transform and common prefixes of a collection of byte strings.

    Symbols are ``width`` bytes wide; a string stands for ``width`` documents, begun at its first bytes, so that a suffix
    begins at each byte. Round j inserts the j-th last symbol of every document that has one. Entries of the transform are
    sorted by suffix, first the ends of all documents; the extension of an entry by its symbol lies where a stable sort of
    the symbols puts it. A common prefix is that of the symbol and the least one between the two entries it was made of.
    """

    def __init__(self, strings: Sequence[bytes], cap: int, folder: str):
        self.strings, self.cap, self.folder = strings, cap, folder
        self.sizes = np.array([len(s) for s in strings])
        for width in (3, 2, 1):
            pad = bytes(width - 1)
            data = np.frombuffer(pad.join(strings) + pad, np.uint8).astype(np.int32)
            codes = np.zeros(len(data) - width + 1, np.int32)
            for b in range(width):
                codes = codes << 8 | data[b : b + len(codes)]
            held = np.zeros(1 << 8 * width, bool)
            held[codes] = True
            if np.count_nonzero(held) < 1 << 16:
                break
        self.width, self.values = width, np.append(0, np.flatnonzero(held))  # rank 0: no symbol
        rank = np.cumsum(held, dtype=np.int32).astype(np.uint16)
        self.codes = rank[codes]
        base = np.cumsum(self.sizes + width - 1) - (self.sizes + width - 1)
        string, phase = np.repeat(np.arange(len(strings)), width), np.tile(np.arange(width), len(strings))
        there = phase < self.sizes[string]
        self.string, phase = string[there], phase[there]
        self.count = -((phase - self.sizes[self.string]) // width)  # symbols of a document
        self.last = base[self.string] + phase + width * (self.count - 1)
        self.base = base

    def _file(self, j: int, name: str, mode: str):
        return open(f"{self.folder}/{name}-{j % 2}", mode)

    def _write(self, j: int, **arrays: np.ndarray) -> None:
        for name, array in arrays.items():
            with self._file(j, name, "r+b" if j > 1 else "wb") as f:  # a file grows, its pages are written again
                f.write(array.data)

    def _read(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        with self._file(j, "bwt", "rb") as bwt, self._file(j, "lcp", "rb") as lcp:
            return np.fromfile(bwt, np.uint16), np.fromfile(lcp, np.uint16 if self.cap > 255 else np.uint8)

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal first bytes of two different symbols."""
        differ = self.values[a] ^ self.values[b]
        return sum((differ < 1 << 8 * k).astype(np.int64) for k in range(1, self.width)) if self.width > 1 else np.zeros(len(a), np.int64)

    @staticmethod
    def _least(lcp: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least value of each range, both ends included."""
        out, level, size, step = np.empty(len(first), np.int64), lcp, last - first + 1, 1
        kind = np.frexp(size)[1] - 1  # 2 ** kind is the largest power of two within the size
        for k in range(int(kind.max(initial=-1)) + 1):
            own = kind == k
            out[own] = np.minimum(level[first[own]], level[last[own] - step + 1])
            level, step = np.minimum(level[:-step], level[step:]), 2 * step
        return out

    def build(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.last)
        doc = pos = np.arange(n)
        small = np.uint16 if self.cap > 255 else np.uint8
        self._write(0, bwt=self.codes[self.last], lcp=np.zeros(n, small))
        for j in range(int(self.count.max(initial=0))):
            bwt, lcp = self._read(j)
            order = np.argsort(bwt, kind="stable")
            tail = order[np.count_nonzero(bwt == 0) :]
            active = np.zeros(len(bwt), bool)
            active[pos] = True
            new = active[tail]
            doc = doc[np.argsort(bwt[pos], kind="stable")]
            place = np.flatnonzero(new)
            before = np.where(self.count[doc] > j + 1, self.codes[self.last[doc] - self.width * np.minimum(j + 1, self.count[doc] - 1)], 0)
            # common prefixes of what is new, and of what follows it
            near = new.copy()
            near[1:] |= new[:-1]
            at = np.flatnonzero(near)
            here, there = tail[at], tail[np.maximum(at - 1, 0)]
            same = (bwt[here] == bwt[there]) & (at > 0)
            value = np.where(at > 0, self._common(bwt[there], bwt[here]), 0)
            value[same] = np.minimum(self.width + self._least(lcp, there[same] + 1, here[same]), self.cap)
            merged = np.empty(n + len(tail), np.uint16), np.empty(n + len(tail), small)
            for out, old, fresh in zip(merged, (bwt, lcp), (before, value[new[at]]), strict=True):
                out[:n] = old[:n]
                out[n:][~new], out[n:][place] = old[n:], fresh
            merged[1][n + at] = value
            self._write(j + 1, bwt=merged[0], lcp=merged[1])
            on = self.count[doc] > j + 1
            doc, pos = doc[on], n + place[on]
        return self._read(int(self.count.max(initial=0)))

    def repeated(self, times: Sequence[int], length: int) -> list[np.ndarray]:
        """For each string, whether each of its windows stands more than once; ``times``: how often the string stands."""
        bwt, lcp = self.build()
        n, times = len(self.last), np.asarray(times)
        tail = np.argsort(bwt, kind="stable")[np.count_nonzero(bwt == 0) :]
        extended = np.empty(len(bwt), np.int64)
        extended[tail] = np.arange(len(tail)) + n
        # follow every document from its end to its begin
        entry, weight = np.zeros(len(self.codes), np.int64), np.zeros(len(bwt), np.int64)
        doc, pos = np.arange(n), np.arange(n)
        for j in range(int(self.count.max(initial=0))):
            on = self.count[doc] > j
            doc, pos = doc[on], extended[pos[on]]
            start = self.last[doc] - self.width * j
            entry[start] = pos
            own = self.string[doc]
            weight[pos] = np.where(start - self.base[own] + length <= self.sizes[own], times[own], 0)
        group = np.cumsum(lcp < length)
        twice = np.bincount(group, weight)[group] > 1.5
        return [twice[entry[b : b + max(size - length + 1, 0)]] for b, size in zip(self.base, self.sizes, strict=True)]


def judged(contents: dict[int, dict[bytes, int]], length: int) -> dict[tuple[int, bytes], np.ndarray]:
    """Anchor -> content -> times it stands. For each content with a repeated window, which of its windows are."""
    out, strings = {}, []
    for h, own in contents.items():
        if len(own) > 1:
            strings += [(h, content) for content in own]
        else:
            ((content, times),) = own.items()
            if times > 1:
                out[h, content] = np.ones(len(content) - length + 1, bool)
    if strings:
        with tempfile.TemporaryDirectory() as folder:
            found = Collection([c for _, c in strings], length, folder).repeated([contents[h][c] for h, c in strings], length)
        out |= {s: f for s, f in zip(strings, found, strict=True) if f.any()}
    return out


# ------------------------------------------------------------ tasks


def _kinds(ddl: str) -> dict[str, pa.DataType]:
    named = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return {name: named[kind] for name, kind in (c.split() for c in ddl.split(", "))}


def _rows(ddl: str, **columns) -> pa.RecordBatch:
    kinds, n = _kinds(ddl), len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()], schema=pa.schema(kinds.items()))


def _texts(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Slices of the texts and other columns of Arrow batches."""
    for batch in batches:
        texts, others = batch.column("text").to_pylist(), [batch.column(c).to_pylist() for c in names]
        for part in common.slices(texts):
            yield texts[part], *[o[part] for o in others]


def _sliced(length: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, keys in _texts(batches, "key"):
            doc, _, count, at, h = anchors(texts, length)
            if not len(h):
                continue
            unique, index, times = np.unique(h, return_inverse=True, return_counts=True)
            cuts = np.searchsorted(unique >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64) * np.uint64(2**32 // parts))
            cuts[-1] = len(unique)
            name, used = common.next_name(), np.flatnonzero(np.diff(cuts))
            pieces = [slice(cuts[p], cuts[p + 1]) for p in used]
            yield _rows(_SLICES, kind=[0] * len(used), slice=[name] * len(used), part=used.astype(np.int32), hashes=[unique[p].tobytes() for p in pieces], many=[np.packbits(times[p] > 1).tobytes() for p in pieces])
            own = {"keys": b"".join(keys), "counts": np.bincount(doc, minlength=len(texts)).astype(np.int32).tobytes(), "sizes": np.diff(cuts).astype(np.int32).tobytes(), "runs": np.stack([count, at]).astype(np.uint16).tobytes(), "index": index.astype(np.int32).tobytes()}
            yield _rows(_SLICES, kind=[1], slice=[name], **{k: [v] for k, v in own.items()})

    return run


def _counted(key, table):
    """Hashes of one partition, of all slices -> which stand more than once."""
    hashes = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    many = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(h)).astype(bool) for x, h in zip(table.column("many").to_pylist(), hashes, strict=True)]
    h, flags = np.concatenate(hashes), np.concatenate(many)
    order = np.argsort(h, kind="stable")
    again = h[order[1:]] == h[order[:-1]]
    flags[order[1:][again]] = flags[order[:-1][again]] = True
    ends = np.cumsum([len(x) for x in hashes])
    each = [flags[e - len(x) : e] for e, x in zip(ends, hashes, strict=True)]
    at = [i for i, f in enumerate(each) if f.any()]
    names = table.column("slice").to_pylist()
    return pa.Table.from_batches([_rows(_FLAGS, slice=[names[i] for i in at], part=[key[0].as_py()] * len(at), flags=[np.packbits(each[i]).tobytes() for i in at])])


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices with their flags -> for each document that has any, its runs with a repeated anchor."""
    for batch in batches:
        for row in batch.to_pylist():
            sizes, index = np.frombuffer(row["sizes"], np.int32), np.frombuffer(row["index"], np.int32)
            ends, flags = np.cumsum(sizes), np.zeros(sizes.sum(), bool)
            for f in row["flags"]:
                p = f["part"]
                flags[ends[p] - sizes[p] : ends[p]] = np.unpackbits(np.frombuffer(f["flags"], np.uint8), count=sizes[p])
            counts = np.frombuffer(row["counts"], np.int32)
            runs = np.frombuffer(row["runs"], np.uint16).reshape(2, -1).astype(np.int32)
            until = np.cumsum(runs[0])
            doc = np.repeat(np.arange(len(counts)), counts)
            # runs follow one another, so a document's first windows are sums of its runs
            first = np.cumsum(counts) - counts
            begun = (until - runs[0])[np.minimum(first, len(until) - 1)]
            own = np.stack([until - runs[0] - begun[doc], runs[0], runs[1]]).astype(np.int32)
            take = flags[index]
            cuts = np.cumsum(np.bincount(doc[take], minlength=len(counts)))[:-1]
            each = np.split(own[:, take], cuts, axis=1)
            some = [i for i, x in enumerate(each) if x.size]
            yield _rows(_CANDIDATES, key=[row["keys"][16 * i : 16 * i + 16] for i in some], runs=[each[i].tobytes() for i in some])


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = gram(length)
        for texts, keys, runs in _texts(batches, "key", "runs"):
            name, held, starts, index, counts, hashes = common.next_name(), {}, [], [], [], []
            for text, own in zip(texts, runs, strict=True):
                first, count, at = np.frombuffer(own, np.int32).reshape(3, -1)
                data = np.frombuffer(text, np.uint8)
                h = np.ascontiguousarray(_grams(data[(first + at)[:, None] + np.arange(k)], k)[:, 0]).view(np.int64)
                for f, c, a, x in zip(first.tolist(), count.tolist(), at.tolist(), h.tolist(), strict=True):
                    content = text[f : f + c + length - 1]
                    entry = held.setdefault((x, content), [len(held), a, 0])
                    entry[2] += 1
                    index.append(entry[0])
                starts.append(first)
                counts.append(len(first))
            content = [c for _, c in held]
            idx, at, times = zip(*held.values(), strict=True)
            n = len(held)
            yield _rows(
                _CONTEXTS, kind=[0] * n, h=[h for h, _ in held], slice=[name] * n, idx=idx, base=[0] * n, at=at, low=[k - length] * n, high=[0] * n, content=content, size=[len(c) for c in content], times=times
            )
            packed = {"keys": b"".join(keys), "counts": np.array(counts, np.int32).tobytes(), "starts": np.concatenate(starts).astype(np.int32).tobytes(), "index": np.array(index, np.int32).tobytes()}
            yield _rows(_CONTEXTS, kind=[1], slice=[name], **{c: [v] for c, v in packed.items()})

    return run


def _halved(length: int):
    """Contexts of crowded anchors -> the two halves of their windows, each with all bytes that such windows share as its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for r in batch.to_pylist():
                windows = r["size"] - length + 1
                middle = (r["low"] + r["high"]) // 2
                for low, high in ((r["low"], middle), (middle + 1, r["high"])):
                    first, last = max(low + r["at"], 0), min(high + r["at"], windows - 1)
                    if first > last:
                        continue
                    shared = r["content"][max(r["at"] + high, 0) : r["at"] + low + length]
                    key = hashlib.blake2b(shared, digest_size=8, key=r["h"].to_bytes(8, "little", signed=True) + bytes([low & 255, low >> 8 & 255])).digest()
                    content = r["content"][first : last + length]
                    out.append(r | {"h": int.from_bytes(key, "little", signed=True), "base": r["base"] + first, "at": r["at"] - first, "low": low, "high": high, "content": content, "size": len(content)})
            if out:
                yield _rows(_CONTEXTS, **{c: [r[c] for r in out] for c in _kinds(_CONTEXTS)})

    return run


def _shard(length: int):
    def run(key, table):
        h, content, times, at = (table.column(c).to_pylist() for c in ("h", "content", "times", "slice"))
        by: dict[int, dict[bytes, int]] = {}
        for a, c, t in zip(h, content, times, strict=True):
            own = by.setdefault(a, {})
            own[c] = own.get(c, 0) + t
        found = judged(by, length)
        edges: dict[tuple[int, bytes], np.ndarray] = {s: np.flatnonzero(np.diff(f, prepend=False, append=False)).reshape(-1, 2) for s, f in found.items()}
        out: dict[int, list[np.ndarray]] = {}
        for a, c, s, i, b in zip(h, content, at, table.column("idx").to_pylist(), table.column("base").to_pylist(), strict=True):
            spans = edges.get((a, c))
            if spans is not None:
                out.setdefault(s, []).append(np.column_stack([np.full(len(spans), i), spans + b]))
        return pa.Table.from_batches([_rows(_FOUND, slice=list(out), spans=[np.concatenate(x).astype(np.int32).tobytes() for x in out.values()])])

    return run


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of (start, end) rows."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    until = np.maximum.accumulate(spans[:, 1])
    first = np.append(True, spans[1:, 0] > until[:-1])
    return np.column_stack([spans[first, 0], until[np.append(first[1:], True)]])


def _spans(length: int):
    """Slices with what was found in their contexts -> the bytes to remove of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = np.concatenate([np.frombuffer(x, np.int32).reshape(-1, 3) for x in row["spans"]]).astype(np.int64)
                found = found[np.argsort(found[:, 0], kind="stable")]
                index, starts = np.frombuffer(row["index"], np.int32), np.frombuffer(row["starts"], np.int32)
                first, last = np.searchsorted(found[:, 0], index), np.searchsorted(found[:, 0], index, side="right")
                many = last - first
                which = np.repeat(np.arange(len(index)), many)
                at = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
                spans = found[at, 1:] + starts[which, None]
                spans[:, 1] += length - 1
                counts = np.frombuffer(row["counts"], np.int32)
                doc = np.repeat(np.arange(len(counts)), counts)[which]
                each = np.split(spans, np.cumsum(np.bincount(doc, minlength=len(counts)))[:-1])
                some = [i for i, x in enumerate(each) if len(x)]
                yield _rows(_SPANS, key=[row["keys"][16 * i : 16 * i + 16] for i in some], spans=[merged(each[i]).astype(np.int64).tobytes() for i in some])

    return run


# ------------------------------------------------------------ the operator


def _found(contexts: DataFrame, length: int) -> list[DataFrame]:
    """What the shards find, for each level of halving."""
    out, rows = [], contexts
    while True:
        sizes = rows.groupBy("h").agg(F.sum("size").alias("bytes"), F.min("low").alias("low"), F.max("high").alias("high"))
        crowded = common.materialise(sizes.where((F.col("bytes") > ANCHOR_BYTES) & (F.col("low") < F.col("high"))).select("h"), "crowded")
        hot = crowded.count()
        # each crowded anchor has ANCHOR_BYTES of contexts, so their number is a small share of the table's
        cool = rows.join(F.broadcast(crowded), "h", "left_anti") if hot else rows
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // SHARD_BYTES))
        dealt = cool.select("h", "slice", "idx", "base", "content", "times", F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard"))
        out.append(common.materialise(dealt.groupBy("shard").applyInArrow(_shard(length), _FOUND), "found"))
        if not hot:
            return out
        rows = common.materialise(rows.join(F.broadcast(crowded), "h", "left_semi").mapInArrow(_halved(length), _CONTEXTS), "halves")


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, spans): for each text with a passage that stands elsewhere too, in any text or again in the same, the byte runs that such passages cover.

    key: MD5 of the text; equal texts have one row. spans: pairs of 64-bit little-endian numbers, begin and end.
    """
    if length < 3:
        raise ValueError("a passage has 3 bytes or more")
    plain = F.coalesce(F.col(text), F.lit("")).cast("binary")
    named = docs.select(plain.alias("text")).select(F.unhex(F.md5("text")).alias("key"), "text").where(F.octet_length("text") >= length)
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 << max(4, (total // PART_BYTES).bit_length())
    slices = common.materialise(named.select("key", "text").mapInArrow(_sliced(length, parts), _SLICES), "slices")
    flags = slices.where("kind = 0").select("slice", "part", "hashes", "many").groupBy("part").applyInArrow(_counted, _FLAGS)
    flags = flags.groupBy("slice").agg(F.collect_list(F.struct("part", "flags")).alias("flags"))
    chosen = slices.where("kind = 1").select("slice", "keys", "counts", "sizes", "runs", "index").join(flags, "slice").mapInArrow(_chosen, _CANDIDATES)
    candidates = common.materialise(chosen.groupBy("key").agg(F.max("runs").alias("runs")), "candidates")
    near = common.perhaps(named, candidates, "key", "near").where("near").drop("near").join(candidates, "key").select("key", "text", "runs")
    contexts = common.materialise(near.mapInArrow(_cut(length), _CONTEXTS), "contexts")
    found = None
    for some in _found(contexts.where("kind = 0"), length):
        found = some if found is None else found.unionByName(some)
    found = found.groupBy("slice").agg(F.collect_list("spans").alias("spans"))
    met = contexts.where("kind = 1").select("slice", "keys", "counts", "starts", "index").join(found, "slice")
    spans = met.mapInArrow(_spans(length), _SPANS)
    return common.materialise(spans.groupBy("key").agg(F.max("spans").alias("spans")), "spans")


@F.pandas_udf(BinaryType())
def _kept(text: pd.Series, spans: pd.Series) -> pd.Series:
    def one(data: bytes, cuts: bytes) -> bytes:
        edges = np.concatenate([[0], np.frombuffer(cuts, np.int64), [len(data)]]).reshape(-1, 2)
        return b"".join(data[a:b] for a, b in edges.tolist())

    return pd.Series([one(t, s) for t, s in zip(text, spans, strict=True)], dtype=object)


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with ``kept`` (binary: the text's bytes without all passages that stand elsewhere too) and ``spans`` (binary: their runs, null if none).

    Null texts are empty; texts shorter than ``length`` keep all; copies lose all their passages, every one of them; long
    texts are whole texts; an empty table gives none. Cuts may lie inside a character. Columns are kept, whatever their
    names but ``kept`` and ``spans``. Texts are told apart by their MD5.
    """
    found = repeated_spans(docs, text, length)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    rows = docs.select(own, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))
    rows = common.perhaps(rows.withColumn("key", F.unhex(F.md5("data"))), found, "key", "near")
    clean = rows.where("NOT near").select("own", F.col("data").alias("kept"), F.lit(None).cast("binary").alias("spans"))
    met = rows.where("near").join(found, "key", "left")
    touched = met.where("spans IS NOT NULL").select("own", _kept("data", "spans").alias("kept"), "spans")
    clean = clean.unionByName(met.where("spans IS NULL").select("own", F.col("data").alias("kept"), "spans"))
    return clean.unionByName(touched).select("own.*", "kept", "spans")


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    found = remove_repeats(docs.select("doc_id", "text"), length=length)
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return found.select("doc_id", size.alias("n_bytes"), (size - F.octet_length("kept")).cast("long").alias("n_removed"), F.coalesce((F.octet_length("spans") / 16).cast("long"), F.lit(0).cast("long")).alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_suffix_dedup(spark, sf_dir):
    return digests(common.table(spark, sf_dir, "documents"))


#: Every window of every text; what lies between the runs of repeated ones is kept.
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT rid, i, b[i:i + {LENGTH - 1}] AS s FROM (SELECT rid, b, unnest(range(1, octet_length(b) - {LENGTH - 2})) AS i FROM d)),
twice AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1),
starts AS (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= {LENGTH} THEN 0 ELSE 1 END AS fresh FROM w SEMI JOIN twice USING (s)),
numbered AS (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS run FROM starts),
runs AS (SELECT rid, run, min(i) AS first, max(i) + {LENGTH - 1} AS last FROM numbered GROUP BY rid, run),
ends AS (SELECT rid, run, first, last, coalesce(lag(last) OVER (PARTITION BY rid ORDER BY run), 0) AS before FROM runs UNION ALL SELECT d.rid, 1000000000000, octet_length(b) + 1, NULL, coalesce(max(last), 0) FROM d LEFT JOIN runs USING (rid) GROUP BY d.rid, b),
kept AS (SELECT rid, string_agg(hex(b[before + 1:first - 1]), '' ORDER BY run) AS bytes FROM ends JOIN d USING (rid) GROUP BY rid),
gone AS (SELECT rid, sum(last - first + 1) AS n, count(*) AS spans FROM runs GROUP BY rid)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(bytes)) AS kept_sha256
FROM d JOIN kept USING (rid) LEFT JOIN gone USING (rid)
"""
