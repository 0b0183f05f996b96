"""Full-text search: tokens as SQLite's ``unicode61`` makes them, and a stored positional index.

Tokens have to be those of the exported SQLite files. The tokeniser's rules (which characters part tokens, which marks
vanish, how letters fold) are asked from SQLite itself, one character at a time, when first needed; a translation by that
table and a split at blanks then make tokens inside the JVM.

The index is a folder. Tasks invert the documents that they read, slice by slice (a segment), and write posting blocks:
for a token and up to ``DOCS`` documents of a segment, documents, numbers of places and places, each delta coded in
variable-length bytes. Blocks lie in folders by a hash of the token and say which documents they span, so a search reads
the blocks of its tokens and decodes those that may meet. A token that is everywhere has many blocks in many segments.
Statistics are kept as signed rows: an addition adds its documents and tokens, a deletion takes them away.
"""

from __future__ import annotations

import functools
import itertools
import sqlite3
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import work

#: BM25 constants of the full-text module of the exported files. Fixed values.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Documents of a posting block, tokens of a segment, folders of blocks.
DOCS, TOKENS, FOLDERS = 512, 1_000_000, 64
#: Posting blocks that a task hands over at once.
SENT = 4096


# ------------------------------------------------------------ tokens


@functools.cache
def folding() -> tuple[str, str]:
    """(from, to) of a translation after which blanks part tokens; characters of ``from`` beyond ``to`` vanish.

    Covers the planes 0 and 1; all further characters are their own tokens' characters in SQLite as well.
    """
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(c)")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, instance)")
    chars = [c for c in map(chr, range(1, 0x20000)) if not "\ud800" <= c <= "\udfff"]
    db.executemany("INSERT INTO t(rowid, c) VALUES (?, ?)", ((ord(c), f"x{c}y") for c in chars))
    met: dict[int, list[str]] = {}
    for term, row in db.execute("SELECT term, doc FROM v ORDER BY doc, offset"):
        met.setdefault(row, []).append(term)
    db.close()
    mapped, parting, gone = {"\0": " "}, [], []
    for c in chars:
        terms = met[ord(c)]
        if len(terms) > 1:
            parting.append(c)
        elif terms[0] == "xy":
            gone.append(c)
        elif terms[0] != f"x{c}y":
            mapped[c] = terms[0][1:-1]
    parting.remove(" ")
    return "".join([*mapped, *parting, *gone]), "".join(mapped.values()) + " " * len(parting)


def tokens(content: Column) -> Column:
    """The tokens of a text, in order; a null text has a null array."""
    return F.filter(F.split(F.translate(content, *folding()), " "), lambda t: t != "")


@functools.cache
def _table() -> dict[int, str | None]:
    old, new = folding()
    return {ord(c): new[i] if i < len(new) else None for i, c in enumerate(old)}


def fold_phrase(text: str) -> list[str]:
    """Tokens of a quoted phrase, as ``tokens`` makes them."""
    return [t for t in text.translate(_table()).split(" ") if t]


# ------------------------------------------------------------ coding


def encoded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative numbers as bytes of seven bits, low bits first, the last byte of a number below 128; and where each ends."""
    values = np.asarray(values, np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1) << np.uint64(7 * k)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        own = size > k
        part = (values[own] >> np.uint64(7 * k)) & np.uint64(127)
        out[ends[own] - size[own] + k] = part | np.where(size[own] > k + 1, np.uint64(128), np.uint64(0))
    return out, ends


def decoded(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    first = np.append(0, last[:-1] + 1) if len(last) else last
    out, size = np.zeros(len(last), np.int64), last - first + 1
    for k in range(int(size.max(initial=0))):
        own = size > k
        out[own] |= (raw[first[own] + k].astype(np.int64) & 127) << 7 * k
    return out


def _deltas(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences to the value before; values at ``starts`` stay."""
    out = np.diff(values, prepend=0)
    out[starts] = values[starts]
    return out


def inverted(words: Sequence[Sequence[str]] | pa.Array) -> Iterator[tuple]:
    """Posting blocks (token, n, first, last, docs, counts, places) of the documents of a segment."""
    lists = words if isinstance(words, pa.Array) else pa.array([list(w) for w in words], pa.list_(pa.string()))
    sizes, flat = pc.list_value_length(lists).to_numpy(), lists.flatten()
    if not len(flat):
        return
    coded = flat.dictionary_encode()  # no token becomes an object of Python, but each different one
    code, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    doc = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.argsort(code, kind="stable")
    code, doc, place = code[order], doc[order], place[order]
    # an entry is a token in a document; a block is up to DOCS entries of a token
    entry = np.flatnonzero(np.append(True, (np.diff(code) != 0) | (np.diff(doc) != 0)))
    token, at = code[entry], doc[entry]
    first = np.flatnonzero(np.append(True, np.diff(token) != 0))
    rank = np.arange(len(entry)) - np.repeat(first, np.diff(first, append=len(entry)))
    block = np.flatnonzero(rank % DOCS == 0)
    docs, doc_ends = encoded(_deltas(at, block))
    counts, count_ends = encoded(np.diff(entry, append=len(code)))
    places, place_ends = encoded(_deltas(place, entry))
    until = np.append(block[1:], len(entry))
    cut = lambda data, ends, a, b: data[ends[a - 1] if a else 0 : ends[b - 1]].tobytes()
    spans = np.append(entry, len(code))
    for a, b in zip(block.tolist(), until.tolist(), strict=True):
        yield names[token[a]], b - a, int(at[a]), int(at[b - 1]), cut(docs, doc_ends, a, b), cut(counts, count_ends, a, b), cut(places, place_ends, spans[a], spans[b])


def postings(docs: bytes, counts: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, numbers of places, places) of a block."""
    at, n, gaps = np.cumsum(decoded(docs)), decoded(counts), decoded(places)
    total, begin = np.cumsum(gaps), np.cumsum(n) - n
    return at, n, total - np.repeat(total[begin] - gaps[begin], n)


def frequencies(blocks: dict[str, list[tuple]], phrase: Sequence[str]) -> dict[int, int]:
    """Document -> how often the phrase stands there. blocks: of each token, (first, last, docs, counts, places).

    The token with the fewest documents leads; of the others only blocks that span one of its documents are decoded, and
    documents that fail drop out before the next token is looked at.
    """
    if any(t not in blocks for t in phrase):
        return {}
    found: np.ndarray | None = None  # document << 32 | place of the phrase's begin
    lead = sorted(range(len(phrase)), key=lambda i: sum(b[1] - b[0] + 1 for b in blocks[phrase[i]]))
    for i in lead:
        held = found >> 32 if found is not None else None
        parts = []
        for first, last, *coded in blocks[phrase[i]]:
            if held is not None:
                near = np.searchsorted(held, first)
                if near == len(held) or held[near] > last:
                    continue
            at, n, place = postings(*coded)
            begin = (np.repeat(at, n) << 32) + place - i
            parts.append(begin[place >= i])
        here = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        found = here if found is None else np.intersect1d(found, here, assume_unique=True)
        if not len(found):
            return {}
        found = np.sort(found)
    at, n = np.unique(found >> 32, return_counts=True)
    return dict(zip(at.tolist(), n.tolist(), strict=True))


# ------------------------------------------------------------ the index

_BLOCKS = "segment string, token string, folder int, n int, first int, last int, docs binary, counts binary, places binary"


class TextIndex:
    """The index in folder ``root``, of rows that ``keys`` tell apart (their types: ``kinds``, DDL)."""

    def __init__(self, spark: SparkSession, root: str, kinds: str):
        self.spark, self.root, self.kinds = spark, root.rstrip("/"), kinds
        self.keys = [k.split()[0] for k in kinds.split(",")]

    def _read(self, name: str, kinds: str) -> DataFrame:
        return self.spark.read.schema(kinds).parquet(f"{self.root}/{name}")

    def documents(self) -> DataFrame:
        """(keys, segment, ordinal, size) of all documents that are not deleted."""
        rows = self._read("documents", f"{self.kinds}, segment string, ordinal int, size long")
        return rows.join(self._gone(), ["segment", "ordinal"], "left_anti")

    def _gone(self) -> DataFrame:
        return self._read("gone", "segment string, ordinal int")

    def statistics(self) -> tuple[int, int]:
        """Documents and tokens that the index holds, from the signed rows."""
        row = self._read("statistics", "documents long, tokens long").agg(F.sum("documents"), F.sum("tokens")).first()
        return row[0] or 0, row[1] or 0

    def add(self, rows: DataFrame, content: str = "content") -> None:
        """Adds rows (keys, content); null contents have no tokens. What a failed task leaves is not read."""
        batch, names = uuid.uuid4().hex, self.keys
        kinds = f"{self.kinds}, segment string, ordinal int, size long, {', '.join(c for c in _BLOCKS.split(', ')[1:])}"
        schema = T._parse_datatype_string(kinds)

        typed = {"segment": pa.string(), "ordinal": pa.int32(), "size": pa.int64(), "token": pa.string(), "folder": pa.int32(), "n": pa.int32(), "first": pa.int32(), "last": pa.int32(), "docs": pa.binary(), "counts": pa.binary(), "places": pa.binary()}

        def rows_of(frame: pa.RecordBatch, rows: int, segment: str, /, **columns) -> pa.RecordBatch:
            kinds = {k: frame.schema.field(k).type for k in names} | typed
            columns["segment"] = pa.array([segment] * rows)
            return pa.RecordBatch.from_arrays([c if isinstance(c := columns.get(k), pa.Array) else pa.array(c, kind) if c is not None else pa.nulls(rows, kind) for k, kind in kinds.items()], names=list(kinds))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, number = TaskContext.get().partitionId(), 0
            for frame in batches:
                words = frame.column("_words")
                sizes = pc.list_value_length(words).to_numpy()
                cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // TOKENS, prepend=0)).tolist()
                for begin, end in itertools.pairwise(sorted({0, *cuts, len(sizes)})):
                    segment = f"{batch}-{part}-{number}"
                    number += 1
                    yield rows_of(frame, end - begin, segment, **{k: frame.column(k).slice(begin, end - begin) for k in names}, ordinal=np.arange(end - begin, dtype=np.int32), size=sizes[begin:end].astype(np.int64))
                    blocks = inverted(words.slice(begin, end - begin))
                    while some := list(itertools.islice(blocks, SENT)):
                        fields = dict(zip(("token", "n", "first", "last", "docs", "counts", "places"), zip(*some, strict=True), strict=True))
                        folder = pd.util.hash_array(np.array(fields["token"], object), categorize=False).astype(np.uint64) % FOLDERS
                        yield rows_of(frame, len(some), segment, folder=folder.astype(np.int32), **fields)

        words = F.coalesce(tokens(F.col(content)), F.array().cast("array<string>")).alias("_words")
        made = work.materialise(rows.select(*names, words).mapInArrow(run, schema), "segments")
        documents = made.where("ordinal IS NOT NULL").select(*names, "segment", "ordinal", "size")
        blocks = made.where("ordinal IS NULL").select("token", "segment", "folder", "n", "first", "last", "docs", "counts", "places")
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # blocks of a folder in token order, so that row groups tell which tokens they hold
        blocks.repartition(max(tasks, FOLDERS), "folder", F.pmod(F.xxhash64("segment"), F.lit(max(1, tasks // FOLDERS)))).sortWithinPartitions("folder", "token").write.mode("append").partitionBy("folder").parquet(f"{self.root}/postings")
        documents.write.mode("append").parquet(f"{self.root}/documents")
        documents.limit(0).select("segment", "ordinal").write.mode("append").parquet(f"{self.root}/gone")
        self._count(documents, 1)

    def _count(self, documents: DataFrame, sign: int) -> None:
        made = documents.agg((sign * F.count("*")).alias("documents"), (sign * F.coalesce(F.sum("size"), F.lit(0))).cast("long").alias("tokens"))
        made.coalesce(1).write.mode("append").parquet(f"{self.root}/statistics")

    def delete(self, gone: DataFrame) -> None:
        """Takes rows out by their keys (null keys are equal); keys that are not there, or twice in ``gone``, do no harm."""
        same = F.lit(True)
        for k in self.keys:
            same = same & F.col(f"d.{k}").eqNullSafe(F.col(f"g.{k}"))
        hit = work.materialise(self.documents().alias("d").join(gone.select(*self.keys).alias("g"), same, "left_semi").select("segment", "ordinal", "size"), "gone")
        hit.select("segment", "ordinal").write.mode("append").parquet(f"{self.root}/gone")
        self._count(hit, -1)

    def _blocks(self, wanted: Sequence[str]) -> DataFrame:
        folders = sorted({int(h % FOLDERS) for h in pd.util.hash_array(np.array(wanted, object), categorize=False)})
        return self._read("postings", _BLOCKS).where(F.col("folder").isin(*folders) & F.col("token").isin(*wanted))

    def matches(self, phrases: Sequence[Sequence[str]]) -> DataFrame:
        """(segment, ordinal, f0, f1, ...): rows that hold any of the phrases, with how often they hold each; deleted rows too."""
        wanted = sorted({t for p in phrases for t in p})
        fields = [f"f{i}" for i in range(len(phrases))]
        schema = T._parse_datatype_string(f"segment string, ordinal int, {', '.join(f'{f} long' for f in fields)}")

        def run(key, frame):
            blocks: dict[str, list[tuple]] = {}
            for r in frame.sort_values("first").itertuples():
                blocks.setdefault(r.token, []).append((r.first, r.last, r.docs, r.counts, r.places))
            each = [frequencies(blocks, p) for p in phrases]
            at = sorted(set().union(*each))
            return pd.DataFrame({"segment": key[0], "ordinal": at, **{f: [e.get(d, 0) for d in at] for f, e in zip(fields, each, strict=True)}})

        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self._blocks(wanted).groupBy("segment").applyInPandas(run, schema)

    def holding(self, phrase: Sequence[str]) -> DataFrame:
        """(keys, frequency) of the rows that hold a phrase."""
        found = self.matches([phrase]).join(self.documents(), ["segment", "ordinal"])
        return found.select(*self.keys, F.col("f0").alias("frequency"))

    def bm25(self, phrases: Sequence[Sequence[str]], k: int) -> DataFrame:
        """(keys, rank) of the k best rows that hold every phrase (a smaller rank is better), ties by keys. No text is read."""
        n, total = self.statistics()
        found = work.materialise(self.matches(phrases).join(self._gone(), ["segment", "ordinal"], "left_anti"), "matches")
        hits = found.agg(*[F.count_if(F.col(f"f{i}") > 0) for i in range(len(phrases))]).first()
        rank, every = F.lit(0.0), F.lit(True)
        for i, d in enumerate(hits):
            f, idf = F.col(f"f{i}"), float(np.log((n - d + 0.5) / (d + 0.5))) if 2 * d < n else LEAST_IDF
            rank = rank - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("size") / (total / max(n, 1))))
            every = every & (f > 0)
        met = found.where(every).join(self.documents(), ["segment", "ordinal"])
        return met.select(*self.keys, rank.alias("rank")).orderBy("rank", *self.keys).limit(k)


def build(rows: DataFrame, keys: Sequence[str], content: str = "content", root: str | None = None) -> TextIndex:
    """A new index of all rows, in ``root`` or a work folder."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    index = TextIndex(rows.sparkSession, root or f"{work.shared_dir(rows.sparkSession)}/text-{uuid.uuid4().hex}", kinds)
    index.add(rows, content)
    return index
