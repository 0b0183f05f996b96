"""Secret scans by a trigram inverted index; DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived: strings that every match must hold are
joined along the expression, alternatives are joined by OR, and each string stands for all of its trigrams. The index is a
written table of postings (trigram, document), a folder a trigram; no trigram that no query needs is in it.

A search looks up as few and as short postings as it can. Of trigrams that must all stand in a match the rarest one is
enough to find every candidate, of alternatives each one's; only these folders are read whole. The other postings are
read for these documents alone, and the postings of a document are intersected by each rule's query. What satisfies it is
verified by the expression itself. A rule without a mandatory trigram scans all documents, where they lie; texts move only
if they are candidates of another rule.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    """pattern: for Java and Python alike. A match counts if its ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: The order is that of the kinds. Base rules first: runs shorter than the least length never match on their own.
RULES = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]{14,}", base=True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

#: A query is True, a trigram, ("and", queries) or ("or", queries).
Query = bool | str | tuple
_CHARS, _STRINGS = 8, 64


def _and(parts) -> Query:
    flat: list = []
    for p in parts:
        if p is True:
            continue
        flat += p[1] if isinstance(p, tuple) and p[0] == "and" else [p]
    flat = list(dict.fromkeys(flat))
    return True if not flat else flat[0] if len(flat) == 1 else ("and", tuple(flat))


def _or(parts) -> Query:
    parts = list(dict.fromkeys(parts))
    held = [set(p[1]) if isinstance(p, tuple) and p[0] == "and" else {p} for p in parts]
    # an alternative that asks for more than another one adds nothing
    parts = [p for i, p in enumerate(parts) if not any(held[j] < held[i] for j in range(len(parts)))]
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings) -> Query:
    return _or(_and(s[i : i + 3] for i in range(len(s) - 2)) if len(s) > 2 else True for s in sorted(strings))


def _walk(items) -> tuple[set[str] | None, Query]:
    """(all strings that the items match, if they are few; else None) and the trigram query of a match."""
    query, run, whole = [], {""}, True

    def close(keep: bool = False):
        nonlocal run
        query.append(_of_strings(run))
        run = {s[-2:] for s in run} if keep else {""}

    for op, arg in items:
        strings, inner = None, True
        if op is sre.LITERAL:
            strings = {chr(arg).lower()}
        elif op is sre.IN:
            chars: set[str] | None = set()
            for kind, x in arg:
                if chars is None or kind not in (sre.LITERAL, sre.RANGE) or kind is sre.RANGE and x[1] - x[0] >= _CHARS:
                    chars = None
                else:
                    chars |= {chr(x).lower()} if kind is sre.LITERAL else {chr(c).lower() for c in range(x[0], x[1] + 1)}
            strings = chars if chars and len(chars) <= _CHARS else None
        elif op is sre.SUBPATTERN:
            strings, inner = _walk(arg[3])
        elif op is sre.BRANCH:
            each = [_walk(branch) for branch in arg[1]]
            strings = set().union(*(s for s, _ in each)) if all(s is not None for s, _ in each) else None
            inner = _or(q for _, q in each)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, body = arg
            strings, inner = _walk(body)
            if low == 0:
                strings, inner = (strings | {""} if strings is not None and high == 1 else None), True
            elif (low, high) != (1, 1):
                repeated = {s * low for s in strings} if strings is not None and len(strings) == 1 else None
                strings, inner = (repeated, inner) if low == high else (None, _and([inner, _of_strings(repeated)]) if repeated else inner)
        elif op is sre.AT:
            continue
        if strings is not None and len(run) * len(strings) <= _STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        whole = False
        close()
        query.append(inner)
        if strings is not None and len(strings) <= _STRINGS:
            run = set(strings)
    if whole:
        return run, _of_strings(run)
    close()
    return None, _and(query)


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query, case folded, that every text with a match of the pattern satisfies."""
    return _walk(parser.parse(pattern))[1]


def trigrams(query: Query) -> set[str]:
    return {query} if isinstance(query, str) else set() if query is True else set().union(*map(trigrams, query[1]))


def _holds(query: Query, has) -> Column:
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        return has(query)
    out = _holds(query[1][0], has)
    for q in query[1][1:]:
        out = out & _holds(q, has) if query[0] == "and" else out | _holds(q, has)
    return out


_WORD_BITS = 60


def postings(docs: DataFrame, wanted: list[str], key: str, text: str) -> DataFrame:
    """The inverted index: a row (number of the trigram, document key) for each wanted trigram that a document holds."""
    low = docs.select(key, F.lower(text).alias("_low"))
    found = F.array_compact(F.array(*[F.when(F.col("_low").contains(F.lit(t)), F.lit(i)) for i, t in enumerate(wanted)]))
    return low.select(F.explode(found).alias("trigram"), key)


def stored(index: DataFrame) -> DataFrame:
    """The index as a table with a folder for each trigram, so that a look-up reads that trigram's postings."""
    spark = index.sparkSession
    path = f"{common.shared_dir(spark)}/trigrams-{uuid.uuid4().hex}"
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a long list of postings is several files, a short one few
    dealt = index.repartition(tasks, "trigram", F.pmod(F.xxhash64(*[c for c in index.columns if c != "trigram"]), F.lit(-(-tasks // 16))))
    dealt.write.partitionBy("trigram").parquet(path)
    return index.sparkSession.read.schema(index.schema).parquet(path)


def leads(query: Query, rows: dict[str, int]) -> set[str]:
    """Trigrams of which each match holds one, with few postings in all. rows: how many each has."""
    if isinstance(query, str):
        return {query}
    each = [leads(q, rows) for q in query[1]]
    return min(each, key=lambda own: (sum(rows.get(t, 0) for t in own), sorted(own))) if query[0] == "and" else set().union(*each)


def candidates(index: DataFrame, queries: dict[str, Query], wanted: list[str], key: str) -> DataFrame:
    """Look up and intersect postings: (key, one Boolean per rule) of the documents that satisfy any rule's query."""
    place = {t: i for i, t in enumerate(wanted)}
    held = {r[0]: r[1] for r in index.groupBy("trigram").count().collect()}  # a row a trigram
    rows = {t: held.get(i, 0) for t, i in place.items()}
    first = sorted(place[t] for t in set().union(*(leads(q, rows) for q in queries.values())))
    found = index.where(F.col("trigram").isin(*first))
    others = index.where(~F.col("trigram").isin(*first)).join(found.select(key).distinct(), key, "left_semi")
    words = -(-len(wanted) // _WORD_BITS)
    bit = F.expr(f"shiftleft(1L, cast(trigram % {_WORD_BITS} AS int))")
    bits = [F.bit_or(F.when(F.floor(F.col("trigram") / _WORD_BITS) == w, bit).otherwise(0)).alias(f"_w{w}") for w in range(words)]
    held = found.select("trigram", key).unionByName(others.select("trigram", key)).groupBy(key).agg(*bits)
    has = lambda t: F.col(f"_w{place[t] // _WORD_BITS}").bitwiseAND(F.lit(1 << place[t] % _WORD_BITS)) != 0
    out = held.select(key, *[_holds(q, has).alias(f"_c_{kind}") for kind, q in queries.items()])
    anything = F.lit(False)
    for kind in queries:
        anything = anything | F.col(f"_c_{kind}")
    return out.where(anything)


_SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"
_SHIFTS = [1 << k for k in range(31)]


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _so_far(numbers: Column, join) -> Column:
    """Of each place of an array of ints, the sum (or another associative join) of all up to it, in steps that double."""
    steps = F.filter(F.array(*map(F.lit, _SHIFTS)), lambda d: d < F.size(numbers))

    def step(held, d):
        before = F.concat(F.array_repeat(F.lit(None).cast("int"), d), F.slice(held, 1, F.size(held) - d))
        return F.zip_with(held, before, lambda x, y: F.when(y.isNull(), x).otherwise(join(x, y))).cast("array<int>")

    return F.aggregate(steps, numbers.cast("array<int>"), step)


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule's matches, in code points: a match ends where the gaps and matches up to it add up to."""
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    sizes = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.length)
    counted = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length) if rule.group else sizes

    def listed(m):
        ends = _so_far(F.zip_with(F.slice(gaps, 1, F.size(m)), m, lambda g, n: g + n), lambda x, y: x + y)
        rows = F.arrays_zip(ends.alias("e"), m.alias("m"), counted.alias("n"))
        span = lambda x: F.struct((x["e"] - x["m"]).alias("start"), F.lit(rank).alias("rank"), x["e"].alias("end"), F.lit(rule.kind).alias("kind"))
        return F.transform(F.filter(rows, lambda x: x["n"] >= rule.least), span).cast(_SPAN)

    return F.when(text.rlike(rule.pattern), _let(sizes, listed)).otherwise(F.array().cast(_SPAN))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", spans: str = "_spans") -> DataFrame:
    """``docs`` with a column ``spans``: structs of start, rank (of the kind), end, kind, sorted by start and kind.

    Defined cases: a null text is empty and has no spans; repeated rows are scanned each; null ids are ids; an empty table
    gives an empty result; other columns are kept, whatever their names but that of ``spans``, which is refused.
    """
    if spans.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {spans}; name another one for the spans")
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not True}
    wanted = sorted(set().union(*map(trigrams, indexed.values()))) if indexed else []
    # two documents with one key would both be candidates: more to verify, nothing missed
    key, held, near, text = "_key", "_held", "_near", "_text"
    # the user's columns travel in a struct, so that none of their names meets one of ours
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(own.alias(held), F.xxhash64(F.col(id_col), F.col(text_col)).alias(key), F.coalesce(F.col(text_col), F.lit("")).alias(text))

    def told(rows: DataFrame, looked_up: bool) -> DataFrame:
        parts = []
        for rank, r in enumerate(rules):
            if queries[r.kind] is True:
                parts.append(_spans(F.col(text), r, rank))
            elif looked_up:
                parts.append(F.when(F.coalesce(F.col(f"_c_{r.kind}"), F.lit(False)), _spans(F.col(text), r, rank)).otherwise(F.array().cast(_SPAN)))
        found = F.array_sort(F.concat(*parts)) if parts else F.array().cast(_SPAN)
        return rows.select(held, found.alias(spans))

    if wanted:
        index = stored(postings(keyed.select(key, text), wanted, key, text))
        found = common.materialise(candidates(index, indexed, wanted, key), "candidates")
        flagged = common.perhaps(keyed, found, key, near)
        out = told(flagged.where(~F.col(near)), False).unionByName(told(flagged.where(near).join(found, key, "left"), True))
    else:
        out = told(keyed, False)
    return out.select(f"{held}.*", spans)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a count of each base kind, base_sha256 and spans of every document."""
    found = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), rules)
    base = [r.kind for r in rules if r.base]
    count = lambda k: F.size(F.filter("_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in base]
    return found.select("doc_id", *counts, F.sha2(_listed(F.filter("_spans", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"), _listed(F.col("_spans")).alias("spans"))


#: Code points of the blocks that a text is cut into to be redacted.
_CUT = 1024


def redact(docs: DataFrame, mark: str = "[secret]", text_col: str = "text", spans: str = "_spans") -> DataFrame:
    """``docs`` with each span of ``spans`` replaced by ``mark`` (overlapping spans by one), without ``spans``."""
    text = F.col(text_col)

    def without(blocks):
        def part(a, b):  # from the blocks that hold it
            first, last = (a / _CUT).cast("int"), ((b - 1) / _CUT).cast("int")
            joined = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
            return F.when(b > a, joined.substr(a - first * _CUT + 1, b - a)).otherwise("")

        ends = F.transform(spans, lambda s: s["end"])
        before = _let(_so_far(ends, F.greatest), lambda e: F.concat(F.array(F.lit(0)), F.slice(e, 1, F.size(e) - 1)))
        pieces = F.zip_with(spans, before, lambda s, b: F.when(s["start"] >= b, F.concat(part(b, s["start"]), F.lit(mark))).otherwise(""))
        rest = part(F.array_max(ends), F.length(text))
        return F.concat(F.array_join(pieces, ""), rest)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CUT}}}"), F.lit(0))
    new = F.when(F.size(spans) > 0, _let(blocks, without)).otherwise(text)
    return docs.withColumn(text_col, new).drop(spans)


def op7_secrets(spark, sf_dir):
    return digests(common.table(spark, sf_dir, "documents"))


def _matches_sql(rule: Rule, rank: int) -> str:
    quoted = rule.pattern.replace("'", "''")
    return f"""SELECT rid, {rank} AS rank, '{rule.kind}' AS kind, {rule.least} AS least, regexp_extract_all(text, '{quoted}', 0) AS m,
       regexp_extract_all(text, '{quoted}', {rule.group}) AS n, regexp_split_to_array(text, '{quoted}') AS g FROM d"""


#: Every rule on every text, without an index; a match ends where the gaps and matches up to it add up to.
OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
a AS ({" UNION ALL ".join(_matches_sql(r, i) for i, r in enumerate(RULES))}),
u AS (SELECT rid, rank, kind, least, unnest(m) AS m, unnest(n) AS n, unnest(g[1:len(m)]) AS g, generate_subscripts(m, 1) AS i FROM a WHERE len(m) > 0),
e AS (SELECT *, CAST(sum(length(g) + length(m)) OVER (PARTITION BY rid, rank ORDER BY i) AS BIGINT) AS stop FROM u),
s AS (SELECT rid, rank, kind, stop - length(m) AS start, concat_ws(':', kind, stop - length(m), stop) AS span FROM e WHERE length(n) >= least),
t AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(span, ',' ORDER BY start, rank) FILTER (kind IN ('assign', 'access', 'hex')) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN t USING (rid)
"""
