"""A Merkle manifest of a table, level by level as DataFrames.

Rows are leaves; the leaves of a group (language) are numbered by a sort over ranges, without a window over a group. A
level's nodes go by the number of their parent (own number divided by the fanout): sorted arrays of at most ``fanout``
children are hashed into parents, until each group has one node, its subroot; subroots are the leaves of the last tree.
Then paths come down: at each level parents hand their path to their children, with the siblings that each child has
before and after it. Levels shrink by the fanout, so all of them together move little more than the lowest one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from . import common

#: What a leaf holds, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that paths come down in one plan.
PLANNED = 6
_PATH = "array<struct<before:binary,after:binary>>"


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _hash(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def leaf(*values: Column) -> Column:
    """SHA-256 (binary) over each value as its length in bytes, a colon and the value; a null is a hyphen."""
    text = [v.cast("string") for v in values]
    return _hash(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]))


def _levels(n: int, fanout: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def _climb(nodes: DataFrame, fanout: int, *payload: str) -> DataFrame:
    """Parents (g, i, n, children, hash) of nodes (g, i, n, hash, payload); n: the nodes that a level has in its group."""
    child = F.struct("i", "hash", *payload)
    up = nodes.groupBy("g", F.expr(f"i div {fanout}").alias("up")).agg(F.sort_array(F.collect_list(child)).alias("children"), F.first("n").alias("n"))
    digests = F.array_join(F.transform("children", lambda c: _hex(c["hash"])), "")
    return up.select("g", F.col("up").alias("i"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), "children", _hash(digests).alias("hash"))


def _tree(nodes: DataFrame, most: int, fanout: int, *payload: str) -> list[DataFrame]:
    """Levels of the trees of all groups, from ``nodes`` up, each written; a group is absent above its root."""
    levels = [nodes]
    for k in range(_levels(most, fanout)):
        levels.append(common.materialise(_climb(levels[-1].where("n > 1"), fanout, *(payload if k == 0 else ())), "merkle"))
    return levels


def _roots(levels: list[DataFrame]) -> DataFrame:
    """(g, hash, level) of the root of each group."""
    out = None
    for k, level in enumerate(levels):
        own = level.where("n = 1").select("g", "hash", F.lit(k).alias("level"))
        out = own if out is None else out.unionByName(own)
    return out


def _handed(parents: DataFrame) -> DataFrame:
    """Children of parents that have their path: (g, child, path, kept columns), each with its siblings."""
    joined = lambda part: F.aggregate(part, F.lit(b""), lambda acc, c: F.concat(acc, c["hash"]))
    kept = [c for c in parents.columns if c not in ("i", "n", "children", "hash", "path")]
    each = parents.select(*kept, "children", "path", F.posexplode("children").alias("p", "child"))
    step = F.struct(joined(F.slice("children", 1, F.col("p"))).alias("before"), joined(F.slice("children", F.col("p") + 2, F.size("children"))).alias("after"))
    return each.select(*kept, "child", F.concat(F.array(step), "path").cast(_PATH).alias("path"))


def _down(levels: list[DataFrame], starts: DataFrame, *kept: str) -> DataFrame:
    """(g, child, path, kept) of all nodes of the lowest level; starts: (g, level, path, kept) of the root of each group."""
    here = None
    for k in range(len(levels) - 1, 0, -1):
        own = starts.where(F.col("level") == k).select("g", F.lit(0).cast("long").alias("i"), "path", *kept)
        here = own if here is None else here.select("g", F.col("child.i").alias("i"), "path", *kept).unionByName(own)
        here = _handed(levels[k].join(here, ["g", "i"]))
        if k > 1 and k % PLANNED == 1:  # high levels are small; a plan of all levels would be long
            here = common.materialise(here, "merkle-paths")
    alone = levels[0].where("n = 1").drop("n").join(starts.where("level = 0").drop("level"), "g")
    child = F.struct("i", "hash", *[c for c in levels[0].columns if c not in ("g", "i", "n", "hash")])
    alone = alone.select("g", *kept, child.alias("child"), "path")
    return alone if here is None else here.select("g", *kept, "child", "path").unionByName(alone)


def manifest(leaves: DataFrame, group: str = "lang", order: str = "doc_id", fanout: int = 2) -> DataFrame:
    """``leaves`` (group, order, ``leaf`` as binary, other columns) with ``subroot``, ``root`` and ``path``.

    path: for each level from the leaf up to the root, the digests of the siblings before and after, concatenated.
    Leaves of a group go by ``order``, then by digest; groups by UTF-8 bytes, null first. Equal rows are leaves of their
    own, whichever is first; null orders come first; an empty table gives no rows.
    """
    if fanout < 2:
        raise ValueError("fanout must be 2 or more")
    others = [c for c in leaves.columns if c not in (group, "leaf")]
    named = leaves.select(F.col(group).alias("_group"), F.col("leaf").alias("hash"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest"), F.col(order).alias("_order"))
    placed = numbered(named, ["_group"], ["_order", "hash"], "i", "n")
    placed = common.materialise(placed.select("_group", (F.col("i") - 1).alias("i"), "n", "hash", "rest"), "merkle-leaves")
    groups = numbered(placed.where("i = 0").select(F.col("_group").alias("name"), F.col("n").alias("size")), [], ["name"], "g", "groups")
    groups = common.materialise(groups.select("name", "size", (F.col("g") - 1).alias("g"), "groups"), "merkle-groups")
    most, of = groups.agg(F.max("size"), F.max("groups")).first()
    nodes = placed.join(groups, F.col("_group").eqNullSafe(F.col("name"))).select("g", "i", "n", "hash", "rest", F.col("name").alias("group"))
    levels = _tree(nodes, most or 0, fanout, "rest", "group")
    subroots = common.materialise(_roots(levels), "merkle-subroots")
    # the tree over groups has one group of its own
    top = subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), F.lit(of or 0).cast("long").alias("n"), "hash", F.col("level").alias("at"))
    above = _tree(top, of or 0, fanout, "at")
    root = _roots(above).select("hash").first()
    begin = _roots(above).select("g", "level", F.array().cast(_PATH).alias("path"))
    starts = _down(above, begin).select(F.col("child.i").alias("g"), F.col("child.at").alias("level"), "path", F.col("child.hash").alias("subroot"))
    out = _down(levels, common.materialise(starts, "merkle-starts"), "subroot")
    columns = [F.col(f"child.rest.`{c}`").alias(c) for c in others]
    return out.select(*columns, F.col("child.group").alias(group), F.col("child.hash").alias("leaf"), "subroot", F.lit(bytes(root.hash) if root else None).cast("binary").alias("root"), "path")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, start, lambda acc, s: _hash(_hex(F.concat(s["before"], acc, s["after"]))))


def proof(path: Column) -> Column:
    """All digests of a path, in hex, from the leaf up."""
    return F.array_join(F.transform(path, lambda s: _hex(F.concat(s["before"], s["after"]))), "")


def verified(docs: DataFrame, tampered: Column, fanout: int = 2) -> DataFrame:
    """Every row of ``docs`` proved against the manifest of all rows; where ``tampered``, with one more in n_chars.

    Null ids are not tampered with and null n_chars stay; empty and long texts are texts; repeated rows are rows of their
    own; an empty table gives no rows; other columns play no part.
    """
    values = {c: F.col(c) for c in FIELDS}
    claimed = leaf(*(values | {"n_chars": F.col("n_chars") + 1}).values())
    leaves = docs.select("doc_id", "lang", leaf(*values.values()).alias("leaf"), F.when(F.coalesce(tampered, F.lit(False)), claimed).alias("claimed"))
    found = manifest(leaves, fanout=fanout).withColumn("folded_root", folded(F.coalesce("claimed", "leaf"), F.col("path")))
    digests = [_hex(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")]
    return found.select("doc_id", *digests, F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), _hex(F.col("folded_root")).alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_merkle(spark, sf_dir):
    return verified(common.table(spark, sf_dir, "documents"), common.crc_mod("doc_id", 7) == 0)


_LEAF_SQL = "sha256(" + " || ".join(f"coalesce(strlen(CAST({{{c}}} AS VARCHAR)) || ':' || CAST({{{c}}} AS VARCHAR), '-')" for c in FIELDS) + ")"
_OWN = {c: c for c in FIELDS}

#: CRC-32 by its polynomial; trees by recursion over levels, of languages first, then of their subroots.
OP13_SQL = f"""
WITH RECURSIVE bits(b, k, v) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
docs AS (SELECT *, CAST(doc_id AS VARCHAR) AS id FROM documents),
summed AS (SELECT docs.*, xor(list_reduce(list_transform(range(1, length(id) + 1), lambda p: CAST(ascii(substr(id, p, 1)) AS BIGINT)), lambda a, c: xor(a >> 8, t[1 + xor(a & 255, c)]), 4294967295::BIGINT), 4294967295) % 7 = 0 AS bad FROM docs, crc),
leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {_LEAF_SQL.format(**_OWN)} AS h, CASE WHEN bad THEN {_LEAF_SQL.format(**_OWN | {"n_chars": "(n_chars + 1)"})} ELSE {_LEAF_SQL.format(**_OWN)} END AS claimed FROM summed),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (ORDER BY g, doc_id NULLS FIRST, h) AS rid FROM leaves),
up(g, k, i, n, h) AS (SELECT g, 0, i, n, h FROM placed UNION ALL SELECT g, k + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY g, k, i // 2, (n + 1) // 2),
subroots AS (SELECT g, h, k AS levels, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
top(k, i, n, h) AS (SELECT 0, i, n, h FROM subroots UNION ALL SELECT k + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY k, i // 2, (n + 1) // 2),
goal AS (SELECT h AS root, k AS levels FROM top WHERE n = 1),
walk(rid, k, acc, proof) AS (
  SELECT rid, 0, claimed, '' FROM placed
  UNION ALL
  SELECT w.rid, w.k + 1,
         CASE WHEN s.h IS NULL THEN sha256(w.acc) WHEN w.own % 2 = 0 THEN sha256(w.acc || s.h) ELSE sha256(s.h || w.acc) END, w.proof || coalesce(s.h, '')
  FROM (SELECT w.*, p.g, r.levels, CASE WHEN w.k < r.levels THEN p.i >> w.k ELSE r.i >> (w.k - r.levels) END AS own FROM walk w JOIN placed p USING (rid) JOIN subroots r ON r.g = p.g, goal WHERE w.k < r.levels + goal.levels) w
  LEFT JOIN (SELECT g, k, i, h FROM up UNION ALL SELECT NULL, k, i, h FROM top) s
    ON s.g IS NOT DISTINCT FROM (CASE WHEN w.k < w.levels THEN w.g END) AND s.k = (CASE WHEN w.k < w.levels THEN w.k ELSE w.k - w.levels END) AND s.i = xor(w.own, 1)),
ends AS (SELECT rid, max(k) AS k FROM walk GROUP BY rid)
SELECT p.doc_id, p.h AS leaf, r.h AS subroot, root, sha256(w.proof) AS proof_sha256, w.acc AS folded_root, w.acc = root AS verified
FROM placed p JOIN ends USING (rid) JOIN walk w ON w.rid = p.rid AND w.k = ends.k JOIN subroots r ON r.g = p.g, goal
"""
