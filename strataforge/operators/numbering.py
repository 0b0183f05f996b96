"""Numbers of rows within groups of any size, without a window over a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import work

#: Rows of a range, on average.
ROWS = 200_000
_BITS = 33  # of monotonically_increasing_id that count the rows of a partition


def ranged(rows: DataFrame, *order: Column | str, name: str, tasks: int | None = None) -> DataFrame:
    """``rows`` sorted over ranges, as a work table with a long ``name`` that grows along the order.

    Rows that are equal in ``order`` may lie in several ranges, so a value that many rows share sets no task's size. Among
    them a hash of the row decides, and only among copies their place in the input; copies had better come from files, which
    a task that runs again reads in the same order.
    """
    spark = rows.sparkSession
    own, copy = work.unused([*rows.columns, name], "own", "copy")
    tie = [own, copy]
    hashed = [F.col(f"`{c}`") for c, kind in rows.dtypes if "map<" not in kind and kind != "variant"]
    tied = rows.withColumns({own: F.xxhash64(*hashed) if hashed else F.lit(0), copy: F.monotonically_increasing_id()})
    tasks = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS))
    spread = tied.repartitionByRange(tasks, *order, *tie).sortWithinPartitions(*order, *tie).drop(*tie)
    return work.materialise(spread.withColumn(name, F.monotonically_increasing_id()), "ranged")


def numbered(rows: DataFrame, groups: Sequence[str], order: Sequence[Column | str], name: str, total: str | None = None, sums: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with ``name``, their place (1, 2, ...) in their group by ``order``, and ``total``, their group's rows.

    sums: name -> a column of numbers; the name's column holds the sum of it over the rows before, in the same order.
    Rows are sorted over ranges and written; the rows of each range and group are counted, and sums of the counts of the
    ranges before give each range its first number. A group takes as many ranges as it needs: its rows never meet in one
    task, its counts (one a range) do. Nulls come first and null groups are groups. Rows that are equal in groups and order
    are numbered in any order. An empty table gives none.
    """
    sums = sums or {}
    at, part, first, n, before, size = work.unused([*rows.columns, *sums], "at", "part", "first", "n", "before", "size")
    table = ranged(rows, *groups, *order, name=at).withColumn(part, F.shiftright(at, _BITS))
    counts = table.groupBy(part, *groups).agg(F.min(at).alias(first), F.count("*").alias(n), *[F.sum(c).cast("long").alias(s) for s, c in sums.items()])
    own = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    earlier = own.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    firsts = counts.select(part, *groups, first, so_far(n).alias(before), F.sum(n).over(own).alias(size), *[so_far(s).alias(s) for s in sums]).alias("f")
    same = F.col(f"t.{part}") == F.col(f"f.{part}")
    for g in groups:
        same = same & F.col(f"t.`{g}`").eqNullSafe(F.col(f"f.`{g}`"))
    met = table.alias("t").join(firsts, same)
    number = (F.col(before) + F.col(at) - F.col(first) + 1).cast("long").alias(name)
    inside = Window.partitionBy(F.col(f"t.{part}"), *[F.col(f"t.`{g}`") for g in groups]).orderBy(F.col(f"t.{at}")).rowsBetween(Window.unboundedPreceding, -1)  # what a range has of a group
    running = [(F.col(f"f.{s}") + F.coalesce(F.sum(F.col(f"t.`{c}`")).over(inside), F.lit(0))).cast("long").alias(s) for s, c in sums.items()]
    return met.select(*[F.col(f"t.`{c}`") for c in rows.columns], number, *([F.col(size).cast("long").alias(total)] if total else []), *running)
