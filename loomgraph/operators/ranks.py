"""Ranks, running sums and prefixes of ordered rows, without a task that sees all of them.

Rows are dealt to ranges of their order, sorted there and numbered as they are
written. What stands before a range follows from one count or sum for each range
and key, and so does every rank: a key that holds most of the rows is spread over
as many ranges as it fills.

Ties are ordered by all columns named in the order only, so name enough of them;
rows that are equal in all of these may change places between runs, not within
one. Nulls come first. Empty tables give empty tables.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

#: Bits of a row's place in its range; above them is the range.
PLACE_BITS = 33


def in_ranges(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """``df``, written once, with __range (growing with the order) and __place (from 0 in each range)."""
    at = F.monotonically_increasing_id()
    out = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at)
    out = out.withColumn("__range", F.shiftright("__at", PLACE_BITS)).withColumn("__place", F.col("__at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))
    return materialise(df.sparkSession, out.drop("__at"), "ranges")


def offsets(placed: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """For each key and range: __first (its first place there), __before (its rows in earlier ranges), and what ``sums`` add up to there (__before_name)."""
    per = placed.groupBy(*keys, "__range").agg(F.min("__place").alias("__first"), F.count("*").alias("__n"), *[F.sum(c).alias(f"__sum_{n}") for n, c in sums.items()])
    names = {"__before": "__n"} | {f"__before_{n}": f"__sum_{n}" for n in sums}
    if keys:  # as many rows for a key as it has ranges
        earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        return per.select(*keys, "__range", "__first", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(n) for n, c in names.items()])
    rows = sorted(per.collect(), key=lambda r: r["__range"])  # one row for each range
    run = {n: [0, *accumulate(r[c] or 0 for r in rows)] for n, c in names.items()}
    kinds = dict(per.dtypes)
    ddl = ", ".join(["__range bigint", "__first bigint", *[f"`{n}` {kinds[c]}" for n, c in names.items()]])
    return placed.sparkSession.createDataFrame([(r["__range"], r["__first"], *[run[n][k] for n in names]) for k, r in enumerate(rows)], ddl)


def ranked(df: DataFrame, order: list[str | Column], keys: list[str] | None = None, name: str = "rank") -> DataFrame:
    """``df`` with the rank (from 1) of each row in ``order``, among the rows of its ``keys``.

    A key's rows in one range join one row; a range has a bounded number of rows.
    """
    keys = keys or []
    placed = in_ranges(df, [*keys, *order])
    own = offsets(placed, keys, {})
    joined = _joined(placed, own, keys)
    return joined.withColumn(name, F.col("__before") + F.col("__place") - F.col("__first") + 1).select(*df.columns, name)


def running(df: DataFrame, order: list[str | Column], sums: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """``df`` with a running sum, this row included, for each name in ``sums``."""
    keys = keys or []
    placed = in_ranges(df, [*keys, *order])
    joined = _joined(placed, offsets(placed, keys, sums), keys)
    upto = Window.partitionBy(*keys, "__range").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(*df.columns, *[(F.col(f"__before_{n}") + F.coalesce(F.sum(c).over(upto), F.lit(0))).alias(n) for n, c in sums.items()])


def prefix(df: DataFrame, order: list[str | Column], cost: Column, most: int, name: str = "used") -> DataFrame:
    """The longest prefix in ``order`` whose costs, none of them negative, add up to ``most`` or less, with the running sum as ``name``.

    Ranges behind the one in which the budget ends are left out before any running sum is formed.
    """
    placed = in_ranges(df, order)
    before = offsets(placed, [], {name: cost}).where(F.col(f"__before_{name}") <= most)
    joined = placed.join(F.broadcast(before), "__range")  # one row for each range
    upto = Window.partitionBy("__range").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    out = joined.select(*df.columns, (F.col(f"__before_{name}") + F.coalesce(F.sum(cost).over(upto), F.lit(0))).alias(name))
    return out.where(F.col(name) <= most)


def _joined(placed: DataFrame, own: DataFrame, keys: list[str]) -> DataFrame:
    if not keys:
        return placed.join(F.broadcast(own), "__range")  # one row for each range
    same = [placed[k].eqNullSafe(own[k]) for k in [*keys, "__range"]]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return placed.join(own, on).drop(*[own[k] for k in [*keys, "__range"]])
