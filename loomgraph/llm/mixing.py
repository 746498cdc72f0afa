"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a shuffled order (by a hash of their id) and
may pass up to three times. A copy's *virtual finish time* is the number of its
source's words up to its end divided by the source's target; merging all
sources by that time serves them in proportion to their targets at any moment,
and the time 1 is where the total budget is spent, so the mix is the range-sorted
schedule up to time 1. The copy that time 1 falls into is taken in part.

Targets: the sources share the budget (the words of all documents) by weight. No
target exceeds ``passes`` times its source's words; what is over is shared by
weight among the others, until none is above. That is the level L for which
the sum of min(passes * words, L * weight) is the budget, found in closed form
from the sources sorted by passes * words / weight.

Cumulative words inside a source need no single task for it: they are summed by
ranges of the shuffled order first, as many as the rows ask for, and only inside
a range row by row. Only sizes and positions are sorted for that; texts are joined
to what is taken at the end.

Defined cases: a null text has no words and is taken 0 times; a null source is a
source, the last; a null id stands where its text's hash puts it; rows that repeat
are documents of their own and interchangeable; a source without words has the
target 0; an empty table gives an empty table; other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .rows import numbered

WEIGHTS = (5, 2, 1)
PASSES = 3
#: Rows of a range of the shuffled order, at most sixteen times as many at the mean.
RANGE = 1 << 10
WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """sources: source, source_size. Adds target; a row for each source, so one task sorts them."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("k") - 1, F.lit(len(weights))) + 1).cast("int"))
    w = sources.withColumn("k", F.row_number().over(by_name)).withColumn("weight", weight)
    w = w.withColumn("most", (F.col("source_size") * passes).cast("double")).withColumn("level", F.col("most") / F.col("weight"))
    by_level = Window.orderBy("level", "k")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("level", "k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = (
        w.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("full", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("try", (F.col("total") - F.col("full")) / F.col("open"))
    )
    # the first source, by level, that stays at or below its most sets the level for all after it
    fits = F.min(F.when(F.col("try") <= F.col("level"), F.struct("level", "k", "try"))).over(everything)
    return w.withColumn("fit", fits).select(
        "source", "source_size", F.least(F.col("most"), F.col("fit.try") * F.col("weight")).alias("target")
    )


def _facts(key: str, text: str, source: str, seed: int) -> list[Column]:
    """A row's size, its shuffled position, and its source as two columns without nulls."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.md5(t))
    return [
        F.regexp_count(t, F.lit(WORD)).cast("bigint").alias("size"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), name)).alias("shuffled"),
        F.coalesce(F.col(f"`{source}`"), F.lit("")).alias("source"),
        F.col(f"`{source}`").isNull().alias("none"),
    ]


def range_digits(rows: int) -> int:
    """Hexadecimal digits of the position that name a range of about ``RANGE`` rows, or up to sixteen times as many."""
    digits = 0
    while 16 ** (digits + 1) * RANGE <= rows:
        digits += 1
    return digits + 1


def _ranges(sized: DataFrame, weights: tuple[int, ...], passes: int) -> DataFrame:
    """Words before each range of each source, and the source's size and target."""
    by = ["source", "none"]
    ranges = sized.groupBy(*by, "range").agg(F.sum("size").alias("range_size"))
    sums = ranges.groupBy(*by).agg(F.sum("range_size").alias("source_size"))
    share = targets(sums.select(F.when(~F.col("none"), F.col("source")).alias("source"), "source_size"), weights, passes)
    share = share.select(F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNull().alias("none"), "source_size", "target")
    inside = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("range_size").over(inside), F.lit(0)))
    return ranges.join(share, by).select(*by, "range", "before", "source_size", "target")


def _placed(slim: DataFrame, order: list[str], weights: tuple[int, ...], passes: int) -> DataFrame:
    """slim: size, shuffled, source, none and ``order``, written. Adds the words of its source up to the row's end and what the mix takes of it.

    The join and the window need the rows dealt by the same columns: one shuffle.
    """
    by = ["source", "none", "range"]
    sized = slim.withColumn("range", F.substring("shuffled", 1, range_digits(slim.count())))
    rows = Window.partitionBy(*by).orderBy("shuffled", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = sized.join(_ranges(sized, weights, passes), by).withColumn("end", F.col("before") + F.sum("size").over(rows))
    budget, start = F.floor(F.col("target") + 0.5), F.col("end") - F.col("size")
    taken = sum(F.greatest(F.lit(0), F.least(F.col("size"), budget - k * F.col("source_size") - start)) for k in range(passes))
    return out.withColumn("taken", taken.cast("bigint"))


def schedule(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """A row for each document: size, source_size, target, taken and the finish time of its first copy, sorted by that."""
    slim = materialise(docs.sparkSession, docs.select(F.col(f"`{key}`").alias("id"), *_facts(key, text, source, seed)), "mix-sizes")
    out = _placed(slim, ["id", "size"], weights, passes)
    finish = F.when(F.col("target") > 0, F.col("end") / F.col("target")).alias("finish")
    return out.select(F.col("id").alias(key), "size", "source_size", "target", "taken", finish).orderBy("finish", f"`{key}`", "size")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """The mix itself, sorted by finish time: each taken copy a row with the columns of ``docs``.

    The copy that its source's budget ends in keeps its first words.
    """
    named = numbered(docs, F.col(f"`{key}`").alias("id"), *_facts(key, text, source, seed))
    placed = _placed(named.drop("cols"), ["id", "size"], weights, passes).where("taken > 0").select("row", "end", "source_size", "target", "taken")
    got = named.select("row", "id", "size", "cols").join(placed, "row")
    got = got.withColumn("copy", F.explode(F.expr("sequence(1L, CAST(ceil(taken / size) AS BIGINT))")))
    got = got.withColumn("words", F.least("size", F.col("taken") - (F.col("copy") - 1) * F.col("size")))
    got = got.withColumn("finish", (F.col("end") + (F.col("copy") - 1) * F.col("source_size")) / F.col("target"))
    whole = F.col(f"cols.`{text}`")
    part = F.array_join(F.slice(F.regexp_extract_all(whole, F.lit(WORD), 0), F.lit(1), F.col("words").cast("int")), " ")
    cut = F.when(F.col("words") < F.col("size"), part).otherwise(whole)
    return got.orderBy("finish", "id", "size").select(*[cut.alias(c) if c == text else F.col(f"cols.`{c}`").alias(c) for c in docs.columns])


MIX_SQL = r"""
WITH d AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        md5('7:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS shuffled FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s),
w AS (SELECT *, CAST([5, 2, 1][(k - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(source_size * 3 AS DOUBLE) AS most FROM k),
l AS (SELECT *, most / weight AS level FROM w),
c AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
        coalesce(sum(most) OVER (ORDER BY level, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
        sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY level, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free FROM l),
t AS (SELECT *, (total - filled) / free AS try_level FROM c),
f AS (SELECT try_level AS fit FROM t WHERE try_level <= level ORDER BY level, k LIMIT 1),
g AS (SELECT source, source_size, least(most, (SELECT fit FROM f) * weight) AS target FROM t),
p AS (SELECT d.*, g.source_size, g.target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY shuffled, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before
    FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(
    greatest(0, least(size, floor(target + 0.5) - before)) + greatest(0, least(size, floor(target + 0.5) - source_size - before))
    + greatest(0, least(size, floor(target + 0.5) - 2 * source_size - before)) AS BIGINT) AS taken FROM p"""
