"""Joins of many rows with a row for each key, where a few keys hold a large share of the many.

Such a key is one shuffle partition. Spark splits skewed partitions of a join
only where both sides are plain shuffles; here the other side is an aggregate. So
frequent keys get a salt: their rows are dealt to parts by a hash of other columns,
and the one row of the key is copied to each part. A key is frequent by its share of
all rows, or by more rows than one task should hold, however small their share is;
it gets ``SALTS`` parts, or as many as keep a part below that number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key is frequent from this part of all rows on, so there are at most so many such keys.
SHARE = 500
SALTS = 64
#: Rows of one key in a task. All rows over this number bound the keys that are frequent by it.
ROWS = 1_000_000
#: Keys that are broadcast, of a few bytes each; Spark joins a longer list as it sees fit.
BROADCAST = 200_000


class Keys(list):
    """Frequent keys, and the parts of each."""

    def __init__(self, keys=(), parts=()):
        super().__init__(keys)
        self.parts = list(parts)


def frequent(counts: DataFrame, key: str, n: str, total: int, share: int = SHARE, rows: int = ROWS) -> Keys:
    """The keys that hold at least one ``share``-th of ``total`` rows, or over ``rows``: ``share`` + total / rows at most. counts: key, n."""
    if not total:
        return Keys()
    found = counts.where((F.col(n) * share >= F.lit(total)) | (F.col(n) > rows)).select(key, n).collect()
    return Keys((r[0] for r in found), (max(SALTS, -(-r[1] // rows)) for r in found))


def salted_join(many: DataFrame, few: DataFrame, on: list[str], keys: list, by: list[str | Column], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``many`` joined with ``few`` on the columns ``on``; rows of the frequent ``keys`` (of the first of ``on``) are dealt by a hash of ``by``.

    how: inner, left or left_semi, which keep the rows of ``many``, or leave some out, as they are.
    """
    if not keys:
        return many.join(few, on, how)
    parts = getattr(keys, "parts", [])
    if len(keys) <= SHARE and max(parts, default=0) <= salts:
        hot = F.col(on[0]).isin(list(keys))
        left = many.withColumn("__parts", F.when(hot, F.lit(salts)))
        right = few.withColumn("__parts", F.when(hot, F.lit(salts)))
    else:
        kind = T.StructType([T.StructField("__hot", many.schema[on[0]].dataType), T.StructField("__parts", T.IntegerType())])
        listed = many.sparkSession.createDataFrame(list(zip(keys, parts or [salts] * len(keys), strict=True)), kind)
        listed = F.broadcast(listed) if len(keys) <= BROADCAST else listed
        left, right = (df.join(listed, F.col(on[0]) == F.col("__hot"), "left").drop("__hot") for df in (many, few))
    left = left.withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*by), F.col("__parts")), F.lit(0)).cast("int")).drop("__parts")
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return left.join(right, [*on, "__salt"], how).drop("__salt")


def dealt_join(many: DataFrame, few: DataFrame, on: str, n: str, by: list[str], rows: int | None = ROWS) -> DataFrame:
    """Inner join of ``many`` with one row for each key; the column ``n`` of ``few`` is the number, or a bound, of the key's rows in ``many``.

    Keys of over ``rows`` rows are dealt by a hash of ``by``. They are found inside the
    job; at most a ``rows``-th of all rows can be such keys, and so many are broadcast.
    None: no key is dealt.
    """
    if rows is None:
        return many.join(few, on)
    parts = F.ceil(F.col(n) / rows).cast("int")
    hot = few.where(F.col(n) > rows).select(on, parts.alias("__parts"))
    left = many.join(F.broadcast(hot), on, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*by), F.col("__parts")), F.lit(0)).cast("int")).drop("__parts")
    right = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return left.join(right, [on, "__salt"]).drop("__salt")
