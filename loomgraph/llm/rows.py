"""Numbered copies of tables.

Numbers that are computed anew at each reading depend on how the input is split,
which may change while a job runs, as when executors come or go. So a table is
numbered once, written to the shared folder, and only that copy is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Bits of a row's number in its task, and of the task's number.
ROW_BITS, TASK_BITS = 31, 20
#: Batches that can be told apart.
BATCHES = 1 << 63 - ROW_BITS - TASK_BITS


def number(batch: int = 0) -> Column:
    """A number that no other row of the same writing job has, nor one of another of the ``BATCHES`` batches."""
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return F.lit(batch << ROW_BITS + TASK_BITS).cast("bigint") + F.shiftleft(F.spark_partition_id().cast("bigint"), ROW_BITS) + inside


def packed(docs: DataFrame, *but: str) -> Column:
    """All columns, but for those named, as one, so that no name can clash."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in but], F.lit(True).alias("__")).alias("cols")


def numbered(docs: DataFrame, *more: Column, batch: int = 0) -> DataFrame:
    """row, cols (the columns of ``docs``) and ``more``; written once."""
    return materialise(docs.sparkSession, docs.select(number(batch).alias("row"), packed(docs), *more), "numbered")


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(f"cols.`{c}`").alias(c) for c in columns])
