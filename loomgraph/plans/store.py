"""A store of computed results by key, of bounded size.

Entries lie in *generations*, one for each batch that was put. Keys that are asked
for are marked. When there are more entries than ``capacity``, the oldest generation
goes: its marked entries get a second chance in a new one, without their mark, and
the others are dropped. That repeats until the rest fits, so the bound holds after
every ``put``; of a batch that is larger by itself the smallest keys are kept.

What counts is a numbered manifest (``versions``): each operation writes its tables
first and its manifest last, so one that dies leaves the store as it was.

Defined cases: rows without a key aren't stored and are never hits; of rows that
repeat a key in a batch one is stored, as results of one key are equal; a key that is
known isn't stored again; batches have the columns of the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import SchemaError
from ..operators.ranks import ranked
from ..versions import Versions


class Store:
    """Results by ``key`` below ``path``."""

    def __init__(self, spark: SparkSession, path: str, capacity: int, key: str = "key"):
        self.spark, self.capacity, self.key = spark, capacity, key
        self.versions = Versions(spark, path)

    def _state(self) -> tuple[int | None, dict]:
        n, note = self.versions.latest() or (None, {})
        return n, {"generations": [], "marks": [], "columns": None} | note

    def _all(self, names: list[str]) -> DataFrame | None:
        out = None
        for n in names:
            rows = self.versions.read(n)
            out = rows if out is None else out.unionByName(rows)
        return out

    def entries(self) -> DataFrame | None:
        """All entries; None of a store that never had any."""
        return self._all([g["name"] for g in self._state()[1]["generations"]])

    def size(self) -> int:
        return sum(g["rows"] for g in self._state()[1]["generations"])

    def get(self, asked: DataFrame, mark: bool = True) -> tuple[DataFrame | None, DataFrame]:
        """Rows of ``asked`` with their results, and those without one. Their keys are marked."""
        base, note = self._state()
        known = self._all([g["name"] for g in note["generations"]])
        if known is None:
            return None, asked
        if mark:
            met = asked.select(self.key).join(known.select(self.key), self.key, "left_semi").distinct()
            note["marks"].append(self.versions.write(met, "marks"))
            self.versions.commit(note, base)
        return asked.join(known, self.key), asked.join(known.select(self.key), self.key, "left_anti")

    def put(self, rows: DataFrame) -> None:
        """Store results whose keys aren't known, and make room."""
        base, note = self._state()
        columns = sorted(map(list, rows.dtypes))
        if note["columns"] not in (None, columns):
            raise SchemaError(f"the store holds {note['columns']}, not {columns}")
        known = self._all([g["name"] for g in note["generations"]])
        new = rows.where(F.col(self.key).isNotNull())
        if known is not None:
            new = new.join(known.select(self.key), self.key, "left_anti")
        rest = [c for c in new.columns if c != self.key]
        one = F.min(F.struct(*rest, F.lit(True).alias("__"))).alias("__one")
        new = new.groupBy(self.key).agg(one).select(self.key, *[F.col(f"__one.{c}").alias(c) for c in rest])
        generations, marks = note["generations"], self._all(note["marks"])
        newest = {"name": self.versions.write(new, "entries")}
        newest["rows"] = self.versions.read(newest["name"]).count()
        if newest["rows"] > self.capacity:
            first = ranked(self.versions.read(newest["name"]), [self.key]).where(F.col("rank") <= self.capacity).drop("rank")
            newest = {"name": self.versions.write(first, "entries"), "rows": self.capacity}
        generations.append(newest)
        spared: list[dict] = []
        while len(generations) > 1 and sum(g["rows"] for g in generations) > self.capacity:
            oldest = generations.pop(0)
            if marks is None or oldest in spared:  # nothing is spared twice
                continue
            name = self.versions.write(self.versions.read(oldest["name"]).join(marks.distinct(), self.key, "left_semi"), "entries")
            if n := self.versions.read(name).count():
                spared.append({"name": name, "rows": n})
                generations.insert(-1, spared[-1])
        if spared:  # without their mark
            rest_marked = marks.distinct().join(self._all([g["name"] for g in spared]).select(self.key), self.key, "left_anti")
            note["marks"] = [self.versions.write(rest_marked, "marks")]
        self.versions.commit(note | {"columns": columns}, base)

    def sweep(self) -> list[str]:
        """Delete what the last versions don't use, also what dead writers left."""
        return self.versions.sweep(lambda note: {g["name"] for g in note["generations"]} | set(note["marks"]))
