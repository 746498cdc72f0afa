"""A folder whose content is named by numbered manifests, so that a crash at any write leaves a whole version.

Data go to folders with fresh names that nothing refers to yet. A version is a
manifest that lists them; it is written under the next number and ends with a mark.
The highest manifest with its mark counts. Nothing is renamed or deleted before
a newer version is whole, so whatever a dead writer leaves is a folder without a
manifest or a manifest without its mark, and neither is seen. Two writers that start from one
version can't both succeed: the second finds the number taken.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from .model import GraphError

_END = "#end"


class Conflict(GraphError):
    """Another writer made a version meanwhile."""


class Versions:
    """Versions below ``path`` on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _place(self, name: str = ""):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        p, fs = self._place()
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def numbers(self) -> list[int]:
        """Numbers of all manifests, also of those without a mark."""
        return sorted(int(m[1]) for n in self._names() if (m := re.fullmatch(r"manifest-(\d{8})\.json", n)))

    def _read(self, n: int) -> dict | None:
        p, fs = self._place(f"manifest-{n:08d}.json")
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text[: -len(_END)]) if text.endswith(_END) else None

    def latest(self) -> tuple[int, dict] | None:
        """Number and note of the last whole version. A folder with data and no manifest at all isn't taken for an empty one."""
        for n in reversed(self.numbers()):
            note = self._read(n)
            if note is not None:
                return n, note
        return None

    def fresh(self, name: str) -> str:
        """A new name for data."""
        return f"{name}-{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, name: str) -> str:
        """Rows under a fresh name."""
        name = self.fresh(name)
        df.write.parquet(f"{self.path}/{name}")
        return name

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def commit(self, note: dict, base: int | None) -> int:
        """Make ``note`` the next version after ``base``, the number it was made from, or None."""
        last = self.latest()
        if (last[0] if last else None) != base:
            raise Conflict(f"{self.path} has a newer version than {base}")
        n = (self.numbers() or [-1])[-1] + 1
        p, fs = self._place(f"manifest-{n:08d}.json")
        try:
            out = fs.create(p, False)  # fails if another writer has taken the number
        except Exception as x:
            raise Conflict(f"{p} is taken") from x
        try:
            out.write(bytearray((json.dumps(note) + _END).encode()))
        finally:
            out.close()
        return n

    def sweep(self, used, keep: int = 2) -> list[str]:
        """Delete what the last ``keep`` whole versions don't use. used(note): the names of its data.

        For one writer at a time: what a writer has begun and not committed counts as unused.
        """
        whole = [(n, note) for n in self.numbers() if (note := self._read(n)) is not None][-keep:]
        if not whole:
            return []
        needed = {name for _, note in whole for name in used(note)} | {f"manifest-{n:08d}.json" for n, _ in whole}
        gone = [n for n in self._names() if n not in needed and not n.startswith(".") and not (n.startswith("manifest-") and n > f"manifest-{whole[-1][0]:08d}.json")]
        for n in gone:
            p, fs = self._place(n)
            fs.delete(p, True)
        return gone
