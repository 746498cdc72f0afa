"""Session helpers: shipping the package to executors and the shared scratch folder."""

from __future__ import annotations

import atexit
import functools
import os
import re
import shutil
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_made = threading.local()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application.

    Arrow functions are pickled by reference, so a worker must be able to
    import the package even where it isn't installed.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    # texts are long: smaller batches bound what a worker and the JVM hold at once
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def scratch(spark: SparkSession) -> str:
    """This application's folder below the one that the driver and all executors share.

    The cluster names that in ``spark.checkpoint.dir``. Only a session on one
    machine may leave it unset, as tests do: a local folder is made and set.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        atexit.register(shutil.rmtree, named.removeprefix("file://"), ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    own = f"/loomgraph-{sc.applicationId}"
    named = named.rstrip("/")
    return named if named.endswith(own) else named + own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if getattr(_made, "open", False):
        _made.paths.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of the shared folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialise(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it again.

    Cuts the lineage, and what follows survives the loss of any executor.
    """
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that only tables written since were made from."""
    for t in tables:
        remove(t.sparkSession, t._scratch)
        if t._scratch in getattr(_made, "paths", ()):
            _made.paths.remove(t._scratch)


@contextmanager
def collecting():
    """The paths of the tables that are materialised inside and not discarded."""
    outer = getattr(_made, "open", False), getattr(_made, "paths", [])
    _made.open, _made.paths = True, []
    paths = _made.paths
    try:
        yield paths
    finally:
        _made.open, _made.paths = outer
        if outer[0]:
            outer[1].extend(paths)


class Chain:
    """Stages that run one after another, each on what the one before has written.

    When a stage begins, what earlier stages of the chain left in the shared folder is
    deleted, but for what its input reads; so the result of a stage has to be written
    before a later stage is called. Results of one stage, or of functions outside a
    chain, never cost each other their tables.
    """

    def __init__(self) -> None:
        self._left: dict[tuple[str, int], dict[int, list[str]]] = {}

    def stage(self, number: int, run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(run)
        def staged(spark: SparkSession, docs: DataFrame, *rest) -> DataFrame:
            left = self._left.setdefault((spark.sparkContext.applicationId, threading.get_ident()), {})
            earlier = [k for k in left if k < number]
            files = docs.inputFiles() if any(left[k] for k in earlier) else []
            for k in earlier:
                keep = [p for p in left[k] if any(f"/{p.rsplit('/', 1)[1]}/" in f for f in files)]
                for p in left[k]:
                    if p not in keep:
                        remove(spark, p)
                left[k] = keep
            with collecting() as paths:
                out = run(spark, docs, *rest)
            left.setdefault(number, []).extend(paths)
            return out

        return staged


def local_session(app: str = "loomgraph", cores: str | None = None) -> SparkSession:
    """A local session for tests and benches."""
    n = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
