"""Tables in the shared folder that the cluster names in ``spark.checkpoint.dir``.

Writing a table there and reading it again cuts the lineage: after an executor is lost, Spark recomputes
from the last table, never from the start, and ids given out once stay as they were written.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, a folder of our own in local
    mode (tests on one machine) and an error on a cluster, whose machines share no such folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    global _own
    if _own is None:
        _own = "file://" + tempfile.mkdtemp(prefix="chronoweave-")
    return _own


_own: str | None = None


_collectors: list[list[Scratch]] = []


@contextlib.contextmanager
def collected() -> Iterator[list[Scratch]]:
    """The Scratches made inside, so that they can be cleared once what reads them has been written."""
    made: list[Scratch] = []
    _collectors.append(made)
    try:
        yield made
    finally:
        _collectors.remove(made)


class Scratch:
    """One operator run's tables. ``drop`` removes what no later step reads; the rest goes when Python ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.saved: list[str] = []
        atexit.register(self.clear)
        for made in _collectors:
            made.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        self.saved.append(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(f"{self.root}/{name}")

    def keep_only(self, *names: str) -> None:
        """Remove all tables but those that a result still reads."""
        gone = [n for n in self.saved if n not in names]
        self.drop(*gone)
        self.saved = [n for n in self.saved if n in names]

    def clear(self) -> None:
        self._remove(self.root)

    def _remove(self, path: str) -> None:
        with contextlib.suppress(Exception):  # at exit the JVM may be gone already
            sc = self.spark.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
