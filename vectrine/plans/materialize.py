"""Cutting lineage with tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder.  Where it is unset and Spark runs
inside one machine, a temporary folder is made; on a cluster an unset folder is
an error, as a machine-local one would not survive the loss of an executor.
Columnar files are used rather than RDD checkpoints: they are compressed, and a
later stage reads only the columns it needs.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []
_ROOTS: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this process; results that weren't read yet are lost with them."""
    while _ROOTS:
        _delete(spark, _ROOTS.pop())


@atexit.register
def _at_exit() -> None:
    try:
        if (spark := SparkSession.getActiveSession()) is not None:
            clear(spark)
    except Exception:  # noqa: BLE001, S110 - the session may be gone already
        pass


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="vectrine-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


#: Rows of a few columns up to which a table is broadcast: tens of MB.
BROADCAST_ROWS = 1 << 20


def sized(table: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """A side of a join that is broadcast if its counted ``rows`` allow, and else met by a sort-merge join."""
    return F.broadcast(table) if rows <= most else table.hint("merge")


class Scratch:
    """Intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{work_dir(spark)}/vectrine-{uuid.uuid4().hex}"
        _ROOTS.append(self.root)
        self.paths: dict[int, str] = {}
        self.n = 0

    def cut(self, df: DataFrame, partitions: int = 0) -> DataFrame:
        """Write ``df`` and read it back: its lineage starts at the files.

        Its shuffles have ``partitions`` partitions at least, for a caller that
        knows how much a step multiplies its rows; adaptive execution may still
        join small ones and split skewed ones.
        """
        path = f"{self.root}/{self.n}"
        self.n += 1
        usual = self.spark.conf.get("spark.sql.shuffle.partitions")
        try:
            if partitions > int(usual):
                self.spark.conf.set("spark.sql.shuffle.partitions", partitions)
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set("spark.sql.shuffle.partitions", usual)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def free(self, df: DataFrame | None) -> None:
        """Delete a table of :meth:`cut` that no later stage reads: the state of a round, once the next one is written."""
        path = self.paths.pop(id(df), None)
        if path:
            _delete(self.spark, path)
