"""Written intermediates in the shared folder that the cluster names in spark.checkpoint.dir.

A written table cuts the lineage: what follows survives the loss of executors, and a costly stage that is
read twice is computed once. Tables that a later written table has replaced are dropped at once; the rest go when
the session's process ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

SETTING = "spark.checkpoint.dir"
#: Rows of a few narrow columns that may be broadcast: with some 100 bytes a row in a hash relation, these are about 20 MB.
BROADCAST_ROWS = 200_000
_local_roots: dict[str, str] = {}


def small_side(rows: DataFrame) -> DataFrame:
    """Narrow rows for one side of a join, to be broadcast if they were counted and found within the bound; beyond, the join shuffles."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; in local mode without that setting, a temporary folder of this machine."""
    root = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"set {SETTING} to a folder that all executors share")
    session = spark.sparkContext.applicationId
    if session not in _local_roots:
        _local_roots[session] = tempfile.mkdtemp(prefix="tidemark-")
    return _local_roots[session]


class Scratch:
    """Tables of one run of an operator.

    keep(df, name) writes df as Parquet and gives the table read back; drop(name) deletes one that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self._spark = spark
        self._root = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self._root}/{name}"
        df.write.parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def path(self, name: str) -> str:
        return f"{self._root}/{name}"

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self._root}/{name}")

    def bytes(self, name: str) -> int:
        """Size of a written table on disk."""
        path = self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._root}/{name}")
        return path.getFileSystem(self._spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()

    def _delete(self, place: str) -> None:
        path = self._spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        """Drops all tables of the run, once its result has been consumed; otherwise they go with the process."""
        atexit.unregister(self.close)
        try:
            if self._spark.sparkContext._jsc is not None:
                self._delete(self._root)
        except Exception:  # the JVM may be gone already
            pass
