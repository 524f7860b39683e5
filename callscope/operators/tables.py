"""Tables that cut a lineage: written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see (``spark.checkpoint.dir``).

    Where the setting is missing, a local master gets a temporary folder; a cluster is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="callscope-")
    return _local_dirs[context.applicationId]


def table_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/callscope/{label}-{uuid.uuid4().hex}"


#: While it is on, Spark deletes the shuffle files of a step when that step has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within the block, each finished step's shuffle files go at once; the session's setting is put back after it."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def _write(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "error") -> DataFrame:
    with dropped_shuffles(df.sparkSession):
        df.write.mode(mode).partitionBy(*by).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in all shuffle partitions of the session: adaptive execution, which else merges them to as few as there are cores, keeps them, so a task's memory does not grow with the whole input."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), *keys)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: what is read again does not depend on shuffle files of lost executors,
    and every later use sees the same rows. The table stays until the folder is cleared, so this is
    for what a returned table reads; what only the steps of a function read goes through :class:`Scratch`.
    """
    return _write(df, table_path(df.sparkSession, label))


def appended(df: DataFrame, path: str) -> DataFrame:
    """Write the rows of ``df`` beside those that are in ``path`` and read all of them; for tables made slice by slice, which stay as those of :func:`materialize`."""
    return _write(df, path, mode="append")


class Scratch:
    """Written tables that are deleted when the block ends, or before: ``with Scratch(spark) as keep: t = keep(df, "label")``."""

    def __init__(self, spark: SparkSession):
        self._spark, self._paths = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def __call__(self, df: DataFrame, label: str, *by: str) -> DataFrame:
        """Write ``df``, in a folder for each value of the columns ``by``, which come last."""
        path = table_path(self._spark, label)
        out = _write(df, path, by)
        self._paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for table in tables:
            path = self._spark._jvm.org.apache.hadoop.fs.Path(self._paths.pop(id(table))[1])
            path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)

    def __exit__(self, *_: object) -> None:
        self.drop(*[table for table, _ in list(self._paths.values())])
