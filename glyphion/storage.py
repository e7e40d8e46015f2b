"""Tables in the folder that driver and executors share: results that outlive lost executors, dropped when they have served."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without; it gets a temporary one."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="glyphion-")
        atexit.register(shutil.rmtree, there.removeprefix("file://"), ignore_errors=True)
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


_live: dict[str, SparkSession] = {}


@atexit.register
def _clear() -> None:
    """At the application's end its tables go; sessions that were stopped before leave theirs."""
    for path, spark in list(_live.items()):
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:  # the JVM may be gone already
            return


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    _live[path] = spark
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def durable(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes df as a Parquet table in the shared folder and reads it back.

    The table outlives lost executors. Column pruning works on it, and it is compressed.
    """
    return _written(df)[0]


def delete(spark: SparkSession, path: str) -> None:
    _live.pop(path, None)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """The durable tables of one operator call. finish() writes the call's result and deletes all others; those that stay go with the application."""

    def __init__(self) -> None:
        self._held: list[tuple[DataFrame, str]] = []

    def durable(self, df: DataFrame) -> DataFrame:
        self._held.append(_written(df))
        return self._held[-1][0]

    def drop(self, *tables: DataFrame) -> None:
        for t, path in self._held:
            if any(t is x for x in tables):
                delete(t.sparkSession, path)
        self._held = [(t, path) for t, path in self._held if not any(t is x for x in tables)]

    def finish(self, out: DataFrame) -> DataFrame:
        out = durable(out)
        self.drop(*(t for t, _ in self._held))
        return out
