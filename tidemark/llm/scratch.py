"""Written intermediate tables in the folder that driver and executors share.

Cutting lineage with a written table keeps a job safe from lost executors: whatever reads it
rereads files, never blocks that lived on one machine. The folder is the checkpoint directory of the
session; a local one is used only where that is unset and the master is local (``shared_folder``).
"""

from __future__ import annotations

import atexit
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..shared import shared_folder


def _remove(jvm, jconf, path: str) -> None:
    try:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(jconf).delete(where, True)
    except Exception:  # the JVM may be gone at exit; the folder is scratch space
        pass


@contextmanager
def arrow_bytes(spark: SparkSession, most: int = 4 << 20) -> Iterator[None]:
    """Tables written inside send Python workers batches of about ``most`` bytes, however long their rows are."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Tables written by one call of an operator. ``drop`` and ``keep`` remove some early; the rest go at exit."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.names = spark, set()
        self.root = shared_folder(spark, name)
        sc = spark.sparkContext
        atexit.register(_remove, sc._jvm, sc._jsc.hadoopConfiguration(), self.root)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        sc = self.spark.sparkContext
        for name in names:
            _remove(sc._jvm, sc._jsc.hadoopConfiguration(), f"{self.root}/{name}")
            self.names.discard(name)

    def keep(self, *names: str) -> None:
        """Removes all other tables: nothing that is still to run reads them."""
        self.drop(*(self.names - set(names)))
        # Spark deletes the shuffle files of plans that the driver has let go of, but only sees that when it collects garbage
        self.spark.sparkContext._jvm.System.gc()
