"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``.

A table written there and read back cuts the lineage; every executor sees it, so a lost executor costs a re-run of tasks
and nothing else. A temporary folder is used only in local mode with the setting unset.
"""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode with the setting unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root if urlparse(root).scheme else f"file://{os.path.abspath(root)}"
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'corpusloom-' + spark.sparkContext.applicationId)}"


class Scratch:
    """A folder of intermediate tables and files of one operator run; dropped tables free their disk at once."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_root(spark).rstrip('/')}/corpusloom/{label}-{uuid.uuid4().hex}"
        self.written: list[str] = []
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Cut the lineage: write ``df`` as Parquet and read it back."""
        df.write.mode("overwrite").parquet(self.path(name))
        self.written.append(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def keep_only(self, *prefixes: str) -> None:
        """Delete the tables written so far whose names don't start with one of the prefixes."""
        gone = [n for n in self.written if not n.startswith(prefixes)]
        if gone:
            self.drop(*gone)

    def collect_garbage(self) -> None:
        """Free the disk of jobs that are over: Spark deletes shuffle files once the driver has collected what refers to them."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Delete some tables, or the whole folder."""
        self.written = [n for n in self.written if n not in names]
        try:
            jvm = self.spark.sparkContext._jvm
            conf = self.spark.sparkContext._jsc.hadoopConfiguration()
            for p in [self.path(n) for n in names] or [self.base]:
                at = jvm.org.apache.hadoop.fs.Path(p)
                at.getFileSystem(conf).delete(at, True)
        except Exception:
            if names:
                raise
            # at exit the session may be gone already; the cluster's own clean-up of the folder takes over


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores if it comes in fewer partitions (a small file, or one large row group): for work that
    costs much more CPU than a shuffle. Tables of many files are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)
