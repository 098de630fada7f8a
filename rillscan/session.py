"""Session helpers shared by every module."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A group of more than this share of all rows is joined by a broadcast of it: at most as many groups as 1 / HOT.
HOT = 0.002


def reach(spark: SparkSession) -> None:
    """Give this package to the Python workers. Called before any function that they run is made."""
    context = spark.sparkContext
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root) and not getattr(context, "_rillscan_sent", False):
        # the driver serves the archive; executors need no folder in common with it
        where = os.path.join(tempfile.mkdtemp(prefix="rillscan-"), "rillscan.zip")
        with zipfile.ZipFile(where, "w") as archive:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        archive.write(path, os.path.relpath(path, os.path.dirname(root)))
        context.addPyFile(where)
        context._rillscan_sent = True
    # Spark's default of 10000 rows a batch is for narrow rows; whole texts make batches of 100 MB with it
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by whatever path Spark's readers understand."""
    reach(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where a local session names none (tests, a laptop) a temporary folder is made and
    the setting is filled in, so that later calls find the same place. On a cluster
    executors could not see such a folder, so there the setting must be given.
    """
    reach(spark)
    where = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not where:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="rillscan-")
        spark.conf.set("spark.checkpoint.dir", where)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Compute once, keep in the shared folder, forget the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """Compute once and keep as Parquet in the shared folder, so that later reads take single columns; removed when the session ends."""
    spark = df.sparkSession
    where = f"{shared_dir(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(where)
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(where)


def hot_join(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """Inner join of rows to their groups, whose number of rows is in ``size``; groups of more than HOT of all rows don't meet in one task."""
    most = HOT * total
    hot = F.broadcast(groups.where(F.col(size) > most))
    cold = groups.where(F.col(size) <= most)
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(cold, on))
