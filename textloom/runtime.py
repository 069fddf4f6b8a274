"""Session helpers shared by every operator: shared storage, lineage cuts, table access."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``.

    Where the session names none, a local session gets a temporary one; on a cluster
    that is an error, as other machines could not read it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, path.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _stages(spark: SparkSession) -> list[str]:
    """Folders written for this session."""
    return spark.sparkContext.__dict__.setdefault("_textloom_stages", [])


def folder(spark: SparkSession, name: str) -> str:
    """Path of a new folder in the shared one."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _stages(spark).append(path)
    return path


def clean(spark: SparkSession) -> None:
    """Delete the intermediate tables written so far; results that still read them must have been stored."""
    jvm = spark.sparkContext._jvm
    while _stages(spark):
        path = jvm.org.apache.hadoop.fs.Path(_stages(spark).pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with a file table that every executor can read, so a lost
    executor costs one task, and several consumers do not run the producer again.
    """
    spark = df.sparkSession
    ship(spark)
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Table:
    """Table in the shared folder that rounds of a loop append to; reading it is one scan, whatever the rounds."""

    def __init__(self, spark: SparkSession, schema: str, name: str):
        self.spark, self.schema, self.path = spark, schema, folder(spark, name)
        self.append(spark.createDataFrame([], schema))

    def append(self, df: DataFrame) -> None:
        df.select(*[f.name for f in self.fields]).write.mode("append").parquet(self.path)

    @property
    def fields(self):
        return self.spark.createDataFrame([], self.schema).schema

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per session, so that no path needs to be set there.

    The archive lies in the shared folder, or beside the driver where that folder is no file system path.
    """
    context = spark.sparkContext
    if getattr(context, "_textloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    shared = shared_dir(spark)
    folder = shared.removeprefix("file://") if shared.startswith(("file://", "/")) else tempfile.mkdtemp(prefix="textloom-")
    os.makedirs(folder, exist_ok=True)
    archive = os.path.join(folder, f"textloom-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(at, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(archive)
    context._textloom_shipped = True


def shipped(query):
    """A registered query that sends the package first."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan that comes as a few unsplittable pieces one partition per core.  What comes before Python stages.

    Larger inputs already have more pieces than cores and pass unchanged.
    """
    ship(df.sparkSession)
    want = cores(df.sparkSession)
    return df.repartition(want) if df.rdd.getNumPartitions() * 2 <= want else df


def tasks(df: DataFrame) -> int:
    """Number of reduce tasks an explicit repartitioning should use in this session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
