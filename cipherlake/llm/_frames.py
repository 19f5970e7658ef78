"""Shared plumbing: column access by position-safe names, and tables written to the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def text_or_empty(name: str) -> Column:
    """The text column as a string, null as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Only a local session that names none (tests on one machine) gets a temporary folder, removed at exit; on a cluster a
    missing setting is an error, as executors would not see the driver's folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="cipherlake-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: The key of `keyed`.
ROW = "_row_key"


class Workspace:
    """Intermediate tables of one operator run, under one fresh folder of the shared directory.

    `save` cuts lineage: the frame is written as Parquet and read again, so a lost executor costs only the step
    that was running. Operators drop what their result no longer reads (`keep`); what it does read lasts until a caller
    that has stored the result drops it (`scratch`).
    """

    _open: list[Workspace] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        Workspace._open.append(self)

    def path(self, name: str) -> str:
        self.names.add(name)
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def keyed(self, df: DataFrame, name: str) -> DataFrame:
        """The frame, saved with a number of its own for each row (ROW): later reads of it agree on these."""
        return self.save(df.withColumn(ROW, F.monotonically_increasing_id()), name)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))
        self.names -= set(names)

    def keep(self, *names: str) -> None:
        """Drops every table but these."""
        self.drop(*sorted(self.names - set(names)))

    def _delete(self, place: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """What is planned within it moves to Python in batches of so many rows: for rows of many kilobytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes, at its end, all tables that operators have written within it; their results must have been stored by then."""
    before = len(Workspace._open)
    yield
    for ws in Workspace._open[before:]:
        ws._delete(ws.root)
    del Workspace._open[before:]
