"""Session settings every entry point shares, and the folder that cut lineage lives in."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: The JVM never compiles a method of over 8000 bytes; beyond that Spark is to generate a wide row's columns in small methods.
COMPILED = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def build_session(app: str = "panelgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; cluster settings stay untouched."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | COMPILED | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, else one in the warehouse, which is shared too."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_panelgraph"


def cut(df: DataFrame, *, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The result has no lineage, survives lost executors, and its true size is known to the
    planner, so later joins pick broadcast or shuffle by size rather than by guess.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/panelgraph/{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: cheaper than ``cut`` for small iterative state."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Revolving:
    """The state of an iteration as a table in the shared folder: each new one replaces the one before, which it was made of."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, None

    def keep(self, df: DataFrame) -> DataFrame:
        path, old = f"{shared_folder(self.spark)}/panelgraph/{uuid.uuid4().hex}", self.path
        df.write.mode("error").parquet(path)
        self.path = path
        if old:
            delete(self.spark, old)
        return self.spark.read.schema(df.schema).parquet(path)
