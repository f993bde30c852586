"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "flowkeel", cores: int | str = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("FLOWKEEL_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    chosen = tempfile.mkdtemp(prefix="flowkeel-")
    spark.conf.set("spark.checkpoint.dir", chosen)
    return chosen


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back.

    This cuts lineage in a way that survives the loss of executors, and the
    file sizes give the optimizer the true size of what it may broadcast.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int, key: str, *order: str, compression: str = "snappy") -> DataFrame:
    """Writes `df` to the shared folder in `buckets` buckets of `key`, each file sorted by key and `order`.

    What is joined or grouped by `key` over as many partitions later is not shuffled again. Where each
    bucket is one file, as after a repartition by `key`, its order holds too. The catalog only
    lends its name for the bucket layout: the entry goes at once, the files stay.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    df.write.format("parquet").option("path", fresh_path(spark, name)).option("compression", compression).bucketBy(buckets, key).sortBy(key, *order).saveAsTable(table)
    stored = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return stored


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_flowkeel_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="flowkeel-"), "flowkeel-src.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("flowkeel", os.path.relpath(path, root)))
    sc.addPyFile(archive)
    sc._flowkeel_shipped = True
