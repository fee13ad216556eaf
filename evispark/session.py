"""Session helpers: a local session for tests, and tables written to the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_scratch_roots: dict[str, SparkSession] = {}


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("evispark")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: below ``spark.checkpoint.dir``, which all executors share.

    Only where that setting is absent and the master is local (tests) a folder of this machine is used.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = os.path.join(tempfile.gettempdir(), "evispark-scratch")
    root = f"{shared.rstrip('/')}/evispark-{spark.sparkContext.applicationId}"
    if root not in _scratch_roots:
        _scratch_roots[root] = spark
        atexit.register(drop_scratch, root)
    return root


def drop_scratch(root: str) -> None:
    """Delete the scratch tables of one application."""
    spark = _scratch_roots.pop(root, None)
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may be gone already
        pass


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """:func:`write_table` bucketed and sorted by ``column``: joins by it leave these rows where they lie."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("compression", "zstd").option("path", f"{scratch_dir(spark)}/{table}")
    writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).sortBy(column).saveAsTable(table)
    return spark.table(table)
