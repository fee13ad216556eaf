"""Artifacts of a run, hashed and verified."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.operators.caches import mismatches


def artifacts(spark: SparkSession, folder: str, without: tuple[str, ...] = ("manifest.json", "run.log")) -> DataFrame:
    """``path, sha256`` of every file below a folder, but for those of the given names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    relative = F.regexp_replace("path", "^.*?" + folder.rstrip("/").replace("/", "/+") + "/+", "")
    return files.where(~name.isin(*without)).select(relative.alias("path"), F.sha2("content", 256).alias("sha256"))


def verify(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Artifacts of the manifest that are missing or changed; an empty manifest is an error."""
    if manifest.isEmpty():
        raise ValueError("the manifest lists no artifacts")
    return mismatches(manifest, artifacts(spark, folder))
