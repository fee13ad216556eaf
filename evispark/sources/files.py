"""Readers and writers of the files that a run takes and leaves."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.functions.text import strip

ENTITY_SCHEMA = "id string, name string, domains string, seeds string"


def _listed(c):
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), strip), lambda x: x != "")


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """Entities from CSV with a header (a byte order mark is fine); lists parted by ``;``, domains in small letters.

    Raises if there are none, or if an id is missing, malformed or repeated.
    """
    raw = spark.read.option("header", True).option("encoding", "UTF-8").schema(ENTITY_SCHEMA).csv(path)
    out = raw.select(strip("id").alias("id"), strip("name").alias("name"), F.transform(_listed("domains"), lambda d: F.regexp_replace(F.lower(d), r"^\.+|\.+$", "")).alias("domains"), _listed("seeds").alias("seeds"))
    bad = out.groupBy("id").count().agg(F.count("*").alias("n"), F.count_if(F.col("count") > 1).alias("repeated"), F.count_if(~F.coalesce(F.col("id"), F.lit("")).rlike("^[A-Za-z0-9_-]+$")).alias("malformed")).first()
    if not bad["n"] or bad["repeated"] or bad["malformed"]:
        raise ValueError(f"entities: {bad['n']} ids, {bad['repeated']} repeated, {bad['malformed']} malformed")
    return out


def read_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all ``.csv``, ``.jsonl`` and ``.json`` files below a folder, with the union of their columns.

    A ``.json`` file is a list of rows, an object with the rows under ``notices`` or ``results``, or one row itself.
    Everything is read as text, so columns of different files never clash in type.
    """
    base = lambda: spark.read.option("recursiveFileLookup", True)
    parts = []
    for suffix in (".csv", ".jsonl", ".json"):
        if not any(Path(folder).rglob("*" + suffix)):
            continue
        if suffix == ".csv":
            for f in sorted(Path(folder).rglob("*.csv")):  # one header each; files of an export are few
                df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(f))
                parts.append(df.toDF(*(c.lstrip("﻿") for c in df.columns)))
        elif suffix == ".jsonl":
            parts.append(base().option("pathGlobFilter", "*.jsonl").option("primitivesAsString", True).json(folder))
        else:
            whole = base().option("pathGlobFilter", "*.json").option("wholetext", True).text(folder)
            v = F.parse_json("value")
            rows = F.coalesce(F.try_variant_get(v, "$.notices", "array<string>"), F.try_variant_get(v, "$.results", "array<string>"), F.try_variant_get(v, "$", "array<string>"), F.array("value"))
            lines = whole.select(F.explode(rows).alias("value"))
            keys = [r[0] for r in lines.select(F.explode(F.json_object_keys("value")).alias("k")).distinct().orderBy("k").collect()]
            parts.append(lines.select(*(F.get_json_object("value", f"$['{k}']").alias(k) for k in keys)))
    if not parts:
        raise ValueError(f"no rows below {folder}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file that begin with ``http``, trimmed: ``url``."""
    return spark.read.text(path).select(strip("value").alias("url")).where(F.col("url").startswith("http"))


def read_config(path: str) -> dict:
    """A YAML or JSON configuration as a dictionary."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def confined(root: str, value: str) -> str:
    """The path of a file below ``root``; raises for anything outside or missing."""
    base, target = Path(root).resolve(), (Path(root) / value).resolve()
    if base not in target.parents or not target.is_file():
        raise ValueError(f"not a file below {root}: {value}")
    return str(target)


def write_rows(df: DataFrame, path: str, kind: str = "json") -> None:
    """Write rows once to a folder that must not exist: ``json`` (a line each), ``csv`` (header, also if empty) or ``parquet``."""
    out = df.write.mode("errorifexists")
    if kind == "csv":
        out.option("header", True).option("quoteAll", False).option("escape", '"').csv(path)
    elif kind == "json":
        out.option("ignoreNullFields", False).json(path)
    else:
        out.parquet(path)


def markdown(df: DataFrame, columns: list[str]) -> str:
    """A small table as Markdown; for summaries of one row per entity."""
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    for row in df.select(*columns).toLocalIterator():
        lines.append("| " + " | ".join(str("" if v is None else v).replace("|", "\\|").replace("\n", " ") for v in row) + " |")
    return "\n".join(lines) + "\n"
