"""Whole runs out of the operators: lazily built tables, written once, hashed at the end."""

from __future__ import annotations

import json
import platform
from datetime import datetime, timezone
from importlib import metadata
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.functions import urls
from evispark.functions.text import document_id, sanitize_cell
from evispark.operators import chunking, discovery, manifest, notices, pages
from evispark.sources import files


def screen_notices(spark: SparkSession, folder: str, source: str, elderly_care_only: bool = False) -> dict[str, DataFrame]:
    """``notices`` and ``years`` of all exports below a folder; the filter comes before the lexicon."""
    raw = files.read_rows(spark, folder)
    rows = notices.is_elderly_care(raw) if elderly_care_only else raw
    found = notices.normalize_notices(rows, source)
    return {"notices": found, "years": notices.aggregate_by_year(found).orderBy(F.asc_nulls_last("year"))}


def analyze(spark: SparkSession, folder: str, out: str, source: str, elderly_care_only: bool = False) -> DataFrame:
    """Screen the notices of a folder into ``out`` (which must not exist) and seal it; returns the counts by year."""
    facts = {"source": source, "elderly_care_only": elderly_care_only}
    tables = screen_notices(spark, folder, source, elderly_care_only)
    try:
        files.write_rows(tables["notices"], f"{out}/notices", "parquet")
        stored = spark.read.parquet(f"{out}/notices")
        files.write_rows(stored, f"{out}/notices_csv", "csv")
        years = notices.aggregate_by_year(stored).orderBy(F.asc_nulls_last("year"))
        files.write_rows(years, f"{out}/year_summary", "json")
    except BaseException as error:
        if Path(out).is_dir():  # what there is stays, sealed as failed
            seal(spark, out, {**facts, "status": "failed", "error": type(error).__name__})
        raise
    inputs = {r["path"]: r["sha256"] for r in manifest.artifacts(spark, folder).orderBy("path").toLocalIterator()}
    counts = {"n_raw_rows": files.read_rows(spark, folder).count(), "n_notices": stored.count()}
    seal(spark, out, {**facts, **counts, "inputs": inputs, "status": "completed", "created_at": utc_now(), "environment": environment()})
    return years


def utc_now() -> str:
    """The time in UTC, to the second."""
    return datetime.now(timezone.utc).replace(microsecond=0).isoformat()


def environment() -> dict[str, str]:
    """Versions of what a run was made with."""
    names = ("pyspark", "pyarrow", "pandas", "numpy")
    return {"python": platform.python_version(), **{n: metadata.version(n) for n in names}}


def collect_run(spark: SparkSession, downloads: DataFrame, entities: DataFrame, out: str, limit: int | None = None, **chunking_options: int) -> dict[str, int]:
    """:func:`collect` of the first ``limit`` entities by id (of all, if none) into ``out``, sealed with the counts of its tables.

    Stops before any model is asked: a collect-only run. The status is ``completed_with_gaps`` where entities have gaps or
    there are errors, ``failed`` where something raised; what was written by then stays.
    """
    if limit is not None and limit < 1:
        raise ValueError("the limit must be at least 1")
    chosen = entities.orderBy("id").limit(limit) if limit else entities
    facts = {"mode": "collect-only", "limit": limit, "created_at": utc_now(), "environment": environment()}
    try:
        tables = collect(downloads.join(chosen.select(F.col("id").alias("municipality_id")), "municipality_id", "left_semi"), chosen, **chunking_options)
        counts = {}
        for name, table in tables.items():
            files.write_rows(table, f"{out}/{name}", "parquet")
            counts[name] = spark.read.parquet(f"{out}/{name}").count()
    except BaseException as error:
        if Path(out).is_dir():
            seal(spark, out, {**facts, "status": "failed", "error": type(error).__name__})
        raise
    seal(spark, out, {**facts, "counts": counts, "status": "completed_with_gaps" if counts["errors"] or counts["gaps"] else "completed"})
    return counts


def export(views: dict[str, DataFrame], out: str, kind: str = "parquet") -> None:
    """Write views below ``out``, a folder each; texts are made fit for a spreadsheet's cells in CSV."""
    for name, view in views.items():
        if kind == "csv":
            texts = {f.name for f in view.schema if f.dataType.simpleString() == "string"}
            view = view.select(*(sanitize_cell(F.col(c)).alias(c) if c in texts else F.col(c) for c in view.columns))
        files.write_rows(view, f"{out}/{name}", kind)


def seal(spark: SparkSession, folder: str, facts: dict) -> None:
    """Write ``manifest.json`` with the hashes of all artifacts of a run. A run's files are few; their contents stay put."""
    listed = {r["path"]: r["sha256"] for r in manifest.artifacts(spark, folder).orderBy("path").toLocalIterator()}
    Path(folder, "manifest.json").write_text(json.dumps({**facts, "artifacts": listed}, ensure_ascii=False, indent=2, sort_keys=True) + "\n", encoding="utf-8")


def verify(spark: SparkSession, folder: str) -> DataFrame:
    """Artifacts of a sealed run that are missing or changed."""
    listed = json.loads(Path(folder, "manifest.json").read_text(encoding="utf-8"))["artifacts"]
    table = spark.createDataFrame(list(listed.items()), "path string, sha256 string") if listed else spark.createDataFrame([], "path string, sha256 string")
    return manifest.verify(spark, folder, table)


def collect(downloads: DataFrame, entities: DataFrame, chunk_chars: int = 14_000, overlap_chars: int = 1_500, max_chunks: int = 100) -> dict[str, DataFrame]:
    """Documents, windows and errors out of stored downloads.

    ``downloads``: ``municipality_id, requested_url, url, html, content_type, sha256, error``. Downloads outside the
    entity's domains, failed ones and unsupported ones become rows of ``errors``; error pages stay documents and are not
    windowed; an entity without documents has a gap.
    """
    domains = entities.select(F.col("id").alias("municipality_id"), "domains")
    d = downloads.join(domains, "municipality_id", "left").withColumn("final", urls.normalize_url(F.col("url")))
    fine = F.col("error").isNull() & F.col("final").isNotNull() & urls.domain_allowed(F.col("final"), F.col("domains"))
    kept = discovery.first_seen(d.where(fine), ["municipality_id", "final", "sha256"], [F.col("requested_url")])
    texts = pages.extract(kept.select(F.col("final").alias("url"), "html", "content_type").dropDuplicates(["url"]))
    documents = kept.select("municipality_id", "requested_url", F.col("final").alias("url"), "sha256").join(texts, "url")
    documents = documents.withColumn("id", document_id(F.col("municipality_id"), F.col("url"), F.col("sha256")))
    usable = documents.where((F.col("kind") == "html") & ~F.array_contains("warnings", "suspected_error_page_not_classified"))
    windows = chunking.chunk_documents(usable, chunk_chars, overlap_chars, max_chunks)
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("final").isNull(), "bad address").otherwise("outside the entity's domains")
    errors = d.where(~F.coalesce(fine, F.lit(False))).select("municipality_id", F.lit("fetch").alias("stage"), F.col("requested_url").alias("url"), reason.alias("detail"))
    unsupported = documents.where("kind <> 'html'").select("municipality_id", F.lit("extract").alias("stage"), "url", F.col("kind").alias("detail"))
    gaps = entities.select(F.col("id").alias("municipality_id")).join(documents.select("municipality_id").distinct(), "municipality_id", "left_anti").select("municipality_id", F.lit("no_documents_retrieved").alias("gap"))
    return {"documents": documents, "chunks": windows, "errors": errors.unionByName(unsupported), "gaps": gaps}
