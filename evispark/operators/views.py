"""Views for export: flat rows out of nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def evidence(units: DataFrame, documents: DataFrame) -> DataFrame:
    """A row per unit and place; units without places keep one row. ``documents``: ``id, text_path``."""
    d = documents.select(F.col("id").alias("document_id"), "text_path").dropDuplicates(["document_id"])
    rows = units.select("unit_id", "chunk_id", "document_id", "municipality_id", "stage", "category", "quote_index", "purpose", "verified", "issue", F.posexplode_outer("locations").alias("pos", "place"))
    return rows.join(d, "document_id", "left").select(
        "unit_id", "chunk_id", "document_id", "municipality_id", "stage", "category", "quote_index", "purpose", "verified", "issue", (F.col("pos") + 1).alias("occurrence"), F.col("place.match").alias("match"), F.col("place.start").alias("start"), F.col("place.end").alias("end"), F.col("place.line_start").alias("line_start"), F.col("place.page_start").alias("page_start"), "text_path"
    )


def errors(audit: DataFrame, documents: DataFrame, units: DataFrame) -> DataFrame:
    """``municipality_id, stage, url, detail``: failed fetches and discoveries, document warnings and rejected quotations in one table."""
    failed = audit.where((F.col("stage") == "fetch") & (F.col("status") >= "400")).select("municipality_id", "stage", "url", F.col("status").alias("detail"))
    lost = audit.where((F.col("stage") == "discovery") & (F.col("outcome") == "error")).select("municipality_id", "stage", "url", F.col("method").alias("detail"))
    llm = audit.where((F.col("stage") == "llm") & (F.col("status") != "completed")).select("municipality_id", "stage", "url", F.concat_ws(": ", "role", "status").alias("detail"))
    warned = documents.select("municipality_id", F.lit("extract").alias("stage"), "url", F.explode("warnings").alias("detail"))
    rejected = units.where("issue is not null").select("municipality_id", F.lit("verify").alias("stage"), F.col("document_id").alias("url"), F.col("issue").alias("detail"))
    return failed.unionByName(lost).unionByName(llm).unionByName(warned).unionByName(rejected)


def usage(audit: DataFrame) -> DataFrame:
    """Model calls: the eight columns of the log that describe them, and their tokens."""
    return audit.where("stage = 'llm'").select("timestamp", "municipality_id", "role", "model", "key", "cache_hit", "status", F.col("usage.input_tokens").alias("input_tokens"), F.col("usage.output_tokens").alias("output_tokens"), F.col("usage.total_tokens").alias("total_tokens"))


def classifications(units: DataFrame) -> DataFrame:
    """A row per chunk: ``chunk_id, document_id, municipality_id, category, n_quotes, n_verified, needs_review`` of its final stage's units.

    A chunk with several categories has the least, and needs review; units repeated by id count once.
    """
    one = units.dropDuplicates(["unit_id"]).groupBy("chunk_id").agg(
        F.min("document_id").alias("document_id"), F.min("municipality_id").alias("municipality_id"), F.min("category").alias("category"), F.count_distinct("category").alias("n_categories"),
        F.count("quote").alias("n_quotes"), F.count_if("verified").alias("n_verified"), F.coalesce(F.bool_or("needs_review"), F.lit(False)).alias("flagged"),
    )
    return one.select("chunk_id", "document_id", "municipality_id", "category", "n_quotes", "n_verified", (F.col("flagged") | (F.col("n_categories") > 1)).alias("needs_review"))


def attributes(records: DataFrame) -> DataFrame:
    """``chunk_id, name, value, quote_indexes``: a row per attribute of ``records`` (``chunk_id, attributes ARRAY<STRUCT<name, value, quote_indexes>>``)."""
    return records.select("chunk_id", F.explode("attributes").alias("a")).select("chunk_id", "a.name", "a.value", F.array_join(F.transform("a.quote_indexes", lambda i: i.cast("string")), "|").alias("quote_indexes"))


def sources(documents: DataFrame) -> DataFrame:
    """A row per document: its addresses, hashes, kind, title, number of pages and warnings; repeated rows count once."""
    none = F.array().cast("array<string>")
    return documents.dropDuplicates(["id"]).select(
        "id", "municipality_id", "url", "requested_url", "retrieved_at", "raw_sha256", "text_sha256", "media_type", "title", F.size(F.coalesce("pages", F.array().cast(documents.schema["pages"].dataType))).alias("n_pages"), F.array_join(F.coalesce("warnings", none), "|").alias("warnings"), "extractor"
    )


def discovery(audit: DataFrame) -> DataFrame:
    """The events of discovery, each once."""
    return audit.where("stage = 'discovery'").dropDuplicates(["event_no"]).select("event_no", "timestamp", "municipality_id", "url", "method", "outcome", "title", "score", "depth")


def methodology(spark: SparkSession, config, environment: dict[str, str], now: str) -> DataFrame:
    """``item, value``: what a study was run with, and a row per label of its codebook. ``config``: :class:`evispark.config.Config`."""
    r, llm = config.research, config.llm
    rows = [
        ("Question", r.question), ("Cutoff", str(r.cutoff or "")), ("Instructions", r.instructions), ("Models", ", ".join(llm.models)), ("Verifier", llm.verifier_model), ("Adjudicator", llm.adjudicator_model),
        ("Passes", str(llm.passes)), ("Environment", ", ".join(f"{k} {v}" for k, v in sorted(environment.items()))), ("Exported", now),
        *((f"Label: {name}", label.description) for name, label in r.labels.items()),
    ]
    return spark.createDataFrame(rows, "item string, value string")
