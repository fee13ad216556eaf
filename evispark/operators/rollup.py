"""Roll-ups by entity that report conflicts and gaps instead of hiding them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def conflicts(values: DataFrame, keys: list[str], name: str, value: str, empty_counts: bool = True) -> DataFrame:
    """``keys, name, n_values, conflicting``: whether an attribute has several values; nulls never count, empty ones may."""
    used = F.col(value) if empty_counts else F.nullif(F.col(value), F.lit(""))
    return values.groupBy(*keys, name).agg(F.count_distinct(used).alias("n_values")).withColumn("conflicting", F.col("n_values") > 1)


def agreement(passes: DataFrame, unit: str, stage: str, signature: str) -> DataFrame:
    """``unit, n_passes, n_signatures, agreed``: whether all passes over a unit gave one signature."""
    one = passes.groupBy(unit, stage).agg(F.array_join(F.array_sort(F.collect_set(signature)), "|").alias("__s"))
    return one.groupBy(unit).agg(F.count("*").alias("n_passes"), F.count_distinct("__s").alias("n_signatures")).withColumn("agreed", F.col("n_signatures") == 1)


def entity_summary(entities: DataFrame, documents: DataFrame, records: DataFrame, conclusive: list[str], unknown: str) -> DataFrame:
    """One row per entity, also for those without documents or records.

    ``documents``: ``id, municipality_id, url, warnings``; ``records``: ``municipality_id, category, quote_verified,
    needs_review``. Columns: ``id, name, category`` (the only conclusive one, ``Review`` for several, else ``unknown``),
    ``needs_review, n_documents, n_records, n_verified, coverage, gaps``. Repeated rows count once.
    """
    d = documents.dropDuplicates(["id"]).groupBy("municipality_id").agg(
        F.count("*").alias("n_documents"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("warnings", F.array().cast("array<string>")))))).alias("gaps")
    )
    is_final = F.col("category").isin(conclusive)
    r = records.groupBy("municipality_id").agg(
        F.count("*").alias("n_records"),
        F.count_if("quote_verified").alias("n_verified"),
        F.array_sort(F.collect_set(F.when(is_final, F.col("category")))).alias("final"),
        F.coalesce(F.bool_or("needs_review"), F.lit(False)).alias("flagged"),
    )
    joined = entities.select("id", "name").join(d.withColumnRenamed("municipality_id", "id"), "id", "left").join(r.withColumnRenamed("municipality_id", "id"), "id", "left")
    none = F.array().cast("array<string>")
    final, gaps = F.coalesce("final", none), F.coalesce("gaps", none)
    gaps = F.when(F.coalesce("n_documents", F.lit(0)) == 0, F.array_sort(F.array_union(gaps, F.array(F.lit("no_documents_retrieved"))))).otherwise(gaps)
    return joined.select(
        "id",
        "name",
        F.when(F.size(final) > 1, "Review").when(F.size(final) == 1, F.get(final, F.lit(0))).otherwise(unknown).alias("category"),
        ((F.size(final) != 1) | (F.size(gaps) > 0) | F.coalesce("flagged", F.lit(False))).alias("needs_review"),
        F.coalesce("n_documents", F.lit(0)).alias("n_documents"),
        F.coalesce("n_records", F.lit(0)).alias("n_records"),
        F.coalesce("n_verified", F.lit(0)).alias("n_verified"),
        F.when(F.size(gaps) > 0, "bounded_with_gaps").otherwise("bounded").alias("coverage"),
        F.array_join(gaps, "|").alias("gaps"),
    )
