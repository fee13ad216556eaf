"""Checks of coded records against the codebook, their quotations and the fields of a study, and of addresses."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType


def unknown_categories(decisions: DataFrame, codebook: DataFrame) -> DataFrame:
    """``decisions`` with ``known_category``: whether ``codebook.label`` has the category (null categories have none).

    The codebook is a study's list of labels; whether it is broadcast is left to the session's size threshold.
    """
    labels = codebook.select(F.col("label").alias("category"), F.lit(True).alias("__known")).where("category is not null").distinct()
    return decisions.join(labels, "category", "left").select(*decisions.columns, F.coalesce("__known", F.lit(False)).alias("known_category"))


def quotes_hold(indexes: Column, verified: Column) -> Column:
    """Whether an attribute's quotations all exist and are verified; no quotation is no evidence.

    ``indexes``: zero-based places in ``verified``, an array of booleans.
    """
    good = F.forall(indexes, lambda i: F.coalesce((i >= 0) & (i < F.size(verified)) & F.get(verified, i), F.lit(False)))
    return F.coalesce((F.size(indexes) > 0) & good, F.lit(False))


def attribute_issues(attributes: DataFrame, fields: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, name, issue``: attributes whose name ``fields.name`` hasn't (``unknown``), or that a record has again (``repeated``).

    ``attributes``: ``keys``, ``position``, ``name``; of repeated names all but the first position are issues.
    """
    names = fields.select("name", F.lit(True).alias("__known")).where("name is not null").distinct()
    again = F.row_number().over(Window.partitionBy(*keys, "name").orderBy("position")) > 1
    found = attributes.withColumn("__again", again).join(names, "name", "left")
    issue = F.when(F.col("__known").isNull(), "unknown").when(F.col("__again"), "repeated")
    return found.select(*keys, "name", issue.alias("issue")).where("issue is not null")


def labels_missing(required: Column, configured: Column) -> Column:
    """Labels that are required and not configured, sorted; an empty array where the subset holds."""
    return F.array_sort(F.array_except(F.coalesce(required, F.array().cast("array<string>")), F.coalesce(configured, F.array().cast("array<string>"))))


def documents_downloaded(rows: DataFrame, documents: str = "documents") -> DataFrame:
    """``n_downloaded``: nested documents with a hash that isn't empty, over all rows."""
    got = F.size(F.filter(F.coalesce(F.col(documents), F.array().cast(rows.schema[documents].dataType)), lambda d: F.coalesce(d["sha256"], F.lit("")) != ""))
    return rows.agg(F.coalesce(F.sum(got), F.lit(0)).alias("n_downloaded"))


@F.pandas_udf(BooleanType())
def is_public_address(addresses: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Whether a resolved address is one of the public network; null and malformed ones are not. The look-up is the transport's."""

    def public(a) -> bool:
        try:
            return ipaddress.ip_address(a).is_global
        except ValueError:
            return False

    for batch in addresses:
        yield batch.map(public).astype(bool)
