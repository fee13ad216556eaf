"""Notices of any export mapped to one schema, screened and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.functions.dates import year
from evispark.functions.text import casefold, first_filled
from evispark.operators.lexicon import CARE_CODE, CARE_TERMS, Lexicon, screen

#: Names under which exports give a column, in order of preference.
ALIASES = {
    "notice_id": ["notice_id", "publication_number", "publication-number", "id"],
    "publication_date": ["publication_date", "publication-date", "date", "published"],
    "buyer_name": ["buyer_name", "buyer-name", "contracting_authority"],
    "municipality_name": ["municipality_name", "municipality", "buyer_municipality"],
    "title": ["title", "notice_title", "notice-title"],
    "text": ["document_text", "text", "description", "content", "document"],
    "source_url": ["source_url", "source", "notice_url"],
    "document_url": ["document_url", "document-url", "document-url-part", "url"],
    "coverage_status": ["coverage_status", "coverage"],
    "cpv": ["cpv", "cpv_code", "cpv_codes", "main_cpv", "classification-cpv"],
    "description": ["description", "short_description"],
}
#: The columns of a notice.
NOTICE_COLUMNS = ["source", "notice_id", "year", "publication_date", "buyer_name", "municipality_name", "title", "document_status", "language_category", "language_evidence", "language_confidence", "source_url", "document_url", "coverage_status"]


def is_elderly_care(df: DataFrame) -> DataFrame:
    """The rows whose code, title or description names care for the elderly. A filter: put it before costly steps."""
    digits = F.regexp_replace(first_filled(ALIASES["cpv"], df.columns), "\\D", "")
    terms = "(?U)" + CARE_TERMS
    return df.where(F.contains(digits, F.lit(CARE_CODE)) | F.lower(first_filled(ALIASES["title"], df.columns)).rlike(terms) | F.lower(first_filled(ALIASES["description"], df.columns)).rlike(terms))


def normalize_notices(df: DataFrame, source: str, lexicon: Lexicon | None = None) -> DataFrame:
    """The 14 columns of ``NOTICE_COLUMNS`` from whatever aliases ``df`` has; missing ones are empty strings."""
    have = df.columns
    picked = df.select(F.lit(source).alias("source"), *(first_filled(ALIASES[c], have).alias(c) for c in ("notice_id", "publication_date", "buyer_name", "municipality_name", "title", "text", "source_url", "document_url", "coverage_status")))
    screened = screen(picked, "text", lexicon)
    return screened.select(
        *(
            {
                "year": year(F.col("publication_date")).alias("year"),
                "document_status": F.when(F.col("text") != "", "available").otherwise("missing").alias("document_status"),
                "coverage_status": F.when(F.col("coverage_status") != "", F.col("coverage_status")).otherwise("unknown").alias("coverage_status"),
            }.get(c, F.col(c))
            for c in NOTICE_COLUMNS
        )
    )


def aggregate_by_year(notices: DataFrame, by_source: bool = False) -> DataFrame:
    """Counts by year (null for none, last in order), or by source and year in the same single pass."""
    keys = ["source", "year"] if by_source else ["year"]
    return notices.groupBy(*keys).agg(
        F.count("*").alias("n_notices"),
        F.count_if(F.col("document_status") == "available").alias("n_documents"),
        F.count_if(F.col("language_category") == "explicit_requirement").alias("n_explicit_swedish"),
        F.count_if(F.col("language_category") == "language_related").alias("n_language_related"),
        F.array_sort(F.collect_set("coverage_status")).alias("coverage_statuses"),
    )


def ted_query(codes: list[str], country: str, first_year: int, last_year: int) -> str:
    """The search string that pushes codes, country and dates to the remote service."""
    return f"classification-cpv IN ({' '.join(codes)}) AND buyer-country IN ({country}) AND publication-date>={first_year}0101 AND publication-date<={last_year}1231"


def ted_rows(notices: DataFrame, json_col: str = "notice") -> DataFrame:
    """Rows of notices given as JSON text: ten columns, language maps and lists flattened. Broken JSON gives empty ones."""
    from evispark.functions.jsonish import flatten_json, json_addresses

    def raw(key: str):
        return F.get_json_object(json_col, f"$['{key}']")

    def text(key: str):
        value = raw(key)
        quoted = F.when(value.rlike(r"^\s*[\[{]"), value).otherwise(F.to_json(F.array(value)))
        return F.when(value.isNull(), F.lit("")).otherwise(flatten_json(quoted))

    number, title = text("publication-number"), text("notice-title")
    description = F.array_join(F.filter(F.array(title, text("title-lot"), text("description-proc"), text("description-lot")), lambda x: x != ""), "\n")
    return notices.select(
        number.alias("notice_id"),
        F.substring(text("publication-date"), 1, 10).alias("publication_date"),
        text("buyer-name").alias("buyer_name"),
        text("buyer-city").alias("municipality_name"),
        title.alias("title"),
        text("classification-cpv").alias("cpv"),
        description.alias("description"),
        json_addresses(F.to_json(F.array(F.coalesce(raw("document-url-lot"), F.lit(""))))).alias("document_urls"),
        F.when(number != "", F.concat(F.lit("https://ted.europa.eu/sv/notice/-/detail/"), number)).otherwise("").alias("source_url"),
        F.lit("ted_above_eu_threshold").alias("coverage_status"),
    )
