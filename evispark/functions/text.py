"""Scalar functions on text: native expressions where Spark has them, Arrow functions for Unicode normal forms."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Python's ``str.strip`` and ``\s`` know it, for Java patterns.
SPACE = r"[\s\x1c-\x1f]"
#: Fixed value: cells above this length are cut to ``CELL_KEPT`` characters and marked.
CELL_LIMIT, CELL_KEPT, CELL_MARK = 32_000, 31_900, "\n[TRUNCATED; see JSON artifact]"

_BLANKS = re.compile(r"[^\S\n]+")
_AROUND_FEED = re.compile(r" ?\n ?")
_MANY_LINES = re.compile(r"\n{3,}")
_FEEDS = re.compile(r"\r\n?")
_DELETED = str.maketrans("", "", "\0\u00ad")


def clean(value: str | None) -> str | None:
    """NFC, line feeds only, no NUL or soft hyphen, single spaces, at most one blank line in a row, trimmed."""
    if value is None:
        return None
    whole = value if value.isascii() else unicodedata.normalize("NFC", value)
    whole = _BLANKS.sub(" ", _FEEDS.sub("\n", whole).translate(_DELETED))
    return _MANY_LINES.sub("\n\n", _AROUND_FEED.sub("\n", whole)).strip()


@F.pandas_udf(StringType())
def clean_text(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """:func:`clean` for columns; null stays null."""
    for s in values:
        yield s.map(clean, na_action="ignore")


@F.pandas_udf(StringType())
def casefold(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in values:
        yield s.str.casefold()


def strip(c: Column) -> Column:
    """Both ends without white space of any kind (Spark's ``trim`` knows the plain space only)."""
    return F.regexp_replace(c, f"(?U)^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space made one space, both ends trimmed."""
    return strip(F.regexp_replace(c, f"(?U){SPACE}+", " "))


def first_filled(columns: list[str], present: list[str]) -> Column:
    """The first of ``columns`` that exists and isn't blank, trimmed; else an empty string."""
    filled = [F.nullif(strip(F.col(f"`{c}`").cast("string")), F.lit("")) for c in columns if c in present]
    return F.coalesce(*filled, F.lit(""))


def sanitize_cell(c: Column) -> Column:
    """Control characters made spaces; texts beyond a cell's limit cut and marked."""
    plain = F.regexp_replace(c, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", " ")
    return F.when(F.length(plain) > CELL_LIMIT, F.concat(F.substring(plain, 1, CELL_KEPT), F.lit(CELL_MARK))).otherwise(plain)


def document_id(entity: Column, url: Column, raw_sha256: Column) -> Column:
    """The first 24 hex digits of the hash of entity, final URL and content hash; null if any is null."""
    whole = F.concat(entity, F.lit("\n"), url, F.lit("\n"), raw_sha256)
    return F.substring(F.sha2(whole, 256), 1, 24)


def chunk_id(document: Column, start: Column, end: Column) -> Column:
    return F.concat(document, F.lit(":"), start.cast("string"), F.lit(":"), end.cast("string"))


def canonical_json(columns: dict[str, Column]) -> Column:
    """JSON with sorted keys and nulls kept, so that equal records give equal bytes."""
    return F.to_json(F.struct(*(columns[k].alias(k) for k in sorted(columns))), {"ignoreNullFields": "false"})


def slug_title(slug: Column) -> Column:
    """``a-b-kommun`` as ``A B kommun``."""
    return F.replace(F.initcap(F.replace(slug, F.lit("-"), F.lit(" "))), F.lit(" Kommun"), F.lit(" kommun"))


def last_segment(reference: Column, url: Column) -> Column:
    """A reference, or the last segment of an address where there is none."""
    tail = F.element_at(F.split(F.regexp_replace(F.coalesce(url, F.lit("")), "/+$", ""), "/"), -1)
    return F.coalesce(F.nullif(strip(reference), F.lit("")), tail)
