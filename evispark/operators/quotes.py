"""Quotations located in texts, with lines and pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longer quotations aren't searched; shorter ones (trimmed) are located but never count as verified.
LONGEST, SHORTEST = 2_000, 12


def occurrences(quote: str | None, text: str | None) -> list[tuple[str, int, int]]:
    """``(match, start, end)`` of all places that don't overlap: exact ones or, if there are none, with other white space."""
    if text is None or quote is None or not quote.strip() or len(quote) > LONGEST:
        return []
    found, at = [], text.find(quote)
    while at >= 0:
        found.append(("exact", at, at + len(quote)))
        at = text.find(quote, at + len(quote))
    if not found:
        loose = r"\s+".join(map(re.escape, quote.split()))
        found = [("whitespace", *m.span()) for m in re.finditer(loose, text)]
    return found


_PLACE = "array<struct<match:string,start:int,end:int,matched_text:string>>"


def locate(df: DataFrame, quote_col: str = "quote", text_col: str = "text", offset_col: str | None = "start") -> DataFrame:
    """``df`` without ``text_col`` and with ``places``: all places of the quotation in the text, in document offsets.

    Blank, null and overlong quotations and null texts have none. All other columns stay, their names as they are.
    """
    keep = [c for c in df.columns if c != text_col]
    if "places" in keep:
        raise ValueError("the input has a column named places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("match", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("matched_text", pa.string())]))
        for b in batches:
            offsets = b[offset_col].to_pylist() if offset_col else [0] * b.num_rows
            places = []
            for quote, text, offset in zip(b[quote_col].to_pylist(), b[text_col].to_pylist(), offsets):
                offset = offset or 0
                places.append([{"match": k, "start": a + offset, "end": e + offset, "matched_text": text[a:e]} for k, a, e in occurrences(quote, text)])
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(places, kind)], names=[*keep, "places"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep)
    return df.mapInArrow(run, f"{schema}, places {_PLACE}")


def line_of(text: Column, offset: Column) -> Column:
    """One-based line of a code-point offset."""
    before = F.substring(text, F.lit(1), offset)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")


def page_of_start(pages: Column, offset: Column) -> Column:
    """The page that holds the character at ``offset``; null in a page break or without pages."""
    return F.get(F.filter(pages, lambda p: (p["start"] <= offset) & (offset < p["end"])), F.lit(0))


def page_of_end(pages: Column, offset: Column) -> Column:
    """The page that holds the character before ``offset``."""
    return F.get(F.filter(pages, lambda p: (p["start"] < offset) & (offset <= p["end"])), F.lit(0))


def with_pages(locations: DataFrame, documents: DataFrame) -> DataFrame:
    """``locations`` (``document_id, start, end, …``) with ``page_start, page_end, page_char_start, page_char_end``.

    ``documents`` has ``id`` and ``pages``, one row per id; documents that aren't listed give null pages.
    """
    joined = locations.join(documents.select(F.col("id").alias("document_id"), F.col("pages").alias("__pages")), "document_id", "left")
    first, last = page_of_start(F.col("__pages"), F.col("start")), page_of_end(F.col("__pages"), F.col("end"))
    return (
        joined.withColumn("__first", first)
        .withColumn("__last", last)
        .select(
            *locations.columns,
            F.col("__first.page").alias("page_start"),
            F.col("__last.page").alias("page_end"),
            F.when(F.col("__first.page").isNotNull(), F.col("start") - F.col("__first.start")).alias("page_char_start"),
            F.when(F.col("__last.page").isNotNull(), F.col("end") - F.col("__last.start")).alias("page_char_end"),
        )
    )
