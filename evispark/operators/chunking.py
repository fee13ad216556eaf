"""Overlapping windows of document texts, numbered lines, page offsets."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions.text import chunk_id

#: Fixed value: pages of a text are parted by this, which belongs to no page.
PAGE_BREAK = "\n\f\n"


def windows_of(text: str, size: int, overlap: int, limit: int) -> tuple[list[tuple[int, int]], bool]:
    """``([(start, end)], limited)``: windows of at most ``size``; ``limited`` if text is left after ``limit`` windows.

    A window that isn't the last ends after the last line feed of its second half, if that lies beyond the overlap.
    """
    feeds = [m.start() for m in re.finditer("\n", text)] if len(text) > size else []
    found: list[tuple[int, int]] = []
    at = 0
    while at < len(text):
        if len(found) >= limit:
            return found, True
        stop = at + size
        if stop < len(text):
            k = bisect.bisect_left(feeds, stop) - 1  # the last line feed within the window
            if k >= 0 and feeds[k] >= at + max(size // 2, overlap + 1):
                stop = feeds[k] + 1
        found.append((at, min(stop, len(text))))
        at = max(at + 1, stop - overlap) if stop < len(text) else len(text)
    return found, False


def chunk_documents(df: DataFrame, size: int = 14_000, overlap: int = 1_500, limit: int = 100, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``document_id, chunk_no, start, end, text, limited, id``, a row per window.

    Null and empty texts have no window. One Arrow pass, no shuffle. Filter documents that aren't to be windowed (error
    pages) before. Repeated rows give repeated windows; extra columns are not read.
    """
    if not (size >= 100 and 0 <= overlap < size):
        raise ValueError("size must be at least 100 and the overlap below it")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                found, limited = windows_of(text, size, overlap, limit)
                rows += [(doc, k, a, b, text[a:b], limited) for k, (a, b) in enumerate(found)]
            types = [batch.schema[0].type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_()]
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["document_id", "chunk_no", "start", "end", "text", "limited"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col), F.col(text_col)).where(F.col(text_col) != "")
    out = rows.mapInArrow(run, f"document_id {kind}, chunk_no int, start int, end int, text string, limited boolean")
    return out.withColumn("id", chunk_id(F.col("document_id").cast("string"), F.col("start"), F.col("end")))


def numbered_lines(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``id, line_no, numbered``: every line (only the line feed ends one) after its six-digit number and a tab."""
    lines = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    number = (F.col("pos") + 1).cast("string")
    padded = F.when(F.length(number) < 6, F.lpad(number, 6, "0")).otherwise(number)
    return lines.select("id", (F.col("pos") + 1).alias("line_no"), F.concat(padded, F.lit("\t"), "line").alias("numbered"))


def page_offsets(pages: DataFrame, id_col: str = "id", page_col: str = "page", text_col: str = "text") -> DataFrame:
    """``id, page, start, end`` in the joined text of the pages: each starts three characters after the one before."""
    sized = pages.select(F.col(id_col).alias("id"), F.col(page_col).alias("page"), F.coalesce(F.length(text_col), F.lit(0)).alias("n"))
    before = F.sum(F.col("n") + len(PAGE_BREAK)).over(Window.partitionBy("id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0))
    return sized.select("id", "page", start.alias("start"), (start + F.col("n")).alias("end"))


def window_gaps(chunks: DataFrame) -> DataFrame:
    """Windows whose next one doesn't start after their own start and at or before their end: ``document_id, start, end, next_start``."""
    nxt = F.lead("start").over(Window.partitionBy("document_id").orderBy("start", "end"))
    return chunks.select("document_id", "start", "end").distinct().withColumn("next_start", nxt).where((F.col("next_start") <= F.col("start")) | (F.col("next_start") > F.col("end")))
