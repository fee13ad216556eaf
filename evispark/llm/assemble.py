"""Whole texts of documents from their stored windows, as sorted streams: no group of windows is ever collected."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that a document brings along from its metadata.
META = ("municipality_id", "media_type", "title", "day")


def overlay(parts: list[str], length: int, start: int, text: str) -> int:
    """Add one window to ``parts`` (whose text has ``length`` code points); the new length. A gap becomes a line feed."""
    if start > length:
        parts.append("\n")
        parts.append(text)
        return length + 1 + len(text)
    if start + len(text) > length:
        parts.append(text[length - start :])
        return start + len(text)
    return length


def sorted_windows(chunks: DataFrame, sources: DataFrame, document_col: str = "document_id", facts: DataFrame | None = None) -> DataFrame:
    """Windows and metadata in one stream by document: a document's metadata first, then its windows by ``start``.

    ``facts`` (``document_id, fact array<bigint>``) are more rows of metadata: what was found out about a document before.

    One shuffle by document id carries both, so no join is needed. Rows with null text or null document id are dropped:
    they say nothing about any text. Repeated rows may stay, as laying a window on itself changes nothing.
    """
    meta = sources.select(
        F.col("id").alias("document_id"), F.lit(-1).alias("start"), F.lit(None).cast("string").alias("text"), "municipality_id", "media_type", "title", F.substring("retrieved_at", 1, 10).alias("day")
    ).where("document_id is not null")
    none = F.lit(None).cast("string")
    windows = chunks.select(F.col(document_col).alias("document_id"), F.coalesce(F.col("start"), F.lit(0)).alias("start"), "text", none.alias("municipality_id"), none.alias("media_type"), none.alias("title"), none.alias("day"))
    windows = windows.where("text is not null and document_id is not null")
    both = meta.unionAll(windows)
    if facts is not None:
        nothing = [none.alias(c) for c in ("text", "municipality_id", "media_type", "title", "day")]
        known = facts.select("document_id", F.lit(-1).alias("start"), *nothing, "fact")
        both = both.withColumn("fact", F.lit(None).cast("array<bigint>")).unionAll(known)
    return both.repartition(F.col("document_id")).sortWithinPartitions("document_id", "start")


def documents(batches: Iterator[pa.RecordBatch], keep: Callable[[dict], bool] = lambda meta: True) -> Iterator[tuple[str, dict, str]]:
    """Over the stream of :func:`sorted_windows`: ``(document_id, metadata, text)`` of each document that has a window.

    Of several rows of metadata the first value that isn't null counts. Texts of documents that ``keep`` refuses are not
    put together. Where the stream has facts, ``meta["facts"]`` lists them.
    """
    current, meta, parts, length, wanted = None, {}, [], 0, True
    for batch in batches:
        ids, starts, texts = (batch.column(k).to_pylist() for k in range(3))
        extra = [batch.column(k).to_pylist() for k in range(3, 7)]
        facts = batch.column(7).to_pylist() if batch.num_columns > 7 else None
        for k, (doc, start, text) in enumerate(zip(ids, starts, texts)):
            if doc != current:
                if parts:
                    yield current, meta, "".join(parts)
                current, meta, parts, length, wanted = doc, dict.fromkeys(META), [], 0, None
                meta["facts"] = []
            if text is None:
                if facts is not None and facts[k] is not None:
                    meta["facts"].append(facts[k])
                    continue
                for name, values in zip(META, extra):
                    if meta[name] is None:
                        meta[name] = values[k]
            else:
                if wanted is None:
                    wanted = keep(meta)
                if wanted:
                    length = overlay(parts, length, start, text)
    if parts:
        yield current, meta, "".join(parts)
