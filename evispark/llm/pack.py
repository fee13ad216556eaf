"""Problem 7: items into containers of fixed capacity with little unused space.

Shortest-pack-first over the histogram of lengths: packs are kept as patterns with counts, so the work depends on the
capacity and not on the number of items. Patterns are joined back to the items by the items' rank among their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evispark.session import write_table

#: Items per bucket of a length, within which ranks are given.
BUCKET_ITEMS = 50_000


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns ``(lengths, count)`` for ``{length: count}``, every length in ``1..capacity``.

    Lengths are placed from the longest on, each into the open packs that hold least so far, as far as it fits, and into
    new ones else. A group of equal packs is split only when a length runs out within it, so there are at most twice as
    many patterns as lengths.
    """
    open_by_space: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted(histogram, reverse=True):
        left, space = histogram[length], capacity
        spaces = sorted((s for s in open_by_space if s >= length), reverse=True)
        added: list[tuple[int, tuple[int, ...], int]] = []
        for space in spaces:
            if not left:
                break
            groups = open_by_space[space]
            while groups and left:
                lengths, count = groups.pop()
                # a pack takes as many items of this length as fit before the next pack is opened only if it stays the emptiest
                used = min(count, left)
                if used < count:
                    groups.append((lengths, count - used))
                left -= used
                added.append((space - length, (*lengths, length), used))
            if not groups:
                del open_by_space[space]
        # what was just filled may hold the length again
        while left and any(s >= length for s, _, _ in added):
            added.sort(key=lambda x: x[0])
            space, lengths, count = added.pop()
            used = min(count, left)
            if used < count:
                added.append((space, lengths, count - used))
            left -= used
            added.append((space - length, (*lengths, length), used))
        if left:
            fit = capacity // length
            whole, rest = divmod(left, fit)
            if whole:
                added.append((capacity - fit * length, (length,) * fit, whole))
            if rest:
                added.append((capacity - rest * length, (length,) * rest, 1))
        for space, lengths, count in added:
            open_by_space.setdefault(space, []).append((lengths, count))
    return [(lengths, count) for s in sorted(open_by_space) for lengths, count in open_by_space[s]]


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank, first container and number of containers of each pattern that holds it."""
    table: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for lengths, count in patterns:
        for length in sorted(set(lengths)):
            lo = taken.get(length, 0)
            table.setdefault(length, []).append((lo, base, count))
            taken[length] = lo + count * lengths.count(length)
        base += count
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in table.items()}


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """``doc_id, piece_no, token_start, token_end``: items up to the capacity whole, larger ones in full pieces and a rest."""
    n = F.col("n_tokens")
    cut = sizes.where(n > 0).select("doc_id", n, F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / F.lit(capacity)))).alias("piece_no"))
    start = F.col("piece_no") * capacity
    return cut.select("doc_id", F.col("piece_no").cast("int").alias("piece_no"), start.alias("token_start"), F.least(start + capacity, n).alias("token_end"))


def pack(sizes: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """Assignment of items to containers: ``doc_id, piece_no, token_start, token_end, container_id``.

    Only items above the capacity are split. Every row of ``sizes`` is an item, repeated rows too; null sizes and sizes
    of 0 take no space: one row with ``container_id`` null. Null ids are items as well. Extra columns are not read.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    sizes = sizes.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(size_col).cast("bigint"), F.lit(0)).alias("n_tokens"))
    cut = pieces(sizes, capacity).withColumn("length", (F.col("token_end") - F.col("token_start")).cast("int"))
    # the histogram has at most `capacity` rows
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = _places(pack_histogram(histogram, capacity))
    buckets = max(1, sum(histogram.values()) // BUCKET_ITEMS)
    cut = cut.withColumn("bucket", F.expr(f"cast(pmod(xxhash64(doc_id, piece_no), {buckets}) as int)"))
    before = cut.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece_no"))
    ranked = cut.withColumn("within", within).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("within") - 1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch["length"].to_numpy(), batch["rank"].to_numpy()
            out = np.empty(len(lengths), np.int64)
            order = np.argsort(lengths, kind="stable")
            starts = np.flatnonzero(np.diff(lengths[order], prepend=-1))
            for a, b in zip(starts, np.append(starts[1:], len(order))):
                at = order[a:b]
                lo, base, count = places[int(lengths[at[0]])]
                k = np.searchsorted(lo, ranks[at], "right") - 1
                out[at] = base[k] + (ranks[at] - lo[k]) % count[k]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "piece_no", "token_start", "token_end")), pa.array(out)], names=["doc_id", "piece_no", "token_start", "token_end", "container_id"])

    kind = sizes.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece_no int, token_start bigint, token_end bigint, container_id bigint"
    packed = ranked.select("doc_id", "piece_no", "token_start", "token_end", "length", "rank").mapInArrow(assign, schema)
    zero = F.lit(0).cast("bigint")
    none = sizes.where("n_tokens <= 0").select("doc_id", F.lit(0).alias("piece_no"), zero.alias("token_start"), zero.alias("token_end"), F.lit(None).cast("bigint").alias("container_id"))
    return packed.unionAll(none)


def pack_all(sizes: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """:func:`pack` once for each named capacity: ``pack_name`` and its columns. The sizes are computed once."""
    if not capacities:
        raise ValueError("no capacities given")
    sizes = write_table(sizes.select("doc_id", "n_tokens"), "sizes")
    parts = [pack(sizes, c).select(F.lit(name).alias("pack_name"), "*") for name, c in sorted(capacities.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def use_of_space(packed: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """``pack_name, capacity, n_containers, n_pieces, n_split, used_tokens, share_used``."""
    capacity = F.create_map(*(x for name, c in capacities.items() for x in (F.lit(name), F.lit(c))))
    return (
        packed.where("container_id is not null")
        .groupBy("pack_name", "container_id")
        .agg(F.count("*").alias("pieces"), F.count_if(F.col("piece_no") > 0).alias("split"), F.sum(F.col("token_end") - F.col("token_start")).alias("used"))
        .groupBy("pack_name")
        .agg(F.count("*").alias("n_containers"), F.sum("pieces").alias("n_pieces"), F.sum("split").alias("n_split"), F.sum("used").alias("used_tokens"), F.max("used").alias("fullest"))
        .select("pack_name", capacity[F.col("pack_name")].alias("capacity"), "n_containers", "n_pieces", "n_split", "used_tokens", "fullest", F.round(F.col("used_tokens") / (F.col("n_containers") * capacity[F.col("pack_name")]), 6).alias("share_used"))
    )
