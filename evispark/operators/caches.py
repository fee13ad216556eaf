"""Stored responses, pacing, budgets and integrity as joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replay(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Requests with their stored response and ``cache_hit``; a miss has ``error`` instead, never a lost row.

    ``cache``: ``key, response``, one row per key (the least response if there are more).
    """
    stored = cache.groupBy(key).agg(F.min("response").alias("response"))
    joined = requests.join(stored.withColumn("__hit", F.lit(True)), key, "left")
    hit = F.coalesce("__hit", F.lit(False))
    return joined.select(*requests.columns, "response", hit.alias("cache_hit"), F.when(~hit, "not in the cache").alias("error"))


def outcome(status: Column, robots: Column | None = None) -> Column:
    """What an HTTP status means: ``ok``, ``retry`` (429, 500, 502, 503, 504), ``error`` (others from 400), ``none``.

    For fetches of a robots file 401, 403, 404 and 410 are answers, not errors.
    """
    code = status.try_cast("int")
    answer = code.isin(401, 403, 404, 410) & (robots if robots is not None else F.lit(False))
    return F.when(code.isNull(), "none").when((code < 400) | answer, "ok").when(code.isin(429, 500, 502, 503, 504), "retry").otherwise("error")


def passes(units: DataFrame, id_col: str, n: int, models: list[str]) -> DataFrame:
    """``id_col, pass_no, model``: every unit ``n`` times, the models in turn."""
    turn = F.get(F.array(*(F.lit(m) for m in models)), F.pmod(F.col("pass_no"), F.lit(len(models))))
    return units.select(id_col, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("pass_no")).withColumn("model", turn)


def store_bodies(downloads: DataFrame, most_bytes: int) -> tuple[DataFrame, DataFrame]:
    """``(bodies, pages)``: every body once by content hash, and the metadata by address; bodies beyond the bound left out."""
    kept = downloads.where(F.octet_length("body") <= most_bytes).withColumn("sha256", F.sha2(F.col("body").cast("binary"), 256))
    return kept.select("sha256", "body").dropDuplicates(["sha256"]), kept.drop("body").dropDuplicates(["url"])


def intact(bodies: DataFrame, body_col: str = "body", sha_col: str = "sha256") -> DataFrame:
    """``bodies`` with ``intact``: whether the hash of the body is the recorded one; false where either is null."""
    return bodies.withColumn("intact", F.coalesce(F.sha2(F.col(body_col).cast("binary"), 256) == F.col(sha_col), F.lit(False)))


def request_key(columns: dict[str, Column]) -> Column:
    """The key of a request: the hash of its canonical JSON."""
    from evispark.functions.text import canonical_json

    return F.sha2(canonical_json(columns), 256)


def running_total(df: DataFrame, keys: list[str], order: str, value: Column, name: str, width: int = 1_000_000) -> DataFrame:
    """``df`` with the sum of ``value`` over a key's rows so far, in the order of a whole-number column.

    A key may hold a large share of all rows, so it isn't one window: rows go by stretches of ``width`` in the order, each
    summed by itself, and a stretch starts from the total of those before it. Ties in the order count in any order.
    """
    parts = df.withColumn("__part", F.floor(F.col(order) / F.lit(width))).withColumn("__value", F.coalesce(value.cast("bigint"), F.lit(0)))
    sums = parts.groupBy(*keys, "__part").agg(F.sum("__value").alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*(F.col(k).alias(f"__k{n}") for n, k in enumerate(keys)), F.col("__part").alias("__at"), before.alias("__before"))
    here = F.sum("__value").over(Window.partitionBy(*keys, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    same = F.col("__part").eqNullSafe(F.col("__at"))
    for n, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{n}"))
    return parts.withColumn("__here", here).join(starts, same).select(*df.columns, (F.col("__before") + F.col("__here")).alias(name))


def waits(events: DataFrame, key: str, ts: str, interval: float, order: str, stretch_s: int = 86_400) -> DataFrame:
    """``events`` with ``wait_s``: how long a request had to wait for its key's spacing; 0 for the first of a key.

    A busy key is worked by stretches of time; a stretch's first request looks at the last one of the stretches before.
    """
    micros = F.unix_micros(ts)
    parts = events.withColumn("__at", micros).withColumn("__part", F.floor(micros / F.lit(stretch_s * 1_000_000)))
    last = parts.groupBy(F.col(key).alias("__key"), F.col("__part").alias("__of")).agg(F.max("__at").alias("__max"))
    earlier = last.withColumn("__earlier", F.max("__max").over(Window.partitionBy("__key").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1))).drop("__max")
    joined = parts.join(earlier, F.col(key).eqNullSafe(F.col("__key")) & F.col("__part").eqNullSafe(F.col("__of")))
    before = F.coalesce(F.lag("__at").over(Window.partitionBy(key, "__part").orderBy(ts, order)), F.col("__earlier"))
    due = before + F.lit(int(interval * 1e6)) - F.col("__at")
    return joined.select(*events.columns, F.round(F.coalesce(F.greatest(due, F.lit(0)), F.lit(0)) / 1e6, 6).alias("wait_s"))


def within_budget(events: DataFrame, key: str, order: str, budget: int, costs: Column) -> DataFrame:
    """``events`` with ``calls_so_far`` and ``within_budget``: a running count of those that cost, by key in order."""
    return running_total(events, [key], order, costs.cast("int"), "calls_so_far").withColumn("within_budget", F.col("calls_so_far") <= budget)


def delivered_once(fetches: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``fetches`` with ``attempt`` (rank by order within the first key) and ``repeat``: whether an earlier attempt
    delivered the same keys. The rank comes before the test, so repeats count as attempts.
    """
    first = fetches.groupBy(*(F.col(k).alias(f"__f{n}") for n, k in enumerate(keys))).agg(F.min(order).alias("__first"))
    same = F.lit(True)
    for n, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__f{n}"))
    marked = fetches.join(first, same).select(*fetches.columns, (F.col(order) > F.col("__first")).alias("repeat"))
    return running_total(marked, keys[:1], order, F.lit(1), "attempt")


def mismatches(manifest: DataFrame, actual: DataFrame, key: str = "path", sha: str = "sha256") -> DataFrame:
    """``key, expected, found`` of manifest rows that are missing (``found`` null) or differ."""
    there = actual.select(F.col(key).alias("__key"), F.col(sha).alias("found")).distinct()
    joined = manifest.select(F.col(key), F.col(sha).alias("expected")).distinct().join(there, F.col(key) == F.col("__key"), "left")
    return joined.where(F.col("found").isNull() | (F.col("found") != F.col("expected"))).select(key, "expected", "found")
