"""Problem 8: records of several sources mixed to target shares of the total size.

Every record of a source is used the same whole number of times, and once more with the fraction that is left. Which
records are used once more is drawn by the cube method: the fractions are moved through the null space of the balancing
equations (number of records and tokens of the source) until each is 0 or 1. The flight phase needs only as many records
at a time as there are equations, and one more, so it runs as a stream in every bucket of a source. The last ``LANDING``
records of a bucket are left open; those of all buckets of a source go through a second flight, and the ones that this
leaves open are landed together, by the choice that keeps the source's tokens best.
"""

from __future__ import annotations

import random
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evispark.session import write_table

#: Records per bucket of a source in the first flight.
BUCKET_RECORDS = 20_000
#: Records left to the landing phase, which looks at every choice among them (and up to two more).
LANDING = 10
_EPS = 1e-9


@dataclass(frozen=True)
class SourcePlan:
    source: str
    target_share: float
    max_repeats: int
    tokens: int
    records: int
    wanted_tokens: float

    @property
    def repeats(self) -> float:
        return min(self.wanted_tokens / self.tokens, self.max_repeats) if self.tokens else 0.0


def plan(targets: list[tuple[str, float, int]], available: dict[str, tuple[int, int]], total: float | None = None) -> list[SourcePlan]:
    """How many tokens each source has to give.

    ``targets``: (source, share, most repeats); ``available``: source -> (tokens, records). Without ``total`` the result
    is the largest mix in which every listed source that has tokens reaches its share within its repeats; shares of
    sources without tokens are spread over the others in proportion. With ``total`` sources that can't give their share
    give all they may, and the others make up for it in proportion, as far as they can.
    """
    have = [(s, w, r) for s, w, r in targets if s is not None and w > 0 and r > 0 and available.get(s, (0, 0))[0] > 0]
    most = {s: available[s][0] * r for s, _, r in have}
    wanted: dict[str, float] = {}
    if have and total is None:
        whole = sum(w for _, w, _ in have)
        total = min(most[s] * whole / w for s, w, _ in have)
    rest, open_ = float(total or 0), list(have)
    while open_:
        whole = sum(w for _, w, _ in open_)
        full = [(s, w, r) for s, w, r in open_ if rest * w / whole > most[s] * (1 + 1e-12)]
        for s, w, r in full or open_:
            wanted[s] = float(most[s]) if full else rest * w / whole
        if not full:
            break
        rest -= sum(most[s] for s, _, _ in full)
        open_ = [x for x in open_ if x not in full]
    return [SourcePlan(s, w, r, *available.get(s, (0, 0)), wanted.get(s, 0.0)) for s, w, r in targets if s is not None]


def _land(active: list[list]) -> None:
    """Decide at most ``LANDING + 2`` open records: of all choices the one nearest to the expected tokens and count."""
    if not active:
        return
    x, pi = np.array([a[2] for a in active], float), np.array([a[3] for a in active])
    choices = (np.arange(1 << len(active))[:, None] >> np.arange(len(active))) & 1
    unit = x.mean() or 1.0
    cost = np.abs(choices @ x - pi @ x) / unit + 0.05 * np.abs(choices.sum(1) - pi.sum())
    for a, s in zip(active, choices[int(np.argmin(cost))]):
        a[3] = float(s)


def _flight(rows: Iterator[tuple], seed: int, land: bool) -> Iterator[tuple]:
    """Flight over the records ``(key, payload, x, pi)`` of each key in turn, ``x`` the balanced size beside the count.

    Yields ``(key, payload, x, pi)`` with pi 0 or 1, but for the last ``LANDING`` records of a key and at most two others,
    which stay open, or are landed with ``land``. Holds no more records than that.
    """

    def move(active: list[list], v: list[float], rng: random.Random) -> None:
        up = min(((1 - a[3]) / c if c > 0 else a[3] / -c) for a, c in zip(active, v) if c)
        down = min((a[3] / c if c > 0 else (1 - a[3]) / -c) for a, c in zip(active, v) if c)
        step = up if rng.random() * (up + down) < down else -down
        for a, c in zip(active, v):
            a[3] += step * c

    def decided(active: list[list]) -> Iterator[tuple]:
        for a in list(active):
            if a[3] < _EPS or a[3] > 1 - _EPS:
                a[3] = float(round(a[3]))
                active.remove(a)
                yield tuple(a)

    current, active, ahead, rng = None, [], deque(), random.Random(seed)

    def close() -> Iterator[tuple]:
        left = [*active, *ahead]
        if land:
            _land(left)
        yield from (tuple(a) for a in left)

    for key, payload, x, pi in rows:
        if key != current:
            yield from close()
            current, active, ahead, rng = key, [], deque(), random.Random(f"{seed}:{key}")
        ahead.append([key, payload, x, pi])
        if len(ahead) <= LANDING:
            continue
        active.append(ahead.popleft())
        yield from decided(active)
        if len(active) == 3:
            a, b, c = (r[2] for r in active)
            v = [float(c - b), float(a - c), float(b - a)]  # spans the null space of count and size
            scale = max(map(abs, v))
            move(active, [q / scale for q in v] if scale else [1.0, -1.0, 0.0], rng)
            yield from decided(active)
    yield from close()


def _run_flight(kind: str, seed: int, land: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for source, bucket, doc, n, pi in zip(*(b[c].to_pylist() for c in ("source", "bucket", "doc_id", "n_tokens", "pi"))):
                    yield (source, bucket), doc, n, pi

        out: list[tuple] = []
        for row in _flight(rows(), seed, land):
            out.append(row)
            if len(out) >= 10_000:
                yield batch(out)
                out = []
        yield batch(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        ids = pa.array([r[1] for r in rows], pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0][0] for r in rows], pa.string()), pa.array([r[0][1] for r in rows], pa.int32()), ids, pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.float64())],
            names=["source", "bucket", "doc_id", "n_tokens", "pi"],
        )

    return run


def mix(sizes: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """``(uses, shares)`` of a mix of ``sizes`` (``doc_id, source, n_tokens``) to ``targets`` (one row per source, a small table).

    ``uses``: ``doc_id, source, n_tokens, uses``, a row for every row of ``sizes``; records of unlisted or null sources are
    used 0 times. ``shares``: ``source, target_share, spread_share, max_repeats, n_records, tokens, used_tokens, actual_share,
    mix_tokens, spare_tokens``, a row for every listed source, also those without records: ``spread_share`` is the target
    with the shares of sources without records spread over the others, ``mix_tokens`` the size of the whole mix and
    ``spare_tokens`` what the source could still give within its repeats. Records without tokens are drawn like all others. Null sizes count
    as 0. See :func:`plan` for the total.
    """
    listed = [(r["source"], float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.select("source", "target_share", "max_repeats").collect()]
    sizes = write_table(sizes.select("doc_id", "source", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens")), "sizes")
    names = [s for s, _, _ in listed if s is not None]
    found = sizes.where(F.col("source").isin(names)).groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()  # at most a row per target
    plans = plan(listed, {r["source"]: (r["t"], r["n"]) for r in found}, total)
    spark = sizes.sparkSession
    rule = spark.createDataFrame(
        [(p.source, int(p.repeats + _EPS), max(0.0, p.repeats - int(p.repeats + _EPS)), max(1, p.records // BUCKET_RECORDS)) for p in plans] or [(None, 0, 0.0, 1)], "source string, base int, pi double, buckets int"
    )
    ruled = sizes.join(F.broadcast(rule), "source", "left")  # as long as the list of targets
    kind = sizes.schema["doc_id"].dataType.simpleString()
    schema = f"source string, bucket int, doc_id {kind}, n_tokens bigint, pi double"
    fraction = F.coalesce("pi", F.lit(0.0))
    drawn = ruled.where(fraction > _EPS).select("source", F.expr("cast(pmod(xxhash64(doc_id), buckets) as int)").alias("bucket"), "doc_id", "n_tokens", "pi")
    first = drawn.repartition("source", "bucket").sortWithinPartitions("source", "bucket", F.xxhash64("doc_id", F.lit(seed)), "doc_id", "n_tokens").mapInArrow(_run_flight(kind, seed, False), schema)
    first = write_table(first, "flight")
    is_open = (F.col("pi") > _EPS) & (F.col("pi") < 1 - _EPS)
    pending = first.where(is_open).withColumn("bucket", F.lit(0)).repartition("source").sortWithinPartitions("source", "doc_id", "n_tokens")
    landed = pending.mapInArrow(_run_flight(kind, seed + 1, True), schema)
    whole_uses = ruled.where(fraction <= _EPS).select("doc_id", "source", "n_tokens", F.coalesce("base", F.lit(0)).cast("int").alias("uses"))
    chosen = first.where(~is_open).unionAll(landed).join(F.broadcast(rule.select("source", "base")), "source").select("doc_id", "source", "n_tokens", (F.col("base") + F.round("pi")).cast("int").alias("uses"))
    uses = write_table(whole_uses.unionAll(chosen), "uses")
    used = uses.where("uses > 0").groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("used_tokens"))
    head = spark.createDataFrame([(p.source, p.target_share, p.max_repeats, p.records, p.tokens) for p in plans] or [], "source string, target_share double, max_repeats int, n_records bigint, tokens bigint")
    # as many rows as targets: one window over all of them
    reached = head.join(used, "source", "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
    share = F.try_divide(F.col("used_tokens"), F.sum("used_tokens").over(Window.partitionBy(F.lit(0))))
    everywhere = Window.partitionBy(F.lit(0))
    there = F.when(F.col("n_records") > 0, F.col("target_share")).otherwise(0.0)
    shares = reached.select(
        "source",
        "target_share",
        F.round(F.coalesce(F.try_divide(there, F.sum(there).over(everywhere)), F.lit(0.0)), 9).alias("spread_share"),
        "max_repeats",
        "n_records",
        "tokens",
        "used_tokens",
        F.round(F.coalesce(share, F.lit(0.0)), 9).alias("actual_share"),
        F.sum("used_tokens").over(everywhere).alias("mix_tokens"),
        (F.col("tokens") * F.col("max_repeats") - F.col("used_tokens")).alias("spare_tokens"),
    )
    return uses, shares
