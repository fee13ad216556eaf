"""Candidates ranked and limited by entity; links followed over stored responses."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions.urls import domain_allowed, normalize_url
from evispark.session import write_table

#: What a way of discovery adds to the keyword score.
BOOSTS = {"seed": 1000, "web_search": 100, "search": 100}


def boosted(score, method):
    """Score plus the boost of the method."""
    bonus = F.coalesce(*(F.when(method == m, F.lit(b)) for m, b in BOOSTS.items()), F.lit(0))
    return F.coalesce(score, F.lit(0)) + bonus


def first_seen(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of every key in the given order. Ties are broken by all columns, so the result is stable."""
    ties = [F.xxhash64(*df.columns)]
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *ties))).where("__rank = 1").drop("__rank")


def candidates(found: DataFrame, entities: DataFrame, entity_col: str = "municipality_id", url_col: str = "url", order: list | None = None) -> DataFrame:
    """``found`` with ``normalized_url``: the first of each normalized address within the entity's domains.

    Addresses that can't be normalized, entities that aren't listed and hosts outside the domains drop out.
    """
    domains = entities.select(F.col("id").alias(entity_col), F.col("domains").alias("__domains")).dropDuplicates([entity_col])
    joined = found.withColumn("normalized_url", normalize_url(F.col(url_col))).where("normalized_url is not null").join(domains, entity_col)
    allowed = joined.where(domain_allowed(F.col("normalized_url"), F.col("__domains"))).drop("__domains")
    return first_seen(allowed, [entity_col, "normalized_url"], order or [F.col(url_col)])


def frontier(df: DataFrame, k: int, entity_col: str = "municipality_id", score_col: str = "score", depth_col: str = "depth", order_col: str = "event_no") -> DataFrame:
    """The ``k`` candidates of each entity that a priority queue would hand out first, with ``rank`` and ``limited``.

    Order: highest score, least depth, first in sequence. ``limited`` says whether the entity had more. Null scores count
    as 0, null depths as 0.
    """
    by = Window.partitionBy(entity_col)
    rank = F.row_number().over(by.orderBy(F.coalesce(score_col, F.lit(0)).desc(), F.coalesce(depth_col, F.lit(0)), order_col))
    counts = df.groupBy(F.col(entity_col).alias("__entity")).agg((F.count("*") > k).alias("limited"))
    top = df.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.join(counts, F.col(entity_col).eqNullSafe(F.col("__entity"))).drop("__entity")


def fill_templates(entities: DataFrame, templates: list[str], most: int) -> DataFrame:
    """``id, query_no, query``: the first ``most`` templates filled with each entity's name, id and first domain."""
    texts = F.array(*(F.lit(t) for t in templates[:most]))
    rows = entities.select("id", "name", F.get("domains", F.lit(0)).alias("domain"), F.posexplode(texts).alias("query_no", "template"))
    filled = F.replace(F.replace(F.replace("template", F.lit("{name}"), F.coalesce("name", F.lit(""))), F.lit("{id}"), F.coalesce("id", F.lit(""))), F.lit("{domain}"), F.coalesce("domain", F.lit("")))
    return rows.select("id", "query_no", filled.alias("query"))


def follow_redirects(edges: DataFrame, starts: DataFrame, most: int = 5) -> DataFrame:
    """``url, final_url, hops, limited``: where chains of redirects lead.

    ``edges``: ``url, target``, one target per url (the least if there are more); ``starts``: ``url``. Loops end after
    ``most`` hops with ``limited`` true. One join per hop, each over the chains still open.
    """
    step = edges.where("url <> target").groupBy("url").agg(F.min("target").alias("target"))
    now = starts.select("url").distinct().select("url", F.col("url").alias("final_url"), F.lit(0).alias("hops"))
    for _ in range(most):
        hop = step.select(F.col("url").alias("final_url"), F.col("target").alias("__next"))
        now = now.join(hop, "final_url", "left").select("url", F.coalesce("__next", "final_url").alias("final_url"), (F.col("hops") + F.col("__next").isNotNull().cast("int")).alias("hops"))
    more = step.select(F.col("url").alias("final_url"), F.lit(True).alias("__more"))
    return now.join(more, "final_url", "left").select("url", "final_url", "hops", F.coalesce("__more", F.lit(False)).alias("limited"))


def reachable(links: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """``url, depth``: pages within ``depth`` links, breadth first; a page keeps its least depth.

    ``links``: ``url, target``. Each round joins the last round's new pages only and is written, so plans don't grow and
    a lost executor costs one round's tasks; the rounds end where nothing is new.
    """
    rounds = [write_table(starts.select("url").distinct().withColumn("depth", F.lit(0)), "reached")]
    for d in range(1, depth + 1):
        targets = links.join(rounds[-1].select("url"), "url", "left_semi").select(F.col("target").alias("url")).where("url is not null").distinct()
        rounds.append(write_table(targets.join(reduce(DataFrame.unionAll, rounds), "url", "left_anti").withColumn("depth", F.lit(d)), "reached"))
        if rounds[-1].isEmpty():
            break
    return reduce(DataFrame.unionAll, rounds)


def crawl(pages: DataFrame, starts: DataFrame, most: int, depth: int) -> DataFrame:
    """Best-first crawl by entity over stored pages: ``entity, step, url, depth, score, found``.

    ``pages``: ``entity, url, links ARRAY<STRUCT<url, score>>``, what a fetch of the page gives; ``starts``: ``entity, url,
    score``. Every step takes the candidate of highest score, least depth and first sequence; pages that aren't stored
    count as attempts too (``found`` false). Entities run in parallel; an entity's pages come as one sorted stream of
    which the addresses and links are held, not the pages' content.
    """
    a = starts.select("entity", "url", F.col("score").cast("int").alias("score"), F.lit(None).cast("array<struct<url:string,score:int>>").alias("links"), F.lit(0).alias("kind"))
    b = pages.select("entity", "url", F.lit(None).cast("int").alias("score"), F.transform("links", lambda x: F.struct(x["url"].alias("url"), x["score"].cast("int").alias("score"))).alias("links"), F.lit(1).alias("kind"))
    rows = a.unionAll(b).where("entity is not null and url is not null").repartition("entity").sortWithinPartitions("entity", "kind", F.col("score").desc(), "url")

    def visit(entity, queue: list, stored: dict) -> Iterator[tuple]:
        seen, heap, n = set(), [], 0

        def add(url, score, d):
            nonlocal n
            if url is not None and url not in seen:
                seen.add(url)
                heapq.heappush(heap, (-(score or 0), d, n, url))
                n += 1

        for url, score in queue:
            add(url, score, 0)
        step = 0
        while heap and step < most:
            score, d, _, url = heapq.heappop(heap)
            step += 1
            yield entity, step, url, d, -score, url in stored
            if d < depth:
                for x in stored.get(url) or ():
                    add(x["url"], x["score"], d + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, queue, stored, out = None, [], {}, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["entity"] != current:
                    out += visit(current, queue, stored)
                    current, queue, stored = r["entity"], [], {}
                if r["kind"] == 0:
                    queue.append((r["url"], r["score"]))
                else:
                    stored.setdefault(r["url"], r["links"])
        out += visit(current, queue, stored)
        cols = list(zip(*out)) if out else [[]] * 6
        types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["entity", "step", "url", "depth", "score", "found"])

    return rows.mapInArrow(run, "entity string, step int, url string, depth int, score int, found boolean")
