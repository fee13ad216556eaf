"""Problem 9: long spans that stand verbatim in more than one record.

A log-structured index of window hashes: from every ``span - anchor + 1`` neighbouring windows of ``ANCHOR`` code points
the one of least hash is kept, so any span of ``SPAN`` code points that two texts share has a kept window, an anchor, at
the same place in both. Each batch's anchors become a sorted immutable run; a merge join of the new run with older ones
shows the anchors that stand in different texts; those are verified on the texts around them, character by character.
The runs are bucketed by anchor, so older ones stay where they are, and are compacted when there are many. Copies of a whole text are one class and are fingerprinted once.

Texts that share a span are kept as cliques (an anchor with equal surroundings on both sides, or a verified overlap of
two surroundings) and only expanded to pairs where pairs are asked for.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.session import scratch_dir, write_table

SPAN, ANCHOR = 200, 100
#: Anchors with at most so many different surroundings are compared pair by pair, others by hashes of all their windows.
FEW_CONTEXTS = 24
#: Runs of an index before they are merged into one.
MOST_RUNS = 8

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x2545F4914F6CDD1D)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``B**i`` and ``B**-i`` modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = np.uint64(pow(int(_B), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for name, base in (("up", _B), ("down", inverse)):
                f = np.full(size, base, np.uint64)
                f[0] = 1
                _POWERS[name] = np.multiply.accumulate(f)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` code points."""
    n = len(codes)
    if n < width:
        return np.empty(0, np.uint64)
    up, down = _powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mix((codes.astype(np.uint64) + np.uint64(1)) * _M3) * up[:n], out=sums[1:])
        return _mix((sums[width:] - sums[:-width]) * down[: n - width + 1])


def _sliding(values: np.ndarray, width: int, f) -> np.ndarray:
    """``f`` over each window of ``width`` values, by doubling."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = f(out[:-step], out[step:])
        done += step
    return out


def anchors(codes: np.ndarray, span: int = SPAN, width: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors: the windows of least hash of any ``span - width + 1`` neighbours (all, if equal)."""
    h = window_hashes(codes, width)
    w = span - width + 1
    if len(h) < w:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    least = _sliding(h, w, np.minimum)
    # a place is kept if the least of some neighbourhood that holds it is its own
    edge = np.zeros(w - 1, np.uint64)
    kept = _sliding(np.concatenate([edge, least, edge]), w, np.maximum) == h
    at = np.flatnonzero(kept)
    return at, h[at]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


_RUN_SCHEMA = "anchor bigint, cls bigint, pos int"


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()  # a task's classes; a partition holds a bounded share of the texts
    for batch in batches:
        hashes, classes, places = [], [], []
        for cls, text in zip(batch["cls"].to_pylist(), batch["text"].to_pylist()):
            if cls in seen:
                continue
            seen.add(cls)
            at, h = anchors(_codes(text))
            hashes.append(h)
            classes.append(np.full(len(at), cls, np.int64))
            places.append(at.astype(np.int32))
        if hashes:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(classes)), pa.array(np.concatenate(places))], names=["anchor", "cls", "pos"]
            )


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """``doc_id, text, cls``: the texts long enough to hold a span. ``cls`` tells texts apart, copies have the same.

    It is a hash: :func:`classes_clash` says whether it ever stands for two texts, and another ``seed`` gives other ones.
    """
    long = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text") >= SPAN)
    return long.where("doc_id is not null").withColumn("cls", F.xxhash64("text", F.length("text"), F.lit(seed)))


def classes_clash(texts: DataFrame) -> bool:
    """Whether one ``cls`` stands for texts of different SHA-256 digests."""
    digest = F.sha2("text", 256)
    return not texts.groupBy("cls").agg(F.min(digest).alias("lo"), F.max(digest).alias("hi")).where("lo <> hi").isEmpty()


class SpanIndex:
    """A log-structured index of anchors in a folder that all executors share: batch after batch, session after session.

    Every batch's anchors are an immutable run: a table bucketed and sorted by anchor, so that merging it with older runs
    moves none of their rows. A manifest in the folder names the runs; an index on a folder that has one goes on from it.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.folder = (folder or f"{scratch_dir(spark)}/spans-{uuid.uuid4().hex}").rstrip("/")
        known = self._read_manifest()
        if known and (known["span"], known["anchor"]) != (SPAN, ANCHOR):
            raise ValueError(f"the index in {self.folder} was made for spans of {known['span']} and anchors of {known['anchor']}")
        self.buckets = known["buckets"] if known else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.batches: int = known["batches"] if known else 0
        self.runs: list[str] = known["runs"] if known else []
        self.found: list[str] = known["found"] if known else []

    # the manifest is replaced by renaming, so it always names whole runs

    def _file_system(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _read_manifest(self) -> dict | None:
        files, path = self._file_system()
        for name in ("manifest.json", "manifest.next"):
            if files.exists(path(f"{self.folder}/{name}")):
                return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.folder}/{name}").collect()))
        return None

    def _write_manifest(self) -> None:
        files, path = self._file_system()
        now, coming = path(f"{self.folder}/manifest.json"), path(f"{self.folder}/manifest.next")
        out = files.create(coming, True)
        out.write(bytearray(json.dumps({"span": SPAN, "anchor": ANCHOR, "buckets": self.buckets, "batches": self.batches, "runs": self.runs, "found": self.found}).encode()))
        out.close()
        files.delete(now, False)
        files.rename(coming, now)

    def _write_run(self, rows: DataFrame, name: str) -> None:
        table = f"spans_{uuid.uuid4().hex}"
        writer = rows.write.format("parquet").option("compression", "zstd").option("path", f"{self.folder}/{name}")
        writer.bucketBy(self.buckets, "anchor").sortBy("anchor", "cls", "pos").saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")  # the files stay

    def _run(self, name: str) -> DataFrame:
        """A run as a bucketed table: a join or an aggregation by anchor needs no exchange of it."""
        table = f"spans_{xxhash.xxh3_64_hexdigest(f'{self.folder}/{name}')}"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({_RUN_SCHEMA}) USING parquet CLUSTERED BY (anchor) SORTED BY (anchor, cls, pos) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'"
        )
        return self.spark.table(table)

    def merged(self, run: str, older: list[str]) -> DataFrame:
        """Rows of a run and of older ones whose anchors the run has and that stand in more than one class.

        Merge joins by anchor over the buckets: each older run gives the rows that the new one touches, then the least and
        the greatest class of an anchor tell whether it is shared. All of it stays within the buckets.
        """
        def classes(rows: DataFrame, k: int) -> DataFrame:
            return rows.groupBy("anchor").agg(F.min("cls").alias(f"lo{k}"), F.max("cls").alias(f"hi{k}"))

        new = self._run(run)
        parts = [new, *(self._run(name).join(new.select("anchor"), "anchor", "left_semi") for name in older)]
        known = classes(new, 0)
        for k, rows in enumerate(parts[1:], 1):
            known = known.join(classes(rows, k), "anchor", "left")
        lows, highs = ([F.col(f"{name}{k}") for k in range(len(parts))] for name in ("lo", "hi"))
        shared = known.where((F.least(*lows) if older else lows[0]) != (F.greatest(*highs) if older else highs[0])).select("anchor")
        out = [rows.join(shared, "anchor", "left_semi") for rows in parts]
        return reduce(DataFrame.unionAll, out)

    def ingest(self, texts: DataFrame) -> DataFrame:
        """Add a batch (:func:`texts_of`); returns :meth:`shared`. An empty batch changes nothing but the count of batches.

        The batch alone is shuffled, by anchor into the index's buckets, and becomes a run; it is merge-joined with the older
        ones. With more than ``MOST_RUNS`` runs they are compacted.
        """
        self.batches += 1
        run, found = f"run-{self.batches:05d}", f"shared-{self.batches:05d}"
        rows = texts.select("cls", "text").mapInArrow(_fingerprint, _RUN_SCHEMA)
        self._write_run(rows.repartition(self.buckets, F.col("anchor")), run)
        self.merged(run, self.runs).write.option("compression", "zstd").parquet(f"{self.folder}/{found}")
        self.runs, self.found = [*self.runs, run], [*self.found, found]
        self._write_manifest()
        if len(self.runs) > MOST_RUNS:
            self.compact()
        return self.shared()

    def compact(self) -> None:
        """Merge all runs into one, bucket by bucket, without an exchange; the old ones are deleted once the manifest is written."""
        if len(self.runs) < 2:
            return
        old = self.runs
        rows = self._run(old[0])
        for name in old[1:]:
            rows = rows.unionAll(self._run(name))
        whole = f"run-{self.batches:05d}-whole"
        self._write_run(rows.groupBy("anchor", "cls", "pos").agg(F.lit(None).alias("none")).drop("none"), whole)
        self.runs = [whole]
        self._write_manifest()
        files, path = self._file_system()
        for name in old:
            files.delete(path(f"{self.folder}/{name}"), True)

    def shared(self) -> DataFrame:
        """``anchor, cls, pos``: the occurrences of anchors that texts of all batches so far share."""
        if not self.found:
            return self.spark.createDataFrame([], _RUN_SCHEMA)
        return self.spark.read.schema(_RUN_SCHEMA).parquet(*(f"{self.folder}/{name}" for name in self.found)).distinct()


# --- verification ----------------------------------------------------------------------------------------------------

_CONTEXT_SCHEMA = "anchor bigint, cls bigint, pos int, lead int, h bigint, context string"


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reach = SPAN - ANCHOR
    for batch in batches:
        rows: list[list] = [[] for _ in range(6)]
        for cls, text, places in zip(batch["cls"].to_pylist(), batch["text"].to_pylist(), batch["places"].to_pylist()):
            for p in places:
                at = p["pos"]
                start = max(0, at - reach)
                context = text[start : at + ANCHOR + reach]
                for col, v in zip(rows, (p["anchor"], cls, at, at - start, _signed(xxhash.xxh3_64_intdigest(f"{at - start}:{context}")), context)):
                    col.append(v)
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=["anchor", "cls", "pos", "lead", "h", "context"])


def common_span(a: str, lead_a: int, b: str, lead_b: int) -> tuple[int, int]:
    """How far two contexts agree to the left and to the right of their anchors' starts."""
    left = 0
    most = min(lead_a, lead_b)
    while left < most and a[lead_a - 1 - left] == b[lead_b - 1 - left]:
        left += 1
    right = 0
    x, y = a[lead_a:], b[lead_b:]
    most = min(len(x), len(y))
    if x[:most] == y[:most]:
        return left, most
    while x[right] == y[right]:
        right += 1
    return left, right


_LINK_SCHEMA = "anchor bigint, h bigint, other bigint, lo int, hi int"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of contexts of one anchor that share a span; an anchor has at most ``FEW_CONTEXTS`` here.

    For each of the two a row: the other one, and what is shared, relative to the anchor.
    """
    current, held = None, []
    for batch in batches:
        out: list[list] = [[] for _ in range(5)]
        for anchor, h, lead, context in zip(*(batch[c].to_pylist() for c in ("anchor", "h", "lead", "context"))):
            if anchor != current:
                current, held = anchor, []
            for h2, lead2, context2 in held:
                left, right = common_span(context, lead, context2, lead2)
                if right >= ANCHOR and left + right >= SPAN:
                    for one, two in ((h, h2), (h2, h)):
                        for col, v in zip(out, (anchor, one, two, -left, right)):
                            col.append(v)
            held.append((h, lead, context))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["anchor", "h", "other", "lo", "hi"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of ``SPAN`` code points of a context, by place and hash: for anchors with many contexts."""
    for batch in batches:
        anchors_, contexts, hashes, places = [], [], [], []
        for anchor, h, lead, context in zip(*(batch[c].to_pylist() for c in ("anchor", "h", "lead", "context"))):
            w = window_hashes(_codes(context), SPAN)
            anchors_.append(np.full(len(w), anchor, np.int64))
            contexts.append(np.full(len(w), h, np.int64))
            hashes.append(w.view(np.int64))
            places.append(np.arange(len(w), dtype=np.int32) - np.int32(lead))
        if anchors_:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (anchors_, contexts, hashes, places)], names=["anchor", "h", "w", "lo"])


class SharedSpans:
    """Verified spans of a collection: cliques of classes, and each class's shared places."""

    def __init__(self, texts: DataFrame, shared: DataFrame):
        self.texts = texts
        self.members = texts.select("doc_id", "cls").distinct()
        classes = self.members.groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
        places = shared.groupBy("cls").agg(F.collect_list(F.struct("anchor", "pos")).alias("places"))
        chosen = places.join(classes, "cls").select("doc_id", "cls", "places")
        held = chosen.join(texts.select("doc_id", "text"), "doc_id").select("cls", "text", "places")
        self.contexts = write_table(held.mapInArrow(_contexts, _CONTEXT_SCHEMA), "contexts")
        kinds = self.contexts.groupBy("anchor", "h").agg(F.min("lead").alias("lead"), F.min("cls").alias("a"), F.max("cls").alias("b"))
        per_anchor = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
        mixed = self.contexts.select("anchor", "h", "lead", "context").join(per_anchor, "anchor").groupBy("anchor", "h", "kinds").agg(F.first("lead").alias("lead"), F.first("context").alias("context"))
        few = mixed.where(F.col("kinds") <= FEW_CONTEXTS).repartition(F.col("anchor")).sortWithinPartitions("anchor")
        self.links = write_table(few.mapInArrow(_compare, _LINK_SCHEMA), "links")
        many = mixed.where(F.col("kinds") > FEW_CONTEXTS)
        windows = many.mapInArrow(_windows, "anchor bigint, h bigint, w bigint, lo int")
        common = windows.groupBy("anchor", "lo", "w").agg(F.min("h").alias("p"), F.max("h").alias("q")).where("p <> q").select("anchor", "lo", "w")
        # hashes only choose the windows: those that stand in two contexts are told apart by the digest of their text
        text = F.expr(f"sha2(substring(context, lo + lead + 1, {SPAN}), 256)")
        told = windows.join(common, ["anchor", "lo", "w"], "left_semi").join(many.select("anchor", "h", "lead", "context"), ["anchor", "h"])
        self.windows = write_table(told.select("anchor", "h", text.alias("w"), "lo"), "windows")

    def cliques(self) -> DataFrame:
        """``clique, cls``: classes any two of which share a span. Cliques of the same classes are kept once."""
        of = self.contexts.select("anchor", "h", "cls").distinct()
        same = of.select(F.xxhash64(F.lit("context"), "anchor", "h").alias("clique"), "cls")
        pair = self.links.select("anchor", "h", F.xxhash64(F.lit("link"), "anchor", F.least("h", "other"), F.greatest("h", "other")).alias("clique"))
        linked = pair.join(of, ["anchor", "h"]).select("clique", "cls")
        window = self.windows.select("anchor", "h", F.xxhash64(F.lit("window"), "anchor", "lo", "w").alias("clique")).distinct().join(of, ["anchor", "h"]).select("clique", "cls")
        rows = same.unionAll(linked).unionAll(window).distinct()
        signed = rows.groupBy("clique").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("s")).where("size > 1")
        kept = signed.groupBy("size", "x", "s").agg(F.min("clique").alias("clique")).select("clique", "size")
        return rows.join(kept, "clique")

    def class_pairs(self, block: int = 2000) -> DataFrame:
        """``a, b`` (a < b): pairs of classes that share a span. Large cliques are worked in blocks of members."""
        rows = self.cliques().withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
        left = rows.select("clique", F.col("cls").alias("a"), F.expr("cast(pmod(xxhash64(cls), blocks) as int)").alias("part"))
        right = rows.select("clique", F.col("cls").alias("b"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("part"))
        return left.join(right, ["clique", "part"]).where("a < b").select("a", "b").distinct()

    def pairs(self) -> DataFrame:
        """``doc_id_a, doc_id_b``: all pairs of documents that share a span, copies among them."""
        m = self.members
        a, b = m.select(F.col("cls").alias("a"), F.col("doc_id").alias("x")), m.select(F.col("cls").alias("b"), F.col("doc_id").alias("y"))
        different = self.class_pairs().join(a, "a").join(b, "b").select("x", "y")
        copied = m.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select("cls", F.ceil(F.col("n") / 2000).cast("int").alias("blocks"))
        rows = m.join(copied, "cls")
        left = rows.select("cls", F.col("doc_id").alias("x"), F.expr("cast(pmod(xxhash64(doc_id), blocks) as int)").alias("part"))
        right = rows.select("cls", F.col("doc_id").alias("y"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("part"))
        copies = left.join(right, ["cls", "part"]).where("x < y").select("x", "y")
        return different.unionAll(copies).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))

    def shared(self) -> DataFrame:
        """Of every text of the collection: ``doc_id, class_id, n_chars, shared_chars, share``.

        ``class_id`` is the least id of the document's copies. Copies share their whole text.
        """
        kinds = self.contexts.groupBy("anchor", "h").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b").select("anchor", "h")
        c = self.contexts.select("anchor", "h", "cls", "pos", "lead", F.length("context").alias("n"))
        whole = c.join(kinds, ["anchor", "h"]).select("cls", (F.col("pos") - F.col("lead")).alias("s"), (F.col("pos") - F.col("lead") + F.col("n")).alias("e"))
        part = self.links.groupBy("anchor", "h", "lo", "hi").count().join(c, ["anchor", "h"]).select("cls", (F.col("pos") + F.col("lo")).alias("s"), (F.col("pos") + F.col("hi")).alias("e"))
        window = self.windows.select("anchor", "h", "lo").distinct().join(c, ["anchor", "h"]).select("cls", (F.col("pos") + F.col("lo")).alias("s"), (F.col("pos") + F.col("lo") + SPAN).alias("e"))
        spans = whole.unionAll(part).unionAll(window).distinct()
        # the length of a union of intervals: a state of (covered so far, furthest end) over the sorted intervals of a text
        merged = spans.groupBy("cls").agg(
            F.expr("aggregate(array_sort(collect_list(struct(s, e))), struct(0 as n, 0 as hi), (acc, x) -> struct(acc.n + greatest(0, x.e - greatest(x.s, acc.hi)) as n, greatest(acc.hi, x.e) as hi), acc -> acc.n)").alias("covered")
        )
        classes = self.members.groupBy("cls").agg(F.count("*").alias("copies"), F.min("doc_id").alias("class_id"))
        sizes = self.texts.select("doc_id", "cls", F.length("text").alias("n_chars"))
        found = sizes.join(classes, "cls").join(merged, "cls", "left")
        chars = F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0)))
        return found.select("doc_id", "class_id", "n_chars", chars.alias("shared_chars"), F.round(chars / F.col("n_chars"), 6).alias("share"))


def shared_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 1) -> SharedSpans:
    """Index a whole collection, in so many batches by the hash of the id, and verify what is shared.

    Null texts, null ids and texts shorter than ``SPAN`` code points can't share a span and are left out. Rows repeated
    with id and text are one document. Extra columns are not read. Several batches end with a compaction and give the
    same result as one.
    """
    texts = next(t for seed in count() for t in [texts_of(df, id_col, text_col, seed)] if not classes_clash(t))
    index = SpanIndex(df.sparkSession)
    for k in range(batches):
        index.ingest(texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k) if batches > 1 else texts)
    index.compact()
    return SharedSpans(texts, index.shared())
