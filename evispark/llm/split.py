"""Problem 6: cut oversized items into overlapping pieces at natural boundaries.

An item is never handled as a whole. It is read in ranges; each range yields the cut positions inside it, their rank and
what its edges look like. What a halo around a range would show is carried from range to range as three flags, so a rank
never depends on where ranges end. Prefix sums of the lengths give global positions. Cuts are chosen over the stitched
table, which holds no text: for files in groups of ranges at once, each from a guessed beginning, and again from where the
group before ends, until nothing changes. Pieces are emitted by offset from the ranges they touch.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evispark.session import scratch_dir, write_table

#: Code points (or bytes, for files) of a range.
RANGE_SIZE = 1 << 20
#: Ranges of a file whose cuts are chosen in one go.
GROUP = 256
#: What a cut may follow, by rank: 4 a blank line or a form feed (with its line feed), 3 a line feed, 2 a blank
#: after the end of a sentence and its closing marks, 1 any blank. The highest rank wins.
_CLOSERS = "'\"”’»)\\]"
_CUT = re.compile(rf"\f\n?|\n|(?P<end>[.!?…][{_CLOSERS}]*)?[ \t]")
_LEAD = re.compile(rf"[{_CLOSERS}]*")
_PENDING = re.compile(rf"[.!?…][{_CLOSERS}]*\Z")


class Edges(NamedTuple):
    """What a range shows at its edges."""

    first_blank: int  # the cut after the blank that follows nothing but closing marks, or -1: an end of sentence before it ranks it 2
    first_line: int  # the cut after the line feed that follows nothing but blanks, or -1: a blank line before it ranks it 4
    all_closers: bool
    all_blank: bool
    ends_blank: int  # 1: its last line is blank so far, 0: it isn't, -1: it has no line feed
    ends_sentence: bool
    ends_feed: bool
    begins_line: bool  # with a line feed


class Carry(NamedTuple):
    """What a range needs to know of the text before it."""

    blank: bool = False  # only blanks since the last line feed
    sentence: bool = False  # a sentence has ended, closing marks may follow
    feed: bool = False  # a form feed


def range_boundaries(text: str) -> tuple[list[int], list[int], Edges]:
    """Cut positions in ``text``, their ranks as if nothing stood before it, and its edges."""
    cuts, ranks = [], []
    line = -1  # end of the last line feed
    for m in _CUT.finditer(text):
        end, c = m.end(), text[m.end() - 1]
        if c == "\f":
            rank = 4
        elif c == "\n":
            rank = 4 if end - m.start() == 2 or line >= 0 and not text[line : end - 1].strip(" \t") else 3
            line = end
        else:
            rank = 2 if m["end"] else 1
        cuts.append(end)
        ranks.append(rank)
    lead = _LEAD.match(text).end()
    stripped = text.lstrip(" \t")
    begins = len(text) - len(stripped)
    last = text.rfind("\n")
    edges = Edges(
        lead + 1 if text[lead : lead + 1] in (" ", "\t") else -1,
        begins + 1 if stripped[:1] == "\n" else -1,
        lead == len(text),
        not stripped,
        -1 if last < 0 else int(not text[last + 1 :].strip(" \t")),
        bool(_PENDING.search(text, max(0, len(text.rstrip("'\"”’»)]")) - 1))),
        text[-1:] == "\f",
        text[:1] == "\n",
    )
    return cuts, ranks, edges


def carry_on(before: Carry, edges: Edges) -> Carry:
    """The carry after a range (that isn't empty)."""
    return Carry(
        edges.ends_blank == 1 or edges.ends_blank < 0 and before.blank and edges.all_blank,
        edges.ends_sentence or before.sentence and edges.all_closers,
        edges.ends_feed,
    )


def in_context(cuts: list[int], ranks: list[int], edges: Edges, before: Carry, goes_on_with_line: bool) -> tuple[list[int], list[int]]:
    """Cuts and ranks of a range with what stands before it, and whether a line feed follows it."""
    ranks = list(ranks)
    for place, known, rank in ((edges.first_blank, before.sentence, 2), (edges.first_line, before.blank or before.feed and edges.begins_line, 4)):
        if known and place >= 0:
            k = cuts.index(place)
            ranks[k] = max(ranks[k], rank)
    if edges.ends_feed and goes_on_with_line:  # the cut lies after the line feed
        return cuts[:-1], ranks[:-1]
    return cuts, ranks


def find_boundaries(text: str) -> tuple[list[int], list[int]]:
    """Cut positions of a whole text and their ranks."""
    return range_boundaries(text)[:2]


def choose_cuts(boundaries: Iterable[tuple[int, int]], length: int, limit: int, overlap: int, start: int = 0) -> Iterator[tuple[int, int]]:
    """Pieces ``[start, end)`` from ``start`` on of at most ``limit``, each next one starting ``overlap`` before the last one's end.

    ``boundaries``: (position, rank) in ascending order, read as a stream; only those of one piece are held. A piece ends
    at the last boundary of the highest rank in its second half, or at the limit where that half has none.
    """
    stream, held = iter(boundaries), []
    nxt = next(stream, None)
    while length - start > limit:
        low, high = start + max(overlap, limit // 2), start + limit
        while nxt is not None and nxt[0] <= high:
            held.append(nxt)
            nxt = next(stream, None)
        held = [b for b in held if b[0] > low]
        end = max(held, key=lambda b: (b[1], b[0]))[0] if held else high
        yield start, end
        start = end - overlap
    yield start, length


_CUTS_TYPE = "item string, n_chars bigint, piece_no int, piece_start bigint, piece_end bigint"


_TABLE = "item string, range_no int, n_chars bigint, offset bigint, cuts array<bigint>, ranks array<tinyint>, edges array<int>"


def _range_boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [range_boundaries(t) for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch["item"], batch["range_no"], batch["n_chars"], batch["offset"],
                pa.array([c for c, _, _ in found], pa.list_(pa.int64())), pa.array([r for _, r, _ in found], pa.list_(pa.int8())), pa.array([[int(x) for x in e] for *_, e in found], pa.list_(pa.int32())),
            ],
            names=["item", "range_no", "n_chars", "offset", "cuts", "ranks", "edges"],
        )


def _stitch(limit: int, overlap: int):
    """Over partitions that hold each item's ranges in order: the pieces of every item, by streaming."""

    def rows(batches):
        for batch in batches:
            for item, n, offset, cuts, ranks, e in zip(*(batch[c].to_pylist() for c in ("item", "n_chars", "offset", "cuts", "ranks", "edges"))):
                yield item, n, offset, cuts, ranks, Edges(*e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = rows(batches)
        row = next(stream, None)
        out: list[tuple] = []
        while row is not None:
            item, n = row[0], row[1]

            def boundaries():
                nonlocal row
                carry = Carry()
                while row is not None and row[0] == item:
                    _, _, offset, cuts, ranks, edges = row
                    row = next(stream, None)
                    follows = row is not None and row[0] == item and row[5].begins_line
                    cuts, ranks = in_context(cuts, ranks, edges, carry, follows)
                    yield from zip([offset + c for c in cuts], ranks)
                    carry = carry_on(carry, edges)

            source = boundaries()
            for k, (a, b) in enumerate(choose_cuts(source, n, limit, overlap)):
                out.append((item, n, k, a, b))
                if len(out) >= 10_000:
                    yield _cuts_batch(out)
                    out = []
            for _ in source:  # what lies behind the last cut
                pass
        if out:
            yield _cuts_batch(out)

    return run


def _cuts_batch(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c, d, e = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.string()), pa.array(b, pa.int64()), pa.array(c, pa.int32()), pa.array(d, pa.int64()), pa.array(e, pa.int64())],
        names=["item", "n_chars", "piece_no", "piece_start", "piece_end"],
    )


def item_ranges(items: DataFrame, range_size: int = RANGE_SIZE) -> DataFrame:
    """Ranges of the items' texts: ``item, n_chars, range_no, offset, size, text``."""
    ranges = items.select("item", F.col("n_chars").cast("bigint").alias("n_chars"), "text", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n_chars - 1) div {range_size} as int)"))).alias("range_no"))
    offset = F.col("range_no").cast("bigint") * range_size
    return ranges.select("item", "n_chars", "range_no", offset.alias("offset"), F.least(F.lit(range_size).cast("bigint"), F.col("n_chars") - offset).alias("size"), F.expr(f"substring(text, range_no * {range_size} + 1, {range_size})").alias("text"))


def plan_cuts(items: DataFrame, limit: int = 2400, overlap: int = 300, range_size: int = RANGE_SIZE) -> DataFrame:
    """Pieces of the items above ``limit``: ``item, n_chars, piece_no, piece_start, piece_end``, without text.

    ``items``: ``item STRING`` (a key of the text), ``n_chars``, ``text``. Texts that are null or fit are not listed. The
    key may be shared by equal texts only. Only positions are shuffled; an item's positions are one sorted stream.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half the limit")
    big = items.where(F.col("n_chars") > limit).dropDuplicates(["item"])
    tables = item_ranges(big, range_size).mapInArrow(_range_boundaries, _TABLE)
    ordered = tables.repartition(F.col("item")).sortWithinPartitions("item", "range_no")
    return ordered.mapInArrow(_stitch(limit, overlap), _CUTS_TYPE)


def split_items(df: DataFrame, limit: int = 2400, overlap: int = 300, id_col: str = "id", text_col: str = "text", start_col: str = "start", range_size: int = RANGE_SIZE) -> DataFrame:
    """Every distinct item as pieces: ``id, piece_no, n_pieces, start, end, text``.

    ``start``/``end`` are global when ``start_col`` gives the item's own start (null counts as 0). Null texts give one
    piece with null text and an empty range; empty texts one empty piece; items that fit one piece with their whole
    text. Rows repeated with id, start and text count once; equal ids with different texts stay apart. Extra columns of
    the input are not read.
    """
    items = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(start_col).cast("bigint"), F.lit(0)).alias("base"), F.col(text_col).alias("text")).withColumn("n_chars", F.length("text"))
    items = items.withColumn("item", F.concat_ws("\u0001", F.coalesce("id", F.lit("\u0002")), F.col("base").cast("string"), F.sha2("text", 256)))
    small = items.where(F.coalesce(F.col("n_chars"), F.lit(0)) <= limit).dropDuplicates(["item"])
    small = small.select("id", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.col("base").alias("start"), (F.col("base") + F.coalesce("n_chars", F.lit(0))).alias("end"), "text")
    big = items.where(F.col("n_chars") > limit).dropDuplicates(["item"])
    cuts = plan_cuts(items, limit, overlap, range_size)
    # a piece touches at most ceil(limit / range_size) + 1 ranges; only those reach it
    touched = cuts.withColumn("range_no", F.explode(F.sequence(F.expr(f"cast(piece_start div {range_size} as int)"), F.expr(f"cast((piece_end - 1) div {range_size} as int)"))))
    ranges = item_ranges(big, range_size).select("item", "range_no", "offset", "size", F.col("text").alias("part"))
    cut_out = F.expr("substring(part, cast(greatest(piece_start - offset, 0) as int) + 1, cast(least(piece_end - offset, size) - greatest(piece_start - offset, 0) as int))")
    pieces = (
        touched.join(ranges, ["item", "range_no"])
        .groupBy("item", "piece_no", "piece_start", "piece_end")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range_no", cut_out.alias("t")))), lambda x: x["t"]), "").alias("text"))
    )
    counts = cuts.groupBy("item").agg((F.max("piece_no") + 1).alias("n_pieces"))
    keys = big.select("item", "id", "base")
    large = pieces.join(counts, "item").join(keys, "item").select("id", "piece_no", "n_pieces", (F.col("base") + F.col("piece_start")).alias("start"), (F.col("base") + F.col("piece_end")).alias("end"), "text")
    return small.unionByName(large)


# --- files -----------------------------------------------------------------------------------------------------------


def _open(path: str):
    """A file of a folder that all executors see, or of any file system that Arrow knows by its address."""
    if "://" in path or path.startswith("file:"):
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(path)
        return system.open_input_file(name)
    return open(path, "rb")


def _size(spark: SparkSession, path: str) -> int:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path if ":" in path else f"file:{path}")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).getLen()


def _read_aligned(f, start: int, end: int, size: int) -> tuple[bytes, int]:
    """The bytes of the characters that begin in ``[start, end)``, and where they begin."""
    f.seek(start)
    raw = f.read(min(end + 3, size) - start)
    a = 0
    while start and a < len(raw) and raw[a] & 0xC0 == 0x80:
        a += 1
    b = end - start
    while b < len(raw) and raw[b] & 0xC0 == 0x80:
        b += 1
    return raw[a:b], start + a


_RANGES = "item string, range_no int, chars bigint, cuts array<bigint>, ranks array<tinyint>, edges array<int>, byte_at bigint, n_bytes bigint"


def _file_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            with _open(r["path"]) as f:
                raw, at = _read_aligned(f, r["byte_start"], r["byte_end"], r["n_bytes"])
            text = raw.decode("utf-8", "replace")
            cuts, ranks, edges = range_boundaries(text)
            row = (r["path"], r["range_no"], len(text), cuts, ranks, [int(x) for x in edges], at, len(raw))
            types = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int8()), pa.list_(pa.int32()), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=["item", "range_no", "chars", "cuts", "ranks", "edges", "byte_at", "n_bytes"])


_PLACES = "item string, range_no int, offset bigint, carry array<boolean>, goes_on boolean"


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over each file's ranges in order, without cuts: where a range begins and what it needs to know of its neighbours."""
    types = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.bool_()), pa.bool_()]
    names = ["item", "range_no", "offset", "carry", "goes_on"]
    held, item, at, carry = None, None, 0, Carry()
    for batch in batches:
        out = []
        for name, range_no, chars, e in zip(*(batch[c].to_pylist() for c in ("item", "range_no", "chars", "edges"))):
            edges = Edges(*e)
            if name != item:
                if held:
                    out.append((*held, False))
                held, item, at, carry = None, name, 0, Carry()
            elif held:
                out.append((*held, bool(edges.begins_line)))
            held = (name, range_no, at, [bool(x) for x in carry])
            at += chars
            if chars:
                carry = carry_on(carry, edges)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*held, False), types)], names=names)


_CHAIN = "item string, group_no int, seq int, piece_start bigint, piece_end bigint, first_range int, last_range int, exit bigint"


def _chain(limit: int, overlap: int):
    """Over each group's ranges in order (and the one after it): its pieces from where the group is entered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        names = ["item", "group_no", "seq", "piece_start", "piece_end", "first_range", "last_range", "exit"]
        for ranges in _grouped(batches):
            first = ranges[0]
            own = [r for r in ranges if r["range_no"] // GROUP == first["group_no"]]
            stop = own[-1]["offset"] + own[-1]["chars"]
            end = ranges[-1]["offset"] + ranges[-1]["chars"]
            # a file ends with the last range that is here, unless the one after the group goes on beyond the limit
            whole = first["n_chars"]

            def boundaries():
                for r in ranges:
                    cuts, ranks = in_context(r["cuts"], r["ranks"], Edges(*r["edges"]), Carry(*r["carry"]), r["goes_on"])
                    yield from zip([r["offset"] + c for c in cuts], ranks)

            out, k, start = [], 0, first["entry"]
            for seq, (a, b) in enumerate(choose_cuts(boundaries(), whole, limit, overlap, start)):
                if a >= stop:
                    start = a
                    break
                while k + 1 < len(ranges) and ranges[k + 1]["offset"] <= a:
                    k += 1
                last = k
                while last + 1 < len(ranges) and ranges[last + 1]["offset"] < b:
                    last += 1
                out.append((first["item"], first["group_no"], seq, a, b, ranges[k]["range_no"], ranges[last]["range_no"]))
                start = whole
            for at in range(0, max(len(out), 1), 20_000):
                rows = [(*r, start) for r in out[at : at + 20_000]] or [(first["item"], first["group_no"], -1, None, None, None, None, start)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each group: at most ``GROUP`` ranges and one more."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["item"], row["group_no"]) != (held[0]["item"], held[0]["group_no"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def split_files(spark: SparkSession, paths: list[str], limit: int = 2400, overlap: int = 300, range_bytes: int = RANGE_SIZE) -> DataFrame:
    """UTF-8 files that all executors see, as pieces: ``path, piece_no, start, end, text`` (code points).

    No task holds more than a range, or the cuts of ``GROUP`` ranges; only a range's place (no cuts, no text) is worked out
    file by file. A group's chain of pieces depends on where the one before ends: all groups are worked at once from a
    guess, and those whose beginning turns out otherwise again, until none changes. Chains of texts with boundaries soon
    meet, so this ends after two or three rounds; each round settles at least one more group. Empty files have no piece.
    """
    if not 0 <= overlap < limit // 2 or range_bytes < 4 * limit:
        raise ValueError("overlap must be less than half the limit, and a range at least four times the limit in bytes")
    plan = [(p, k, a, min(a + range_bytes, n), n) for p in paths for n in [_size(spark, p)] for k, a in enumerate(range(0, n, range_bytes))]
    todo = spark.createDataFrame(plan, "path string, range_no int, byte_start bigint, byte_end bigint, n_bytes bigint").repartition(max(1, min(len(plan), 10_000)))
    ranges = write_table(todo.mapInArrow(_file_ranges, _RANGES), "ranges")
    places = write_table(ranges.select("item", "range_no", "chars", "edges").repartition(F.col("item")).sortWithinPartitions("item", "range_no").mapInArrow(_place, _PLACES), "places")
    lengths = ranges.groupBy("item").agg(F.sum("chars").alias("n_chars"))
    placed = ranges.join(places, ["item", "range_no"]).join(lengths, "item")
    # a group's last piece reaches into the range after it, or two where that is the file's short last one
    group = F.expr(f"range_no div {GROUP}").cast("int")
    groups = placed.withColumn("group_no", F.explode(F.when((F.col("range_no") % GROUP < 2) & (F.col("range_no") >= GROUP), F.array(group, group - 1)).otherwise(F.array(group))))
    groups = write_table(groups, "groups")
    entries = groups.where(F.col("range_no") == F.col("group_no") * GROUP).select("item", "group_no", F.col("offset").alias("entry"))
    pieces = used_before = None
    while True:
        ordered = groups.join(entries, ["item", "group_no"]).repartition("item", "group_no").sortWithinPartitions("item", "group_no", "range_no")
        now = write_table(ordered.mapInArrow(_chain(limit, overlap), _CHAIN), "chains")
        pieces = now if pieces is None else write_table(pieces.join(entries.select("item", "group_no"), ["item", "group_no"], "left_anti").unionByName(now), "chains")
        used = entries if used_before is None else used_before.join(entries, ["item", "group_no"], "left_anti").unionByName(entries)
        used_before = write_table(used, "entries")
        exits = pieces.select("item", (F.col("group_no") + 1).alias("group_no"), F.col("exit").alias("entry")).distinct()
        entries = write_table(exits.join(used_before.withColumnRenamed("entry", "was"), ["item", "group_no"]).where("entry <> was").select("item", "group_no", "entry"), "entries")
        if entries.isEmpty():
            break
    pieces = pieces.where("seq >= 0")
    before = pieces.groupBy("item", "group_no").agg(F.count("*").alias("n"))
    base = before.select("item", "group_no", (F.sum("n").over(Window.partitionBy("item").orderBy("group_no")) - F.col("n")).alias("base"))
    numbered = pieces.join(base, ["item", "group_no"]).select("item", (F.col("base") + F.col("seq")).alias("piece_no"), "piece_start", "piece_end", F.explode(F.sequence("first_range", "last_range")).alias("range_no"))
    where = placed.select("item", "range_no", "offset", "chars", "byte_at", F.col("n_bytes").alias("size"))
    touched = numbered.join(where, ["item", "range_no"])
    parts = touched.repartition("item", "range_no").sortWithinPartitions("item", "range_no").mapInArrow(_file_parts, "item string, piece_no bigint, piece_start bigint, piece_end bigint, range_no int, part string")
    return (
        parts.groupBy("item", "piece_no", "piece_start", "piece_end")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range_no", "part"))), lambda x: x["part"]), "").alias("text"))
        .select(F.col("item").alias("path"), "piece_no", F.col("piece_start").alias("start"), F.col("piece_end").alias("end"), "text")
    )


def _file_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, text = None, ""
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if key != (r["item"], r["range_no"]):
                key = (r["item"], r["range_no"])
                with _open(r["item"]) as f:
                    f.seek(r["byte_at"])
                    text = f.read(r["size"]).decode("utf-8", "replace")
            a, b = max(0, r["piece_start"] - r["offset"]), min(r["piece_end"] - r["offset"], r["chars"])
            out.append((r["item"], r["piece_no"], r["piece_start"], r["piece_end"], r["range_no"], text[a:b]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["item", "piece_no", "piece_start", "piece_end", "range_no", "part"])


def split_table_as_files(df: DataFrame, text_col: str = "text", limit: int = 2400, overlap: int = 300, range_bytes: int = RANGE_SIZE, files: int = 4, order_col: str = "doc_id") -> DataFrame:
    """The texts of a table, written as ``files`` large files (a text a paragraph, in order), split as files: ``file, piece_no, start, end, text``."""
    spark = df.sparkSession
    folder = f"{scratch_dir(spark)}/files-{uuid.uuid4().hex}"
    rows = df.where(F.col(text_col).isNotNull()).select(order_col, F.concat(text_col, F.lit("\n")).alias("value"))
    rows.repartition(files, F.col(order_col)).sortWithinPartitions(order_col).select("value").write.text(folder)
    system = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    names = sorted(str(s.getPath().toString()) for s in system.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(system) if s.getPath().getName().startswith("part-"))
    pieces = split_files(spark, names, limit, overlap, range_bytes)
    return pieces.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("file"), "piece_no", "start", "end", "text")


def oversized(df: DataFrame, limit: int = 2400, overlap: int = 300, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Ids of the items that ``plan_cuts`` has to cut: ``id``, one row each. Null and fitting texts have none."""
    items = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("n_chars", F.length("text")).where(F.col("n_chars") > limit)
    items = items.withColumn("item", F.concat_ws("\u0001", F.coalesce("id", F.lit("\u0002")), F.sha2("text", 256)))
    cut = plan_cuts(items, limit, overlap).where(F.col("piece_no") == 1).select("item")
    return cut.select(F.regexp_extract("item", "^([^\u0001]*)\u0001", 1).alias("id")).select(F.when(F.col("id") != "\u0002", F.col("id")).alias("id")).distinct()
