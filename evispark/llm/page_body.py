"""Problem 3: the main body of web pages, apart from menus, notices, sidebars and footers.

Every non-blank line is a node. A classifier fitted to the pages themselves (:mod:`evispark.llm.line_model`) gives its
terminal capacities: the log-odds that it is furniture. Smoothness edges join neighbouring lines, by how much more often
neighbours of their kind (entries of one list, a list and its heading, lines alike in shape) agree than others do; text
has no DOM, so nearness in it is taken from blank lines, list marks and shape. The minimum cut separates furniture from
body, exactly, page by page.

Three passes: templates of lines, counted over the pages of each site and of all; a bounded sample of pages for the fit;
the cut of every page. Only hashes and counts are shuffled beside the texts themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm import mincut
from evispark.llm.assemble import documents, sorted_windows
from evispark.llm.line_model import Features, Model, Page, Reader, SamplePage, Scorer, arrange, capacities, fit, outside_prose, read, sample_page
from evispark.session import write_table

#: The bounded sample of the fit: so many pages, by the hash of their id, of those with at most so many characters.
SAMPLE_PAGES, SAMPLE_CHARS = 2000, 50_000
#: Parts into which the rows of one template and site are split where they are joined: a page has one at most among its own,
#: so the largest site's rows of one template are few of all, and a few parts even them out.
SALTS = 4
#: What a document says of a template: that it has it within its prose, before or after it, as its title.
WITHIN, OUTSIDE, TITLE = 1, 2, 4
_ALL_PAGES = 0  # stands for every page of a site


def _is_page(meta: dict) -> bool:
    return meta["media_type"] == "text/html"


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


# --- templates -------------------------------------------------------------------------------------------------------

_TEMPLATES_SCHEMA = "site string, document_id string, cluster bigint, templates array<bigint>, flags array<tinyint>"


def _templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By page every template that it asks about, with what the page says of it."""
    reader = Reader(wants_residue=False)
    types = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int8())]
    names = ["site", "document_id", "cluster", "templates", "flags"]
    cols: list[list] = [[] for _ in range(5)]
    for doc, meta, text in documents(batches, _is_page):
        _, lines = read(text, reader)
        flags = {_ALL_PAGES: WITHIN}
        for x, outside in zip(lines, outside_prose(lines, meta["title"])):
            flags[x.template] = flags.get(x.template, 0) | (OUTSIDE if outside else WITHIN)
            if x.core:
                flags.setdefault(x.core, 0)
            if x.begin and x.open:  # asked of lines that name or count something only
                flags.setdefault(x.begin, 0)
        if meta["title"]:
            x = reader.line(meta["title"])
            for of_title in (x.template, x.begin):
                if of_title:
                    flags[of_title] = flags.get(of_title, 0) | TITLE
        for c, v in zip(cols, (meta["municipality_id"] or "", doc, _signed(xxhash.xxh3_64_intdigest(text)), list(flags), list(flags.values()))):
            c.append(v)
        if len(cols[0]) >= 512:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
            cols = [[] for _ in range(5)]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def template_facts(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """``document_id, fact``: by page its templates, each followed by pages of the site, pages of all, of those outside prose, titles.

    Copies of a page count once. Templates of a single page and no title are left out: that is what no fact means. Rows of
    one site and template are counted in parts, and joined in ``SALTS`` parts by document.
    """
    said = write_table(sorted_windows(chunks, sources).mapInArrow(_templates, _TEMPLATES_SCHEMA), "templates")
    rows = said.select("site", "document_id", "cluster", F.explode(F.arrays_zip("templates", "flags")).alias("said")).select("site", "document_id", "cluster", F.col("said.templates").alias("template"), F.col("said.flags").alias("flags"))
    by_page = rows.groupBy("site", "template", "cluster").agg(F.bit_or("flags").alias("flags"))

    def has(flag: int):
        return F.col("flags").bitwiseAND(flag) != 0

    by_site = by_page.groupBy("site", "template").agg(
        F.count_if(has(WITHIN | OUTSIDE)).alias("n"), F.count_if(has(OUTSIDE)).alias("n_outside"), F.count_if(has(TITLE)).alias("n_titles")
    )
    everywhere = by_site.groupBy("template").agg(F.sum("n").alias("pages"), F.sum("n_outside").alias("outside"), F.sum("n_titles").alias("titles"))
    known = everywhere.where("pages > 1 or titles > 1")
    stats = by_site.select("site", "template", "n").join(known, "template").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = rows.select("site", "template", "document_id", F.expr(f"cast(pmod(xxhash64(document_id), {SALTS}) as int)").alias("salt"))
    fact = F.array(*(F.col(c).cast("bigint") for c in ("template", "n", "pages", "outside", "titles")))
    return asked.join(stats, ["site", "template", "salt"]).groupBy("document_id").agg(F.flatten(F.collect_list(fact)).alias("fact"))


def _page(meta: dict, text: str, reader: Reader) -> Page:
    known = {t: (max(n, 1), max(pages, 1), outside, titles) for f in meta["facts"] for t, n, pages, outside, titles in zip(*[iter(f)] * 5)}
    pages = known.pop(_ALL_PAGES, (1, 1, 0, 0))[0]
    return arrange(text, meta["title"], known, pages, reader)


# --- the fit ---------------------------------------------------------------------------------------------------------

_SAMPLE_SCHEMA = "ids array<array<int>>, n_words array<int>, labels array<int>, kinds array<int>"


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = Reader()
    features = Features(reader)
    types = [pa.list_(pa.list_(pa.int32())), *[pa.list_(pa.int32())] * 3]
    for _, meta, text in documents(batches, _is_page):
        if len(text) <= SAMPLE_CHARS:
            p = sample_page(_page(meta, text, reader), features)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((p.ids, p.n_words, p.labels, p.kinds), types)], names=["ids", "n_words", "labels", "kinds"])


def fit_model(chunks: DataFrame, sources: DataFrame, facts: DataFrame) -> Model:
    """The classifier and the edges, fitted on the driver to at most ``SAMPLE_PAGES`` pages of ``SAMPLE_CHARS`` characters."""
    pages = sources.where(F.col("media_type") == "text/html").select(F.col("id").alias("document_id")).where("document_id is not null").distinct()
    chosen = F.broadcast(write_table(pages.orderBy(F.xxhash64("document_id"), "document_id").limit(SAMPLE_PAGES), "sample"))
    some = chunks.join(chosen, "document_id", "left_semi")
    about = sources.join(chosen.withColumnRenamed("document_id", "id"), "id", "left_semi")
    rows = sorted_windows(some, about, facts=facts.join(chosen, "document_id", "left_semi")).mapInArrow(_sample, _SAMPLE_SCHEMA)
    return fit([SamplePage(*r) for r in rows.collect()])


# --- the cut ---------------------------------------------------------------------------------------------------------

_LABELS_SCHEMA = "document_id string, line_no array<int>, capacity array<double>, furniture array<boolean>"


def cut_page(page: Page, scorer: Scorer) -> tuple[list[float], list[bool]]:
    """Terminal capacities and labels of a page's lines."""
    unary, edges = capacities(page, scorer)
    return unary, mincut.label(unary, edges)


def _label(model: Model, furniture_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        scorer = Scorer(model, reader)
        types = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.bool_())]
        names = ["document_id", "line_no", "capacity", "furniture"]
        cols: list[list] = [[] for _ in range(4)]
        for doc, meta, text in documents(batches, _is_page):
            page = _page(meta, text, reader)
            capacity, furniture = cut_page(page, scorer)
            values = ([n for n, f in zip(page.numbers, furniture) if f], None, None) if furniture_only else (page.numbers, capacity, furniture)
            for c, v in zip(cols, (doc, *values)):
                c.append(v)
            if len(cols[0]) >= 512:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
                cols = [[] for _ in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return run


def _judged(chunks: DataFrame, sources: DataFrame) -> tuple[DataFrame, Model]:
    facts = write_table(template_facts(chunks, sources), "facts")
    return sorted_windows(chunks, sources, facts=facts), fit_model(chunks, sources, facts)


def label_lines(chunks: DataFrame, sources: DataFrame, furniture_only: bool = False) -> DataFrame:
    """Non-blank lines of web pages: ``document_id, line_no, capacity, furniture``; of furniture only the first two, if so wished.

    A page is labelled from its whole text. Documents of another media type, or without metadata, are no web pages and have
    no rows, nor have null and empty texts. Pages without a municipality count as one site. Repeated rows change nothing;
    extra columns are not read. A collection in which nothing repeats labels no line as furniture.
    """
    windows, model = _judged(chunks, sources)
    labels = windows.mapInArrow(_label(model, furniture_only), _LABELS_SCHEMA)
    if furniture_only:
        return labels.select("document_id", F.explode("line_no").alias("line_no"))
    one = F.explode(F.arrays_zip("line_no", "capacity", "furniture")).alias("line")
    return labels.select("document_id", one).select("document_id", "line.line_no", "line.capacity", "line.furniture")


def _bodies(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        scorer = Scorer(model, reader)
        for doc, meta, text in documents(batches):
            gone: set[int] = set()
            if _is_page(meta):
                page = _page(meta, text, reader)
                gone = {n for n, furniture in zip(page.numbers, cut_page(page, scorer)[1]) if furniture}
            body = "\n".join(line for n, line in enumerate(text.split("\n"), 1) if n not in gone) if gone else text
            yield pa.RecordBatch.from_arrays([pa.array([doc]), pa.array([body]), pa.array([len(gone)], pa.int32())], names=["document_id", "text", "n_removed"])

    return run


def page_bodies(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Every document's body lines: ``document_id, text, n_removed``; documents that are no web pages keep all lines."""
    windows, model = _judged(chunks, sources)
    return windows.mapInArrow(_bodies(model), "document_id string, text string, n_removed int")
