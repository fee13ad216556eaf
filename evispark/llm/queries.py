"""Queries of the text operators: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.llm import lookalike, mix, mojibake, pack, page_body, residue, site_lines, spans, split, tokens

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# 1: lines repeated across one site's documents


def _repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.repeated_lines(_table(spark, sf_dir, "chunks"), _table(spark, sf_dir, "sources"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies collapse and clusters and days are counted here too; the number of documents decides."""
    return _repeated_lines(spark, sf_dir).select("municipality_id", "line")


def p1_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repeated_lines(spark, sf_dir).select("municipality_id", "line", "n_documents", "n_clusters", "n_days")


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without any line of :func:`p1_found`."""
    return site_lines.without_repeated_lines(_table(spark, sf_dir, "chunks"), _table(spark, sf_dir, "sources"), least_clusters=1, least_days=0)


def p1_clean_by_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the lines of different texts and days only: copies keep theirs."""
    return site_lines.without_repeated_lines(_table(spark, sf_dir, "chunks"), _table(spark, sf_dir, "sources"))


# 2: template residue and error pages


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(_table(spark, sf_dir, "chunks")).select(F.col("id").alias("chunk_id")).distinct()


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.without_residue(_table(spark, sf_dir, "chunks"))


def p2_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By document the share of its text that is residue, and whether it is left out for it."""
    return residue.document_residue(_table(spark, sf_dir, "chunks"), _table(spark, sf_dir, "sources"))


# 3: page boilerplate


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_body.label_lines(_table(spark, sf_dir, "chunks"), _table(spark, sf_dir, "sources"), furniture_only=True).select("document_id", "line_no")


def p3_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_body.page_bodies(_table(spark, sf_dir, "chunks"), _table(spark, sf_dir, "sources"))


# 4: visually identical text


def _bigrams(units: DataFrame) -> dict[str, float]:
    texts = units.select(F.col("quote").alias("t")).unionAll(units.select(F.explode(F.transform("locations", lambda x: x["matched_text"]))))
    return lookalike.count_bigrams(texts, "t")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _table(spark, sf_dir, "units")
    return lookalike.find_lookalikes(units, _bigrams(units)).distinct()


def p4_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _table(spark, sf_dir, "units")
    return lookalike.normalize_locations(units, _bigrams(units))


# 5: wrong character encoding


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = mojibake.repair_text(_table(spark, sf_dir, "chunks"), "id", "text", "chunk")
    titles = mojibake.repair_text(_table(spark, sf_dir, "audit"), "event_no", "title", "audit")
    return chunks.unionByName(titles).dropDuplicates(["record_kind", "record_id", "text"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = mojibake.find_damaged(_table(spark, sf_dir, "chunks"), "id", "text", "chunk")
    titles = mojibake.find_damaged(_table(spark, sf_dir, "audit"), "event_no", "title", "audit")
    return chunks.unionByName(titles).distinct()


# 6: oversized items


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.oversized(_table(spark, sf_dir, "chunks")).select(F.col("id").alias("chunk_id"))


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_items(_table(spark, sf_dir, "chunks"))


def p6_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as a few large files, split as files by byte ranges."""
    return split.split_table_as_files(_table(spark, sf_dir, "documents"))


# 7: containers of fixed capacity


def _capacities(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    return {r["name"]: r["capacity_tokens"] for r in _table(spark, sf_dir, "pack_sizes").collect()}


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tokens.token_counts(_table(spark, sf_dir, "documents"), ["doc_id"])
    return pack.pack_all(sizes, _capacities(spark, sf_dir))


def p7_use_of_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.use_of_space(p7_packed(spark, sf_dir), _capacities(spark, sf_dir))


# 8: mixing sources


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes = tokens.token_counts(_table(spark, sf_dir, "documents"), ["doc_id", "source"])
    return mix.mix(sizes, _table(spark, sf_dir, "mix_targets"))


def p8_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


# 9: long exact spans


#: Batches in which the documents come into the index: the second meets the run of the first, then both are compacted.
_BATCHES = 2


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(_table(spark, sf_dir, "documents"), batches=_BATCHES).pairs()


def p9_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(_table(spark, sf_dir, "documents"), batches=_BATCHES).shared()


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    windows = """WITH c AS (SELECT DISTINCT document_id, "start" AS s, text FROM chunks WHERE text IS NOT NULL),
w AS (SELECT *, coalesce(max(s + length(text)) OVER (PARTITION BY document_id ORDER BY s, length(text) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM c),
d AS (SELECT document_id, string_agg(substring(text, greatest(done - s, 0) + 1), '' ORDER BY s, length(text)) AS text FROM w GROUP BY document_id),
l AS (SELECT document_id, unnest(string_split(text, chr(10))) AS line FROM d),
n AS (SELECT DISTINCT document_id, trim(regexp_replace(line, '[ \t]+', ' ', 'g'), ' ') AS line FROM l),
m AS (SELECT DISTINCT id, municipality_id FROM sources WHERE municipality_id IS NOT NULL)
"""
    lines = windows + """, o AS (SELECT document_id, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM d),
k AS (SELECT *, trim(regexp_replace(raw, '[ \t]+', ' ', 'g'), ' ') AS line FROM o),
s AS (SELECT id, min(municipality_id) AS municipality_id, min(substr(retrieved_at, 1, 10)) AS day FROM sources WHERE id IS NOT NULL GROUP BY id),
r AS (SELECT municipality_id, line, count(DISTINCT k.document_id) AS n_documents, count(DISTINCT text) AS n_clusters, count(DISTINCT day) AS n_days FROM k JOIN s ON s.id = k.document_id
WHERE municipality_id IS NOT NULL AND length(line) >= 40 GROUP BY ALL HAVING count(DISTINCT k.document_id) >= 5)
"""
    clean = """SELECT k.document_id, coalesce(string_agg(raw, chr(10) ORDER BY no) FILTER (WHERE r.line IS NULL), '') AS text, CAST(count(*) AS INT) AS n_lines, CAST(count(r.line) AS INT) AS n_removed
FROM k LEFT JOIN s ON s.id = k.document_id LEFT JOIN r ON r.municipality_id = s.municipality_id AND r.line = k.line GROUP BY k.document_id"""
    spans_of = """WITH t AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 200),
w AS (SELECT doc_id, i AS p, hash(substring(text, CAST(i + 1 AS INT), 200)) AS h FROM (SELECT doc_id, text, unnest(range(length(text) - 199)) AS i FROM t)),
g AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
x AS (SELECT w.* FROM w JOIN g USING (h))
"""
    return {
        "p1_found": windows + "SELECT municipality_id, line FROM n JOIN m ON m.id = n.document_id WHERE length(line) >= 40 GROUP BY ALL HAVING count(DISTINCT document_id) >= 5",
        "p1_clean": lines + clean,
        "p6_found": "SELECT DISTINCT id AS chunk_id FROM chunks WHERE length(text) > 2400",
        # a cut lies after a blank, a line feed or a form feed; its rank is told by what stands before it
        "p6_pieces": """WITH RECURSIVE i AS (SELECT DISTINCT id, coalesce(CAST("start" AS BIGINT), 0) AS base, text, length(text) AS n FROM chunks),
big AS (SELECT row_number() OVER () AS item, * FROM i WHERE n > 2400),
place AS (SELECT item, unnest(range(1, n + 1)) AS p, text FROM big),
cut AS (SELECT item, p, CASE substring(text, CAST(p AS INT), 1)
WHEN chr(12) THEN CASE WHEN substring(text, CAST(p + 1 AS INT), 1) <> chr(10) THEN 4 END
WHEN chr(10) THEN CASE WHEN regexp_matches(left(text, CAST(p AS INT)), '(\\n[ \\t]*|\\f)\\n$') THEN 4 ELSE 3 END
ELSE CASE WHEN regexp_matches(left(text, CAST(p AS INT)), '[.!?…][''"”’»)\\]]*[ \\t]$') THEN 2 ELSE 1 END END AS rank
FROM place WHERE substring(text, CAST(p AS INT), 1) IN (' ', chr(9), chr(10), chr(12))),
piece AS (SELECT item, 0 AS piece_no, CAST(0 AS BIGINT) AS a, (SELECT coalesce(max_by(p, rank * 1000000 + p), 2400) FROM cut WHERE cut.item = big.item AND rank IS NOT NULL AND p > 1200 AND p <= 2400) AS b FROM big
UNION ALL SELECT q.item, q.piece_no + 1, q.b - 300, CASE WHEN big.n - (q.b - 300) <= 2400 THEN big.n
ELSE (SELECT coalesce(max_by(p, rank * 1000000 + p), q.b + 2100) FROM cut WHERE cut.item = q.item AND rank IS NOT NULL AND p > q.b + 900 AND p <= q.b + 2100) END FROM piece q JOIN big ON big.item = q.item WHERE q.b < big.n),
counted AS (SELECT *, count(*) OVER (PARTITION BY item) AS n_pieces FROM piece)
SELECT id, 0 AS piece_no, 1 AS n_pieces, base AS "start", base + coalesce(n, 0) AS "end", text FROM i WHERE coalesce(n, 0) <= 2400
UNION ALL SELECT id, piece_no, CAST(n_pieces AS INT), base + a, base + b, substring(text, CAST(a + 1 AS INT), CAST(b - a AS INT)) FROM counted JOIN big USING (item)""",
        "p9_found": spans_of + "SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM (SELECT DISTINCT doc_id, h FROM x) a JOIN (SELECT DISTINCT doc_id, h FROM x) b USING (h) WHERE a.doc_id < b.doc_id",
        # every shared window adds the characters that the one before doesn't cover
        "p9_shared": spans_of
        + """, c AS (SELECT doc_id, sum(least(200, p - q)) AS n FROM (SELECT doc_id, p, coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -200) AS q FROM x) GROUP BY doc_id)
SELECT t.doc_id, min(t.doc_id) OVER (PARTITION BY t.text) AS class_id, CAST(length(t.text) AS INT) AS n_chars, CAST(coalesce(n, 0) AS INT) AS shared_chars, round(coalesce(n, 0) / length(t.text), 6) AS share FROM t LEFT JOIN c USING (doc_id)""",
    }
