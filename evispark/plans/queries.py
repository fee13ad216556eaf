"""Queries over the driver's tables, one or more per operator, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evispark.functions import dates, text, urls
from evispark.operators import caches, checks, chunking, discovery, lexicon, notices, pages, quotes, rollup, views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Words that make an address worth fetching first.
KEYWORDS = ["upphandling", "sprakkrav", "protokoll", "omsorg", "hemtjanst", "care", "moten"]
CONCLUSIVE = ["Yes", "Pilot", "No", "Later"]
TEMPLATES = ["{name} språkkrav äldreomsorg", "site:{domain} upphandling", "{id} protokoll", "{name} riktlinjer"]


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- text ------------------------------------------------------------------------------------------------------------

_WS = r"[\t\x{0b}\f\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query(f"""
WITH a AS (SELECT DISTINCT id AS chunk_id, replace(replace(replace(replace(nfc_normalize(text), chr(173), ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(0), '') AS t FROM chunks WHERE text IS NOT NULL),
b AS (SELECT chunk_id, array_to_string(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '{_WS}+', ' ', 'g'), ' ')), chr(10)) AS t FROM a)
SELECT chunk_id, sha256(regexp_replace(regexp_replace(t, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g')) AS text_sha256 FROM b""")
def text_clean_hash(spark, sf_dir):
    c = _t(spark, sf_dir, "chunks").where("text is not null").select("id", "text").distinct()
    return c.select(F.col("id").alias("chunk_id"), F.sha2(text.clean_text("text"), 256).alias("text_sha256"))


@query("SELECT DISTINCT id, substring(sha256(municipality_id || chr(10) || url || chr(10) || raw_sha256), 1, 24) AS document_id FROM sources")
def document_ids(spark, sf_dir):
    return _t(spark, sf_dir, "sources").select("id", text.document_id(F.col("municipality_id"), F.col("url"), F.col("raw_sha256")).alias("document_id")).distinct()


@query("""SELECT DISTINCT document_id || ':' || "start" || ':' || "end" AS id, sha256(document_id || ':' || "start" || ':' || "end") AS file_name FROM chunks""")
def chunk_ids(spark, sf_dir):
    cid = text.chunk_id(F.col("document_id"), F.col("start"), F.col("end"))
    return _t(spark, sf_dir, "chunks").select(cid.alias("id"), F.sha2(cid, 256).alias("file_name")).distinct()


@query("""WITH c AS (SELECT DISTINCT id, text FROM chunks WHERE text IS NOT NULL), l AS (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM c)
SELECT id, CAST(n AS INT) AS line_no, lpad(CAST(n AS VARCHAR), 6, '0') || chr(9) || line AS numbered FROM l""")
def numbered_lines(spark, sf_dir):
    return chunking.numbered_lines(_t(spark, sf_dir, "chunks").where("text is not null").select("id", "text").distinct())


@query(r"""WITH c AS (SELECT DISTINCT id, regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g') AS t FROM chunks)
SELECT id, CASE WHEN length(t) > 32000 THEN substring(t, 1, 31900) || chr(10) || '[TRUNCATED; see JSON artifact]' ELSE t END AS cell FROM c""")
def cell_sanitize(spark, sf_dir):
    return _t(spark, sf_dir, "chunks").select("id", text.sanitize_cell(F.col("text")).alias("cell")).distinct()


@query("""SELECT DISTINCT event_no, sha256('{"key":' || coalesce('"' || key || '"', 'null') || ',"model":' || coalesce('"' || model || '"', 'null') || ',"role":' || coalesce('"' || role || '"', 'null') || '}') AS request_key FROM audit WHERE stage = 'llm'""")
def request_keys(spark, sf_dir):
    a = _t(spark, sf_dir, "audit").where("stage = 'llm'")
    return a.select("event_no", caches.request_key({"role": F.col("role"), "model": F.col("model"), "key": F.col("key")}).alias("request_key")).distinct()


# --- windows and pages -----------------------------------------------------------------------------------------------

_WINDOWS = """
WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text <> ''),
w AS (
  SELECT doc_id, text, n, 0 AS k, 0 AS s, {end0} AS e FROM (SELECT *, 0 AS st FROM d)
  UNION ALL
  SELECT doc_id, text, n, k + 1, st, {end0} FROM (SELECT doc_id, text, n, k, greatest(s + 1, e - 300) AS st FROM w WHERE e < n AND k + 1 < 100)
)"""
# the end of a window that starts at st: after the last line feed of its second half, if that lies beyond the overlap
_END = """CASE WHEN st + 2400 >= n THEN n
  WHEN strpos(reverse(substring(text, st + 1201, 1200)), chr(10)) > 0 AND st + 2400 - strpos(reverse(substring(text, st + 1201, 1200)), chr(10)) > st + 300
  THEN st + 2401 - strpos(reverse(substring(text, st + 1201, 1200)), chr(10)) ELSE st + 2400 END"""
_WINDOWS = _WINDOWS.replace("{end0}", _END)


def _chunked(spark, sf_dir):
    return chunking.chunk_documents(_t(spark, sf_dir, "documents"), 2400, 300, 100, id_col="doc_id")


@query(_WINDOWS + """ SELECT doc_id AS document_id, CAST(k AS INT) AS chunk_no, CAST(s AS INT) AS "start", CAST(e AS INT) AS "end", sha256(substring(text, s + 1, e - s)) AS text_sha256 FROM w""")
def chunk_windows(spark, sf_dir):
    return _chunked(spark, sf_dir).select("document_id", "chunk_no", "start", "end", F.sha2("text", 256).alias("text_sha256"))


@query(_WINDOWS + """ SELECT doc_id AS document_id, count(*) AS n_windows, max(e) < max(n) AS limited FROM w GROUP BY doc_id""")
def chunk_limit_flag(spark, sf_dir):
    return _chunked(spark, sf_dir).groupBy("document_id").agg(F.count("*").alias("n_windows"), F.bool_or("limited").alias("limited"))


@query("""WITH c AS (SELECT DISTINCT document_id, "start", "end" FROM chunks WHERE id IN (SELECT chunk_id FROM units)), n AS (SELECT *, lead("start") OVER (PARTITION BY document_id ORDER BY "start", "end") AS next_start FROM c)
SELECT document_id, "start", "end", next_start FROM n WHERE next_start <= "start" OR next_start > "end" """)
def chunk_overlap_check(spark, sf_dir):
    """Gaps between the windows that quotations cite; all windows of a document together leave none."""
    cited = _t(spark, sf_dir, "units").select(F.col("chunk_id").alias("id")).distinct()
    return chunking.window_gaps(_t(spark, sf_dir, "chunks").join(cited, "id", "left_semi"))


@query("""WITH p AS (SELECT DISTINCT id, unnest(pages, recursive := true) FROM sources WHERE media_type = 'application/pdf'), o AS (SELECT id, page, coalesce(sum("end" - "start" + 3) OVER (PARTITION BY id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, "end" - "start" AS n FROM p)
SELECT id, page, CAST(s AS BIGINT) AS "start", CAST(s + n AS BIGINT) AS "end" FROM o""")
def page_offsets(spark, sf_dir):
    p = _t(spark, sf_dir, "sources").where("media_type = 'application/pdf'").select("id", F.explode("pages").alias("p")).select("id", "p.page", F.repeat(F.lit("x"), F.col("p.end") - F.col("p.start")).alias("text")).distinct()
    out = chunking.page_offsets(p)
    return out.select("id", "page", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


# --- quotations ------------------------------------------------------------------------------------------------------


def _quoted(spark, sf_dir):
    u = _t(spark, sf_dir, "units").select("unit_id", "chunk_id", "document_id", "quote").distinct()
    c = _t(spark, sf_dir, "chunks").where("text is not null").select(F.col("id").alias("chunk_id"), "start", "text").dropDuplicates(["chunk_id"])
    return u.join(c, "chunk_id")


@query("""WITH u AS (SELECT DISTINCT unit_id, chunk_id, quote FROM units), c AS (SELECT id, min(text) AS text, min("start") AS s FROM chunks WHERE text IS NOT NULL GROUP BY id)
SELECT unit_id, (length(text) - length(replace(text, quote, ''))) // length(quote) AS n_exact, CAST(s + strpos(text, quote) - 1 AS INT) AS first_start
FROM u JOIN c ON c.id = u.chunk_id WHERE strpos(text, quote) > 0 AND trim(quote) <> '' AND length(quote) <= 2000""")
def quote_exact(spark, sf_dir):
    found = quotes.locate(_quoted(spark, sf_dir))
    exact = F.filter("places", lambda p: p["match"] == "exact")
    return found.where(F.size(exact) > 0).select("unit_id", F.size(exact).cast("bigint").alias("n_exact"), F.get(exact, F.lit(0))["start"].alias("first_start"))


@query()
def quote_locations(spark, sf_dir):
    found = quotes.locate(_quoted(spark, sf_dir)).select("unit_id", "document_id", F.posexplode("places").alias("occurrence", "p")).select("unit_id", "document_id", "occurrence", "p.match", "p.start", "p.end", "p.matched_text")
    documents = _t(spark, sf_dir, "sources").select("id", "pages").dropDuplicates(["id"])
    return quotes.with_pages(found, documents)


@query("""WITH l AS (SELECT DISTINCT unit_id, document_id, unnest(locations, recursive := true) FROM units), p AS (SELECT DISTINCT id, unnest(pages, recursive := true) FROM sources),
q AS (SELECT id, page AS pg, "start" AS ps, "end" AS pe FROM p)
SELECT DISTINCT l.unit_id, l."start", l."end", a.pg AS page_start, b.pg AS page_end, CASE WHEN a.pg IS NOT NULL THEN l."start" - a.ps END AS page_char_start, CASE WHEN b.pg IS NOT NULL THEN l."end" - b.ps END AS page_char_end
FROM l LEFT JOIN q a ON a.id = l.document_id AND a.ps <= l."start" AND l."start" < a.pe LEFT JOIN q b ON b.id = l.document_id AND b.ps < l."end" AND l."end" <= b.pe""")
def quote_page_lookup(spark, sf_dir):
    places = _t(spark, sf_dir, "units").select("unit_id", "document_id", F.explode("locations").alias("p")).select("unit_id", "document_id", "p.start", "p.end").distinct()
    found = quotes.with_pages(places, _t(spark, sf_dir, "sources").select("id", "pages").dropDuplicates(["id"]))
    return found.select("unit_id", "start", "end", "page_start", "page_end", "page_char_start", "page_char_end").distinct()


@query("""WITH u AS (SELECT DISTINCT unit_id, chunk_id, quote FROM units), c AS (SELECT id, min(text) AS text FROM chunks WHERE text IS NOT NULL GROUP BY id), f AS (SELECT unit_id, text, strpos(text, quote) - 1 AS p, length(quote) AS n FROM u JOIN c ON c.id = u.chunk_id WHERE strpos(text, quote) > 0)
SELECT unit_id, CAST(length(substring(text, 1, p)) - length(replace(substring(text, 1, p), chr(10), '')) + 1 AS INT) AS line_start, CAST(length(substring(text, 1, p + n - 1)) - length(replace(substring(text, 1, p + n - 1), chr(10), '')) + 1 AS INT) AS line_end FROM f""")
def quote_line_numbers(spark, sf_dir):
    q = _quoted(spark, sf_dir).withColumn("p", F.instr("text", F.col("quote")) - 1).where("p >= 0")
    t = F.col("text")
    return q.select("unit_id", quotes.line_of(t, F.col("p")).alias("line_start"), quotes.line_of(t, F.col("p") + F.length("quote") - 1).alias("line_end"))


# --- dates -----------------------------------------------------------------------------------------------------------

_PARTIAL = """(SELECT doc_id, unnest([strftime(published_at, '%Y'), strftime(published_at, '%Y-%m'), strftime(published_at, '%Y-%m-%d'), strftime(published_at, '%Y-13'), strftime(published_at, '%Y-02-30'), 'ca ' || strftime(published_at, '%Y')]) AS value FROM documents)"""


@query(f"""SELECT doc_id, value, CASE WHEN regexp_full_match(value, '\\d{{4}}') THEN make_date(CAST(value AS INT), 12, 31) WHEN regexp_full_match(value, '\\d{{4}}-\\d{{2}}') THEN CAST(last_day(TRY_CAST(value || '-01' AS DATE)) AS DATE)
WHEN regexp_full_match(value, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN TRY_CAST(value AS DATE) END AS latest_day FROM {_PARTIAL}""")
def partial_dates(spark, sf_dir):
    ts = F.col("published_at")
    forms = [F.date_format(ts, "yyyy"), F.date_format(ts, "yyyy-MM"), F.date_format(ts, "yyyy-MM-dd"), F.concat(F.date_format(ts, "yyyy"), F.lit("-13")), F.concat(F.date_format(ts, "yyyy"), F.lit("-02-30")), F.concat(F.lit("ca "), F.date_format(ts, "yyyy"))]
    d = _t(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*forms)).alias("value"))
    return d.select("doc_id", "value", dates.latest_day(F.col("value")).alias("latest_day"))


# --- addresses -------------------------------------------------------------------------------------------------------

_NORMAL = r"""regexp_replace(regexp_replace(lower(regexp_extract({u}, '^https?://[^/?#]+')), ':(80|443)$', '') || CASE WHEN regexp_extract({u}, '^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({u}, '^https?://[^/?#]+([^?#]*)', 1) END || regexp_extract({u}, '^[^?#]*(\?[^#]+)', 1), '\.(/)', '.\1')"""


@query(f"SELECT DISTINCT requested_url, {_NORMAL.format(u='requested_url')} AS normalized_url FROM sources")
def url_normalize(spark, sf_dir):
    return _t(spark, sf_dir, "sources").select("requested_url", urls.normalize_url(F.col("requested_url")).alias("normalized_url")).distinct()


@query("""WITH s AS (SELECT DISTINCT id, municipality_id, url, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS h FROM sources)
SELECT s.id, s.h AS host, len(list_filter(e.domains, lambda d: s.h = d OR s.h LIKE '%.' || d)) > 0 AS allowed FROM s JOIN entity e ON e.id = s.municipality_id""")
def url_allowlist(spark, sf_dir):
    e = _t(spark, sf_dir, "entity").select(F.col("id").alias("municipality_id"), "domains")
    s = _t(spark, sf_dir, "sources").select("id", "municipality_id", "url").distinct().join(e, "municipality_id")
    return s.select("id", urls.host(F.col("url")).alias("host"), urls.domain_allowed(F.col("url"), F.col("domains")).alias("allowed"))


@query(f"""WITH s AS (SELECT DISTINCT id, municipality_id, retrieved_at, {_NORMAL.format(u='url')} AS normalized_url FROM sources)
SELECT municipality_id, normalized_url, id FROM s QUALIFY row_number() OVER (PARTITION BY municipality_id, normalized_url ORDER BY retrieved_at, id) = 1""")
def url_first_seen(spark, sf_dir):
    s = _t(spark, sf_dir, "sources").select("id", "municipality_id", "retrieved_at", urls.normalize_url(F.col("url")).alias("normalized_url")).distinct()
    return discovery.first_seen(s, ["municipality_id", "normalized_url"], [F.col("retrieved_at"), F.col("id")]).select("municipality_id", "normalized_url", "id")


@query("""WITH d AS (SELECT DISTINCT ON (event_no) event_no, municipality_id, url FROM audit WHERE stage = 'discovery' AND outcome = 'candidate'), x AS (SELECT d.*, regexp_replace(url, '#.*$', '') AS u, e.domains FROM d JOIN entity e ON e.id = d.municipality_id)
SELECT municipality_id, u AS normalized_url, min(event_no) AS event_no FROM x WHERE len(list_filter(domains, lambda q: lower(regexp_extract(u, '^https?://([^/?#:]+)', 1)) = q OR lower(regexp_extract(u, '^https?://([^/?#:]+)', 1)) LIKE '%.' || q)) > 0 GROUP BY ALL""")
def discovery_candidates(spark, sf_dir):
    a = _t(spark, sf_dir, "audit").where("stage = 'discovery' and outcome = 'candidate'").select("event_no", "municipality_id", "url").dropDuplicates(["event_no"])
    return discovery.candidates(a, _t(spark, sf_dir, "entity"), order=[F.col("event_no")]).select("municipality_id", "normalized_url", "event_no")


@query("SELECT DISTINCT event_no, " + " + ".join(f"CAST(contains(lower(url), '{k}') AS INT)" for k in KEYWORDS) + " AS keyword_score FROM audit WHERE stage = 'discovery'")
def keyword_score(spark, sf_dir):
    a = _t(spark, sf_dir, "audit").where("stage = 'discovery'")
    return a.select("event_no", urls.keyword_score([F.col("url")], KEYWORDS, percent_encoded=False).alias("keyword_score")).distinct()


_FOUND = """WITH d AS (SELECT DISTINCT ON (event_no) event_no, municipality_id, depth, coalesce(score, 0) + CASE method WHEN 'seed' THEN 1000 WHEN 'search' THEN 100 ELSE 0 END AS score FROM audit WHERE stage = 'discovery' AND outcome = 'candidate'),
r AS (SELECT *, row_number() OVER (PARTITION BY municipality_id ORDER BY score DESC, coalesce(depth, 0), event_no) AS rank, count(*) OVER (PARTITION BY municipality_id) AS n FROM d) """


def _frontier(spark, sf_dir):
    a = _t(spark, sf_dir, "audit").where("stage = 'discovery' and outcome = 'candidate'").dropDuplicates(["event_no"])
    return discovery.frontier(a.select("event_no", "municipality_id", "depth", discovery.boosted(F.col("score"), F.col("method")).alias("score")), 5)


@query(_FOUND + "SELECT municipality_id, event_no, score, CAST(rank AS INT) AS rank, n > 5 AS limited FROM r WHERE rank <= 5")
def frontier_topk(spark, sf_dir):
    return _frontier(spark, sf_dir).select("municipality_id", "event_no", "score", "rank", "limited")


@query(_FOUND + "SELECT DISTINCT municipality_id, n > 5 AS document_limit FROM r")
def frontier_limit_flag(spark, sf_dir):
    return _frontier(spark, sf_dir).select("municipality_id", F.col("limited").alias("document_limit")).distinct()


@query("SELECT id, CAST(k AS INT) AS query_no, replace(replace(replace(t, '{name}', name), '{id}', id), '{domain}', coalesce(domains[1], '')) AS query FROM entity, (VALUES " + ", ".join(f"({k}, '{t}')" for k, t in enumerate(TEMPLATES[:3])) + ") v(k, t)")
def search_queries(spark, sf_dir):
    return discovery.fill_templates(_t(spark, sf_dir, "entity"), TEMPLATES, 3)


@query("""WITH f AS (SELECT DISTINCT url, final_url FROM audit WHERE stage = 'fetch' AND url <> final_url), e AS (SELECT url, min(final_url) AS target FROM f GROUP BY url)
SELECT s.url, coalesce(e3.target, e2.target, e1.target, s.url) AS final_url, CAST((e1.target IS NOT NULL)::INT + (e2.target IS NOT NULL)::INT + (e3.target IS NOT NULL)::INT AS INT) AS hops
FROM (SELECT DISTINCT url FROM audit WHERE stage = 'fetch' AND url IS NOT NULL) s LEFT JOIN e e1 ON e1.url = s.url LEFT JOIN e e2 ON e2.url = e1.target LEFT JOIN e e3 ON e3.url = e2.target""")
def redirect_chain(spark, sf_dir):
    f = _t(spark, sf_dir, "audit").where("stage = 'fetch' and url is not null")
    return discovery.follow_redirects(f.select("url", F.col("final_url").alias("target")).where("target is not null"), f.select("url"), 3).select("url", "final_url", "hops")


# --- documents -------------------------------------------------------------------------------------------------------


@query(r"""SELECT DISTINCT id, coalesce(regexp_matches(title, '(?i)^(404|page not found|sidan (saknas|finns inte|kunde inte hittas))($|[^\p{L}\p{N}_])'), false) OR lower(rtrim(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/')) = '/404' AS error_page FROM sources""")
def soft_404(spark, sf_dir):
    s = _t(spark, sf_dir, "sources")
    by_title = F.coalesce(F.col("title").rlike(r"(?iU)^(?:404|page not found|sidan (?:saknas|finns inte|kunde inte hittas))\b"), F.lit(False))
    by_path = F.lower(F.regexp_replace(urls.path(F.col("url")), "/+$", "")) == "/404"
    return s.select("id", (by_title | by_path).alias("error_page")).distinct()


@query("""WITH c AS (SELECT document_id, bool_or("start" = 0) AS windowed FROM chunks WHERE text IS NOT NULL GROUP BY document_id), s AS (SELECT DISTINCT id, coalesce(list_contains(warnings, 'suspected_error_page_not_classified'), false) AS bad FROM sources)
SELECT s.id, s.bad AS error_page, c.document_id IS NOT NULL AS windowed FROM s LEFT JOIN c ON c.document_id = s.id""")
def error_page_windows(spark, sf_dir):
    s = _t(spark, sf_dir, "sources").select("id", F.coalesce(F.array_contains("warnings", "suspected_error_page_not_classified"), F.lit(False)).alias("error_page")).distinct()
    c = _t(spark, sf_dir, "chunks").where("text is not null").select(F.col("document_id").alias("id")).distinct().withColumn("w", F.lit(True))
    return s.join(c, "id", "left").select("id", "error_page", F.coalesce("w", F.lit(False)).alias("windowed"))


#: The query asks for pages below a length that some of the tables' pages have; the operator's own default is 30.
_SPARSE = 300


@query(f"""WITH p AS (SELECT DISTINCT id, unnest(pages, recursive := true) FROM sources WHERE media_type = 'application/pdf') SELECT id, page, 'page_' || page || '_sparse_or_scanned_needs_review' AS warning FROM p WHERE "end" - "start" < {_SPARSE}""")
def sparse_pages(spark, sf_dir):
    return pages.sparse_page_warnings(_t(spark, sf_dir, "sources").where("media_type = 'application/pdf'"), _SPARSE)


@query("""SELECT DISTINCT id, CASE WHEN media_type ILIKE '%pdf%' OR url ILIKE '%.pdf' THEN 'pdf' WHEN media_type ILIKE '%html%' THEN 'html' ELSE 'unsupported' END AS kind FROM sources""")
def media_dispatch(spark, sf_dir):
    m, u = F.lower(F.coalesce("media_type", F.lit(""))), F.lower("url")
    return _t(spark, sf_dir, "sources").select("id", F.when(F.contains(m, F.lit("pdf")) | F.endswith(u, F.lit(".pdf")), "pdf").when(F.contains(m, F.lit("html")), "html").otherwise("unsupported").alias("kind")).distinct()


# --- the log ---------------------------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT DISTINCT ON (event_no) * FROM audit WHERE stage = 'fetch') SELECT event_no, row_number() OVER (PARTITION BY municipality_id ORDER BY event_no) AS attempt, row_number() OVER (PARTITION BY municipality_id, final_url, sha256 ORDER BY event_no) > 1 AS repeat FROM f""")
def delivered_dedupe(spark, sf_dir):
    f = _t(spark, sf_dir, "audit").where("stage = 'fetch'").dropDuplicates(["event_no"])
    return caches.delivered_once(f, ["municipality_id", "final_url", "sha256"], "event_no").select("event_no", F.col("attempt").cast("bigint").alias("attempt"), "repeat")


@query("""WITH f AS (SELECT DISTINCT ON (event_no) event_no, final_url, status FROM audit WHERE stage = 'fetch'), a AS (SELECT *, row_number() OVER (PARTITION BY final_url ORDER BY event_no) - 1 AS attempt FROM f)
SELECT event_no, CAST(attempt AS INT) AS attempt, CAST(CASE event_no % 3 WHEN 0 THEN event_no % 50 WHEN 1 THEN 90 ELSE least(pow(2, attempt), 30) END AS DOUBLE) AS wait_s FROM a WHERE status IN ('429', '500', '502', '503', '504')""")
def retry_schedule(spark, sf_dir):
    f = _t(spark, sf_dir, "audit").where("stage = 'fetch'").dropDuplicates(["event_no"])
    attempt = F.row_number().over(Window.partitionBy("final_url").orderBy("event_no")) - 1
    tried = f.withColumn("attempt", attempt).where(F.col("status").isin("429", "500", "502", "503", "504"))
    # a third of the answers name seconds, a third a date 90 seconds ahead, the others nothing
    date = F.date_format(F.col("timestamp") + F.expr("interval 90 seconds"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    header = F.when(F.col("event_no") % 3 == 0, (F.col("event_no") % 50).cast("string")).when(F.col("event_no") % 3 == 1, date)
    now = F.date_trunc("second", "timestamp")
    return tried.select("event_no", "attempt", dates.retry_delay(header, F.col("attempt"), now).alias("wait_s"))


@query("""WITH f AS (SELECT DISTINCT ON (event_no) event_no, epoch_us("timestamp") AS t, lower(regexp_extract(final_url, '^https?://([^/?#:]+)', 1)) AS h FROM audit WHERE stage = 'fetch' AND NOT cache_hit)
SELECT event_no, h AS host, round(greatest(0, coalesce(lag(t) OVER (PARTITION BY h ORDER BY t, event_no) + 3600000000 - t, 0)) / 1e6, 6) AS wait_s FROM f""")
def pacing_waits(spark, sf_dir):
    f = _t(spark, sf_dir, "audit").where("stage = 'fetch' and not cache_hit").dropDuplicates(["event_no"]).withColumn("host", urls.host(F.col("final_url")))
    return caches.waits(f.select("event_no", "timestamp", "host"), "host", "timestamp", 3600.0, "event_no").select("event_no", "host", "wait_s")


@query("""WITH l AS (SELECT DISTINCT ON (event_no) event_no, municipality_id, cache_hit FROM audit WHERE stage = 'llm'), s AS (SELECT *, sum((NOT cache_hit)::INT) OVER (PARTITION BY municipality_id ORDER BY event_no) AS c FROM l)
SELECT event_no, CAST(c AS BIGINT) AS calls_so_far, c <= 10 AS within_budget FROM s""")
def call_budget(spark, sf_dir):
    calls = _t(spark, sf_dir, "audit").where("stage = 'llm'").dropDuplicates(["event_no"]).select("event_no", "municipality_id", "cache_hit")
    return caches.within_budget(calls, "municipality_id", "event_no", 10, ~F.col("cache_hit")).select("event_no", "calls_so_far", "within_budget")


@query("""SELECT DISTINCT event_no, CASE WHEN TRY_CAST(status AS INT) IS NULL THEN 'none' WHEN TRY_CAST(status AS INT) < 400 THEN 'ok' WHEN status IN ('429', '500', '502', '503', '504') THEN 'retry' ELSE 'error' END AS outcome FROM audit WHERE stage = 'fetch'""")
def fetch_outcomes(spark, sf_dir):
    return _t(spark, sf_dir, "audit").where("stage = 'fetch'").select("event_no", caches.outcome(F.col("status")).alias("outcome")).distinct()


@query("""SELECT id, CAST(p AS INT) AS pass_no, ['model-a', 'model-b'][p % 2 + 1] AS model FROM (SELECT DISTINCT id FROM chunks), range(3) r(p)""")
def pass_requests(spark, sf_dir):
    return caches.passes(_t(spark, sf_dir, "chunks").select("id").distinct(), "id", 3, ["model-a", "model-b"])


@query("""SELECT DISTINCT id, coalesce(nullif(trim(coalesce(title, '')), ''), split_part(rtrim(url, '/'), '/', -1)) AS notice_id FROM sources""")
def notice_id_fallback(spark, sf_dir):
    return _t(spark, sf_dir, "sources").select("id", text.last_segment(F.col("title"), F.col("url")).alias("notice_id")).distinct()


@query("""SELECT * FROM (VALUES (1, 'text', NULL), (2, NULL, 'refusal'), (3, NULL, 'status incomplete'), (4, NULL, 'empty output'), (5, NULL, 'unreadable response')) v(n, output, error)""")
def decoded_responses(spark, sf_dir):
    from evispark.functions.jsonish import decode_response

    part = '{"status": "%s", "output": [{"content": [%s]}]}'
    rows = [part % ("completed", '{"type": "output_text", "text": "te"}, {"type": "output_text", "text": "xt"}'), part % ("completed", '{"type": "refusal", "refusal": "no"}'), part % ("incomplete", ""), part % ("completed", ""), "{"]
    return spark.createDataFrame(list(enumerate(rows, 1)), "n int, body string").select("n", decode_response("body").alias("x")).select("n", "x.output", "x.error")


@query("""SELECT * FROM (VALUES ('https://a.se/', 'Ny'), ('https://b.se/', '')) v(url, title)""")
def search_sources(spark, sf_dir):
    from evispark.functions.jsonish import search_results

    body = '{"output": [{"type": "web_search_call", "action": {"sources": [{"type": "url", "url": "https://a.se/", "title": "Gammal"}, {"type": "url", "url": "https://b.se/"}]}}, {"type": "message", "content": [{"type": "output_text", "text": "se https://prosa.se/", "annotations": [{"type": "url_citation", "url": "https://a.se/", "title": "Ny"}]}]}]}'
    return spark.createDataFrame([(body,)], "body string").select(F.explode(search_results("body")).alias("x")).select("x.url", "x.title")


@query("""WITH r AS (SELECT DISTINCT event_no, key FROM audit WHERE stage = 'llm'), c AS (SELECT key, min(status) AS response FROM audit WHERE stage = 'llm' AND status = 'completed' GROUP BY key)
SELECT r.event_no, c.response, c.key IS NOT NULL AS cache_hit, CASE WHEN c.key IS NULL THEN 'not in the cache' END AS error FROM r LEFT JOIN c ON c.key = r.key""")
def cache_replay(spark, sf_dir):
    calls = _t(spark, sf_dir, "audit").where("stage = 'llm'")
    stored = calls.where("status = 'completed'").select("key", F.col("status").alias("response"))
    return caches.replay(calls.select("event_no", "key").distinct(), stored).select("event_no", "response", "cache_hit", "error")


@query("""SELECT DISTINCT s.url, s.raw_sha256 AS expected, f.sha256 AS found FROM sources s LEFT JOIN (SELECT DISTINCT final_url, sha256 FROM audit WHERE stage = 'fetch' AND sha256 IS NOT NULL) f ON f.final_url = s.url WHERE f.sha256 IS NULL OR f.sha256 <> s.raw_sha256""")
def manifest_mismatch(spark, sf_dir):
    fetched = _t(spark, sf_dir, "audit").where("stage = 'fetch' and sha256 is not null").select(F.col("final_url").alias("url"), "sha256")
    listed = _t(spark, sf_dir, "sources").select("url", F.col("raw_sha256").alias("sha256"))
    return caches.mismatches(listed, fetched, "url")


@query("""SELECT DISTINCT "timestamp", municipality_id, role, model, key, cache_hit, status, usage.input_tokens AS input_tokens, usage.output_tokens AS output_tokens, usage.total_tokens AS total_tokens FROM audit WHERE stage = 'llm'""")
def api_usage_view(spark, sf_dir):
    return views.usage(_t(spark, sf_dir, "audit")).distinct()


@query("""SELECT model, role, count(*) AS n_calls, count_if(cache_hit) AS n_cached, CAST(sum(usage.total_tokens) AS BIGINT) AS total_tokens FROM (SELECT DISTINCT ON (event_no) * FROM audit WHERE stage = 'llm') GROUP BY ALL""")
def usage_by_model(spark, sf_dir):
    calls = _t(spark, sf_dir, "audit").where("stage = 'llm'").dropDuplicates(["event_no"])
    return calls.groupBy("model", "role").agg(F.count("*").alias("n_calls"), F.count_if("cache_hit").alias("n_cached"), F.sum("usage.total_tokens").alias("total_tokens"))


@query("""SELECT stage, date_trunc('day', "timestamp") AS day, count(DISTINCT event_no) AS n_events FROM audit GROUP BY ALL""")
def audit_by_day(spark, sf_dir):
    return _t(spark, sf_dir, "audit").groupBy("stage", F.date_trunc("day", "timestamp").alias("day")).agg(F.count_distinct("event_no").alias("n_events"))


@query("""SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_stream_counts(spark, sf_dir):
    from evispark.streaming.audit import hourly_counts

    return hourly_counts(_t(spark, sf_dir, "events"))


# --- roll-ups and views ----------------------------------------------------------------------------------------------

_FINAL = ", ".join(f"'{c}'" for c in CONCLUSIVE)


@query(f"""WITH d AS (SELECT municipality_id, count(*) AS n, list_sort(list_distinct(flatten(list(coalesce(warnings, []))))) AS gaps FROM (SELECT DISTINCT ON (id) * FROM sources) GROUP BY municipality_id),
u AS (SELECT DISTINCT unit_id, municipality_id, category, verified, needs_review FROM units),
r AS (SELECT municipality_id, count(*) AS n, count_if(verified) AS v, list_sort(list_distinct(list(category) FILTER (category IN ({_FINAL})))) AS final, bool_or(needs_review) AS flagged FROM u GROUP BY municipality_id),
x AS (SELECT e.id, e.name, coalesce(d.n, 0) AS dn, coalesce(r.n, 0) AS rn, coalesce(r.v, 0) AS v, coalesce(r.final, []) AS final, CASE WHEN d.n IS NULL THEN ['no_documents_retrieved'] ELSE coalesce(d.gaps, []) END AS gaps, coalesce(r.flagged, false) AS flagged FROM entity e LEFT JOIN d ON d.municipality_id = e.id LEFT JOIN r ON r.municipality_id = e.id)
SELECT id, name, CASE WHEN len(final) > 1 THEN 'Review' WHEN len(final) = 1 THEN final[1] ELSE 'NoEvidence' END AS category, len(final) <> 1 OR len(gaps) > 0 OR flagged AS needs_review, dn AS n_documents, rn AS n_records, v AS n_verified, CASE WHEN len(gaps) > 0 THEN 'bounded_with_gaps' ELSE 'bounded' END AS coverage, array_to_string(gaps, '|') AS gaps FROM x""")
def entity_summary(spark, sf_dir):
    u = _t(spark, sf_dir, "units").select("unit_id", "municipality_id", "category", F.col("verified").alias("quote_verified"), "needs_review").distinct()
    return rollup.entity_summary(_t(spark, sf_dir, "entity"), _t(spark, sf_dir, "sources").select("id", "municipality_id", "url", "warnings"), u, CONCLUSIVE, "NoEvidence")


@query("""SELECT municipality_id, purpose, count(DISTINCT category) AS n_values, count(DISTINCT category) > 1 AS conflicting FROM units GROUP BY ALL""")
def entity_conflicts(spark, sf_dir):
    return rollup.conflicts(_t(spark, sf_dir, "units"), ["municipality_id"], "purpose", "category")


@query("""WITH s AS (SELECT DISTINCT id, municipality_id, unnest(warnings) AS gap FROM sources) SELECT municipality_id, gap, count(*) AS n_documents FROM s GROUP BY ALL""")
def entity_gaps(spark, sf_dir):
    return _t(spark, sf_dir, "sources").select("id", "municipality_id", F.explode("warnings").alias("gap")).distinct().groupBy("municipality_id", "gap").agg(F.count("*").alias("n_documents"))


@query("""WITH s AS (SELECT chunk_id, stage, array_to_string(list_sort(list_distinct(list(category))), '|') AS sig FROM units GROUP BY ALL) SELECT chunk_id, count(*) AS n_passes, count(DISTINCT sig) AS n_signatures, count(DISTINCT sig) = 1 AS agreed FROM s GROUP BY chunk_id""")
def pass_agreement(spark, sf_dir):
    return rollup.agreement(_t(spark, sf_dir, "units"), "chunk_id", "stage", "category")


@query("""WITH u AS (SELECT DISTINCT * FROM units), l AS (SELECT u.*, unnest(CASE WHEN len(locations) > 0 THEN locations ELSE [NULL] END) AS p, unnest(CASE WHEN len(locations) > 0 THEN range(1, len(locations) + 1) ELSE [NULL] END) AS k FROM u), d AS (SELECT id, min(text_path) AS text_path FROM sources GROUP BY id)
SELECT unit_id, chunk_id, document_id, municipality_id, stage, category, quote_index, purpose, verified, issue, CAST(k AS INT) AS occurrence, p.match AS match, p."start" AS "start", p."end" AS "end", p.line_start AS line_start, p.page_start AS page_start, d.text_path FROM l LEFT JOIN d ON d.id = l.document_id""")
def evidence_view(spark, sf_dir):
    return views.evidence(_t(spark, sf_dir, "units").distinct(), _t(spark, sf_dir, "sources"))


@query("""WITH a AS (SELECT DISTINCT ON (event_no) * FROM audit), s AS (SELECT DISTINCT ON (id) * FROM sources), u AS (SELECT DISTINCT ON (unit_id) * FROM units), x AS (
SELECT municipality_id, stage, url, status AS detail FROM a WHERE stage = 'fetch' AND status >= '400' UNION ALL SELECT municipality_id, stage, url, method FROM a WHERE stage = 'discovery' AND outcome = 'error' UNION ALL
SELECT municipality_id, stage, url, role || ': ' || status FROM a WHERE stage = 'llm' AND status <> 'completed' UNION ALL SELECT municipality_id, 'extract', url, unnest(warnings) FROM s UNION ALL SELECT municipality_id, 'verify', document_id, issue FROM u WHERE issue IS NOT NULL)
SELECT stage, municipality_id, url, detail, count(*) AS n FROM x GROUP BY ALL""")
def error_union(spark, sf_dir):
    found = views.errors(_t(spark, sf_dir, "audit").dropDuplicates(["event_no"]), _t(spark, sf_dir, "sources").dropDuplicates(["id"]), _t(spark, sf_dir, "units").dropDuplicates(["unit_id"]))
    return found.groupBy("stage", "municipality_id", "url", "detail").agg(F.count("*").alias("n"))


@query("""WITH u AS (SELECT DISTINCT chunk_id, stage, category, NULL AS status FROM units), a AS (SELECT DISTINCT NULL AS chunk_id, role AS stage, NULL AS category, status FROM audit WHERE stage = 'llm') SELECT chunk_id, stage, category, status FROM u UNION ALL SELECT chunk_id, stage, category, status FROM a""")
def pass_audit_union(spark, sf_dir):
    u = _t(spark, sf_dir, "units").select("chunk_id", "stage", "category").distinct()
    a = _t(spark, sf_dir, "audit").where("stage = 'llm'").select(F.col("role").alias("stage"), "status").distinct()
    return u.unionByName(a, allowMissingColumns=True)


@query("""SELECT chunk_id, min(document_id) AS document_id, min(municipality_id) AS municipality_id, min(category) AS category, count(quote) AS n_quotes, count_if(verified) AS n_verified, coalesce(bool_or(needs_review), false) OR count(DISTINCT category) > 1 AS needs_review
FROM (SELECT DISTINCT ON (unit_id) * FROM units) GROUP BY chunk_id""")
def classifications_view(spark, sf_dir):
    return views.classifications(_t(spark, sf_dir, "units"))


@query("""SELECT DISTINCT ON (id) id, municipality_id, url, requested_url, retrieved_at, raw_sha256, text_sha256, media_type, title, CAST(coalesce(len(pages), 0) AS INT) AS n_pages, coalesce(array_to_string(warnings, '|'), '') AS warnings, extractor FROM sources""")
def sources_view(spark, sf_dir):
    return views.sources(_t(spark, sf_dir, "sources"))


@query("""SELECT DISTINCT ON (event_no) event_no, timestamp, municipality_id, url, method, outcome, title, score, depth FROM audit WHERE stage = 'discovery'""")
def discovery_view(spark, sf_dir):
    return views.discovery(_t(spark, sf_dir, "audit"))


@query("""WITH c AS (SELECT DISTINCT category FROM units WHERE category IS NOT NULL ORDER BY 1 LIMIT 2) SELECT DISTINCT unit_id, category, category IS NOT NULL AND category IN (SELECT category FROM c) AS known_category FROM units""")
def category_known(spark, sf_dir):
    units = _t(spark, sf_dir, "units").select("unit_id", "category").distinct()
    codebook = units.select(F.col("category").alias("label")).where("label is not null").distinct().orderBy("label").limit(2)
    return checks.unknown_categories(units, codebook)


@query("""WITH c AS (SELECT chunk_id, list(verified ORDER BY quote_index, unit_id) AS v, list(quote_index ORDER BY quote_index, unit_id) AS i FROM (SELECT DISTINCT chunk_id, quote_index, unit_id, verified FROM units) GROUP BY chunk_id)
SELECT chunk_id, len(i) > 0 AND len(list_filter(i, lambda k: k < 0 OR k >= len(v) OR NOT coalesce(v[k + 1], false))) = 0 AS quotes_hold FROM c""")
def quotes_hold(spark, sf_dir):
    units = _t(spark, sf_dir, "units").select("chunk_id", "quote_index", "unit_id", "verified").distinct()
    listed = units.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("quote_index", "unit_id", "verified"))).alias("q"))
    return listed.select("chunk_id", checks.quotes_hold(F.col("q.quote_index"), F.transform("q", lambda x: x["verified"])).alias("quotes_hold"))


# --- notices ---------------------------------------------------------------------------------------------------------


def _notices(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("publication_number"), F.date_format("published_at", "yyyy-MM-dd").alias("publication-date"), F.col("source").alias("buyer-name"), F.col("municipality_id").alias("municipality"), "text", F.col("lang").alias("coverage"))
    return notices.normalize_notices(d, "documents")


@query()
def notice_rows(spark, sf_dir):
    return _notices(spark, sf_dir)


def _bounded(pattern: str) -> str:
    return "(^|[^\\p{L}\\p{N}_])(?:" + pattern.replace("\\b", "").replace("\\w*", "[\\p{L}\\p{N}_]*") + ")($|[^\\p{L}\\p{N}_])"


#: In the SQL a bound within a pattern is a character that isn't of a word: between two words lie 1 to 60 or 40 characters.
_BETWEEN = "(?:[^\\p{L}\\p{N}_]|[^\\p{L}\\p{N}_].{0,%d}[^\\p{L}\\p{N}_])"
_SQL_EXPLICIT = [_bounded(p.replace(r"\b.{0,60}?\b", _BETWEEN % 58).replace(r"\b.{0,40}?\b", _BETWEEN % 38)) for p in lexicon.EXPLICIT]
_SQL_RELATED = [_bounded(p) for p in lexicon.RELATED]
_SPACED = "regexp_replace(text, '[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')"


def _any(column: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '{p}')" for p in patterns) + ")"


#: The screen sentence by sentence: a match counts as explicit if its sentence isn't about users or is about staff.
_SCREENED = f"""WITH t AS (SELECT *, trim(lower({_SPACED})) AS t FROM documents),
q AS (SELECT doc_id, bool_or({_any("x", _SQL_EXPLICIT)} AND (NOT regexp_matches(x, '{_bounded(lexicon.USER_CONTEXT)}') OR regexp_matches(x, '{_bounded(lexicon.STAFF_CONTEXT)}'))) AS strong
FROM (SELECT doc_id, unnest(string_split_regex(t, '[.;] ')) AS x FROM t) GROUP BY doc_id),
n AS (SELECT CAST(nullif(regexp_extract(strftime(published_at, '%Y-%m-%d'), '(20[0-9]{{2}})', 1), '') AS INT) AS year, coalesce(source, '') AS source, coalesce(nullif(lang, ''), 'unknown') AS coverage,
coalesce(t, '') <> '' AS has_text, coalesce(strong, false) AS strong, {_any("t", _SQL_EXPLICIT + _SQL_RELATED)} AS any_match FROM t LEFT JOIN q USING (doc_id))
"""
_COUNTS = "count(*) AS n_notices, count_if(has_text) AS n_documents, count_if(has_text AND strong) AS n_explicit_swedish, count_if(has_text AND NOT strong AND any_match) AS n_language_related, array_to_string(list_sort(list_distinct(list(coverage))), '|') AS coverage_statuses FROM n"


@query(f"{_SCREENED}SELECT year, {_COUNTS} GROUP BY 1")
def notice_year_summary(spark, sf_dir):
    out = notices.aggregate_by_year(_notices(spark, sf_dir))
    return out.withColumn("coverage_statuses", F.array_join("coverage_statuses", "|")).orderBy(F.asc_nulls_last("year"))


@query(f"{_SCREENED}SELECT source, year, {_COUNTS} GROUP BY 1, 2")
def notice_source_year_summary(spark, sf_dir):
    n = _notices(spark, sf_dir)
    return notices.aggregate_by_year(n.withColumn("source", F.col("buyer_name")), by_source=True).withColumn("coverage_statuses", F.array_join("coverage_statuses", "|"))


@query("""SELECT CAST(nullif(regexp_extract(strftime(published_at, '%Y-%m-%d'), '(20[0-9]{2})', 1), '') AS INT) AS year, count(*) AS n_notices, count_if(trim(coalesce(text, ''), ' ' || chr(10) || chr(9)) <> '') AS n_documents, array_to_string(list_sort(list_distinct(list(coalesce(nullif(lang, ''), 'unknown')))), '|') AS coverage_statuses FROM documents GROUP BY 1""")
def notice_year_counts(spark, sf_dir):
    """The counts of :func:`notice_year_summary` that need no lexicon."""
    return notice_year_summary(spark, sf_dir).select("year", "n_notices", "n_documents", "coverage_statuses")


@query(f"WITH d AS (SELECT lower({_SPACED}) AS t FROM documents) " + " UNION ALL ".join(f"SELECT CAST({k} AS INT) AS pattern_no, count_if(regexp_matches(t, '{p}')) AS n_rows FROM d" for k, p in enumerate(_SQL_EXPLICIT + _SQL_RELATED, 1)))
def lexicon_counts(spark, sf_dir):
    return lexicon.pattern_counts(_t(spark, sf_dir, "documents"), lexicon.EXPLICIT + lexicon.RELATED)


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])(?:äldreomsorg|hemtjänst|särskil(?:t|da)\s+boende|äldreboende|vård-\s+och\s+omsorgsboende|omsorgsboende|korttidsboende|dagverksamhet|trygghetslarm|serviceboende|demensboende|äldre\s+personer($|[^\p{L}\p{N}_]))')")
def care_filter(spark, sf_dir):
    return notices.is_elderly_care(_t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("description"))).select("doc_id")


# --- literal inputs: pages, notices and chains that no table holds ---------------------------------------------------

_ADVERT = """<html><body><main><h1>Hemtjänst enligt LOV</h1><dl><dt>Upphandlande myndighet</dt><dd>Berga kommun</dd><dt>Diarienummer:</dt><dd>SN 2024/1</dd></dl><a href="https://berga.example/lov.pdf">Underlag</a><a href="/om">Om portalen</a></main></body></html>"""


def _pages(spark, html: str, url: str = "https://berga.example/sida/") -> DataFrame:
    return spark.createDataFrame([(url, html)], "url string, html string")


def _source_pages(spark, sf_dir, body: str) -> DataFrame:
    """A page for each source: ``body`` is an SQL expression over its row."""
    s = _t(spark, sf_dir, "sources").select("id", "url", "requested_url", "municipality_id").distinct()
    return s.select("url", F.expr(f"concat('<html><head><title>', id, ' &amp; villkor</title><script>x()</script></head><body><nav><a href=\"/\">Hem</a></nav>', {body}, '<footer>Kontakt</footer></body></html>')").alias("html")).dropDuplicates()


_HOST = "regexp_extract(url, '^(https?://[^/]+)', 1)"
_DISTINCT_SOURCES = "(SELECT DISTINCT id, url, requested_url, municipality_id FROM sources)"


@query(f"SELECT DISTINCT url, id || ' & villkor' AS title, 'html' AS kind, 'Villkor' || chr(10) || 'Hemtjänst' || chr(10) || 'i' || chr(10) || coalesce(municipality_id, '-') || chr(10) || id AS text FROM {_DISTINCT_SOURCES}")
def page_text(spark, sf_dir):
    html = """'<main><h1>Villkor</h1><p>Hemtjänst <b>i</b> ', coalesce(municipality_id, '-'), '</p><a href="', id, '">', id, '</a></main>'"""
    return pages.extract(_source_pages(spark, sf_dir, html)).select("url", "title", "kind", "text")


@query(f"""SELECT DISTINCT url, x.link_no, x.target, x.label FROM (SELECT url, unnest([{{'link_no': 1, 'target': {_HOST} || '/', 'label': 'Hem'}}, {{'link_no': 2, 'target': requested_url, 'label': id}}, {{'link_no': 3, 'target': {_HOST} || '/docs/' || id || '.pdf?v=1', 'label': 'Karta'}}]) AS x FROM {_DISTINCT_SOURCES})""")
def page_links(spark, sf_dir):
    html = """'<a href="', requested_url, '">', id, '</a><a href="/docs/', id, '.pdf?v=1">Karta</a><a>utan adress</a>'"""
    return pages.anchors(_source_pages(spark, sf_dir, html)).select("url", "link_no", "target", "label").distinct()


@query(f"""SELECT DISTINCT url, x.rank, x.target FROM (SELECT url, unnest([{{'rank': 1, 'target': {_HOST} || '/docs/' || id || '-b.PDF'}}, {{'rank': 2, 'target': {_HOST} || '/docs/' || id || '-a.pdf'}}, {{'rank': 3, 'target': {_HOST} || '/download/' || id}}]) AS x FROM {_DISTINCT_SOURCES} WHERE url IN (SELECT url FROM {_DISTINCT_SOURCES} GROUP BY url HAVING count(*) = 1))""")
def pdf_link_rank(spark, sf_dir):
    """Of pages that one source has: two sources of one address would make one page of two."""
    html = """'<a href="/docs/', id, '-a.pdf">Karta</a><a href="/docs/', id, '-b.PDF">Förfrågningsunderlag</a><a href="/download/', id, '">Bilder</a><a href="/docs/', id, '-a.pdf">Igen</a><a href="/x">x</a>'"""
    found = _source_pages(spark, sf_dir, html)
    return pages.pdf_links(found.join(found.groupBy("url").count().where("count = 1").select("url"), "url", "left_semi")).select("url", "rank", "target")


@query("""SELECT 'https://www.upphandlingsmyndigheten.se/hitta-lov-uppdrag/?k=' || municipality_id AS url, CAST(row_number() OVER (PARTITION BY municipality_id ORDER BY id) AS INT) AS rank, 'https://www.upphandlingsmyndigheten.se/hitta-lov-uppdrag/annonser/' || municipality_id || '/' || id || '/' AS target FROM (SELECT DISTINCT municipality_id, id FROM sources WHERE municipality_id IS NOT NULL)""")
def lov_advert_urls(spark, sf_dir):
    """A listing for each municipality with links to adverts, to the listing itself and to another site."""
    base = "https://www.upphandlingsmyndigheten.se/hitta-lov-uppdrag/"
    s = _t(spark, sf_dir, "sources").where("municipality_id is not null").select("municipality_id", "id").distinct()
    link = F.concat(F.lit('<a href="/hitta-lov-uppdrag/annonser/'), "municipality_id", F.lit("/"), "id", F.lit('">A</a>'))
    listings = s.groupBy("municipality_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", link.alias("a")))), lambda x: x["a"]), "").alias("links"))
    html = F.concat(F.lit('<a href="/hitta-lov-uppdrag/annonser/">alla</a>'), "links", F.lit('<a href="https://annan.example/hitta-lov-uppdrag/annonser/x/y/">B</a>'), "links")
    return pages.advert_links(listings.select(F.concat(F.lit(base + "?k="), "municipality_id").alias("url"), html.alias("html"))).select("url", "rank", "target")


@query("""SELECT 'Hemtjänst enligt LOV' AS title, 'Berga kommun' AS buyer_name, 'SN 2024/1' AS reference, 'https://berga.example/lov.pdf' AS document_links""")
def lov_adverts(spark, sf_dir):
    return pages.adverts(_pages(spark, _ADVERT, "https://www.upphandlingsmyndigheten.se/hitta-lov-uppdrag/annonser/berga/hemtjanst/")).select("title", "buyer_name", "reference", F.array_join("document_links", "|").alias("document_links"))


@query("""SELECT DISTINCT url || '?x=1&y=2' AS loc FROM sources WHERE municipality_id IS NOT NULL AND municipality_id <> (SELECT min(municipality_id) FROM sources)""")
def sitemap_locs(spark, sf_dir):
    """A sitemap for each municipality; that of the first has a document type and gives nothing."""
    s = _t(spark, sf_dir, "sources").where("municipality_id is not null")
    least = s.agg(F.min("municipality_id").alias("least"))
    entry = F.concat(F.lit('<s:url xmlns:s="x"><s:loc> '), "url", F.lit("?x=1&amp;y=2 </s:loc></s:url>"))
    maps = s.groupBy("municipality_id").agg(F.array_join(F.collect_set(entry), "").alias("entries")).crossJoin(F.broadcast(least))  # one row
    xml = F.concat(F.when(F.col("municipality_id") == F.col("least"), "<!DOCTYPE x>").otherwise(""), F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "entries", F.lit("</urlset>"))
    return maps.select(F.explode(pages.sitemap_locations(xml)).alias("loc")).distinct()


@query(r"""SELECT CAST(doc_id AS VARCHAR) AS notice_id, strftime(published_at, '%Y-%m-%d') AS publication_date, concat_ws(' | ', source, municipality_id) AS buyer_name, coalesce(municipality_id, '') AS municipality_name, 'Nr ' || doc_id AS title, '85311100 | 85312100' AS cpv, 'Nr ' || doc_id || chr(10) || 'lott ' || coalesce(lang, '-') AS description, 'https://d.example/' || doc_id || '.pdf' AS document_urls, 'https://ted.europa.eu/sv/notice/-/detail/' || doc_id AS source_url
FROM documents WHERE published_at IS NOT NULL""")
def ted_rows(spark, sf_dir):
    """A notice in JSON for each dated document: language maps, lists with empty members, addresses within text."""
    d = _t(spark, sf_dir, "documents").where("published_at is not null")
    number = F.col("doc_id").cast("string")
    notice = F.struct(
        number.alias("publication-number"),
        F.concat(F.date_format("published_at", "yyyy-MM-dd"), F.lit("+01:00")).alias("publication-date"),
        F.struct(F.lit("Care").alias("eng"), F.array(F.concat(F.lit("Nr "), number)).alias("swe")).alias("notice-title"),
        F.array("source", F.lit(""), "municipality_id").alias("buyer-name"),
        F.struct(F.col("municipality_id").alias("swe")).alias("buyer-city"),
        F.array(F.lit("85311100"), F.lit("85312100")).alias("classification-cpv"),
        F.array(F.lit(None).cast("string"), F.concat(F.lit("lott "), F.coalesce("lang", F.lit("-")))).alias("title-lot"),
        F.array(F.concat(F.lit("se https://d.example/"), number, F.lit(".pdf nu"))).alias("document-url-lot"),
    )
    rows = notices.ted_rows(d.select(F.to_json(notice).alias("notice")))
    return rows.select("notice_id", "publication_date", "buyer_name", "municipality_name", "title", "cpv", "description", F.array_join("document_urls", "|").alias("document_urls"), "source_url")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS flat FROM events""")
def ted_flatten(spark, sf_dir):
    from evispark.functions.jsonish import flatten_json

    return _t(spark, sf_dir, "events").select("event_id", flatten_json("props").alias("flat"))


@query("""WITH s AS (SELECT municipality_id, id, row_number() OVER (PARTITION BY municipality_id ORDER BY id) AS k FROM (SELECT DISTINCT municipality_id, id FROM sources WHERE municipality_id IS NOT NULL))
SELECT municipality_id || '/' || id AS url, CAST(floor(log2(k)) AS INT) AS depth FROM s WHERE k < 16""")
def crawl_reachability(spark, sf_dir):
    """The sources of each municipality as a tree of links, two from each, with links back; walked from its first to depth 3."""
    s = _t(spark, sf_dir, "sources").where("municipality_id is not null").select("municipality_id", "id").distinct()
    ranked = s.withColumn("k", F.row_number().over(Window.partitionBy("municipality_id").orderBy("id"))).select("municipality_id", F.concat("municipality_id", F.lit("/"), "id").alias("url"), "k")
    child = ranked.select("municipality_id", F.col("url").alias("target"), F.expr("k div 2").alias("k"))
    down = ranked.join(child, ["municipality_id", "k"]).select("url", "target")
    back = down.select(F.col("target").alias("url"), F.col("url").alias("target"))
    return discovery.reachable(down.unionAll(back), ranked.where("k = 1").select("url"), 3)


@query("""SELECT * FROM (VALUES ('m', 1, 'a', 0, 5, true), ('m', 2, 'c', 1, 9, true), ('m', 3, 'd', 2, 7, false), ('m', 4, 'b', 1, 1, true)) v(entity, step, url, depth, score, found)""")
def crawl_best_first(spark, sf_dir):
    pages_ = spark.createDataFrame([("m", "a", [("b", 1), ("c", 9)]), ("m", "c", [("d", 7), ("a", 100)]), ("m", "b", [("e", 3)])], "entity string, url string, links array<struct<url:string,score:int>>")
    return discovery.crawl(pages_, spark.createDataFrame([("m", "a", 5)], "entity string, url string, score int"), 4, 2)
