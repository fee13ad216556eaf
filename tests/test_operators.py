import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evispark import config
from evispark.operators import caches, checks, chunking, discovery, lexicon, notices, pages, quotes, rollup, views


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab\n å", max_size=300), st.integers(10, 60), st.integers(0, 9))
def test_windows_cover_the_text(text, size, overlap):
    found, limited = chunking.windows_of(text, size, overlap, 1000)
    assert not limited and (found or not text)
    if text:
        assert found[0][0] == 0 and found[-1][1] == len(text)
    for (a, b), (c, d) in zip(found, found[1:]):
        assert a < c <= b < d
    assert all(b - a <= size for a, b in found)


def test_recorded_windows():
    # line feeds where the recorded texts have them
    def text(n, feeds):
        t = ["x"] * n
        for f in feeds:
            t[f] = "\n"
        return "".join(t)

    assert chunking.windows_of(text(45092, [13993, 26486, 38955]), 14000, 1500, 100)[0] == [(0, 13994), (12494, 26487), (24987, 38956), (37456, 45092)]
    assert chunking.windows_of(text(28578, [13999, 26497]), 14000, 1500, 100)[0] == [(0, 14000), (12500, 26498), (24998, 28578)]
    assert chunking.windows_of("x" * 8394, 14000, 1500, 100) == ([(0, 8394)], False)
    assert chunking.windows_of("x" * 300, 100, 20, 1) == ([(0, 100)], True)


def test_chunk_documents(spark):
    df = spark.createDataFrame([("a", "x" * 250, 1), ("b", None, 1), ("c", "", 1), ("a", "x" * 250, 1)], "id string, text string, start int")
    rows = chunking.chunk_documents(df, 100, 20).collect()
    assert sorted({(r["id"], r["limited"]) for r in rows}) == [("a:0:100", False), ("a:160:250", False), ("a:80:180", False)] and len(rows) == 6
    assert chunking.chunk_documents(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        chunking.chunk_documents(df, 100, 100)


def test_lines_and_pages(spark):
    df = spark.createDataFrame([("a", "x\r\n\ny"), ("b", "")], "id string, text string")
    assert [r["numbered"] for r in chunking.numbered_lines(df).orderBy("id", "line_no").collect()] == ["000001\tx\r", "000002\t", "000003\ty", "000001\t"]
    p = spark.createDataFrame([("d", 1, "x" * 140), ("d", 2, "y" * 69), ("d", 3, None)], "id string, page int, text string")
    assert [(r["start"], r["end"]) for r in chunking.page_offsets(p).orderBy("page").collect()] == [(0, 140), (143, 212), (215, 215)]


def test_quotations():
    t = "Krav på svenska.\nKrav på svenska. aaa"
    assert quotes.occurrences("Krav på svenska.", t) == [("exact", 0, 16), ("exact", 17, 33)]
    assert quotes.occurrences("svenska. Krav", t) == [("whitespace", 8, 21)]
    assert quotes.occurrences("aa", t) == [("exact", 34, 36)]
    assert quotes.occurrences("krav", t) == quotes.occurrences(" ", t) == quotes.occurrences(None, t) == quotes.occurrences("x" * 2001, "x" * 3000) == []


def test_locate_and_pages(spark):
    df = spark.createDataFrame([(1, "d", "två", 10, "ett två\ntvå"), (2, "d", "x", None, None), (3, "e", None, 0, "a")], "n int, document_id string, quote string, start int, text string")
    found = quotes.locate(df).select("n", "document_id", F.explode("places").alias("p")).select("n", "document_id", "p.start", "p.end", "p.match")
    assert [tuple(r)[2:] for r in found.orderBy("start").collect()] == [(14, 17, "exact"), (18, 21, "exact")]
    docs = spark.createDataFrame([("d", [(1, 0, 16), (2, 18, 30)])], "id string, pages array<struct<page:int,start:int,end:int>>")
    got = [(r["page_start"], r["page_end"], r["page_char_start"], r["page_char_end"]) for r in quotes.with_pages(found, docs).orderBy("start").collect()]
    assert got == [(1, None, 14, None), (2, 2, 0, 3)]
    assert spark.createDataFrame([("a\nb\nc",)], "t string").select(quotes.line_of(F.col("t"), F.lit(4))).first()[0] == 3


@pytest.mark.parametrize(
    "text,category",
    [
        ("Utföraren ska ha goda kunskaper i svenska.", "explicit_requirement"),
        ("Personalen ska behärska svenska i tal och skrift.", "explicit_requirement"),
        ("Lägst nivå B2 enligt GERS krävs.", "explicit_requirement"),
        ("Medarbetare ska tala, läsa och skriva   svenska.", "explicit_requirement"),
        ("Brukare som inte talar god svenska har rätt till tolk.", "language_related"),
        ("Brukaren talar god svenska. Personalen ska kunna tala svenska.", "explicit_requirement"),
        ("Språkombud finns.", "language_related"),
        ("Upphandling svenska 2025.", "no_evidence"),
        ("", "missing_document"),
        (None, "missing_document"),
        (" \n", "missing_document"),
    ],
)
def test_lexicon(text, category):
    found = lexicon.Screen(lexicon.Lexicon()).judge(text)
    assert found[0] == category
    if category in ("explicit_requirement", "language_related"):
        assert found[1] and " ".join(found[1].split()) in " ".join(text.split())


def test_evidence_window():
    shown = lexicon.Screen(lexicon.Lexicon()).judge("a " * 200 + "språkkrav" + " b" * 200)[1]
    assert shown == ("a " * 50 + "språkkrav" + " b" * 70).strip()


def test_notices(spark):
    df = spark.createDataFrame(
        [("N1", "2022-03-01", "Berga", "Personalen ska behärska svenska", "85311100-3", None), ("N2", "20210304", "", None, None, "Hemtjänst"), (None, None, None, " ", None, None)],
        "`publication-number` string, `publication-date` string, municipality string, document_text string, cpv string, title string",
    )
    n = notices.normalize_notices(df, "ted")
    assert n.columns == notices.NOTICE_COLUMNS
    rows = {r["notice_id"]: r for r in n.collect()}
    assert (rows["N1"]["year"], rows["N1"]["language_category"], rows["N1"]["document_status"]) == (2022, "explicit_requirement", "available")
    assert (rows["N2"]["year"], rows["N2"]["language_category"], rows["N2"]["coverage_status"]) == (None, "missing_document", "unknown")
    years = {r["year"]: tuple(r)[1:5] for r in notices.aggregate_by_year(n).collect()}
    assert years == {2022: (1, 1, 1, 0), None: (2, 0, 0, 0)}
    assert {r["publication-number"] for r in notices.is_elderly_care(df).collect()} == {"N1", "N2"}
    assert notices.ted_query(["1", "2"], "SWE", 2020, 2021) == "classification-cpv IN (1 2) AND buyer-country IN (SWE) AND publication-date>=20200101 AND publication-date<=20211231"


def test_frontier(spark):
    df = spark.createDataFrame([("m", 1, 0, 2), ("m", 2, 5, 1), ("m", 3, 5, 0), ("m", 4, None, None), (None, 5, 1, 0), ("n", 6, 1, 1)], "municipality_id string, event_no int, score int, depth int")
    got = {(r["municipality_id"], r["rank"]): (r["event_no"], r["limited"]) for r in discovery.frontier(df, 2).collect()}
    assert got == {("m", 1): (3, True), ("m", 2): (2, True), (None, 1): (5, False), ("n", 1): (6, False)}


def test_candidates(spark):
    entities = spark.createDataFrame([("m", ["town.se"])], "id string, domains array<string>")
    found = spark.createDataFrame([("m", "https://TOWN.se/a#x", 1), ("m", "https://town.se/a", 2), ("m", "https://evil.se/", 3), ("x", "https://town.se/", 4), ("m", None, 5)], "municipality_id string, url string, n int")
    assert [(r["normalized_url"], r["n"]) for r in discovery.candidates(found, entities, order=[F.col("n")]).collect()] == [("https://town.se/a", 1)]


def test_redirects_and_rounds(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("c", "c")], "url string, target string")
    starts = spark.createDataFrame([("a",), ("c",), ("x",)], "url string")
    got = {r["url"]: (r["final_url"], r["hops"], r["limited"]) for r in discovery.follow_redirects(edges, starts, 3).collect()}
    assert got == {"a": ("c", 2, False), "c": ("c", 0, False), "x": ("y", 3, True)}


def test_crawl_matches_a_plain_queue(spark):
    rng = random.Random(3)
    import heapq

    rows, starts, want = [], [], []
    for e in ("m", "n"):
        graph = {f"p{k}": [(f"p{rng.randrange(30)}", rng.randrange(5)) for _ in range(4)] for k in range(20)}
        rows += [(e, u, x) for u, x in graph.items()]
        starts.append((e, "p0", 9))
        seen, heap, n, step = {"p0"}, [(-9, 0, 0, "p0")], 1, 0
        while heap and step < 12:
            s, d, _, u = heapq.heappop(heap)
            step += 1
            want.append((e, step, u, d, -s, u in graph))
            if d < 3:
                for v, w in graph.get(u, []):
                    if v not in seen:
                        seen.add(v)
                        heapq.heappush(heap, (-w, d + 1, n, v))
                        n += 1
    p = spark.createDataFrame(rows, "entity string, url string, links array<struct<url:string,score:int>>")
    s = spark.createDataFrame(starts, "entity string, url string, score int")
    assert sorted(tuple(r) for r in discovery.crawl(p, s, 12, 3).collect()) == sorted(want)
    assert discovery.crawl(p.limit(0), s.limit(0), 5, 1).collect() == []


def test_caches(spark):
    requests = spark.createDataFrame([("k1", 1), ("k2", 2), (None, 3)], "key string, n int")
    cache = spark.createDataFrame([("k1", "b"), ("k1", "a")], "key string, response string")
    got = {r["n"]: (r["response"], r["cache_hit"], r["error"]) for r in caches.replay(requests, cache).collect()}
    assert got == {1: ("a", True, None), 2: (None, False, "not in the cache"), 3: (None, False, "not in the cache")}
    bodies = spark.createDataFrame([(b"x", "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"), (b"y", "0"), (None, None)], "body binary, sha256 string")
    assert [r["intact"] for r in caches.intact(bodies).collect()] == [True, False, False]
    m = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    assert sorted(tuple(r) for r in caches.mismatches(m, spark.createDataFrame([("a", "1"), ("b", "9")], "path string, sha256 string")).collect()) == [("b", "2", "9"), ("c", "3", None)]


def test_pacing(spark):
    e = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, "a", 0), (4, "a", 5)], "n int, k string, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert {r["n"]: r["wait_s"] for r in caches.waits(e, "k", "ts", 2.0, "n").collect()} == {1: 0.0, 2: 0.0, 3: 2.0, 4: 0.0}
    b = caches.within_budget(e.withColumn("hit", F.col("n") == 3), "k", "n", 1, ~F.col("hit"))
    assert {r["n"]: (r["calls_so_far"], r["within_budget"]) for r in b.collect()} == {1: (1, True), 2: (1, True), 3: (1, True), 4: (2, False)}


def test_running_totals_by_stretches(spark):
    rng = random.Random(8)
    rows = [(n, rng.choice(["a", "a", "b", None]), rng.choice([0, 1, None])) for n in range(200)]
    df = spark.createDataFrame(rows, "n int, k string, v int")
    want, so_far = {}, {}
    for n, k, v in rows:
        so_far[k] = so_far.get(k, 0) + (v or 0)
        want[n] = so_far[k]
    for width in (7, 1_000_000):
        assert {r["n"]: r["t"] for r in caches.running_total(df, ["k"], "n", F.col("v"), "t", width).collect()} == want
    e = df.withColumn("ts", F.timestamp_seconds(F.col("n") * 3))
    one = {r["n"]: r["wait_s"] for r in caches.waits(e, "k", "ts", 20.0, "n").collect()}
    assert {r["n"]: r["wait_s"] for r in caches.waits(e, "k", "ts", 20.0, "n", stretch_s=10).collect()} == one
    assert max(one.values()) == 17.0 and min(one.values()) == 0.0


def test_repeats_are_attempts(spark):
    f = spark.createDataFrame([(1, "m", "u", "s"), (2, "m", "u", "s"), (3, "m", "v", None), (4, "m", "v", None), (5, None, "u", "s")], "n int, m string, u string, s string")
    got = {r["n"]: (r["attempt"], r["repeat"]) for r in caches.delivered_once(f, ["m", "u", "s"], "n").collect()}
    assert got == {1: (1, False), 2: (2, True), 3: (3, False), 4: (4, True), 5: (1, False)}


def test_summary(spark):
    e = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", "C")], "id string, name string")
    d = spark.createDataFrame([("d1", "1", "u", None), ("d1", "1", "u", None), ("d2", "2", "u", ["w"])], "id string, municipality_id string, url string, warnings array<string>")
    r = spark.createDataFrame([("1", "Yes", True, False), ("2", "Yes", True, False), ("2", "Pilot", False, True), ("1", "Unclear", False, False)], "municipality_id string, category string, quote_verified boolean, needs_review boolean")
    got = {x["id"]: (x["category"], x["needs_review"], x["n_documents"], x["n_records"], x["coverage"], x["gaps"]) for x in rollup.entity_summary(e, d, r, ["Yes", "Pilot"], "NoEvidence").collect()}
    assert got == {"1": ("Yes", False, 1, 2, "bounded", ""), "2": ("Review", True, 1, 2, "bounded_with_gaps", "w"), "3": ("NoEvidence", True, 0, 0, "bounded_with_gaps", "no_documents_retrieved")}


def test_conflicts_and_agreement(spark):
    v = spark.createDataFrame([("e", "scope", "a"), ("e", "scope", ""), ("e", "date", None), ("e", "date", "x")], "e string, name string, value string")
    both = {(r["name"], r["conflicting"]) for r in rollup.conflicts(v, ["e"], "name", "value").collect()}
    assert both == {("scope", True), ("date", False)}
    assert {r["conflicting"] for r in rollup.conflicts(v, ["e"], "name", "value", empty_counts=False).collect()} == {False}
    p = spark.createDataFrame([("c", "1", "Y"), ("c", "2", "Y"), ("d", "1", "Y"), ("d", "2", "N")], "c string, s string, v string")
    assert {r["c"]: r["agreed"] for r in rollup.agreement(p, "c", "s", "v").collect()} == {"c": True, "d": False}


def test_pages(spark):
    df = spark.createDataFrame([("https://a.se/404/", "<title>Sidan saknas</title><body>kort</body>"), ("u", None), ("https://a.se/", "<body>" + "text " * 20)], "url string, html string")
    got = {r["url"]: r["warnings"] for r in pages.extract(df).collect()}
    assert "suspected_error_page_not_classified" in got["https://a.se/404/"] and got["https://a.se/"] == ["html_fallback_extractor_review_layout"] and len(got) == 2
    xml = spark.createDataFrame([("i", "<sitemapindex><sitemap><loc>m</loc></sitemap><sitemap><loc>i</loc></sitemap></sitemapindex>"), ("m", "<urlset><url><loc>p</loc></url></urlset>")], "url string, body string")
    assert [r["url"] for r in pages.sitemap_urls(xml, spark.createDataFrame([("i",)], "url string")).collect()] == ["p"]


@pytest.mark.parametrize("status,robots,want", [(200, "User-agent: *\nDisallow: /a", False), (200, "User-agent: *\nDisallow: /b", True), (403, "", False), (404, None, True), (500, None, False), (None, None, False)])
def test_robots(status, robots, want):
    assert pages.robots_allow(robots, status, "bot", "https://x.se/a") is want


def test_evidence_keeps_units_without_places(spark):
    schema = "unit_id int, chunk_id string, document_id string, municipality_id string, stage string, category string, quote_index int, purpose string, verified boolean, issue string, locations array<struct<match:string,start:int,end:int,line_start:int,page_start:int>>"
    u = spark.createDataFrame([(1, "c", "d", "m", "s", "Y", 0, "f", True, None, [("exact", 0, 1, 1, None)]), (2, "c", "x", "m", "s", "Y", 0, "f", False, "i", [])], schema)
    got = {r["unit_id"]: (r["occurrence"], r["text_path"]) for r in views.evidence(u, spark.createDataFrame([("d", "t")], "id string, text_path string")).collect()}
    assert got == {1: (1, "t"), 2: (None, None)}


def test_broken_json_is_an_empty_notice(spark):
    rows = notices.ted_rows(spark.createDataFrame([("{",), (None,), (json.dumps({"publication-number": 7, "notice-title": None}),)], "notice string")).collect()
    assert [(r["notice_id"], r["title"], r["document_urls"], r["source_url"]) for r in rows] == [("", "", [], ""), ("", "", [], ""), ("7", "", [], "https://ted.europa.eu/sv/notice/-/detail/7")]


def test_adverts_of_a_paged_listing(spark):
    base = "https://www.upphandlingsmyndigheten.se/hitta-lov-uppdrag/"
    link = lambda n: f'<a href="{base}annonser/k/s{n}/">x</a>'
    rows = [(base, link(1)), (f"{base}?page=2", link(1)), (f"{base}?page=3", link(9)), (f"{base}?p=2", link(2) + link(1)), (f"{base}?p=3", link(3)), (f"{base}?p=4", link(2)), (f"{base}?p=5", link(8)), (f"{base}?s=2", link(7))]
    got = pages.discover_adverts(spark.createDataFrame(rows, "url string, html string"), spark.createDataFrame([(f"{base}annonser/k/s0/",)], "url string"), base, ["page", "p", "s"])
    assert sorted(r["url"][-3:-1] for r in got.collect()) == ["s0", "s1", "s2", "s3"]


def test_documents_of_a_request(spark):
    page = '<main>Sida <a href="/karta.pdf">Karta</a><a href="/villkor.pdf">Villkor</a><a href="https://annan.se/x.pdf">x</a></main>'
    stored = spark.createDataFrame([("https://a.se/", page, "text/html"), ("https://a.se/villkor.pdf", "%PDF-1", "application/pdf"), ("https://a.se/sist", "<p>sist</p>", "text/html")], "url string, html string, content_type string")
    requests = spark.createDataFrame([("n", ["https://a.se/", "https://a.se/sist"]), ("tom", None)], "id string, urls array<string>")
    got = [(r["step"], r["url"], r["kind"], r["error"]) for r in pages.document_queue(requests, stored).orderBy("step").collect()]
    assert got == [
        (1, "https://a.se/", "html", None),
        (2, "https://a.se/villkor.pdf", "pdf", None),
        (3, "https://a.se/karta.pdf", None, "not in the cache"),
        (4, "https://annan.se/x.pdf", None, "outside the request's hosts"),
        (5, "https://a.se/sist", "html", None),
    ]
    assert len(pages.document_queue(requests, stored, most=2).collect()) == 2


def test_stored_bodies(spark):
    d = spark.createDataFrame([("u", b"x"), ("v", b"x"), ("w", b"xyz"), ("n", None)], "url string, body binary")
    bodies, meta = caches.store_bodies(d, 2)
    assert bodies.count() == 1 and {r["url"] for r in meta.collect()} == {"u", "v"}


def test_every_pattern_of_the_lexicon_is_counted(spark, tmp_path):
    import re

    from evispark.plans.queries import QUERIES

    rng = random.Random(7)
    words = ["CEFR", "gers", "gemensam  europeisk\nreferensram", "B1", "c2", "B12", "xcefr", "nivå", "å" * 20, "x" * 39, "svenska", "sfi", "tolk", "språkkrav"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(400)] + [None, ""]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plain = [re.sub(r"\s+", " ", t).lower() for t in texts if t is not None]
    patterns = lexicon.EXPLICIT + lexicon.RELATED
    want = {k: sum(bool(re.search(p, t)) for t in plain) for k, p in enumerate(patterns, 1)}
    assert {r["pattern_no"]: r["n_rows"] for r in QUERIES["lexicon_counts"](spark, str(tmp_path)).collect()} == want
    assert want[12] and want[13] and want[12] != want[13]


def test_checks_of_coded_records(spark):
    book = spark.createDataFrame([("Ja", 1), ("Nej", 2), (None, 3)], "label string, known_category int")
    rows = spark.createDataFrame([(1, "Ja"), (2, "Annat"), (3, None), (1, "Ja")], "id int, category string")
    assert sorted((r["id"], r["known_category"]) for r in checks.unknown_categories(rows, book).collect()) == [(1, True), (1, True), (2, False), (3, False)]
    held = spark.createDataFrame([([0, 1], [True, True]), ([0, 2], [True, True]), ([-1], [True]), ([], [True]), ([0], [None]), (None, [True]), ([0], None)], "i array<int>, v array<boolean>")
    assert [r[0] for r in held.select(checks.quotes_hold(F.col("i"), F.col("v"))).collect()] == [True, False, False, False, False, False, False]
    attributes = spark.createDataFrame([("c", 0, "a"), ("c", 1, "b"), ("c", 2, "a"), ("d", 0, "a"), ("d", 1, None)], "chunk_id string, position int, name string")
    fields = spark.createDataFrame([("a",), ("a",), (None,)], "name string")
    assert sorted((r["chunk_id"], r["name"] or "", r["issue"]) for r in checks.attribute_issues(attributes, fields, ["chunk_id"]).collect()) == [("c", "a", "repeated"), ("c", "b", "unknown"), ("d", "", "unknown")]
    sets = spark.createDataFrame([(["a", "b"], ["b"]), (["a"], ["a", "c"]), (None, ["a"]), (["a"], None)], "r array<string>, c array<string>")
    assert [r[0] for r in sets.select(checks.labels_missing(F.col("r"), F.col("c"))).collect()] == [["a"], [], [], ["a"]]
    nested = spark.createDataFrame([(1, [("x",), ("",), (None,)]), (2, None), (3, [("y",)])], "n int, documents array<struct<sha256:string>>")
    assert checks.documents_downloaded(nested).collect()[0][0] == 2 and checks.documents_downloaded(nested.where("false")).collect()[0][0] == 0
    hosts = spark.createDataFrame([("8.8.8.8",), ("10.0.0.1",), ("127.0.0.1",), ("::1",), ("2001:4860:4860::8888",), ("169.254.1.1",), ("x",), (None,)], "a string")
    assert [r[0] for r in hosts.select(checks.is_public_address("a")).collect()] == [True, False, False, False, True, False, False, False]


def test_rounds_end_where_nothing_is_new(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", None)], "url string, target string")
    assert sorted((r["url"], r["depth"]) for r in discovery.reachable(links, spark.createDataFrame([("a",), ("a",)], "url string"), 50).collect()) == [("a", 0), ("b", 1), ("c", 2)]


def test_pdf_pages_come_from_a_provider(spark):
    stored = spark.createDataFrame([("u", "%PDF-1 sida", "application/pdf"), ("v", "%PDF-1 trasig", "application/pdf")], "url string, html string, content_type string")

    def texts(body):
        if b"trasig" in body:
            raise ValueError("encrypted")
        return ["Text på första sidan, lång nog för gränsen.", ""]

    got = {r["url"]: (r["kind"], r["text"], r["warnings"]) for r in pages.extract(stored, page_texts=texts).collect()}
    assert got["u"] == ("pdf", "Text på första sidan, lång nog för gränsen.\n\f\n", ["page_2_sparse_or_scanned_needs_review"])
    assert got["v"] == ("pdf", "", ["pdf_without_text"])
    assert {r["warnings"][0] for r in pages.extract(stored).collect()} == {"pdf_without_text"}


def test_attribute_and_methodology_views(spark):
    rows = spark.createDataFrame([("c", [("a", "1", [0, 2]), ("b", None, [])]), ("d", None)], "chunk_id string, attributes array<struct<name:string,value:string,quote_indexes:array<int>>>")
    assert [tuple(r) for r in views.attributes(rows).orderBy("name").collect()] == [("c", "a", "1", "0|2"), ("c", "b", None, "")]
    study = config.check({"research": {"question": "Q", "labels": {"Ja": {"description": "yes"}, "Vet ej": {"description": "?", "conclusive": False}}, "unknown_label": "Vet ej"}})
    items = [r["item"] for r in views.methodology(spark, study, {"pyspark": "4"}, "2024").collect()]
    assert len(items) == 11 and items[-2:] == ["Label: Ja", "Label: Vet ej"]
