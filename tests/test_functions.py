import datetime as dt

import pytest
from pyspark.sql import functions as F

from evispark.functions import dates, html, jsonish, text, urls


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'timestamp' if isinstance(v, dt.datetime) else 'int' if isinstance(v, int) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize(
    "raw,want",
    [(" a\t b \r\n\r\n\r\n\r\nc\x00­ ", "a b\n\nc"), ("å", "å"), ("", ""), (None, None), ("x  y", "x y"), ("\x1c a", "a")],
)
def test_clean_text(spark, raw, want):
    assert text.clean(raw) == want
    assert one(spark, text.clean_text("t"), t=raw) == want


def test_strip_and_collapse(spark):
    assert one(spark, text.strip(F.col("t")), t=" \x1f a b \t\n") == "a b"
    assert one(spark, text.collapse(F.col("t")), t=" a  \n b ") == "a b"


def test_first_filled(spark):
    df = spark.createDataFrame([(" ", None, " x ")], "a string, b string, `c-d` string")
    assert df.select(text.first_filled(["missing", "a", "b", "c-d"], df.columns)).first()[0] == "x"
    assert df.select(text.first_filled(["b"], df.columns)).first()[0] == ""


def test_cells(spark):
    assert one(spark, text.sanitize_cell(F.col("t")), t="a\x01b\nc") == "a b\nc"
    cut = one(spark, text.sanitize_cell(F.col("t")), t="x" * 40_000)
    assert cut == "x" * 31_900 + text.CELL_MARK


def test_canonical_json(spark):
    assert one(spark, text.canonical_json({"b": F.col("t"), "a": F.lit(1)}), t=None) == '{"a":1,"b":null}'


@pytest.mark.parametrize(
    "url,want",
    [
        ("https://TOWN.se/a?q=1#fragment", "https://town.se/a?q=1"),
        (" http://town.se. ", "http://town.se/"),
        ("HTTPS://town.se:443/A%20b?x=/?", "https://town.se/A%20b?x=/?"),
        ("http://town.se:80", "http://town.se/"),
        ("https://town.se/?", "https://town.se/"),
        ("file:///etc/passwd", None),
        ("https://user:pw@town.se/", None),
        ("https://town.se:444/", None),
        ("https:///x", None),
        ("/x", None),
        (None, None),
    ],
)
def test_normalize_url(spark, url, want):
    assert one(spark, urls.normalize_url(F.col("u")), u=url) == want


def test_international_hosts(spark):
    assert one(spark, urls.normalize_url(F.col("u"), international=True), u="https://Åsele.se/x") == "https://xn--sele-poa.se/x"
    assert one(spark, urls.normalize_url(F.col("u")), u="https://Åsele.se/x") is None


@pytest.mark.parametrize("url,want", [("https://town.se/", True), ("https://a.town.se/x", True), ("https://eviltown.se/", False), ("https://town.se.evil.com/", False), (None, False)])
def test_domain_allowed(spark, url, want):
    assert one(spark, urls.domain_allowed(F.col("u"), F.array(F.lit("town.se"))), u=url) is want


def test_keyword_score_and_resolve(spark):
    assert one(spark, urls.keyword_score([F.col("u")], ["språk", "OMSORG", "x y"]), u="https://a/spr%C3%A5k+Omsorg%zz") == 2
    assert one(spark, urls.resolve(F.col("b"), F.col("x")), b="https://a.se/b/c", x="../d?e#f") == "https://a.se/d?e#f"
    assert one(spark, urls.resolve(F.col("b"), F.col("x")), b="https://a.se", x=None) is None


@pytest.mark.parametrize("value,want", [("2024", "2024-12-31"), ("2024-02", "2024-02-29"), ("2023-09-01", "2023-09-01"), ("2024-13", None), ("2024-02-31", None), ("2024-ish", None), ("00", None), (None, None)])
def test_partial_dates(spark, value, want):
    assert str(one(spark, dates.latest_day(F.col("v")), v=value)) == str(want)


def test_cutoff_is_exclusive(spark):
    cutoff = F.to_date(F.lit("2025-01-01"))
    assert one(spark, dates.wholly_before(F.col("v"), cutoff), v="2024") is True
    assert one(spark, dates.wholly_before(F.col("v"), cutoff), v="2025-01-01") is False


@pytest.mark.parametrize("value,want", [("2021-03-04", 2021), ("20210304", None), ("x 2019.", 2019), ("1999", None), ("", None), (None, None)])
def test_year(spark, value, want):
    assert one(spark, dates.year(F.col("v")), v=value) == want


@pytest.mark.parametrize("header,attempt,want", [("3", 0, 3.0), ("-1", 0, 0.0), (None, 2, 4.0), ("soon", 9, 30.0), ("Mon, 01 Jan 2024 00:01:00 GMT", 0, 60.0), ("Sun, 31 Dec 2023 00:00:00 GMT", 0, 0.0)])
def test_retry_delay(spark, header, attempt, want):
    assert one(spark, dates.retry_delay(F.col("h"), F.col("a"), F.col("now")), h=header, a=attempt, now=dt.datetime(2024, 1, 1)) == want


@pytest.mark.parametrize(
    "value,want",
    [(None, ""), (" x ", "x"), (3, "3"), (["a", "", None, "b"], "a | b"), ({"eng": "E", "swe": ["S", "T"]}, "S | T"), ({"swe": "", "eng": "E"}, ""), ({"x": "1", "y": {"sv": "2"}}, "1 | 2")],
)
def test_flatten(value, want):
    assert jsonish.flatten(value) == want


def test_addresses_in_order():
    assert jsonish.addresses({"a": ["se https://b.se/x och", "http://a.se"], "b": "https://b.se/x"}) == ["https://b.se/x", "http://a.se"]


def test_html_tree():
    root = html.parse("<title>A &amp; B</title><body><nav>meny</nav><p>ett<p>två <b>tre</b><script>x</script><a href='b c'>l</a><td>")
    assert html.title(root) == "A & B"
    assert html.main_text(root) == "ett\ntvå\ntre\nl"
    assert html.links(root, "https://x.se/y/") == [("https://x.se/y/b c", "l")]
    assert html.parse(b"\xff<<<").text() is not None
    assert html.body_text(b" %PDF-1.4", "") == ("pdf", "") and html.body_text(b"x", "text/plain") == ("unsupported", "") and html.body_text(None, None) == ("unsupported", "")


def test_labels():
    root = html.parse("<dl><dt>Diarienummer:</dt><dd>SN 1</dd></dl><p><strong>Startdatum</strong> : 2024</p>")
    said = html.label_values(root)
    assert said["diarienummer"] == "SN 1" and said["startdatum"] == "2024" and "x" not in said
