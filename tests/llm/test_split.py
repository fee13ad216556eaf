import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evispark.llm import split


def pieces(text, limit, overlap):
    cuts, ranks = split.find_boundaries(text)
    return list(split.choose_cuts(zip(cuts, ranks), len(text), limit, overlap))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. \n\f!å", max_size=400), st.integers(10, 60), st.data())
def test_pieces_cover_and_overlap(text, limit, data):
    overlap = data.draw(st.integers(0, limit // 2 - 1))
    found = pieces(text, limit, overlap)
    assert found[0][0] == 0 and found[-1][1] == len(text)
    for (a, b), (c, d) in zip(found, found[1:]):
        assert c == b - overlap and d > b
    assert all(b - a <= limit for a, b in found)


def test_best_boundary_wins():
    text = "a" * 60 + "\n\n" + "b" * 10 + ". " + "c" * 100
    assert pieces(text, 100, 10)[0] == (0, 62)
    assert pieces("x" * 60 + ". " + "y" * 20 + " " + "z" * 60, 100, 10)[0] == (0, 62)
    assert pieces("x" * 300, 100, 10)[0] == (0, 100)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab. \n\f\t)!'", max_size=120), st.integers(1, 30))
def test_ranges_of_any_size_find_the_same_boundaries(text, size):
    ranges = [split.range_boundaries(text[k : k + size]) for k in range(0, len(text), size)]
    got, carry = [], split.Carry()
    for k, (cuts, ranks, edges) in enumerate(ranges):
        goes_on = k + 1 < len(ranges) and ranges[k + 1][2].begins_line
        got += [(k * size + c, r) for c, r in zip(*split.in_context(cuts, ranks, edges, carry, goes_on))]
        carry = split.carry_on(carry, edges)
    assert got == list(zip(*split.find_boundaries(text)))


def test_a_long_blank_line_is_one_boundary():
    text = "Ett.\n" + " " * 60 + "\nTvå"
    assert dict(zip(*split.find_boundaries(text)))[66] == 4


def test_items(make_chunks):
    rng = random.Random(5)
    long = "".join(rng.choice(["ord ", "Mening. ", "Rad\n", "å😀", "Stycke.\n\n"]) for _ in range(4000))
    rows = [("a", "d", 100, 100 + len(long), long)] * 3 + [("b", "d", 0, 5, "kort."), ("b", "d", 0, 5, "kort."), ("n", "d", None, None, None), ("e", "d", 0, 0, ""), (None, "d", 0, 9, "y" * 2401), ("f", "d", 0, 2400, "z" * 2400)]
    chunks = make_chunks(rows, extra=True)
    for size in (1 << 20, 1000):
        got = split.split_items(chunks, range_size=size).collect()
        a = sorted((r["piece_no"], r["start"], r["end"], r["text"]) for r in got if r["id"] == "a")
        assert [(s - 100, e - 100) for _, s, e, _ in a] == pieces(long, 2400, 300)
        assert all(t == long[s - 100 : e - 100] for _, s, e, t in a)
        assert [(r["start"], r["end"], r["text"]) for r in got if r["id"] == "b"] == [(0, 5, "kort.")]
        assert [(r["start"], r["end"], r["text"]) for r in got if r["id"] == "n"] == [(0, 0, None)]
        assert sum(r["id"] is None for r in got) == 2
    assert {r["id"] for r in split.oversized(chunks).collect()} == {"a", None}
    assert split.split_items(make_chunks([])).collect() == split.oversized(make_chunks([])).collect() == []


def test_bad_overlap(make_chunks):
    with pytest.raises(ValueError):
        split.split_items(make_chunks([]), limit=100, overlap=50)


def _files(spark, tmp_path, text, range_bytes, limit=150, overlap=20):
    (tmp_path / "a.txt").write_bytes(text.encode())
    (tmp_path / "b.txt").write_bytes(b"kort")
    (tmp_path / "c.txt").write_bytes(b"")
    got = split.split_files(spark, [str(tmp_path / f"{x}.txt") for x in "abc"], limit, overlap, range_bytes=range_bytes).collect()
    assert [(r["piece_no"], r["start"], r["end"], r["text"]) for r in got if r["path"].endswith("b.txt")] == [(0, 0, 4, "kort")]
    a = sorted((r["piece_no"], r["start"], r["end"], r["text"]) for r in got if r["path"].endswith("a.txt"))
    assert [n for n, *_ in a] == list(range(len(a)))
    assert all(t == text[s:e] for _, s, e, t in a)
    return [(s, e) for _, s, e, _ in a]


@pytest.mark.parametrize("group", [1, 2, 256])
def test_files(spark, tmp_path, monkeypatch, group):
    monkeypatch.setattr(split, "GROUP", group)
    rng = random.Random(7)
    text = "".join(rng.choice(["ord ", "Mening. ", "Rad\n", "åäö", "😀", "Stycke.\n\n", "\n" + " " * 20 + "\n"]) for _ in range(1200))
    for range_bytes in (777, 4000, 1 << 20):
        assert _files(spark, tmp_path, text, range_bytes) == pieces(text, 150, 20)


def test_files_without_boundaries(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(split, "GROUP", 2)
    for text in ("x" * 5000, "å" * 3001 + " " * 40):
        assert _files(spark, tmp_path, text, 700) == pieces(text, 150, 20)


def test_a_table_as_files(spark):
    rows = [(k, f"Text {k}. " * 50, "x") for k in range(40)] + [(99, None, "x"), (98, "", "x")]
    got = split.split_table_as_files(spark.createDataFrame(rows, "doc_id bigint, text string, file string"), limit=300, overlap=40, range_bytes=4000, files=2).collect()
    for f in (0, 1):
        mine = sorted((r["piece_no"], r["start"], r["end"], r["text"]) for r in got if r["file"] == f)
        assert mine[0][1] == 0 and all(len(t) == e - s <= 300 for _, s, e, t in mine)
        assert all(b[1] == a[2] - 40 and a[3][-40:] == b[3][:40] for a, b in zip(mine, mine[1:]))
