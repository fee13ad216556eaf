from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evispark.llm import pack, tokens


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60)), st.integers(40, 90))
def test_patterns_hold_every_item_once(histogram, capacity):
    patterns = pack.pack_histogram(histogram, capacity)
    got = Counter()
    for lengths, count in patterns:
        assert sum(lengths) <= capacity and count > 0
        for n in lengths:
            got[n] += count
    assert got == Counter(histogram)


def test_little_space_is_left():
    histogram = {n: 50 + n % 7 for n in range(1, 513)}
    patterns = pack.pack_histogram(histogram, 2048)
    used = sum(n * c for n, c in histogram.items())
    assert used / (2048 * sum(c for _, c in patterns)) > 0.99


def test_assignment(spark):
    sizes = [(k, (k * 37) % 250) for k in range(500)] + [(1000, 1001), (1001, None), (1002, 0), (7, 9), (7, 9), (None, 5)]
    df = spark.createDataFrame([(d, n, "x", 1) for d, n in sizes], "doc_id bigint, n_tokens bigint, length string, bucket int")
    got = pack.pack(df, 300).collect()
    fill = defaultdict(int)
    for r in got:
        assert (r["container_id"] is None) == (r["token_end"] == r["token_start"])
        if r["container_id"] is not None:
            fill[r["container_id"]] += r["token_end"] - r["token_start"]
    assert max(fill.values()) <= 300 and set(fill) == set(range(len(fill)))
    assert sum(fill.values()) == sum(n or 0 for _, n in sizes)
    assert sorted((r["token_start"], r["token_end"]) for r in got if r["doc_id"] == 1000) == [(0, 300), (300, 600), (600, 900), (900, 1001)]
    assert all(r["piece_no"] == 0 for r in got if r["doc_id"] != 1000)
    assert len(got) == len(sizes) + 3
    assert pack.pack(df.limit(0), 300).collect() == []
    with pytest.raises(ValueError):
        pack.pack(df, 0)


def test_hot_length_is_ranked_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(pack, "BUCKET_ITEMS", 10)
    df = spark.range(1000).selectExpr("id as doc_id", "cast(10 as bigint) as n_tokens")
    got = pack.pack(df, 100).groupBy("container_id").count().collect()
    assert len(got) == 100 and {r["count"] for r in got} == {10}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab åÄ1.,'\n\t  -–", max_size=60))
def test_counts_are_the_tokenizers(text):
    path = f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}"
    assert tokens.Counter(path).count(text) == len(tokens.encoding(path).encode_ordinary(text))
