from evispark.llm import mix


def test_plan():
    available = {"a": (1000, 10), "b": (100, 2), "d": (50, 1)}
    plans = {p.source: p for p in mix.plan([("a", 0.5, 2), ("b", 0.3, 3), ("c", 0.2, 9)], available)}
    # b reaches 300 tokens at most: the mix is as large as that allows, c's share is spread
    assert round(plans["b"].wanted_tokens) == 300 and round(plans["a"].wanted_tokens) == 500 and plans["c"].wanted_tokens == 0
    fixed = {p.source: p for p in mix.plan([("a", 0.5, 2), ("b", 0.5, 3)], available, total=2000)}
    assert round(fixed["b"].wanted_tokens) == 300 and round(fixed["a"].wanted_tokens) == 1700


def test_flight_keeps_totals():
    rows = [("k", i, (i * 37) % 100 + 1, 0.3) for i in range(5000)]
    out = list(mix._flight(iter(rows), 1, True))
    assert {r[3] for r in out} <= {0.0, 1.0} and len(out) == 5000
    want = sum(x * p for _, _, x, p in rows)
    assert abs(sum(r[2] * r[3] for r in out) - want) < 5
    assert abs(sum(r[3] for r in out) - 1500) <= 12


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mix, "BUCKET_RECORDS", 100)
    rows = [(k, "big", 50 + k % 90) for k in range(3000)] + [(5000 + k, "small", 100 + k) for k in range(20)] + [(6000, None, 10), (6001, "other", 10), (6002, "big", None), (6003, "small", 0)]
    sizes = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, source string, n_tokens bigint, pi string")
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.2, 4), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    uses, shares = mix.mix(sizes, targets)
    got = {r["doc_id"]: r["uses"] for r in uses.collect()}
    assert len(got) == len(rows) and got[6000] == got[6001] == 0
    assert all(got[5000 + k] <= 4 for k in range(20)) and all(got[k] <= 1 for k in range(3000))
    by = {r["source"]: r for r in shares.collect()}
    assert by["gone"]["used_tokens"] == 0 and by["gone"]["n_records"] == 0
    assert abs(by["big"]["actual_share"] - 0.7 / 0.9) < 0.003 and abs(by["small"]["actual_share"] - 0.2 / 0.9) < 0.003
    again = {r["doc_id"]: r["uses"] for r in mix.mix(sizes, targets)[0].collect()}
    assert again == got


def test_empty(spark):
    sizes = spark.createDataFrame([], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    uses, shares = mix.mix(sizes, targets)
    assert uses.collect() == [] and [r["actual_share"] for r in shares.collect()] == [0.0]
    assert mix.mix(sizes, targets.limit(0))[1].collect() == []
