import random
from collections import defaultdict

import numpy as np

from evispark.llm import spans


def brute(texts):
    where = defaultdict(set)
    for d, t in texts:
        if t is not None and d is not None:
            for p in range(len(t) - spans.SPAN + 1):
                where[t[p : p + spans.SPAN]].add(d)
    pairs = {(a, b) for s in where.values() for a in s for b in s if a < b}
    shared = defaultdict(set)
    for d, t in texts:
        if t is not None and d is not None:
            for p in range(len(t) - spans.SPAN + 1):
                if len(where[t[p : p + spans.SPAN]]) > 1:
                    shared[d].update(range(p, p + spans.SPAN))
    return pairs, {d: len(s) for d, s in shared.items()}


def corpus(rng, hot=30):
    word = lambda n: "".join(rng.choice("abcdefgh åäö😀\n") for _ in range(n))
    notice = word(150)
    passage, exact, near = word(450), word(200), word(199)
    texts = []
    for k in range(60):
        t = word(rng.randint(0, 700))
        if k % 5 == 0:
            at = rng.randint(0, len(t))
            t = t[:at] + passage[rng.randint(0, 100) : rng.randint(330, 450)] + t[at:]
        if k % 7 == 0:
            t += exact
        if k % 7 == 1:
            t = near + t
        texts.append((k, t))
    # an anchor that many texts share with different surroundings
    texts += [(100 + k, word(120) + notice + ("X" * 60 if k % 2 else word(60)) + word(80)) for k in range(hot)]
    texts += [(200 + k, texts[3][1] + word(300)[:0] + passage) for k in range(4)]
    return texts


def test_anchors_guarantee():
    rng = random.Random(2)
    shared = "".join(rng.choice("abc ") for _ in range(spans.SPAN))
    for _ in range(50):
        a = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 300))) + shared
        b = shared + "".join(rng.choice("abc ") for _ in range(rng.randint(0, 300)))
        x, y = (set(spans.anchors(spans._codes(t))[1].tolist()) for t in (a, b))
        assert x & y
    assert len(spans.anchors(np.zeros(0, np.uint32))[0]) == 0


def test_against_brute_force(spark):
    texts = corpus(random.Random(4))
    rows = texts + texts[:5] + [(900, None), (None, "q" * 300), (901, ""), (902, "z" * 5000), (903, "z" * 250), (904, "kort")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id bigint, text string, cls int, anchor string")
    found = spans.shared_spans(df)
    pairs, shared = brute(rows)
    got = [(r["doc_id_a"], r["doc_id_b"]) for r in found.pairs().collect()]
    assert set(got) == pairs and len(got) == len(pairs)
    report = {r["doc_id"]: r["shared_chars"] for r in found.shared().collect()}
    assert {d: n for d, n in report.items() if n} == shared
    assert set(report) == {d for d, t in rows if t and d is not None and len(t) >= spans.SPAN}


def test_batches_give_what_one_batch_gives(spark, monkeypatch):
    monkeypatch.setattr(spans, "MOST_RUNS", 2)
    texts = corpus(random.Random(5), hot=8)
    schema = "doc_id bigint, text string"
    index = spans.SpanIndex(spark)
    pairs = set()
    for k in range(4):
        index.ingest(spans.texts_of(spark.createDataFrame(texts[k::4], schema)))
    before = {tuple(r) for r in index.shared().collect()}
    after = index.ingest(spans.texts_of(spark.createDataFrame([(999, "w" * 10)], schema)))
    assert before and {tuple(r) for r in after.collect()} == before  # too short to share anything
    # the last batch sees the older ones
    last = [(500, texts[5][1] + "åå")]
    hits = index.ingest(spans.texts_of(spark.createDataFrame(last, schema)))
    whole = spans.texts_of(spark.createDataFrame(texts + last, schema))
    pairs = {(r["doc_id_a"], r["doc_id_b"]) for r in spans.SharedSpans(whole, hits).pairs().collect()}
    want = {p for p in brute(texts + last)[0] if 500 in p}
    assert want <= pairs <= brute(texts + last)[0]


def test_a_third_are_copies(spark):
    copy = "En lång text. " * 30
    rows = [(k, copy if k % 3 == 0 else f"{k} " * 60) for k in range(60)]
    found = spans.shared_spans(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {(r[0], r[1]) for r in found.pairs().collect()} == brute(rows)[0]
    assert {r["class_id"] for r in found.shared().collect() if r["doc_id"] % 3 == 0} == {0}


def test_empty(spark):
    found = spans.shared_spans(spark.createDataFrame([], "doc_id bigint, text string"))
    assert found.pairs().collect() == found.shared().collect() == []


def test_batches_mark_the_rows_that_one_batch_marks(spark, monkeypatch):
    monkeypatch.setattr(spans, "MOST_RUNS", 2)
    texts = corpus(random.Random(6), hot=8)
    frame = lambda rows: spans.texts_of(spark.createDataFrame(rows, "doc_id bigint, text string"))
    index, marked = spans.SpanIndex(spark), []
    for batch in (texts[::4], [(999, "w" * 10)], texts[1::4], texts[2::4], texts[3::4]):
        marked.append({tuple(r) for r in index.ingest(frame(batch)).collect()})
    assert len(index.runs) < 5
    assert marked[0] == marked[1]  # too short to add anything
    assert marked[-1] and marked[-1] == {tuple(r) for r in spans.SpanIndex(spark).ingest(frame(texts)).collect()}


def test_an_index_is_opened_again(spark, tmp_path):
    texts = corpus(random.Random(7), hot=8)
    frame = lambda rows: spans.texts_of(spark.createDataFrame(rows, "doc_id bigint, text string"))
    spans.SpanIndex(spark, str(tmp_path), buckets=3).ingest(frame(texts[::2]))
    again = spans.SpanIndex(spark, str(tmp_path))
    assert (again.buckets, again.batches, len(again.runs)) == (3, 1, 1)
    again.ingest(frame(texts[1::2]))
    again.compact()
    assert len(again.runs) == 1
    third = spans.SpanIndex(spark, str(tmp_path))
    assert {tuple(r) for r in third.shared().collect()} == {tuple(r) for r in spans.SpanIndex(spark).ingest(frame(texts)).collect()}


def test_older_runs_are_not_moved(spark, tmp_path):
    frame = lambda rows: spans.texts_of(spark.createDataFrame(rows, "doc_id bigint, text string"))
    texts = corpus(random.Random(8), hot=2)
    index = spans.SpanIndex(spark, str(tmp_path), buckets=4)
    index.ingest(frame(texts[::2]))
    index.ingest(frame(texts[1::2]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index.merged(index.runs[1], index.runs[:1])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_batches_of_a_whole_collection(spark):
    rows = corpus(random.Random(9), hot=30)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = spans.shared_spans(df, batches=3)
    pairs, shared = brute(rows)
    assert {tuple(r) for r in found.pairs().collect()} == pairs
    assert {r["doc_id"]: r["shared_chars"] for r in found.shared().collect() if r["shared_chars"]} == shared


def test_classes_are_verified(spark):
    texts = spark.createDataFrame([(1, "a", 7), (2, "a", 7), (3, "b", 8)], "doc_id int, text string, cls bigint")
    assert not spans.classes_clash(texts)
    assert spans.classes_clash(texts.unionAll(spark.createDataFrame([(4, "c", 7)], "doc_id int, text string, cls bigint")))
