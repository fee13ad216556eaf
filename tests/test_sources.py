import json

import pytest

from evispark import config
from evispark.__main__ import main
from evispark.plans import pipelines
from evispark.sources import files, replay
from evispark.streaming import audit


def test_entities(spark, tmp_path):
    f = tmp_path / "e.csv"
    f.write_text("﻿id,name,domains,seeds\n0180,Stad, .A.se; b.se ;,https://a.se/\n", encoding="utf-8")
    assert [tuple(r) for r in files.read_entities(spark, str(f)).collect()] == [("0180", "Stad", ["a.se", "b.se"], ["https://a.se/"])]
    for bad in ("id,name,domains,seeds\n", "id,name,domains,seeds\n1,a,,\n1,b,,\n", "id,name,domains,seeds\na b,x,,\n"):
        f.write_text(bad)
        with pytest.raises(ValueError):
            files.read_entities(spark, str(f)).collect()


@pytest.fixture
def exports(tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.csv").write_text('id,title,text,date\n1,Hemtjänst,"Personalen ska behärska\nsvenska",2022-01-01\n', encoding="utf-8")
    (folder / "sub" / "b.jsonl").write_text('{"notice_id": "2", "date": "2023", "n": 5}\n\n', encoding="utf-8")
    (folder / "c.json").write_text(json.dumps({"notices": [{"id": "3", "cpv": ["85311100"]}], "results": []}), encoding="utf-8")
    (folder / "d.json").write_text(json.dumps([{"id": "4"}]), encoding="utf-8")
    (folder / "e.json").write_text(json.dumps({"id": "5"}), encoding="utf-8")
    (folder / "skip.txt").write_text("x")
    return folder


def test_rows_of_mixed_files(spark, exports):
    rows = files.read_rows(spark, str(exports))
    assert {"id", "notice_id", "title", "text", "n", "cpv"} <= set(rows.columns)
    assert sorted(r["id"] or r["notice_id"] for r in rows.collect()) == ["1", "2", "3", "4", "5"]
    with pytest.raises(ValueError):
        files.read_rows(spark, str(exports / "none"))


def test_run_is_sealed_and_tampering_found(spark, exports, tmp_path):
    out = tmp_path / "out"
    years = {r["year"]: r["n_notices"] for r in pipelines.analyze(spark, str(exports), str(out), "x").collect()}
    assert years == {2022: 1, 2023: 1, None: 3}
    assert pipelines.verify(spark, str(out)).collect() == []
    target = next((out / "year_summary").glob("*.json"))
    target.write_text(target.read_text() + " ")
    (target.parent / f".{target.name}.crc").unlink()
    assert [r["found"] is not None for r in pipelines.verify(spark, str(out)).collect()] == [True]
    assert main(["verify", str(out)]) == 2
    assert main(["analyze", str(exports), str(tmp_path / "out2"), "--source", "x", "--elderly-care-only"]) == 2
    assert main(["analyze", str(tmp_path / "none"), str(tmp_path / "o3"), "--source", "x"]) == 1


def test_confined(tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "f").write_text("x")
    (tmp_path / "g").write_text("x")
    assert files.confined(str(tmp_path / "r"), "f").endswith("f")
    for bad in ("../g", "missing", "."):
        with pytest.raises(ValueError):
            files.confined(str(tmp_path / "r"), bad)


def test_seeds_and_config(spark, tmp_path):
    (tmp_path / "s.txt").write_text(" https://a.se/ \n# x\n\nhttp://b.se\n")
    assert [r["url"] for r in files.read_seeds(spark, str(tmp_path / "s.txt")).collect()] == ["https://a.se/", "http://b.se"]
    (tmp_path / "c.yaml").write_text("a: [1, 2]\n")
    assert files.read_config(str(tmp_path / "c.yaml")) == {"a": [1, 2]}


def test_replayed_services(spark, tmp_path):
    replay.register(spark)
    (tmp_path / "urls.txt").write_text("https://a.se/1\nhttps://b.se/2\nhttps://a.se/1\n")
    (tmp_path / "store.jsonl").write_text(json.dumps({"url": "https://a.se/1", "status": 200, "content_type": "text/html", "body": "<p>å"}) + "\n")
    df = spark.read.format("replay_http").option("urls", str(tmp_path / "urls.txt")).option("store", str(tmp_path / "store.jsonl")).load()
    got = {r["url"]: (r["status"], r["error"]) for r in df.collect()}
    assert got == {"https://a.se/1": (200, None), "https://b.se/2": (None, "not in the cache")}
    assert [r["status"] for r in df.where("url = 'https://a.se/1'").collect()] == [200]
    (tmp_path / "pages.json").write_text(json.dumps({"": {"notices": [{"a": 1}, {"a": 2}], "iterationNextToken": "t1"}, "t1": {"notices": [{"a": 3}], "iterationNextToken": "t2"}, "t2": {"notices": []}}))
    load = lambda **o: [r["notice"] for r in spark.read.format("replay_pages").options(store=str(tmp_path / "pages.json"), **o).load().collect()]
    assert load() == ['{"a": 1}', '{"a": 2}', '{"a": 3}'] and load(max_pages="1") == ['{"a": 1}', '{"a": 2}']


def test_collect(spark):
    entities = spark.createDataFrame([("m", ["a.se"]), ("tom", ["b.se"])], "id string, domains array<string>")
    page = "<html><title>T</title><body><main>" + "Text om krav. " * 20 + "</main></body></html>"
    rows = [
        ("m", "https://a.se/1", "https://a.se/1", page, "text/html", "h1", None),
        ("m", "https://a.se/2", "https://A.se/1#x", page, "text/html", "h1", None),
        ("m", "https://a.se/404", "https://a.se/404", page, "text/html", "h2", None),
        ("m", "https://a.se/3", "https://evil.se/", page, "text/html", "h3", None),
        ("m", "https://a.se/4", None, None, None, None, "offline"),
        ("m", "https://a.se/5", "https://a.se/5", "x", "text/plain", "h5", None),
    ]
    out = pipelines.collect(spark.createDataFrame(rows, "municipality_id string, requested_url string, url string, html string, content_type string, sha256 string, error string"), entities, 100, 20)
    assert {r["url"] for r in out["documents"].collect()} == {"https://a.se/1", "https://a.se/404", "https://a.se/5"}
    assert len({r["document_id"] for r in out["chunks"].collect()}) == 1
    assert {r["detail"] for r in out["errors"].collect()} == {"outside the entity's domains", "offline", "unsupported"}
    assert [tuple(r) for r in out["gaps"].collect()] == [("tom", "no_documents_retrieved")]


def test_streams(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "1.json").write_text("".join(json.dumps({"event_no": n, "timestamp": f"2024-01-01T00:{n:02d}:00", "stage": "fetch"}) + "\n" for n in (1, 2, 2, 3)))
    stream = audit.with_late_data(audit.read_log(spark, str(log)), "timestamp", "1 day", ["event_no"])
    for extra in (None, 4):
        if extra:
            (log / "2.json").write_text(json.dumps({"event_no": extra, "timestamp": "2024-01-01T02:00:00", "stage": "llm"}) + "\n")
        audit.append(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        got = sorted(r["event_no"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
        assert got == [1, 2, 3] + ([4] if extra else [])
    batch = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["n"] for r in audit.sessions(batch, "timestamp", "stage", "30 minutes").collect()) == [1, 3]


STUDY = {"research": {"question": "Q", "labels": {"Ja": {"description": "yes"}, "Vet ej": {"description": "?", "conclusive": False}}, "unknown_label": "Vet ej"}}


def test_configuration_is_checked(tmp_path):
    good = config.check(STUDY)
    assert good.discovery.max_documents == 20 and good.extraction.chunk_chars == 14_000 and good.llm.passes == 3 and good.network.respect_robots is True
    (tmp_path / "c.json").write_text(json.dumps({**STUDY, "llm": {"passes": 5}}))
    assert config.load(str(tmp_path / "c.json")).llm.passes == 5
    r = STUDY["research"]
    bad = [
        {}, {**STUDY, "x": {}}, {**STUDY, "llm": {"y": 1}}, {**STUDY, "llm": {"passes": 0}}, {**STUDY, "llm": {"passes": True}}, {**STUDY, "llm": {"models": []}}, {**STUDY, "network": {"timeout_seconds": 0}},
        {**STUDY, "discovery": {"provider": "x"}}, {**STUDY, "extraction": {"chunk_chars": 100, "overlap_chars": 100}}, {"research": {**r, "unknown_label": "Nej"}}, {"research": {**r, "unknown_label": "Ja"}},
        {"research": {**r, "labels": {**r["labels"], "Review": {"description": "x"}}}}, {"research": {**r, "labels": {**r["labels"], "Tid": {"description": "x", "requires_before_cutoff": True}}}}, {"research": {**r, "labels": []}},
    ]
    for given in bad:
        with pytest.raises(ValueError):
            config.check(given)
    assert str(config.check({"research": {**r, "cutoff": "2024-05-01", "labels": {**r["labels"], "Tid": {"description": "x", "requires_before_cutoff": True}}}}).research.cutoff) == "2024-05-01"


class Echo:
    """A transport for the test below."""

    def __init__(self, options):
        self.status = int(options["status"])

    def fetch(self, url):
        return {"status": self.status, "content_type": "text/plain", "body": url}


def test_any_transport_plugs_in(spark, tmp_path):
    replay.register(spark)
    (tmp_path / "urls.txt").write_text("https://a.se/1\nhttps://b.se/2\n")
    df = spark.read.format("replay_http").options(urls=str(tmp_path / "urls.txt"), provider="tests.test_sources:Echo", status="203").load()
    assert {(r["url"], r["status"], bytes(r["body"]).decode()) for r in df.collect()} == {(u, 203, u) for u in ("https://a.se/1", "https://b.se/2")}


def test_collect_only_run(spark, tmp_path):
    entities = spark.createDataFrame([("m", ["a.se"]), ("tom", ["b.se"])], "id string, domains array<string>")
    page = "<html><title>T</title><body><main>" + "Text om krav. " * 20 + "</main></body></html>"
    rows = [("m", "https://a.se/1", "https://a.se/1", page, "text/html", "h1", None)]
    downloads = spark.createDataFrame(rows, "municipality_id string, requested_url string, url string, html string, content_type string, sha256 string, error string")
    counts = pipelines.collect_run(spark, downloads, entities, str(tmp_path / "run"), chunk_chars=100, overlap_chars=20)
    assert counts["documents"] == 1 and counts["chunks"] > 1 and counts["gaps"] == 1
    told = json.loads((tmp_path / "run" / "manifest.json").read_text())
    assert told["status"] == "completed_with_gaps" and told["counts"] == counts and told["environment"]["pyspark"]
    assert pipelines.verify(spark, str(tmp_path / "run")).collect() == []
    assert pipelines.collect_run(spark, downloads, entities, str(tmp_path / "first"), limit=1, chunk_chars=100, overlap_chars=20)["gaps"] == 0
    with pytest.raises(ValueError):
        pipelines.collect_run(spark, downloads, entities, str(tmp_path / "none"), limit=0)
    pipelines.export({"v": spark.createDataFrame([("a\x01b", 1)], "t string, n int")}, str(tmp_path / "views"), "csv")
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "views" / "v")).collect()] == [("a b", "1")]
