import json
import logging

import pytest

from tidemark import config, logship
from tidemark.api.http import Api
from tidemark.engine import Engine
from tidemark.server import assemble
from tidemark.sources.scrape import Target
from tidemark.store import Store
from tidemark.streaming import ingest, retention
from tidemark.streaming.gate import PushGate
from tidemark.streaming.scraper import Scraper

SCHEMA = "labels map<string,string>, t long, v double"


@pytest.fixture(scope="module")
def api(spark):
    rows = [({"__name__": "m", "a": "x"}, 1000 * i, float(i)) for i in range(5)]
    return Api(Engine(Store.of_rows(spark.createDataFrame(rows, SCHEMA))), now=lambda: 4.0)


def get(api, path, query=""):
    status, _, body = api.handle("GET", path, query)
    return status, json.loads(body)


def test_queries_over_http(api):
    assert get(api, "/api/v1/query", "query=m&time=3")[1]["data"] == {"resultType": "vector", "result": [{"metric": {"__name__": "m", "a": "x"}, "value": [3.0, "3"]}]}
    assert get(api, "/api/v1/query", "query=1/0")[1]["data"] == {"resultType": "scalar", "result": [4.0, "+Inf"]}
    assert get(api, "/api/v1/query_range", "query=m&start=0&end=2&step=1s")[1]["data"]["result"][0]["values"] == [[0.0, "0"], [1.0, "1"], [2.0, "2"]]
    assert get(api, "/api/v1/series", "match[]=m&start=0&end=5")[1]["data"] == [{"__name__": "m", "a": "x"}]
    assert get(api, "/api/v1/labels")[1]["data"] == ["__name__", "a"] and get(api, "/api/v1/label/a/values")[1]["data"] == ["x"]
    for path, query in (("/api/v1/query", "query=m{"), ("/api/v1/query_range", "query=m&start=0&end=2"), ("/api/v1/query", "query=m&time=nan"), ("/api/v1/series", "")):
        assert get(api, path, query)[0] == 400
    assert get(api, "/api/nothing")[0] == 404 and api.handle("POST", "/metrics")[0] == 405
    assert "tidemark_queries_total" in api.handle("GET", "/metrics")[2]


def test_a_stream_into_a_store(spark, tmp_path):
    path, source = str(tmp_path / "store"), str(tmp_path / "in")
    spark.createDataFrame([({"__name__": "m"}, 1000, 1.0), ({"__name__": "m"}, 2000, 2.0)], SCHEMA).write.json(source)
    for _ in range(2):
        stream = spark.readStream.schema(SCHEMA).json(source)
        ingest.start(stream, path, str(tmp_path / "check"), once=True).awaitTermination(120)
        spark.createDataFrame([({"__name__": "m"}, 1000, 9.0), ({"__name__": "n"}, 500, 3.0)], SCHEMA).write.mode("append").json(source)
    store = Store.read(spark, path)
    assert sorted((r.t, r.v) for r in store.samples.collect()) == [(500, 3.0), (1000, 1.0), (2000, 2.0)]
    assert [(r.key, r.v) for r in Engine(store).instant("m", 2000).frame.collect()] == [("m", 2.0)]
    rows = spark.createDataFrame([({"__name__": f"x{i}"}, 1, 1.0, i) for i in range(3)], SCHEMA + ", arrival long")
    assert not ingest.append(rows, path, max_series=4) and ingest.append(rows, path, max_series=5)


def test_a_batch_is_worked_out_once(spark, tmp_path):
    seen, path = spark.sparkContext.accumulator(0), str(tmp_path / "store")

    def noted(row):
        seen.add(1)
        return row

    def batch(points):
        return spark.createDataFrame(spark.sparkContext.parallelize(points, 2).map(noted), SCHEMA + ", arrival long")

    assert ingest.append(batch([({"__name__": "m"}, t, float(t), t) for t in range(6)]), path) and seen.value == 6
    late = [({"__name__": "m"}, 5, -1.0, 0), ({"__name__": "m"}, 6, 6.0, 1), ({"__name__": "n"}, 7, 1.0, 2), ({"__name__": "n"}, 7, 2.0, 3)]
    assert ingest.append(batch(late), path) and seen.value == 10
    store = Store.read(spark, path)
    assert sorted((r.t, r.v) for r in store.samples.collect()) == [*((t, float(t)) for t in range(7)), (7, 1.0)]
    assert sorted(r.key for r in store.series.collect()) == ["m", "n"]
    assert not ingest.append(batch([({"__name__": "o"}, 1, 1.0, 0)]), path, max_series=2) and seen.value == 11


def test_pushes_over_http(spark, tmp_path):
    gate = PushGate(spark, str(tmp_path / "store"), token="secret", sample_limit=3, max_body=2000, max_series=2, now=lambda: 5.0)
    api = Api(Engine(Store.of_rows(spark.createDataFrame([], SCHEMA))), gate=gate)

    def push(body, token="secret"):
        status, _, text = api.handle("POST", "/api/v1/push", "", body if isinstance(body, str) else json.dumps(body), f"Bearer {token}", "10.0.0.1")
        return status, json.loads(text)

    one = {"job": "j", "series": [{"name": "m", "value": 1.5}, {"name": "n", "samples": [{"timestamp_ms": 1000, "value": 2}]}]}
    assert push(one) == (200, {"status": "success", "data": {"samplesAppended": 2, "seriesTouched": 2}})
    assert push(one, "wrong")[0] == 401 and push("{")[0] == 400 and push({"job": "j" * 3000})[0] == 413
    assert push({"job": "j", "series": [{"name": "m", "samples": [{"timestamp_ms": t, "value": 1} for t in range(1, 5)]}]})[0] == 400
    assert push({"job": "j", "series": [{"name": "third", "value": 1}]})[0] == 503
    sources = json.loads(api.handle("GET", "/api/v1/push/sources")[2])["data"]
    assert [(s["job"], s["instance"], s["pushesTotal"], s["samplesTotal"], s["lastError"]) for s in sources] == [("j", "10.0.0.1", 3, 2, "too many series")]
    assert sorted((r.t, r.v) for r in Store.read(spark, str(tmp_path / "store")).samples.collect()) == [(1000, 2.0), (5000, 1.5)]
    text = api.exposition()
    assert 'tidemark_push_requests_total{status="error"} 5' in text and "tidemark_push_samples_appended_total 2" in text and "tidemark_push_series_rejected_total 1" in text


def test_scraping_into_a_store(spark, tmp_path):
    path, clock = str(tmp_path / "store"), [10.0]
    good, bad = Target.of("web", "good:1"), Target.of("web", "bad:1")

    def get(target):
        if target.instance == "bad:1":
            raise OSError("no reply")
        return 'm{a="x"} 1 99\nbroken line\nn 2\n'

    scraper = Scraper(spark, path, [(good, 15.0), (bad, 15.0)], get, max_series=8, now=lambda: clock[0])
    scraper.once([good, bad])
    api = Api(Engine(Store.read(spark, path)), scraper=scraper)
    told = {t["instance"]: t for t in json.loads(api.handle("GET", "/api/v1/targets")[2])["data"]}
    assert told["good:1"]["up"] and told["good:1"]["samplesScraped"] == 2 and told["good:1"]["lastError"] and not told["bad:1"]["up"] and told["bad:1"]["lastError"] == "no reply"
    vector = lambda query: sorted((r.labels["instance"], r.v) for r in Engine(Store.read(spark, path)).instant(query, int(clock[0] * 1000)).frame.collect())
    assert vector("up") == [("bad:1", 0.0), ("good:1", 1.0)] and vector("m") == [("good:1", 1.0)]
    # three more series do not fit beside the eight there are: the target is down, the others go on
    clock[0] = 20.0
    scraper.once([Target.of("web", "late:1"), good])
    told = {t["instance"]: t for t in scraper.targets()}
    assert told["late:1"]["lastError"] == "too many series" and not told["late:1"]["up"] and told["good:1"]["up"]
    assert vector("m") == [("good:1", 1.0)] and {r.t for r in Store.read(spark, path).samples.collect()} == {10_000, 20_000}


def test_retention_deletes_files(spark, tmp_path):
    path, day = str(tmp_path / "store"), 86_400_000
    rows = [({"__name__": "old"}, day // 2, 1.0), ({"__name__": "m"}, day + 1, 2.0), ({"__name__": "m"}, 3 * day + 5, 3.0), ({"__name__": "m"}, 3 * day + 9, 4.0)]
    Store.of_rows(spark.createDataFrame(rows, SCHEMA)).write(path)
    days = lambda: sorted(p.name for p in (tmp_path / "store" / "samples").iterdir() if p.name.startswith("day="))
    assert len(days()) == 3 and retention.enforce(spark, path, 3 * day + 7) == 2 and days() == ["day=1970-01-04"]
    left = Store.read(spark, path, 3 * day + 7)
    assert [r.t for r in left.samples.collect()] == [3 * day + 9] and [r.key for r in left.series.collect()] == ["m"]
    assert retention.enforce(spark, path, 3 * day + 7) == 0 and retention.enforce(spark, path, 9 * day) == 1
    assert Store.read(spark, path).samples.count() == 0 and Store.read(spark, path).series.count() == 0
    assert retention.enforce(spark, str(tmp_path / "none"), 5) == 0


def test_a_server_from_a_configuration(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("TOKEN", "t")
    (tmp_path / "password").write_text(" pw \n")
    text = f"""
storage: {{path: {tmp_path}/store, retention: 2h}}
push: {{auth_token: abc}}
scrape_configs:
  - job_name: web
    scrape_timeout: 3s
    static_configs: [{{targets: ["a:1", "https://b/x"]}}]
    basic_auth: {{username: "${{USER_NAME:-me}}", password_file: "{tmp_path}/password"}}
alerting:
  datasources: [{{name: far, url: "http://far", authorization: {{credentials: "${{TOKEN}}"}}}}]
"""
    server = assemble(spark, config.parsed(text))
    targets = server.api.scraper._rounds[15.0]
    assert [(t.url, t.timeout_s, t.auth.user, t.auth.password) for t in targets] == [("http://a:1/metrics", 3.0, "me", "pw"), ("https://b/x", 3.0, "me", "pw")]
    assert [(d.name, d.credentials, d.editable) for d in server.api.alerts.store.datasources()] == [("builtin", "", False), ("far", "t", False)]
    assert json.loads(server.api.handle("GET", "/api/v1/query", "query=vector(1)")[2])["data"]["result"][0]["value"][1] == "1"
    body = json.dumps({"job": "j", "series": [{"name": "m", "value": 3}]})
    assert server.api.handle("POST", "/api/v1/push", "", body, "Bearer abc", "h")[0] == 200
    assert json.loads(server.api.handle("GET", "/api/v1/query", "query=m")[2])["data"]["result"][0]["value"][1] == "3"
    for bad in ("scrape_configs: [{job_name: a}]", "storage: {retention: 5q}", "alerting: {notify: {enabled: true}}", "push: {enabled: 3}", "- a", "global: {scrape_interval: [1]}", 'scrape_configs: [{job_name: a, static_configs: [{targets: [x]}], authorization: {credentials: "${NOT_SET}"}}]', "a: [", "alerting: {default_datasource: x, datasources: [{name: y, url: u}]}"):
        with pytest.raises(config.ConfigError):
            config.parsed(bad)


def test_log_lines_are_shipped_in_batches():
    sent, failing = [], [2]

    def send(body):
        if failing[0]:
            failing[0] -= 1
            raise OSError("down")
        sent.append([json.loads(x) for x in body.decode().splitlines()])

    shipper = logship.Shipper(send, batch=2, every_s=0.05, sleep=lambda s: None)
    log = logging.getLogger("shipped")
    log.addHandler(shipper)
    log.setLevel(logging.INFO)
    log.info("one\n\ntwo")
    log.error("three")
    shipper.close()
    log.removeHandler(shipper)
    assert [[x["message"] for x in b] for b in sent] == [["one", "two"], ["three"]] and sent[1][0]["level"] == "error" and shipper.dropped == 0
    failing[0] = 3
    shipper = logship.Shipper(send, sleep=lambda s: None)
    shipper.handle(logging.makeLogRecord({"msg": "lost", "levelname": "INFO"}))
    shipper.close()
    assert shipper.dropped == 1
