import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidemark.alerts import evaluate as E
from tidemark.alerts import notify, state
from tidemark.alerts.datasources import Datasource, Remote, decoded
from tidemark.alerts.routes import AlertRoutes, Refused
from tidemark.alerts.scheduler import Scheduler
from tidemark.alerts.service import AlertService, Failed
from tidemark.alerts.store import AlertStore
from tidemark.api.http import Api, serve
from tidemark.engine import Engine
from tidemark.store import Store


@pytest.mark.parametrize(
    "now,holds,elapsed,wait,after",
    [("ok", False, 0, 60, "ok"), ("ok", True, 0, 0, "firing"), ("ok", True, 0, 60, "pending"), ("pending", True, 30, 60, "pending"), ("pending", True, 60, 60, "firing"), ("pending", True, 120, 60, "firing"), ("pending", False, 0, 60, "resolved"), ("firing", True, 0, 60, "firing"), ("firing", False, 0, 60, "resolved")],
)
def test_states(spark, now, holds, elapsed, wait, after):
    got = spark.range(1).select(state.following(F.lit(now), F.lit(holds), F.lit(1000), F.lit(1000 + elapsed), F.lit(wait)).alias("s")).first().s
    assert got == after


def _engine(spark, rows):
    return Engine(Store.of_rows(spark.createDataFrame([({"__name__": "m", "instance": i}, 1000, v) for i, v in rows], "labels map<string,string>, t long, v double")))


def test_a_rule_over_time(spark):
    rule, store = E.Rule("r1", "high", "m > 5", "critical", labels={"team": "x"}), AlertStore()
    store.save_rule(rule)
    for now, rows in ((1000, [("a", 7.0), ("b", 9.0)]), (1001, [("a", 8.0), ("b", 9.0)]), (1002, [("a", 8.0), ("b", 1.0)])):
        out = E.evaluate(_engine(spark, rows), rule, store.instances(spark), now)
        store.apply("r1", out.instances, out.history)
    history = store.history()
    assert [(h[4], h[5]) for h in history] == [("ok", "firing"), ("ok", "firing"), ("firing", "resolved")]
    left = E.active(store.instances(spark)).collect()
    assert [(r.labels["instance"], r.labels["team"], r.value) for r in left] == [("a", "x", 8.0)]
    assert [h[0] for h in store.history(since=2)] == [3]
    failed = E.evaluate(_engine(spark, []), E.Rule("r1", "x", "m >", "critical"), store.instances(spark), 2000)
    assert failed.failure == "query" and failed.instances.count() == 1
    store.delete_rule("r1")
    assert store.instances(spark).count() == 0 and len(store.history()) == 3 and store.rules() == []


def test_cap_and_validation(spark):
    out = E.evaluate(_engine(spark, [(str(i), 9.0) for i in range(5)]), E.Rule("r", "n", "m", "info"), spark.createDataFrame([], E.INSTANCES), 1000, cap=3)
    assert out.instances.count() == 3 and out.refused == 2 and out.history.count() == 3
    assert E.Rule("r", "", "m", "info", interval_s=0).problems({"d"}) == ["name is needed", "the interval must be positive", "unknown datasource"]
    store = AlertStore()
    store.save_datasource(Datasource("1", "a"))
    with pytest.raises(ValueError):
        store.save_datasource(Datasource("2", "a"))


def test_notifications():
    assert notify.severity_of("ERROR") == "error" and notify.severity_of("page") == "warning" and notify.severity_of("odd") == "warning"
    assert notify.wanted("firing", "warn", "warning") and not notify.wanted("pending", "critical") and not notify.wanted("firing", "info", "critical")
    tries = []

    def send(message):
        tries.append(message)
        if message["n"] == 1 or len(tries) == 1:
            raise (notify.Permanent if message["n"] == 1 else OSError)("no")

    sender = notify.Dispatcher(send, sleep=lambda s: None)
    for n in (0, 1):
        assert sender.offer({"n": n})
    sender.close()
    assert sender.counts["sent"] == 1 and sender.counts["retries"] == 1 and sender.counts["failed_permanent"] == 1


class _Box:
    """A sender that keeps what it is given."""

    def __init__(self):
        self.counts, self.told = __import__("collections").Counter(), []

    def offer(self, message):
        self.told.append(message)
        return True

    def exposition(self):
        return {}

    def close(self):
        pass


def _call(routes, method, path, body=None, **args):
    return routes.handle(method, path, args, json.dumps(body) if body is not None else "")


def test_a_rule_fires_notifies_and_resolves_through_http(spark):
    box, service = _Box(), None
    engines = [_engine(spark, [("a", 7.0)]), _engine(spark, [("a", 1.0)])]
    service = AlertService(engines[0], notifier=box, now=lambda: 1.0)
    api = Api(engines[0], alerts=service)

    def http(method, path, body=None):
        status, _, text = api.handle(method, path, "", json.dumps(body) if body is not None else "")
        return status, json.loads(text)

    rule = {"name": " high ", "promql": "m > 5", "evaluation_interval_seconds": 3600, "severity": "Critical", "annotations": {"note": "x"}}
    status, made = http("POST", "/api/v1/alerts", rule)
    assert status == 201 and made["data"]["name"] == "high" and made["data"]["datasource_id"] == "builtin"
    one = f"/api/v1/alerts/{made['data']['id']}"
    assert http("POST", f"{one}/evaluate") == (200, {"status": "success", "data": {"active": 1, "pending": 0, "transitions": 1}})
    assert [i["labels"]["instance"] for i in http("GET", "/api/v1/alerts/active")[1]["data"]] == ["a"]
    assert http("GET", one)[1]["data"]["instances"][0]["status"] == "firing"
    service.engine = engines[1]
    assert http("POST", "/api/v1/alerts/evaluate")[1]["data"] == {"evaluated": 1}
    assert [(m["status"], m["severity"], m["annotations"]) for m in box.told] == [("firing", "critical", {"note": "x"}), ("resolved", "critical", {"note": "x"})]
    events = http("GET", "/api/v1/alerts/events")[1]["data"]
    assert [(e["previous_state"], e["new_state"]) for e in events] == [("ok", "firing"), ("firing", "resolved")]
    assert http("POST", f"{one}/disable")[1]["data"]["enabled"] is False and http("POST", "/api/v1/alerts/evaluate")[1]["data"] == {"evaluated": 0}
    assert http("PUT", one, {**rule, "promql": "m >"})[0] == 200 and http("POST", f"{one}/evaluate")[0] == 502
    text = api.exposition()
    assert 'tidemark_alert_evaluation_failures_total{reason="query"} 1' in text and "tidemark_alert_state_transitions_total 2" in text and "# TYPE tidemark_alerts_active gauge" in text
    assert http("DELETE", one)[0] == 200 and http("GET", one)[0] == 404 and len(http("GET", "/api/v1/alerts/history")[1]["data"]) == 2
    for bad in ({**rule, "name": " "}, {**rule, "promql": ""}, {**rule, "evaluation_interval_seconds": 0}, {**rule, "for_duration_seconds": -1}, {**rule, "severity": ""}, {**rule, "datasource_id": "no"}, {**rule, "odd": 1}, {**rule, "enabled": 1}, [1]):
        assert http("POST", "/api/v1/alerts", bad)[0] == 400, bad
    assert api.handle("POST", "/api/v1/alerts", "", "{")[0] == 400


def test_datasources_through_routes(spark):
    engine = _engine(spark, [("a", 7.0)])
    routes = AlertRoutes(AlertService(engine, now=lambda: 1.0))
    server = serve(Api(engine), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}"
    _, made = _call(routes, "POST", "/api/v1/datasources", {"name": "far", "base_url": url, "auth_type": "bearer", "credentials": "s"})
    one = f"/api/v1/datasources/{made['id']}"
    assert "credentials" not in made and _call(routes, "POST", f"{one}/test") == (200, {"status": "ok"})
    assert [(labels["instance"], v) for labels, v in Remote(spark, routes.store.datasource(made["id"])).fetch("m", 1000)] == [("a", 7.0)]
    rule = E.Rule("r", "n", "m > 5", "info", datasource=made["id"])
    routes.store.save_rule(rule)
    assert routes.service.evaluate("r") == {"active": 1, "pending": 0, "transitions": 1}
    server.shutdown()
    server.server_close()
    with pytest.raises(Failed):
        routes.service.evaluate("r")
    assert routes.service.counts['alert_evaluation_failures_total{reason="invalid"}'] == 1 and len(routes.store.active("r")) == 1
    assert _call(routes, "PUT", one, {"name": "far", "base_url": url, "enabled": False})[1]["enabled"] is False and routes.store.datasource(made["id"]).credentials == "s"
    with pytest.raises(Failed):
        routes.service.evaluate("r")
    for method, path, body, status in (
        ("POST", "/api/v1/datasources", {"name": "far", "base_url": url}, 409), ("POST", "/api/v1/datasources", {"name": "x", "base_url": "ftp://h"}, 400), ("POST", "/api/v1/datasources", {"name": "x", "base_url": "http://u:p@h"}, 400),
        ("POST", "/api/v1/datasources", {"name": "x", "base_url": url, "auth_type": "odd"}, 400), ("DELETE", "/api/v1/datasources/builtin", None, 409), ("PUT", "/api/v1/datasources/builtin", {"name": "x", "base_url": url}, 409), ("POST", f"{one}/test", None, 502), ("GET", "/api/v1/datasources/none", None, 404),
    ):
        with pytest.raises(Refused) as refused:
            _call(routes, method, path, body)
        assert refused.value.status == status, (method, path, body)
    assert _call(routes, "DELETE", one)[0] == 200


def test_answers_of_remote_sources():
    vector = {"status": "success", "data": {"resultType": "vector", "result": [{"metric": {"a": "b"}, "value": [1, "+Inf"]}]}}
    assert decoded(vector) == [({"a": "b"}, float("inf"))] and decoded({"status": "success", "data": {"resultType": "scalar", "result": [1, 2.5]}}) == [({}, 2.5)]
    for bad in ({"status": "error", "error": "x"}, {"status": "success", "data": {"resultType": "matrix", "result": []}}, {"status": "success", "data": {"resultType": "string", "result": [1, "x"]}}):
        with pytest.raises(ValueError):
            decoded(bad)


def test_scheduler_follows_the_rules():
    seen, scheduler = [], None
    scheduler = Scheduler(seen.append)
    fast, slow = E.Rule("a", "n", "m", "info", interval_s=0.02), E.Rule("b", "n", "m", "info", interval_s=60)
    scheduler.reconcile([fast, slow, E.Rule("c", "n", "m", "info", interval_s=0.02, enabled=False)])
    deadline = time.monotonic() + 5
    while seen.count("a") < 3 and time.monotonic() < deadline:
        time.sleep(0.01)
    assert seen.count("a") >= 3 and "b" not in seen and "c" not in seen
    scheduler.reconcile([slow])
    time.sleep(0.1)
    before = len(seen)
    time.sleep(0.1)
    assert len(seen) == before
    scheduler.stop()


def test_errors_of_spark_hold_the_state(spark):
    class Broken:
        def rows(self, query, now_ms):
            return spark.range(1).select(F.create_map().cast("map<string,string>").alias("labels"), F.raise_error(F.lit("timeout")).cast("double").alias("v"))

    known = spark.createDataFrame([("r", "f", {}, "firing", 1.0, 1, 1)], E.INSTANCES)
    out = E.evaluate(Broken(), E.Rule("r", "n", "m", "info"), known, 5)
    assert out.failure == "timeout" and out.instances.count() == 1 and out.history.count() == 0
