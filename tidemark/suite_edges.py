"""Registered queries of edge cases: NaN, order, limits, the HTTP routes, push, scraping, alerts and retention."""

from __future__ import annotations

import json
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import datasets
from .alerts import evaluate
from .alerts.store import AlertStore
from .api.http import Api
from .engine import Engine
from .functions.labels import text_of
from .lang import kind_of, parse
from .lang.tree import QueryError
from .shared import shared_folder
from .sources import exposition, push
from .sources.scrape import Target, scrape
from .store import Store, cap_series, keep_first, retain
from .streaming import ingest, retention
from .suite import BY_EVENT, DAY, EV, FINE, HOUR, LOOKBACK, QUERIES, SQL, START, add, grouped, instants, out, ranged

__all__ = ["QUERIES", "SQL"]
_TYPE = ("event_type",)

# ---- NaN ----

add("cmp_nan", ranged("sqrt(event_value - 50) <= 1e9"), instants() + out("sqrt(v - 50)", where="v >= 50"))
add("cmp_nan_differs", ranged("sqrt(event_value - 50) != bool (0 / 0)"), instants() + out("1"))
add("arith_mod_by_zero", ranged("(event_value % (0 * event_value)) != bool 0"), instants() + out("1"))
# logarithms of numbers below 0 are NaN: one that comes first in a group stays, later ones are passed over
_LOG = ", x AS (SELECT *, CASE WHEN v > 50 THEN ln(v - 50) ELSE 'nan'::DOUBLE END AS w FROM iv) "
for _name in ("min", "max"):
    add(
        f"agg_{_name}_nan",
        ranged(f"{_name} by (event_type) (ln(event_value - 50)) > -1e9", _TYPE, FINE),
        instants(FINE) + _LOG + grouped(f"{_name}(w) FILTER (WHERE NOT isnan(w))", "x", "NOT isnan(arg_min(w, user_id || '\"'))", _TYPE),
    )
add(
    "agg_quantile_nan",
    ranged("quantile by (event_type) (0.9, ln(event_value - 50)) > -1e9", _TYPE, FINE),
    instants(FINE)
    + _LOG
    + ", y AS (SELECT s, event_type, count(*) AS n, count(*) FILTER (WHERE isnan(w)) AS k, list_sort(list(w) FILTER (WHERE NOT isnan(w))) AS a FROM x GROUP BY ALL), "
    + "z AS (SELECT *, 0.9::DOUBLE * (n - 1) AS r, CAST(floor(0.9::DOUBLE * (n - 1)) AS BIGINT) AS i FROM y WHERE a IS NOT NULL) "
    + out("a[i - k + 1] * (1 - (r - i)) + CASE WHEN r > i THEN a[i - k + 2] * (r - i) ELSE 0 END", "z", "i >= k", _TYPE),
)
add(
    "quantile_over_time_nan",
    ranged("quantile_over_time(0.75, ln(event_value - 50)[2d:12h]) > -1e9"),
    f"WITH {EV}, st AS (SELECT {START} + i * {6 * HOUR} AS s FROM range(121) r(i)), g AS (SELECT s, s - {2 * DAY} + i * {12 * HOUR} AS x FROM st, range(5) r(i)), gx AS (SELECT DISTINCT x FROM g), "
    f"iv AS (SELECT x, user_id, event_type, arg_max(v, t) AS v FROM ev JOIN gx ON t BETWEEN x - {LOOKBACK} AND x GROUP BY ALL), "
    "y AS (SELECT s, user_id, event_type, count(*) AS n, count(*) FILTER (WHERE v < 50) AS k, list_sort(list(ln(v - 50)) FILTER (WHERE v > 50)) AS a FROM g JOIN iv USING (x) GROUP BY ALL), "
    "z AS (SELECT *, 0.75::DOUBLE * (n - 1) AS r, CAST(floor(0.75::DOUBLE * (n - 1)) AS BIGINT) AS i FROM y WHERE a IS NOT NULL) "
    + out("a[i - k + 1] * (1 - (r - i)) + CASE WHEN r > i THEN a[i - k + 2] * (r - i) ELSE 0 END", "z", "i >= k"),
)

# ---- order and duplicates ----

add(
    "join_last_duplicate",
    ranged("sum by (user_id) (event_value) + on (user_id) event_value", ("user_id",)),
    instants() + ", x AS (SELECT s, user_id, sum(v) AS total, arg_max(v, event_type) AS last FROM iv GROUP BY ALL) " + out("total + last", "x", labels=("user_id",)),
)
_AT = START + 5 * DAY


def _numbered(query: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = Engine(datasets.event_value(spark, sf_dir), LOOKBACK).instant(query, _AT).frame
        placed = frame.withColumn("__id", F.monotonically_increasing_id())  # rises in the order of the result
        nth = F.row_number().over(Window.orderBy("__id")).cast("long")
        return placed.select(nth.alias("nth"), *[F.col("labels")[c].alias(c) for c in BY_EVENT], F.round("v", 6).alias("v"))

    return run


_ONE = f"WITH {EV}, iv AS (SELECT user_id, event_type, arg_max(v, t) AS v FROM ev WHERE t BETWEEN {_AT - LOOKBACK} AND {_AT} GROUP BY ALL) "
_KEY = "'event_value{event_type=\"' || event_type || '\",user_id=\"' || user_id || '\"}'"
for _name, _query, _order in (("order_of_results", "event_value", _KEY), ("order_of_sort", "sort(event_value)", f"v, {_KEY}"), ("order_of_sort_desc", "sort_desc(event_value)", f"v DESC, {_KEY}")):
    add(_name, _numbered(_query), _ONE + f"SELECT row_number() OVER (ORDER BY {_order}) AS nth, user_id, event_type, round(v, 6) AS v FROM iv")

# ---- errors and limits ----

_KINDS = {
    "event_value": "vector", "event_value[5m]": "matrix", "1 + 2": "scalar", "'x'": "string", "rate(event_value[5m])": "vector", "time()": "scalar",
    "rate(event_value)": "error", "sum(1)": "error", "1 == 2": "error", "event_value{": "error", "nothing()": "error", "clamp(event_value, 1)": "error", "event_value and 1": "error",
    "event_value[5m:1m]": "matrix", "-event_value": "vector", "topk(event_value)": "error", 'event_value{a=~"["}': "error", "event_value + on () group_left sum(event_value)": "vector",
}


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of value a query has, or that it is none: told before anything is evaluated."""
    engine = Engine(datasets.event_value(spark, sf_dir), LOOKBACK)

    def kind(query: str) -> str:
        try:
            if query.startswith("event_value{a"):
                engine.instant(query, _AT)
            return kind_of(parse(query))
        except QueryError:
            return "error"
        except ValueError:
            return "error"

    return spark.createDataFrame([(q, kind(q)) for q in _KINDS], "query string, kind string")


def _values(rows: list[tuple]) -> str:
    def said(x: object) -> str:
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).upper() if isinstance(x, bool) else str(x)

    return ", ".join("(" + ", ".join(said(x) for x in r) + ")" for r in rows)


add("kinds_of_queries", _kinds, f"SELECT * FROM (VALUES {_values(list(_KINDS.items()))}) t(query, kind)")

_LIMITS = [("range", 11_000, True), ("range", 11_001, False), ("subquery", 11_000, True), ("subquery", 11_001, False)]


def _limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(datasets.event_value(spark, sf_dir), LOOKBACK)

    def taken(kind: str, points: int) -> bool:
        try:
            if kind == "range":
                engine.range_frame("vector(1)", 0, (points - 1) * 1000, 1000)
            else:
                engine.instant(f"count_over_time(vector(1)[{points - 1}s:1s])", _AT)
        except QueryError:
            return False
        return True

    return spark.createDataFrame([(k, n, taken(k, n)) for k, n, _ in _LIMITS], "kind string, points long, taken boolean")


add("limits_of_points", _limits, f"SELECT kind, CAST(points AS BIGINT) AS points, taken FROM (VALUES {_values(_LIMITS)}) t(kind, points, taken)")

# ---- HTTP ----


def _asked(path: str, shape: str, rows):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        api = Api(Engine(datasets.event_value(spark, sf_dir), LOOKBACK), now=lambda: _AT / 1000)
        status, _, body = api.handle("GET", *path.split("?", 1))
        assert status == 200, body
        return spark.createDataFrame(rows(json.loads(body)["data"]), shape)

    return run


_SUM = quote("sum by (event_type) (event_value)")
add(
    "http_query",
    _asked(f"/api/v1/query?query={_SUM}", "kind string, event_type string, at double, v double", lambda d: [(d["resultType"], r["metric"]["event_type"], float(r["value"][0]), round(float(r["value"][1]), 6)) for r in d["result"]]),
    _ONE + f"SELECT 'vector' AS kind, event_type, CAST({_AT // 1000} AS DOUBLE) AS at, round(sum(v), 6) AS v FROM iv GROUP BY event_type",
)
add(
    "http_query_range",
    _asked(f"/api/v1/query_range?query={_SUM}&start={START // 1000}&end={START // 1000 + 86_400}&step=6h", "event_type string, step_ts long, v double", lambda d: [(r["metric"]["event_type"], int(t * 1000), round(float(v), 6)) for r in d["result"] for t, v in r["values"]]),
    instants((5, 6 * HOUR)) + grouped("sum(v)", labels=_TYPE),
)
add(
    "http_series",
    _asked(f"/api/v1/series?match[]={quote('event_value{event_type="click"}')}&start={_AT // 1000}&end={_AT // 1000 + 86_400}", "name string, user_id string, event_type string", lambda d: [(r["__name__"], r["user_id"], r["event_type"]) for r in d]),
    f"WITH {EV} SELECT DISTINCT 'event_value' AS name, user_id, event_type FROM ev WHERE event_type = 'click' AND t BETWEEN {_AT} AND {_AT + DAY}",
)
add("http_labels", _asked("/api/v1/labels?x=", "name string", lambda d: [(x,) for x in d]), "SELECT unnest(['__name__', 'event_type', 'user_id']) AS name")
add("http_label_values", _asked("/api/v1/label/event_type/values?x=", "value string", lambda d: [(x,) for x in d]), "SELECT DISTINCT event_type AS value FROM events")
_ANSWERS = [
    ("GET", "/api/v1/query?query=1", 200), ("GET", "/api/v1/query", 400), ("GET", "/api/v1/query?query=m{", 400), ("GET", "/api/v1/query?query=m&time=inf", 400), ("GET", "/api/v1/query_range?query=1&start=0&end=1", 400),
    ("GET", "/api/v1/query_range?query=1&start=5&end=1&step=1", 400), ("GET", "/api/v1/query_range?query=1&start=0&end=20000&step=1", 400), ("GET", "/api/v1/series", 400), ("GET", "/api/v1/status/buildinfo", 200),
    ("GET", "/api/v1/metadata", 200), ("GET", "/api/v1/targets", 200), ("GET", "/api/v1/nothing", 404), ("GET", "/-/healthy", 200), ("GET", "/-/ready", 200), ("POST", "/-/healthy", 405), ("POST", "/metrics", 405), ("GET", "/metrics", 200), ("DELETE", "/api/v1/query", 404),
]


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    api = Api(Engine(datasets.event_value(spark, sf_dir), LOOKBACK), now=lambda: _AT / 1000)
    return spark.createDataFrame([(m, p, api.handle(m, *p.split("?", 1))[0]) for m, p, _ in _ANSWERS], "method string, path string, status int")


add("http_statuses", _statuses, f"SELECT * FROM (VALUES {_values(_ANSWERS)}) t(method, path, status)")

# ---- push, exposition, scraping ----


def _refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with one fault each, by event: what is said of them."""
    events = datasets.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 10).alias("k"), "value")
    good = [(1, '{"job":"j","series":[{"name":"m","value":%s}]}')]
    bad = ['{"series":[{"name":"m","value":%s}]}', '{"job":"j","series":[{"name":"1m","value":%s}]}', '{"job":"j","series":[{"name":"m","labels":{"a-b":"x"},"value":%s}]}', '{"job":"j","series":[{"name":"m","labels":{"__x":"y"},"value":%s}]}',
           '{"job":"j","series":[{"name":"m","value":%s,"samples":[{"timestamp_ms":1,"value":1}]}]}', '{"job":"j","series":[{"name":"m"}],"x":%s}', '{"job":"j","series":[{"name":"m","value":"v%s"}]}', '{"job":"j","series":[],"x":%s}',
           '{"job":"j","series":[{"name":"m","samples":[{"timestamp_ms":1,"value":%s},{"timestamp_ms":2,"value":2},{"timestamp_ms":3,"value":3}]}]}']
    body = F.lit(None).cast("string")
    for k, text in [(0, good[0][1]), *enumerate(bad, 1)]:
        body = F.when(F.col("k") == k, F.format_string(text, F.col("value").cast("string"))).otherwise(body)
    requests = events.select(F.col("event_id").alias("request_id"), body.alias("body"), F.lit("h").alias("remote_host"), F.lit(7).cast("long").alias("received_ms"))
    return push.parsed(requests, sample_limit=2).select("request_id", "error")


add(
    "push_refused",
    _refused,
    "SELECT event_id AS request_id, CASE event_id % 10 WHEN 1 THEN 'job is needed' WHEN 2 THEN 'invalid metric name' WHEN 3 THEN 'invalid label name' WHEN 4 THEN 'reserved label name' WHEN 5 THEN 'exactly one of value and samples is needed' "
    "WHEN 6 THEN 'exactly one of value and samples is needed' WHEN 7 THEN 'invalid value' WHEN 8 THEN 'series are needed' WHEN 9 THEN 'too many samples' END AS error FROM events",
)


def _stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples without a time get the request's, requests without an instance get the sender's."""
    events = datasets.table(spark, sf_dir, "events")
    sample = F.struct(F.when(F.col("event_id") % 2 == 0, F.col("event_id")).otherwise(0).alias("timestamp_ms"), F.col("value").alias("value"))
    series = F.struct(F.lit("m").alias("name"), F.create_map(F.lit("instance"), F.lit("client")).alias("labels"), F.array(sample).alias("samples"))
    body = F.to_json(F.struct(F.lit("j").alias("job"), F.when(F.col("event_id") % 3 == 0, F.lit("own")).alias("instance"), F.array(series).alias("series")))
    requests = events.select(F.col("event_id").alias("request_id"), body.alias("body"), F.lit("sender").alias("remote_host"), (F.col("event_id") * 10).alias("received_ms"))
    return push.samples(requests).select("request_id", F.col("labels")["instance"].alias("instance"), "t", "v")


add("push_times", _stamped, "SELECT event_id AS request_id, CASE WHEN event_id % 3 = 0 THEN 'own' ELSE 'sender' END AS instance, CASE WHEN event_id % 2 = 0 AND event_id <> 0 THEN event_id ELSE event_id * 10 END AS t, value AS v FROM events")


def _push_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = datasets.table(spark, sf_dir, "events")
    name = F.when(F.col("event_id") % 4 == 0, F.lit("1bad")).otherwise(F.lit("m"))
    body = F.to_json(F.struct(F.col("event_type").alias("job"), F.array(F.struct(name.alias("name"), F.col("value").alias("value"))).alias("series")))
    requests = events.select(F.col("event_id").alias("request_id"), body.alias("body"), F.lit("sender").alias("remote_host"), F.col("event_id").alias("received_ms"))
    return push.sources(requests)


add(
    "push_sources",
    _push_sources,
    "SELECT event_type AS job, 'sender' AS instance, count(*) FILTER (WHERE event_id % 4 <> 0) AS accepted, count(*) FILTER (WHERE event_id % 4 = 0) AS rejected, max(event_id) AS last_push_ms, "
    "CASE WHEN count(*) FILTER (WHERE event_id % 4 = 0) > 0 THEN 'invalid metric name' END AS last_error FROM events GROUP BY event_type",
)


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HELP and TYPE comments of a metric for each part."""
    parts = datasets.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    name, kinds = F.format_string("part_%d", "p_partkey"), F.array(*map(F.lit, ["counter", "gauge", "histogram", "summary", "odd"]))
    lines = F.array(F.concat(F.lit("# HELP "), name, F.lit(" "), F.col("p_name")), F.concat(F.lit("# TYPE "), name, F.lit(" "), F.get(kinds, (F.col("p_partkey") % 5).cast("int"))), F.lit("# plain words"), F.concat(name, F.lit(" 1")))
    return exposition.metadata(parts.select(F.explode(lines).alias("value")))


add("exposition_metadata", _described, "SELECT 'part_' || p_partkey AS name, CASE p_partkey % 5 WHEN 0 THEN 'counter' WHEN 1 THEN 'gauge' WHEN 2 THEN 'histogram' WHEN 3 THEN 'summary' ELSE 'untyped' END AS type, p_name AS help FROM part")
_SPECIAL = [("+Inf", "inf"), ("-inf", "-inf"), ("NaN", "nan"), ("1.5e3", 1500.0), ("-0.5", -0.5), (".5", 0.5), ("5.", 5.0), ("0x1p4", 16.0), ("-0X1.8p1", -3.0), ("abc", None), ("1_0", None), ("", None), ("0x10", None)]


def _special(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.createDataFrame([(f'm{{n="{i}"}} {text}',) for i, (text, _) in enumerate(_SPECIAL)], "value string")
    rows = exposition.samples(lines)
    return rows.filter("error is null").select(F.col("labels")["n"].alias("n"), "v")


add("exposition_floats", _special, f"SELECT * FROM (VALUES {', '.join(f"('{i}', '{v}'::DOUBLE)" for i, (_, v) in enumerate(_SPECIAL) if v is not None)}) t(n, v)")


def _scraped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target for each nation: some do not answer, some have too many samples, all have their health."""
    nations = [r.n_nationkey for r in datasets.table(spark, sf_dir, "nation").select("n_nationkey").collect()]

    def get(target: Target) -> str:
        k = int(target.instance.split(":")[1])
        if k % 3 == 2:
            raise OSError("no reply")
        return f'm{{job="other"}} {k} 99\nbad line here x\n' + "n 1\n" * (k % 3)

    rows = scrape(spark, [Target.of("web", f"host:{k}", labels={"env": "x"}, sample_limit=1) for k in nations], get, now_ms=42)
    name = F.col("labels")["__name__"]
    return rows.filter(name != "scrape_duration_seconds").select(name.alias("name"), F.col("labels")["instance"].alias("instance"), F.col("labels")["job"].alias("job"), F.col("labels")["env"].alias("env"), "t", "v")


add(
    "scrape_targets",
    _scraped,
    "WITH n AS (SELECT n_nationkey AS k, 'host:' || n_nationkey AS instance FROM nation) "
    "SELECT name, instance, 'web' AS job, 'x' AS env, CAST(42 AS BIGINT) AS t, CAST(v AS DOUBLE) AS v FROM ("
    "SELECT 'm' AS name, instance, k AS v FROM n WHERE k % 3 = 0 UNION ALL SELECT 'up', instance, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END FROM n "
    "UNION ALL SELECT 'scrape_samples_scraped', instance, CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END FROM n)",
)

# ---- storage ----


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = datasets.table(spark, sf_dir, "events")
    labels = F.create_map(F.lit("__name__"), F.lit("event_value"), *[x for c in BY_EVENT for x in (F.lit(c), F.col(c).cast("string"))])
    return events.select(labels.alias("labels"), datasets.millis(F.col("ts")).alias("t"), F.col("value").alias("v"), "event_id")


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream into a store in two runs, the later ones first, all of the first run again in the second with other values."""
    folder = shared_folder(spark, "stream")
    path, source, check = (f"{folder}/{n}" for n in ("store", "in", "check"))
    rows, shape = _labelled(spark, sf_dir), "labels map<string,string>, t long, v double"
    late = F.col("event_id") % 2 == 0
    for part in (rows.filter(late), rows.withColumn("v", F.when(late, F.lit(-1.0)).otherwise(F.col("v")))):
        part.select("labels", "t", "v").write.mode("append").json(source)
        ingest.start(spark.readStream.schema(shape).json(source), path, check, delay="60 days", once=True).awaitTermination()
    store = Store.read(spark, path)
    return store.samples.join(store.series, "sid").select(*[F.col("labels")[c].alias(c) for c in BY_EVENT], "t", "v")


add("stream_into_store", _streamed, f"WITH {EV} SELECT user_id, event_type, t, v FROM ev")
_CUT = START + 10 * DAY + 5 * HOUR


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written store after its old days were deleted."""
    path = f"{shared_folder(spark, 'retention')}/store"
    Store.of_rows(_labelled(spark, sf_dir).drop("event_id"), distinct=True).write(path)
    gone = retention.enforce(spark, path, _CUT)
    store = Store.read(spark, path, _CUT)
    both = store.samples.join(store.series, "sid")
    return both.groupBy(F.col("labels")["event_type"].alias("event_type")).agg(F.count(F.lit(1)).alias("samples"), F.count_distinct("sid").alias("series"), F.min("t").alias("first")).withColumn("days_gone", F.lit(gone))


add(
    "retention_of_days",
    _kept,
    f"WITH {EV} SELECT event_type, count(*) AS samples, count(DISTINCT user_id) AS series, min(t) AS first, CAST((SELECT count(DISTINCT t // {DAY}) FROM ev WHERE t // {DAY} < {_CUT // DAY}) AS INTEGER) AS days_gone FROM ev WHERE t >= {_CUT} GROUP BY event_type",
)


def _retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = retain(datasets.event_value(spark, sf_dir), START + 25 * DAY)
    return left.series.select(*[F.col("labels")[c].alias(c) for c in BY_EVENT])


add("retention_of_series", _retained, f"WITH {EV} SELECT DISTINCT user_id, event_type FROM ev WHERE t >= {START + 25 * DAY}")


def _capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of half the events are known; those of the rest fit if there is room for all of them."""
    rows = _labelled(spark, sf_dir).withColumn("sid", F.xxhash64(text_of(F.col("labels"))))
    known, fresh = rows.filter(F.col("event_id") % 2 == 0).select("sid").distinct(), rows.filter(F.col("event_id") % 2 == 1)
    total = rows.select("sid").distinct().count()
    taken = [(name, cap_series(known, fresh, limit).count()) for name, limit in (("room", total), ("one too few", total - 1))]
    return spark.createDataFrame(taken, "cap string, taken long")


add("series_cap", _capped, "SELECT 'room' AS cap, count(*) AS taken FROM events WHERE event_id % 2 = 1 UNION ALL SELECT 'one too few', 0")


def _first_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as samples at day resolution: of those of a series and day the first by key stays."""
    orders = datasets.table(spark, sf_dir, "orders")
    rows = orders.select(F.xxhash64("o_orderpriority").alias("sid"), datasets.millis(F.col("o_orderdate")).alias("t"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("arrival"), "o_orderpriority")
    return keep_first(rows).select("o_orderpriority", "t", "v", "arrival")


add("keep_first", _first_kept, "SELECT o_orderpriority, epoch_us(o_orderdate) // 1000 AS t, arg_min(o_totalprice, o_orderkey) AS v, min(o_orderkey) AS arrival FROM orders GROUP BY ALL")

# ---- alerts ----

_NAMES = ("rule_id", "fingerprint", "labels", "state", "value", "active_ms", "started_ms")
_RULE = "sum by (user_id) (event_value) > 50"


def _loud(at: int) -> str:
    return f"(SELECT user_id, sum(v) AS v FROM (SELECT user_id, event_type, arg_max(v, t) AS v FROM ev WHERE t BETWEEN {at - LOOKBACK} AND {at} GROUP BY ALL) GROUP BY user_id HAVING sum(v) > 50)"


def _known(spark: SparkSession, engine: Engine, rule: evaluate.Rule, at: int, cap: int | None = None) -> DataFrame:
    return evaluate.transitions(spark.createDataFrame([], evaluate.INSTANCES), evaluate.observed(engine, rule, at), rule, at, cap)


def _pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule that waits for two hours, evaluated twice, three hours apart."""
    engine = Engine(datasets.event_value(spark, sf_dir), LOOKBACK)
    rule = evaluate.Rule("loud", "loud", _RULE, "warning", for_s=7200)
    first = _known(spark, engine, rule, _AT).select(*_NAMES)
    after = evaluate.transitions(first, evaluate.observed(engine, rule, _AT + 3 * HOUR), rule, _AT + 3 * HOUR, cap=None)
    return after.select(F.col("labels")["user_id"].alias("user_id"), "before", "state", "changed", "active_ms", "started_ms")


add(
    "alert_pending",
    _pending,
    f"""WITH {EV}, a AS {_loud(_AT)}, b AS {_loud(_AT + 3 * HOUR)}
SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.v IS NULL THEN 'ok' ELSE 'pending' END AS before,
  CASE WHEN b.v IS NULL THEN 'resolved' WHEN a.v IS NULL THEN 'pending' ELSE 'firing' END AS state, true AS changed,
  CASE WHEN a.v IS NULL THEN {_AT + 3 * HOUR} ELSE {_AT} END AS active_ms, CASE WHEN a.v IS NULL THEN {_AT + 3 * HOUR} ELSE {_AT} END AS started_ms
FROM a FULL JOIN b ON a.user_id = b.user_id""",
)


def _at_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No more than 20 instances, taken in order of their fingerprints; known ones keep their places."""
    engine = Engine(datasets.event_value(spark, sf_dir), LOOKBACK)
    rule = evaluate.Rule("loud", "loud", _RULE, "warning")
    first = _known(spark, engine, rule, _AT, cap=20).filter("state is not null").select(*_NAMES)
    after = evaluate.transitions(first, evaluate.observed(engine, rule, _AT + 3 * HOUR), rule, _AT + 3 * HOUR, cap=25)
    return after.select(F.col("labels")["user_id"].alias("user_id"), "before", "state")


_PRINT = "sha256('{user_id=\"' || user_id || '\"}')"
add(
    "alert_cap",
    _at_cap,
    f"""WITH {EV}, a AS (SELECT * FROM {_loud(_AT)} ORDER BY {_PRINT} LIMIT 20), b AS {_loud(_AT + 3 * HOUR)},
fresh AS (SELECT user_id, row_number() OVER (ORDER BY {_PRINT}) AS k FROM b WHERE user_id NOT IN (SELECT user_id FROM a))
SELECT user_id, 'ok' AS before, CASE WHEN k <= 25 - (SELECT count(*) FROM a) THEN 'firing' END AS state FROM fresh
UNION ALL SELECT user_id, 'firing', CASE WHEN user_id IN (SELECT user_id FROM b) THEN 'firing' ELSE 'resolved' END FROM a""",
)


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule's labels win over those of a series; of instances that become one, the last sample counts."""
    engine = Engine(datasets.event_value(spark, sf_dir), LOOKBACK)
    rule = evaluate.Rule("all", "all", "event_value", "info", labels={"event_type": "any", "team": "x"})
    seen = evaluate.observed(engine, rule, _AT)
    return seen.select(*[F.col("labels")[c].alias(c) for c in ("user_id", "event_type", "team")], F.round("value", 6).alias("value"))


add("alert_labels", _merged, _ONE + "SELECT user_id, 'any' AS event_type, 'x' AS team, round(arg_max(v, event_type), 6) AS value FROM iv GROUP BY user_id")


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of two evaluations from the third event on, as the events feed gives it."""
    engine, store = Engine(datasets.event_value(spark, sf_dir), LOOKBACK), AlertStore()
    rule = evaluate.Rule("loud", "loud", _RULE, "warning")
    for at in (_AT, _AT + 3 * HOUR):
        outcome = evaluate.evaluate(engine, rule, store.instances(spark), at, cap=10)
        store.apply(rule.id, outcome.instances, outcome.history, at)
    rows = [(i, json.loads(labels)["user_id"], before, state, at) for i, _, _, labels, before, state, _, at in store.history(since=2, limit=12)]
    return spark.createDataFrame(rows, "id long, user_id string, before string, state string, at_ms long")


add(
    "alert_history",
    _told,
    f"""WITH {EV}, a AS (SELECT *, {_PRINT} AS p FROM {_loud(_AT)} ORDER BY p LIMIT 10), b AS (SELECT *, {_PRINT} AS p FROM {_loud(_AT + 3 * HOUR)}),
fresh AS (SELECT * FROM b WHERE user_id NOT IN (SELECT user_id FROM a) ORDER BY p LIMIT (10 - (SELECT count(*) FROM a))),
h AS (SELECT 1 AS k, user_id, p, 'ok' AS before, 'firing' AS state, {_AT} AS at_ms FROM a
  UNION ALL SELECT 2, user_id, p, 'firing', 'resolved', {_AT + 3 * HOUR} FROM a WHERE user_id NOT IN (SELECT user_id FROM b)
  UNION ALL SELECT 2, user_id, p, 'ok', 'firing', {_AT + 3 * HOUR} FROM fresh)
SELECT * FROM (SELECT row_number() OVER (ORDER BY k, p) AS id, user_id, before, state, at_ms FROM h) WHERE id > 2 ORDER BY id LIMIT 12""",
)


def _gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(datasets.event_value(spark, sf_dir), LOOKBACK)
    waits, fires = evaluate.Rule("waits", "w", _RULE, "info", for_s=60), evaluate.Rule("fires", "f", "event_value > 90", "info")
    both = _known(spark, engine, waits, _AT).unionByName(_known(spark, engine, fires, _AT))
    return evaluate.gauges(evaluate.active(both.select(*_NAMES)))


add("alert_gauges", _gauges, _ONE + f", a AS {_loud(_AT)} SELECT 'pending' AS state, count(*) AS n FROM a HAVING count(*) > 0 UNION ALL SELECT 'firing', count(*) FROM iv WHERE v > 90 HAVING count(*) > 0")
_PROBLEMS = [
    ("good", "", "m", "info", 60, 0, "builtin"), ("no name", "name is needed", "m", "info", 60, 0, "builtin"), ("no query", "query is needed", "", "info", 60, 0, "builtin"), ("no severity", "severity is needed", "m", "", 60, 0, "builtin"),
    ("interval", "the interval must be positive", "m", "info", 0, 0, "builtin"), ("for", "for must not be negative", "m", "info", 60, -1, "builtin"), ("source", "unknown datasource", "m", "info", 60, 0, "far"), ("unparsed", "", "m{{", "info", 60, 0, "builtin"),
]


def _problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for kind, _, query, severity, interval, wait, source in _PROBLEMS:
        found = evaluate.Rule("r", "" if kind == "no name" else "n", query, severity, interval, wait, datasource=source).problems({"builtin"})
        rows.append((kind, found[0] if found else ""))
    return spark.createDataFrame(rows, "kind string, problem string")


add("alert_rules_checked", _problems, f"SELECT * FROM (VALUES {_values([r[:2] for r in _PROBLEMS])}) t(kind, problem)")
_REASONS = [("timed out", "timeout"), ("unauthorized 401", "auth"), ("forbidden 403", "auth"), ("status 500", "http"), ("no such thing", "invalid")]
add(
    "alert_failures",
    lambda spark, d: spark.createDataFrame([(t, evaluate.classify(OSError(t))) for t, _ in _REASONS] + [("m{", evaluate.classify(QueryError("m{")))], "said string, reason string"),
    f"SELECT * FROM (VALUES {_values([*_REASONS, ('m{', 'query')])}) t(said, reason)",
)
