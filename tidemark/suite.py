"""The registered queries, one per operator, each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import datasets
from .alerts import evaluate
from .engine import Engine
from .functions.labels import text_of
from .sources import exposition, push
from .store import keep_first

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

START, HOUR, DAY = 1_704_067_200_000, 3_600_000, 86_400_000
WIDE = (121, 6 * HOUR)  # steps of results by series
FINE = (721, HOUR)  # steps of aggregated results
LOOKBACK = 6 * HOUR
BY_EVENT = ("user_id", "event_type")


def _shown(df: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    return df.select(*[F.col("labels")[c].alias(c) for c in labels], F.col("t").alias("step_ts"), F.round("v", 6).alias("v"))


def ranged(query: str, labels: tuple[str, ...] = BY_EVENT, grid=WIDE, store=datasets.event_value, lookback: int = LOOKBACK, start: int = START) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(store(spark, sf_dir), lookback)
        return _shown(engine.range_frame(query, start, start + (grid[0] - 1) * grid[1], grid[1]), labels)

    return run


def add(name: str, run: Query, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        SQL[name] = sql


# ---- pieces of SQL ----

EV = "ev AS (SELECT epoch_us(ts) // 1000 AS t, CAST(user_id AS VARCHAR) AS user_id, event_type, value AS v FROM events)"
TOTAL = "ev AS (SELECT epoch_us(ts) // 1000 AS t, CAST(user_id AS VARCHAR) AS user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS DOUBLE) AS v FROM events)"
LAGGED = "lg AS (SELECT *, lag(t) OVER w AS pt, lag(v) OVER w AS pv FROM ev WINDOW w AS (PARTITION BY user_id, event_type ORDER BY t))"


def steps(grid=WIDE, start: int = START) -> str:
    return f"st AS (SELECT {start} + i * {grid[1]} AS s FROM range({grid[0]}) r(i))"


def instants(grid=WIDE, offset: int = 0, lookback: int = LOOKBACK, source: str = EV) -> str:
    return f"WITH {source}, {steps(grid)}, iv AS (SELECT s, user_id, event_type, max(t) AS t, arg_max(v, t) AS v FROM ev JOIN st ON t BETWEEN s - {offset} - {lookback} AND s - {offset} GROUP BY ALL) "


def windows(length: int, grid=WIDE, offset: int = 0, source: str = EV) -> str:
    return f"WITH {source}, {LAGGED}, {steps(grid)}, rv AS (SELECT s, user_id, event_type, t, v, pt, pv FROM lg JOIN st ON t BETWEEN s - {offset} - {length} AND s - {offset}) "


def out(value: str, source: str = "iv", where: str = "true", labels: tuple[str, ...] = BY_EVENT) -> str:
    return f"SELECT {''.join(c + ', ' for c in labels)}s AS step_ts, round(CAST({value} AS DOUBLE), 6) AS v FROM {source} WHERE {where}"


def grouped(value: str, source: str = "iv", having: str = "true", labels: tuple[str, ...] = ()) -> str:
    return f"SELECT {''.join(c + ', ' for c in labels)}s AS step_ts, round(CAST({value} AS DOUBLE), 6) AS v FROM {source} GROUP BY {''.join(c + ', ' for c in labels)}s HAVING {having}"


# ---- selection ----

add("sel_instant", ranged("event_value", grid=FINE, lookback=300_000), instants(FINE, lookback=300_000) + out("v"))
add("sel_equal", ranged('event_value{event_type="click"}'), instants() + out("v", where="event_type = 'click'"))
add("sel_not_equal", ranged('event_value{event_type!="click",nothing!="x"}'), instants() + out("v", where="event_type <> 'click'"))
add("sel_regex", ranged('event_value{event_type=~"c.*|v.*"}'), instants() + out("v", where="event_type IN ('click', 'view')"))
add("sel_not_regex", ranged('event_value{event_type!~"c.*|v.*"}'), instants() + out("v", where="event_type NOT IN ('click', 'view')"))
add("sel_regex_class", ranged('event_value{event_type=~"[[:alpha:]]+",user_id=~"[[:digit:]]{1,2}"}'), instants() + out("v", where="regexp_full_match(event_type, '[a-zA-Z]+') AND regexp_full_match(user_id, '[0-9]{1,2}')"))
add("sel_offset", ranged("event_value offset 1d"), instants(offset=DAY) + out("v"))
add("sel_offset_negative", ranged("event_value offset -1d"), instants(offset=-DAY) + out("v"))
_AT = START + 10 * DAY
add(
    "sel_at",
    ranged(f"event_value @ {_AT // 1000}"),
    f"WITH {EV}, {steps()}, iv AS (SELECT user_id, event_type, arg_max(v, t) AS v FROM ev WHERE t BETWEEN {_AT - LOOKBACK} AND {_AT} GROUP BY ALL) " + out("v", "iv, st"),
)
_END = START + 120 * 6 * HOUR
add(
    "sel_at_end",
    ranged("event_value @ end()"),
    f"WITH {EV}, {steps()}, iv AS (SELECT user_id, event_type, arg_max(v, t) AS v FROM ev WHERE t BETWEEN {_END - LOOKBACK} AND {_END} GROUP BY ALL) " + out("v", "iv, st"),
)


def subquery(outer: int, inner: int, length: int, lookback: int = LOOKBACK) -> str:
    return (
        f"WITH {EV}, {steps((121, outer))}, g AS (SELECT s, s - {length} + i * {inner} AS x FROM st, range({length // inner} + 1) r(i)), gx AS (SELECT DISTINCT x FROM g), "
        f"iv AS (SELECT x, user_id, event_type, arg_max(v, t) AS v FROM ev JOIN gx ON t BETWEEN x - {lookback} AND x GROUP BY ALL), rv AS (SELECT s, user_id, event_type, v FROM g JOIN iv USING (x)) "
    )


add("subquery_max", ranged("max_over_time(event_value[1d:3h])"), subquery(6 * HOUR, 3 * HOUR, DAY) + grouped("max(v)", "rv", labels=BY_EVENT))
add("subquery_unaligned", ranged("sum_over_time(event_value[1d:7h])"), subquery(6 * HOUR, 7 * HOUR, DAY) + grouped("sum(v)", "rv", labels=BY_EVENT))

# ---- functions over ranges ----

_INC = "sum(CASE WHEN pt >= s - {r} THEN CASE WHEN v >= pv THEN v - pv ELSE v END ELSE 0 END)"
_X = "((t - s) / 1000.0)"
_SLOPE = f"(count(*) * sum({_X} * v) - sum({_X}) * sum(v)) / (count(*) * sum({_X} * {_X}) - sum({_X}) * sum({_X}))"
_RANGES: dict[str, tuple[str, str]] = {
    "rate": (_INC + " / ((max(t) - min(t)) / 1000.0)", "count(*) >= 2 AND max(t) > min(t)"),
    "increase": (_INC, "count(*) >= 2"),
    "irate": ("arg_max(CASE WHEN v >= pv THEN v - pv ELSE v END / ((t - pt) / 1000.0), t)", "count(*) >= 2"),
    "delta": ("arg_max(v, t) - arg_min(v, t)", "count(*) >= 2"),
    "idelta": ("arg_max(v - pv, t)", "count(*) >= 2"),
    "deriv": (_SLOPE, "count(*) >= 2"),
    "changes": ("sum(CASE WHEN pt >= s - {r} AND v <> pv THEN 1 ELSE 0 END)", "true"),
    "resets": ("sum(CASE WHEN pt >= s - {r} AND v < pv THEN 1 ELSE 0 END)", "true"),
    "sum_over_time": ("sum(v)", "true"),
    "avg_over_time": ("avg(v)", "true"),
    "min_over_time": ("min(v)", "true"),
    "max_over_time": ("max(v)", "true"),
    "count_over_time": ("count(*)", "true"),
    "stddev_over_time": ("stddev_pop(v)", "true"),
    "stdvar_over_time": ("var_pop(v)", "true"),
    "last_over_time": ("arg_max(v, t)", "true"),
    "present_over_time": ("1", "true"),
}
for _name, (_value, _having) in _RANGES.items():
    add(_name, ranged(f"{_name}(event_value[1d])"), windows(DAY) + grouped(_value.format(r=DAY), "rv", _having, BY_EVENT))
add("predict_linear", ranged("predict_linear(event_value[1d], 3600)"), windows(DAY) + grouped(f"(sum(v) - ({_SLOPE}) * sum({_X})) / count(*) + ({_SLOPE}) * 3600", "rv", "count(*) >= 2", BY_EVENT))
add("quantile_over_time", ranged("quantile_over_time(0.9, event_value[1d])"), windows(DAY) + grouped("quantile_cont(v, 0.9)", "rv", labels=BY_EVENT))
add(
    "absent_over_time",
    ranged('absent_over_time(event_value{user_id="1",event_type="click"}[6h])', BY_EVENT, FINE),
    windows(6 * HOUR, FINE) + "SELECT '1' AS user_id, 'click' AS event_type, s AS step_ts, CAST(1 AS DOUBLE) AS v FROM st WHERE s NOT IN (SELECT s FROM rv WHERE user_id = '1' AND event_type = 'click')",
)
add("increase_counter", ranged("increase(events_total[1d])", store=datasets.events_total), windows(DAY, source=TOTAL) + grouped(_INC.format(r=DAY), "rv", "count(*) >= 2", BY_EVENT))
_PER = windows(6 * HOUR, FINE) + f", x AS ({grouped(_INC.format(r=6 * HOUR) + ' / ((max(t) - min(t)) / 1000.0)', 'rv', 'count(*) >= 2 AND max(t) > min(t)', BY_EVENT).replace('round(', '(').replace(', 6)', ')')}) "
FLAGSHIP = "sum by (event_type) (rate(event_value[6h]))"
add("sum_of_rates", ranged(FLAGSHIP, ("event_type",), FINE), _PER + "SELECT event_type, step_ts, round(sum(v), 6) AS v FROM x GROUP BY ALL")

# ---- aggregation ----

_TYPE = ("event_type",)
for _name, _value in {"sum": "sum(v)", "avg": "avg(v)", "min": "min(v)", "max": "max(v)", "count": "count(*)", "group": "1", "stddev": "stddev_pop(v)", "stdvar": "var_pop(v)"}.items():
    add(f"agg_{_name}", ranged(f"{_name} by (event_type) (event_value / 3)", _TYPE, FINE), instants(FINE) + grouped(_value.replace("(v)", "(v / 3)"), labels=_TYPE))
add("agg_all", ranged("sum(event_value)", (), FINE), instants(FINE) + grouped("sum(v)"))
add("agg_without", ranged("max without (user_id) (event_value)", _TYPE, FINE), instants(FINE) + grouped("max(v)", labels=_TYPE))
add("agg_quantile", ranged("quantile by (event_type) (0.9, event_value)", _TYPE, FINE), instants(FINE) + grouped("quantile_cont(v, 0.9)", labels=_TYPE))
for _name, _order in {"topk": "v DESC", "bottomk": "v"}.items():
    _rank = f", x AS (SELECT *, row_number() OVER (PARTITION BY s, event_type ORDER BY {_order}, '{{event_type=\"' || event_type || '\",user_id=\"' || user_id || '\"}}') AS k FROM iv) "
    add(f"agg_{_name}", ranged(f"{_name} by (event_type) (3, event_value)", BY_EVENT, FINE), instants(FINE) + _rank + out("v", "x", "k <= 3"))
add(
    "agg_count_values",
    ranged('count_values by (event_type) ("val", floor(event_value / 10) * 10)', ("event_type", "val"), FINE),
    instants(FINE) + "SELECT event_type, CAST(CAST(floor(v / 10) * 10 AS BIGINT) AS VARCHAR) AS val, s AS step_ts, CAST(count(*) AS DOUBLE) AS v FROM iv GROUP BY ALL",
)

# ---- functions of instant values ----

_MATH = {
    "abs": ("abs(event_value - 50)", "abs(v - 50)"),
    "ceil": ("ceil(event_value)", "ceil(v)"),
    "floor": ("floor(event_value)", "floor(v)"),
    "exp": ("exp(event_value / 100)", "exp(v / 100)"),
    "ln": ("ln(event_value)", "ln(v)"),
    "log2": ("log2(event_value)", "log2(v)"),
    "log10": ("log10(event_value)", "log10(v)"),
    "sqrt": ("sqrt(event_value)", "sqrt(v)"),
    "sgn": ("sgn(event_value - 50)", "sign(v - 50)"),
    "round": ("round(event_value, 5)", "floor(v / 5 + 0.5) * 5"),
    "clamp": ("clamp(event_value, 10, 50)", "greatest(10, least(50, v))"),
    "clamp_min": ("clamp_min(event_value, 20)", "greatest(20, v)"),
    "clamp_max": ("clamp_max(event_value, 20)", "least(20, v)"),
    "timestamp": ("timestamp(event_value)", "t / 1000.0"),
    "negate": ("-event_value", "-v"),
}
for _name, (_query, _value) in _MATH.items():
    add(f"math_{_name}", ranged(_query), instants() + out(_value))
_SECONDS = "to_timestamp(1704067200 + CAST(floor(v * 86400) AS BIGINT)) AT TIME ZONE 'UTC'"
for _name, _part in {"minute": "minute", "hour": "hour", "day_of_week": "dow", "day_of_month": "day", "day_of_year": "doy", "month": "month", "year": "year"}.items():
    add(f"date_{_name}", ranged(f"{_name}(1704067200 + floor(event_value * 86400))"), instants() + out(f"date_part('{_part}', {_SECONDS})"))
add("date_days_in_month", ranged("days_in_month(1704067200 + floor(event_value * 86400))"), instants() + out(f"date_part('day', last_day({_SECONDS}))"))
add("date_now", ranged("hour()", (), FINE), f"WITH {steps(FINE)} " + out("(s // 3600000) % 24", "st", labels=()))
add("time", ranged("time()", (), FINE), f"WITH {steps(FINE)} " + out("s / 1000.0", "st", labels=()))
add("vector", ranged("vector(time() / 2)", (), FINE), f"WITH {steps(FINE)} " + out("s / 2000.0", "st", labels=()))
add(
    "scalar",
    ranged("event_value / scalar(sum(event_value))"),
    instants() + ", x AS (SELECT s, sum(v) AS total FROM iv GROUP BY s) " + out("v / total", "iv JOIN x USING (s)"),
)
add("sort", ranged("sort_desc(event_value)"), instants() + out("v"))
add("absent", ranged('absent(event_value{user_id="1",event_type="click"})', BY_EVENT, FINE, lookback=DAY), instants(FINE, lookback=DAY) + "SELECT '1' AS user_id, 'click' AS event_type, s AS step_ts, CAST(1 AS DOUBLE) AS v FROM st WHERE s NOT IN (SELECT s FROM iv WHERE user_id = '1' AND event_type = 'click')")
add("label_replace", ranged('label_replace(event_value, "kind", "${1}_x", "event_type", "(.).*k")', (*BY_EVENT, "kind")), instants() + "SELECT user_id, event_type, CASE WHEN event_type LIKE '%k' THEN event_type[1] || '_x' END AS kind, s AS step_ts, round(v, 6) AS v FROM iv")
add("label_join", ranged('label_join(event_value, "both", "-", "event_type", "user_id")', (*BY_EVENT, "both")), instants() + "SELECT user_id, event_type, event_type || '-' || user_id AS both, s AS step_ts, round(v, 6) AS v FROM iv")

_SHIPPED, _MONTH = 788_918_400_000, 30 * DAY
_HIST = f"""WITH {steps((84, _MONTH), _SHIPPED)},
n AS (SELECT s, l_returnflag, le, CAST(count(*) FILTER (WHERE l_quantity <= le) AS DOUBLE) AS c
  FROM lineitem JOIN st ON epoch_us(l_shipdate) // 1000 BETWEEN s - {_MONTH} AND s, (VALUES (10.0), (20.0), (30.0), (40.0), (50.0), ('inf'::DOUBLE)) b(le) GROUP BY ALL),
n2 AS (SELECT *, max(c) OVER (PARTITION BY s, l_returnflag) AS total, lag(c) OVER w AS c0, lag(le) OVER w AS le0 FROM n WHERE c > 0 WINDOW w AS (PARTITION BY s, l_returnflag ORDER BY le)),
hit AS (SELECT *, row_number() OVER (PARTITION BY s, l_returnflag ORDER BY le) AS k FROM n2 WHERE c >= 0.9 * total)
"""
add(
    "histogram_quantile",
    ranged("histogram_quantile(0.9, sum by (l_returnflag, le) (sum_over_time(lineitem_quantity_bucket[30d])))", ("l_returnflag",), (84, _MONTH), datasets.quantity_buckets, start=_SHIPPED),
    _HIST + "SELECT l_returnflag, s AS step_ts, round(CAST(CASE WHEN le = 'inf'::DOUBLE THEN le0 ELSE coalesce(le0, 0) + (le - coalesce(le0, 0)) * (0.9 * total - coalesce(c0, 0)) / (c - coalesce(c0, 0)) END AS DOUBLE), 6) AS v FROM hit WHERE k = 1",
)

# ---- binary operators ----

for _name, _op, _value in (("add", "+", "v + 7"), ("sub", "-", "v - 7"), ("mul", "*", "v * 7"), ("div", "/", "v / 7"), ("mod", "%", "fmod(v, 7)"), ("pow", "^", "pow(v, 2)")):
    add(f"arith_{_name}", ranged(f"event_value {_op} {2 if _op == '^' else 7}"), instants() + out(_value))
add("arith_scalar_left", ranged("100 - event_value"), instants() + out("100 - v"))
add("arith_by_zero", ranged("floor(event_value / 50) / (0 * time())"), instants() + out("CASE WHEN floor(v / 50) > 0 THEN 'inf'::DOUBLE ELSE 'nan'::DOUBLE END"))
for _name, _op, _sql in (("eq", "==", "="), ("ne", "!=", "<>"), ("gt", ">", ">"), ("lt", "<", "<"), ("ge", ">=", ">="), ("le", "<=", "<=")):
    add(f"cmp_{_name}", ranged(f"floor(event_value) {_op} 50"), instants() + out("floor(v)", where=f"floor(v) {_sql} 50"))
add("cmp_bool", ranged("event_value > bool 50"), instants() + out("CASE WHEN v > 50 THEN 1 ELSE 0 END"))
add("cmp_scalar_left", ranged("50 < event_value"), instants() + out("v", where="50 < v"))
add("cmp_scalars", ranged("time() > bool 1705000000", (), FINE), f"WITH {steps(FINE)} " + out("CASE WHEN s > 1705000000000 THEN 1 ELSE 0 END", "st", labels=()))

_SIDES = ", a AS (SELECT * FROM iv WHERE event_type = 'click'), b AS (SELECT s AS s2, user_id AS u2, event_type AS e2, v AS w FROM iv WHERE event_type = 'view') "
_BOTH = "a JOIN b ON s = s2 AND user_id = u2"
_A, _B = 'event_value{event_type="click"}', 'event_value{event_type="view"}'
add("join_on", ranged(f"{_A} - on (user_id) {_B}", ("user_id",)), instants() + _SIDES + out("v - w", _BOTH, labels=("user_id",)))
add("join_ignoring", ranged(f"{_A} - ignoring (event_type) {_B}"), instants() + _SIDES + out("v - w", _BOTH))
add("join_one_to_one", ranged("event_value / (event_value + 1)"), instants() + out("v / (v + 1)"))
add("join_compare", ranged(f"{_A} > on (user_id) {_B}"), instants() + _SIDES + out("v", _BOTH, "v > w"))
add("join_bool", ranged(f"{_A} > bool on (user_id) {_B}", ("user_id",)), instants() + _SIDES + out("CASE WHEN v > w THEN 1 ELSE 0 END", _BOTH, labels=("user_id",)))
_SUMS = ", x AS (SELECT s, event_type, sum(v) AS total FROM iv GROUP BY ALL) "
add("join_group_left", ranged("event_value / on (event_type) group_left sum by (event_type) (event_value)"), instants() + _SUMS + out("v / total", "iv JOIN x USING (s, event_type)"))
add("join_group_right", ranged("sum by (event_type) (event_value) - on (event_type) group_right event_value"), instants() + _SUMS + out("total - v", "iv JOIN x USING (s, event_type)"))
add(
    "join_group_left_labels",
    ranged(f'{_A} + on (user_id) group_left (event_type) {_B}'),
    instants() + _SIDES + "SELECT user_id, e2 AS event_type, s AS step_ts, round(v + w, 6) AS v FROM " + _BOTH,
)
_LOUD = ", loud AS (SELECT * FROM iv WHERE v > 50), late AS (SELECT * FROM iv WHERE v < 20) "
add("set_and", ranged("event_value and on (user_id) (event_value > 50)"), instants() + _LOUD + out("v", where="(s, user_id) IN (SELECT (s, user_id) FROM loud)"))
add("set_unless", ranged("event_value unless on (user_id) (event_value > 50)"), instants() + _LOUD + out("v", where="(s, user_id) NOT IN (SELECT (s, user_id) FROM loud)"))
add(
    "set_or",
    ranged("(event_value > 50) or on (user_id) (event_value < 20)"),
    instants() + _LOUD + f"{out('v', 'loud')} UNION ALL {out('v', 'late', '(s, user_id) NOT IN (SELECT (s, user_id) FROM loud)')}",
)

# ---- lookups ----

_FROM, _TO = START + 5 * DAY, START + 6 * DAY


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Engine(datasets.event_value(spark, sf_dir)).series(['event_value{event_type="click"}', 'event_value{event_type="view"}'], _FROM, _TO)
    return found.select("key", *[F.col("labels")[c].alias(c) for c in BY_EVENT])


add(
    "series",
    _series,
    f"WITH {EV} SELECT DISTINCT 'event_value{{event_type=\"' || event_type || '\",user_id=\"' || user_id || '\"}}' AS key, user_id, event_type FROM ev WHERE event_type IN ('click', 'view') AND t BETWEEN {_FROM} AND {_TO}",
)
add("label_names", lambda spark, d: Engine(datasets.event_value(spark, d)).label_names(), "SELECT unnest(['__name__', 'event_type', 'user_id']) AS name")
add("label_values", lambda spark, d: Engine(datasets.event_value(spark, d)).label_values("user_id", ['event_value{event_type="click"}']), f"WITH {EV} SELECT DISTINCT user_id AS value FROM ev WHERE event_type = 'click'")
add(
    "order_price_total",
    ranged("sum by (o_orderstatus) (sum_over_time(order_price[30d]))", ("o_orderstatus",), (80, _MONTH), datasets.order_price, start=_SHIPPED),
    f"WITH {steps((80, _MONTH), _SHIPPED)} SELECT o_orderstatus, s AS step_ts, round(sum(o_totalprice), 6) AS v FROM orders JOIN st ON epoch_us(o_orderdate) // 1000 BETWEEN s - {_MONTH} AND s GROUP BY ALL",
)

# ---- ingestion and alerts ----


def _pushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a pushed request; of a series' samples at one time the first is kept."""
    events = datasets.table(spark, sf_dir, "events")
    sample = F.struct(datasets.millis(F.col("ts")).alias("timestamp_ms"), F.col("value").alias("value"))
    series = F.struct(F.lit("event_value").alias("name"), F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("job"), F.lit("client")).alias("labels"), F.array(sample).alias("samples"))
    body = F.to_json(F.struct(F.lit("events").alias("job"), F.col("user_id").cast("string").alias("instance"), F.array(series).alias("series")))
    requests = events.select(F.col("event_id").alias("request_id"), body.alias("body"), F.lit("host").alias("remote_host"), F.lit(0).cast("long").alias("received_ms"))
    rows = push.samples(requests).withColumn("sid", F.xxhash64(text_of(F.col("labels")))).withColumn("arrival", F.col("request_id"))
    return keep_first(rows).select(*[F.col("labels")[n].alias(n) for n in ("event_type", "instance", "job")], "t", "v")


def _exposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a line of text, parsed."""
    events = datasets.table(spark, sf_dir, "events")
    line = F.format_string('event_value{user_id="%d",event_type="%s"} %s %d', "user_id", "event_type", F.col("value").cast("string"), datasets.millis(F.col("ts")))
    rows = exposition.samples(events.select(line.alias("value")))
    return rows.select(*[F.col("labels")[n].alias(n) for n in BY_EVENT], F.col("timestamp_ms").alias("t"), "v")


_RULE_AT = START + 5 * DAY


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule evaluated twice: what the second evaluation makes of each instance."""
    engine = Engine(datasets.event_value(spark, sf_dir), LOOKBACK)
    rule = evaluate.Rule("loud", "loud users", "sum by (user_id) (event_value) > 50", "warning")
    known = evaluate.transitions(spark.createDataFrame([], evaluate.INSTANCES), evaluate.observed(engine, rule, _RULE_AT), rule, _RULE_AT, cap=None)
    after = evaluate.transitions(known, evaluate.observed(engine, rule, _RULE_AT + 3 * HOUR), rule, _RULE_AT + 3 * HOUR, cap=None)
    return after.select(F.col("labels")["user_id"].alias("user_id"), "before", "state", F.round("value", 6).alias("value"))


add("ingest_push", _pushed, "SELECT event_type, CAST(user_id AS VARCHAR) AS instance, 'events' AS job, epoch_us(ts) // 1000 AS t, arg_min(value, event_id) AS v FROM events GROUP BY ALL")
add("ingest_exposition", _exposed, "SELECT CAST(user_id AS VARCHAR) AS user_id, event_type, epoch_us(ts) // 1000 AS t, value AS v FROM events")
add(
    "alert_transitions",
    _alerts,
    f"""WITH {EV},
a AS (SELECT user_id, sum(v) AS v FROM (SELECT user_id, event_type, arg_max(v, t) AS v FROM ev WHERE t BETWEEN {_RULE_AT - LOOKBACK} AND {_RULE_AT} GROUP BY ALL) GROUP BY user_id HAVING sum(v) > 50),
b AS (SELECT user_id, sum(v) AS v FROM (SELECT user_id, event_type, arg_max(v, t) AS v FROM ev WHERE t BETWEEN {_RULE_AT + 3 * HOUR - LOOKBACK} AND {_RULE_AT + 3 * HOUR} GROUP BY ALL) GROUP BY user_id HAVING sum(v) > 50)
SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.v IS NULL THEN 'ok' ELSE 'firing' END AS before, CASE WHEN b.v IS NULL THEN 'resolved' ELSE 'firing' END AS state, round(coalesce(b.v, a.v), 6) AS value
FROM a FULL JOIN b ON a.user_id = b.user_id""",
)
