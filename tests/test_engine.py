import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.engine import Engine
from tidemark.lang import tree as q
from tidemark.store import Store, cap_series, keep_first, retain

NAN = math.nan


def _series(name, labels, points):
    return [({"__name__": name, **labels}, t, float(v)) for t, v in points]


ROWS = [
    *_series("m", {"job": "a"}, [(1000, 1), (2000, 2), (3000, 3)]),
    *_series("m", {"job": "a", "inst": "2"}, [(3000, 5)]),
    *_series("m", {"job": "b"}, [(1000, 10), (2000, 20), (3000, 30)]),
    *_series("c", {"job": "a"}, [(1000, 0), (2000, 100), (3000, 250)]),
    *_series("a", {"x": "1", "y": "p"}, [(3000, 10)]),
    *_series("a", {"x": "1", "y": "q"}, [(3000, 20)]),
    *_series("b", {"x": "1"}, [(3000, 2)]),
    *_series("up", {"job": "a"}, [(3000, 1)]),
    *_series("up", {"job": "b"}, [(3000, 1)]),
    *_series("down", {"job": "a"}, [(3000, 1)]),
    *[r for le, v in (("0.1", 1), ("0.5", 3), ("1", 4), ("+Inf", 5)) for r in _series("h_bucket", {"le": le}, [(3000, v)])],
    *[r for le, v in (("1", 2), ("2", 1), ("3", 9), ("+Inf", 9)) for r in _series("nm", {"le": le}, [(3000, v)])],
    *[r for k, v in (("a", 5), ("b", NAN), ("c", 2)) for r in _series("g", {"k": k}, [(3000, v)])],
    *_series("node:cpu:rate5m", {"x": "1"}, [(3000, 7)]),
]
SCHEMA = "labels map<string,string>, t long, v double"


@pytest.fixture(scope="module")
def engine(spark):
    store = Store.of_rows(spark.createDataFrame(ROWS, SCHEMA))
    return Engine(Store(store.series.cache(), store.samples.cache()))


def value(engine, query, ts=3000):
    got = engine.instant(query, ts)
    rows = got.frame.collect()
    return rows[0].v if got.kind == "scalar" else [(r.key, r.v) for r in rows]


@pytest.mark.parametrize(
    "query,expected",
    [
        ("2 ^ 3 ^ 2", 512), ("-2 ^ 2", -4), ("2 ^ -2", 0.25), ("1 / 0", math.inf), ('scalar(m{job="b"})', 30), ("1 == bool 1", 1),
        ("m", [('m{inst="2",job="a"}', 5), ('m{job="a"}', 3), ('m{job="b"}', 30)]),
        ("sum(m)", [("{}", 38)]), ("sum by (job) (m)", [('{job="a"}', 8), ('{job="b"}', 30)]),
        ("rate(c[5m])", [('{job="a"}', 125)]), ("irate(c[5m])", [('{job="a"}', 150)]), ("changes(c[5m])", [('{job="a"}', 2)]), ("deriv(c[5m])", [('{job="a"}', 125)]),
        ('m{job="b"} > bool 20', [('{job="b"}', 1)]), ("m > 20", [('m{job="b"}', 30)]), ("20 < m", [('m{job="b"}', 30)]),
        ("topk(1, m)", [('m{job="b"}', 30)]), ("bottomk(1, m)", [('m{job="a"}', 3)]), ("topk(0, m)", []), ("quantile(0.5, m)", [("{}", 5)]),
        ('count_values("val", m)', [('{val="3"}', 1), ('{val="30"}', 1), ('{val="5"}', 1)]),
        ("a / on (x) group_left b", [('{x="1",y="p"}', 5), ('{x="1",y="q"}', 10)]), ("b / on (x) group_right a", [('{x="1",y="p"}', 0.2), ('{x="1",y="q"}', 0.1)]),
        ("up and on (job) down", [('up{job="a"}', 1)]), ("up unless on (job) down", [('up{job="b"}', 1)]), ("up or down", [('up{job="a"}', 1), ('up{job="b"}', 1), ('down{job="a"}', 1)]),
        ('m{job="b"} offset 1s', [('m{job="b"}', 20)]), ('m{job="b"} @ 2.000', [('m{job="b"}', 20)]), ('max_over_time(m{job="b"}[3s:1s])', [('{job="b"}', 30)]),
        ("histogram_quantile(0.5, h_bucket)", [("{}", 0.4)]), ("histogram_quantile(0.3, nm)", [("{}", 2.1)]), ("histogram_quantile(2, nm)", [("{}", math.inf)]),
        ('label_replace(m{job="b"}, "dst", "$1", "job", "(.*)")', [('m{dst="b",job="b"}', 30)]), ('label_replace(m{job="b"}, "job", "", "job", "b")', [("m", 30)]),
        ('absent(nonexistent{foo="bar"})', [('{foo="bar"}', 1)]), ("absent(m)", []), ("clamp(m, 10, 0)", []), ("round(vector(2.5))", [("{}", 3)]),
        ("min(g)", [("{}", 2)]), ("day_of_week(vector(0))", [("{}", 4)]), ("max_over_time(node:cpu:rate5m[1m:30s])", [('{x="1"}', 7)]),
    ],
)
def test_instant(engine, query, expected):
    got = value(engine, query)
    if isinstance(expected, list):
        assert [k for k, _ in got] == [k for k, _ in expected]
        assert [v for _, v in got] == pytest.approx([v for _, v in expected])
    else:
        assert got == pytest.approx(expected)


def test_sorting_puts_nan_last(engine):
    assert [k for k, _ in value(engine, "sort(g)")] == ['g{k="c"}', 'g{k="a"}', 'g{k="b"}']
    assert [k for k, _ in value(engine, "sort_desc(g)")] == ['g{k="a"}', 'g{k="c"}', 'g{k="b"}']


def test_sample_time(engine):
    assert value(engine, 'timestamp(m{job="b"})', 3500) == [('{job="b"}', 3.0)]


def test_ranges(engine):
    assert [(r.t, r.v) for r in engine.range('m{job="b"}', 1000, 3000, 1000).frame.collect()] == [(1000, 10), (2000, 20), (3000, 30)]
    assert [(r.t, r.v) for r in engine.range('sum_over_time(m{job="b"}[2s:1s])', 1000, 4000, 1500).frame.collect()] == [(1000, 10), (2500, 30), (4000, 80)]
    with pytest.raises(q.QueryError):
        engine.range("1", 0, 100_000_000, 1)
    with pytest.raises(q.QueryError):
        engine.range("1", 1, 0, 1)


def test_lookups(engine):
    assert engine.series(["m"], 0, 999).count() == 0 and engine.series(["m", "up"], 0, 5000).count() == 5
    assert [r[0] for r in engine.label_names(["m"]).collect()] == ["__name__", "inst", "job"]
    assert [r[0] for r in engine.label_values("job").collect()] == ["a", "b"]


def test_store_rules(spark):
    rows = spark.createDataFrame([(1, 100, 1.0, 0), (1, 100, 2.0, 1), (1, 50, 9.0, 2), (1, 50, 8.0, 3)], "sid long, t long, v double, arrival long")
    assert sorted((r.t, r.v) for r in keep_first(rows).collect()) == [(50, 9.0), (100, 1.0)]
    known = spark.createDataFrame([(1,)], "sid long")
    assert cap_series(known, spark.createDataFrame([(2,), (3,)], "sid long"), 2).count() == 0
    assert cap_series(known, spark.createDataFrame([(1,), (3,)], "sid long"), 2).count() == 2
    store = Store.of_rows(spark.createDataFrame([({"a": "1"}, t, 0.0) for t in range(0, 1001, 100)] + [({"a": "2"}, 0, 0.0)], SCHEMA))
    kept = retain(store, 500)
    assert kept.samples.count() == 6 and kept.series.count() == 1


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 40), st.sampled_from([0.0, 1.0, 2.0, 5.0])), min_size=1, max_size=25, unique_by=lambda x: x[0]), st.sampled_from(["rate", "increase", "changes", "resets", "sum_over_time", "min_over_time", "delta", "irate"]))
def test_tiles_and_samples_agree(spark, points, name):
    store = Store.of_rows(spark.createDataFrame([({"__name__": "x"}, 1000 * t, v) for t, v in points], SCHEMA), distinct=True)
    plain = Engine(store).range(f"{name}(x[20s])", 0, 40_000, 5000).frame.collect()
    dense = Engine(Store(store.series, store.samples, interval_ms=1000)).range(f"{name}(x[20s])", 0, 40_000, 5000).frame.collect()
    assert [(r.t, r.v) for r in plain] == [(r.t, pytest.approx(r.v)) for r in dense]
    assert {r.t: r.v for r in plain} == pytest.approx(_fold(name, sorted(points)))


def _fold(name, points):
    """The same by walking over each window."""
    out = {}
    for s in range(0, 41, 5):
        w = [(t, v) for t, v in points if s - 20 <= t <= s]
        if not w:
            continue
        pairs = list(zip(w, w[1:]))
        rise = [b[1] - a[1] if b[1] >= a[1] else b[1] for a, b in pairs]
        if name in ("rate", "increase", "delta", "irate") and not pairs:
            continue
        out[1000 * s] = {
            "rate": lambda: sum(rise) / (w[-1][0] - w[0][0]),
            "increase": lambda: sum(rise),
            "changes": lambda: float(sum(a[1] != b[1] for a, b in pairs)),
            "resets": lambda: float(sum(b[1] < a[1] for a, b in pairs)),
            "sum_over_time": lambda: sum(v for _, v in w),
            "min_over_time": lambda: min(v for _, v in w),
            "delta": lambda: w[-1][1] - w[0][1],
            "irate": lambda: rise[-1] / (w[-1][0] - w[-2][0]),
        }[name]()
    return out


def test_limits_of_points(engine):
    assert engine.range_frame("vector(1)", 0, 10_999, 1) is not None
    for ask in (lambda: engine.range_frame("vector(1)", 0, 11_000, 1), lambda: engine.instant("count_over_time(vector(1)[11000s:1s])", 0)):
        with pytest.raises(q.QueryError):
            ask()


def test_a_union_keeps_what_both_stores_know(spark, tmp_path):
    rows = [({"__name__": "m"}, 1000 * i, float(i)) for i in range(5)]
    Store.of_rows(spark.createDataFrame(rows, "labels map<string,string>, t long, v double")).write(str(tmp_path / "a"))
    one = Store.read(spark, str(tmp_path / "a"))
    assert one.interval_ms == 1000 and one.by_day
    both = one.union(Store.read(spark, str(tmp_path / "a")))
    assert both.by_day and both.interval_ms == 1000 and "day" in both.samples.columns
    plain = one.union(Store(one.series, one.samples.select("sid", "t", "v")))
    assert not plain.by_day and plain.interval_ms is None


def _plan(frame):
    return frame._jdf.queryExecution().toString()


def test_plans(spark):
    from tidemark import datasets

    engine = Engine(datasets.event_value(spark, "/root/testdata/sf0.001"))
    at = 1_704_500_000_000
    for query in ("topk(3, event_value)", "min(event_value)", "event_value + event_value", "event_value / on (user_id) group_left sum by (user_id) (event_value)"):
        assert "SinglePartition" not in _plan(engine.range_frame(query, at, at + 7_200_000, 3_600_000)), query
    scan = _plan(engine.range_frame("rate(event_value[1h])", at, at + 7_200_000, 3_600_000))
    assert "GreaterThanOrEqual(ts," in scan and "LessThan(ts," in scan


def test_samples_are_dealt_by_the_steps_they_are_spread_to(spark, monkeypatch):
    from tidemark import datasets
    from tidemark.plans import compiler

    engine = Engine(datasets.event_value(spark, "/root/testdata/sf0.001"), 6 * 3_600_000)
    start, hour = 1_704_067_200_000, 3_600_000
    queries = ("sum by (event_type) (rate(event_value[6h]))", "max by (event_type) (event_value)", "topk by (event_type) (3, event_value)", "max_over_time(event_value[6h:1h])")
    asked = lambda query: engine.range_frame(query, start, start + 720 * hour, hour)
    shown = lambda frame: sorted((r.key, r.t, r.v) for r in frame.collect())
    plain = [shown(asked(query)) for query in queries]
    monkeypatch.setattr(compiler, "TASK_ROWS", 500)
    monkeypatch.setattr(compiler, "SMALL_BYTES", 0)
    dealt = [asked(query) for query in queries]
    # 1000 samples at 7 steps each; those of the subquery again at 7
    for query, frame, parts in zip(queries, dealt, (14, 14, 14, 98)):
        assert "hashpartitioning(sid#" in _plan(frame) and f", {parts}), REPARTITION_BY_NUM" in _plan(frame), query
    assert [shown(frame) for frame in dealt] == [[(k, t, pytest.approx(v)) for k, t, v in rows] for rows in plain]
    assert "REPARTITION_BY_NUM" not in _plan(engine.range_frame("event_value", start, start, hour))


def test_sizes_of_what_is_not_in_files_are_not_guessed(spark):
    from tidemark.store import estimated_bytes

    files = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert 0 < estimated_bytes(files.select("ts", "value")) < estimated_bytes(files) < 1 << 20
    assert estimated_bytes(files.join(files, "event_id")) <= 2 * estimated_bytes(files)
    assert estimated_bytes(spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "x long")) is None


def test_count_values_makes_texts_of_numbers_not_of_samples(spark):
    values = [0.0, NAN, math.inf, -math.inf, 1.5, 1.5, 1e21, 1.25e-7, -1e-5, 123456.0, 1234567.0, 0.1 + 0.2, 0.0, NAN]
    rows = [r for i, v in enumerate(values) for r in _series("m", {"i": str(i), "k": str(i % 2)}, [(1000, v)])]
    got = Engine(Store.of_rows(spark.createDataFrame(rows, SCHEMA), distinct=True)).instant('count_values by (k) ("val", m)', 1000).frame
    texts = ["0", "NaN", "+Inf", "-Inf", "1.5", "1.5", "1e+21", "1.25e-07", "-1e-05", "123456", "1.234567e+06", "0.30000000000000004", "0", "NaN"]
    pairs = [(str(i % 2), x) for i, x in enumerate(texts)]
    assert {(r.labels["k"], r.labels["val"]): r.v for r in got.collect()} == {p: pairs.count(p) for p in pairs}
    assert "_groupingexpression" not in _plan(got)  # samples are grouped as they are, not by a text made of each
