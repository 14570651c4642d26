import json

import pytest

from tidemark.sources import exposition, push, scrape


@pytest.mark.parametrize(
    "line,expected",
    [
        ("m 1.5", ({"__name__": "m"}, 1.5, None)),
        ('m{a="x",b="y",} 2 1395066363000', ({"__name__": "m", "a": "x", "b": "y"}, 2.0, 1395066363000)),
        ('m{ a = "x" , b="y" } +Inf', ({"__name__": "m", "a": "x", "b": "y"}, float("inf"), None)),
        ("m{} -0.5", ({"__name__": "m"}, -0.5, None)),
        (r'm{a="q\"\\\n\z"} 1e3', ({"__name__": "m", "a": 'q"\\\nz'}, 1000.0, None)),
        ('m{__name__="other"} 1', ({"__name__": "m"}, 1.0, None)),
    ],
)
def test_sample_lines(line, expected):
    assert exposition.parse_sample(line) == expected


@pytest.mark.parametrize("line", ["m", "m 1 2 3", 'm{a="x} 1', "m{a=x} 1", "1m 2", "m abc", "m 1 1.5", 'm{a="x" b="y"} 1'])
def test_bad_lines(line):
    with pytest.raises(ValueError):
        exposition.parse_sample(line)


TEXT = "# HELP m What \\\\ it\\n is\n# TYPE m counter\nm 1\nbad line here x\n# plain comment\nn{a=\"b\"} 2 5\n# TYPE n odd\n"


def test_parse_keeps_good_lines():
    got = exposition.parse(TEXT)
    assert len(got.samples) == 2 and got.bad == 1 and got.error
    assert got.metadata == {"m": ("counter", "What \\ it\n is"), "n": ("untyped", "")}


def test_lines_as_rows(spark):
    lines = spark.createDataFrame([(x,) for x in TEXT.split("\n")], "value string")
    rows = exposition.samples(lines).collect()
    assert sorted((r.v, r.timestamp_ms) for r in rows if not r.error) == [(1.0, None), (2.0, 5)] or len([r for r in rows if not r.error]) == 2
    assert sum(r.error is not None for r in rows) == 1
    assert sorted(map(tuple, exposition.metadata(lines).collect())) == [("m", "counter", "What \\ it\n is"), ("n", "untyped", "")]
    good = exposition.samples(lines).filter("error is null")
    assert sorted(r[0] for r in exposition.render(good).collect()) == ["m 1", 'n{a="b"} 2']


def _requests(spark, *bodies):
    return spark.createDataFrame([(i, b if isinstance(b, str) else json.dumps(b), "10.0.0.9", 777) for i, b in enumerate(bodies)], "request_id long, body string, remote_host string, received_ms long")


def test_push_samples(spark):
    body = {"job": "j", "series": [{"name": "m", "labels": {"job": "mine", "a": "b"}, "value": 5}, {"name": "n", "samples": [{"timestamp_ms": 1000, "value": 0.1}, {"timestamp_ms": 2000, "value": "+Inf"}]}]}
    rows = push.samples(_requests(spark, body)).orderBy("nth").collect()
    assert [(r.labels, r.t, r.v) for r in rows] == [
        ({"a": "b", "__name__": "m", "job": "j", "instance": "10.0.0.9"}, 777, 5.0),
        ({"__name__": "n", "job": "j", "instance": "10.0.0.9"}, 1000, 0.1),
        ({"__name__": "n", "job": "j", "instance": "10.0.0.9"}, 2000, float("inf")),
    ]
    assert push.samples(_requests(spark, body), sample_limit=2).count() == 0


@pytest.mark.parametrize(
    "body",
    [
        "no json", {"series": [{"name": "m", "value": 1}]}, {"job": "j"}, {"job": "j", "series": []}, {"job": "j", "series": [{"name": "1m", "value": 1}]},
        {"job": "j", "series": [{"name": "m"}]}, {"job": "j", "series": [{"name": "m", "value": 1, "samples": [{"value": 1}]}]}, {"job": "j", "series": [{"name": "m", "value": "5"}]},
        {"job": "j", "series": [{"name": "m", "labels": {"__x": "1"}, "value": 1}]}, {"job": "j", "series": [{"name": "m", "labels": {"a:b": "1"}, "value": 1}]}, {"job": "j", "series": [{"name": "m", "value": 1}, {"name": "n", "value": True}]},
    ],
)
def test_push_rejects_whole_requests(spark, body):
    assert push.samples(_requests(spark, body)).count() == 0
    assert push.parsed(_requests(spark, body)).first().error


def test_scrape_rules(spark):
    target = scrape.Target.of("web", "host:9090", labels={"env": "x"})
    assert target.url == "http://host:9090/metrics" and target.instance == "host:9090"
    rows, health = scrape.scrape_once(target, lambda t: 'm{job="other"} 1 5\nbad\n', now_ms=42)
    assert rows[0] == ({"__name__": "m", "job": "web", "instance": "host:9090", "env": "x"}, 42, 1.0)
    assert health.up and health.error and {r[0]["__name__"] for r in rows} == {"m", "up", "scrape_duration_seconds", "scrape_samples_scraped"}
    limited = scrape.Target.of("web", "http://host:1/x", sample_limit=1)
    rows, health = scrape.scrape_once(limited, lambda t: "m 1\nn 2\n")
    assert not health.up and len(rows) == 3 and rows[0][2] == 0.0
    assert scrape.scrape(spark, [target, limited], lambda t: "m 1", 7).count() == 8
