"""Pushed samples: JSON requests, checked and turned into samples as one DataFrame plan.

A request is taken whole or not at all: one bad series, a missing job, or too many samples rejects it.
The server's labels (name, job, instance) win over those of a client.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..lang.tree import NAME

MAX_BODY = 16 << 20
SCHEMA = "job string, instance string, series array<struct<name:string,labels:map<string,string>,value:variant,samples:array<struct<timestamp_ms:bigint,value:variant>>>>"
#: The one error of a request that is well-formed.
TOO_MANY = "too many samples"
_METRIC, _LABEL = r"\A[A-Za-z_:][A-Za-z0-9_:]*\z", r"\A[A-Za-z_][A-Za-z0-9_]*\z"


def _number(v: Column) -> Column:
    """A JSON number, or one of the words for what JSON has no number for; null for anything else."""
    kind = F.schema_of_variant(v)
    word = F.try_variant_get(v, "$", "string")
    special = F.when(word == "NaN", F.lit(float("nan"))).when(word.isin("+Inf", "Inf"), F.lit(float("inf"))).when(word == "-Inf", F.lit(float("-inf")))
    return F.when(kind == "STRING", special).when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double"))


def _is_null(v: Column) -> Column:
    return v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(False))


def _series_error(s: Column) -> Column:
    names = F.map_keys(s["labels"])
    valued, sampled = ~_is_null(s["value"]), s["samples"].isNotNull() & (F.size(s["samples"]) > 0)
    return (
        F.when(~F.coalesce(s["name"].rlike(_METRIC), F.lit(False)), "invalid metric name")
        .when(F.coalesce(F.exists(names, lambda n: ~n.rlike(_LABEL)), F.lit(False)), "invalid label name")
        .when(F.coalesce(F.exists(names, lambda n: F.startswith(n, F.lit("__")) & (n != NAME)), F.lit(False)), "reserved label name")
        .when(valued == sampled, "exactly one of value and samples is needed")
        .when(valued & _number(s["value"]).isNull(), "invalid value")
        .when(sampled & F.exists(s["samples"], lambda x: _number(x["value"]).isNull()), "invalid value")
    )


def parsed(requests: DataFrame, sample_limit: int = 0) -> DataFrame:
    """From (request_id, body, remote_host, received_ms): the same with the request and its error, if any."""
    out = requests.withColumn("r", F.from_json("body", SCHEMA))
    series = F.col("r.series")
    total = F.aggregate(series, F.lit(0), lambda a, s: a + F.when(s["samples"].isNotNull() & (F.size(s["samples"]) > 0), F.size(s["samples"])).otherwise(1))
    errors = F.array_compact(F.transform(series, _series_error))
    error = (
        F.when(F.octet_length("body") > MAX_BODY, "request too large")
        .when(F.col("r").isNull() | (F.coalesce(F.col("r.job"), F.lit("")) == ""), "job is needed")
        .when(series.isNull() | (F.size(series) == 0), "series are needed")
        .when(F.size(errors) > 0, F.get(errors, F.lit(0)))
    )
    if sample_limit:
        error = error.when(total > sample_limit, TOO_MANY)
    return out.withColumn("error", error)


def samples(requests: DataFrame, sample_limit: int = 0) -> DataFrame:
    """Samples of the requests without error: (request_id, nth, labels, t, v), in order of arrival."""
    good = parsed(requests, sample_limit).filter("error is null")
    each = good.select("request_id", "received_ms", F.col("r.job").alias("job"), F.coalesce(F.nullif(F.col("r.instance"), F.lit("")), F.col("remote_host"), F.lit("")).alias("instance"), F.posexplode("r.series").alias("i", "s"))
    own = F.create_map(F.lit(NAME), F.col("s.name"), F.lit("job"), F.col("job"), F.lit("instance"), F.col("instance"))
    labels = L.overlay(F.coalesce(F.col("s.labels"), L.empty()), own)
    single = F.array(F.struct(F.lit(0).cast("long").alias("timestamp_ms"), F.col("s.value").alias("value")))
    several = F.col("s.samples").isNotNull() & (F.size("s.samples") > 0)
    each = each.select("request_id", "received_ms", "i", labels.alias("labels"), F.posexplode(F.when(several, F.col("s.samples")).otherwise(single)).alias("k", "x"))
    t = F.when(F.coalesce(F.col("x.timestamp_ms"), F.lit(0)) == 0, F.col("received_ms")).otherwise(F.col("x.timestamp_ms"))
    return each.select("request_id", (F.col("i").cast("long") * (1 << 32) + F.col("k")).alias("nth"), "labels", t.cast("long").alias("t"), _number(F.col("x.value")).alias("v"))


def sources(requests: DataFrame, sample_limit: int = 0) -> DataFrame:
    """Per (job, instance): requests taken and rejected, the last time and the last error."""
    rows = parsed(requests, sample_limit)
    instance = F.coalesce(F.nullif(F.col("r.instance"), F.lit("")), F.col("remote_host"), F.lit(""))
    return rows.groupBy(F.coalesce("r.job", F.lit("")).alias("job"), instance.alias("instance")).agg(
        F.count_if(F.col("error").isNull()).alias("accepted"),
        F.count_if(F.col("error").isNotNull()).alias("rejected"),
        F.max("received_ms").alias("last_push_ms"),
        F.max_by("error", F.when(F.col("error").isNotNull(), F.col("received_ms"))).alias("last_error"),
    )
