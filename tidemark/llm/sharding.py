"""Sharding by a hierarchical weighted hash tree (region, rack, shard).

Each shard draws ``-ln(u) / weight`` from a hash of the row's id and its own name, and a rack or region
draws the least of what is below it, which is how a draw with the sum of the weights is distributed.
A row descends from the root: at each level it goes to the child with the smallest draw, so children win
in proportion to their weights. A draw depends on what is below it alone. When a weight changes, rows
move only into or out of the subtrees that hold it; a shard more takes rows only into itself, at any number
of shards. ``tree_of`` deals shards to racks and racks to regions.

Slots number the rows of a shard from 0 without gaps. A shard's rows are spread over buckets by
hash; buckets are counted first, so each task ranks one bucket and adds the bucket's offset, and no
task sees a whole shard. A bucket that is far too large holds a row that is repeated very often: such rows are
interchangeable, and are dealt to parts of their own by the place they were read from.

Edge cases: a null id is an id like any other; a null text has no bytes (size 1) and crc32 0; equal
rows are interchangeable; an empty table gives an empty result; other columns are carried on request,
and new columns replace any of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Rows that one task ranks at a time, about.
BUCKET_ROWS = 20_000
#: Names of shards to weights, by rack, by region.
Tree = list[list[list[tuple[int, float]]]]
_NEW = ("doc_id", "size", "text_crc32", "law", "region", "rack", "shard", "slot", "grown_shard")


def tree_of(shards: int, per_rack: int = 4, racks: int = 2) -> Tree:
    """Shards of equal weight, ``per_rack`` to a rack and ``racks`` racks to a region."""
    leaves = [(s, 1.0) for s in range(shards)]
    by_rack = [leaves[i : i + per_rack] for i in range(0, shards, per_rack)]
    return [by_rack[i : i + racks] for i in range(0, len(by_rack), racks)]


def leaves_of(tree: Tree) -> list[tuple[int, int, int, float]]:
    """(region, rack, shard, weight) of the shards that can be chosen."""
    return [(r, k, s, w) for r, region in enumerate(tree) for k, rack in enumerate(region) for s, w in rack if w > 0]


def draws(key: Column, tree: Tree) -> Column:
    """An array of (draw, region, rack, shard), one for each shard."""
    leaves = F.array(*[F.struct(F.lit(f"s/{s}").alias("name"), F.lit(float(w)).alias("w"), F.lit(r).alias("region"), F.lit(k).alias("rack"), F.lit(s).alias("shard")) for r, k, s, w in leaves_of(tree)])
    # 53 random bits give a u in (0, 1)
    bits = lambda x: F.shiftrightunsigned(F.xxhash64(key, x["name"]), 11).cast("double")
    return F.transform(leaves, lambda x: F.struct((-F.log((bits(x) + 0.5) / float(1 << 53)) / x["w"]).alias("draw"), x["region"].alias("region"), x["rack"].alias("rack"), x["shard"].alias("shard")))


def descend(drawn: Column) -> Column:
    """(draw, region, rack, shard) that a row reaches: the child with the least draw at each level, ties to the first.

    A region or rack draws the least of what is below it, so every level holds the least draw of all: one pass finds it.
    """
    return F.array_min(drawn)


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard that ``key`` reaches in ``tree``."""
    return descend(draws(key, tree))["shard"].cast("int")


def _ranked(slim: DataFrame, shards: int, rows: int) -> DataFrame:
    """``slim`` (shard, doc_id, text_crc32, size, __row, ...) with slot."""
    buckets = 1 << max(0, math.ceil(math.log2(max(1, rows / shards / BUCKET_ROWS))))
    kind = F.xxhash64("doc_id", "text_crc32", "size")
    slim = slim.withColumn("__b", F.pmod(kind, F.lit(buckets)).cast("int")).withColumn("__kind", F.lit(0).cast("long")).withColumn("__part", F.lit(0))
    large = [(r.shard, r["__b"]) for r in slim.groupBy("shard", "__b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 4 * BUCKET_ROWS).collect()]  # no more than rows / BUCKET_ROWS
    if large:
        there = slim.sparkSession.createDataFrame(large, "shard int, __b int")
        often = slim.join(F.broadcast(there), ["shard", "__b"]).groupBy("shard", "__b", kind.alias("__k")).agg(F.count(F.lit(1)).alias("__m")).filter(F.col("__m") > BUCKET_ROWS)
        often = F.broadcast(often.select(F.col("__k"), F.ceil(F.col("__m") / BUCKET_ROWS).cast("int").alias("__parts")).distinct())
        slim = slim.drop("__kind", "__part").withColumn("__k", kind).join(often, "__k", "left")
        slim = slim.withColumn("__kind", F.when(F.col("__parts").isNotNull(), F.col("__k")).otherwise(0)).withColumn("__part", F.coalesce(F.pmod("__row", F.col("__parts")), F.lit(0)).cast("int")).drop("__k", "__parts")
    by = ["shard", "__b", "__kind", "__part"]
    counts = slim.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("shard").orderBy("__b", "__kind", "__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*by, F.coalesce(before, F.lit(0)).alias("__offset"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("doc_id", "text_crc32", "size", "__row")) - 1
    if buckets * shards <= 100_000:  # a few numbers for each bucket
        offsets = F.broadcast(offsets)
    return slim.withColumn("__rank", rank).join(offsets, by).withColumn("slot", (F.col("__rank") + F.col("__offset")).cast("long"))


def shard(docs: DataFrame, shards: int = 16, carry: Sequence[str] = ()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, size, text_crc32, law, region, rack, shard, slot, grown_shard.

    ``carry`` names columns of ``docs`` to keep; new columns replace any of the same name.
    """
    carry = [c for c in carry if c not in _NEW]
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    # a tree of one shard more has the same leaves and draws, and the new one
    drawn = draws(key, tree_of(shards + 1))
    slim = docs.select(
        *[F.col(c).alias(f"__keep_{c}") for c in carry],
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        drawn.alias("__drawn"),
        F.xxhash64(F.monotonically_increasing_id()).alias("__row"),
    )
    reached = descend(F.filter("__drawn", lambda x: x["shard"] < shards))
    slim = slim.withColumn("__to", reached).withColumn("shard", F.col("__to.shard").cast("int")).withColumn("grown_shard", descend(F.col("__drawn"))["shard"].cast("int")).drop("__drawn")
    # written once: what is ranked and what is counted are the same rows, in the same places
    slim = Scratch(docs.sparkSession, "sharding").write(slim, "slim")
    return _ranked(slim, shards, slim.count()).select(
        *[F.col(f"__keep_{c}").alias(c) for c in carry],
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        F.col("__to.region").cast("int").alias("region"),
        F.col("__to.rack").cast("int").alias("rack"),
        "shard",
        "slot",
        "grown_shard",
    )
