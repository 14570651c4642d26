"""Mixing sources to target weights by capped water-filling.

Every source asks for its share of a budget by weight. A source never gives more than
``max_epochs`` times its own size, so targets above that cap are clamped and the excess is shared
again among the rest by weight until no target is above its cap. A source with target ``r`` times
its size gives every document ``floor(r)`` whole times, and once more to documents chosen by a
seeded hash, so that the extra words meet the fractional rest.

The choice is exact without ordering a source: documents fall into 4096 cells by hash. The one
cell of each source in which the running sum of sizes crosses the rest is split into 4096 finer
cells, and in the finer crossing cell rows are grouped by what they hold. Equal rows take one more
copy for as many of them as fit; which ones is settled by the place they were read from. A source or
a text that holds a third of all rows is thus summed before it is shuffled, and no task ranks it.

Weights go by the order of sources, so their number matters twice: up to ``DRIVER_SOURCES`` the table of sources
is filled on the driver; beyond that, ranks come from counts by range and the water level from repeated sums.

Edge cases: a null text has size 0; a null source is a source of its own (last in order); an empty
table gives an empty result; equal rows are interchangeable, so reruns agree up to which of them is which;
a source at its cap takes no document once more, not even an empty one; a source whose size
is 0 has target 0 and its documents are taken 0 times. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Up to here the table of sources is filled on the driver (under 100 bytes each).
DRIVER_SOURCES = 100_000
#: Up to here the table of sources (under 100 bytes each) is sent to every executor.
BROADCAST_SOURCES = 10_000
_CELLS = 4096
_SCHEMA = "__source string, source_size long, target double, whole long, rest double"


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space and U+0009 to U+000D; null is 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sizes: Sequence[float], weights: Sequence[float], share: float, max_epochs: float) -> list[float]:
    """Targets that share ``share`` times the total by weight, none above ``max_epochs`` times its size."""
    targets, left, budget = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while left and budget > 0:
        total = sum(weights[i] for i in left)
        if total <= 0:
            break
        over = [i for i in left if budget * weights[i] / total >= max_epochs * sizes[i]]
        if not over:
            for i in left:
                targets[i] = budget * weights[i] / total
            break
        for i in over:
            targets[i] = max_epochs * sizes[i]
        budget -= sum(targets[i] for i in over)
        left -= set(over)
    return targets


def _filled(totals: list[tuple[str | None, int]], weights: Sequence[float], share: float, max_epochs: float) -> list[tuple]:
    totals = sorted(totals, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    sizes = [s for _, s in totals]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, max_epochs)
    plan = []
    for (source, size), target in zip(totals, targets, strict=True):
        whole = int(target // size) if size else 0
        plan.append((source, size, float(target), whole, float(target - whole * size)))
    return plan


def _filled_apart(totals: DataFrame, weights: Sequence[float], share: float, max_epochs: float, scratch: Scratch) -> DataFrame:
    """The same for a table (__source, source_size) of any length: only sums come to the driver."""
    # by range: all sources of a part come before those of the next, null last
    placed = totals.repartitionByRange(F.col("__source").isNull(), F.col("__source")).withColumn("__part", F.spark_partition_id())
    placed = scratch.write(placed, "by_range")
    parts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = parts.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("before"))  # a row for each part
    nth = F.row_number().over(Window.partitionBy("__part").orderBy(F.col("__source").isNull(), "__source")) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("nth") + F.col("before")) % len(weights)).cast("int"))
    weighted = placed.withColumn("nth", nth).join(F.broadcast(before), "__part").select("__source", "source_size", weight.alias("w"))
    weighted = scratch.write(weighted, "weighted")
    cap = F.lit(float(max_epochs)) * F.col("source_size")
    budget = share * (weighted.agg(F.sum("source_size")).first()[0] or 0)
    level = -1.0
    while True:  # the level only rises; each round clamps one source more at least
        over = cap <= level * F.col("w")
        clamped, total = weighted.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("w")))).first()
        following = (budget - (clamped or 0.0)) / total if total else level
        if following <= level:
            break
        level = following
    target = F.least(cap, F.greatest(F.lit(0.0), F.lit(float(level)) * F.col("w")))
    whole = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size"))).otherwise(0).cast("long")
    return scratch.write(weighted.select("__source", "source_size", target.alias("target"), whole.alias("whole"), (target - whole * F.col("source_size")).alias("rest")), "sources")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken, copies.

    Sources in order of code point, null last, get ``weights`` in turn. The text is read once, for its size.
    """
    return _mixed(docs, weights, share, max_epochs, seed, ()).select("doc_id", "size", "source_size", "target", "taken", "copies")


def _mixed(docs: DataFrame, weights: Sequence[float], share: float, max_epochs: float, seed: int, carry: Sequence[str]) -> DataFrame:
    """The columns of ``mix``, and each column in ``carry`` under the name ``__keep_...``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    h = F.xxhash64(F.col("doc_id"), F.xxhash64("text"), F.lit(seed)).bitwiseAND(F.lit((1 << 48) - 1))
    slim = docs.select(
        *[F.col(c).alias(f"__keep_{c}") for c in carry],
        F.col("doc_id"),
        F.col("source").alias("__source"),
        word_count(F.col("text")).alias("size"),
        F.shiftright(h, 36).cast("int").alias("__c1"),
        F.shiftright(h, 24).bitwiseAND(F.lit(_CELLS - 1)).cast("int").alias("__c2"),
        h.alias("__h"),
        F.xxhash64("text").alias("__t"),
        F.xxhash64(F.monotonically_increasing_id()).alias("__row"),
    )
    slim = scratch.write(slim, "slim")
    cells = slim.groupBy("__source", "__c1").agg(F.sum("size").alias("s"))
    totals = cells.groupBy("__source").agg(F.sum("s").alias("source_size"))
    told = totals.limit(DRIVER_SOURCES + 1).collect()
    if len(told) <= DRIVER_SOURCES:
        plan = _filled([(r[0], int(r[1])) for r in told], weights, share, max_epochs)
        sources, n_sources = spark.createDataFrame(plan, _SCHEMA), len(plan)
    else:
        sources = _filled_apart(scratch.write(totals, "totals"), weights, share, max_epochs, scratch)
        n_sources = DRIVER_SOURCES + 1
    small = n_sources <= BROADCAST_SOURCES
    side = lambda df: F.broadcast(df) if small else df

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("__source", "__r")
        return left.join(side(right), left["__source"].eqNullSafe(right["__r"]), "left").drop("__r")

    def crossing(cells: DataFrame, cell: str, rest: str, x: str) -> DataFrame:
        """Per source the cell in which the running sum of s crosses ``rest`` (as ``x``), and what is left of it there."""
        before = F.coalesce(F.sum("s").over(Window.partitionBy("__source").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        hit = cells.withColumn("__before", before).filter((F.col("__before") <= F.col(rest)) & (F.col("__before") + F.col("s") > F.col(rest)))
        return hit.select("__source", F.col(cell).alias(x), (F.col(rest) - F.col("__before")).alias(f"{x}_rest"))

    first = crossing(joined(cells, sources.select("__source", "rest").filter("rest > 0")).filter("rest is not null"), "__c1", "rest", "__x1")
    inside = joined(slim.select("__source", "__c1", "__c2", "size"), first).filter("__c1 = __x1")
    fine = inside.groupBy("__source", "__c2", "__x1_rest").agg(F.sum("size").alias("s"))
    second = crossing(fine, "__c2", "__x1_rest", "__x2")
    marks = joined(joined(sources, first), second)
    marks = spark.createDataFrame(marks.collect(), marks.schema) if small else scratch.write(marks, "marks")
    rows = joined(slim, marks)
    lower = (F.col("__c1") < F.col("__x1")) | ((F.col("__c1") == F.col("__x1")) & (F.col("__x2").isNull() | (F.col("__c2") < F.col("__x2"))))
    below = (F.col("rest") > 0) & F.when(F.col("__x1").isNull(), F.lit(True)).otherwise(lower)
    edge = F.coalesce((F.col("__c1") == F.col("__x1")) & (F.col("__c2") == F.col("__x2")), F.lit(False))
    # in the finer crossing cell: kinds of equal rows, in order of their hash, and how many of each fit
    kind = ["__source", "__h", "doc_id", "__t", "size"]
    at_edge = rows.filter(edge)
    kinds = at_edge.groupBy(*kind, "__x2_rest").agg(F.count(F.lit(1)).alias("m"))
    up_to = Window.partitionBy("__source").orderBy("__h", "doc_id", "__t", "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("__x2_rest") - F.coalesce(F.sum(F.col("m") * F.col("size")).over(up_to), F.lit(0))
    fits = F.when(F.col("size") == 0, F.when(room >= 0, F.col("m")).otherwise(0)).otherwise(F.least(F.col("m"), F.greatest(F.lit(0), F.floor(room / F.col("size") + 0.5))))
    kinds = scratch.write(kinds.select(*kind, "m", fits.cast("long").alias("fits")), "kinds")
    # a kind of which some fit is split by place: cells below the crossing one fit whole, in that one rows are ranked
    split = kinds.filter("fits > 0 and fits < m").select(*[F.col(c).alias(f"{c}2") for c in kind], "fits")
    same = lambda df: [df[c].eqNullSafe(F.col(f"{c}2")) for c in kind]
    cell = F.shiftright(F.col("__row"), 52)
    some = at_edge.join(F.broadcast(split), same(at_edge)).drop(*[f"{c}2" for c in kind]).withColumn("__cell", cell)  # one kind for each source at most
    counted = some.groupBy(*kind, "__cell", "fits").agg(F.count(F.lit(1)).alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy(*kind).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = counted.select(*[F.col(c).alias(f"{c}2") for c in (*kind, "__cell")], "n", (F.col("fits") - ahead).alias("left"))
    some = some.drop("fits").join(counted, [*same(some), some["__cell"] == F.col("__cell2")]).drop(*[f"{c}2" for c in (*kind, "__cell")])
    nth = F.row_number().over(Window.partitionBy(*kind, "__cell").orderBy("__row"))
    partly = some.filter("left > 0 and left < n").withColumn("__up", nth <= F.col("left")).drop("n", "left", "__cell")
    wholly = some.filter("left <= 0 or left >= n").withColumn("__up", F.col("left") > 0).drop("n", "left", "__cell")
    plain = kinds.filter("fits = 0 or fits = m").select(*[F.col(c).alias(f"{c}2") for c in kind], (F.col("fits") > 0).alias("__up"))
    others = at_edge.join(plain, same(at_edge)).drop(*[f"{c}2" for c in kind])
    rest = rows.filter(~edge).withColumn("__up", below)
    copies = F.col("whole") + F.col("__up").cast("long")
    every = rest.unionByName(others).unionByName(wholly).unionByName(partly)
    return every.select(
        *[F.col(f"__keep_{c}") for c in carry],
        "doc_id",
        "size",
        "source_size",
        "target",
        (copies * F.col("size")).alias("taken"),
        copies.alias("copies"),
    )


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as ``mix`` takes it, with the columns of ``docs``."""
    taken = _mixed(docs, weights, share, max_epochs, seed, docs.columns)
    repeated = taken.filter("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select(*[F.col(f"__keep_{c}").alias(c) for c in docs.columns])
