"""From a typed tree to DataFrame plans that evaluate all steps at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ieee, numfmt
from ..functions import labels as L
from ..functions.regex import anchored, group_numbers, template_parts
from ..lang import tree as q
from ..store import Store, estimated_bytes
from . import ranges
from .grid import Grid, inner_grid
from .values import Scalar, Vector

LOOKBACK_MS = 300_000
SUBQUERY_STEP_MS = 60_000
#: From so many samples a step on, range functions sum tiles first.
DENSE = 4
#: About so many rows of one selection, each sample counted once for every step it can be spread to, go to one task.
TASK_ROWS = 1 << 20
#: Selections whose files, times those steps, have fewer bytes are dealt out as Spark does it.
SMALL_BYTES = 32 << 20


def _now() -> Column:
    return F.col("step_ts") / F.lit(1000.0)


class Compiler:
    """Compiles one query over a store; ``start`` and ``end`` are the bounds that @ start() and @ end() mean."""

    def __init__(self, store: Store, start: int, end: int, lookback_ms: int = LOOKBACK_MS):
        self.store, self.bounds, self.lookback = store, {"start": start, "end": end}, lookback_ms
        self.spark = store.samples.sparkSession
        self.names = 0
        self.copies = 1  # steps of the subqueries around what is compiled, to which each of its rows can go

    # ---- entry points ----

    def value(self, node: q.Node, grid: Grid, ordered: bool = False) -> Scalar | Vector:
        """``ordered``: something above depends on the order of elements within a step."""
        match node:
            case q.Number(value):
                return Scalar(ieee.number(value), constant=value)
            case q.Paren(inner):
                return self.value(inner, grid, ordered)
            case q.Selector():
                return self.selected(node, grid)
            case q.Negate(inner):
                got = self.value(inner, grid, ordered)
                if isinstance(got, Scalar):
                    return Scalar(-got.column, got.needs, None if got.constant is None else -got.constant)
                return got.unnamed().valued(-F.col("v"))
            case q.Aggregate():
                return self.aggregated(node, grid, ordered)
            case q.Binary():
                return self.binary(node, grid, ordered)
            case q.Call():
                return self.call(node, grid, ordered)
        raise q.QueryError("not an instant value")

    def scalar(self, node: q.Node, grid: Grid) -> Scalar:
        got = self.value(node, grid)
        if not isinstance(got, Scalar):
            raise q.QueryError("a scalar is needed")
        return got

    def vector(self, node: q.Node, grid: Grid, ordered: bool = False) -> Vector:
        got = self.value(node, grid, ordered)
        if not isinstance(got, Vector):
            raise q.QueryError("an instant vector is needed")
        return got

    # ---- selection ----

    def series(self, matchers: list[q.Matcher]) -> DataFrame:
        return self.store.series.filter(L.all_hold(F.col("labels"), matchers)).select("sid", "labels", F.col("key").alias("okey"))

    def dealt(self, samples: DataFrame, length: int, grid: Grid) -> DataFrame:
        """``samples`` by series, in partitions enough for all the steps they are spread to.

        Left to itself Spark chooses partitions by the bytes of the samples, before those are spread over the steps of
        ``length``; sorts and aggregations in the same task would then grow with the input.
        """
        copies = self.copies * grid.most_steps(length)
        size = estimated_bytes(samples)
        if grid.count == 1 or size is None or size * copies < SMALL_BYTES:
            return samples
        parts = -(-samples.count() * copies // TASK_ROWS)
        return samples.repartition(parts, "sid") if parts > self.spark.sparkContext.defaultParallelism else samples

    def _fixed(self, at: q.At | None) -> int | None:
        return None if at is None else at.ms if at.bound is None else self.bounds[at.bound]

    def selected(self, node: q.Selector, grid: Grid) -> Vector:
        """The latest sample of each series in the lookback before each step, both ends included."""
        dim, fixed = self.series(node.matchers), self._fixed(node.at)
        own = grid if fixed is None else Grid.at(fixed)
        samples = self.store.between(own.start - node.offset - self.lookback, own.end - node.offset)
        samples = self.dealt(samples, self.lookback, own).join(dim.select("sid"), "sid")
        if own.count == 1:
            latest = samples.groupBy("sid").agg(F.max_by(F.struct("t", "v"), "t").alias("x"))
            data = latest.select(F.lit(own.start).cast("long").alias("step_ts"), "sid", "x.t", "x.v")
        else:
            # a sample counts until the next one, or until it is too old
            following = F.lead("t").over(Window.partitionBy("sid").orderBy("t"))
            until = F.least(F.col("t") + self.lookback, F.coalesce(following - 1, F.col("t") + self.lookback))
            shown = samples.withColumn("__until", until)
            data = own.spread(shown, own.first_from(F.col("t") + node.offset), own.last_until(F.col("__until") + node.offset)).select("step_ts", "sid", "t", "v")
        if fixed is not None:
            data = grid.everywhere(data.drop("step_ts")).select("step_ts", "sid", "t", "v")
        return Vector(data, dim)

    def points(self, node: q.Node, grid: Grid) -> tuple[ranges.Points, int | None]:
        """What a range holds, on the grid of its selection times, and the fixed time if there is one."""
        if isinstance(node, q.Paren):
            return self.points(node.inner, grid)
        if isinstance(node, q.Window):
            sel = node.selector
            fixed = self._fixed(sel.at)
            own = grid if fixed is None else Grid.at(fixed)
            dim = self.series(sel.matchers)
            samples = self.store.between(own.start - sel.offset - node.range_ms, own.end - sel.offset)
            samples = self.dealt(samples, node.range_ms, own).join(dim.select("sid"), "sid")
            return ranges.Points(samples, dim, own, sel.offset, node.range_ms), fixed
        if isinstance(node, q.Subquery):
            fixed = self._fixed(node.at)
            own = grid if fixed is None else Grid.at(fixed)
            step = node.step_ms or SUBQUERY_STEP_MS
            inner = inner_grid(self.spark, own, node.offset, node.range_ms, step)
            around, self.copies = self.copies, self.copies * own.most_steps(node.range_ms)
            got = self.value(node.inner, inner)
            self.copies = around
            vector = got if isinstance(got, Vector) else self.constant_vector(got, inner)
            data = vector.data.select("sid", F.col("step_ts").alias("t"), "v")
            return ranges.Points(data, vector.dim, own, node.offset, node.range_ms, every=step), fixed
        raise q.QueryError("a range vector is needed")

    def over_time(self, name: str, node: q.Node, grid: Grid, scalar: Scalar | None = None) -> Vector:
        points, fixed = self.points(node, grid)
        dense = self.store.interval_ms is not None and points.every is None and points.grid.step >= DENSE * self.store.interval_ms
        data = ranges.apply(points, name, dense)
        if fixed is not None:
            data = grid.everywhere(data.drop("step_ts")).withColumn("t", F.col("step_ts"))
        if name in ("quantile_over_time", "predict_linear"):
            data = scalar.beside(data)
            if name == "quantile_over_time":
                v = ranges.quantile(scalar.column, F.col("a"))
            else:
                later = (F.col("step_ts") - fixed) / F.lit(1000.0) if fixed is not None else F.lit(0.0)
                v = F.col("slope") * (scalar.column + later) + F.col("intercept")
            data = data.select("step_ts", "sid", "t", v.alias("v"))
        out = Vector(data, points.dim)
        return out if name == "last_over_time" else out.unnamed()

    # ---- vectors without series ----

    def single(self, data: DataFrame, labels: dict[str, str]) -> Vector:
        """One element a step: ``data`` (step_ts, v) under the given labels."""
        dim = self.spark.range(1).select(F.lit(0).cast("long").alias("sid"), L.literal(labels).alias("labels"), F.lit("{}").alias("okey"))
        return Vector(data.select("step_ts", F.lit(0).cast("long").alias("sid"), F.col("step_ts").alias("t"), "v"), dim)

    def constant_vector(self, s: Scalar, grid: Grid) -> Vector:
        return self.single(s.beside(grid.frame(self.spark)).select("step_ts", s.column.alias("v")), {})

    # ---- aggregation ----

    def aggregated(self, node: q.Aggregate, grid: Grid, ordered: bool) -> Vector:
        picks = node.op in ("topk", "bottomk")
        by_order = ordered or picks or node.op in ("min", "max")
        vector = self.vector(node.inner, grid, by_order)
        labels = F.col("labels")
        group = L.drop(labels, [*node.labels, q.NAME]) if node.without else L.keep(labels, node.labels)
        if not node.without and not node.labels:
            data = (vector.ordered() if by_order else vector.data).withColumn("gid", F.lit(0).cast("long"))
            dim = self.single(self.spark.range(0).select(F.col("id").alias("step_ts"), F.lit(0.0).alias("v")), {}).dim.withColumnRenamed("sid", "gid")
        else:
            data, dim = vector.rekeyed(group, by_order)
        dim = dim.select(F.col("gid").alias("sid"), "labels", "okey")
        if picks:
            return self._picked(node, grid, vector, data)
        if node.op == "count_values":
            return self._values_counted(node, data, dim)
        v, real = F.col("v"), F.when(~F.isnan("v"), F.col("v"))
        # a NaN that comes first stays; a later one is passed over
        extreme = lambda f: F.when(F.isnan(F.min_by("v", "ord")), ieee.number(ieee.NAN)).otherwise(f(real))
        value = {
            "sum": lambda: F.sum(v),
            "avg": lambda: F.sum(v) / F.count(F.lit(1)),
            "min": lambda: extreme(F.min),
            "max": lambda: extreme(F.max),
            "count": lambda: F.count(F.lit(1)).cast("double"),
            "group": lambda: F.first(F.lit(1.0)),
            "stddev": lambda: F.stddev_pop(v),
            "stdvar": lambda: F.var_pop(v),
            "quantile": lambda: F.sort_array(F.collect_list(F.struct((~F.isnan("v")).alias("r"), v.alias("v")))),
        }[node.op]()
        extra = [F.min("ord").alias("ord")] if ordered else []
        out = data.groupBy("step_ts", F.col("gid").alias("sid")).agg(value.alias("v"), *extra).withColumn("t", F.col("step_ts"))
        if node.op == "quantile":
            s = self._parameter(node, grid)
            out = s.beside(out).withColumn("v", ranges.quantile(s.column, F.transform("v", lambda x: x["v"])))
        return Vector(out.select("step_ts", "sid", "t", "v", *(["ord"] if ordered else [])), dim)

    def _parameter(self, node: q.Aggregate, grid: Grid) -> Scalar:
        if isinstance(node.param, q.Text):
            return Scalar(F.lit(0.0), constant=0.0)  # a text counts as 0
        return self.scalar(node.param, grid)

    def _picked(self, node: q.Aggregate, grid: Grid, vector: Vector, data: DataFrame) -> Vector:
        s = self._parameter(node, grid)
        v = F.col("v").desc() if node.op == "topk" else F.col("v").asc()
        rank = F.row_number().over(Window.partitionBy("step_ts", "gid").orderBy(F.isnan("v"), v, "ord"))
        ranked = s.beside(data).withColumn("__rank", rank)
        if s.constant is not None:  # a literal bound is applied before the shuffle
            kept = ranked.filter(F.col("__rank") <= (int(max(0, min(s.constant, 2**31 - 1))) if s.constant == s.constant else 0))
        else:
            kept = ranked.filter(F.col("__rank") <= F.coalesce(ieee.to_long(s.column), F.lit(0)))
        return Vector(kept.select("step_ts", "sid", F.col("step_ts").alias("t"), "v", "ord"), vector.dim)

    def _values_counted(self, node: q.Aggregate, data: DataFrame, dim: DataFrame) -> Vector:
        name = node.param.value if isinstance(node.param, q.Text) else ""
        # equal numbers have equal texts and others do not: the text is made once per number and group, not per sample
        counted = data.groupBy("step_ts", "gid", F.col("v").alias("__number")).agg(F.count(F.lit(1)).cast("double").alias("v"))
        counted = counted.withColumn("sid", F.xxhash64("gid", "__number"))
        numbers = counted.select("sid", "gid", "__number").dropDuplicates(["sid"])
        pairs = numbers.select("sid", "gid", numfmt.text_of(F.col("__number")).alias("__text"))
        out = pairs.join(dim.withColumnRenamed("sid", "gid"), "gid")
        labels = L.with_label(F.col("labels"), name, F.col("__text"))
        return Vector(counted.select("step_ts", "sid", F.col("step_ts").alias("t"), "v"), out.select("sid", labels.alias("labels"), F.concat("okey", "__text").alias("okey")))

    # ---- binary operators ----

    def binary(self, node: q.Binary, grid: Grid, ordered: bool) -> Scalar | Vector:
        if node.op in q.SET_OPERATORS:
            return self._set(node, grid, ordered)
        kinds = q.kind_of(node.left), q.kind_of(node.right)
        compares = node.op in q.COMPARISONS
        if kinds == (q.SCALAR, q.SCALAR):
            a, b = self.scalar(node.left, grid), self.scalar(node.right, grid)
            column = ieee.compare(node.op, a.column, b.column).cast("double") if compares else ieee.arithmetic(node.op, a.column, b.column)
            return Scalar(column, a.needs + b.needs)
        if q.VECTOR in kinds and q.SCALAR in kinds:
            swapped = kinds[0] == q.SCALAR
            vector = self.vector(node.right if swapped else node.left, grid, ordered)
            s = self.scalar(node.left if swapped else node.right, grid)
            a, b = (s.column, F.col("v")) if swapped else (F.col("v"), s.column)
            if not compares:
                return vector.unnamed().valued(ieee.arithmetic(node.op, a, b), (s,))
            held = ieee.compare(node.op, a, b)
            return vector.unnamed().valued(held.cast("double"), (s,)) if node.as_bool else vector.valued(F.col("v"), (s,), keep=held)
        return self._joined(node, grid, ordered)

    @staticmethod
    def _signature(matching: q.Matching, keep_name: bool = False) -> Column:
        labels = F.col("labels")
        if not matching.given:
            return labels if keep_name else L.drop_name(labels)
        return L.keep(labels, matching.labels) if matching.on else L.drop(labels, [*matching.labels, q.NAME])

    def _joined(self, node: q.Binary, grid: Grid, ordered: bool) -> Vector:
        """Each row of the iterated side with the last match of the other side, by step and signature."""
        matching = node.matching
        right_iterates = matching.many == "right"
        left, right = self.vector(node.left, grid, True), self.vector(node.right, grid, True)
        many, one = (right, left) if right_iterates else (left, right)
        signature = self._signature(matching)
        rows = many.rekeyed(signature, ordered)[0]
        others = one.rekeyed(signature, True)[0].groupBy("step_ts", "gid").agg(F.max_by(F.struct(F.col("v").alias("ov"), F.col("sid").alias("osid")), "ord").alias("o"))
        met = rows.join(others, ["step_ts", "gid"]).select(*rows.columns, "o.ov", "o.osid")
        a, b = (F.col("ov"), F.col("v")) if right_iterates else (F.col("v"), F.col("ov"))
        rest = ["ord"] if ordered else []
        labels = L.keep(F.col("labels"), matching.labels) if matching.given and matching.on and not matching.many else L.drop_name(F.col("labels"))
        if node.op in q.COMPARISONS:
            held = ieee.compare(node.op, a, b)
            if not node.as_bool:
                return Vector(met.filter(held).select("step_ts", "sid", "t", "v", *rest), many.dim)
            value = held.cast("double")
        else:
            value = ieee.arithmetic(node.op, a, b)
        if not (matching.many and matching.include):
            return Vector(met.select("step_ts", "sid", "t", value.alias("v"), *rest), many.dim.withColumn("labels", labels))
        # labels taken over from the other side depend on the pair of series
        pair = met.withColumn("nsid", F.xxhash64("sid", "osid"))
        pairs = pair.select("nsid", "sid", "osid").dropDuplicates(["nsid"])
        dim = pairs.join(many.dim.withColumn("labels", labels), "sid").join(one.dim.select(F.col("sid").alias("osid"), F.col("labels").alias("olabels")), "osid")
        taken = F.map_filter("olabels", lambda k, x: k.isin(*matching.include) & (x != ""))
        dim = dim.select(F.col("nsid").alias("sid"), L.overlay(F.col("labels"), taken).alias("labels"), "okey")
        return Vector(pair.select("step_ts", F.col("nsid").alias("sid"), "t", value.alias("v"), *rest), dim)

    def _set(self, node: q.Binary, grid: Grid, ordered: bool) -> Vector:
        left, right = self.vector(node.left, grid, ordered), self.vector(node.right, grid, ordered)
        signature = self._signature(node.matching, keep_name=True)
        rows, others = left.rekeyed(signature, ordered)[0], right.rekeyed(signature, ordered)[0]
        columns = ["step_ts", "sid", "t", "v", *(["ord"] if ordered else [])]
        on = ["step_ts", "gid"]
        if node.op != "or":
            how = "left_semi" if node.op == "and" else "left_anti"
            return Vector(rows.join(others.select(*on), on, how).select(*columns), left.dim)
        # the sides' series can share ids under different labels
        def side(df: DataFrame, k: int) -> DataFrame:
            # all of the left side come before those of the right
            out = df.withColumn("sid", F.xxhash64(F.lit(k), "sid"))
            return out.withColumns({c: F.concat(F.lit(str(k)), c) for c in ("okey", "ord") if c in df.columns})

        fresh = others.join(rows.select(*on), on, "left_anti")
        dim = side(left.dim, 0).unionByName(side(right.dim, 1))
        return Vector(side(rows.select(*columns), 0).unionByName(side(fresh.select(*columns), 1)), dim)

    # ---- functions ----

    def call(self, node: q.Call, grid: Grid, ordered: bool) -> Scalar | Vector:
        name, args = node.name, node.args
        if name in _SIMPLE:
            return self.vector(args[0], grid, ordered).unnamed().valued(_SIMPLE[name](F.col("v")), now=True)
        if name in _DATE_PARTS:
            vector = self.vector(args[0], grid, ordered) if args else self.constant_vector(Scalar(_now()), grid)
            return vector.unnamed().valued(_date_part(name, F.col("v")), now=True)
        if name in ("absent", "absent_over_time"):
            return self._absent(node, grid)
        if name == "predict_linear":
            return self.over_time(name, args[0], grid, self.scalar(args[1], grid))
        if name == "quantile_over_time":
            return self.over_time(name, args[1], grid, self.scalar(args[0], grid))
        if q.SIGNATURES[name][0] == (q.MATRIX,):
            return self.over_time(name, args[0], grid)
        return getattr(self, f"_{name}")(node, grid, ordered)

    def _time(self, node: q.Call, grid: Grid, ordered: bool) -> Scalar:
        return Scalar(_now())

    def _vector(self, node: q.Call, grid: Grid, ordered: bool) -> Vector:
        return self.constant_vector(self.scalar(node.args[0], grid), grid)

    def _scalar(self, node: q.Call, grid: Grid, ordered: bool) -> Scalar:
        self.names += 1
        name = f"__s{self.names}"
        data = self.vector(node.args[0], grid).data.groupBy("step_ts").agg(F.count(F.lit(1)).alias("n"), F.first("v").alias("x"))
        only = F.when(F.col("n") == 1, F.col("x")).otherwise(ieee.number(ieee.NAN))
        return Scalar(F.col(name), [grid.frame(self.spark).join(data, "step_ts", "left").select("step_ts", only.alias(name))])

    def _timestamp(self, node: q.Call, grid: Grid, ordered: bool) -> Vector:
        return self.vector(node.args[0], grid, ordered).unnamed().valued(F.col("t") / F.lit(1000.0), now=True)

    def _sort(self, node: q.Call, grid: Grid, ordered: bool) -> Vector:
        return self.vector(node.args[0], grid, ordered)  # the order of a result is the engine's part

    _sort_desc = _sort

    def _round(self, node: q.Call, grid: Grid, ordered: bool) -> Vector:
        s = self.scalar(node.args[1], grid) if len(node.args) > 1 else Scalar(F.lit(1.0))
        return self.vector(node.args[0], grid, ordered).unnamed().valued(ieee.round_to(F.col("v"), s.column), (s,), now=True)

    def _clamp(self, node: q.Call, grid: Grid, ordered: bool) -> Vector:
        low, high = (self.scalar(a, grid) for a in node.args[1:3])
        v = ieee.maximum(low.column, ieee.minimum(high.column, F.col("v")))
        return self.vector(node.args[0], grid, ordered).unnamed().valued(v, (low, high), keep=~ieee.compare(">", low.column, high.column), now=True)

    def _clamp_min(self, node: q.Call, grid: Grid, ordered: bool) -> Vector:
        s = self.scalar(node.args[1], grid)
        limit = ieee.maximum if node.name == "clamp_min" else ieee.minimum
        return self.vector(node.args[0], grid, ordered).unnamed().valued(limit(F.col("v"), s.column), (s,), now=True)

    _clamp_max = _clamp_min

    def _absent(self, node: q.Call, grid: Grid) -> Vector:
        arg = node.args[0]
        if node.name == "absent":
            there = self.vector(arg, grid).data.select("step_ts")
        else:
            there = self.over_time("present_over_time", arg, grid).data.select("step_ts")
        selector = arg.selector if isinstance(arg, q.Window) else arg
        labels = {m.name: m.value for m in selector.matchers if m.op == "=" and m.name != q.NAME} if isinstance(selector, q.Selector) else {}
        gone = grid.frame(self.spark).join(there.distinct(), "step_ts", "left_anti")
        return self.single(gone.select("step_ts", F.lit(1.0).alias("v")), labels)

    def _label_replace(self, node: q.Call, grid: Grid, ordered: bool) -> Vector:
        target, template, source, pattern = (a.value for a in node.args[1:5])
        vector, value = self.vector(node.args[0], grid, ordered), L.get(F.col("labels"), source)
        whole = anchored(pattern)
        count, named = group_numbers(pattern)
        parts = []
        for kind, x in template_parts(template):
            number = int(x) if kind == "group" and x.isdigit() else named.get(x, count + 1)
            parts.append(F.lit(x) if kind == "text" else F.regexp_extract(value, whole, number) if number <= count else F.lit(""))
        new = F.concat(*parts) if parts else F.lit("")
        return vector.relabelled(F.when(value.rlike(whole), L.with_label(F.col("labels"), target, new)).otherwise(F.col("labels")))

    def _label_join(self, node: q.Call, grid: Grid, ordered: bool) -> Vector:
        target, separator, *sources = (a.value for a in node.args[1:])
        joined = F.concat_ws(separator, *[L.get(F.col("labels"), s) for s in sources]) if sources else F.lit("")
        return self.vector(node.args[0], grid, ordered).relabelled(L.with_label(F.col("labels"), target, joined))

    def _histogram_quantile(self, node: q.Call, grid: Grid, ordered: bool) -> Vector:
        """Buckets in order of their bounds: counts made monotone, then the one in which the rank falls."""
        s, vector = self.scalar(node.args[0], grid), self.vector(node.args[1], grid)
        le = L.get(F.col("labels"), "le")
        bound = F.when(le.rlike(r"^\+?[Ii]nf$"), ieee.number(ieee.INF)).when(le.rlike("^-[Ii]nf$"), ieee.number(-ieee.INF)).otherwise(le.try_cast("double"))
        vector = Vector(vector.data, vector.dim.withColumn("__le", bound).filter("__le is not null"))
        bounds = vector.dim.select("sid", "__le")
        data, dim = vector.rekeyed(L.drop(F.col("labels"), [q.NAME, "le"]), False)
        group = Window.partitionBy("step_ts", "gid")
        rising = group.orderBy("__le").rowsBetween(Window.unboundedPreceding, 0)
        rows = s.beside(data.join(bounds, "sid")).withColumn("c", F.max("v").over(rising))
        rows = rows.select(
            "step_ts", "gid", s.column.alias("q"), "__le", "c",
            F.row_number().over(group.orderBy("__le")).alias("i"),
            F.lag("__le").over(group.orderBy("__le")).alias("le0"), F.lag("c").over(group.orderBy("__le")).alias("c0"),
            F.count(F.lit(1)).over(group).alias("n"), F.max("__le").over(group).alias("top"), F.max("v").over(group).alias("total"),
        )
        rank = F.col("q") * F.col("total")
        found = rows.filter((F.col("i") == F.col("n")) | (F.col("c") >= rank)).groupBy("step_ts", "gid").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in ("step_ts", "gid")]), "i").alias("b")).select("step_ts", "gid", "b.*")
        start, below = F.coalesce("le0", F.lit(0.0)), F.coalesce("c0", F.lit(0.0))
        v = (
            F.when(F.isnan("q"), ieee.number(ieee.NAN))
            .when(F.col("q") < 0, ieee.number(-ieee.INF))
            .when(F.col("q") > 1, ieee.number(ieee.INF))
            .when((F.col("n") < 2) | (F.col("top") != ieee.number(ieee.INF)) | (F.col("total") == 0), ieee.number(ieee.NAN))
            .when(F.col("i") == F.col("n"), F.col("le0"))
            .when((F.col("i") == 1) & (F.col("__le") <= 0), F.col("__le"))
            .when(F.col("c") == below, start)
            .otherwise(start + (F.col("__le") - start) * ieee.divide(rank - below, F.col("c") - below))
        )
        return Vector(found.select("step_ts", F.col("gid").alias("sid"), F.col("step_ts").alias("t"), v.alias("v")), dim.withColumnRenamed("gid", "sid"))


_SIMPLE = {
    "abs": F.abs,
    "ceil": ieee.ceil,
    "floor": ieee.floor,
    "exp": F.exp,
    "ln": ieee.logarithm,
    "log2": lambda v: ieee.logarithm(v, 2),
    "log10": lambda v: ieee.logarithm(v, 10),
    "sqrt": F.sqrt,
    "sgn": F.signum,
}
_DATE_PARTS = {
    "minute": F.minute,
    "hour": F.hour,
    "day_of_week": lambda ts: F.dayofweek(ts) - 1,
    "day_of_month": F.dayofmonth,
    "day_of_year": F.dayofyear,
    "days_in_month": lambda ts: F.dayofmonth(F.last_day(ts)),
    "month": F.month,
    "year": F.year,
}


def _date_part(name: str, v: Column) -> Column:
    """A part of the UTC date of ``v`` seconds; NaN where there is none."""
    seconds = ieee.to_long(v)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / F.lit(86_400)).cast("int"))
    within = F.pmod(seconds, F.lit(86_400))
    clock = {"minute": F.floor(F.pmod(within, F.lit(3600)) / 60), "hour": F.floor(within / 3600)}
    part = clock[name] if name in clock else _DATE_PARTS[name](day)
    return F.coalesce(part.cast("double"), ieee.number(ieee.NAN))
