"""Exact n-gram Jaccard join by parity sketches.

A text's set holds the hashes of its distinct word shingles. A sketch deals the hashes into segments
by their high bits and XORs those of a segment together. Two texts differ in no more segments than
their sets' symmetric difference has members, which the similarity bounds by the sizes: texts of one
size band that link differ in at most ``D`` segments. With ``D + 1 + spare`` segments, some agree
(pigeonhole), so texts that share no (band, segment, XOR) key cannot link. A second sketch has one
parity bit per place: the Hamming distance of two such sketches never exceeds the difference of their
sets, so a distance beyond the bound rules a pair out before any text is read. The rest is verified on
whole sets.

What keeps the keys few and the join whole:

* Equal sets are one class first; a class is sketched once and needs no verification.
* Shingles that a bounded sample of texts shows to be very common are left out of the segments. That
  never loses a link (a difference of subsets is no larger). A text with more than ``spare`` empty
  segments left also sends a sketch of its whole set, and if that too has more, its empty segments.
  Two linked texts agree in at least ``spare + 1`` segments, so one of these kinds has a common key.
* Keys of a chunk of texts are combined before the shuffle: one member stands for the others.
* The members of a key are never paired out. Each is compared with one leader. Links are contracted to
  components, and a key whose members all are in one component is done. Members within the radius of
  the leader (``Radius``) are known from then on by their difference from it; those beyond it choose
  another leader, for ``ROUNDS`` rounds; what is left then has the empty set as its leader.
* Members of one leader: the difference of two sets is the difference of their differences from it, also once what most
  members have in theirs (where the leader stands alone) is turned round in all of them. Two
  whose differences are small link by the triangle inequality, which one member for each leader settles.
  Any other two that link share a part of their differences among the first few, in the order of how
  many members of the leader have a part (rarest first): a prefix join finds them, and the exact
  distance follows from the differences alone. Linked or not, no text is read twice for a leader.

The result does not depend on ``ROUNDS``, the radius or the sample: they shape candidates only. Every set
is known by a 64-bit hash of its members.

Edge cases: a null text or one without words has an empty set, is linked with nothing and is its own
component; a text with fewer words than a shingle is one shingle; equal texts link; rows with a
null doc_id take part (a component's id is its least non-null doc_id); an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .sampling import bounded_sample
from .scratch import Scratch, arrow_bytes
from .textkernel import CHUNK_BYTES, SPACE_WORDS, Words, chunks, mix64, shingle_sets

#: Texts sampled to find common shingles; from how many of them on one is common; at most so many (8 bytes each).
SAMPLE_DOCS, COMMON_FROM, MOST_COMMON = 10_000, 4, 200_000
#: Tables of up to so many rows of two numbers (16 MB) are sent to every executor.
BROADCAST_ROWS = 1_000_000
#: How often the members of a key that are beyond the radius of their leader choose another.
ROUNDS = 3
#: Classes that a task remembers to have sketched; beyond it, it begins anew and may sketch one again.
REMEMBERED = 100_000
_RATIO = 1.25
_U = np.uint64


class Bands:
    """Size bands for links of ``100 * common >= percent * union``."""

    def __init__(self, percent: int):
        self.percent = percent

    @cache  # noqa: B019
    def band(self, t: int) -> tuple[int, int, int, int, int]:
        """Of band ``t``: least size, first size beyond, largest size of a partner, segments, spare."""
        low = 1 if t == 0 else self.band(t - 1)[1]
        high = max(low + 1, math.ceil(low * _RATIO))
        most = (high - 1) * 100 // self.percent
        differ = (100 - self.percent) * (high - 1 + most) // (100 + self.percent)
        spare = math.ceil(1.5 * (differ + 1) * math.exp(-0.85 * low / (differ + 1))) + 1 if differ else 0
        return low, high, most, differ + 1 + spare, spare

    @cache  # noqa: B019
    def of(self, n: int) -> tuple[tuple[int, int, int], ...]:
        """Bands that a set of ``n`` shingles joins, as (band, segments, spare); none where only equal sets link."""
        out, t = [], 0
        while self.band(t)[0] <= n:
            low, high, most, segments, spare = self.band(t)
            if (low <= n < high or n <= most) and segments > 1:
                out.append((t, segments, spare))
            t += 1
        return tuple(out)


def _segments(members: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments that have members, and the XOR of their members; ``members`` are sorted."""
    if not len(members):
        return np.empty(0, np.int64), np.empty(0, _U)
    at = (((members >> _U(32)) * _U(count)) >> _U(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], np.bitwise_xor.reduceat(mix64(members), first)


def keys_of(members: np.ndarray, rare: np.ndarray, bands: Bands) -> np.ndarray:
    """The join keys of a set: all of its members, and those that are not common."""
    out = []
    for t, count, spare in bands.of(len(members)):
        for kind, part in enumerate((rare, members)):
            at, xor = _segments(part, count)
            out.append(mix64(xor ^ mix64(at.astype(_U) + _U((2 * t + kind) << 32))))
            if count - len(at) <= spare:
                break
        else:
            empty = np.setdiff1d(np.arange(count), at)
            out.append(mix64(empty.astype(_U) + _U((2 * t + 1) << 32 | 1 << 31)))
    return np.concatenate(out) if out else np.empty(0, _U)


def class_of(members: np.ndarray) -> int:
    """A set's 64-bit identity, from its members and their number."""
    return int(mix64(np.array([np.add.reduce(mix64(members ^ _U(0xA5A5A5A5A5A5A5A5))) + _U(len(members))], dtype=_U)).view(np.int64)[0])


class Common:
    """Shingles that stand in many texts of a bounded sample, and in how many."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]

    def of(self, members: np.ndarray) -> np.ndarray:
        """In how many texts of the sample each member stands; 0 if that is not known to be many."""
        if not len(self.hashes):
            return np.zeros(len(members), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, members), len(self.hashes) - 1)
        return np.where(self.hashes[at] == members, self.counts[at], 0)


def _common(docs: DataFrame, shingle: int) -> Common:

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                sets = shingle_sets(Words(part.column(0), SPACE_WORDS), shingle)
                h, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    sample = bounded_sample(docs.select("doc_id", "text"), "doc_id", SAMPLE_DOCS, 23).select("text")
    counted = sample.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON_FROM)
    rows = counted.orderBy(F.desc("n"), "h").limit(MOST_COMMON).collect()
    return Common(np.array([r[0] for r in rows], dtype=np.int64).view(_U), np.array([r[1] for r in rows], dtype=np.int64))


def parity_bits(members: np.ndarray) -> bytes:
    """One parity bit per place: 4 places or more a member, a power of two, so that halves fold onto each other."""
    places = max(64, 1 << (4 * len(members) - 1).bit_length())
    at = (mix64(members) & _U(places - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=places) & 1).astype(np.uint8), bitorder="little").tobytes()


def hamming(one: bytes, two: bytes) -> int:
    """Distance of two parity sketches, the longer folded to the shorter: at most the difference of their sets."""
    x, y = np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


class Radius:
    """How far a member may be from its leader, for links of ``100 * common >= percent * union``."""

    def __init__(self, percent: int):
        self.percent, self.lose, self.gain = percent, 100 - percent, 100 + percent

    def most(self, n: int) -> int:
        """By how many shingles a set of ``n`` and any that links with it differ at most."""
        return self.lose * (n + n * 100 // self.percent) // self.gain

    def inner(self, n: int) -> int:
        """A member no further than this needs no other leader."""
        return 3 * self.most(n)

    def outer(self, n: int) -> int:
        """Whatever links with a set that needs no other leader is no further from the leader than this."""
        return self.inner(n * 100 // self.percent) + self.most(n)

    def linked(self, total: int, d: int) -> bool:
        """Whether sets of ``total`` members together that differ in ``d`` link."""
        return self.gain * d <= self.lose * total


_SKETCHED = "h long, n long, class long, bits binary, sent array<long>, led array<long>, tied array<long>"


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """A list for each of ``n`` rows from values in order of their rows."""
    ends = np.cumsum(np.bincount(owner, minlength=n))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values, pa.int64()))


def _sketched(docs: DataFrame, shingle: int, bands: Bands, common: Broadcast) -> DataFrame:
    """Per row: doc_id, hash of the text, n, class, parity bits, and keys.

    Of the texts of a chunk with a key, one sends it (``led`` if there are others); the others only hold it (``tied``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, seen = common.value, set()
        for batch in batches:
            for part in chunks(batch):
                sizes, classes, bits, keys = [], [], [], []
                for members in shingle_sets(Words(part.column(2), SPACE_WORDS), shingle):
                    own = class_of(members) if len(members) else None
                    fresh = own is not None and own not in seen
                    sizes.append(len(members))
                    classes.append(own)
                    bits.append(parity_bits(members) if fresh else None)
                    keys.append(keys_of(members, members[frequent.of(members) == 0], bands).view(np.int64) if fresh else np.empty(0, np.int64))
                    if fresh:
                        seen.add(own)
                if len(seen) > REMEMBERED:
                    seen.clear()
                flat, owner = np.concatenate(keys), np.repeat(np.arange(len(keys)), [len(k) for k in keys])
                order = np.argsort(flat, kind="stable")
                first = np.ones(len(flat), bool)
                first[1:] = flat[order][1:] != flat[order][:-1]
                alone = first & np.append(first[1:], True)
                kind = np.empty(len(flat), np.int8)
                kind[order] = np.where(alone, 0, np.where(first, 1, 2))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(bits, pa.binary())]
                    + [_lists(flat[kind == k], owner[kind == k], len(keys)) for k in range(3)],
                    ["doc_id", "h", "n", "class", "bits", "sent", "led", "tied"],
                )

    rest = T.StructType.fromDDL(_SKETCHED)
    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], *rest.fields]))


def _held(sketched: DataFrame) -> DataFrame:
    """(key, a) of all keys that several rows share; a few of them are rows of one class."""
    lone = sketched.select(F.explode("sent").alias("key"), F.col("class").alias("a"), F.lit(False).alias("led"))
    led = sketched.filter("size(led) > 0").select(F.explode("led").alias("key"), F.col("class").alias("a"), F.lit(True).alias("led"))
    tied = sketched.filter("size(tied) > 0").select(F.explode("tied").alias("key"), F.col("class").alias("a"))
    by_key = Window.partitionBy("key").orderBy("a")
    sent = lone.unionByName(led).select("key", "a", "led", F.lag("a").over(by_key).alias("before"), F.lead("a").over(by_key).alias("after"))
    sent = sent.filter("(led or before is not null or after is not null) and not a <=> before")
    return sent.select("key", "a").unionByName(tied)


def _side(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if its rows (of two numbers) are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _texts(docs: DataFrame, members: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """(class, n, bits, text) of the wanted classes (column a)."""
    # a class is addressed by id and text of one of its rows, with a null id only if it has no other
    rows_of = members.join(_side(wanted.withColumnRenamed("a", "class")), "class", "left_semi")
    address = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    chosen = rows_of.groupBy("class").agg(F.min(address).alias("c"), F.max("n").alias("n"), F.first("bits", ignorenulls=True).alias("bits"))
    chosen = scratch.write(chosen.select("class", "n", "bits", F.col("c.doc_id").alias("__id"), F.col("c.h").alias("__h")), "chosen")
    where = _side(chosen.select("class", "__id", "__h"))
    texts = docs.select("doc_id", "text").join(where, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__h"))).select("class", "text")
    texts = scratch.write(texts, "held_texts")
    repeated = texts.groupBy("class").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("class")
    if repeated.limit(1).count():
        side = F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated
        once = texts.join(side, "class", "left_semi").dropDuplicates(["class"])
        texts = texts.join(side, "class", "left_anti").unionByName(once)
    return scratch.write(texts.join(chosen.select("class", "n", "bits"), "class"), "texts")


def _beside(pairs: DataFrame, texts: DataFrame, column: str) -> DataFrame:
    """(a, b, ``column`` of a, ``column`` of b, size of a)."""
    one, two = texts.select(F.col("class").alias("a"), F.col(column).alias("one"), "n"), texts.select(F.col("class").alias("b"), F.col(column).alias("two"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two", "n")


def _pair_chunks(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[int], dict[int, int], pa.Array]]:
    """Parts of a batch (a, b, text of a, text of b) with about ``CHUNK_BYTES`` of text: a, b, where a class stands, its text."""
    length = np.add(*[pc.binary_length(batch.column(k)).to_numpy(zero_copy_only=False) for k in (2, 3)])
    end, at = np.cumsum(length), 0
    while at < len(end):
        to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + CHUNK_BYTES, side="right")))
        part = batch.slice(at, to - at)
        classes, place = np.unique(np.concatenate([part.column(k).to_numpy() for k in (0, 1)]), return_index=True)
        yield part.column(0).to_pylist(), part.column(1).to_pylist(), {c: i for i, c in enumerate(classes.tolist())}, pa.concat_arrays([part.column(2), part.column(3)]).take(pa.array(place))
        at = to


def _measured(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """Pairs (a, b) within the outer radius: a, b, n (size of a), d, linked, inside (the inner radius), parts (the difference)."""
    radius = Radius(percent)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [hamming(x, y) <= radius.outer(n) for x, y, n in zip(*[batch.column(k).to_pylist() for k in (2, 3, 4)], strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, place, column in _pair_chunks(batch):
                sets = shingle_sets(Words(column, SPACE_WORDS), shingle)
                rows, parts = [], []
                for one, two in zip(a, b, strict=True):
                    x, y = sets[place[one]], sets[place[two]]
                    if class_of(x) != one or class_of(y) != two:
                        continue  # a row whose hash meets that of another text
                    differ = np.setxor1d(x, y, assume_unique=True)
                    n, d = len(x), len(differ)
                    if d <= radius.outer(n):
                        rows.append((one, two, n, d, radius.linked(n + len(y), d), d <= radius.inner(n)))
                        parts.append(differ.view(np.int64))
                if rows:
                    types = (pa.int64(),) * 4 + (pa.bool_(),) * 2
                    lists = _lists(np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts]), len(parts))
                    yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], lists], ["a", "b", "n", "d", "linked", "inside", "parts"])

    near = scratch.write(_beside(pairs, texts, "bits").mapInArrow(close, "a long, b long"), f"close{name}")
    beside = _beside(near, texts, "text").mapInArrow(measure, "a long, b long, n long, d long, linked boolean, inside boolean, parts array<long>")
    return scratch.write(beside, f"measured{name}")


def _rooted(df: DataFrame, roots: DataFrame, node: str, out: str) -> DataFrame:
    """``df`` with the root of the component of ``node``."""
    return df.join(roots.select(F.col("node").alias(node), F.col("root").alias(out)), node, "left").withColumn(out, F.coalesce(out, node))


def _within(known: DataFrame, roots: DataFrame, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """Links (a, b) between different components among the members of each leader, from (a, lead, n, d, parts).

    Every pair of members of a leader that links is found, or both are linked with one third member.
    """
    lose, gain = 100 - percent, 100 + percent
    members = _rooted(known, roots, "a", "root")
    open_leads = members.groupBy("lead").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("lead")
    members = scratch.write(members.join(open_leads, "lead", "left_semi"), f"open{name}")
    if not members.limit(1).count():
        return members.select("a", F.col("a").alias("b"))
    # What more than half of a leader's members have in their differences is the leader's own: seen from the leader without
    # it, differences are smaller, those of a member from another the same, and copies of one text share none of theirs.
    sizes = members.groupBy("lead").agg(F.count(F.lit(1)).alias("m"))
    shared = members.select("lead", F.explode("parts").alias("part")).groupBy("lead", "part").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    usual = shared.join(sizes, "lead").filter("2 * c > m").groupBy("lead").agg(F.collect_list("part").alias("usual"))  # no longer than two differences
    seen = F.when(F.col("usual").isNull(), F.col("parts")).otherwise(F.concat(F.array_except("parts", "usual"), F.array_except("usual", "parts")))
    members = members.join(usual, "lead", "left").withColumn("parts", seen).withColumn("d", F.size("parts").cast("long")).drop("usual")
    members = scratch.write(members, f"seen{name}")
    # Differences of d and e shingles are at most d + e apart. If that is enough for any partner, it is for the member of the
    # leader with the most room, so all such pairs hang together through that one.
    room = F.lit(lose) * F.col("n") - F.lit(gain) * F.col("d")
    roomy = members.groupBy("lead").agg(F.max_by(F.struct(F.col("a").alias("b"), room.alias("room")), F.struct(room, "a")).alias("m"))
    near = members.select("lead", "a", room.alias("room")).join(roomy, "lead").filter((F.col("room") + F.col("m.room") >= 0) & (F.col("a") != F.col("m.b"))).select("a", F.col("m.b").alias("b"))
    # Others share (d + e - most) / 2 of their parts at least: some are among the first (most + d - e) / 2 + 1 of d.
    most = F.floor(F.lit(lose) * (F.col("n") + F.floor(F.col("n") * 100 / percent)) / gain)
    each = members.select("lead", "a", "n", "d", "root", F.explode("parts").alias("part"))
    counts = each.groupBy("lead", "part").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    placed = each.join(counts, ["lead", "part"], "left").select("lead", "a", "n", "d", "root", "part", F.coalesce("c", F.lit(1)).alias("c"))
    place = F.row_number().over(Window.partitionBy("lead", "a").orderBy("c", "part")) - 1
    first = scratch.write(placed.withColumn("place", place).filter((F.col("place") <= most) & (F.col("c") > 1)).select("lead", "part", "a", "n", "d", "root", "place"), f"first{name}")
    one, two = (first.select("lead", "part", *[F.col(c).alias(f"{c}{k}") for c in ("a", "n", "d", "root", "place")]) for k in (1, 2))
    bound = F.floor(F.lit(lose) * (F.col("n1") + F.col("n2")) / gain)
    beyond = F.col("d1") - F.col("d2")
    met = one.join(two, ["lead", "part"]).filter(
        ((beyond > 0) | (beyond == 0) & (F.col("a1") > F.col("a2")))
        & (F.col("root1") != F.col("root2"))
        & (beyond <= bound)
        & (F.col("d1") + F.col("d2") > bound)
        & (2 * F.col("place1") <= bound + beyond)
        & (2 * F.col("place2") <= bound - beyond)
        & (100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2"))
    )
    met = scratch.write(met.select("lead", F.col("a1").alias("a"), F.col("a2").alias("b")).distinct(), f"met{name}")
    parts = members.select("lead", "a", "n", "d", "parts")
    both = met.join(parts, ["lead", "a"]).join(parts.select("lead", *[F.col(c).alias(k) for c, k in (("a", "b"), ("n", "n2"), ("d", "d2"), ("parts", "parts2"))]), ["lead", "b"])
    apart = F.col("d") + F.col("d2") - 2 * F.size(F.array_intersect("parts", "parts2"))
    found = both.filter(gain * apart <= lose * (F.col("n") + F.col("n2"))).select("a", "b")
    return scratch.write(near.unionByName(found).distinct(), f"found{name}")


def _whole_sets(texts: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(a, n, parts) of the wanted classes (column a): whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                sets = [s.view(np.int64) for s in shingle_sets(Words(part.column(1), SPACE_WORDS), shingle)]
                lists = _lists(np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]), len(sets))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), lists], ["a", "n", "parts"])

    rows = texts.select(F.col("class").alias("a"), "text").join(wanted, "a", "left_semi")
    return rows.mapInArrow(run, "a long, n long, parts array<long>")


def _roots(docs: DataFrame, members: DataFrame, held: DataFrame, shingle: int, percent: int, scratch: Scratch) -> DataFrame:
    """(node, root) of the classes that link with another."""
    several = held.groupBy("key").agg(F.min("a").alias("lead"), F.max("a").alias("last")).filter("lead <> last").select("key", "lead")
    held = scratch.write(held.join(several, "key"), "held")
    scratch.drop("held0")
    if not held.limit(1).count():
        return docs.sparkSession.createDataFrame([], "node long, root long")
    texts = _texts(docs, members, scratch.write(held.select("a").distinct(), "wanted"), scratch)
    # at first each class meets the leader (the least class of a key) with which it shares most keys
    shared = held.filter("a <> lead").groupBy("a", "lead").agg(F.count(F.lit(1)).alias("c"))
    tried = scratch.write(shared.groupBy("a").agg(F.max_by("lead", F.struct("c", "lead")).alias("b")), "pairs0")
    known = _measured(tried, texts, shingle, percent, scratch, "0")
    roots = scratch.write(components(known.filter("linked").select("a", "b"), scratch, "c0_"), "roots0")
    held = held.select("key", "a")
    for k in range(1, ROUNDS + 1):
        # a key asks for the least home of its members, where each is at home with the least leader within its radius
        homes = known.filter("inside").groupBy("a").agg(F.min("b").alias("home"))
        state = _rooted(held, roots, "a", "root").join(homes, "a", "left").withColumn("home", F.coalesce("home", "a"))
        leads = state.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min("home").alias("lead")).filter("x <> y").select("key", "lead")
        asked = scratch.write(held.join(leads, "key"), f"asked{k}").filter("a <> lead")
        if not asked.limit(1).count():
            return _finished(known, roots, percent, scratch, None)
        pairs = asked.select("a", F.col("lead").alias("b")).distinct()
        pairs = scratch.write(pairs.join(tried, ["a", "b"], "left_anti"), f"pairs{k}")
        if pairs.limit(1).count():
            fresh = _measured(pairs, texts, shingle, percent, scratch, str(k))
            known, tried = known.unionByName(fresh), tried.unionByName(pairs)
            if fresh.filter("linked").limit(1).count():
                roots = scratch.write(components(known.filter("linked").select("a", "b"), scratch, f"c{k}_"), f"roots{k}")
        settled = known.filter("inside").select("a", F.col("b").alias("lead"))
        held = scratch.write(asked.join(settled, ["a", "lead"], "left_anti").select("key", "a"), f"held{k}")
    left = _rooted(held, roots, "a", "root")
    open_keys = left.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("key")
    lone = scratch.write(held.join(open_keys, "key", "left_semi").select("a").distinct(), "lone")
    return _finished(known, roots, percent, scratch, _whole_sets(texts, lone, shingle) if lone.limit(1).count() else None)


def _finished(known: DataFrame, roots: DataFrame, percent: int, scratch: Scratch, lone: DataFrame | None) -> DataFrame:
    """Components with the links among members of one leader, and among classes that have none."""
    links = known.filter("linked").select("a", "b")
    near = known.select("a", F.col("b").alias("lead"), "n", "d", "parts")
    more = [_within(near, roots, percent, scratch, "led")]
    if lone is not None:
        # the empty set leads them: a set is its own difference from it
        more.append(_within(lone.select("a", F.lit(0).cast("long").alias("lead"), "n", F.col("n").alias("d"), "parts"), roots, percent, scratch, "lone"))
    fresh = more[0] if len(more) == 1 else more[0].unionByName(more[1])
    if not fresh.limit(1).count():
        return roots
    return scratch.write(components(links.unionByName(fresh), scratch, "c_"), "roots")


def _members(docs: DataFrame, shingle: int, percent: int, scratch: Scratch) -> DataFrame:
    """Per row of ``docs``: doc_id, hash of the text (h), n, and the root of its class (null for an empty set)."""
    spark = docs.sparkSession
    common = spark.sparkContext.broadcast(_common(docs, shingle))  # at most MOST_COMMON pairs of numbers
    with arrow_bytes(spark):
        sketched = scratch.write(_sketched(docs, shingle, Bands(percent), common), "sketched")
        held = scratch.write(_held(sketched), "held0")
        members = scratch.write(sketched.select("doc_id", "h", "n", "class", "bits"), "members")
        scratch.keep("held0", "members")  # the keys are as large as the texts
        roots = _roots(docs, members, held, shingle, percent, scratch)
    # few classes link with another, so the rows need not be dealt by class
    linked = _side(roots.select(F.col("node").alias("class"), "root"))
    some = members.select("doc_id", "h", "n", "class").join(linked, "class", "left")
    rows = scratch.write(some.select("doc_id", "h", "n", F.coalesce("root", "class").alias("root")), "rows")
    scratch.keep("rows")
    return rows


def join(docs: DataFrame, shingle: int = 3, percent: int = 90) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id."""
    scratch = Scratch(docs.sparkSession, "simjoin")
    rows = _members(docs, shingle, percent, scratch)
    least = rows.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    # a component of one row needs no partner: only the roots of several rows are joined back
    several = scratch.write(least.filter("rows > 1").select("root", "component_id"), "several")
    found = rows.join(_side(several), "root", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates_removed(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id (null last).

    Rows without words all stay. What stays is settled by component and row, so rows that repeat an id with
    another text are rows of their own; of rows with equal id and text in a component one stays.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    rows = _members(docs, shingle, percent, scratch).filter("root is not null")
    address = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    kept = rows.groupBy("root").agg(F.min(address).alias("c"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    told = rows.join(kept.select("root", "c"), "root").select("doc_id", "h", (address == F.col("c")).alias("stays"))
    # a text has one component, so all rows of one id and text stay or go together
    told = scratch.write(told.groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).agg(F.max("stays").alias("__stays"), F.count(F.lit(1)).alias("__rows")), "told")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__h"))
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    gone, several = told.filter("not __stays or __rows > 1").select("__id", "__h"), told.filter("__stays and __rows > 1").select("__id", "__h")
    rest = docs.join(_side(gone), same & words, "left_anti")
    nth = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(1)))
    first = docs.filter(words).join(_side(several), same, "left_semi").withColumn("__nth", nth).filter("__nth = 1").drop("__nth")
    return rest.unionByName(first)
