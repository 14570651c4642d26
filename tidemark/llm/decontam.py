"""Benchmark decontamination: a prefix-filtered join of benchmark windows with documents.

A window is ``WINDOW`` consecutive words of an item (a shorter item is one window). A document holds
a window only if it holds all its words, so for full containment one word is a sufficient prefix:
the rarest by corpus count. Every document word that is some window's rarest word is a candidate;
its place fixes where the window would start (positional bound) and end (length bound), and the word
beside it must be the window's too. What is left is compared word by word in the texts themselves.

All of it is DataFrame functions. Texts are split once, into a written table of word hashes; counts and
candidates read that table, and only texts with a candidate are split again for the comparison. Windows
are sent to every executor in blocks of at most ``BLOCK_WINDOWS``; more windows take more passes over
the table of hashes, never a larger broadcast.

Edge cases: a null text has no words; a null item_id marks words but counts as no item; rows of one
item_id are one item; repeated documents get equal results; ties in rarity go to the lesser word
and the first place; empty tables give empty results (an empty benchmark hits nothing); other
columns are carried only on request.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

WINDOW = 10
#: About 300 bytes each.
BLOCK_WINDOWS = 100_000
#: Up to so many rows of three numbers (24 MB) are sent to every executor.
BROADCAST_ROWS = 500_000
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text with A-Z in lower case; a null text has none."""
    # lower() is the faster way, and for ASCII the same; separators at either end leave an empty word
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.coalesce(F.array_remove(F.split(lowered, _BETWEEN), ""), F.array().cast("array<string>"))


def _windows(benchmark: DataFrame) -> DataFrame:
    """Distinct windows (words) with the items they come from."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - WINDOW + 1))
    each = items.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s, F.lit(WINDOW)))).alias("window"))
    return each.groupBy("window").agg(F.collect_set("item").alias("items"))


def _hashed(docs: DataFrame) -> DataFrame:
    """Row key, n_words, and the hashes of the words in order."""
    split = docs.select(*row_key(), words_of(F.col("text")).alias("w"))
    return split.select("__id", "__h", "__c", F.size("w").cast("long").alias("n_words"), F.transform("w", lambda x: F.xxhash64(x)).alias("hashes"))


def _anchored(hashed: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows with their rarest word by its count in the documents: id, length, place from 0, hashes of it and of the word beside."""
    placed = windows.select("id", F.size("window").alias("length"), "window", F.posexplode("window").alias("place", "word")).withColumn("hash", F.xxhash64("word"))
    vocabulary = placed.select("hash").distinct()
    corpus = hashed.select(F.explode("hashes").alias("hash"))
    counts = corpus.join(F.broadcast(vocabulary), "hash").groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    counted = placed.join(counts, "hash", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # the next word, for the last word the one before; a window of one word has none
    beside = F.when(F.col("place") + 1 < F.col("length"), F.get("window", F.col("place") + 1)).otherwise(F.get("window", F.col("place") - 1))
    rarest = counted.groupBy("id").agg(F.min(F.struct("n", "word", "place", "length", "hash", F.xxhash64(beside).alias("beside"))).alias("r"))
    return rarest.select("id", "r.length", "r.place", "r.hash", "r.beside")


def _blocks(windows: DataFrame, scratch: Scratch) -> Iterator[DataFrame]:
    """The windows in parts of about ``BLOCK_WINDOWS``."""
    parts = -(-windows.count() // BLOCK_WINDOWS)
    for k in range(parts):
        yield windows if parts == 1 else windows.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == k)


def row_key() -> list[Column]:
    """Rows of one id and text are told from all others by these; they get equal results."""
    return [F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__h"), F.crc32("text").alias("__c")]


def _places(hashed: DataFrame, anchored: DataFrame) -> DataFrame:
    """Where windows can stand: row key, start (from 0), length, window id."""
    h, n = F.col("hashes"), F.col("n_words").cast("int")
    after, before = F.slice(h, F.lit(2), n), F.concat(F.array(F.lit(0).cast("long")), F.slice(h, F.lit(1), F.greatest(n - 1, F.lit(0))))
    each = hashed.filter(n > 0).select("__id", "__h", "__c", n.alias("n"), F.posexplode(F.arrays_zip(h.alias("word"), after.alias("after"), before.alias("before"))).alias("pos", "at"))
    each = each.select("__id", "__h", "__c", "n", "pos", F.col("at.word").alias("hash"), F.col("at.after").alias("after"), F.col("at.before").alias("before"))
    start = F.col("pos") - F.col("place")
    inside = (start >= 0) & (start + F.col("length") <= F.col("n"))
    beside = (F.col("length") == 1) | (F.col("beside") == F.when(F.col("place") + 1 < F.col("length"), F.col("after")).otherwise(F.col("before")))
    return each.join(F.broadcast(anchored), "hash").filter(inside & beside).select("__id", "__h", "__c", start.alias("start"), "length", "id")


def _same_row(left: tuple[str, str, str] = ("__id", "__h", "__c"), right: tuple[str, str, str] = ("__id2", "__h2", "__c2")) -> Column:
    one, two, three = (F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True))
    return one & two & three


def _found(docs: DataFrame, hashed: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """Windows found in documents: row key, start (from 0), length, and the windows' items."""
    windows = scratch.write(_windows(benchmark).withColumn("id", F.xxhash64("window")), "windows")
    empty = hashed.select("__id", "__h", "__c", F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit(0).cast("long").alias("id")).limit(0)
    places = empty
    for k, block in enumerate(_blocks(windows, scratch)):
        anchored = scratch.write(_anchored(hashed, block), f"anchored{k}")
        places = places.unionByName(scratch.write(_places(hashed, anchored), f"places{k}"))
    # the texts themselves settle it: a text's places are few, and its words are joined to all of them at once
    by_row = places.groupBy("__id", "__h", "__c").agg(F.collect_set(F.struct("start", "length", "id")).alias("at"))
    by_row = scratch.write(by_row, "rows")
    side = F.broadcast(by_row.select("__id", "__h", "__c")) if by_row.count() <= BROADCAST_ROWS else by_row.select("__id", "__h", "__c")
    texts = docs.select(F.col("text"), *[c.alias(f"{n}2") for c, n in zip(row_key(), ("__id", "__h", "__c"), strict=True)])
    texts = texts.join(side, _same_row(), "left_semi").dropDuplicates(["__id2", "__h2", "__c2"])
    both = texts.join(by_row, _same_row()).select("__id", "__h", "__c", "at", words_of(F.col("text")).alias("w"))
    cut = F.transform("at", lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"), x["id"].alias("id"), F.slice("w", x["start"] + 1, x["length"]).alias("cut")))
    each = both.select("__id", "__h", "__c", F.explode(F.filter(cut, lambda x: F.xxhash64(x["cut"]) == x["id"])).alias("x")).select("__id", "__h", "__c", "x.*")
    exact = each.join(windows, "id").filter(F.col("cut") == F.col("window"))
    return scratch.write(exact.select("__id", "__h", "__c", "start", "length", "items"), "found")


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Windows found in documents: row key, start (from 0), length, and the windows' items."""
    scratch = Scratch(docs.sparkSession, "decontam")
    return _found(docs, scratch.write(_hashed(docs), "hashed"), benchmark, scratch)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    scratch, key = Scratch(docs.sparkSession, "decontam"), ["__id", "__h", "__c"]
    hashed = scratch.write(_hashed(docs), "hashed")
    found = _found(docs, hashed, benchmark, scratch)
    marked = found.select(*key, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("p")).distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n_hit"))
    items = found.select(*key, F.explode("items").alias("item")).distinct().groupBy(*key).agg(F.sort_array(F.collect_list("item")).alias("items"))
    # every item of a hit may be null, so items can lack rows that marked has
    each = marked.alias("m").join(items.alias("i"), [F.col(f"m.{c}").eqNullSafe(F.col(f"i.{c}")) for c in key], "left").select(*[F.col(f"m.{c}").alias(f"{c}2") for c in key], "n_hit", "items")
    each = scratch.write(each, "each")
    side = F.broadcast(each) if each.count() <= BROADCAST_ROWS // 10 else each  # a few hundred bytes each
    joined = hashed.select(F.col("__id").alias("doc_id"), *key, "n_words").join(side, _same_row(), "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a window."""
    scratch = Scratch(docs.sparkSession, "decontam")
    found = _found(docs, scratch.write(_hashed(docs), "hashed"), benchmark, scratch)
    gone = scratch.write(found.select(*[F.col(c).alias(f"{c}2") for c in ("__id", "__h", "__c")]).distinct(), "gone")
    scratch.keep("gone")
    here = docs.select("*", *row_key())
    return here.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, _same_row(), "left_anti").select(*docs.columns)
