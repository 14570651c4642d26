"""Five stages that turn raw documents into sharded training data.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet and
hands it, reread, to the next. All but the last return the columns of ``docs``.

What becomes of odd rows: a null text and one without a letter have no language and go in the first stage, so an empty
text never gets further. A null doc_id is an id like any other, but of a group of near duplicates a row with an id stays
before one without; rows that repeat an id are rows of their own if their texts differ, and near duplicates if they do
not. Equal texts are near duplicates, so one row of each stays; mixing may repeat it. Very long texts are read whole in
every stage. A null source is a source of its own. Columns beyond those that a stage reads are carried along, whatever
their names; the last stage replaces columns that have the names of its own. A table without rows gives one without rows,
with the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontam, langid, mixing, sharding, simjoin
from tidemark.llm.scratch import Scratch

#: Language ID rejects a text without a language (null, or without a letter); all others stay.
REJECTED_LANGUAGE = "und"


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts in which the byte network, trained on every labelled row, finds a language."""
    found = langid.identify(docs, langid.fit_whole(docs), carry=docs.columns, names=("__lang", "__score"))
    return found.filter(found["__lang"] != REJECTED_LANGUAGE).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8 or more."""
    return simjoin.near_duplicates_removed(docs, shingle=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that each source comes near its target."""
    return mixing.mixed_documents(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard, slot and the shard with one more shard to every document."""
    return sharding.shard(docs, carry=docs.columns)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("identify_languages", identify_languages),
    ("drop_near_duplicates", drop_near_duplicates),
    ("drop_contaminated", drop_contaminated),
    ("mix_sources", mix_sources),
    ("assign_shards", assign_shards),
]

#: The first stage rests on a trained network, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = name
    return docs
