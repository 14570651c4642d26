import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tidemark.llm import langid, queries, simjoin


def test_stages_keep_the_columns(spark, tmp_path):
    rows = [(i, f"the and that text number {i} " * 8, "en" if i % 2 else "fr", f"s{i % 3}", 9) for i in range(40)]
    rows += [(100, rows[3][1], "en", "s0", 9), (101, "123 456", None, "s1", 7), (102, None, "en", "s1", 0), (103, "lead in " + "one two three four five six seven eight nine ten" + " and out", "en", None, 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "One two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns, name
    ids = {r.doc_id for r in left.collect()}
    assert not ids & {100, 101, 102, 103} and 3 in ids
    last = corpus_pipeline.run(spark, str(tmp_path))
    assert set(last.columns) >= {"doc_id", "text", "shard", "slot"} and {r.doc_id for r in last.collect()} == ids


def test_the_language_model_of_the_pipeline_is_trained_on_all_rows(spark, monkeypatch, tmp_path):
    # neither the number nor the bytes of labelled rows bound it: a sample of rows without an id takes all or none of them
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 0)
    rows = [(None, f"the and that text number {i}", "en", "s", 9) for i in range(30)] + [(None, "12 34", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.identify_languages(spark, docs, str(tmp_path)).count() == 30


def test_training_on_whole_tables(spark, monkeypatch):
    monkeypatch.setattr(langid, "PART_BYTES", 100_000)  # four parts of three batches
    monkeypatch.setattr(langid, "PASSES", 15)
    rnd = random.Random(9)
    said = {"xx": "the and that with this", "yy": "und der nicht auch sie", "zz": "el que los para por"}
    rows = [(" ".join(rnd.choice(words.split()) for _ in range(rnd.randrange(30, 200))), lang) for lang, words in said.items() for _ in range(200)]  # in order of their languages
    shape = "text string, lang string"
    net = langid.fit_whole(spark.createDataFrame(rows + [(None, "xx"), ("!!", "yy"), ("no label", None), ("lone", "rare")], shape).coalesce(2))
    assert net.labels == ["rare", "xx", "yy", "zz"]
    got = langid.predict_batch(net, [" ".join(rnd.choice(words.split()) for _ in range(40)) for words in said.values() for _ in range(50)])[0]
    assert np.mean([a == b for a, b in zip(got, [lang for lang in said for _ in range(50)], strict=True)]) > 0.95
    again = langid.fit_whole(spark.createDataFrame(rows[:9], shape).coalesce(1))
    assert all(np.array_equal(a, b) for a, b in zip(again.params(), langid.fit_whole(spark.createDataFrame(rows[:9], shape).coalesce(1)).params(), strict=True))
    assert langid.fit_whole(spark.createDataFrame([("text", None), ("1", "en")], shape)) is None


def test_near_duplicates_do_not_depend_on_the_sample(spark, monkeypatch):
    rnd = random.Random(4)
    base = [[rnd.choice("abcdefgh") * rnd.randrange(1, 5) for _ in range(120)] for _ in range(12)]
    rows = [(i * 10 + j, " ".join(w if rnd.random() > 0.008 * j else "x" for w in words)) for i, words in enumerate(base) for j in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [sorted(r.doc_id for r in simjoin.near_duplicates_removed(docs).collect())]
    hashes = np.unique(np.concatenate(simjoin.shingle_sets(simjoin.Words(pa.array([t for _, t in rows]), simjoin.SPACE_WORDS), 5)))[::2]
    monkeypatch.setattr(simjoin, "_common", lambda *_: simjoin.Common(hashes, np.full(len(hashes), 9)))  # every second shingle is called common
    found.append(sorted(r.doc_id for r in simjoin.near_duplicates_removed(docs).collect()))
    assert found[0] == found[1] and 12 <= len(found[0]) < 72


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
