"""Every operator and stage on one table of edge cases, and on it without rows."""

import json

import pytest

import corpus_pipeline
from tidemark.llm import chat, decontam, langid, licences, media, mixing, pii, quality, sharding, simjoin

LONG = "word and other " * 20_000
#: Null and repeated ids, equal rows, null, empty and very long texts, texts without words, equal texts under several ids.
ROWS = [
    (1, None, None, None), (1, None, None, None), (2, "", "a", "en"), (3, "one", "b", "en"), (3, "one", "b", "en"), (3, "two words", "a", None), (4, LONG, "b", "en"), (5, LONG, None, "en"), (6, " \t\n", "a", "en"),
    (7, "é ü ñ", "é", "fr"), (8, "one", "a", "en"), (None, "lone words", None, "en"), (None, None, None, None), (None, "lone words", None, "en"), (9, "12 34 !!", "a", None), (10, "a@b.org and token = \"abc\" under the MIT License", "a", "en"),
]
#: A column for every name that an operator makes.
CLASHING = (
    "size source_size target taken copies score predicted held_out n_bytes media payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature payload height width rgb text_crc32 law region rack shard slot grown_shard "
    "n_shingles component_id class root key n_words n_base first_word last_word base_labels labels label template_words start_word end_word coverage lang_pred n_hit n_items items_sha256 contaminated "
    "n_email n_ip n_card n_phone base_sha256 spans h n a b"
).split()
SHAPE = "doc_id long, text string, source string, lang string, " + ", ".join(f"`{c}` string" for c in CLASHING)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edges"))
    docs = spark.createDataFrame([(*r, *["kept"] * len(CLASHING)) for r in ROWS], SHAPE)
    docs.repartition(2).write.parquet(f"{path}/documents.parquet")
    docs.limit(0).write.parquet(f"{path}/empty.parquet")
    spark.createDataFrame([(1, "under the mit license"), (None, "lone"), (3, None), (4, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def _labelled(docs):
    return docs.selectExpr("doc_id", "text", "CAST(doc_id % 2 AS INT) AS label")


OPERATORS = {
    "mix": (mixing.mix, None),
    "mixed_documents": (lambda d: mixing.mixed_documents(d), "more"),
    "quality": (lambda d: quality.score(d, quality.fit(_labelled(d)), carry=d.columns), None),
    "media": (lambda d: media.read(media.store(d, carry=d.columns)), None),
    "tensors": (lambda d: media.read(media.store(d.filter("text is null or length(text) < 1000"), carry=d.columns), tensors=True), "fewer"),
    "shard": (lambda d: sharding.shard(d, carry=d.columns), None),
    "join": (simjoin.join, None),
    "near_duplicates_removed": (simjoin.near_duplicates_removed, "fewer"),
    "licences": (lambda d: licences.scan(d, carry=d.columns), None),
    "spans": (lambda d: licences.spans(d, carry=d.columns), "fewer"),
    "language": (lambda d: langid.identify(d, langid.fit(d), carry=d.columns), None),
    "report": (lambda d: decontam.report(d, d.sparkSession.createDataFrame([(1, "under the mit license"), (None, "lone")], "item_id long, text string")), None),
    "clean_documents": (lambda d: decontam.clean_documents(d, d.sparkSession.createDataFrame([(1, "under the mit license")], "item_id long, text string")), "fewer"),
    "personal_data": (pii.find, None),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operators(spark, table, name):
    run, rows = OPERATORS[name]
    docs = spark.read.parquet(f"{table}/documents.parquet")
    got = run(docs)
    found = got.collect()
    assert len(set(got.columns)) == len(got.columns)
    assert len(found) == len(ROWS) if rows is None else len(found) >= len(ROWS) if rows == "more" else 0 < len(found) < len(ROWS)
    none = run(spark.read.parquet(f"{table}/empty.parquet"))
    assert none.columns == got.columns and none.count() == 0


def test_results_on_the_table(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    rows = simjoin.join(docs).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows if r.n_shingles and r.doc_id is not None) == [(3, 3), (3, 3), (3, 3), (4, 4), (5, 4), (7, 7), (8, 3), (9, 9), (10, 10)]
    assert [r.component_id for r in rows if r.doc_id is None] == [None] * 3 and all(r.component_id == r.doc_id for r in rows if not r.n_shingles)
    kept = [(r.doc_id, r.text) for r in simjoin.near_duplicates_removed(docs).collect()]
    assert sorted((i or 0, (t or "")[:9]) for i, t in kept) == sorted([(1, ""), (1, ""), (2, ""), (3, "one"), (3, "two words"), (4, LONG[:9]), (6, " \t\n"), (7, "é ü ñ"), (0, "lone word"), (0, ""), (9, "12 34 !!"), (10, "a@b.org a")])
    hits = {r.doc_id: r for r in decontam.report(docs, spark.read.parquet(f"{table}/benchmark.parquet")).collect()}
    assert hits[10].n_hit == 4 and hits[10].n_items == 1 and hits[None].contaminated in (True, False) and not hits[4].contaminated
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    assert found[10].n_email == 1 and found[4].spans == ""


def test_conversations(spark):
    said = "</s>[INST] " * 3000
    rows = [(1, 0, "user", said, "x"), (1, 1, "assistant", None, "x"), (1, 1, "assistant", None, "x"), (2, 0, None, "", "x"), (None, 0, "user", "a", "x"), (3, 5, "assistant", "b", "x"), (3, 2, "user", "<|im_end|>", "x")]
    shape = "conv_id long, turn long, role string, text string, n_turns string"
    got = {r.conv_id: r for r in chat.digest(chat.format_conversations(spark.createDataFrame(rows, shape))).collect()}
    assert {i: r.n_turns for i, r in got.items()} == {1: 3, 2: 1, None: 1, 3: 2} and got[1].loss_chars == 0 and got[3].loss_chars == 1
    assert got[1].formatted_chars > len(said) and chat.digest(chat.format_conversations(spark.createDataFrame([], shape))).count() == 0


def test_stages(spark, table):
    for name in ("documents", "empty"):
        left = spark.read.parquet(f"{table}/{name}.parquet")
        columns = left.columns
        for stage, run in corpus_pipeline.STAGES[:-1]:
            left = run(spark, left, table)
            assert left.columns == columns, stage
        last = corpus_pipeline.STAGES[-1][1](spark, left, table)
        assert set(columns) <= set(last.columns) and len(set(last.columns)) == len(last.columns)
        ids = {r.doc_id for r in last.select("doc_id").collect()}
        assert ids == ({3, 4, 7, None} - ({None} if name == "documents" else set()) if name == "documents" else set()), json.dumps(sorted(map(str, ids)))
