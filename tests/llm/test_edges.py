"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for operators and stages."""

import hashlib
import zlib

import pytest

import corpus_pipeline
from seriesloom.llm import byte_bpe, chat, decontaminate, exact_dedup, html_text, near_dedup, quality, queries, sharding, token_files, toxicity

LONG = " ".join(f"word{i % 997}x{i}" for i in range(60_000))
PASSAGE = " ".join(f"item{i}" for i in range(30))
# doc_id, text and columns whose names the operators use inside
ROWS = [
    (1, "Some plain words of a text, in order", "en", "s", 1),
    (2, None, None, None, None),
    (3, "", "en", "s", 0),
    (4, "   \n\t ", "en", "s", 3),
    (5, "some plain words of a text, in order", "en", "s", 1),
    (5, "some plain words of a text, in order", "en", "s", 1),
    (6, "a different text " + PASSAGE + " that ends here", "en", "s", 1),
    (7, LONG, "en", "s", 1),
    (8, LONG + " tail", "en", "s", 1),
    (None, "a text without an id", "en", "s", 1),
    (9, "x" * 5000, "en", "s", 1),
    (10, "one", None, "s", 1),
    (11, "ONE", None, "s", 1),
    (12, "Schön, 漢字 😀 ﷽ é", "de", "s", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["shard", "sha", "id", "n", "key", "score", "ids", "component", "start", "label"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (3, 0, 0), (5, 1, 1), (6, 1, 0), (6, 0, 1), (None, 1, 1), (7, None, None), (10, 0, 1), (12, 1, 0), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, PASSAGE), (2, None), (None, "text"), (3, ""), (4, PASSAGE)], "item_id long, text string")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


OPERATORS = {
    "sharding": lambda d, l, i: sharding.assign_shards(d, 5),
    "exact": lambda d, l, i: exact_dedup.exact_groups(d),
    "near": lambda d, l, i: near_dedup.link_groups(d, size=2),
    "bpe": lambda d, l, i: byte_bpe.digests(byte_bpe.encode_decode(d, queries.RANKS, queries.public_tokenizers.PATTERN)),
    "tokens": lambda d, l, i: token_files.round_trip(d, queries.WORD_BPE),
    "quality": lambda d, l, i: quality.score_documents(d, l),
    "toxicity": lambda d, l, i: toxicity.score_documents(d, l),
    "items": lambda d, l, i: decontaminate.find_items(d, i),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row_whatever_else_there_is(docs, clashing, labels, items, name):
    got = rows_of(OPERATORS[name](docs, labels, items))
    assert got == rows_of(OPERATORS[name](clashing, labels, items))
    assert name == "items" or len(got) == len(ROWS)
    assert name == "items" or sorted(map(repr, (r[0] for r in got))) == sorted(repr(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, docs, labels, items, name):
    assert OPERATORS[name](docs.limit(0), labels, items).collect() == []
    without = OPERATORS[name](docs, labels.limit(0), items.limit(0)).collect()
    assert name == "items" and without == [] or len(without) == len(ROWS)


def test_shards_of_edges(docs):
    got = sharding.assign_shards(docs, 5).collect()
    assert sorted(r["size"] for r in got if r.doc_id in (2, 3)) == [8, 8]
    assert len({r.shard for r in got if r.doc_id in (2, 3)}) == 1  # null and empty are one group
    assert all(r.text_crc32 == zlib.crc32(b"") for r in got if r.doc_id in (2, 3))


def test_exact_of_edges(docs):
    got = {r.doc_id: r for r in exact_dedup.exact_groups(docs).collect()}
    assert (got[1].keep_id, got[1].group_size, got[1].kept) == (5, 3, False)
    assert (got[2].keep_id, got[2].group_size) == (3, 2) and got[10].keep_id == 11
    assert got[2].text_sha256 == hashlib.sha256(b"").hexdigest()
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, [3, 4, 5, 6, 7, 8, None, 9, 11, 12]))


def test_near_of_edges(docs):
    got = {r.doc_id: r for r in near_dedup.link_groups(docs, size=2).collect()}
    assert [got[i].n_shingles for i in (2, 3, 4, 10)] == [0, 0, 0, 1]
    assert all(got[i].component_id == i and got[i].kept for i in (2, 3, 4, 9)) and got[None].component_id is None and got[None].kept
    assert (got[5].component_id, got[5].kept, got[8].component_id, got[11].component_id) == (1, False, 7, 10)


def test_an_id_with_two_texts(spark):
    rows = [(1, "a b c d e f"), (2, "p q r s t u"), (2, "a b c d e f"), (3, "p q r s t u")]
    got = near_dedup.link_groups(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()
    assert {r.component_id for r in got} == {1}


def test_items_of_edges(docs, items):
    got = decontaminate.find_items(docs, items).collect()
    assert sorted((r.doc_id, r.item_id, r.distance, r.start, r.n_words) for r in got) == [(6, 1, 0, 3, 30), (6, 4, 0, 3, 30)]
    assert decontaminate.drop_contaminated(docs, items).count() == len(ROWS) - 1


def test_models_without_two_classes(docs, labels):
    assert {r.score for r in quality.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in toxicity.score_documents(docs, labels.limit(0)).collect()} == {0.5}


def test_pages_of_edges(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>a</p>", "x"), (2, "v", "", "x"), (3, "w", "<p>" + LONG + "</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(pages)
    assert rows_of(got.select("page_id", "n_chars")) == rows_of(spark.createDataFrame([(1, 0), (1, 0), (None, 1), (2, 0), (3, len(LONG))], "page_id long, n_chars long"))
    assert html_text.extract(pages.limit(0)).collect() == []


def test_chat_of_edges(spark):
    rows = [(1, 0, None, None, "x"), (1, 0, None, None, "x"), (None, None, None, "Hi", "x"), (None, 3, "user", "Hi", "x"), (2, 5, "USER:", "q?\nassistant: yes", "x"), (2, None, "bot", "", "x"), (3, 1, "user", LONG, "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, conv string")
    got = chat.format_turns(table)
    assert got.count() == 6  # equal rows count once
    by = {(r.conv_id, r.turn): r for r in got.collect()}
    assert by[2, 5].roles == ["user", "assistant"] and by[2, None].roles == ["assistant"] and by[3, 1].texts == [LONG]
    assert chat.format_turns(table.limit(0)).collect() == []


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, docs, labels, items):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    items.write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_keep_the_columns(spark, docs, clashing, folder, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs, folder)
    assert stage(spark, docs.limit(0), folder).collect() == []
    if name == corpus_pipeline.STAGES[-1][0]:
        assert got.count() == len(ROWS)
        return
    assert got.columns == docs.columns and stage(spark, clashing, folder).columns == clashing.columns
    assert sorted(map(repr, (r.doc_id for r in got.collect()))) == sorted(map(repr, (r.doc_id for r in stage(spark, clashing, folder).collect())))
