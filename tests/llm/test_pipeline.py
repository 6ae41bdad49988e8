"""The pipeline against plain versions of its stages, each on the stage's own input."""

import hashlib
import itertools

import numpy as np
import pytest
from test_brute_force import best_by_trial, near_by_trial

import corpus_pipeline
from seriesloom.llm import byte_bpe, decontaminate, queries


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Rows after each stage, from the documents on."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def texts(rows):
    return {r.doc_id: r.text for r in rows}


def test_good_documents_stay(spark, sf, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = texts(stages[1])
    known = [(d in kept, labels[d]) for d in texts(stages[0]) if d in labels]
    assert sum(k == bool(y) for k, y in known) / len(known) > 0.95


def test_one_of_each_text_stays(stages):
    best = {}
    for d, t in texts(stages[1]).items():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        best[low] = max(best.get(low, d), d)
    assert set(texts(stages[2])) == set(best.values())


def test_one_of_each_group_stays(stages):
    found = near_by_trial(sorted(texts(stages[2]).items()), 5)
    assert set(texts(stages[3])) == {d for d, (_, _, kept) in found.items() if kept}


def test_benchmark_passages_go(spark, sf, stages):
    items = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = {g for w in items for g in zip(w, w[1:], w[2:])}
    kept = texts(stages[4])
    for d, t in texts(stages[3]).items():
        words = decontaminate.words_of(t)
        if not any(g in grams for g in zip(words, words[1:], words[2:])):
            assert d in kept  # an item shares three words in a row with any text that holds it
            continue
        held = any(best_by_trial(w, words, decontaminate.edits(len(w), 0.2)) is not None for w in items if len(set(zip(w, w[1:], w[2:])) & set(zip(words, words[1:], words[2:]))) > 2)
        assert (d in kept) != held, d


def test_tokens_of_what_is_left(spark, sf, stages):
    import tiktoken

    plain = tiktoken.Encoding("plain", pat_str=queries.public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(queries.RANKS), special_tokens={})
    want = {}
    for d, t in texts(stages[4]).items():
        ids = plain.encode_ordinary(t)
        want[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in stages[5]} == want
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == set(want)
    assert all(len(a) >= len(b) for a, b in itertools.pairwise(stages))
