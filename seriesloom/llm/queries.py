"""The registered queries of the corpus operators, on the test tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seriesloom.llm import byte_bpe, chat, decontaminate, exact_dedup, html_text, near_dedup, periodic_runs, quality, sharding, token_files, toxicity, url_filter, vector_codes
from seriesloom.llm.tables import table
from seriesloom.session import ship

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
# Rules of the URL filter, as (host and path, verdict)
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link_groups(table(spark, sf_dir, "documents"), size=2)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(byte_bpe.encode_decode(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_turns(table(spark, sf_dir, "conversations"), distinct=False)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), WORD_BPE)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.product_codes(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.find_runs(table(spark, sf_dir, "documents"), plant=True, texts=False)


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


OP8_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""

# every round joins all parts with all entries of their position; the nearest entry is that of the least |c|^2 - 2xc
OP11_ROUND = """
n{k} AS MATERIALIZED (SELECT p.r, p.part, arg_min(b.e, struct_pack(d := list_inner_product(b.v, b.v) - 2 * list_inner_product(p.v, b.v), e := b.e)) AS e,
    min(list_inner_product(p.v, p.v) + list_inner_product(b.v, b.v) - 2 * list_inner_product(p.v, b.v)) AS d FROM p JOIN b{k} b ON b.part = p.part GROUP BY p.r, p.part)"""
OP11_BOOK = """
b{next} AS MATERIALIZED (SELECT b.part, b.e, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN (SELECT part, e, list(CAST(w AS DOUBLE) ORDER BY i) AS v FROM (
    SELECT n.part, n.e, i, (sum(CAST(p.v[i] AS BIGINT)) - (sum(CAST(p.v[i] AS BIGINT)) % count(*) + count(*)) % count(*)) // count(*) AS w
    FROM n{k} n JOIN p ON p.r = n.r AND p.part = n.part, LATERAL (SELECT unnest(generate_series(1, len(p.v))) AS i) GROUP BY n.part, n.e, i) GROUP BY part, e) m
    ON m.part = b.part AND m.e = b.e)"""
OP11_SQL = (
    """
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(1024 * x)) AS v
    FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
p AS MATERIALIZED (SELECT r, part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] AS v FROM k, generate_series(0, 3) g(part)),
b0 AS MATERIALIZED (SELECT part, r AS e, v FROM p WHERE r < 256),"""
    + "".join(OP11_ROUND.format(k=k) + "," + OP11_BOOK.format(k=k, next=k + 1) + "," for k in range(4))
    + OP11_ROUND.format(k=4)
    + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(CAST(v[i] AS BIGINT) AS VARCHAR), ',' ORDER BY part, e, i))
    FROM b4, LATERAL (SELECT unnest(generate_series(1, len(v))) AS i)) AS codebooks_sha256
FROM k JOIN (SELECT r, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM n4 GROUP BY r) USING (r)
"""
)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: fn for name, fn in globals().items() if name.startswith("op") and callable(fn)}

    def run(fn):
        def shipped(spark, sf_dir):
            ship(spark)
            return fn(spark, sf_dir)

        return shipped

    return {name: run(fn) for name, fn in found.items()}


def checks() -> dict[str, str]:
    return {"op8_exact_dedup": OP8_SQL, "op11_vector_codes": OP11_SQL}
