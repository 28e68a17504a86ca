"""Registered queries of the training-data operators.

Each is ``fn(spark, sf_dir) -> DataFrame`` over its whole table, with the
parameters a deployment would use.  SQL expresses op9 and op12 only; the others
are tested against brute force, fixed cases or held-out accuracy.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from firmament.llm import decontaminate, hnsw, html_text, langid, linkgraph, mixing, phrases, pii, quality, secret_scan, simhash, token_files, whitening
from firmament.llm.store import ship, table_path

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")  # of the secret scan's dictionary

TOKENIZER = "word_bpe_49k.json"  # of the token files

# host/path prefixes
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; labels of ids whose remainder is 0 are not learned."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.train(docs, langid.learned(labels, held_out=(5, 0)))
    return quality.score(docs, model)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(_table(spark, sf_dir, "documents")))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(langid.learned(docs)))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_text.main_text(pages, html_text.train(pages))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(_table(spark, sf_dir, "documents"), secret_scan.dictionary(VOCABULARY))


def op8_url_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op9_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex64(groups["fp"]).alias("fingerprint"), "component_id", "kept")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, from the files written."""
    path = table_path(spark, "tokens")
    token_files.write(_table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER))
    return token_files.checksums(token_files.tokens(spark, path))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.top_phrases(_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.scaled(_table(spark, sf_dir, "embeddings"))
    return whitening.whiten(rows, whitening.fit(rows))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality, op2_pii, op3_language, op4_embedding_dedup, op5_main_text, op6_mixing, op7_secrets, op8_url_verdict, op9_contamination, op10_simhash, op11_token_files, op12_phrases, op13_whitening)
}
ORACLE: dict[str, str] = {"op9_contamination": decontaminate.ORACLE, "op12_phrases": phrases.ORACLE}
