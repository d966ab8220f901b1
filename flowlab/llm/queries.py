"""The registered queries of this subpackage, over the whole of the given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from flowlab.llm import (
    bpe_duck,
    collocations,
    jaccard_bayes,
    line_marginals,
    pack_mixture,
    prefix_trie,
    pstable,
    quality_crf,
    secret_lexer,
    seed_extend,
    suffix_dcx,
    warc,
    weak_labels,
)
from flowlab.plans.catalog.registry import query, table


@query("op1_line_quality")
def line_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality_crf.rate(docs, quality_crf.fit(docs, table(spark, folder, "labels")))


@query("op2_warc_segments")
def archives(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


@query("op3_weak_toxicity")
def toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    _, _, classifier = weak_labels.fit(docs, table(spark, folder, "labels"))
    return weak_labels.score(docs, classifier)


@query("op4_jaccard_bayes")
def jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_bayes.join_similar(table(spark, folder, "documents"))


@query("op5_mixture_packing")
def packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_mixture.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op6_seed_extend")
def repeated_words(spark: SparkSession, folder: str) -> DataFrame:
    return seed_extend.repeats(table(spark, folder, "documents"))


@query("op7_pstable_vectors")
def near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return pstable.near_vectors(table(spark, folder, "embeddings"))


@query("op8_suffix_dc")
def repeated_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dcx.repeats(table(spark, folder, "documents"))


@query("op9_bpe_duckdb")
def bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe_duck.round_trip(table(spark, folder, "documents"), ranks, pattern)


@query("op10_secret_lexer")
def secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_lexer.find(table(spark, folder, "documents"))


@query("op11_prefix_trie", prefix_trie.SQL)
def conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.build(table(spark, folder, "conversations"))


@query("op12_hat_trie_phrases", collocations.SQL)
def phrases(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


@query("op13_line_marginals")
def line_quality_score(spark: SparkSession, folder: str) -> DataFrame:
    return line_marginals.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
