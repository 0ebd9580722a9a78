"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import (
    chats,
    collocations,
    common,
    divergence,
    fingerprints,
    mixing,
    neardup,
    packing,
    quality_rules,
    substrings,
    token_counts,
    token_files,
    toxicity,
    warc,
)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_documents(common.table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality_rules.judged(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return d.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "rule")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.cut(common.table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(common.table(spark, sf_dir, "documents"), k=2)


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = common.new_folder(spark, "token-counts")
    token_counts.write(common.table(spark, sf_dir, "documents"), at, tokenizer("word_bpe_49k.json"))
    return token_counts.read(spark, at)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = common.new_folder(spark, "token-files")
    token_files.write(common.table(spark, sf_dir, "documents"), at, tokenizer("byte_bpe_50k.json"))
    return token_files.read_documents(spark, at)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(common.table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), limits=packing.DOCUMENTS)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = common.new_folder(spark, "warc")
    warc.write(common.table(spark, sf_dir, "pages"), at)
    return warc.read(spark, at)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(common.table(spark, sf_dir, "documents").drop("n_chars"), keep_text=False)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    net = toxicity.train(*toxicity.sample(documents, common.table(spark, sf_dir, "labels")))
    return toxicity.scored(documents, net)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(common.table(spark, sf_dir, "documents"))


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.round_trip(common.table(spark, sf_dir, "conversations"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(common.table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports this module

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_fingerprints,
        op2_quality_rules,
        op3_substrings,
        op4_near_duplicates,
        op5_warc,
        op6_mixing,
        op7_token_counts,
        op8_token_files,
        op9_packing,
        op10_toxicity,
        op11_collocations,
        op12_chat_formatting,
        op13_divergence,
        pipeline,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op11_collocations": collocations.SQL, "op12_chat_formatting": chats.SQL, "op13_divergence": divergence.SQL}
