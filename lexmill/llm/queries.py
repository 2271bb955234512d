"""The opN queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracle
from ._common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_groups

    return jaccard_groups(table(spark, sf_dir, "documents"), k=3, threshold=(9, 10)).select("doc_id", "n_shingles", "component_id")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import fresh_folder, token_digests, write_tokens

    folder = fresh_folder(spark)
    write_tokens(table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return token_digests(spark, folder).withColumnRenamed("id", "doc_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lattice_lm import lattice_scores, load_pieces

    return lattice_scores(table(spark, sf_dir, "documents"), load_pieces(tokenizer_path("byte_bpe_multi_50k.tiktoken")))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_verdicts

    return quality_verdicts(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_html_extraction, op3_quality_classifier, op4_source_mixing, op5_token_output, op6_language_id, op7_decontamination, op8_lm_scoring, op9_suffix_dedup, op10_quality_rules)}

ORACLE_SQL: dict[str, str] = {"op1_ngram_jaccard_join": oracle.OP1, "op4_source_mixing": oracle.OP4, "op10_quality_rules": oracle.OP10}
