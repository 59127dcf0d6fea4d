"""The registered queries of the training-data operators, over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, language, license, mixing, prefixes, quality, repair, rules, simhash, substring, suffix, url_filter
from .common import table


def op1_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op5_simhash_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op6_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.apply_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", F.array_join("sentence_ids", "|").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), "kind")


def op10_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op11_min_plus_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.reports(repair.damaged(table(spark, sf_dir, "conversations")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_language_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bloom_cascade": op1_bloom_cascade,
        "op2_multi_index": op2_multi_index,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_factorisation_machine": op4_factorisation_machine,
        "op5_simhash_trees": op5_simhash_trees,
        "op6_suffix_family": op6_suffix_family,
        "op7_quality_rules": op7_quality_rules,
        "op8_source_mix": op8_source_mix,
        "op9_license_rules": op9_license_rules,
        "op10_suffix_automata": op10_suffix_automata,
        "op11_min_plus_repair": op11_min_plus_repair,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_language_hierarchy": op13_language_hierarchy,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_bloom_cascade": url_filter.oracle_sql(),
        "op7_quality_rules": rules.oracle_sql(),
        "op9_license_rules": license.oracle_sql(),
        "op11_min_plus_repair": repair.oracle_sql(),
        "op12_prefix_trie": prefixes.oracle_sql(),
    }
