"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowkeel.llm import bond, bpe, circulant, fingerprint, hybrid, mixing, ordinal, packed, rindex, template, trie, urlfilter, winnow


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulant.near_groups(table(spark, sf_dir, "documents"), percent=85).select(
        "doc_id", "n_shingles", "component_id", "kept")


def op1_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.score(table(spark, sf_dir, "documents"))


def op2_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rindex.remove_repeats(table(spark, sf_dir, "documents"))


def op3_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.main_text(table(spark, sf_dir, "pages"))


def op4_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op6_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_likeness(table(spark, sf_dir, "documents"))


def op8_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.grade_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


def op9_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed.token_table(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.rule_table(spark, urlfilter.RULES))


def op11_word_table_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe.encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias(
        "ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.search(hybrid.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_bond_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bond.mine(table(spark, sf_dir, "embeddings"), 50, bond.moved_label())


QUERIES = {f.__name__: f for f in (
    op1_elias_fano_lm, op2_repeat_removal, op3_page_text, op4_pareto_mixing, op5_winnowing, op6_minhash_fingerprints,
    op7_circulant_minhash, op8_ordinal_quality, op9_packed_ids, op10_url_rules, op11_word_table_bpe, op12_hybrid_search,
    op13_bond_negatives)}
ORACLES: dict[str, str] = {
    "op4_pareto_mixing": mixing.ORACLE, "op5_winnowing": winnow.ORACLE, "op10_url_rules": urlfilter.ORACLE,
    "op12_hybrid_search": hybrid.ORACLE, "op13_bond_negatives": bond.ORACLE}
