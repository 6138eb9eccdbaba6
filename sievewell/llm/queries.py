"""The registered queries of the numbered operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievewell.llm.mixing import mix_documents

    return mix_documents(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievewell.llm.toxicity import learned, scored

    docs = table(spark, sf_dir, "documents")
    return scored(docs, learned(docs, table(spark, sf_dir, "labels")))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievewell.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievewell.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op5_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievewell.llm.pseudo_likelihood import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op6_sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievewell.llm.pieces import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievewell.llm.fingerprints import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op8_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievewell.llm.quality_neighbours import fitted, scored

    docs = table(spark, sf_dir, "documents")
    return scored(docs, fitted(docs, table(spark, sf_dir, "labels")))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievewell.llm.embedding_dedup import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievewell.llm.jaccard_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievewell.llm.conversation_trie import trie

    return trie(table(spark, sf_dir, "conversations"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievewell.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op13_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievewell.llm.warc_zip import archived_pages

    return archived_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    from sievewell.llm.collocations import collocations_sql
    from sievewell.llm.conversation_trie import trie_sql
    from sievewell.llm.licenses import scan_sql
    from sievewell.llm.warc_zip import archived_pages_sql

    return {"op3_license_scan": scan_sql(), "op11_conversation_trie": trie_sql(), "op12_phrase_collocations": collocations_sql(), "op13_warc_zip": archived_pages_sql()}
