"""The operators' queries over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import co_training, decontamination, language, mixing, near_duplicates, order_minhash, piece_codec, prefix_trie, private_data, quality_rules, token_counts, turn_repair, url_filter
from .common import read


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edited_fingerprints(read(spark, sf_dir, "documents"))


def piece_model() -> bytes:
    """The public tokenizer's model file; its bytes go to the workers, not its path."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.identify(docs.select("doc_id", "text"), docs).select("doc_id", "held_out", "lang_pred", "score")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, piece_model()).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return private_data.find(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_found")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.clean(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_bad_lines")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co_training.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages").select("page_id", "url"))


def op9_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_codec.encode_decode(docs, piece_model(), digest=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return mixing.mix(docs)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.digest(read(spark, sf_dir, "conversations"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = prefix_trie.rebuilt(prefix_trie.ordered_turns(read(spark, sf_dir, "conversations")))
    return prefix_trie.digest(*prefix_trie.trie(turns, convs))


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.digest(decontamination.windows(docs, read(spark, sf_dir, "benchmark")))


def queries() -> dict:
    return {
        "op1_document_fingerprints": op1_document_fingerprints,
        "op2_language_id": op2_language_id,
        "op3_token_counts": op3_token_counts,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_personal_data": op5_personal_data,
        "op6_quality_rules": op6_quality_rules,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_url_filters": op8_url_filters,
        "op9_sentencepiece_codec": op9_sentencepiece_codec,
        "op10_source_mixing": op10_source_mixing,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_conversation_trie": op12_conversation_trie,
        "op13_benchmark_decontamination": op13_benchmark_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_quality_rules": quality_rules.SQL,
        "op10_source_mixing": mixing.SQL,
        "op12_conversation_trie": prefix_trie.SQL,
        "op13_benchmark_decontamination": decontamination.SQL,
    }
