"""The queries of the numbered operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from codexloom.llm import bpe

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codexloom.llm import ngram_join

    return ngram_join.join(spark, table(spark, sf_dir, "documents"), 3, 90, 100)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codexloom.llm import suffix_dedup

    return suffix_dedup.digests(spark, table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codexloom.llm import secrets
    from codexloom.llm.common import Work

    return secrets.scan(table(spark, sf_dir, "documents"), Work(spark, "op4"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codexloom.llm import embeddings

    return embeddings.near_duplicates(spark, table(spark, sf_dir, "embeddings"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from codexloom.llm import media

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return media.digests(media.store_text(docs).drop("text"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codexloom.llm import quality

    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from codexloom.llm import binary_output
    from codexloom.llm.common import Work

    shards = binary_output.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2, Work(spark, "op7"))
    return binary_output.read(shards)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from codexloom.llm import chat

    return chat.formatted(spark, table(spark, sf_dir, "conversations"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from codexloom.llm import packing
    from codexloom.llm.common import Work

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2, Work(spark, "op10")).drop("ids")


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from codexloom.llm import best_fit
    from codexloom.llm.common import Work

    ids = best_fit.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0, Work(spark, "op11"))
    return best_fit.pack(ids).drop("part", "row")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codexloom.llm import filter_audit
    from codexloom.llm.common import Work

    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Work(spark, "op12"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codexloom.llm import spelling
    from codexloom.llm.common import Work

    return spelling.grouped(table(spark, sf_dir, "documents"), Work(spark, "op13"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_ngram_join, op3_suffix_dedup, op4_secrets, op5_embeddings, op6_media, op7_binary_output, op8_quality, op9_chat, op10_packing, op11_best_fit, op12_filter_audit, op13_spelling)}


def oracle_sql() -> dict[str, str]:
    from codexloom.llm import filter_audit

    return {"op12_filter_audit": filter_audit.SQL}
