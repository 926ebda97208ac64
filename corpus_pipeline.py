"""The corpus pipeline: quality, near-duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns a DataFrame; all but
the last return the columns of documents. `run` writes each stage's result to the shared folder and reads it
again, so a lost executor costs at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexloom.llm import ngram_join, packing, quality, secrets, suffix_dedup
from codexloom.llm.common import Work, fresh

#: The packed sequences' tokenizer file, the id that ends a document, and the length of a sequence.
TOKENIZER, END_ID, WINDOW = "word_bpe_49k.json", 2, 4096


def _with_length(docs: DataFrame) -> DataFrame:
    """Texts have changed, so n_chars follows them; that of a null text stays."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text"), "n_chars").cast(docs.schema["n_chars"].dataType))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier predicts to be good. Rows, repeated ones too, and columns stay as they are;
    a null or empty text gets the score of difference 0."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs, "score")
    return quality.score(docs, model, out=score).where(F.col(score) >= quality.THRESHOLD).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word-shingle similarity 0.8 or more: all rows of its smallest doc_id. Empty texts, null
    texts and null ids link with nothing and stay."""
    return ngram_join.keep_first(spark, docs, 5, 80, 100)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 100 bytes that start earlier in the corpus. Every row stays, its text may become empty; null stays null."""
    return _with_length(suffix_dedup.remove(spark, docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each secret replaced by a mark. Every row stays; null stays null; equal texts get equal marks."""
    return _with_length(secrets.redact(docs, Work(spark, "redact")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boundary records of the packed sequences, with the ids of each piece. A null text is empty and gives its end id; repeated rows
    are packed each; an empty table gives no records."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER), END_ID, Work(spark, "pack"), WINDOW)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", drop_repeats),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: Compression, hash-banded joins and suffix arrays are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
