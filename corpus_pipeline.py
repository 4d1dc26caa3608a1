"""From documents to token ids: STAGES in order, each from whole table to whole table.

Language identification drops texts without a language; one document of each class of
near duplicates stays; personal data is replaced by its kind; sources are repeated to
equal shares of characters; texts are encoded as SentencePiece ids and decoded again.

Defined cases, in every stage: an empty table gives an empty one; columns beyond those of
``documents`` are left behind, so their names cannot clash; repeated rows count as rows
until near_dedup, which keeps one of them; what a null in a column means is said by stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.llm import language, mixing, near_duplicates, piece_codec, private_data
from barflow.llm.common import read, saved
from barflow.llm.queries import piece_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with it in ``lang``.

    Null and empty texts and texts without a letter go; so does all if no document has a ``lang`` to learn from.
    A null or wrong ``lang`` becomes the language told from the text; other nulls stay.
    """
    told = language.identify(docs.select(COLUMNS)).filter(F.col("lang_pred") != language.UNKNOWN)
    return told.withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the least doc_id (nulls last).

    A null text is a class of its own; texts without a word are alike only if equal.
    """
    return near_duplicates.kept(docs.select(COLUMNS)).select(COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced; n_chars follows the text (null for a null text)."""
    return private_data.redact(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources have equal shares, in shuffled order; a null source is a source, a null doc_id the empty id."""
    return mixing.mix(docs.select(COLUMNS)).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each copy's ids and decoded text; a null text is the empty text, without ids."""
    return piece_codec.encode_decode(docs.select(COLUMNS), piece_model()).select("doc_id", "source", "n_tokens", "ids", "decoded")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("source_mixing", source_mixing),
    ("sentencepiece", encode),
]

#: Language identification, DartMinHash and the span field are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"stage-{name}")
    return docs
