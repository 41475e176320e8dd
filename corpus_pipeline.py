"""A training-data pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept,
and returns the columns of documents; the last returns one row of encoding
digests for each document that is left. Between stages run() writes the rows to
the shared folder, so that a lost executor costs no finished stage.

Rows: null texts have no language and go in the first stage; null ids are kept
by the dedup stages as documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpyramid.llm.common import table, written
from gridpyramid.llm.exact_dedup import exact_dedup
from gridpyramid.llm.language_id import identify
from gridpyramid.llm.minhash_neardup import near_duplicates
from gridpyramid.llm.sentencepiece_codec import encoded_digests
from gridpyramid.llm.source_mixing import mix

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose language is less certain than this go.
MIN_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a known language; a missing label is filled by the prediction."""
    known = identify(docs.select(*COLUMNS)).where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each text."""
    return exact_dedup(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five-word shingles, similarity 0.8."""
    gone = written(near_duplicates(docs).where("not kept").select("doc_id").distinct(), "near-gone")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that sources, languages and topics meet their target weights."""
    return mix(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes what is left."""
    return encoded_digests(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("source_mixing", mixing), ("sentencepiece", encoding)]

#: SQL cannot express the language model, the tokenizer or the components of near duplicates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
