"""A corpus from raw documents to packed token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet in the shared folder and reread as the next stage's docs.  All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.bitpack import packed_digest, tokenizer_path
from tabloom.llm.decontaminate import clean
from tabloom.llm.language_id import UNKNOWN, held_out, learn, predicted
from tabloom.llm.mixing import mix
from tabloom.llm.near_copies import one_of_each
from tabloom.llm.shared import drop_made, made, table, written


#: By what share the best language must beat the second best: below it a text is as likely in either.
TOLD = 0.01


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with the language they were found to be in as their lang.

    Rejected are texts without letters and texts that parse as well in two languages.
    """
    told = predicted(docs, learn(docs.where(~held_out())))
    kept = told.where((F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= TOLD))
    return kept.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (Jaccard index of five-word shingles at least 0.8), one row: that with the smallest doc_id."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as its source's target weight draws, in a global random order."""
    return mix(docs).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids, and of each document what the files say: doc_id, start, n_tokens, ids_crc32."""
    return packed_digest(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_ids", token_ids),
]

#: SQL can express neither the trained language model nor the tokenizer; tests/llm hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's input and what it wrote for itself are dropped once its result is written."""
    docs, begun = table(spark, sf_dir, "documents"), made()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        if name != STAGES[-1][0]:  # the last one's packed files are its output
            drop_made(spark, begun, made() - 1)
    return docs
