"""A corpus pipeline of five operators: ``documents`` in, packed training sequences out.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last keep the columns of ``documents``; where a text changes, ``n_chars`` follows it. A document that
line dedup or substring dedup leaves without words stays in the table with an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinvec.llm import line_dedup, ngram_jaccard, packing, quality_lm, substring_dedup
from twinvec.session import checkpoint, discard

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Ids of documents that go are sent to every task up to this number (a long each); beyond it the texts are shuffled to them.
MOST_SENT = 2_000_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the documents of ``ids``. Their number is counted: Spark's estimate for them is that of all documents."""
    ids = checkpoint(ids.select("doc_id").distinct())
    return docs.join(F.broadcast(ids) if ids.count() <= MOST_SENT else ids, "doc_id", "left_anti").select(*COLUMNS)


def _with_text(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return _without(docs, quality_lm.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("not kept"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go."""
    return _with_text(line_dedup.dedup(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest id stays."""
    return _without(docs, ngram_jaccard.near_duplicates(docs).where("doc_id <> component_id"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that occur earlier go."""
    return _with_text(substring_dedup.dedup(docs))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    import public_tokenizers

    return packing.pack_texts(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates),
          ("substring dedup", passages), ("packing", sequences)]

#: The language model of the first stage and random packing are no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stored = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
        discard(*stored)
        stored = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
