"""Inputs of the registered queries, derived by rule from the driver's tables.

Every derived input grows with its table (no id subsets, no caps):

* corpus: ``documents`` in ``(doc_id, pos)`` order;
* vectors: ``embeddings.vec_id`` is the word id (word 0 is UNK);
* query words: every vector;
* analogy questions: for every k with ``3k+2 < n_vectors``: ``a=3k, b=3k+1, c=3k+2`` and
  ``d = c`` when ``k % 3 = 0`` else ``3k+3`` (a ``d`` past the last vector is unknown: skipped);
* similarity pairs: ``(i, i+1)`` for every i, gold ``10 - i%5`` when the labels match else ``i%5``.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinvec.operators import corpus as C
from twinvec.operators.embeddings import from_table
from twinvec.params import Word2VecParams

PARAMS = Word2VecParams()
_MEMO: dict = {}
_LOCK = threading.RLock()  # builds may use other memoised inputs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(table(spark, sf_dir, "embeddings"))


def _memo(spark: SparkSession, key: tuple, build):
    full = (spark.sparkContext.applicationId,) + key
    with _LOCK:
        if full not in _MEMO:
            _MEMO[full] = build()
        return _MEMO[full]


def corpus(spark: SparkSession, sf_dir: str, params: Word2VecParams = PARAMS):
    """(tokens, vocab, encoded, total_tokens) for the documents corpus, built once per session."""
    return _memo(spark, ("corpus", sf_dir, params.min_count),
                 lambda: C.prepare_corpus(table(spark, sf_dir, "documents"), params, counted=counted(spark, sf_dir, params)))


def counted(spark: SparkSession, sf_dir: str, params: Word2VecParams = PARAMS):
    """(vocab, total_tokens) of the documents corpus, built once per session; queries of words alone need no encoded tokens."""
    return _memo(spark, ("counted", sf_dir, params.min_count, params.window_size),
                 lambda: C.prepare_vocab(table(spark, sf_dir, "documents"), params))


def kept(spark: SparkSession, sf_dir: str, epoch: int = 0, params: Word2VecParams = PARAMS) -> DataFrame:
    """The epoch's kept positions ``(k, g, word_id)``, materialised once per session."""
    _, _, enc, total = corpus(spark, sf_dir, params)
    return _memo(spark, ("kept", sf_dir, epoch, params.min_count, params.subsample, params.seed),
                 lambda: C.epoch_kept(enc, total, params, epoch))


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark, sf_dir)[0]


def all_query_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("q"))


def analogy_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(qid, a, b, c, d)`` by the rule in the module docstring."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("a"))
    k = (F.col("a") / 3).cast("long")
    q = e.where(F.col("a") % 3 == 0).select(k.alias("qid"), "a")
    q = q.select("qid", "a", (F.col("a") + 1).alias("b"), (F.col("a") + 2).alias("c"))
    q = q.withColumn("d", F.when(F.col("qid") % 3 == 0, F.col("c")).otherwise(F.col("a") + 3))
    return q


def similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pid, a, b, gold)`` by the rule in the module docstring (both ids must have vectors)."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("i"), "label")
    nxt = e.select((F.col("i") - 1).alias("i"), F.col("label").alias("label_b"))
    j = e.join(nxt, "i")
    gold = F.when(F.col("label") == F.col("label_b"), F.lit(10) - F.col("i") % 5).otherwise(F.col("i") % 5)
    return j.select(F.col("i").alias("pid"), F.col("i").alias("a"), (F.col("i") + 1).alias("b"),
                    gold.cast("double").alias("gold"))
