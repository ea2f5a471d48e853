"""Readers (S1-S4): text corpora, analogy question files, similarity sets, tagged corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinvec.functions.text import split_tokens
from twinvec.operators.ordering import dense_prefix, ordered_prefix


def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A plain-text corpus (possibly one huge line) as ``tokens(g, word)`` in file order.

    The files are read with a space as the record separator, so even a one-line corpus is
    split across tasks; each record is split again on the other ASCII blanks. Order:

    * a file split is ``(file path, block start)``; per split the record count and the first
      row id form a tiny table (one row per split) whose prefix sum gives each split's first
      record number (broadcast: bounded by the number of splits);
    * within a split, rows are contiguous in their partition, so ``row id - first row id``
      numbers them; the record number is then a dense key and token positions come from the
      block prefix sum of per-record token counts. Nothing is materialised.
    """
    raw = (spark.read.option("lineSep", " ").text(path)
           .select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
                   F.monotonically_increasing_id().alias("_r")))
    splits = raw.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_nrec"), F.min("_r").alias("_r0"))
    before = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    split_off = splits.select("_f", "_b", "_r0", F.coalesce(F.sum("_nrec").over(before), F.lit(0)).alias("_rec0"))
    recs = raw.join(F.broadcast(split_off), ["_f", "_b"]).select(
        (F.col("_rec0") + F.col("_r") - F.col("_r0")).alias("_rec"), split_tokens("value").alias("_t"))
    recs = recs.withColumn("_n", F.size("_t").cast("long"))
    pos = dense_prefix(recs, "_rec", {"_off": F.col("_n")})
    ex = pos.select("_off", F.posexplode("_t").alias("_p", "word"))
    return ex.select((F.col("_off") + F.col("_p")).alias("g"), "word")


SIMILARITY_SCHEMA = T.StructType([T.StructField("w1", T.StringType()), T.StructField("w2", T.StringType()),
                                  T.StructField("gold", T.DoubleType())])


def read_similarity(spark: SparkSession, path: str) -> DataFrame:
    """``w1<TAB>w2<TAB>gold`` lines (words lower-cased)."""
    df = spark.read.schema(SIMILARITY_SCHEMA).option("sep", "\t").csv(path)
    return df.select(F.lower("w1").alias("w1"), F.lower("w2").alias("w2"), "gold")


def read_tagged(df: DataFrame, order: list[str], word_col: str = "word", tag_col: str = "tag") -> DataFrame:
    """S3: any tagged table with an order key -> ``tagged(g, word, tag)``, words lower-cased."""
    pos = ordered_prefix(df.select(*order, word_col, tag_col), [F.col(c).asc() for c in order], {"g": F.lit(1).cast("long")})
    return pos.select("g", F.lower(word_col).alias("word"), F.col(tag_col).alias("tag"))
