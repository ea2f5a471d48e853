"""Writers (S5-S9, S11): vocabulary, vector text, word + vector text, reports, checkpoints.

Text forms are produced with column expressions and written by Spark; the row order of a
text file follows ``word_id`` through a range-partitioned sort (no single-task sort).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinvec.operators.embeddings import export

# Fixed value: decimals of the reference's vector text files.
TEXT_DECIMALS = 10


def fixed_decimals(e: Column, decimals: int = TEXT_DECIMALS) -> Column:
    """``printf('%.<decimals>f')`` as a column expression: the exact binary value rounded half to even.

    float32 vectors often sit exactly on a tie at the 11th decimal, so half-up would differ.
    """
    exact = e.cast("double").cast("decimal(38,20)")
    return F.bround(exact, decimals).cast(f"decimal(38,{decimals})").cast("string")


def vocab_lines(vocab: DataFrame) -> DataFrame:
    """``(word_id, line)`` with ``line = 'word count'`` (plain UTF-8, no bytes-literal form)."""
    return vocab.select("word_id", F.concat_ws(" ", "word", F.col("freq").cast("string")).alias("line"))


def vector_lines(emb: DataFrame, kind: str = "w", normal: bool = False, decimals: int = TEXT_DECIMALS) -> DataFrame:
    """``(word_id, kind, line)``: the numbers of one vector kind, space separated."""
    ex = export(emb, kind, normal)
    return ex.select("word_id", "kind", F.array_join(F.transform("vec", lambda e: fixed_decimals(e, decimals)), " ")
                     .alias("line"))


def word_vector_lines(emb: DataFrame, vocab: DataFrame, kind: str = "w", normal: bool = False) -> DataFrame:
    """``word v1 ... vd`` joined on ``word_id`` (not pasted by row position)."""
    vl = vector_lines(emb, kind, normal)
    return vl.join(vocab.select("word_id", "word"), "word_id").select(
        "word_id", "kind", F.concat_ws(" ", "word", "line").alias("line"))


def write_lines(lines: DataFrame, path: str, order_col: str = "word_id") -> None:
    """Write one text line per row in ``order_col`` order (range-partitioned sort)."""
    lines.orderBy(order_col).select("line").write.mode("overwrite").text(path)


def write_report(report: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per query word (``partitionBy('q')``)."""
    report.write.mode("overwrite").partitionBy("q").format(fmt).option("header", "true").save(path)


# Our own bound: query words of one report file.
WORDS_PER_FILE = 1000


def write_report_files(report: DataFrame, path: str, fmt: str = "parquet", key: str = "q", words_per_file: int = WORDS_PER_FILE) -> None:
    """S9 for many words: about one file for ``words_per_file`` of them instead of a folder a word; a word's rows follow each other in
    one file, in rank order."""
    files = max(1, -(-report.select(key).distinct().count() // words_per_file))
    order = [c for c in (key, "panel", "rank") if c in report.columns]
    report.repartition(files, key).sortWithinPartitions(*order).write.mode("overwrite").format(fmt).option("header", "true").save(path)
