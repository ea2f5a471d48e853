"""Incremental word counts over a folder of corpus text files (A1 on a stream)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinvec.functions.text import split_tokens
from twinvec.session import ensure_checkpoint_dir


def word_count_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming ``(word, freq)``: files are read with a space as record separator (a one-line
    corpus still splits), tokens use the same ASCII-blank rule as the batch job."""
    reader = spark.readStream.format("text").option("lineSep", " ")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    lines = reader.load(path)
    words = lines.select(F.explode(split_tokens("value")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def start_word_counts(spark: SparkSession, path: str, query_name: str, sink: str | None = None,
                      checkpoint_location: str | None = None, available_now: bool = True):
    """Start the counting query. By default each trigger replaces the table ``query_name`` (parquet in the warehouse);
    the ``memory`` sink collects the whole word table in the driver and is for tests."""
    loc = checkpoint_location or (ensure_checkpoint_dir(spark).rstrip("/") + "/twinvec-streams/" + uuid.uuid4().hex)
    writer = (word_count_stream(spark, path).writeStream.outputMode("complete")
              .queryName(query_name).option("checkpointLocation", loc))
    if sink is None:
        writer = writer.foreachBatch(lambda counts, _: counts.write.mode("overwrite").saveAsTable(query_name))
    else:
        writer = writer.format(sink)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
