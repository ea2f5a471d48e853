"""Word-similarity evaluation (E1): Spearman correlation of gold scores and cosines, per vector kind.

Average ranks (ties share the mean of their positions) come from a distributed prefix sum
over the distinct values of each group, so no window holds a whole group; the correlation
itself is the built-in ``corr`` aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinvec.operators.ordering import ordered_prefix


def average_rank(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """1-based average rank of ``value`` within ``group`` (ascending; ties get the mean position)."""
    distinct = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_cnt"))
    pre = ordered_prefix(distinct, [F.col(c).asc() for c in group] + [F.col(value).asc()], {"_before": F.col("_cnt")})
    start = pre.groupBy(*group).agg(F.min("_before").alias("_g0"))
    ranks = pre.join(start, group).select(*group, value, (F.col("_before") - F.col("_g0") + (F.col("_cnt") + 1) / 2.0)
                                          .alias(out))
    return df.join(ranks, group + [value])


def spearman(df: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """``(group..., n, rho)`` with rho rounded to 6 decimals."""
    ra = average_rank(df, group, a, "_ra")
    rb = average_rank(ra, group, b, "_rb")
    return rb.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("_ra", "_rb"), 6).alias("rho"))


def wordsim(similarities: DataFrame, gold: str = "gold") -> DataFrame:
    """E1 for w, x and y: ``similarities`` has ``gold, cos_w, cos_x, cos_y`` per pair."""
    long = similarities.select(gold, F.explode(F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(f"cos_{k}").alias("cos")) for k in "wxy"])).alias("s"))
    long = long.select(F.col("s.kind").alias("kind"), F.col(gold).alias("gold"), F.col("s.cos").alias("cos"))
    return spearman(long, ["kind"], "gold", "cos")


def eval_similarity(emb: DataFrame, vocab: DataFrame, pairs: DataFrame) -> DataFrame:
    """E1 on a word-pair set ``(w1, w2, gold)`` (see ``sources.corpus.read_similarity``).

    Words map to ids through the vocabulary (ids >= 1); a pair with an unknown word or a word
    without a vector is dropped and counted in ``n_unknown``. Returns ``(kind, n, n_unknown, rho)``.
    """
    from twinvec.operators.joins import lookup_join
    from twinvec.operators.neighbors import similarities

    ids = vocab.where(F.col("word_id") >= 1).select("word", "word_id")
    with_vec = ids.join(emb.select("word_id"), "word_id", "left_semi")
    p = pairs.select(F.monotonically_increasing_id().alias("pid"), "w1", "w2", "gold")
    p = lookup_join(p, with_vec.select(F.col("word").alias("w1"), F.col("word_id").alias("a")), "w1")
    p = lookup_join(p, with_vec.select(F.col("word").alias("w2"), F.col("word_id").alias("b")), "w2")
    known = p.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    unknown = p.agg(F.count(F.when(F.col("a").isNull() | F.col("b").isNull(), 1)).alias("n_unknown"))
    rho = wordsim(similarities(emb, known.select("pid", "a", "b", "gold")))
    return rho.withColumn("_k", F.lit(1)).join(unknown.withColumn("_k", F.lit(1)), "_k").select(
        "kind", "n", "n_unknown", "rho")
