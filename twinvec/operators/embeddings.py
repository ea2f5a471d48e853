"""Embedding table helpers: ``emb(word_id, vec)``, subvectors, norms, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinvec.functions.vectors import (dot, l2_normalize, safe_norm, sign_flip, sq_norm, x_part,
                                       y_part)

# Mode names of the reference's export, accepted as aliases of ours.
KIND_ALIASES = {"entire": "w", "+1": "x", "cos sim y": "y", "w": "w", "x": "x", "y": "y"}


def from_table(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("word_id"), F.col(vec_col).alias("vec"))


def with_parts(emb: DataFrame) -> DataFrame:
    """Add ``x``, ``y`` and the squared norms ``sx``, ``sy`` (double)."""
    return (emb.withColumn("x", x_part("vec")).withColumn("y", y_part("vec"))
            .withColumn("sx", sq_norm("x")).withColumn("sy", sq_norm("y")))


def norms(emb: DataFrame) -> DataFrame:
    e = with_parts(emb)
    return e.select("word_id", safe_norm(F.col("sx")).alias("nx"), safe_norm(F.col("sy")).alias("ny"),
                    safe_norm(F.col("sx") + F.col("sy")).alias("n"))


def self_context(emb: DataFrame) -> DataFrame:
    """``w . Q . w`` through the sign-flip expression."""
    return emb.select("word_id", dot("vec", sign_flip("vec")).alias("wqw"))


def export(emb: DataFrame, kind: str = "w", normal: bool = False) -> DataFrame:
    """``(word_id, kind, vec)`` for w (whole), x (odd slots) or y (even slots), raw or unit.

    x and y are normalised from their own raw slices (not slices of the unit whole vector).
    """
    kind = KIND_ALIASES[kind]
    col = {"w": F.col("vec"), "x": x_part("vec"), "y": y_part("vec")}[kind]
    col = l2_normalize(col) if normal else F.transform(col, lambda e: e.cast("double"))
    return emb.select("word_id", F.lit(kind).alias("kind"), col.alias("vec"))


def export_all(emb: DataFrame, normal: bool = False) -> DataFrame:
    return export(emb, "w", normal).unionByName(export(emb, "x", normal)).unionByName(export(emb, "y", normal))
