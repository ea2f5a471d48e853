"""Two-dimensional view of vectors.

The reference draws t-SNE maps started from PCA; exact t-SNE is a single-machine quadratic
method, so the distributed part kept here is the PCA projection (Spark ML computes the
covariance with a distributed aggregation). Component signs are fixed so that the largest
loading of each component is positive.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinvec.functions.vectors import x_part, y_part


def project_2d(emb: DataFrame, kind: str = "w", first_n: int | None = None) -> DataFrame:
    """``(word_id, kind, p1, p2)`` for every vector of ``emb`` (P14: or the ids below ``first_n``,
    the reference's plot selection of the most frequent words)."""
    if first_n is not None:
        emb = emb.where(F.col("word_id") < first_n)
    col = {"w": F.col("vec"), "x": x_part("vec"), "y": y_part("vec")}[kind]
    feats = emb.select("word_id", array_to_vector(F.transform(col, lambda e: e.cast("double"))).alias("f"))
    model = PCA(k=2, inputCol="f", outputCol="p").fit(feats)
    pc = model.pc.toArray()  # d x 2 loadings: model parameters, not data
    signs = np.sign(pc[np.argmax(np.abs(pc), axis=0), [0, 1]])
    signs[signs == 0] = 1.0
    out = model.transform(feats).select("word_id", vector_to_array("p").alias("p"))
    return out.select("word_id", F.lit(kind).alias("kind"), (F.col("p")[0] * float(signs[0])).alias("p1"),
                      (F.col("p")[1] * float(signs[1])).alias("p2"))
