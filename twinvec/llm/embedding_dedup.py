"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Equal vectors are one class with a weight. Every class gets a signature of ``bits`` hyperplane signs in each of ``tables``
tables; classes that share a signature are compared by exact cosine in double precision. With an angle a between two
vectors a sign agrees with probability 1 - a / pi, which gives the number of tables for the wished recall at the
threshold itself (closer pairs are found more surely). ``bits`` grows with the logarithm of the number of vectors.

A bucket of many members is cut into tiles, and every pair of tiles is a task of bounded size; a task returns one row per
member (its number of links, and the smallest member it hangs together with), never the pairs. A pair that meets in
several tables counts in the first of them only. Counting all links of a dense cluster needs all its cosines, which
tiles spread over the cluster's tasks; its output stays linear.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing; so do vectors of
different length; rows that share an id are one vector, the smallest; a null id is not linked; labels and extra columns
are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinvec.llm.components import components
from twinvec.llm.registry import register, table
from twinvec.session import checkpoint

COSINE, RECALL, SEED, TILE = 0.9, 0.95, 17, 2048
#: Rows that one task takes of buckets that need no tiles.
TASK_ROWS = 20_000


def tables_for(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Signs in a signature, and tables, for n vectors."""
    bits = min(30, max(8, math.ceil(math.log2(max(n, 2))) - 2))
    agree = 1 - math.acos(cosine) / math.pi
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree ** bits))


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``vec_id, cls`` for every id (cls null if the vector links with nothing), and ``cls, vec, weight``."""
    one = vectors.groupBy("vec_id").agg(F.min("embedding").alias("vec"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = (F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", bad)
            & F.exists("vec", lambda x: ~bad(x) & (x != 0)))
    one = checkpoint(one.select("vec_id", "vec", F.coalesce(good, F.lit(False)).alias("good"),
                                F.xxhash64("vec").alias("h"), F.hash("vec").alias("g")))
    same = one.where("good").groupBy("h", "g").agg(F.min("vec_id").alias("cls"), F.count(F.lit(1)).alias("weight"))
    same = checkpoint(same)
    member = one.where("good").select("vec_id", "h", "g").join(same, ["h", "g"]).select("vec_id", "cls").union(
        one.where("not good").select("vec_id", F.lit(None).cast("long")))
    return member, one.join(same.select("cls", "weight"), F.col("vec_id") == F.col("cls")).select("cls", "vec", "weight")


def signatures(classes: DataFrame, bits: int, tables: int, kind: str, seed: int = SEED) -> DataFrame:
    """``cls, weight, vec`` (its bytes as ``kind``) and ``signs`` (one 32-bit signature for each table)."""
    def run(batches):
        planes = {}
        for b in batches:
            at = b["vec"].offsets.to_numpy()
            flat = b["vec"].values.to_numpy(zero_copy_only=False).astype(kind)
            vecs, signs = [], []
            for lo, hi in zip(at[:-1], at[1:]):
                v = flat[lo:hi]
                if len(v) not in planes:
                    planes[len(v)] = np.random.default_rng([seed, len(v)]).standard_normal((tables * bits, len(v)))
                vecs.append(v.tobytes())
                up = (planes[len(v)] @ (v / np.abs(v).max()).astype(np.float64) > 0).reshape(tables, bits)
                signs.append((up @ (1 << np.arange(bits))).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b["cls"], b["weight"], pa.array(vecs, pa.binary()), pa.array(signs, pa.binary())],
                                             names=["cls", "weight", "vec", "signs"])
    return classes.select("cls", "weight", "vec").mapInArrow(run, "cls long, weight long, vec binary, signs binary")


def _buckets(sig: DataFrame, tables: int) -> DataFrame:
    """``cls, t, bucket``."""
    part = lambda t: F.substring("signs", 4 * t + 1, 4)
    return sig.select("cls", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), part(t), F.length("vec")).alias("bucket")) for t in range(tables)])).alias("x")
    ).select("cls", "x.t", "x.bucket")


def linked(sig: DataFrame, tables: int, kind: str, cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """``cls, n, root`` rows: links counted (by weight of the other class) and one smaller class it hangs together with."""
    at = checkpoint(_buckets(sig, tables))
    size = checkpoint(at.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    rows = size.agg(F.sum("c")).first()[0] or 0
    tasks = max(1, -(-rows // TASK_ROWS))
    parts = F.ceil(F.col("c") / tile).cast("int")
    t = at.join(size, "bucket").select("cls", "t", "bucket", F.pmod(F.xxhash64("cls"), parts).cast("int").alias("own"), parts.alias("parts"))
    t = t.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    unit = F.when(F.col("parts") == 1, F.pmod("bucket", F.lit(tasks))).otherwise(F.xxhash64("bucket", lo, hi))
    t = t.select("cls", "t", "bucket", "own", lo.alias("lo"), hi.alias("hi"), unit.alias("unit")).join(sig, "cls")

    def run(x):
        x = x.sort_by([("bucket", "ascending"), ("lo", "ascending"), ("hi", "ascending"), ("cls", "ascending")])
        ids, weight = x["cls"].to_numpy(), x["weight"].to_numpy()
        bucket, own, low, high, turn = (x[c].to_numpy() for c in ("bucket", "own", "lo", "hi", "t"))
        signs = np.frombuffer(b"".join(x["signs"].to_pylist()), dtype="<u4").reshape(len(ids), -1)
        vecs = x["vec"].to_pylist()
        edge = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
        out = []
        for a, b in zip(edge, np.append(edge[1:], len(ids))):
            if b - a < 2:
                continue
            v = np.frombuffer(b"".join(vecs[a:b]), dtype=kind).reshape(b - a, -1).astype(np.float64)
            v = v / np.abs(v).max(axis=1, keepdims=True)
            v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
            i, j = np.nonzero(np.triu(v @ v.T >= cosine, 1))
            if low[a] != high[a]:
                cross = own[a + i] != own[a + j]
                i, j = i[cross], j[cross]
            if not len(i):
                continue
            n = np.zeros(b - a, dtype=np.int64)
            for s in range(0, len(i), 1 << 16):
                p, q = i[s:s + (1 << 16)], j[s:s + (1 << 16)]
                fresh = ~(signs[a + p, :turn[a]] == signs[a + q, :turn[a]]).any(axis=1)
                np.add.at(n, p[fresh], weight[a + q[fresh]])
                np.add.at(n, q[fresh], weight[a + p[fresh]])
            root = np.arange(b - a)
            while True:  # members are in order of id, so the smallest number is the smallest id
                least = root.copy()
                np.minimum.at(least, i, root[j])
                np.minimum.at(least, j, root[i])
                least = least[least]
                if (least == root).all():
                    break
                root = least
            some = np.unique(np.concatenate([i, j]))
            out.append((ids[a + some], n[some], ids[a + root[some]]))
        col = lambda k: pa.array(np.concatenate([o[k] for o in out]) if out else np.empty(0, dtype=np.int64), pa.int64())
        return pa.table({"cls": col(0), "n": col(1), "root": col(2)})

    return t.groupBy("unit").applyInArrow(run, "cls long, n long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every id of ``vectors (vec_id, embedding)``."""
    member, classes = classes_of(vectors.select(F.col("vec_id").cast("long"), "embedding"))
    classes = checkpoint(classes)
    bits, tables = tables_for(classes.count(), cosine, recall)
    kind = "<f4" if dict(classes.dtypes)["vec"] == "array<float>" else "<f8"
    sig = checkpoint(signatures(classes, bits, tables, kind))
    found = checkpoint(linked(sig, tables, kind, cosine, tile))
    n = found.groupBy("cls").agg(F.sum("n").alias("n"))
    comp = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b"))).select(
        F.col("node").alias("cls"), F.col("component").alias("comp"))
    per_class = classes.select("cls", "weight").join(n, "cls", "left").join(comp, "cls", "left").select(
        "cls", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("comp", "cls").alias("comp"))
    good = member.where("cls is not null").join(per_class, "cls").select("vec_id", F.col("n").alias("n_links"), F.col("comp").alias("component_id"))
    rest = member.where("cls is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(rest).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


@register("op4_embedding_dedup")
def op4_embedding_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))
