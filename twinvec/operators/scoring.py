"""Blocked top-k scoring of query vectors against every candidate vector.

The reference computes a dense [queries x vocabulary] product and runs top-k on it. Here:

* queries are hashed into ``n_qb`` query blocks and candidates into ``n_chunks`` chunks;
* each query row is copied once per chunk and each candidate row once per query block
  (the replication scheme of a blocked matrix product), and the two sides are cogrouped
  on ``(qb, chunk)``: every group holds at most one query block and one chunk, a size
  bounded by the block parameters, never by the data;
* inside the group NumPy computes the partial products for a few hundred queries at a
  time and keeps, per query and panel, the exact local top k (ties on the rounded score
  go to the lower id, as in the final ranking);
* the union of the local top k lists contains the global top k, which one window with
  ``row_number() <= k`` selects (Spark plans a partial ``WindowGroupLimit`` before the
  shuffle, so the merge is pre-aggregated map-side).

No pair is emitted as a row, no cross join is planned, and nothing is collected.
Several panels (scores) share one pass, which replaces the reference's separate products.

Two other plans give the same rows. A few queries (:data:`FEW_QUERIES`, counted) are sent to every task and the
candidates are scanned where they lie, each task keeping the best ``k`` so far (:func:`topk_few`): the table is not shuffled. Long lists
and stretches of ranks (:func:`rank_interval`) first count scores in bins, which gives the scores between which the ranks lie,
and then emit only the pairs in that band, so the memory of a task does not depend on ``k``. In every plan a pair whose score is not
finite has no rank.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from typing import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinvec.session import checkpoint

# Fixed value: scores are rounded to this many decimals before ranking (stable ties).
SCORE_DECIMALS = 6


@dataclass(frozen=True)
class Kernel:
    """How to turn stacked query/candidate matrices into panel scores.

    ``prepare_q`` / ``prepare_c`` map the raw float64 matrices of the array columns to a dict
    of derived matrices (done once per block). ``scores`` gets the two dicts for a slice of
    queries and returns ``{panel: function returning the score matrix}`` (larger is better;
    only requested panels are evaluated). ``extras`` returns functions of the rows and columns of
    selected pairs, which give additional values reported for them.
    """

    q_cols: tuple[str, ...]
    c_cols: tuple[str, ...]
    prepare_q: Callable[[dict], dict]
    prepare_c: Callable[[dict], dict]
    scores: Callable[[dict, dict], dict]
    extras: Callable[[dict, dict], dict] | None = None
    extra_names: tuple[str, ...] = ()
    q_scalars: tuple[str, ...] = ()


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of an array column, one a row, in double precision; a null component is NaN."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], column.type)
    sizes = pc.list_value_length(lists)
    width = pc.max(sizes).as_py() or 0
    if len(lists) and (sizes.null_count or pc.min(sizes).as_py() != width):
        raise ValueError("vectors must be of one length and not null")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), width)


def _longs(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64)


def _local_topk(score: np.ndarray, k: int) -> np.ndarray:
    """Boolean mask of the exact top k per row, ordered by (score desc, column asc).

    Columns are assumed sorted by candidate id, so 'column asc' is 'id asc'.
    """
    n_rows, n_cols = score.shape
    if n_cols <= k:
        return np.ones_like(score, dtype=bool)
    kth = -np.partition(-score, k - 1, axis=1)[:, k - 1]
    gt = score > kth[:, None]
    need = k - gt.sum(axis=1)
    eq = score == kth[:, None]
    take_eq = eq & (np.cumsum(eq, axis=1) <= need[:, None])
    return gt | take_eq


def _best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and rounded scores of the exact top k finite scores per row, ordered by (rounded score desc, column asc).

    The k-th largest of the maxima of many stretches of a row is a lower bound of its k-th largest score, so a row is looked at closely only
    above it; rounding keeps the order, so nothing below the bound by more than its step can be among the k.
    """
    n_rows, n_cols = score.shape
    stretches = max(8 * k, 512)
    if n_cols >= 2 * stretches:
        whole = n_cols // stretches * stretches
        tops = score[:, :whole].reshape(n_rows, -1, stretches).max(axis=1)
        # A maximum shows what has no rank, but for minus infinity, which is below any finite bound.
        if any(np.isnan(x).any() or np.isposinf(x).any() for x in (tops, score[:, whole:])):
            score = np.where(np.isfinite(score), score, -np.inf)
            tops = score[:, :whole].reshape(n_rows, -1, stretches).max(axis=1)
        low = np.partition(tops, stretches - k, axis=1)[:, stretches - k]
        if np.isfinite(low).all():
            found = np.flatnonzero(score >= (low - 1.5 * 10.0 ** -SCORE_DECIMALS - 1e-12 * np.abs(low))[:, None])
            if len(found) <= 16 * k * n_rows:
                r, c = np.divmod(found, n_cols)
                v = np.round(score[r, c], SCORE_DECIMALS)
                order = np.lexsort((c, -v, r))
                r, c, v = r[order], c[order], v[order]
                own = (np.arange(len(r)) - np.searchsorted(r, r) < k) & np.isfinite(v)
                return r[own], c[own], v[own]
    v = np.round(np.where(np.isfinite(score), score, -np.inf), SCORE_DECIMALS)
    r, c = np.nonzero(_local_topk(v, k) & np.isfinite(v))
    return r, c, v[r, c]


def _slices(kernel: Kernel, slice_rows: int, queries: pa.Table, cands: pa.Table):
    """``(rows of queries, ids of candidates in order, scores, extras)`` for slices of queries."""
    if not (queries.num_rows and cands.num_rows):
        return
    cands = cands.take(pa.array(np.argsort(_longs(cands["id"]), kind="stable")))
    cm = kernel.prepare_c({c: _matrix(cands["c__" + c]) for c in kernel.c_cols})
    cm["_id"] = _longs(cands["id"])
    for at in range(0, queries.num_rows, slice_rows):
        own = queries.slice(at, slice_rows)
        qm = kernel.prepare_q({c: _matrix(own["q__" + c]) for c in kernel.q_cols})
        for c in kernel.q_scalars:
            qm[c] = _longs(own["q__" + c])
        scores = kernel.scores(qm, cm)          # panel -> zero-argument function (lazy)
        yield own, cm["_id"], scores, kernel.extras(qm, cm) if kernel.extras else {}
        # The functions hold the slice's score matrices and are held by ``qm`` themselves: without this cut each slice's matrices would
        # stay until Python looks for cycles.
        scores.clear(), qm.clear()


def _found(own: pa.Table, panel: str, ids: np.ndarray, r: np.ndarray, c: np.ndarray, v: np.ndarray, kernel: Kernel, extras: dict) -> list:
    """The selected pairs as columns of :func:`_schema`."""
    # An extra that is not a number is null.
    more = [pa.array(np.round(extras[e](r, c), SCORE_DECIMALS), from_pandas=True) for e in kernel.extra_names]
    return [pa.array(_longs(own["q"])[r]), pa.repeat(panel, len(r)), pa.array(ids[c]), pa.array(v), *more]


def _table(pieces: list[list], names: list[str], kinds: list) -> pa.Table:
    schema = pa.schema(list(zip(names, kinds)))
    return pa.Table.from_batches([pa.RecordBatch.from_arrays(x, schema=schema) for x in pieces], schema=schema)


def _columns(kernel: Kernel) -> tuple[list[str], list]:
    return (["q", "panel", "id", "score", *kernel.extra_names],
            [pa.int64(), pa.string(), pa.int64(), *[pa.float64()] * (1 + len(kernel.extra_names))])


def _make_udf(kernel: Kernel, panels: tuple[str, ...], k: int, slice_rows: int):
    def run(queries: pa.Table, cands: pa.Table) -> pa.Table:
        out = []
        for own, ids, scores, extras in _slices(kernel, slice_rows, queries, cands):
            for p in panels:
                r, c, v = _best(scores[p](), k)
                out.append(_found(own, p, ids, r, c, v, kernel, extras))
        return _table(out, *_columns(kernel))

    return run


# Our own bounds on one cogroup: rows of a query block and of a candidate chunk. With d = 300
# a group holds at most (16384 + 65536) * 300 * 8 bytes = 197 MB of float64 vectors.
MAX_QUERY_BLOCK = 16384
MAX_CAND_CHUNK = 65536
# Rows that a group's lists may have (about 60 bytes each).
LIST_ROWS = 1 << 20
# Entries of one score matrix per query slice (8 MB as float64).
SLICE_ENTRIES = 1 << 20


def plan_blocks(n_queries: int, n_cands: int, min_groups: int, max_query_block: int = MAX_QUERY_BLOCK,
                max_cand_chunk: int = MAX_CAND_CHUNK, list_rows: int = 0) -> tuple[int, int]:
    """Numbers of query blocks and candidate chunks.

    Start from the fewest blocks the memory bounds allow (least replication: the shuffle
    carries ``queries * chunks + candidates * blocks`` rows and the merge ``queries * chunks * k``),
    then split the side with the larger blocks until there are ``min_groups`` groups. ``list_rows`` is the length of a query's lists
    for all panels: they bound the block too, and where they are long the queries are split, since one chunk more carries
    ``n_queries * list_rows`` rows of lists and one block more ``n_cands`` rows of vectors.
    """
    if list_rows:
        max_query_block = max(16, min(max_query_block, LIST_ROWS // list_rows))
    n_qb = max(1, math.ceil(n_queries / max_query_block))
    n_ch = max(1, math.ceil(n_cands / max_cand_chunk))
    while n_qb * n_ch < min_groups and (n_queries / n_qb > 16 or n_cands / n_ch > 64):
        dear = n_queries * list_rows > 4 * n_cands and n_queries / n_qb > 16
        if n_cands / n_ch >= n_queries / n_qb and not dear:
            n_ch += 1
        else:
            n_qb += 1
    return n_qb, n_ch


def _replicas(queries: DataFrame, cands: DataFrame, kernel: Kernel, n_qb: int, n_ch: int, more: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The two sides of the cogroup: each query once per chunk, each candidate once per query block."""
    # Fresh names on both sides: the two inputs often derive from the same table. The cogroup
    # keys must have the same type on both sides (long), or equal keys hash apart.
    q_rep = (queries.select(F.col("q").alias("q"), *[F.col(c).alias("q__" + c)
                                                     for c in kernel.q_cols + kernel.q_scalars], *more)
             .withColumn("qb", F.pmod(F.xxhash64("q"), F.lit(n_qb)).cast("long"))
             .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_ch - 1).cast("long")))))
    c_rep = (cands.select(F.col("id").alias("id"), *[F.col(c).alias("c__" + c) for c in kernel.c_cols])
             .withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(n_ch)).cast("long"))
             .withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_qb - 1).cast("long")))))
    return q_rep, c_rep


def _ranked(local: DataFrame, kernel: Kernel, k: int) -> DataFrame:
    """The best ``k`` of the local lists."""
    w = Window.partitionBy("q", "panel").orderBy(F.col("score").desc(), F.col("id").asc())
    ranked = local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("q", "panel", F.col("rank").cast("long").alias("rank"), "id", "score", *kernel.extra_names)


def topk_panels(queries: DataFrame, cands: DataFrame, kernel: Kernel, panels: tuple[str, ...] | list[str], k: int,
                n_queries: int | None = None, n_cands: int | None = None, query_block: int = MAX_QUERY_BLOCK,
                cand_chunk: int = MAX_CAND_CHUNK, slice_rows: int | None = None,
                min_groups: int | None = None) -> DataFrame:
    """Exact top ``k`` candidates per (query, panel).

    ``queries`` needs a long column ``q`` plus ``kernel.q_cols``; ``cands`` needs a long
    column ``id`` plus ``kernel.c_cols``. Returns ``(q, panel, rank, id, score, extras...)``
    with ``rank`` 1..k by score descending, lower id first on ties.
    """
    panels = tuple(panels)
    spark = queries.sparkSession
    if n_queries is None:
        n_queries = queries.count()
    if n_queries <= FEW_QUERIES and n_queries * len(panels) * k <= FEW_ENTRIES:
        return topk_few(queries, cands, kernel, panels, k)
    if n_cands is None:
        n_cands = cands.count()
    if min_groups is None:
        min_groups = 2 * spark.sparkContext.defaultParallelism
    n_qb, n_ch = plan_blocks(n_queries, n_cands, min_groups, query_block, cand_chunk, len(panels) * k)
    if slice_rows is None:
        slice_rows = max(8, min(1024, SLICE_ENTRIES // max(1, math.ceil(n_cands / n_ch))))

    q_rep, c_rep = _replicas(queries, cands, kernel, n_qb, n_ch)
    udf = _make_udf(kernel, panels, k, slice_rows)
    local = (q_rep.groupBy("qb", "chunk").cogroup(c_rep.groupBy("qb", "chunk"))
             .applyInArrow(lambda a, b: udf(a, b), schema=_schema(kernel)))
    return _ranked(local, kernel, k)


def _schema(kernel: Kernel) -> T.StructType:
    return T.StructType([T.StructField("q", T.LongType()), T.StructField("panel", T.StringType()), T.StructField("id", T.LongType()),
                         T.StructField("score", T.DoubleType())] + [T.StructField(e, T.DoubleType()) for e in kernel.extra_names])


# Our own bounds on the plan for a few queries: rows sent to every task, and entries of a task's lists.
FEW_QUERIES, FEW_ENTRIES = 64, 1 << 20


def topk_few(queries: DataFrame, cands: DataFrame, kernel: Kernel, panels: tuple[str, ...] | list[str], k: int) -> DataFrame:
    """:func:`topk_panels` for queries that every task can hold (at most :data:`FEW_QUERIES` rows are collected): candidates are
    read where they lie and never shuffled; a task merges each stretch of them into its lists of ``k``."""
    rows = queries.select("q", *[F.col(c).alias("q__" + c) for c in kernel.q_cols + kernel.q_scalars]).limit(FEW_QUERIES + 1).toArrow()
    if rows.num_rows > FEW_QUERIES:
        raise ValueError(f"more than {FEW_QUERIES} queries")
    sent = queries.sparkSession.sparkContext.broadcast(rows)
    find = _make_udf(kernel, tuple(panels), k, max(8, rows.num_rows))

    names = ["q", "panel", "id", "score", *kernel.extra_names]

    def scan(frames):
        best = pd.DataFrame({n: [] for n in names})
        for cdf in frames:
            found = find(sent.value, pa.Table.from_pandas(cdf, preserve_index=False)).to_pandas()
            if len(found):
                both = pd.concat([best, found], ignore_index=True) if len(best) else found
                both = both.sort_values(["q", "panel", "score", "id"], ascending=[True, True, False, True], kind="stable")
                best = both[both.groupby(["q", "panel"], sort=False).cumcount() < k]
        if len(best):
            yield best[names].astype({"q": "int64", "id": "int64"})
    local = cands.select("id", *[F.col(c).alias("c__" + c) for c in kernel.c_cols]).mapInPandas(scan, _schema(kernel))
    return _ranked(local, kernel, k)


# Pairs that a group of the second pass of rank_interval emits.
BAND_ENTRIES = 1 << 17


def _bins(score: np.ndarray) -> np.ndarray:
    """Numbers that rise with the (rounded) score: its sign, exponent and first bits, 16 bins a power of two, so that a query has far fewer bins than
    candidates."""
    bits = (score + 0.0).view(np.int64)
    return np.where(bits >= 0, bits, np.int64(-1 << 63) - bits) >> 48


def rank_interval(queries: DataFrame, cands: DataFrame, kernel: Kernel, panels: tuple[str, ...] | list[str], first: int, last: int,
                  n_queries: int | None = None, n_cands: int | None = None, query_block: int = MAX_QUERY_BLOCK,
                  cand_chunk: int = MAX_CAND_CHUNK) -> DataFrame:
    """Ranks ``first`` to ``last`` of each (query, panel), as :func:`topk_panels` numbers them, in two passes.

    The first counts the scores of every block and chunk by bins; the merged counts tell in which bins the wanted ranks lie, and
    how many pairs stand above them. The second emits the pairs in those bins, from blocks and chunks cut so small that a group has
    about :data:`BAND_ENTRIES` of them. So no task holds whole lists, whatever their length.
    """
    panels = tuple(panels)
    parallel = 2 * queries.sparkSession.sparkContext.defaultParallelism
    n_queries = queries.count() if n_queries is None else n_queries
    n_cands = cands.count() if n_cands is None else n_cands
    n_qb, n_ch = plan_blocks(n_queries, n_cands, parallel, query_block, cand_chunk)
    slice_rows = max(8, min(1024, SLICE_ENTRIES // max(1, math.ceil(n_cands / n_ch))))

    def tally(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        for own, ids, scores, extras in _slices(kernel, slice_rows, a, b):
            for p in panels:
                s = np.round(scores[p](), SCORE_DECIMALS)
                ok = np.isfinite(s)
                code, n = np.unique((np.nonzero(ok)[0] << 17) + _bins(s[ok]) + (1 << 16), return_counts=True)
                out.append([pa.array(_longs(own["q"])[code >> 17]), pa.repeat(p, len(n)), pa.array((code & (1 << 17) - 1) - (1 << 16)), pa.array(n)])
        return _table(out, ["q", "panel", "bin", "n"], [pa.int64(), pa.string(), pa.int64(), pa.int64()])
    q_rep, c_rep = _replicas(queries, cands, kernel, n_qb, n_ch)
    counts = checkpoint(q_rep.groupBy("qb", "chunk").cogroup(c_rep.groupBy("qb", "chunk")).applyInArrow(
        lambda a, b: tally(a, b), "q long, panel string, bin long, n long").groupBy("q", "panel", "bin").agg(F.sum("n").alias("n")))
    w = Window.partitionBy("q", "panel").orderBy(F.col("bin").desc())  # at most one row a bin
    above = counts.withColumn("above", F.sum("n").over(w) - F.col("n"))
    band = above.where((F.col("above") < last) & (F.col("above") + F.col("n") >= first)).groupBy("q", "panel").agg(
        F.min("bin").alias("low"), F.max("bin").alias("high"), F.min("above").alias("above"))
    # One struct a panel, so that a query's row carries the bands of all its panels.
    bands = checkpoint(band.groupBy("q").pivot("panel", list(panels)).agg(F.first(F.struct("low", "high", "above"))))
    # Groups of the second pass are as small as the share of the pairs that stand in a band asks for.
    inside = counts.join(band.select("q", "panel", "low", "high"), ["q", "panel"]).where(F.col("bin").between(F.col("low"), F.col("high")))
    share = (inside.agg(F.sum("n")).first()[0] or 0) / max(1, n_queries * n_cands * len(panels))
    cells = BAND_ENTRIES / len(panels) / max(share, BAND_ENTRIES / (query_block * cand_chunk))
    chunk = min(math.ceil(n_cands / n_ch), max(1, math.isqrt(int(cells))))
    n_qb, n_ch = max(n_qb, math.ceil(n_queries / max(1, cells / chunk))), max(n_ch, math.ceil(n_cands / chunk))
    slice_rows = max(8, min(1024, SLICE_ENTRIES // max(1, math.ceil(n_cands / n_ch))))
    wanted = queries.join(bands.select("q", *[F.col(p)["low"].alias(f"low__{p}") for p in panels],
                                       *[F.col(p)["high"].alias(f"high__{p}") for p in panels]), "q")

    def pick(x: pa.Table, y: pa.Table) -> pa.Table:
        out = []
        for own, ids, scores, extras in _slices(kernel, slice_rows, x, y):
            for p in panels:
                low, high = (_longs(pc.fill_null(own[f"{e}__{p}"], d))[:, None] for e, d in (("low", 1), ("high", 0)))
                s = np.round(scores[p](), SCORE_DECIMALS)
                b = _bins(np.where(np.isfinite(s), s, 0.0))
                r, c = np.nonzero(np.isfinite(s) & (b >= low) & (b <= high))
                out.append(_found(own, p, ids, r, c, s[r, c], kernel, extras))
        return _table(out, *_columns(kernel))
    q_rep, c_rep = _replicas(wanted, cands, kernel, n_qb, n_ch, tuple(f"{x}__{p}" for x in ("low", "high") for p in panels))
    local = q_rep.groupBy("qb", "chunk").cogroup(c_rep.groupBy("qb", "chunk")).applyInArrow(lambda a, b: pick(a, b), _schema(kernel))
    start = bands.select("q", F.explode(F.array(*[F.struct(F.lit(p).alias("panel"), F.col(p)["above"].alias("above")) for p in panels])).alias("x")).select(
        "q", "x.panel", "x.above")
    w = Window.partitionBy("q", "panel").orderBy(F.col("score").desc(), F.col("id").asc())
    out = local.withColumn("n", F.row_number().over(w)).join(start, ["q", "panel"]).withColumn("rank", (F.col("above") + F.col("n")).cast("long"))
    return out.where(F.col("rank").between(first, last)).select("q", "panel", "rank", "id", "score", *kernel.extra_names)


# Scores of a chunk's list that its sketch holds.
SKETCH = 16


def rank_stretch(queries: DataFrame, cands: DataFrame, kernel: Kernel, panels: tuple[str, ...] | list[str], first: int, last: int,
                 n_queries: int | None = None, n_cands: int | None = None, query_block: int = MAX_QUERY_BLOCK,
                 cand_chunk: int = MAX_CAND_CHUNK) -> DataFrame:
    """Ranks ``first`` to ``last`` of each (query, panel), as :func:`topk_panels` numbers them, for lists a task can hold.

    The first pass reports every ``step``-th score of a chunk's best ``last``; the m-th largest of a query's reports has ``m * step`` scores at
    or above it, which gives a lower bound of the score at rank ``last``. The second pass emits only the pairs from that bound on, about
    ``last + chunks * step`` a query instead of ``last`` a chunk.
    """
    panels = tuple(panels)
    n_queries = queries.count() if n_queries is None else n_queries
    n_cands = cands.count() if n_cands is None else n_cands
    n_ch = max(1, math.ceil(n_cands / cand_chunk))
    n_qb, n_ch = plan_blocks(n_queries, n_cands, 2 * queries.sparkSession.sparkContext.defaultParallelism, query_block, cand_chunk,
                             len(panels) * math.ceil(last / n_ch))
    slice_rows = max(8, min(1024, SLICE_ENTRIES // max(1, math.ceil(n_cands / n_ch))))
    step = math.ceil(last / SKETCH)

    def report(x: pa.Table, y: pa.Table) -> pa.Table:
        out = []
        for own, ids, scores, extras in _slices(kernel, slice_rows, x, y):
            for p in panels:
                r, c, v = _best(scores[p](), last)
                order = np.lexsort((-v, r))
                r, v = r[order], v[order]
                told = (np.arange(len(r)) - np.searchsorted(r, r)) % step == step - 1
                q, ends = np.unique(r[told], return_index=True)
                lists = pa.ListArray.from_arrays(np.append(ends, told.sum()).astype(np.int32), pa.array(v[told]))
                out.append([pa.array(_longs(own["q"])[q]), pa.repeat(p, len(q)), lists])
        return _table(out, ["q", "panel", "told"], [pa.int64(), pa.string(), pa.list_(pa.float64())])
    q_rep, c_rep = _replicas(queries, cands, kernel, n_qb, n_ch)
    told = q_rep.groupBy("qb", "chunk").cogroup(c_rep.groupBy("qb", "chunk")).applyInArrow(
        lambda a, b: report(a, b), "q long, panel string, told array<double>")
    lows = told.groupBy("q", "panel").agg(F.sort_array(F.flatten(F.collect_list("told")), asc=False).alias("told"))
    lows = lows.select("q", "panel", F.get("told", F.lit(math.ceil(last / step) - 1)).alias("low"))
    # A query that comes twice has twice the reports and twice the pairs, so its bound holds too.
    wanted = queries.join(lows.groupBy("q").pivot("panel", list(panels)).agg(F.first("low")).select(
        "q", *[F.col(p).alias(f"low__{p}") for p in panels]), "q", "left")

    def pick(x: pa.Table, y: pa.Table) -> pa.Table:
        out = []
        for own, ids, scores, extras in _slices(kernel, slice_rows, x, y):
            for p in panels:
                low = pc.fill_null(own[f"low__{p}"], -math.inf).to_numpy()[:, None]
                s = scores[p]()
                r, c, v = _best(np.where(s >= low - 10.0 ** -SCORE_DECIMALS - 1e-12 * np.abs(low), s, -np.inf), last)
                out.append(_found(own, p, ids, r, c, v, kernel, extras))
        return _table(out, *_columns(kernel))
    q_rep, c_rep = _replicas(wanted, cands, kernel, n_qb, n_ch, tuple(f"low__{p}" for p in panels))
    local = q_rep.groupBy("qb", "chunk").cogroup(c_rep.groupBy("qb", "chunk")).applyInArrow(lambda a, b: pick(a, b), _schema(kernel))
    return _ranked(local, kernel, last).where(F.col("rank") >= first)


# ---------------------------------------------------------------------------------------
# Kernels
# ---------------------------------------------------------------------------------------

NORM_EPS = 1e-12


def _split(w: np.ndarray) -> dict:
    x = np.ascontiguousarray(w[:, 1::2])
    y = np.ascontiguousarray(w[:, 0::2])
    sx = np.einsum("ij,ij->i", x, x)
    sy = np.einsum("ij,ij->i", y, y)
    return {"x": x, "y": y,
            "nx": np.sqrt(np.maximum(sx, NORM_EPS)), "ny": np.sqrt(np.maximum(sy, NORM_EPS)),
            "nw": np.sqrt(np.maximum(sx + sy, NORM_EPS))}


def _once(fn):
    """A zero-argument function computed at most once (panels share intermediate matrices)."""
    cell = []

    def get():
        if not cell:
            cell.append(fn())
        return cell[0]
    return get


def _neighbor_scores(qm: dict, cm: dict) -> dict:
    """Only the requested panels are computed; ``x.x'`` and ``y.y'`` are shared by all of them."""
    xx = _once(lambda: qm["x"] @ cm["x"].T)
    yy = _once(lambda: qm["y"] @ cm["y"].T)
    cos_w = _once(lambda: (xx() + yy()) / (qm["nw"][:, None] * cm["nw"][None, :]))
    cos_x = _once(lambda: xx() / (qm["nx"][:, None] * cm["nx"][None, :]))
    cos_y = _once(lambda: yy() / (qm["ny"][:, None] * cm["ny"][None, :]))
    qm["_products"] = (xx, yy)
    return {
        "near_w": cos_w,                       # K1: nearest by cosine of the whole vector
        "near_x": cos_x,                       # K2: nearest by cosine of x
        "near_y": cos_y,                       # K3: nearest by cosine of y
        "far_y": lambda: -cos_y(),             # K4: farthest by cosine of y
        "context": lambda: xx() - yy(),        # K5: w_i . Q . w_j
        "dot_w": lambda: xx() + yy(),          # K6: w_i . w_j
        "dot_x": xx,                           # K7: x_i . x_j
        "dot_y": lambda: -yy(),                # K8: -(y_i . y_j)
    }


def _neighbor_extras(qm: dict, cm: dict) -> dict:
    """The three cosines of selected pairs only, from the products of the whole slice."""
    xx, yy = qm["_products"]
    return {"cos_w": lambda r, c: (xx()[r, c] + yy()[r, c]) / (qm["nw"][r] * cm["nw"][c]),
            "cos_x": lambda r, c: xx()[r, c] / (qm["nx"][r] * cm["nx"][c]),
            "cos_y": lambda r, c: yy()[r, c] / (qm["ny"][r] * cm["ny"][c])}


NEIGHBOR_KERNEL = Kernel(q_cols=("vec",), c_cols=("vec",),
                         prepare_q=lambda m: _split(m["vec"]), prepare_c=lambda m: _split(m["vec"]),
                         scores=_neighbor_scores, extras=_neighbor_extras,
                         extra_names=("cos_w", "cos_x", "cos_y"))
# For callers that ask for ranks and scores alone.
RANKS_KERNEL = replace(NEIGHBOR_KERNEL, extras=None, extra_names=())

NEIGHBOR_PANELS = ("near_w", "near_x", "near_y", "far_y", "context", "dot_w", "dot_x", "dot_y")
# The seven panels of the side-by-side report (dot_w is computed by the reference but not shown).
REPORT_PANELS = ("near_w", "near_x", "near_y", "far_y", "context", "dot_x", "dot_y")


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.maximum(np.einsum("ij,ij->i", m, m), NORM_EPS))
    return m / n[:, None]


def _analogy_prepare_q(m: dict) -> dict:
    a, b, c = m["va"], m["vb"], m["vc"]
    out = {}
    for kind, sl in (("w", slice(None)), ("x", slice(1, None, 2)), ("y", slice(0, None, 2))):
        out["a" + kind], out["b" + kind], out["c" + kind] = _unit(a[:, sl]), _unit(b[:, sl]), _unit(c[:, sl])
    return out


def _analogy_prepare_c(m: dict) -> dict:
    w = m["vec"]
    return {"uw": _unit(w), "ux": _unit(w[:, 1::2]), "uy": _unit(w[:, 0::2])}


def _excluded(qm: dict, cm: dict) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the question words; candidates are in the order of their ids, which may repeat."""
    rows, cols = [], []
    for own in (qm[x] for x in "abc"):
        first, last = (np.searchsorted(cm["_id"], own, side=x) for x in ("left", "right"))
        rows.append(np.repeat(np.arange(len(own)), last - first))
        cols.append(np.arange(len(rows[-1])) - np.repeat(np.cumsum(last - first) - last, last - first))
    return np.concatenate(rows), np.concatenate(cols)


def _additive(qm: dict, cm: dict, kind: str) -> np.ndarray:
    """Target ``u_c + (u_b - u_a)`` on unit vectors, not re-normalised, against unit candidates."""
    target = qm["c" + kind] + (qm["b" + kind] - qm["a" + kind])
    return target @ cm["u" + kind].T


# Fixed value: denominator offset of the multiplicative objective.
MUL_EPS = 0.001


def _multiplicative(qm: dict, cm: dict, kind: str) -> np.ndarray:
    """``cos'(b,v) cos'(c,v) / (cos'(a,v) + eps)`` with cosines shifted to [0, 1]."""
    u, found = cm["u" + kind].T, []
    for x in "abc":
        p = qm[x + kind] @ u
        p += 1.0
        p /= 2.0
        found.append(p)
    pa, pb, pc = found
    pb *= pc
    pa += MUL_EPS
    pb /= pa
    return pb


def _analogy_scores(qm: dict, cm: dict) -> dict:
    sw, sx, sy = (_once(lambda k=k: _additive(qm, cm, k)) for k in "wxy")
    return {"near_w": sw, "near_x": sx, "near_y": sy,
            "far_w": lambda: -sw(), "far_x": lambda: -sx(), "far_y": lambda: -sy()}


def _eval_scores(qm: dict, cm: dict) -> dict:
    """Additive and multiplicative objectives, question words excluded."""
    out, at = _once(lambda: _excluded(qm, cm)), {}

    def without(score):
        score[out()] = -np.inf
        return score
    for k in "wxy":
        at["add_" + k] = lambda k=k: without(_additive(qm, cm, k))
        at["mul_" + k] = lambda k=k: without(_multiplicative(qm, cm, k))
    return at


ANALOGY_KERNEL = Kernel(q_cols=("va", "vb", "vc"), c_cols=("vec",), prepare_q=_analogy_prepare_q,
                        prepare_c=_analogy_prepare_c, scores=_analogy_scores)
ANALOGY_PANELS = ("near_w", "near_x", "near_y", "far_w", "far_x", "far_y")
ANALOGY_EVAL_KERNEL = Kernel(q_cols=("va", "vb", "vc"), c_cols=("vec",), prepare_q=_analogy_prepare_q,
                             prepare_c=_analogy_prepare_c, scores=_eval_scores, q_scalars=("a", "b", "c"))
ANALOGY_EVAL_PANELS = ("add_w", "add_x", "add_y", "mul_w", "mul_x", "mul_y")
