"""Global order without a single-partition window.

Two distributed prefix-sum forms:

* :func:`dense_prefix` for a dense integer key (a global position): rows are grouped into
  fixed-width key blocks, so every window partition holds at most ``block`` rows and no
  key value can make one block large; block totals (``n / block`` rows) get their own
  small prefix sum.
* :func:`ordered_prefix` for any total order: a range repartition (sampled boundaries,
  balanced), the partition index is materialised by a reliable checkpoint, partition
  totals (one row per partition, a proven bound) are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinvec.session import checkpoint

# Rows per window partition: Spark keeps up to 4096 rows of a window partition in its in-memory
# buffer (spark.sql.windowExec.buffer.in.memory.threshold), so blocks stay at that size.
DEFAULT_BLOCK = 4096
# Blocks per super-block in the second level; the top level then has n / (block * fanout) rows.
DEFAULT_FANOUT = 4096
UNB = Window.unboundedPreceding


def block_offsets(totals: DataFrame, names: list[str], fanout: int = DEFAULT_FANOUT) -> DataFrame:
    """Exclusive prefix sums over ``totals(_blk, _t_<name>...)`` in ``_blk`` order: ``(_blk, _o_<name>...)``.

    Two levels: windows per super-block of ``fanout`` blocks, then one small window over
    super-blocks, so no window partition grows with the data.
    """
    t = totals.withColumn("_sup", (F.col("_blk") / F.lit(fanout)).cast("long"))
    w = Window.partitionBy("_sup").orderBy("_blk")
    t2 = t.select("_blk", "_sup",
                  *[F.coalesce(F.sum(f"_t_{n}").over(w.rowsBetween(UNB, -1)), F.lit(0)).alias(f"_lo_{n}") for n in names],
                  *[F.sum(f"_t_{n}").over(w.rowsBetween(UNB, Window.unboundedFollowing)).alias(f"_st_{n}") for n in names])
    sup = t2.groupBy("_sup").agg(*[F.max(f"_st_{n}").alias(f"_st_{n}") for n in names])
    top = Window.orderBy("_sup").rowsBetween(UNB, -1)
    sup_off = sup.select("_sup", *[F.coalesce(F.sum(f"_st_{n}").over(top), F.lit(0)).alias(f"_so_{n}") for n in names])
    return t2.join(sup_off, "_sup").select("_blk", *[(F.col(f"_so_{n}") + F.col(f"_lo_{n}")).alias(f"_o_{n}")
                                                     for n in names])


def windowed_prefix(df: DataFrame, order: str, weights: dict[str, Column], fanout: int = DEFAULT_FANOUT) -> DataFrame:
    """Prefix sums for a frame that already has a block column ``_blk`` (blocks ordered like ``order``).

    The running sum inside a block is one window (the only shuffle of the rows); block totals
    are a plain aggregation of the input, combined map-side, so they shuffle one row per
    block and task. (Reading the totals back from the window output would make the optimizer
    prune each branch differently and shuffle the rows again.)
    """
    tmp = df
    for name, w in weights.items():
        tmp = tmp.withColumn(f"_w_{name}", w)
    w_in = Window.partitionBy("_blk").orderBy(order).rowsBetween(UNB, -1)
    local = tmp.select("*", *[F.coalesce(F.sum(f"_w_{n}").over(w_in), F.lit(0)).alias(f"_l_{n}") for n in weights])
    totals = tmp.groupBy("_blk").agg(*[F.sum(f"_w_{n}").alias(f"_t_{n}") for n in weights])
    offsets = block_offsets(totals, list(weights), fanout)
    joined = local.join(offsets, "_blk")
    return joined.select(*df.columns, *[(F.col(f"_o_{n}") + F.col(f"_l_{n}")).alias(n) for n in weights])


def dense_prefix(df: DataFrame, key: str, weights: dict[str, Column | str], block: int = DEFAULT_BLOCK,
                 fanout: int = DEFAULT_FANOUT) -> DataFrame:
    """Add exclusive prefix sums ``sum(weight) over rows with a smaller key`` for each output name.

    ``key`` must be a non-negative integer column whose values are unique and roughly dense
    (e.g. a corpus position): a block then holds at most ``block`` rows whatever the data.
    """
    wcols = {name: (F.col(w) if isinstance(w, str) else w) for name, w in weights.items()}
    tmp = df.withColumn("_blk", F.floor(F.col(key) / F.lit(block)).cast("long"))
    out = windowed_prefix(tmp, key, wcols, fanout)
    return out.select(*df.columns, *wcols)


def ordered_prefix(df: DataFrame, order: list[Column], weights: dict[str, Column | str],
                   n_parts: int | None = None) -> DataFrame:
    """Exclusive prefix sums of ``weights`` in the total order ``order`` (must be unique).

    Cost: one range shuffle, one checkpoint write, one shuffle by partition index.
    """
    spark = df.sparkSession
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    wcols = {name: (F.col(w) if isinstance(w, str) else w) for name, w in weights.items()}
    tmp = df
    for name, w in wcols.items():
        tmp = tmp.withColumn(f"_w_{name}", w)
    ranged = checkpoint(tmp.repartitionByRange(n, *order).withColumn("_pp", F.spark_partition_id()))
    totals = ranged.groupBy("_pp").agg(*[F.sum(f"_w_{k}").alias(f"_t_{k}") for k in wcols])
    before = Window.orderBy("_pp").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pp", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}")
                                     for k in wcols])
    inside = Window.partitionBy("_pp").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # offsets has one row per range partition: bounded by n, safe to broadcast.
    joined = ranged.join(F.broadcast(offsets), "_pp")
    return joined.select(*df.columns, *[(F.col(f"_o_{k}") + F.coalesce(F.sum(f"_w_{k}").over(inside), F.lit(0)))
                                        .alias(k) for k in wcols])


def key_prefix(df: DataFrame, key: str, weights: dict[str, Column | str], block: int = DEFAULT_BLOCK,
               fanout: int = DEFAULT_FANOUT, max_top_rows: int = 1_000_000) -> DataFrame:
    """Exclusive prefix sums in the order of a unique integer ``key`` (e.g. a document id).

    One cheap aggregate reads the key range. Blocks of ``block`` consecutive key values hold
    at most ``block`` rows whatever the distribution, so :func:`dense_prefix` is used when
    the range keeps the top level small; very sparse keys (hashes) take :func:`ordered_prefix`.
    """
    st = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    if st["lo"] is None:
        return df.select("*", *[F.lit(0).cast("long").alias(n) for n in weights])
    lo, hi = int(st["lo"]), int(st["hi"])
    if (hi - lo + 1) // (block * fanout) <= max_top_rows:
        shifted = df.withColumn("_key0", F.col(key) - F.lit(lo))
        return dense_prefix(shifted, "_key0", weights, block, fanout).drop("_key0")
    return ordered_prefix(df, [F.col(key).asc()], weights)


def row_number_global(df: DataFrame, order: list[Column], name: str, start: int = 1,
                      n_parts: int | None = None) -> DataFrame:
    """Global 1-based (or ``start``-based) row number in a unique total order, distributed."""
    out = ordered_prefix(df, order, {name: F.lit(1).cast("long")}, n_parts=n_parts)
    return out.withColumn(name, F.col(name) + F.lit(start))


def next_value(df: DataFrame, key: str, value: str, out: str, block: int = DEFAULT_BLOCK, top_rows: int = DEFAULT_BLOCK) -> DataFrame:
    """``df`` with ``out``: the ``value`` of the row with the next larger integer ``key`` (unique), null for the last.

    Inside a block of consecutive keys it is ``lead``; a block's last row takes the first value of the next block that has rows, from a
    table of one row a block, found in the same way. A window partition has at most ``block`` rows, the last one ``top_rows``.
    """
    st = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()  # two scalars
    if st["lo"] is None or int(st["hi"]) - int(st["lo"]) < top_rows:
        return df.select("*", F.lead(value).over(Window.orderBy(key)).alias(out))
    nb = f"_n{key}"  # another name on each level, where the key is the block's number of the level below
    blk = F.floor(F.col(key) / F.lit(block)).cast("long")
    w = Window.partitionBy(nb).orderBy(key)
    local = df.withColumn(nb, blk).select("*", F.lead(value).over(w).alias("_nv"), F.lead(key).over(w).isNull().alias("_nl"))
    firsts = df.groupBy(blk.alias(nb)).agg(F.min_by(value, key).alias("_nf"))
    borders = next_value(firsts, nb, "_nf", "_after", block, top_rows).select(nb, "_after")
    return local.join(borders, nb).select(*df.columns, F.when(F.col("_nl"), F.col("_after")).otherwise(F.col("_nv")).alias(out))
