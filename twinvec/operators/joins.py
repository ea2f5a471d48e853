"""Lookup joins against a table keyed by a unique column (vocabulary, embeddings).

A broadcast is used only after the rows and bytes of the small side are counted; beyond the
bounds the join is shuffled with the big side salted, so one hot key (a frequent word can
hold a large share of all tokens) is spread over ``salt`` tasks instead of one.

:func:`lookup_arrays` looks up whole arrays of words where they lie, so that a text becomes numbers before it moves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinvec.session import checkpoint, discard

# Our own bounds: the driver holds a broadcast table several times over (collected, hashed, in blocks), a row with about ROW_BYTES besides its strings.
MAX_BROADCAST_ROWS, MAX_BROADCAST_BYTES, ROW_BYTES = 2_000_000, 64 << 20, 48


def lookup_join(big: DataFrame, small: DataFrame, key: str | list[str], how: str = "left",
                max_broadcast_rows: int = MAX_BROADCAST_ROWS, salt: int = 32,
                small_rows: int | None = None) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    if small_rows is None:
        texts = [F.octet_length(f.name) for f in small.schema.fields if f.dataType.simpleString() == "string"]
        size = small.agg(F.count(F.lit(1)), *[F.sum(x) for x in texts]).first()
        n, held = size[0], ROW_BYTES * size[0] + sum(x or 0 for x in size[1:])
    else:
        n, held = small_rows, ROW_BYTES * small_rows
    if n <= max_broadcast_rows and held <= MAX_BROADCAST_BYTES:
        return big.join(F.broadcast(small), keys, how)
    # Any salt value finds exactly one copy of its key; a hash of the row comes out the same when a task is repeated.
    big_s = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salt)).cast("int"))
    small_s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return big_s.join(small_s, keys + ["_salt"], how).drop("_salt")


# Our own bound on the words that the driver sends and every task holds for lookup_arrays, arrays of a batch there (whole texts are large rows),
# and words of a block that asks for its ids where the table is larger.
MAX_LOOKUP_BYTES, ARRAYS_AT_ONCE, WORDS_ASKED = 32 << 20, 500, 1 << 20


def lookup_arrays(df: DataFrame, words: str, table: DataFrame, out: str) -> DataFrame:
    """``df`` with its column ``words`` (array of strings, not null) replaced by ``out``: the ``word_id`` of each word by
    ``table(word, word_id)``, null where it has none. If the words of ``table`` are more than :data:`MAX_LOOKUP_BYTES`, by :func:`lookup_blocks`."""
    size = table.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("word")).alias("b")).first()
    if 12 * size["n"] + (size["b"] or 0) > MAX_LOOKUP_BYTES:
        return lookup_blocks(df, words, table, out)
    held = table.select("word", F.col("word_id").cast("long")).toArrow().combine_chunks()
    sent = df.sparkSession.sparkContext.broadcast(held)
    rest = [f for f in df.schema.fields if f.name != words]

    def run(batches):
        # The table is looked up in a batch's distinct words, not they in the table: no task builds a hash table of the whole vocabulary.
        for b in batches:
            lists = b[words]
            own, starts = lists.flatten().dictionary_encode(), lists.offsets
            at = pc.index_in(sent.value["word"].cast(own.dictionary.type), value_set=own.dictionary).combine_chunks()
            rows = pc.indices_nonzero(at.is_valid()).to_numpy()[::-1]  # the first of equal words wins
            id_of, missing = np.zeros(len(own.dictionary), dtype=np.int64), np.ones(len(own.dictionary), dtype=bool)
            places = at.take(pa.array(rows)).to_numpy()
            id_of[places], missing[places] = sent.value["word_id"].combine_chunks().take(pa.array(rows)).to_numpy(), False
            found = pa.array(id_of, mask=missing).take(own.indices)
            kind = pa.list_(pa.int64()) if pa.types.is_list(lists.type) else pa.large_list(pa.int64())
            array = (pa.ListArray if pa.types.is_list(lists.type) else pa.LargeListArray).from_arrays(pc.subtract(starts, starts[0]), found)
            yield pa.RecordBatch.from_arrays([b[f.name] for f in rest] + [array.cast(kind)], names=[f.name for f in rest] + [out])
    return df.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [f"`{out}` array<bigint>"]))


def lookup_blocks(df: DataFrame, words: str, table: DataFrame, out: str) -> DataFrame:
    """:func:`lookup_arrays` by a join, for tables of any size: no word passes the driver and no token is a row.

    Arrays of about :data:`WORDS_ASKED` words make a block, in which each is a number; the stored blocks ask the table for their distinct words, and
    the answers meet the numbers in a cogroup of one block.
    """
    rest = [f for f in df.schema.fields if f.name != words]
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest)

    def number(batches):
        part, count, waiting, held = TaskContext.get().partitionId(), 0, [], 0

        def block():
            t = pa.Table.from_batches(waiting).combine_chunks()
            lists = t[words].combine_chunks()
            own = lists.flatten().dictionary_encode()
            offsets = pc.subtract(lists.offsets, lists.offsets[0]).cast(pa.int32())
            codes = pa.ListArray.from_arrays(offsets, own.indices.cast(pa.int32()))
            # The block's words lie in its first row.
            asked = pa.ListArray.from_arrays(pa.array(np.minimum(np.arange(len(t) + 1), 1) * len(own.dictionary), pa.int32()),
                                             own.dictionary.cast(pa.string()))
            blk = pa.array(np.full(len(t), part << 33 | count))
            # In batches as small as those that came, for whole texts are large rows.
            found = pa.table([*[t[f.name] for f in rest], codes, blk, asked], names=[*[f.name for f in rest], "_codes", "_blk", "_asked"])
            return found.to_batches(max_chunksize=ARRAYS_AT_ONCE)
        for b in batches:
            waiting.append(b)
            held += len(b[words].flatten())
            if held >= WORDS_ASKED:
                yield from block()
                count, waiting, held = count + 1, [], 0
        if sum(map(len, waiting)):
            yield from block()

    def answer(arrays: pa.Table, ids: pa.Table) -> pa.Table:
        id_of, missing = np.zeros(len(ids) + 1, dtype=np.int64), np.ones(len(ids) + 1, dtype=bool)
        known = ids.filter(pc.is_valid(ids["word_id"]))
        at = known["p"].to_numpy()
        id_of[at], missing[at] = known["word_id"].to_numpy(), False
        lists = arrays["_codes"].combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        found = pa.array(id_of, mask=missing).take(lists.flatten())
        column = pa.ListArray.from_arrays(pc.subtract(lists.offsets, lists.offsets[0]), found)
        return pa.table([*[arrays[f.name] for f in rest], column], names=[*[f.name for f in rest], out])
    stored = stored_arrays(df.mapInArrow(number, f"{kinds}_codes array<int>, _blk long, _asked array<string>"))
    asked = stored.where(F.size("_asked") > 0).select("_blk", F.posexplode("_asked").alias("p", "word"))
    ids = table.groupBy("word").agg(F.min(F.col("word_id").cast("long")).alias("word_id"))
    answers = asked.join(ids, "word", "left").select((F.col("_blk") + F.lit(0)).alias("_blk"), F.col("p").cast("long").alias("p"), "word_id")
    back = stored.drop("_asked").groupBy("_blk").cogroup(answers.groupBy("_blk")).applyInArrow(
        lambda arrays, found: answer(arrays, found), f"{kinds}`{out}` array<bigint>")
    back.made_from = stored
    return back


# Runs of equal values that a task may hold.
MOST_RUNS = 1 << 18


def lookup_runs(df: DataFrame, key: str, table: DataFrame, value: str) -> DataFrame | None:
    """``df`` with the ``value`` of its ``key`` in ``table``, both whole numbers, every key with a value. Sent to the tasks are the runs of consecutive
    keys of one value, for a vocabulary ordered by frequency has few frequencies. None if there are more than :data:`MOST_RUNS`, or no runs."""
    by = table.groupBy(F.col(value).alias("v"), F.col(key) == 0).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count(F.lit(1)).alias("n"))
    runs = by.select("first", "last", "n", "v").limit(MOST_RUNS + 1).toArrow().sort_by("first")
    first, last, n, v = (x.to_numpy().astype(np.int64) for x in runs.columns)
    if not 0 < len(runs) <= MOST_RUNS or (last - first + 1 != n).any() or (first[1:] <= last[:-1]).any():
        return None
    sent = df.sparkSession.sparkContext.broadcast((first, v))

    def run(batches):
        first, v = sent.value
        for b in batches:
            found = v[np.maximum(np.searchsorted(first, b[key].to_numpy(), side="right") - 1, 0)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found)], names=[*b.schema.names, value])
    return df.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{value}` long"]))


#: Different strings of :func:`coded` arrays; more stay strings.
MOST_CODES = 127


def coded(df: DataFrame, column: str):
    """``df`` with the strings of the array ``column`` as numbers of one byte, for a shuffle, and a function that gives a number's string
    back. Both leave the strings as they are if there are more than :data:`MOST_CODES` different ones."""
    names = [r[0] for r in df.select(F.explode(F.array_distinct(column)).alias("x")).where("x is not null").distinct().limit(MOST_CODES + 1).collect()]
    if not names or len(names) > MOST_CODES:
        return df, lambda x: x
    names = F.array(*[F.lit(x) for x in sorted(names)])
    return (df.withColumn(column, F.transform(column, lambda x: F.array_position(names, x).cast("tinyint"))),
            lambda x: F.get(names, x.cast("int") - 1))


def stored_arrays(df: DataFrame) -> DataFrame:
    """Stores a table of :func:`lookup_arrays` and deletes the blocks that it was made from. For the time of this job fewer rows go between Spark and Python at a time than by default,
    so that a task holds a few MB of texts however many documents its split has."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(min(int(before), ARRAYS_AT_ONCE) if int(before) > 0 else ARRAYS_AT_ONCE))
    try:
        out = checkpoint(df)
    finally:
        conf.set(key, before)
    if hasattr(df, "made_from"):
        discard(df.made_from)
    return out
