"""Words and word windows of whole texts as 64-bit hashes, and blocks of documents (NumPy inside tasks).

A word is a maximal run of bytes other than ASCII blanks; its hash is a polynomial in the values of its bytes, drawn
from a fixed random table, and then mixed. A window's hash is a polynomial of its words' hashes, mixed again. All
arithmetic is modulo 2**64, so both come from running sums without a loop over words.

A block is a run of documents that travel together, zstd-compressed in one row. Requests that a block sends to shards
and the answers to them carry the block's id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinvec.llm.workers import lean, per_process
from twinvec.session import checkpoint

#: Most text and rows of a block (one longer text is a block by itself), a stretch hashed at once, and rows of a batch.
BLOCK_BYTES, BLOCK_ROWS, STRETCH, BATCH_ROWS = 4 << 20, 4096, 1 << 17, 1000
NO_ID = -(1 << 63)


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` for i up to n at least, kept for later calls."""
    key = ("powers", base, max(n, STRETCH).bit_length())

    def build():
        size = (1 << key[2]) + 1
        up, down = np.full(size, base, dtype=np.uint64), np.full(size, pow(base, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)
    return per_process(key, build)


def _tables():
    rng = np.random.default_rng(20240601)
    values = rng.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    lower = values.copy()
    lower[65:91] = values[97:123]
    blank = np.zeros(256, dtype=bool)
    blank[[32, 9, 10, 11, 12, 13]] = True
    return values, lower, blank


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def words(data: np.ndarray, ends: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in ``data`` (bytes of texts laid end to end; ``ends``: where each text ends), and how many
    words each text has. ``lower``: A-Z count as a-z."""
    values, lowered, blank = per_process("byte tables", _tables)
    values = lowered if lower else values
    solid = ~blank[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cuts = ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(data))]
    first[cuts] = solid[cuts]
    last[cuts - 1] = solid[cuts - 1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):  # stretches bound the memory of very long texts
        to = max(at + 1, int(np.searchsorted(stop, start[at] + STRETCH, side="right")))
        lo, hi = start[at], stop[to - 1]
        up, down = _powers(int(hi - lo), 0x9E3779B97F4A7C15)
        run = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(values[data[lo:hi]] * up[:hi - lo], out=run[1:])
        out[at:to] = (run[stop[at:to] - lo] - run[start[at:to] - lo]) * down[start[at:to] - lo]
        at = to
    counts = np.diff(np.searchsorted(start, np.concatenate([[0], ends])))
    return mix(out), counts


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive words (over the borders of texts too)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.empty(n, dtype=np.uint64)
    for at in range(0, n, STRETCH):
        part = hashes[at:at + STRETCH + k - 1]
        up, down = _powers(len(part), 0xC2B2AE3D27D4EB4F)
        run = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * up[:len(part)], out=run[1:])
        out[at:at + STRETCH] = (run[k:] - run[:-k]) * down[:len(part) - k + 1]
    return mix(out)


def inside(counts: np.ndarray, k: int) -> np.ndarray:
    """Starts of the windows of k words that lie in one text, in order."""
    total, ends = int(counts.sum()), np.cumsum(counts)
    good = np.ones(max(0, total - k + 1), dtype=bool)
    for j in range(1, k):
        at = ends[:-1] - j
        good[at[(at >= 0) & (at < len(good))]] = False
    return np.flatnonzero(good)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array laid end to end, and where each text ends."""
    texts = texts.cast(pa.large_binary()).fill_null(b"") if texts.null_count else texts.cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[at[0]:at[-1]] if data is not None else np.empty(0, dtype=np.uint8)
    return data, at[1:] - at[0]


def gathered(batches, most: int):
    """Batches of up to ``most`` bytes of text and ``BLOCK_ROWS`` rows, put together from smaller ones; a larger one stays as it is."""
    held, size = [], 0
    for b in batches:
        own = int(flat(b["text"])[1][-1]) if len(b) else 0
        if held and (size + own > most or sum(map(len, held)) + len(b) > BLOCK_ROWS):
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(b)
        size += own
    if held:
        yield pa.concat_batches(held)


def pack_blocks(docs: DataFrame, columns: list[str], level: int = 3, most: int = BLOCK_BYTES, full: bool = False) -> DataFrame:
    """``block, docs, size``: rows of ``docs`` (``columns``, with ``text``) in compressed blocks, as a stored table.

    Stored, since requests and answers must see the same blocks even if an executor is lost in between. ``full``: blocks reach over the
    batches that come from Spark, so that they are as large as ``most`` and ``BLOCK_ROWS`` allow; the fewer ask for the same thing.
    """
    def run(batches):
        import zstandard
        from pyspark import TaskContext

        lean()
        squeeze, block = zstandard.ZstdCompressor(level=level), TaskContext.get().partitionId() << 32
        for b in gathered(batches, most) if full else batches:
            size = np.cumsum(np.diff(np.concatenate([[0], flat(b["text"])[1]])))
            at = 0
            while at < len(b):
                base = size[at - 1] if at else 0
                to = min(max(at + 1, int(np.searchsorted(size, base + most, side="right"))), at + BLOCK_ROWS, len(b))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema) as w:
                    w.write_batch(b.slice(at, to - at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([squeeze.compress(sink.getvalue())], pa.binary()), pa.array([int(size[to - 1] - base)])],
                    names=["block", "docs", "size"])
                at, block = to, block + 1
    # Fewer rows at a time between Spark and Python than by default, for the time of this job: whole texts are large rows.
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        return checkpoint(docs.select(*columns).mapInArrow(run, "block long, docs binary, size long"))
    finally:
        conf.set(key, before)


def unpack(cell: pa.Scalar) -> pa.RecordBatch:
    import zstandard

    lean()
    data = zstandard.ZstdDecompressor().decompressobj().decompress(cell.as_buffer())
    with pa.ipc.open_stream(data) as r:
        return r.read_next_batch()


def shards_for(blocks: DataFrame, bytes_per_shard: int = 8 << 20) -> int:
    """A power of two, so that requests of a few bytes per word come to a few MB a shard."""
    total = blocks.agg(F.sum("size")).first()[0] or 0
    return 1 << max(0, int(total // bytes_per_shard)).bit_length()


def ids(batch: pa.RecordBatch, name: str = "doc_id") -> np.ndarray:
    return batch[name].cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
