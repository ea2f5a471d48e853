"""Deterministic uniforms that do not depend on partitioning and that SQL can repeat.

u(seed, tag, keys...) = first 32 bits of md5("seed:tag:k1:k2...") / 2^32, in [0, 1).
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def uniform(seed: int, tag: str, *keys: Column | str) -> Column:
    parts = [F.lit(str(seed)), F.lit(tag)] + [F.col(k) if isinstance(k, str) else k for k in keys]
    h = F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8)
    return F.conv(h, 16, 10).cast("long") / F.lit(TWO32)


def uniform_sql(seed: int, tag: str, *key_sql: str) -> str:
    """DuckDB form of :func:`uniform`; ``key_sql`` are SQL expressions."""
    cat = " || ':' || ".join([f"'{seed}'", f"'{tag}'"] + [f"CAST({k} AS VARCHAR)" for k in key_sql])
    return f"(('0x' || substr(md5({cat}), 1, 8))::BIGINT / 4294967296.0)"


def uniforms4(seed: int, tag: str, *keys: Column | str) -> Column:
    """Four uniforms from one md5: ``u(.., block)[r]`` is draw ``4 * block + r`` (the last key is the block)."""
    parts = [F.lit(str(seed)), F.lit(tag)] + [F.col(k) if isinstance(k, str) else k for k in keys]
    h = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.array(*[F.conv(F.substring(h, 1 + 8 * r, 8), 16, 10).cast("long") / F.lit(TWO32) for r in range(4)])


def uniform4_sql(seed: int, tag: str, *key_sql: str, draw_sql: str) -> str:
    """DuckDB form of draw ``draw_sql`` of :func:`uniforms4`."""
    cat = " || ':' || ".join([f"'{seed}'", f"'{tag}'"] + [f"CAST({k} AS VARCHAR)" for k in key_sql]
                             + [f"CAST(({draw_sql}) // 4 AS VARCHAR)"])
    return f"(('0x' || substr(md5({cat}), 1 + 8 * (({draw_sql}) % 4), 8))::BIGINT / 4294967296.0)"


def explode_draws(df: DataFrame, seed: int, tag: str, keys: list[Column | str], start: int, count: int,
                  draw: str = "draw", u: str = "u") -> DataFrame:
    """Rows ``draw`` in ``[start, start + count)`` with their uniform ``u``, one md5 per four draws.

    Exactly ``count`` uniforms are built as one array (the md5 of a block of four is shared by
    its draws through subexpression elimination) and exploded once.
    """
    parts = [F.lit(str(seed)), F.lit(tag)] + [F.col(k) if isinstance(k, str) else k for k in keys]
    hashes = {}
    vals = []
    for d in range(start, start + count):
        b = d // 4
        if b not in hashes:
            hashes[b] = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts + [F.lit(b)]]))
        vals.append(F.conv(F.substring(hashes[b], 1 + 8 * (d % 4), 8), 16, 10).cast("long") / F.lit(TWO32))
    ex = df.select("*", F.posexplode(F.array(*vals)).alias("_ur", u))
    return ex.withColumn(draw, F.col("_ur") + F.lit(start)).drop("_ur")


# Keys that are hashed side by side: the arrays of a step stay in a core's cache.
LANES = 1 << 14
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_SINES = [int(abs(math.sin(i + 1)) * 2 ** 32) for i in range(64)]


def _md5_lanes(before: bytes, keys: np.ndarray, digits: int, after: bytes) -> np.ndarray:
    """md5 of ``before + str(key) + after`` for keys of ``digits`` digits, at most 55 bytes, as four little-endian numbers a key."""
    size = len(before) + digits + len(after)
    fixed = np.frombuffer((before + bytes(digits) + after + b"\x80").ljust(56, b"\0") + (8 * size).to_bytes(8, "little"), dtype="<u4").tolist()
    words: list = list(fixed)
    places = range(len(before) + digits - 1, len(before) - 1, -1)
    for n, at in enumerate(places):
        if n % 9 == 0:  # nine digits fit 32 bits
            above = keys // 10 ** 9
            rest, keys = (keys - above * 10 ** 9).astype(np.uint32), above
        tens = rest // np.uint32(10)
        words[at // 4] = words[at // 4] + ((rest - tens * np.uint32(10) + np.uint32(48)) << np.uint32(8 * (at % 4)))
        rest = tens
    start = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    a, b, c, d = (np.full(len(keys), x, dtype=np.uint32) for x in start)
    t = np.empty_like(a)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=t), np.bitwise_and(t, b, out=t), np.bitwise_xor(t, d, out=t)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=t), np.bitwise_and(t, d, out=t), np.bitwise_xor(t, c, out=t)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=t), np.bitwise_xor(t, d, out=t)
        else:
            g = 7 * i % 16
            np.invert(d, out=t), np.bitwise_or(t, b, out=t), np.bitwise_xor(t, c, out=t)
        np.add(a, t, out=a)
        if isinstance(words[g], int):
            np.add(a, np.uint32((_SINES[i] + words[g]) & 0xFFFFFFFF), out=a)
        else:
            np.add(a, words[g], out=a), np.add(a, np.uint32(_SINES[i]), out=a)
        turn = _TURNS[i // 16][i % 4]
        np.left_shift(a, np.uint32(turn), out=t), np.right_shift(a, np.uint32(32 - turn), out=a)
        np.bitwise_or(a, t, out=a), np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return np.stack([x + np.uint32(s) for x, s in zip((a, b, c, d), start)], axis=1)


def md5_numbers(before: str, keys: np.ndarray, after: str = "") -> np.ndarray:
    """The md5 of ``before + key + after`` as four numbers of 32 bits a key, for many integer keys inside a task."""
    keys, head, tail = np.asarray(keys, dtype=np.int64), before.encode(), after.encode()
    out = np.empty((len(keys), 4), dtype=np.uint32)
    if len(keys) and (int(keys.min()) < 0 or len(head) + len(tail) + len(str(int(keys.max()))) > 55):
        data = b"".join(hashlib.md5(f"{before}{k}{after}".encode()).digest() for k in keys.tolist())
        return np.frombuffer(data, dtype=">u4").reshape(len(keys), 4).astype(np.uint32)
    digits = np.searchsorted(10 ** np.arange(1, 19, dtype=np.int64), keys, side="right") + 1
    for n in np.unique(digits).tolist():
        of_n = np.flatnonzero(digits == n)
        for at in range(0, len(of_n), LANES):
            own = of_n[at:at + LANES]
            out[own] = _md5_lanes(head, keys[own], n, tail)
    return out.byteswap()


def uniforms_of(seed: int, tag: str, epoch: int, keys: np.ndarray) -> np.ndarray:
    """:func:`uniform` with the keys ``epoch, key`` of many keys inside a task."""
    return md5_numbers(f"{seed}:{tag}:{epoch}:", keys)[:, 0] / TWO32
