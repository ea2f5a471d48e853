"""What Python workers keep between tasks."""

from __future__ import annotations


def per_process(key, build):
    """The value of ``build()``, built once in this process and kept for later tasks.

    Functions of this package travel to executors by value, so their own globals do not outlive a task.
    """
    import sys
    import types

    held = sys.modules.setdefault("_twinvec_held", types.ModuleType("_twinvec_held")).__dict__
    if key not in held:
        held[key] = build()
    return held[key]


def one_memo(key, build):
    """:func:`per_process` for a value that fills up with what it has seen: it is kept until a task of another operator calls
    :func:`lean`, so that the next operator does not pay for it."""
    memos = per_process("memos", dict)
    lean(keep=key)
    if key not in memos:
        memos[key] = build()
    return memos[key]


def lean(keep=None) -> None:
    """Make this worker return large arrays to the machine as soon as they are freed, so that idle workers leave their
    executor's memory to Spark. Without effect where the C library has no such setting. Memos other than ``keep`` go."""
    def settle():
        import ctypes

        import pyarrow as pa

        pa.set_memory_pool(pa.system_memory_pool())
        try:
            libc = ctypes.CDLL("libc.so.6")
            for option, value in ((-3, 1 << 18), (-1, 1 << 20), (-8, 2)):  # mmap threshold, trim threshold, arenas
                libc.mallopt(option, value)
        except (OSError, AttributeError):
            pass
        return True
    per_process("lean", settle)
    memos = per_process("memos", dict)
    old = [key for key in memos if key != keep]
    for key in old:
        del memos[key]
    if old:
        import ctypes
        import gc

        gc.collect()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass
