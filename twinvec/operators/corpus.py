"""Corpus job: tokens -> vocabulary -> encoded corpus -> subsample -> sentences -> skip-gram pairs.

Tables (all DataFrames):

* ``tokens(g, word)``: global position ``g`` (0-based, corpus order) and token text.
* ``vocab(word_id, word, freq)``: id 0 is ``UNK`` carrying the mass of rare words; ids 1..
  by frequency descending, ties by word (the reference leaves ties unordered).
* ``encoded(g, word_id, freq)``: every token with its id (0 when rare) and that id's count.
* ``kept(k, g, word_id)``: tokens surviving subsampling, ``k`` their rank among kept tokens.
* ``sentences(sid, i, word_id)``: ``sid = k div 1000``, ``i = k mod 1000``.
* ``pairs(sid, i, j, input_id, label_id)``.
"""

from __future__ import annotations

from functools import partial, reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinvec.functions.rand import uniform, uniforms_of
from twinvec.functions.text import split_tokens
from twinvec.operators.joins import MAX_BROADCAST_BYTES, ROW_BYTES, lookup_arrays, lookup_join, lookup_runs, stored_arrays
from twinvec.operators.ordering import block_offsets, dense_prefix, key_prefix, ordered_prefix, row_number_global
from twinvec.params import Word2VecParams
from twinvec.session import checkpoint, discard

UNK = "UNK"


def documents_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents in ``id_col`` order become one token stream; returns ``tokens(g, word)``.

    Positions: per-document token counts get a distributed exclusive prefix sum (document
    level, far smaller than the text), joined back before the explode.
    """
    per_doc = docs.select(F.col(id_col).alias("_doc"), F.size(split_tokens(text_col)).cast("long").alias("_n"))
    offsets = key_prefix(per_doc, "_doc", {"_off": F.col("_n")}).select("_doc", "_off")
    with_off = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).join(offsets, "_doc")
    exploded = with_off.select("_off", F.posexplode(split_tokens("_text")).alias("_pos", "word"))
    return exploded.select((F.col("_off") + F.col("_pos")).alias("g"), "word")


def text_word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """A1 straight from the texts: counting needs no positions, so no text is shuffled."""
    return word_counts(docs.select(F.explode(split_tokens(text_col)).alias("word")))


def ordered_tokens(df: DataFrame, order: list[str], text_col: str = "text") -> DataFrame:
    """Like :func:`documents_tokens` for a composite order key (e.g. conversations by conv_id, turn)."""
    keyed = df.select(*[F.col(c) for c in order], F.col(text_col).alias("_text"))
    per = keyed.select(*order, F.size(split_tokens("_text")).cast("long").alias("_n"))
    offsets = ordered_prefix(per, [F.col(c).asc() for c in order], {"_off": F.col("_n")}).select(*order, "_off")
    with_off = keyed.join(offsets, order)
    exploded = with_off.select("_off", F.posexplode(split_tokens("_text")).alias("_pos", "word"))
    return exploded.select((F.col("_off") + F.col("_pos")).alias("g"), "word")


def word_counts(tokens: DataFrame) -> DataFrame:
    """A1: ``(word, freq)``; partial aggregation happens map-side."""
    return tokens.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def build_vocab(tokens: DataFrame, min_count: int = 5, counts: DataFrame | None = None) -> DataFrame:
    """``vocab(word_id, word, freq)`` materialised by a checkpoint."""
    # Distinct words are far fewer than tokens: materialise them once so the range sampling,
    # the ranking and the UNK mass do not each re-tokenize the corpus.
    counts = checkpoint(counts if counts is not None else word_counts(tokens))
    frequent = counts.where(F.col("freq") >= min_count)
    ranked = row_number_global(frequent, [F.col("freq").desc(), F.col("word").asc()], "word_id")
    unk = counts.agg(F.coalesce(F.sum(F.when(F.col("freq") < min_count, F.col("freq"))), F.lit(0))
                     .cast("long").alias("freq"))
    unk_row = unk.select(F.lit(0).cast("long").alias("word_id"), F.lit(UNK).alias("word"), "freq")
    vocab = ranked.select(F.col("word_id").cast("long"), "word", F.col("freq").cast("long")).unionByName(unk_row)
    return checkpoint(vocab)


def corpus_stats(docs_text: DataFrame, min_count: int = 5, text_col: str = "text") -> DataFrame:
    """A2: bytes, tokens, distinct words, frequent words, vocabulary size (with UNK), words per epoch."""
    counts = text_word_counts(docs_text, text_col)
    by_word = counts.agg(F.sum("freq").cast("long").alias("tokens"), F.count(F.lit(1)).alias("distinct_words"),
                         F.count(F.when(F.col("freq") >= min_count, 1)).alias("frequent_words"))
    nbytes = docs_text.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).cast("long").alias("bytes"))
    # Both sides are single-row aggregates; the join key makes the pairing explicit.
    out = nbytes.withColumn("_k", F.lit(1)).join(by_word.withColumn("_k", F.lit(1)), "_k")
    return out.select("bytes", "tokens", "distinct_words", "frequent_words",
                      (F.col("frequent_words") + 1).alias("vocab_size"), F.col("tokens").alias("words_per_epoch"))


def check_enough_data(n_tokens: int, window: int) -> None:
    """A corpus of fewer than 10 x window tokens is refused."""
    if n_tokens < 10 * window:
        raise ValueError(f"{n_tokens} tokens are not enough for windows of {window}: at least {10 * window} are needed")


def encode(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """``encoded(g, word_id, freq)``; rare or unknown words map to 0 with the UNK mass.

    Only the ranked words (id >= 1) are looked up, so a literal ``UNK`` token that is frequent
    keeps its own id while rare words still land on id 0.
    """
    ranked = vocab.where(F.col("word_id") >= 1).select("word", "word_id", "freq")
    unk = vocab.where(F.col("word_id") == 0).select(F.col("freq").alias("_unk_freq"))
    unk_freq = unk.first()["_unk_freq"]  # one scalar
    joined = lookup_join(tokens, ranked, "word")
    return joined.select("g", F.coalesce("word_id", F.lit(0)).cast("long").alias("word_id"),
                         F.coalesce("freq", F.lit(int(unk_freq))).cast("long").alias("freq"))


def encode_documents(docs: DataFrame, vocab: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored ``encoded(g, word_id, freq)`` of documents in ``id_col`` order (unique integers).

    Each text becomes an array of ids where it lies; only these arrays meet the documents' offsets. A vocabulary that the driver can't
    send is asked by blocks of texts, and the counts of its ids are then sent as runs. :func:`encode` gives the same rows.
    """
    ranked = vocab.where(F.col("word_id") >= 1).select("word", "word_id")
    arrays = lookup_arrays(docs.select(F.col(id_col).alias("_doc"), split_tokens(text_col).alias("_w")), "_w", ranked, "ids")
    arrays = stored_arrays(arrays)
    offsets = key_prefix(arrays.select("_doc", F.size("ids").cast("long").alias("_n")), "_doc", {"_off": F.col("_n")}).select("_doc", "_off")
    narrow = arrays.select("_doc", F.col("ids").cast("array<int>").alias("ids"))  # half the bytes to shuffle
    ids = narrow.join(offsets, "_doc").select("_off", F.posexplode("ids").alias("_pos", "word_id"))
    ids = ids.select((F.col("_off") + F.col("_pos")).alias("g"), F.coalesce("word_id", F.lit(0)).cast("long").alias("word_id"))
    counts, n = vocab.select("word_id", "freq"), vocab.count()
    with_counts = lookup_runs(ids, "word_id", counts, "freq") if n * ROW_BYTES > MAX_BROADCAST_BYTES else None
    out = checkpoint((lookup_join(ids, counts, "word_id", small_rows=n) if with_counts is None else with_counts).select("g", "word_id", "freq"))
    discard(arrays)
    return out


def keep_probability(freq: Column, total_tokens: int, threshold: float) -> Column:
    """P5: ``(sqrt(f/(tN)) + 1) * tN / f`` (may exceed 1)."""
    tn = F.lit(float(threshold) * float(total_tokens))
    f = freq.cast("double")
    return (F.sqrt(f / tn) + F.lit(1.0)) * tn / f


def subsample(encoded: DataFrame, total_tokens: int, params: Word2VecParams, epoch: int = 0) -> DataFrame:
    """Keep a token when ``u(seed, 'sub', epoch, g) <= p``; ``subsample <= 0`` keeps all. ``u`` is below 1, so it is only drawn where
    ``p`` is: for the few most frequent words."""
    if params.subsample <= 0:
        return encoded
    p = keep_probability(F.col("freq"), total_tokens, params.subsample)
    return encoded.where((p >= 1) | (uniform(params.seed, "sub", F.lit(epoch), F.col("g")) <= p))


def kept_positions(kept: DataFrame, block: int | None = None) -> DataFrame:
    """W2 (first half): ``k`` = 0-based rank of each kept token in corpus order."""
    kw = {} if block is None else {"block": block}
    return dense_prefix(kept, "g", {"k": F.lit(1).cast("long")}, **kw)


def sentences(kept_k: DataFrame, sentence_size: int = 1000) -> DataFrame:
    """``sid = k div size``, ``i = k mod size``. Sentences run across document ends."""
    return kept_k.select((F.col("k") / F.lit(sentence_size)).cast("long").alias("sid"),
                         (F.col("k") % F.lit(sentence_size)).cast("int").alias("i"), "k", "word_id")


def centres(kept_k: DataFrame, window: int, dynamic: bool = True, seed: int = 42, epoch: int = 0,
            sentence_size: int = 1000, n_kept: int | None = None) -> DataFrame:
    """One row per kept token with its ``2 * window`` neighbour slots.

    Centre ``i`` has width ``s`` (``1 + floor(u * window)`` when dynamic, else ``window``) and
    labels ``j`` in ``[max(0, i-s), min(size, i+s+1))``, ``j != i``, in ascending ``j``. The
    neighbours come from ``lag``/``lead`` over the sentence (the window partition, at most
    ``sentence_size`` rows whatever the data); the same partitioning serves the stream
    numbering, so pairs are shuffled once. No join, no range join.

    ``nb`` is ``array<struct<off, label, p>>`` with ``label`` NULL for a slot outside the
    sentence or the width and ``p`` the index of the pair among the centre's valid labels;
    ``n`` counts the valid labels. Only scalar expressions are used (no higher-order
    function), which keeps the projection inside whole-stage code generation. When the number
    of kept tokens ``n_kept`` is given, ``n`` is computed in closed form,
    ``min(i, s) + min(L - 1 - i, s)`` with ``L`` the sentence length, so totals over ``n``
    need no window.
    """
    sid = (F.col("k") / F.lit(sentence_size)).cast("long")
    base = kept_k.select(sid.alias("_blk"), sid.alias("sid"), (F.col("k") % F.lit(sentence_size)).cast("int").alias("i"),
                         "k", "word_id")
    w = Window.partitionBy("_blk").orderBy("k")
    width = (F.lit(1) + F.floor(uniform(seed, "win", F.lit(epoch), F.col("k")) * F.lit(window))).cast("int") \
        if dynamic else F.lit(window)
    offs = list(range(-window, 0)) + list(range(1, window + 1))
    same = lambda o: ((F.col("k") + F.lit(o)) / F.lit(sentence_size)).cast("long") == F.col("sid")
    keep = lambda o: same(o) & (F.lit(abs(o)) <= F.col("_s"))
    with_s = base.withColumn("_s", width)
    lab = {o: F.when(keep(o), (F.lag if o < 0 else F.lead)("word_id", abs(o)).over(w)) for o in offs}
    win = with_s.select("_blk", "sid", "i", "k", "word_id", "_s",
                        *[lab[o].alias(f"_l{n}") for n, o in enumerate(offs)])
    ind = [F.col(f"_l{n}").isNotNull().cast("int") for n in range(len(offs))]
    before = [F.lit(0)]
    for n in range(1, len(offs)):
        before.append(before[-1] + ind[n - 1])
    slots = [F.struct(F.lit(o).alias("off"), F.col(f"_l{n}").alias("label"), before[n].alias("p"))
             for n, o in enumerate(offs)]
    if n_kept is None:
        total = before[-1] + ind[-1]
    else:
        length = F.least(F.lit(sentence_size).cast("long"), F.lit(n_kept) - F.col("sid") * F.lit(sentence_size))
        total = F.least(F.col("i"), F.col("_s")) + F.least(length - 1 - F.col("i"), F.col("_s"))
    return win.select("_blk", "sid", "i", "k", F.col("word_id").alias("input_id"), total.cast("long").alias("n"),
                      F.array(*slots).alias("nb"))


def _explode_centres(cen: DataFrame, extra: list[str] = ()) -> DataFrame:
    # inline_outer: the optimizer infers no size(nb) > 0 filter, which would rebuild the array.
    ex = cen.select("sid", "i", "k", "input_id", *extra, F.inline_outer("nb")).where(F.col("label").isNotNull())
    return ex.select("sid", "i", (F.col("i") + F.col("off")).alias("j"), "k", "p", "input_id",
                     F.col("label").alias("label_id"), *extra)


def pairs(kept_k: DataFrame, window: int, dynamic: bool = True, seed: int = 42, epoch: int = 0,
          sentence_size: int = 1000) -> DataFrame:
    """Skip-gram pairs ``(sid, i, j, k, p, input_id, label_id)`` of one epoch."""
    return _explode_centres(centres(kept_k, window, dynamic, seed, epoch, sentence_size))


# Sentences whose pairs a task makes at a time.
SENTENCES_AT_ONCE = 16
PAIR_COLUMNS = {"sid": "long", "i": "int", "j": "int", "k": "long", "p": "int", "input_id": "long", "label_id": "long", "pair_idx": "long",
                "batch_id": "long"}


def _widths(k: np.ndarray, window: int, dynamic: bool, seed: int, epoch: int) -> np.ndarray:
    """``1 + floor(u * window)`` of each centre when dynamic, else ``window``."""
    return 1 + np.floor(uniforms_of(seed, "win", epoch, k) * window).astype(np.int64) if dynamic else np.full(len(k), window)


def _pair_totals(kept_k: DataFrame, window: int, dynamic: bool, seed: int, epoch: int, sentence_size: int) -> DataFrame:
    """``(_blk, _t_start)``: the number of pairs of each block of :data:`SENTENCES_AT_ONCE` sentences. A centre at place ``i`` of a sentence of
    ``L`` words and width ``s`` has ``min(i, s) + min(L - 1 - i, s)`` labels, so the number of kept tokens is all that is read."""
    spark, n_kept, size = kept_k.sparkSession, kept_k.count(), SENTENCES_AT_ONCE * sentence_size

    def count(batches):
        for b in batches:
            totals = []
            for blk in b["id"].to_pylist():
                k = np.arange(blk * size, min(n_kept, (blk + 1) * size))
                i, s = k % sentence_size, _widths(k, window, dynamic, seed, epoch)
                length = np.minimum(sentence_size, n_kept - (k - i))
                totals.append(int((np.minimum(i, s) + np.minimum(length - 1 - i, s)).sum()))
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(totals, pa.int64())], names=["_blk", "_t_start"])
    return spark.range(-(-n_kept // size)).mapInArrow(count, "_blk long, _t_start long")


def _offsets(window: int) -> np.ndarray:
    return np.concatenate([np.arange(-window, 0), np.arange(1, window + 1)])


def _slots(k: np.ndarray, window: int, dynamic: bool, seed: int, epoch: int, sentence_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sentence of each kept token, places of its ``2 * window`` neighbours, and which of them are its labels."""
    offs = _offsets(window)
    sid, at = k // sentence_size, np.arange(len(k))[:, None] + offs
    inside = (at >= 0) & (at < len(k)) & (np.abs(offs) <= _widths(k, window, dynamic, seed, epoch)[:, None])
    at = np.where(inside, at, 0)
    inside &= sid[at] == sid[:, None]
    return sid, at, inside


def _make_pairs(blocks: DataFrame, columns: list[str], window: int, dynamic: bool, seed: int, epoch: int, sentence_size: int,
                batch_size: int = 1) -> DataFrame:
    """The pairs of ``blocks(_blk, k, word_id[, _o_start])``, with the ``columns`` named.

    Centre ``i`` of a sentence with width ``s`` has the labels ``j`` in ``[max(0, i-s), min(size, i+s+1))``, ``j != i``, in ascending
    ``j``. A group holds the tokens of :data:`SENTENCES_AT_ONCE` sentences, whatever the data.
    """
    offs = _offsets(window)

    def make(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        k, words = (table[c].to_numpy() for c in ("k", "word_id"))
        sid, at, inside = _slots(k, window, dynamic, seed, epoch, sentence_size)
        c, slot = np.nonzero(inside)
        found = {"sid": lambda: sid[c], "i": lambda: k[c] % sentence_size, "j": lambda: k[c] % sentence_size + offs[slot], "k": lambda: k[c],
                 "p": lambda: np.cumsum(inside, axis=1)[c, slot] - 1, "input_id": lambda: words[c], "label_id": lambda: words[at[c, slot]]}
        if "_o_start" in table.column_names:
            idx = table["_o_start"][0].as_py() + np.arange(len(c)) if len(k) else c
            found |= {"pair_idx": lambda: idx, "batch_id": lambda: idx // batch_size}
        return pa.table({x: pa.array(found[x]().astype(np.int32 if PAIR_COLUMNS[x] == "int" else np.int64)) for x in columns})
    return blocks.groupBy("_blk").applyInArrow(make, ", ".join(f"{x} {PAIR_COLUMNS[x]}" for x in columns))


def _sentence_blocks(kept_k: DataFrame, sentence_size: int, at_once: int | None = None) -> DataFrame:
    return kept_k.select(F.floor(F.col("k") / F.lit((at_once or SENTENCES_AT_ONCE) * sentence_size)).cast("long").alias("_blk"), F.col("k").cast("long"),
                         F.col("word_id").cast("long"))


def pair_stream(kept_k: DataFrame, window: int, batch_size: int = 16, dynamic: bool = True, seed: int = 42,
                epoch: int = 0, sentence_size: int = 1000, columns: list[str] | None = None) -> DataFrame:
    """Pairs numbered in stream order (centre ``k``, then ``j``) with ``batch_id = pair_idx div B``.

    The numbers of pairs in the blocks before a block come from a table of one row a block (its prefix sum has two levels), so the
    kept tokens are shuffled once and pairs not at all.
    """
    starts = block_offsets(_pair_totals(kept_k, window, dynamic, seed, epoch, sentence_size), ["start"])
    blocks = _sentence_blocks(kept_k, sentence_size).join(starts, "_blk")
    return _make_pairs(blocks, columns or list(PAIR_COLUMNS), window, dynamic, seed, epoch, sentence_size, batch_size)


def stream_batches(kept_k: DataFrame, params: Word2VecParams, epoch: int = 0) -> DataFrame:
    """The ``batch_id`` of every batch of the epoch's stream, once each, from the numbers of pairs of the blocks: no pair is made."""
    totals = _pair_totals(kept_k, params.window_size, True, params.seed, epoch, params.sentence_size)
    start, size = F.col("_o_start").cast("long"), F.lit(params.batch_size)
    blocks = totals.join(block_offsets(totals, ["start"]), "_blk").where("_t_start > 0")
    # A batch belongs to the block that has its first pair.
    first, last = F.ceil(start / size).cast("long"), F.floor((start + F.col("_t_start") - 1) / size).cast("long")
    return blocks.select(first.alias("first"), last.alias("last")).where("first <= last").select(F.explode(F.sequence("first", "last")).alias("batch_id"))


# Kept tokens of one packed row at most: the rows that go between Spark and Python at a time are a few MB.
PIECE = 512


def _pieces(kept_k: DataFrame, size: int) -> DataFrame:
    """``(_blk, k0, words)``: the kept tokens as runs of consecutive ``k`` inside blocks of ``size`` tokens, their words as packed numbers of 32
    bits. What lies together in ``kept_k`` travels together, in a fraction of the bytes that a row a token takes."""
    def cut(batches):
        for b in batches:
            k, words = b["k"].to_numpy(), b["word_id"].to_numpy()
            if not len(k):
                continue
            order = np.argsort(k, kind="stable")
            k, words = k[order], words[order]
            if words.min() < -(1 << 31) or words.max() >= 1 << 31:
                raise ValueError("word ids must fit 32 bits")
            blk = k // size
            starts = np.flatnonzero((np.diff(k, prepend=k[0] - 2) != 1) | (np.diff(blk, prepend=-1) != 0))
            own = np.repeat(starts, np.diff(starts, append=len(k)))
            starts = np.flatnonzero((np.arange(len(k)) - own) % PIECE == 0)
            ends, data = 4 * np.append(starts, len(k)).astype(np.int32), pa.py_buffer(words.astype("<i4").tobytes())
            packed = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), data])
            yield pa.RecordBatch.from_arrays([pa.array(blk[starts]), pa.array(k[starts]), packed], names=["_blk", "k0", "words"])
    return kept_k.select(F.col("k").cast("long"), F.col("word_id").cast("long")).mapInArrow(cut, "_blk long, k0 long, words binary")


def _joined(pieces: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """``k`` and words of the pieces of a block."""
    words = [np.frombuffer(w, dtype="<i4").astype(np.int64) for _, w in pieces]
    return np.concatenate([k0 + np.arange(len(w)) for (k0, _), w in zip(pieces, words)]), np.concatenate(words)


def over_pairs(kept_k: DataFrame, task, schema: str, window: int, dynamic: bool = True, seed: int = 42, epoch: int = 0, sentence_size: int = 1000,
               batch_size: int = 1, parts: int | None = None, copies: int = 1, first: DataFrame | None = None) -> DataFrame:
    """The pairs of :func:`pair_stream` handed to ``task`` where they are made, so that no pair is a row, stored or shuffled.

    The sentences are dealt to ``parts`` ranges of blocks (one a core unless given), each to one task, or to ``copies`` tasks that see the same
    pairs. ``task(copy, chunks, given)`` is a generator of record batches of ``schema``; ``chunks`` yields ``(pair_idx, input ids, label ids)``, one
    array each, in stream order and in whole batches of ``batch_size`` pairs (the epoch's last one may be short): a batch that runs over the
    end of a range is finished with the first sentences of the next, which both ranges get. A chunk has the pairs of
    :data:`SENTENCES_AT_ONCE` sentences. ``first(data binary)``: rows that every task gets before its pairs, as the iterator ``given``.
    """
    spark, size = kept_k.sparkSession, SENTENCES_AT_ONCE * sentence_size
    n_blocks = -(-kept_k.count() // size)
    parts = max(1, min(n_blocks, parts or spark.sparkContext.defaultParallelism))
    starts = block_offsets(_pair_totals(kept_k, window, dynamic, seed, epoch, sentence_size), ["start"])
    part = F.floor(F.col("_blk") * F.lit(parts) / F.lit(max(1, n_blocks))).cast("int")
    begins = (F.col("_blk") > 0) & (part > F.floor((F.col("_blk") - 1) * F.lit(parts) / F.lit(max(1, n_blocks))))
    rows = lookup_join(_pieces(kept_k, size), starts.select("_blk", F.col("_o_start").cast("long").alias("start")), "_blk", "inner", small_rows=n_blocks)
    rows = rows.select(F.explode(F.when(begins, F.array(part, part - 1)).otherwise(F.array(part))).alias("part"), F.lit(1).alias("turn"),
                       "_blk", "start", "k0", "words", part.alias("own"))
    if first is not None:
        rows = rows.unionByName(first.select(F.explode(F.lit(list(range(parts)))).alias("part"), F.lit(0).alias("turn"), F.lit(0).cast("long").alias("_blk"),
                                             F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("k0"), F.col("data").alias("words"),
                                             F.lit(-1).alias("own")))
    # Of two partitions at least: Spark would run a union of single partitions in one task.
    rows = rows.repartitionById(max(2, parts), "part").sortWithinPartitions("part", "turn", "_blk", "k0")

    def run(copy: int, batches):
        flat = (r for b in batches for r in zip(*(b[c].to_pylist() for c in ("part", "turn", "_blk", "start", "k0", "words", "own"))))
        for part, own in groupby(flat, lambda r: r[0]):
            yield from one_task(part, copy, own)

    def one_task(part: int, copy: int, own):
        turns, ahead = groupby(own, lambda r: r[1]), []

        def given():
            for turn, some in turns if not ahead else ():
                if turn == 0:
                    yield from (r[5] for r in some)
                    continue
                ahead.append(some)
                return

        def chunks():
            for _ in given():  # what the task has not taken
                pass
            left = None  # pairs of a batch that the next block finishes
            for _, some in groupby(ahead[0] if ahead else (), lambda r: r[2]):
                pieces = list(some)
                start, other = pieces[0][3], pieces[0][6] != part
                k, words = _joined([(r[4], r[5]) for r in pieces])
                _, at, inside = _slots(k, window, dynamic, seed, epoch, sentence_size)
                c, slot = np.nonzero(inside)
                found = [start + np.arange(len(c)), words[c], words[at[c, slot]]]
                if left is None and part:  # the range before this one finishes its last batch
                    found = [x[-start % batch_size:] for x in found]
                if left is not None:
                    need = -start % batch_size
                    found = [np.concatenate([x, y[:need] if other else y]) for x, y in zip(left, found)]
                elif other:
                    break
                whole = len(found[0]) // batch_size * batch_size
                if whole:
                    yield tuple(x[:whole] for x in found)
                left = [x[whole:] for x in found]
            if left is not None and len(left[0]):
                yield tuple(left)
        yield from task(copy, chunks(), given())
    # All copies read one exchange.
    return reduce(DataFrame.unionAll, [rows.mapInArrow(partial(run, copy), schema) for copy in range(copies)])


def over_epoch(kept: DataFrame, params: Word2VecParams, task, schema: str, epoch: int = 0, **kw) -> DataFrame:
    """:func:`over_pairs` with the settings of the epoch's stream (:func:`epoch_stream`)."""
    return over_pairs(kept, task, schema, params.window_size, True, params.seed, epoch, params.sentence_size, **kw)


# Sentences whose pairs are counted together before they travel, and pairs whose counts a task merges at a time.
SENTENCES_COUNTED, PAIRS_MERGED = 128, 1 << 21


def _pack(numbers: np.ndarray) -> bytes:
    """Non-negative numbers by byte planes, compressed: the high bytes of small numbers cost nothing."""
    planes = np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def _unpack(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(packed, 8 * n, asbytes=True), dtype=np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<i8").reshape(n)


def pair_counts(kept_k: DataFrame, window: int, dynamic: bool = True, seed: int = 42, epoch: int = 0, sentence_size: int = 1000) -> DataFrame:
    """T1 / J3 counted: ``(input_id, label_id, n)`` over the pairs of :func:`pairs`.

    No pair is a row: the pairs of :data:`SENTENCES_COUNTED` sentences are counted where they are made, and their sorted keys travel as
    packed differences to the bucket of the pair's hash, in which equal pairs meet. Buckets are by pair, so a frequent word is in all of them.
    """
    buckets = max(1, -(-kept_k.count() * 2 * window // PAIRS_MERGED))
    merged = "input_id long, label_id long, n long"

    def count(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        k, words = (table[c].to_numpy() for c in ("k", "word_id"))
        sid, width, keys = k // sentence_size, _widths(k, window, dynamic, seed, epoch), []
        for off in range(1, window + 1):
            a, b, same = words[:-off], words[off:], sid[:-off] == sid[off:]
            for centre, label, s in ((a, b, width[:-off]), (b, a, width[off:])):
                there = same & (s >= off)
                keys.append(centre[there] << 32 | label[there])
        found, n = np.unique(np.concatenate(keys), return_counts=True)
        own = ((found.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(own, kind="stable")  # keys stay in order inside a bucket
        found, n, own = found[order], n[order], own[order].astype(np.int64)
        some, starts = np.unique(own, return_index=True)
        ends = np.append(starts[1:], len(own))
        spans = list(zip(starts.tolist(), ends.tolist()))
        return pa.table({"bucket": pa.array(some, pa.int64()), "size": pa.array(ends - starts, pa.int64()),
                         "keys": pa.array([_pack(np.diff(found[x:y], prepend=0)) for x, y in spans], pa.binary()),
                         "counts": pa.array([_pack(n[x:y]) for x, y in spans], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        sizes = table["size"].to_pylist()
        keys = np.concatenate([np.cumsum(_unpack(x.as_py(), m)) for x, m in zip(table["keys"], sizes)])
        n = np.concatenate([_unpack(x.as_py(), m) for x, m in zip(table["counts"], sizes)])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        return pa.table({"input_id": keys[first] >> 32, "label_id": keys[first] & 0xFFFFFFFF, "n": np.add.reduceat(n, first)})
    blocks = _sentence_blocks(kept_k, sentence_size, SENTENCES_COUNTED)
    counted = blocks.groupBy("_blk").applyInArrow(count, "bucket long, size long, keys binary, counts binary")
    return counted.groupBy("bucket").applyInArrow(merge, merged)


def prepare_vocab(docs: DataFrame, params: Word2VecParams, text_col: str = "text") -> tuple[DataFrame, int]:
    """The first part of the corpus job: ``(vocab, total_tokens)``, for those who need no encoded tokens."""
    vocab = build_vocab(None, params.min_count, text_word_counts(docs, text_col))  # counting needs no order
    total = int(vocab.agg(F.sum("freq")).first()[0] or 0)
    check_enough_data(total, params.window_size)
    return vocab, total


def prepare_corpus(docs: DataFrame, params: Word2VecParams, id_col: str = "doc_id", text_col: str = "text",
                   counted: tuple[DataFrame, int] | None = None):
    """Run the corpus job once: returns (tokens, vocab, encoded, total_tokens). ``counted``: what :func:`prepare_vocab` gave for ``docs``."""
    # Tokens are not materialised: splitting the text again is cheaper than writing every
    # token string; the id corpus (integers) is what every epoch reads.
    toks = documents_tokens(docs, id_col, text_col)
    vocab, total = counted or prepare_vocab(docs, params, text_col)
    enc = encode_documents(docs, vocab, id_col, text_col)  # the id corpus is reused by every epoch
    return toks, vocab, enc, total


def epoch_kept(encoded: DataFrame, total_tokens: int, params: Word2VecParams, epoch: int = 0) -> DataFrame:
    """``(g, word_id, freq, k)`` of the epoch's kept tokens, materialised once: the pair window
    and the stream numbering both read it (two integers per kept token, far cheaper than
    hashing every token again in each branch of the plan)."""
    return checkpoint(kept_positions(subsample(encoded, total_tokens, params, epoch)).select("k", "g", "word_id"))


def epoch_pairs(encoded: DataFrame, total_tokens: int, params: Word2VecParams, epoch: int = 0,
                dynamic: bool = True, kept: DataFrame | None = None) -> DataFrame:
    kept = kept if kept is not None else epoch_kept(encoded, total_tokens, params, epoch)
    return pairs(kept, params.window_size, dynamic=dynamic, seed=params.seed, epoch=epoch,
                 sentence_size=params.sentence_size)


def epoch_pair_counts(encoded: DataFrame, total_tokens: int, params: Word2VecParams, epoch: int = 0,
                      dynamic: bool = True, kept: DataFrame | None = None) -> DataFrame:
    kept = kept if kept is not None else epoch_kept(encoded, total_tokens, params, epoch)
    return pair_counts(kept, params.window_size, dynamic=dynamic, seed=params.seed, epoch=epoch, sentence_size=params.sentence_size)


def epoch_stream(encoded: DataFrame, total_tokens: int, params: Word2VecParams, epoch: int = 0,
                 dynamic: bool = True, kept: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    kept = kept if kept is not None else epoch_kept(encoded, total_tokens, params, epoch)
    return pair_stream(kept, params.window_size, params.batch_size, dynamic=dynamic, seed=params.seed, epoch=epoch,
                       sentence_size=params.sentence_size, columns=columns)
