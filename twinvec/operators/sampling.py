"""Sampling: noise distribution (T2), shared negatives without replacement (T3), per-pair negatives
with replacement (T4), initial vectors (T5) and the learning-rate schedule (T9).

Inverse-CDF draws use a bucketed equi-join instead of a range join: ``[0, 1)`` is cut into
``M`` buckets; each bucket lists the words whose CDF interval overlaps it, sorted by their
lower bound (at most ``V + M`` rows overall); a draw ``u`` joins its bucket ``floor(u M)`` on
equality and keeps the single row with ``lo <= u < next_lo``, i.e. the word with the
greatest lower bound not above ``u``.

Up to :data:`MAX_SAMPLER_WORDS` words the tasks that hold the pairs or batches make the same draws by themselves (:class:`Sampler`, from the
sorted CDF), so that no draw meets a join; a training task does so too, and its draws are never rows.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinvec.functions.rand import TWO32, explode_draws, md5_numbers, uniform
from twinvec.operators.corpus import over_epoch, pair_stream
from twinvec.operators.joins import lookup_join
from twinvec.operators.ordering import dense_prefix
from twinvec.params import Word2VecParams
from twinvec.session import checkpoint


# Our own fixed point for the sampling CDF: weights are rounded to 1/4096, summed as integers
# (exact, and below 2^53 for any corpus up to ~1e15 tokens), then divided once. Floating sums in
# different orders disagree near interval ends; integer sums do not.
WEIGHT_SCALE = 4096


def noise(vocab: DataFrame, distortion: float = 0.75) -> DataFrame:
    """``(word_id, weight, prob, lo, cum, wq)``; ``weight = freq^distortion``, UNK included.

    ``prob`` is ``weight / sum(weight)``; the sampling interval of a word is ``[lo, cum)``, the
    exclusive / inclusive cumulative share of the fixed-point weights ``wq`` in id order.
    """
    w = vocab.select("word_id", F.pow(F.col("freq").cast("double"), F.lit(distortion)).alias("weight"))
    w = w.withColumn("wq", F.round(F.col("weight") * F.lit(WEIGHT_SCALE)).cast("long"))
    tot = w.agg(F.sum("weight").alias("t"), F.sum("wq").alias("tq")).first()  # two scalars
    total, total_q = float(tot["t"] or 0.0), int(tot["tq"] or 0)
    if total <= 0 or total_q <= 0:
        raise ValueError("noise distribution has no positive weight")
    pre = dense_prefix(w, "word_id", {"_lo": F.col("wq")})
    tq = F.lit(float(total_q))
    return pre.select("word_id", "weight", (F.col("weight") / total).alias("prob"),
                      (F.col("_lo").cast("double") / tq).alias("lo"),
                      ((F.col("_lo") + F.col("wq")).cast("double") / tq).alias("cum"), "wq")


def cdf_buckets(noise_df: DataFrame, n_buckets: int) -> DataFrame:
    """``(bucket, word_id, lo_eff, next_lo)`` for the bucketed inverse-CDF join."""
    m = F.lit(n_buckets)
    pos = noise_df.where(F.col("wq") > 0)
    b_lo = F.least(F.floor(F.col("lo") * m), m - 1).cast("long")
    b_hi = F.least(F.floor(F.col("cum") * m), m - 1).cast("long")
    rows = pos.select("word_id", "lo", F.explode(F.sequence(b_lo, F.greatest(b_lo, b_hi))).alias("bucket"))
    w = Window.partitionBy("bucket").orderBy("lo", "word_id")
    rows = rows.withColumn("_first", F.row_number().over(w) == 1) \
        .withColumn("next_lo", F.coalesce(F.lead("lo").over(w), F.lit(float("inf"))))
    return rows.select("bucket", "word_id", F.when(F.col("_first"), F.lit(float("-inf"))).otherwise(F.col("lo"))
                       .alias("lo_eff"), "next_lo")


def inverse_cdf(draws: DataFrame, buckets: DataFrame, n_buckets: int, u_col: str = "u",
                out: str = "sample") -> DataFrame:
    """Map each draw ``u`` in [0, 1) to a word id (exactly one match per draw)."""
    d = draws.withColumn("bucket", F.least(F.floor(F.col(u_col) * F.lit(n_buckets)),
                                           F.lit(n_buckets - 1)).cast("long"))
    j = lookup_join(d, buckets, "bucket", how="inner")
    hit = j.where((F.col("lo_eff") <= F.col(u_col)) & (F.col(u_col) < F.col("next_lo")))
    return hit.drop("bucket", "lo_eff", "next_lo").withColumnRenamed("word_id", out)


def default_buckets(vocab_rows: int) -> int:
    return max(1024, int(vocab_rows))


def per_pair_negatives(stream: DataFrame, noise_df: DataFrame, k: int, seed: int = 42, epoch: int = 0,
                       n_buckets: int | None = None) -> DataFrame:
    """T4: ``k`` draws with replacement per pair; draws equal to the label are skipped.

    ``stream`` needs ``pair_idx`` and ``label_id``. Returns ``(pair_idx, draw, sample)``. Pairs draw where they lie; ``n_buckets`` asks for the
    bucketed join, which larger vocabularies take by themselves.
    """
    known = None if n_buckets else Sampler.of(noise_df)
    if known:
        sent = stream.sparkSession.sparkContext.broadcast(known)

        def draw(batches):
            for b in batches:
                for at in range(0, b.num_rows, PAIRS_AT_ONCE):
                    part = b.slice(at, PAIRS_AT_ONCE)
                    pairs, labels = part["pair_idx"].to_numpy(), part["label_id"].to_numpy()
                    words = sent.value.pair(seed, epoch, pairs, k)
                    rows, draws = np.nonzero(words != labels[:, None])
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[rows]), pa.array(draws.astype(np.int32)), pa.array(words[rows, draws])],
                                                     names=["pair_idx", "draw", "sample"])
        return stream.select(F.col("pair_idx").cast("long"), F.col("label_id").cast("long")).mapInArrow(
            draw, "pair_idx long, draw int, sample long")
    m = n_buckets or default_buckets(noise_df.count())
    draws = explode_draws(stream.select("pair_idx", "label_id"), seed, "negp", [F.lit(epoch), F.col("pair_idx")], 0, k)
    s = inverse_cdf(draws, cdf_buckets(noise_df, m), m)
    return s.where(F.col("sample") != F.col("label_id")).select("pair_idx", "draw", "sample")


def negative_counts(kept: DataFrame, noise_df: DataFrame, k: int, params: Word2VecParams, epoch: int = 0) -> DataFrame:
    """T4 counted: ``(sample, n)`` over the rows that :func:`per_pair_negatives` gives for every pair of the epoch's stream.

    Neither a pair nor a draw is a row: a task makes the pairs of its sentences, draws for each and sorts the draws, so that the words' shares are
    read off between the bounds of their intervals; draws equal to the pair's label are taken off. A task emits a row a word.
    """
    known = Sampler.of(noise_df)
    if known is None:
        stream = pair_stream(kept, params.window_size, params.batch_size, True, params.seed, epoch, params.sentence_size, ["pair_idx", "label_id"])
        return per_pair_negatives(stream, noise_df, k, params.seed, epoch).groupBy("sample").agg(F.count(F.lit(1)).alias("n"))
    sent, seed = kept.sparkSession.sparkContext.broadcast(known), params.seed

    def task(copy, chunks, given):
        own, (counts, waiting, held) = sent.value, (None, [], 0)
        by_id = np.argsort(own.ids, kind="stable")
        ids, ends = own.ids[by_id], np.append(own._steps[1:], 1 << 32)

        def add():
            at = np.searchsorted(np.sort(np.concatenate(waiting)), np.minimum(own._steps, (1 << 32) - 1).astype(np.uint32))
            at[own._steps > (1 << 32) - 1] = held
            return np.diff(at, append=held)
        for pairs, _, labels in chunks:
            counts = np.zeros(len(ids), dtype=np.int64) if counts is None else counts
            for at in range(0, len(pairs), PAIRS_AT_ONCE):
                draws = own.draws(seed, "negp", epoch, pairs[at:at + PAIRS_AT_ONCE], 0, k)
                mine = labels[at:at + PAIRS_AT_ONCE]
                place = np.minimum(np.searchsorted(ids, mine), len(ids) - 1)
                there, word = ids[place] == mine, by_id[place]  # a label without weight is never drawn
                low, high = own._steps[word], ends[word]
                same = ((draws >= low[:, None]) & (draws < high[:, None])).sum(axis=1)
                np.subtract.at(counts, word[there], same[there])
                waiting.append(draws.ravel())
                held += draws.size
                if held >= DRAWS_SORTED:
                    counts += add()
                    waiting, held = [], 0
        if counts is None:
            return
        if held:
            counts += add()
        found = np.flatnonzero(counts)
        for at in range(0, len(found), PAIRS_AT_ONCE):
            some = found[at:at + PAIRS_AT_ONCE]
            yield pa.RecordBatch.from_arrays([pa.array(own.ids[some].astype(np.int64)), pa.array(counts[some])], names=["sample", "n"])
    return over_epoch(kept, params, task, "sample long, n long", epoch).groupBy("sample").agg(F.sum("n").alias("n"))


def shared_negatives(batch_ids: DataFrame, noise_df: DataFrame, k: int, seed: int = 42, epoch: int = 0,
                     first_draws: int | None = None, n_buckets: int | None = None) -> DataFrame:
    """Per batch, ``k`` distinct ids drawn without replacement from the noise distribution.

    Sequential draws with replacement, keeping first occurrences in draw order, equal
    sampling without replacement. Each round draws ``2k`` per pending batch; batches still
    short of ``k`` distinct ids get the next block of draws, so no batch is cut short. Returns ``(batch_id, word_id, draw)``
    where ``draw`` is the index of the first draw of that id. Batches draw where they lie; ``first_draws`` or ``n_buckets`` ask for the
    bucketed join, which larger vocabularies take by themselves.
    """
    n_pos = noise_df.where(F.col("wq") > 0).count()
    if k > n_pos:
        raise ValueError(f"cannot draw {k} distinct ids from {n_pos} words with positive weight")
    known = None if n_buckets or first_draws else Sampler.of(noise_df)
    if known:
        sent = batch_ids.sparkSession.sparkContext.broadcast(known)

        def draw(batches):
            for b in batches:
                ids = b["batch_id"].to_numpy()
                for at in range(0, len(ids), PAIRS_AT_ONCE // 8):
                    own = ids[at:at + PAIRS_AT_ONCE // 8]
                    words, draws = sent.value.shared_draws(seed, epoch, own, k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, k)), pa.array(words.ravel()), pa.array(draws.ravel().astype(np.int32))],
                                                     names=["batch_id", "word_id", "draw"])
        return batch_ids.select(F.col("batch_id").cast("long")).distinct().mapInArrow(draw, "batch_id long, word_id long, draw int")
    m = n_buckets or default_buckets(noise_df.count())
    buckets = cdf_buckets(noise_df, m)
    step = first_draws or 4 * ((2 * k + 3) // 4)  # 2k draws per round, a multiple of 4 (one md5 each)
    pending = batch_ids.select("batch_id").distinct()
    found = None
    start = 0
    while True:
        draws = explode_draws(pending.select("batch_id"), seed, "neg", [F.lit(epoch), F.col("batch_id")], start, step)
        s = inverse_cdf(draws, buckets, m).select("batch_id", "draw", F.col("sample").alias("word_id"))
        found = s if found is None else found.unionByName(s)
        firsts = found.groupBy("batch_id", "word_id").agg(F.min("draw").alias("draw"))
        firsts = checkpoint(firsts)
        found = firsts
        counts = firsts.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
        short = counts.where(F.col("n") < k).select("batch_id")
        if short.limit(1).count() == 0:
            break
        pending = short
        start += step
    w = Window.partitionBy("batch_id").orderBy("draw")
    return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


# Our own bound on the words whose intervals every training task holds (12 bytes each).
MAX_SAMPLER_WORDS = 4_000_000
# Pairs whose draws a task holds at a time.
PAIRS_AT_ONCE = 1 << 14
# Runs of equal weights that are sent to the tasks, and words of a guide's entry that are tried before a search.
MOST_RUNS, MOST_TRIED = 1 << 18, 8
# Draws that a task of negative_counts sorts at a time.
DRAWS_SORTED = 1 << 22


class Sampler:
    """The draws of :func:`shared_negatives` and :func:`per_pair_negatives`, made inside a task from the sorted CDF.

    What is sent to the tasks are the runs of consecutive ids of one weight, far fewer than words in a vocabulary that is ordered by frequency;
    a task makes the words' intervals from them, by the divisions of :func:`noise`.
    """

    def __init__(self, ids: np.ndarray, lo: np.ndarray):
        order = np.argsort(lo, kind="stable")
        self._sorted = ids[order].astype(np.int32 if len(ids) < 1 << 31 else np.int64), lo[order]

    @classmethod
    def of(cls, noise_df: DataFrame) -> "Sampler | None":
        """None where the vocabulary is larger than :data:`MAX_SAMPLER_WORDS`."""
        positive = noise_df.where(F.col("wq") > 0).select("word_id", "lo", "wq")
        n = positive.count()
        if n > MAX_SAMPLER_WORDS:
            return None
        by = positive.groupBy("wq", F.col("word_id") == 0).agg(F.min("word_id").alias("first"), F.count(F.lit(1)).alias("n"), F.min("lo").alias("lo"),
                                                               F.max("word_id").alias("last"))
        runs = by.select("first", "n", "wq", "lo", "last").limit(MOST_RUNS + 1).toArrow().sort_by("first")
        first, count, wq, lo, last = (x.to_numpy() for x in runs.columns)
        if n and len(runs) <= MOST_RUNS and (last - first + 1 == count).all() and (first[1:] > last[:-1]).all():
            found = cls.__new__(cls)
            found._runs = first.astype(np.int64), count.astype(np.int64), wq.astype(np.int64)
            before = np.cumsum(count * wq) - count * wq
            if np.array_equal(before.astype(np.float64) / float((count * wq).sum()), lo):
                return found
        t = positive.toArrow()  # ids and weights in another order
        return cls(t["word_id"].to_numpy(), t["lo"].to_numpy())

    @cached_property
    def _sorted(self) -> tuple[np.ndarray, np.ndarray]:
        first, count, wq = self._runs
        total, ends = float((count * wq).sum()), np.cumsum(count)
        place = np.arange(ends[-1]) - np.repeat(ends - count, count)
        lo = np.repeat(np.cumsum(count * wq) - count * wq, count) + place * np.repeat(wq, count)
        ids = np.repeat(first, count) + place
        return ids.astype(np.int32 if len(ids) < 1 << 31 else np.int64), lo.astype(np.float64) / total

    @property
    def ids(self) -> np.ndarray:
        return self._sorted[0]

    @property
    def lo(self) -> np.ndarray:
        return self._sorted[1]

    @cached_property
    def _steps(self) -> np.ndarray:
        """The least draw, as a number of 32 bits, of each word; a draw is a 2^32nd part, so comparing these is comparing it with ``lo``."""
        return np.ceil(self.lo * TWO32).astype(np.int64)

    @cached_property
    def _guide(self) -> tuple[int, np.ndarray]:
        """For each value of a draw's first bits, the last word that begins below all such draws."""
        bits = min(22, max(8, len(self.lo).bit_length() + 1))
        starts = np.arange((1 << bits) + 1, dtype=np.int64) << (32 - bits)
        return bits, np.maximum(np.searchsorted(self._steps, starts, side="right") - 1, 0).astype(np.int32)

    def places(self, draws: np.ndarray) -> np.ndarray:
        """Places in ``ids`` of draws of 32 bits: the last word whose interval begins at or below each."""
        bits, guide = self._guide
        flat = draws.ravel()
        part = flat >> np.uint32(32 - bits)
        at, last = guide[part], guide[part + np.uint32(1)]
        open_ = np.flatnonzero(last > at)  # the words that begin among these draws are tried one after another
        for _ in range(MOST_TRIED):
            if not len(open_):
                break
            further = self._steps[at[open_] + 1] <= flat[open_]
            open_ = open_[further]
            at[open_] += 1
            open_ = open_[at[open_] < last[open_]]
        at[open_] = np.searchsorted(self._steps, flat[open_].astype(np.int64), side="right") - 1
        return at.reshape(draws.shape)

    @staticmethod
    def uniforms(seed: int, tag: str, epoch: int, keys: np.ndarray, start: int, count: int) -> np.ndarray:
        """Draws ``start`` to ``start + count`` of every key, four from an md5 (see ``functions.rand.explode_draws``)."""
        return Sampler.draws(seed, tag, epoch, keys, start, count) / TWO32

    @staticmethod
    def draws(seed: int, tag: str, epoch: int, keys: np.ndarray, start: int, count: int) -> np.ndarray:
        """:meth:`uniforms` as numbers of 32 bits."""
        first, last = start // 4, (start + count + 3) // 4
        found = np.concatenate([md5_numbers(f"{seed}:{tag}:{epoch}:", keys, f":{b}") for b in range(first, last)], axis=1)
        return found[:, start - 4 * first:start - 4 * first + count]

    def words(self, u: np.ndarray) -> np.ndarray:
        return self.ids[np.maximum(np.searchsorted(self.lo, u, side="right") - 1, 0)].astype(np.int64)

    def drawn(self, draws: np.ndarray) -> np.ndarray:
        """:meth:`words` of draws as numbers of 32 bits."""
        return self.ids[self.places(draws)].astype(np.int64)

    def pair(self, seed: int, epoch: int, pair_idx: np.ndarray, k: int) -> np.ndarray:
        """T4: ``k`` draws a pair, as a row each; those equal to the label are the caller's to leave out."""
        return self.drawn(self.draws(seed, "negp", epoch, pair_idx, 0, k))

    def shared_draws(self, seed: int, epoch: int, batch_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """``k`` distinct words a batch, in the order of their first draws, and the numbers of these draws."""
        if k > len(self.ids):
            raise ValueError(f"cannot draw {k} distinct ids from {len(self.ids)} words with positive weight")
        step = 4 * ((2 * k + 3) // 4)
        words, draws = np.zeros((2, len(batch_ids), k), dtype=np.int64)
        drawn, short = np.empty((len(batch_ids), 0), dtype=np.int64), np.arange(len(batch_ids))
        while len(short):
            more = self.drawn(self.draws(seed, "neg", epoch, batch_ids[short], drawn.shape[1], step))
            drawn = np.concatenate([drawn, more], axis=1)
            order = np.argsort(drawn, axis=1, kind="stable")  # equal words in the order of their draws
            ranked, new = np.take_along_axis(drawn, order, axis=1), np.ones(drawn.shape, dtype=bool)
            new[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
            first = np.empty(drawn.shape, dtype=bool)
            np.put_along_axis(first, order, new, axis=1)
            done = first.sum(axis=1) >= k
            picked = first[done] & (np.cumsum(first[done], axis=1) <= k)
            words[short[done]] = drawn[done][picked].reshape(-1, k)
            draws[short[done]] = np.nonzero(picked)[1].reshape(-1, k)
            drawn, short = drawn[~done], short[~done]
        return words, draws

    def shared(self, seed: int, epoch: int, batch_ids: np.ndarray, k: int) -> list[np.ndarray]:
        """The words of :meth:`shared_draws`, an array for each batch."""
        return list(self.shared_draws(seed, epoch, batch_ids, k)[0])


def init_vectors(vocab: DataFrame, dim: int, seed: int = 42) -> DataFrame:
    """T5: ``emb(word_id, vec)`` with entries uniform in ``[-0.5/dim, 0.5/dim)``."""
    slots = vocab.select("word_id", F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("slot"))
    vals = slots.withColumn("value", (uniform(seed, "init", F.col("word_id"), F.col("slot")) - F.lit(0.5)) / F.lit(dim))
    return vals


def init_matrix(vocab: DataFrame, dim: int, seed: int = 42) -> DataFrame:
    """T5 as arrays, computed per row; the ids are dealt to all tasks, for a vocabulary is a small table in few files."""
    seq = F.sequence(F.lit(0), F.lit(dim - 1))
    vec = F.transform(seq, lambda s: ((F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("init"),
                                                                               F.col("word_id").cast("string"),
                                                                               s.cast("string"))), 1, 8), 16, 10)
                                      .cast("long") / F.lit(4294967296.0)) - F.lit(0.5)) / F.lit(dim))
    ids = vocab.select("word_id").repartition(vocab.sparkSession.sparkContext.defaultParallelism, "word_id")
    return ids.select("word_id", F.transform(vec, lambda e: e.cast("float")).alias("vec"))


def learning_rate(words: F.Column, words_per_epoch: int, params: Word2VecParams, epochs: int | None = None,
                  lr0: float | None = None) -> F.Column:
    """``lr0 * max(floor, 1 - decay * words / (words_per_epoch * epochs))``."""
    epochs = epochs or params.epochs_to_train
    lr0 = params.learning_rate if lr0 is None else lr0
    frac = words.cast("double") / F.lit(float(words_per_epoch) * float(epochs))
    return F.lit(lr0) * F.greatest(F.lit(params.lr_floor), F.lit(1.0) - F.lit(params.lr_decay) * frac)


def rate_at(words: int, words_per_epoch: int, params: Word2VecParams, epochs: int, lr0: float) -> float:
    """:func:`learning_rate` for one value of the word counter."""
    return lr0 * max(params.lr_floor, 1.0 - params.lr_decay * (float(words) / (float(words_per_epoch) * float(epochs))))
