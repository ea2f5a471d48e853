"""Quality classifier: an interpolated modified Kneser-Ney model of characters, one for each language, trained on trusted text.

Trusted documents are labelled good and not toxic. Four fifths of them (by a hash of the id) train the model, the rest
set the thresholds. Counts cover every trusted text:

1. Blocks of documents send each different n-gram once, with its count in trusted text, to a shard; the shard adds up.
2. Lower orders count the different characters before an n-gram; discounts come from the counts of counts. Joins of these
   count tables give the probability of every n-gram that occurs in the corpus.
3. The shards answer the blocks with log-probabilities, and each block sums them for its documents.

A document's score is its mean negative log-probability a character, drawn to the language's mean by ``prior_chars`` characters
so that short texts do not swing. It is rejected if the score is above the language's threshold, a quantile of the
held-out trusted documents' scores.

Characters below 3000 stand for themselves, others share 1096 classes, so an n-gram of four fits 48 bits.
Defined results: a null text is empty, an empty text has the language's mean score and is kept; a null language is the language
``''``; a language without held-out trusted text has no threshold and keeps all; repeated rows count and are judged each;
a document labelled twice is trusted if every label is; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinvec.llm import shingles as S
from twinvec.llm.registry import register, table
from twinvec.session import checkpoint, discard

ORDER, BITS = 4, 12
QUANTILE, PRIOR_CHARS = 0.995, 100
#: Labelled ids are sent to every task up to this number (16 bytes each) and joined by a shuffle beyond it.
MOST_BROADCAST = 1_000_000
TRAIN, HELD_OUT = 1, 2
BLOCK_BYTES = 8 << 20


def trusted(labels: DataFrame) -> DataFrame:
    """``doc_id, role`` of trusted documents."""
    good = F.min(F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False)).cast("int"))
    t = labels.where("doc_id is not null").groupBy("doc_id").agg(good.alias("good")).where("good = 1")
    return t.select("doc_id", F.when(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0, HELD_OUT).otherwise(TRAIN).cast("int").alias("role"))


def with_roles(docs: DataFrame, labels: DataFrame) -> DataFrame:
    t = trusted(labels)
    t = F.broadcast(t) if labels.count() <= MOST_BROADCAST else t
    return docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang")).join(t, "doc_id", "left").select(
        "doc_id", "text", "lang", F.coalesce("role", F.lit(0)).alias("role"))


class _Grams:
    """N-grams of the documents of one language in a block: ``keys`` (sorted), and ``at``, the number of each position's key."""

    def __init__(self, texts: list[str], order: int):
        size = np.array([len(t) for t in texts], dtype=np.int64)
        pad = "\0" * (order - 1)
        sym = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le"), dtype=np.uint32)
        sym = np.where(sym < 3000, sym, 3000 + (sym * np.uint32(2654435761) >> np.uint32(8)) % np.uint32(1096)).astype(np.int16)
        self.owner = np.repeat(np.arange(len(texts), dtype=np.int32), size)
        place = np.arange(len(self.owner), dtype=np.int32) + np.int32(order - 1) * (self.owner + np.int32(1))
        used = np.flatnonzero(np.bincount(sym, minlength=1 << BITS))
        small = np.zeros(1 << BITS, dtype=np.int32)
        small[used] = np.arange(len(used))
        # From short to long n-grams, numbering at each length only those that occur: no sorting of positions. A position's number
        # fits 32 bits, as there are no more numbers than positions.
        at, values = np.zeros(len(place), dtype=np.int32), np.zeros(1, dtype=np.int64)
        for back in range(order - 1, -1, -1):
            space = len(values) * len(used)
            at = at.astype(np.int32 if space < 1 << 31 else np.int64, copy=False)
            at = at * at.dtype.type(len(used))
            at += small[sym[place - np.int32(back)]]
            if space <= max(1 << 24, 2 * len(place)):
                there = np.zeros(space, dtype=bool)
                there[at] = True
                seen = np.flatnonzero(there)
                number = np.zeros(space, dtype=np.int32)
                number[seen] = np.arange(len(seen), dtype=np.int32)
                at = number[at]
            else:
                seen, at = np.unique(at, return_inverse=True)
                at = at.astype(np.int32)
            values = (values[seen // len(used)] << BITS) | used[seen % len(used)]
        self.keys, self.at = values, at


def _by_language(batch: pa.RecordBatch):
    lang, texts = batch["lang"].to_pylist(), batch["text"].to_pylist()
    for one in sorted(set(lang)):
        rows = np.flatnonzero(np.array([x == one for x in lang]))
        yield one, rows, _Grams([texts[i] or "" for i in rows], ORDER)


def _home(keys: np.ndarray, shards: int) -> list[np.ndarray]:
    """Numbers of the keys of each shard."""
    home = (S.mix(keys.astype(np.uint64)) & np.uint64(shards - 1)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    return np.split(order, np.searchsorted(home[order], np.arange(1, shards)))


def _packed(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, byte by byte of all of them, compressed: neighbours share their first characters."""
    import zstandard

    planes = np.diff(keys.astype("<i8"), prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _keys(cell: pa.Scalar) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(cell.as_buffer()), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i8").ravel())


def requests(blocks: DataFrame, shards: int) -> DataFrame:
    """``shard, block, lang, keys, counts``: different n-grams of a block and their counts in its training texts."""
    def run(batches):
        for b in batches:
            for block, cell in zip(b["block"].to_pylist(), b["docs"]):
                docs = S.unpack(cell)
                train = docs["role"].to_numpy() == TRAIN
                for lang, rows, g in _by_language(docs):
                    counts = np.bincount(g.at[train[rows][g.owner]], minlength=len(g.keys)).astype(np.uint32)
                    parts = [(s, r) for s, r in enumerate(_home(g.keys, shards)) if len(r)]
                    if parts:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([s for s, _ in parts], pa.int64()), pa.array([block] * len(parts), pa.int64()),
                             pa.array([lang] * len(parts)), pa.array([_packed(g.keys[r]) for _, r in parts], pa.binary()),
                             pa.array([counts[r].tobytes() for _, r in parts], pa.binary())],
                            names=["shard", "block", "lang", "keys", "counts"])
    return blocks.select("block", "docs").mapInArrow(run, "shard long, block long, lang string, keys binary, counts binary")


def totals(asked: DataFrame) -> DataFrame:
    """``shard, lang, gram, c``: every n-gram of the corpus once, with its count in all training text (0 if only asked for)."""
    def run(t):
        out = []
        for lang in sorted(set(t["lang"].to_pylist())):
            own = t.filter(pa.compute.equal(t["lang"], lang))
            keys = np.concatenate([_keys(x) for x in own["keys"]])
            counts = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.uint32) for x in own["counts"]])
            gram, at = np.unique(keys, return_inverse=True)
            out.append(pa.table({"shard": pa.array(np.full(len(gram), t["shard"][0].as_py())), "lang": pa.array([lang] * len(gram)),
                                 "gram": pa.array(gram), "c": pa.array(np.bincount(at, weights=counts).astype(np.int64))}))
        return pa.concat_tables(out)
    return asked.groupBy("shard").applyInArrow(run, "shard long, lang string, gram long, c long")


def probabilities(seen: DataFrame, order: int = ORDER) -> DataFrame:
    """``shard, lang, gram, logp`` by interpolated modified Kneser-Ney for every row of ``totals``, as a stored table. The tables of an
    order are deleted when the next order's are written."""
    last = F.lit((1 << BITS) - 1)
    tables, asked = {order: seen.where("c > 0").select("lang", "gram", "c")}, {order: seen.select("lang", "gram")}
    for o in range(order - 1, 0, -1):
        cut = F.col("gram").bitwiseAND(F.lit((1 << (BITS * o)) - 1)).alias("gram")
        tables[o] = checkpoint(tables[o + 1].select("lang", cut).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("c")))
        asked[o] = asked[o + 1].select("lang", cut).distinct()
    lower = None
    for o in range(1, order + 1):
        t = tables[o]
        n = [F.sum((F.col("c") == i).cast("long")) for i in (1, 2, 3, 4)]
        d = t.groupBy("lang").agg(*[x.alias(f"n{i}") for i, x in enumerate(n, 1)])
        y = F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0))
        # Chen and Goodman's discounts; half the count where a count of counts is missing.
        raw = lambda i: i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")
        d = d.select("lang", *[F.when(y.isNotNull() & (F.col(f"n{i}") > 0), F.greatest(F.lit(0.0), F.least(F.lit(float(i)), raw(i))))
                               .otherwise(i / 2).alias(f"d{i}") for i in (1, 2, 3)])
        # The number of languages is small but not known to be, so Spark chooses how to join.
        off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        t = t.join(d, "lang").select("lang", "gram", F.shiftright("gram", BITS).alias("ctx"), "c", off.alias("off"))
        ctx = t.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), F.sum("off").alias("free"))
        q = asked[o].withColumn("ctx", F.shiftright("gram", BITS)).join(t.select("lang", "gram", "c", "off"), ["lang", "gram"], "left")
        q = q.join(ctx, ["lang", "ctx"], "left")
        if lower is None:
            q = q.withColumn("below", F.lit(1.0 / (1 << BITS)))
        else:
            q = q.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << (BITS * (o - 1))) - 1))).join(lower, ["lang", "suffix"])
        own = F.coalesce(F.col("c") - F.col("off"), F.lit(0.0))
        p = F.when(F.col("total").isNull(), F.col("below")).otherwise((own + F.col("free") * F.col("below")) / F.col("total"))
        done = [x for x in (lower, tables[o] if o < order else None) if x is not None]
        lower = checkpoint(q.select("lang", F.col("gram").alias("suffix"), p.alias("below")))
        discard(*done)
    probs = checkpoint(seen.select("shard", "lang", "gram").join(lower.withColumnRenamed("suffix", "gram"), ["lang", "gram"]).select(
        "shard", "lang", "gram", F.log(F.greatest("below", F.lit(1e-12))).cast("float").alias("logp")))
    discard(lower)
    return probs


def answers(asked: DataFrame, probs: DataFrame) -> DataFrame:
    """``block, shard, lang, logp``: log-probabilities in the order in which the block asked."""
    def run(t, known):
        out = []
        langs = np.array(known["lang"].to_pylist(), dtype=object)
        gram, logp = known["gram"].to_numpy(), known["logp"].to_numpy()
        tables = {}
        for lang in set(langs):
            own = np.flatnonzero(langs == lang)
            own = own[np.argsort(gram[own])]
            tables[lang] = gram[own], logp[own].astype(np.float32)
        for lang, keys in zip(t["lang"].to_pylist(), t["keys"]):
            g, p = tables[lang]
            out.append(p[np.searchsorted(g, _keys(keys))].tobytes())
        return pa.table({"block": t["block"], "shard": t["shard"], "lang": t["lang"], "logp": pa.array(out, pa.binary())})
    return (asked.select("shard", "block", "lang", "keys").groupBy("shard").cogroup(probs.groupBy("shard"))
            .applyInArrow(run, "block long, shard long, lang string, logp binary"))


def scores(blocks: DataFrame, answered: DataFrame, shards: int) -> DataFrame:
    """``doc_id, lang, role, n_chars, loss``: the negative log-probability of every document."""
    def run(docs, got):
        batch = S.unpack(docs["docs"][0])
        logs = {(s, x): np.frombuffer(p.as_buffer(), dtype=np.float32)
                for s, x, p in zip(got["shard"].to_pylist(), got["lang"].to_pylist(), got["logp"])}
        chars, loss = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch))
        for lang, rows, g in _by_language(batch):
            p = np.empty(len(g.keys))
            for s, r in enumerate(_home(g.keys, shards)):
                if len(r):
                    p[r] = logs[s, lang]
            chars[rows] = np.bincount(g.owner, minlength=len(rows))
            loss[rows] = -np.bincount(g.owner, weights=p[g.at], minlength=len(rows))
        return pa.table({"doc_id": batch["doc_id"].cast(pa.int64()), "lang": batch["lang"].cast(pa.string()),
                         "role": batch["role"].cast(pa.int32()), "n_chars": pa.array(chars), "loss": pa.array(loss)})
    return (blocks.select("block", "docs").groupBy("block").cogroup(answered.groupBy("block"))
            .applyInArrow(run, "doc_id long, lang string, role int, n_chars long, loss double"))


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, prior_chars: int = PRIOR_CHARS) -> DataFrame:
    """``doc_id, lang, n_chars, perplexity, score, kept`` for every row of ``docs (doc_id, text, lang)``."""
    blocks = S.pack_blocks(with_roles(docs, labels), ["doc_id", "text", "lang", "role"], level=9, most=BLOCK_BYTES, full=True)
    shards = S.shards_for(blocks, 64 << 20)
    asked = checkpoint(requests(blocks, shards))
    seen = checkpoint(totals(asked))
    probs = probabilities(seen)
    discard(seen)
    scored = checkpoint(scores(blocks, answers(asked, probs), shards))
    discard(blocks, asked, probs)
    held = scored.where(F.col("role") == HELD_OUT)
    mean = held.groupBy("lang").agg((F.sum("loss") / F.greatest(F.sum("n_chars"), F.lit(1))).alias("mean"))
    score = (F.col("loss") + prior_chars * F.col("mean")) / (F.col("n_chars") + prior_chars)
    limit = held.join(mean, "lang").groupBy("lang").agg(
        F.percentile_approx(score, quantile, 10_000).alias("limit"))
    per_lang = mean.join(limit, "lang")
    return scored.join(per_lang, "lang", "left").select(
        "doc_id", "lang", "n_chars", F.exp(F.col("loss") / F.greatest("n_chars", F.lit(1))).alias("perplexity"), score.alias("score"),
        F.coalesce(score <= F.col("limit"), F.lit(True)).alias("kept"))


@register("op6_quality_lm")
def op6_quality_lm(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
