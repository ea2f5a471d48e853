"""Phrase mining: word sequences that occur far more often together than their parts let expect, by language.

Counts are streams of ``name, a, b, c``. A phrase of ``k`` words is named by a number; ``a`` names its first ``k - 1`` words and
``b`` its last ``k - 1``, so one phrase is one pair of numbers at every length:

1. Texts become blocks of word positions, each with the block's number of its word and a barrier where a piece ends. A block sends each
   different word once, with its count, to a shard (a range of the words' hashes). The shards merge these sorted streams, and answer
   with names for words that are frequent enough.
2. Two neighbouring positions with names are a pair, and the pairs are counted in the same way: a phrase can't be frequent if one of its
   two shorter parts isn't, so nothing is lost, and long phrases are counted where their parts are frequent only. Blocks shrink
   from length to length; each table is deleted when the next is written.
3. The frequent phrases of a length, in prefix order (by ``a``) and in suffix order (by ``b``), are merged in lockstep with the phrases one
   word shorter, in the order of their names: the prefix order gives the counts of all left parts, the suffix order those of all
   right parts, and the streams one word longer give each phrase's most frequent extension to the right and to the left. These are
   sort-merge joins; no table of phrases is hashed, held in memory or broadcast.

A word or phrase has one entry a block, however often it occurs, and pairs are dealt by a mix of both numbers, so common ones make no hot shard.

Words are maximal runs of bytes other than space and tab in pieces between ``.,;:!?`` and line ends, with A-Z as a-z. Words are told
apart by 64-bit hashes (with the language), names are exact. Counts and products are exact.
Defined results: a null text is empty, an empty one has no words; a null language is ``und``; repeated rows count each; long
texts are cut into blocks between pieces; ties are broken by the phrase's bytes; an empty table gives no rows; only ``lang`` and
``text`` are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinvec.llm import shingles as S
from twinvec.llm.registry import register, table
from twinvec.llm.workers import lean, per_process
from twinvec.session import checkpoint, discard

MIN_COUNT, LONGEST, TOP = 30, 4, 2000
#: A longer phrase takes a shorter one's place if it makes up this share (in hundredths) of its occurrences; scale of scores.
COVERS, SCALE = 80, 2_000_000
BLOCK_BYTES, SHARD_BYTES, SALTS = 4 << 20, 8 << 20, 64
NONE = np.uint32(0xFFFFFFFF)
BREAK, BLANK = 10, 32

SENT = "kind string, block long, shard long, lo long, lang string, a binary, b binary, c binary, words binary"
COUNTED = "kind string, block long, lo long, names binary, name long, a long, b long, c long, lang string, word string"


def _byte_map() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    out[9] = BLANK
    out[list(b".,;:!?") + [10, 11, 12, 13]] = BREAK
    return out


def _squeeze(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences, which are small in a sorted stream."""
    return np.diff(x, prepend=x.dtype.type(0))


def _loose(cell: pa.Scalar, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(cell.as_buffer()), dtype=kind)


def _rows(schema: str, rows: list[dict]) -> pa.RecordBatch:
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_pylist(rows, pa.schema([(c.split()[0], types[c.split()[1]]) for c in schema.split(", ")]))


def _cuts(home: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """``(shard, from, to)`` of the runs in sorted ``home``."""
    edges = np.searchsorted(home, np.arange(shards + 1)) if shards <= len(home) else None
    if edges is not None:
        return [(s, edges[s], edges[s + 1]) for s in range(shards) if edges[s] < edges[s + 1]]
    at = np.flatnonzero(np.diff(home, prepend=-1))
    return [(int(home[i]), i, j) for i, j in zip(at, np.append(at[1:], len(home)))]


def _home(mixed: np.ndarray, shards: int) -> np.ndarray:
    return (mixed >> np.uint64(65 - shards.bit_length())).astype(np.int64) if shards > 1 else np.zeros(len(mixed), dtype=np.int64)


class _Words:
    """Words of a stretch of bytes that begins and ends where a piece may (``ends``: of the texts in it)."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        self.data = data
        self.hashes, self.per_text = S.words(data, ends)
        solid = (data != BREAK) & (data != BLANK)
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        cuts = ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(data))]
        first[cuts] = solid[cuts]
        last[cuts - 1] = solid[cuts - 1]
        self.start, self.stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        piece = np.cumsum(data == BREAK)[self.start] + np.repeat(np.arange(len(ends)), self.per_text)
        self.place = np.arange(len(piece)) + np.cumsum(np.diff(piece, prepend=piece[:1]) != 0)

    def texts(self, which: np.ndarray) -> bytes:
        """The words numbered ``which``, with breaks between them (no word has one inside)."""
        size = self.stop[which] - self.start[which] + 1
        at = np.cumsum(size) - size
        take = np.repeat(self.start[which] - at, size) + np.arange(int(size.sum()))
        out = self.data[np.minimum(take, len(self.data) - 1)]
        out[at + size - 1] = BREAK
        return out[:-1].tobytes()


def _stretches(data: np.ndarray, ends: np.ndarray, most: int):
    """``(from, to)`` of at most ``most`` bytes each, cut after breaks or at ends of texts; longer only if a piece is."""
    at, total = 0, len(data)
    while at < total:
        to = total
        if total - at > most:
            inside = np.flatnonzero(data[at:at + most] == BREAK)
            e = ends[np.searchsorted(ends, at + most, side="right") - 1] if len(ends) and ends[0] <= at + most else 0
            to = max(e, at + inside[-1] + 1 if len(inside) else 0)
            if to <= at:
                later = np.flatnonzero(data[at + most:] == BREAK)
                e = ends[np.searchsorted(ends, at, side="right")]
                to = min(e, at + most + later[0] + 1 if len(later) else total)
        yield at, int(to)
        at = int(to)


def words(docs: DataFrame, shards: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``SENT`` rows of the first length, stored: ``state`` (positions of a block), ``ask`` (its words) and ``total`` (words by language)."""
    def cut(batches):
        from pyspark import TaskContext

        lean()
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            data, ends = S.flat(b["text"])
            data, langs = per_process("phrase bytes", _byte_map)[data], b["lang"].to_pylist()
            for lo, hi in _stretches(data, ends, block_bytes):
                x, y = np.searchsorted(ends, lo, side="right"), np.searchsorted(ends, hi, side="left")
                w = _Words(data[lo:hi], np.minimum(ends[x:y + 1], hi) - lo)
                own = langs[x:y + 1]
                if len(w.start):
                    yield _rows(SENT, list(_first_rows(w, own, block, shards)))
                    block += 1
    return checkpoint(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(cut, SENT), "kind")


def _first_rows(w: _Words, langs: list[str], block: int, shards: int):
    names = sorted(set(langs))
    code = np.repeat(np.array([names.index(x) for x in langs]), w.per_text)
    at, lo = np.full(int(w.place[-1]) + 1, NONE, dtype=np.uint32), 0
    for k, lang in enumerate(names):
        rows = np.flatnonzero(code == k)
        if not len(rows):
            continue
        keys, first, number, counts = np.unique(w.hashes[rows], return_index=True, return_inverse=True, return_counts=True)
        at[w.place[rows]] = number + lo
        yield {"kind": "total", "block": block, "lang": lang, "lo": len(rows)}
        for s, i, j in _cuts(_home(keys, shards), shards):
            yield {"kind": "ask", "block": block, "shard": s, "lang": lang, "lo": lo + i, "a": _squeeze(_steps(keys[i:j])),
                   "c": _squeeze(counts[i:j].astype(np.int64)), "words": _pack(w.texts(rows[first[i:j]]))}
        lo += len(keys)
    yield {"kind": "state", "block": block, "a": _squeeze(at)}


def _pack(x: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x)


def name_words(sent: DataFrame, min_count: int) -> DataFrame:
    """``COUNTED`` rows of the first length, stored: ``freq`` (``name, c, lang, word``) and ``answer`` (names for a block)."""
    def run(key, t):
        import zstandard

        lean()
        shard, out, names = key[0].as_py(), [], 0
        langs = t["lang"].to_pylist()
        block, lo = t["block"].to_pylist(), t["lo"].to_pylist()
        for lang in sorted(set(langs)):
            rows = [i for i, x in enumerate(langs) if x == lang]
            keys = [np.cumsum(_loose(t["a"][i], np.uint64), dtype=np.uint64) for i in rows]
            every, counts = np.concatenate(keys), np.concatenate([_loose(t["c"][i], np.int64) for i in rows])
            order = np.argsort(every, kind="stable")
            start = np.flatnonzero(np.diff(every[order], prepend=every[order][:1] ^ np.uint64(1)) != 0)
            total, uniq, source = np.add.reduceat(counts[order], start), every[order][start], order[start]
            often = np.flatnonzero(total >= min_count)
            name = np.full(len(uniq), -1, dtype=np.int64)
            name[often] = (shard << 32) + names + np.arange(len(often))
            names += len(often)
            edge, held = np.cumsum([len(k) for k in keys]), {}
            for u in often:
                r = int(np.searchsorted(edge, source[u], side="right"))
                if r not in held:
                    held[r] = zstandard.ZstdDecompressor().decompress(t["words"][rows[r]].as_buffer()).split(bytes([BREAK]))
                word = held[r][int(source[u] - (edge[r] - len(keys[r])))]
                out.append({"kind": "freq", "name": int(name[u]), "c": int(total[u]), "lang": lang, "word": word.decode("utf-8", "replace")})
            for i, k in zip(rows, keys):
                out.append({"kind": "answer", "block": block[i], "lo": lo[i], "names": _squeeze(name[np.searchsorted(uniq, k)])})
        return pa.Table.from_batches([_rows(COUNTED, out)])
    asked = sent.where("kind = 'ask'").select("shard", "block", "lo", "lang", "a", "c", "words")
    return checkpoint(asked.groupBy("shard").applyInArrow(run, COUNTED), "kind")


def pairs(sent: DataFrame, counted: DataFrame, shards: int, last: bool) -> DataFrame:
    """``SENT`` rows of the next length, stored: neighbouring names of every block. ``last``: no positions are kept."""
    def run(key, state, answer):
        lean()
        block = key[0].as_py()
        if not len(state):
            return pa.Table.from_batches([_rows(SENT, [])])
        at = _loose(state["a"][0], np.uint32)
        found = {lo: _loose(x, np.int64) for lo, x in zip(answer["lo"].to_pylist(), answer["names"])}
        name = np.concatenate([found[lo] for lo in sorted(found)] + [np.array([-1])])
        here = name[np.where(at == NONE, len(name) - 1, at)]
        valid = (here[:-1] >= 0) & (here[1:] >= 0)
        place = np.flatnonzero(valid)
        if not len(place):
            return pa.Table.from_batches([_rows(SENT, [])])
        a, b = here[place], here[place + 1]
        order = np.lexsort((b, a))
        start = np.flatnonzero((np.diff(a[order], prepend=-1) != 0) | (np.diff(b[order], prepend=-1) != 0))
        ua, ub, counts = a[order][start], b[order][start], np.diff(np.append(start, len(order)))
        home = _home(S.mix(ua.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + ub.astype(np.uint64)), shards)
        dealt = np.argsort(home, kind="stable")  # in each shard still in prefix order
        out = [{"kind": "ask", "block": block, "shard": s, "lo": int(i), "a": _squeeze(_steps(ua[dealt[i:j]])), "b": _squeeze(ub[dealt[i:j]]),
                "c": _squeeze(counts[dealt[i:j]].astype(np.int64))} for s, i, j in _cuts(home[dealt], shards)]
        if not last:
            number = np.empty(len(start), dtype=np.uint32)
            number[dealt] = np.arange(len(start), dtype=np.uint32)
            now = np.full(len(valid), NONE, dtype=np.uint32)
            now[place[order]] = np.repeat(number, counts)
            now = now[valid | np.concatenate([[False], valid[:-1]])]  # one barrier after each run
            out.append({"kind": "state", "block": block, "a": _squeeze(now)})
        return pa.Table.from_batches([_rows(SENT, out)])
    state, answer = sent.where("kind = 'state'").select("block", "a"), counted.where("kind = 'answer'").select("block", "lo", "names")
    return checkpoint(state.groupBy("block").cogroup(answer.groupBy("block")).applyInArrow(run, SENT), "kind")


def name_pairs(sent: DataFrame, min_count: int, last: bool) -> DataFrame:
    """``COUNTED`` rows of a later length, stored: ``freq`` (``name, a, b, c``) and, unless ``last``, ``answer``."""
    def run(key, t):
        lean()
        shard, sizes = key[0].as_py(), []
        a, b, c = [], [], []
        for x, y, z in zip(t["a"], t["b"], t["c"]):
            a.append(np.cumsum(_loose(x, np.int64)))
            b.append(_loose(y, np.int64))
            c.append(_loose(z, np.int64))
            sizes.append(len(a[-1]))
        a, b, c = np.concatenate(a), np.concatenate(b), np.concatenate(c)
        order = np.lexsort((b, a))
        new = (np.diff(a[order], prepend=-1) != 0) | (np.diff(b[order], prepend=-1) != 0)
        start = np.flatnonzero(new)
        total = np.add.reduceat(c[order], start)
        often = np.flatnonzero(total >= min_count)
        name = np.full(len(start), -1, dtype=np.int64)
        name[often] = (shard << 32) + np.arange(len(often))
        n = len(often)
        ua, ub = a[order][start][often], b[order][start][often]
        null = lambda kind, m: pa.nulls(m, kind)
        schema = _rows(COUNTED, []).schema
        out = [pa.table({"kind": pa.array(["freq"] * n, pa.string()), "block": null(pa.int64(), n), "lo": null(pa.int64(), n), "names": null(pa.binary(), n),
                         "name": pa.array(name[often]), "a": pa.array(ua), "b": pa.array(ub), "c": pa.array(total[often]),
                         "lang": null(pa.string(), n), "word": null(pa.string(), n)}, schema=schema)]
        if not last:
            mine = np.empty(len(order), dtype=np.int64)
            mine[order] = name[np.cumsum(new) - 1]
            parts = np.split(mine, np.cumsum(sizes)[:-1])
            out.append(pa.Table.from_batches([_rows(COUNTED, [
                {"kind": "answer", "block": k, "lo": lo, "names": _squeeze(x)}
                for k, lo, x in zip(t["block"].to_pylist(), t["lo"].to_pylist(), parts)])]))
        return pa.concat_tables(out)
    asked = sent.where("kind = 'ask'").select("shard", "block", "lo", "a", "b", "c")
    return checkpoint(asked.groupBy("shard").applyInArrow(run, COUNTED), "kind")


def count(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST) -> tuple[DataFrame, list[DataFrame]]:
    """``lang, n`` (all words), and the streams of frequent phrases: ``name, lang, word, c`` of words, then ``name, a, b, c`` by length."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 << max(0, int(size // SHARD_BYTES)).bit_length()
    sent = words(docs, shards)
    n = checkpoint(sent.where("kind = 'total'").groupBy("lang").agg(F.sum("lo").alias("n")))
    counted = name_words(sent, min_count)
    streams = [checkpoint(counted.where("kind = 'freq'").select("name", "lang", "word", "c"))]
    for k in range(2, longest + 1):
        after = pairs(sent, counted, shards, k == longest)
        discard(sent, counted)
        sent = after
        counted = name_pairs(sent, min_count, k == longest)
        streams.append(checkpoint(counted.where("kind = 'freq'").select("name", "a", "b", "c")))
    discard(sent, counted)
    return n, streams


def parts(streams: list[DataFrame]) -> list[DataFrame]:
    """By length: ``name, lang, phrase, last, a`` (count), ``pre`` and ``suf`` (counts of the first and last 1, 2, ... words), stored."""
    none = F.array().cast("array<bigint>")
    out = [streams[0].select("name", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.col("c").alias("a"), none.alias("pre"), none.alias("suf"))]
    for s in streams[1:]:
        left = out[-1].select(F.col("name").alias("l"), "lang", "phrase", F.concat("pre", F.array("a")).alias("pre"))
        right = out[-1].select(F.col("name").alias("r"), "last", F.concat("suf", F.array("a")).alias("suf"))
        both = s.withColumnRenamed("a", "l").withColumnRenamed("b", "r")
        both = both.join(left.hint("merge"), "l").join(right.hint("merge"), "r")  # in prefix order, then in suffix order
        out.append(checkpoint(both.select("name", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", F.col("c").alias("a"), "pre", "suf")))
    return out


def extensions(stream: DataFrame) -> DataFrame:
    """``name, m``: the largest count of a phrase one word longer, to the right or to the left."""
    both = stream.select(F.col("a").alias("name"), "c").union(stream.select("b", "c"))
    return both.groupBy("name").agg(F.max("c").alias("m"))


def mine(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases."""
    n, streams = count(docs, min_count, longest)
    tables, found = parts(streams), None
    big = lambda c: F.col(c).cast("decimal(19,0)")
    for k in range(2, longest + 1):
        t = tables[k - 1]
        if k < longest:
            t = t.join(extensions(streams[k]).hint("merge"), "name", "left").where(F.coalesce(100 * big("m") < COVERS * big("a"), F.lit(True)))
        cut = F.array(*[F.struct(
            F.expr(f"(cast(a as decimal(19,0)) * {SCALE}bd) div (cast(pre[{i - 1}] as decimal(19,0)) + suf[{k - i - 1}])").alias("score"),
            F.lit(i).alias("k"), F.col("pre")[i - 1].alias("l"), F.col("suf")[k - i - 1].alias("r")) for i in range(1, k)])
        t = t.select("lang", "phrase", "a", F.array_min(cut).alias("cut"))
        found = t if found is None else found.unionByName(t)
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = found.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("cut.score").cast("long").alias("score"))
    # Of a language's phrases first the best of each salt, so that the last step has at most SALTS * top rows of a language.
    part = Window.partitionBy("lang", "salt").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    best = best.drop("salt").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) AS g FROM w, range(1, {LONGEST + 1}) t(k)),
c AS (SELECT lang, k, g, count(*)::BIGINT AS a FROM g GROUP BY lang, k, g),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM c WHERE k = 1 GROUP BY lang),
cand AS (SELECT * FROM c WHERE k >= 2 AND a >= {MIN_COUNT}),
sub AS (SELECT lang, s, max(a) AS m FROM (SELECT lang, a, unnest(list_transform(range(1, k - j + 2), lambda i: g[i:i + j - 1])) AS s
  FROM cand, range(2, {LONGEST}) t(j) WHERE j < k) GROUP BY lang, s),
kept AS (SELECT cand.* FROM cand LEFT JOIN sub ON sub.lang = cand.lang AND sub.s = cand.g WHERE m IS NULL OR 100 * m < {COVERS} * a),
cut AS (SELECT x.lang, x.g, x.a, i, l.a AS l, r.a AS r, (({SCALE}::HUGEINT * x.a) // (l.a + r.a))::BIGINT AS score
  FROM (SELECT kept.*, i, g[1:i] AS gl, g[i + 1:] AS gr FROM kept, range(1, {LONGEST}) t(i) WHERE i < k) x
  JOIN c l ON l.lang = x.lang AND l.g = x.gl JOIN c r ON r.lang = x.lang AND r.g = x.gr),
best AS (SELECT *, array_to_string(g, ' ') AS phrase FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, i) = 1)
SELECT best.lang, (row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, phrase))::BIGINT AS rank, phrase, a, l, r, n, score
FROM best JOIN n ON n.lang = best.lang QUALIFY rank <= {TOP}"""


@register("op12_phrases", SQL)
def op12_phrases(spark, sf_dir):
    return mine(table(spark, sf_dir, "documents"))
