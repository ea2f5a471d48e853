"""Substring dedup: words of passages that occur earlier are removed, located by phrase automata.

1. Every window of ``window`` words is hashed; blocks of documents send each different window once to a shard of the
   windows, with the smallest document that has it. The shard confirms the windows that recur and answers, in one bit
   each, whether the window recurs and whether an earlier document of another block has it.
2. Each block is a shard of automata: from the windows that recur in it, phrases of ``phrase`` words are chosen so that
   every one of them holds a phrase (the smallest phrase hash in the window), and compiled by pyahocorasick over the
   block's own words. The phrases are found as words, but what is removed is decided by the hashes of step 1.
3. The automaton streams every document of its block and reports each place of a phrase. The windows around a place are
   looked up in the confirmed ones; a window that also starts earlier removes its words.

A shard gets one entry for each block that has a window, however often it occurs there, and answers in bits; so a
passage that a third of all documents share costs no more than one in each block.

Windows are compared by 64-bit hashes of 64-bit word hashes; among N different windows the expected number of false
pairs is N * N / 2**65. Defined results: a null text has no words; texts shorter than a window are unchanged; a null id sorts
first; rows of one id in different blocks come in the order of their blocks; extra columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinvec.llm import shingles as S
from twinvec.llm.registry import register, table

WINDOW, PHRASE = 20, 10


class _Windows:
    """The windows of a block's documents, taken in order of id."""

    def __init__(self, batch: pa.RecordBatch, window: int):
        self.ids = S.ids(batch)
        self.order = np.argsort(self.ids, kind="stable")
        self.batch = batch.take(pa.array(self.order))
        data, ends = S.flat(self.batch["text"])
        self.hashes, self.counts = S.words(data, ends)
        self.start = S.inside(self.counts, window)
        self.key = S.windows(self.hashes, window)[self.start]
        # Each different window once, at its first place; a stable sort keeps the order of places.
        by_key = np.argsort(self.key, kind="stable")
        new = np.ones(len(by_key), dtype=bool)
        new[1:] = self.key[by_key][1:] != self.key[by_key][:-1]
        self.first = np.sort(by_key[new])
        self.by_key, self.new = by_key, new

    def asked(self, shards: int):
        """Shard, and positions in ``first``, of the windows each shard is asked for."""
        home = (self.key[self.first] & np.uint64(shards - 1)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        cuts = np.searchsorted(home[order], np.arange(shards + 1))
        return [(s, order[cuts[s]:cuts[s + 1]]) for s in np.flatnonzero(np.diff(cuts))]


def recurring(blocks: DataFrame, shards: int, window: int) -> DataFrame:
    """``block, shard, again, later``: packed bits for the windows that a block asked the shard for."""
    def ask(batches):
        for b in batches:
            for block, cell in zip(b["block"].to_pylist(), b["docs"]):
                w = _Windows(S.unpack(cell), window)
                owner = np.repeat(w.ids[w.order], w.counts)[w.start][w.first]
                key = w.key[w.first]
                rows = w.asked(shards)
                docs = []
                for _, r in rows:  # ids in runs: the windows are in order of documents
                    own = owner[r]
                    edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                    docs.append(np.concatenate([own[edge], np.diff(np.append(edge, len(own)))]).astype(np.int64).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s for s, _ in rows], pa.int64()), pa.array([block] * len(rows), pa.int64()),
                     pa.array([key[r].tobytes() for _, r in rows], pa.binary()), pa.array(docs, pa.binary())],
                    names=["shard", "block", "keys", "docs"])

    def answer(t):
        t = t.sort_by("block")
        keys = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in t["keys"]]
        every, ends = np.concatenate(keys), np.cumsum([len(k) for k in keys])
        order = np.argsort(every, kind="stable")
        same = every[order][1:] == every[order][:-1]
        again = np.zeros(len(every), dtype=bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        runs = [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in t["docs"]]
        doc = np.concatenate([np.repeat(r[:len(r) // 2], r[len(r) // 2:]) for r in runs])
        many = np.flatnonzero(again)
        many = many[np.lexsort((many, doc[many], every[many]))]  # by window, then document, then block
        later = np.zeros(len(every), dtype=bool)
        later[many[1:][every[many][1:] == every[many][:-1]]] = True
        bits = lambda x: pa.array([np.packbits(p).tobytes() for p in np.split(x, ends[:-1])], pa.binary())
        return pa.table({"block": t["block"], "shard": t["shard"], "again": bits(again), "later": bits(later)})

    asked = blocks.select("block", "docs").mapInArrow(ask, "shard long, block long, keys binary, docs binary")
    return asked.groupBy("shard").applyInArrow(answer, "block long, shard long, again binary, later binary")


def phrase_automaton(w: _Windows, again: np.ndarray, texts: list[list[bytes]], window: int, phrase: int):
    """The automaton of the phrases chosen in the windows marked ``again`` and the code of each of their words, or None."""
    import ahocorasick

    marked = w.start[again]
    if not len(marked):
        return None
    grams = S.windows(w.hashes, phrase)
    span = window - phrase + 1
    chosen = []
    for at in range(0, len(marked), 1 << 16):  # the place of the smallest phrase hash in each marked window
        part = marked[at:at + (1 << 16)]
        chosen.append(part + np.lib.stride_tricks.sliding_window_view(grams, span)[part].argmin(axis=1))
    chosen = np.unique(np.concatenate(chosen))
    _, one = np.unique(grams[chosen], return_index=True)
    ends = np.cumsum(w.counts)
    codes, automaton = {}, ahocorasick.Automaton()
    for at in chosen[one]:
        doc = int(np.searchsorted(ends, at, side="right"))
        i = int(at - (ends[doc] - w.counts[doc]))
        automaton.add_word("".join([codes[x] if x in codes else _code(codes, x) for x in texts[doc][i:i + phrase]]), 1)
    automaton.make_automaton()
    return automaton, codes


def _code(codes: dict, word: bytes) -> str:
    """Three characters for each word, each from 128 of its own, so that no node of the automaton has many children and
    matches begin at words. Should a very long text use up the codes, they serve again; that only adds places, and
    every place is looked up in the confirmed windows."""
    n = len(codes) % (1 << 21)
    code = chr(0x100 + (n >> 14)) + chr(0x200 + (n >> 7 & 127)) + chr(0x300 + (n & 127))
    codes[word] = code
    return code


def removed_words(blocks: DataFrame, shards: int, columns: list[tuple[str, str]], respace: bool, window: int = WINDOW,
                  phrase: int = PHRASE) -> DataFrame:
    """``columns`` of the blocks with the words that stay, and ``n_words, n_removed``, for every row. ``columns``: (name, type)."""
    names = [c for c, _ in columns]

    def run(docs, answers):
        w = _Windows(S.unpack(docs["docs"][0]), window)
        again_first, later_first = np.zeros((2, len(w.first)), dtype=bool)
        got = {s: (a, b) for s, a, b in zip(answers["shard"].to_pylist(), answers["again"], answers["later"])}
        for s, r in w.asked(shards):
            for bits, into in zip(got[s], (again_first, later_first)):
                into[r] = np.unpackbits(np.frombuffer(bits.as_buffer(), dtype=np.uint8), count=len(r)).astype(bool)
        # From the first place of each window in the block to all of them; places after the first are repeats.
        number = np.empty(len(w.key), dtype=np.int64)
        number[w.by_key] = np.cumsum(w.new) - 1
        times = np.bincount(number) if len(number) else np.empty(0, dtype=np.int64)
        at_first, again, later = np.zeros(len(w.key), dtype=bool), np.empty(len(times), dtype=bool), np.empty(len(times), dtype=bool)
        at_first[w.first] = True
        again[number[w.first]], later[number[w.first]] = again_first, later_first
        again = (again | (times > 1))[number] if len(times) else at_first
        later = later[number] | ~at_first if len(times) else at_first
        texts = [(t or "").encode().split() for t in w.batch["text"].to_pylist()]
        # Where windows start: confirmed (1) and to be removed (2), by place among the block's words.
        confirmed = np.zeros(len(w.hashes) + 1, dtype=np.int8)
        confirmed[w.start[again]] = 1
        confirmed[w.start[again & later]] = 2
        built = phrase_automaton(w, again & at_first, texts, window, phrase)
        cut = np.zeros(len(w.hashes) + 1, dtype=np.int64)
        base = 0
        for words in texts if built else []:
            automaton, codes = built
            if len(words) >= window:
                code = "".join([codes.get(x, "---") for x in words])
                places = np.fromiter((e for e, _ in automaton.iter(code)), dtype=np.int64) // 3 - (phrase - 1)
                if len(places):
                    near = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(near, np.maximum(0, places - (window - phrase)), 1)
                    np.add.at(near, places + 1, -1)
                    hit = base + np.flatnonzero((np.cumsum(near)[:-1] > 0) & (confirmed[base:base + len(words)] == 2))
                    np.add.at(cut, hit, 1)
                    np.add.at(cut, hit + window, -1)
            base += len(words)
        gone = np.cumsum(cut)[:-1] > 0
        rows, base = [], 0
        for words in texts:
            lost = gone[base:base + len(words)]
            base += len(words)
            n = int(lost.sum())
            kept = words if not n else [x for x, y in zip(words, lost) if not y]
            rows.append((len(words), n, b" ".join(kept) if n or respace else None))
        text = pa.array([r[2] for r in rows], pa.binary()).cast(pa.string())
        own = {c: w.batch[c] for c in names} | {"text": text if respace else pa.compute.coalesce(text, w.batch["text"])}
        return pa.table(own | {"n_words": pa.array([r[0] for r in rows], pa.int64()), "n_removed": pa.array([r[1] for r in rows], pa.int64())})

    answers = recurring(blocks, shards, window)
    return (blocks.select("block", "docs").groupBy("block").cogroup(answers.groupBy("block"))
            .applyInArrow(run, ", ".join(f"`{c}` {t}" for c, t in [*columns, ("n_words", "long"), ("n_removed", "long")])))


def dedup(docs: DataFrame, respace: bool = False, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """``docs`` with repeated words removed from ``text``, plus ``n_words`` and ``n_removed`` (these replace columns of that name).

    What stays of a text is joined by single spaces; a text that loses nothing is left as it is, unless ``respace``.
    """
    columns = [(c, t) for c, t in docs.dtypes if c not in ("n_words", "n_removed")]
    blocks = S.pack_blocks(docs, [c for c, _ in columns])
    return removed_words(blocks, S.shards_for(blocks), columns, respace, window, phrase)


SQL = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r WHERE n > 1),
a AS (SELECT doc_id, p, ws[p] AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
k AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM a ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)"""


@register("op8_substring_dedup", SQL)
def op8_substring_dedup(spark, sf_dir):
    d = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), respace=True)
    return d.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
