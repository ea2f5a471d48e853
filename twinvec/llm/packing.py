"""Packing of tokenized documents into sequences of a fixed length with little padding.

Documents are dealt at random into groups of about ``group_docs``. In each group a document longer than a sequence
is cut into full sequences, and the rest of it is packed by first-fit decreasing: the rests are taken from the longest
to the shortest, each into the first sequence with room for it. A tournament tree holds the room of every
sequence, an inner node that of the roomiest one below it, so the first fit is found by going down once. At last
the emptiest sequences are cut up to fill the gaps of the others; the one that stays partly filled is cut into
lengths that are powers of two, which need no padding.

Defined results: a null text is empty and still has the closing id; repeated rows are packed as often as they occur; an
empty table gives no pieces; ids and names of other columns are not looked at. Groups are bounded by the number
of documents, and hot values of any column do not matter, since rows are dealt by a hash of id, ids and place in the input.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinvec.llm.bpe import byte_alphabet
from twinvec.llm.registry import register, table
from twinvec.llm.workers import one_memo

LENGTH, CLOSING_ID, GROUP_DOCS = 4096, 2, 2048
#: Pieces of text remembered by a Python worker, and the longest of them.
MEMO_PIECES, MEMO_CHARS = 1_200_000, 64
PIECE_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


class _Words(dict):
    """Ids of stretches between blanks, as the tokenizers library gives them; emptied when full."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.kind = np.dtype(self.code)
        self.model, self.alphabet = self.tokenizer.model, {b: c for c, b in byte_alphabet().items()}
        self[""] = b""

    def __missing__(self, word: str) -> bytes:
        """Two kinds of words are put together from shorter ones: the tokenizer takes capital letters as small ones, and
        closing punctuation after a letter is a piece of its own. The letter has to be one that normalizing leaves alone: of a
        letter that becomes a letter and a mark, the mark and the punctuation are one piece."""
        if "A" <= word[0] <= "Z":
            ids = self[word[0].lower() + word[1:]]
        elif word[-1] in ".,;:!?" and word[-2:-1].isascii() and word[-2:-1].isalpha():
            ids = self[word[:-1]] + self[word[-1]]
        elif max(word) < "\u0100" and word.isalpha() and word.islower():  # one piece that normalizing leaves as it is
            piece = word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(self.alphabet)
            ids = array(self.code, [t.id for t in self.model.tokenize(piece)]).tobytes()
        else:
            ids = array(self.code, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_PIECES:
                self.clear()
                self[""] = b""
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """No piece of this tokenizer reaches over a space or a line feed, so each stretch is encoded by itself."""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def words(path: str) -> _Words:
    return one_memo(("words", path), lambda: _Words(path))


def tokenize(docs: DataFrame, path: str, closing_id: int = CLOSING_ID) -> DataFrame:
    """``doc_id, ids, place``: the ids of every whole text with the closing id, as little-endian numbers of the
    vocabulary's width (2 or 4 bytes), and a random number that depends on row and place."""
    def run(batches):
        from pyspark import TaskContext

        known, n = words(path), TaskContext.get().partitionId() << 40
        end = np.array([closing_id], dtype=known.kind).tobytes()
        for b in batches:
            ids = [known.ids(t or "") + end for t in b["text"].to_pylist()]
            place = [zlib.crc32((n + i).to_bytes(8, "little"), zlib.crc32(x)) for i, x in enumerate(ids)]
            n += len(ids)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(ids, pa.binary()), pa.array(place, pa.int64())],
                                             names=["doc_id", "ids", "place"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary, place long")


class Rooms:
    """Tournament tree of the room in ``n`` sequences."""

    def __init__(self, n: int, length: int):
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.room = [length] * (2 * self.leaves)

    def take(self, size: int) -> tuple[int, int]:
        """Put ``size`` into the first sequence with room; its number and what it held before is up to the caller."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        found, left = at - self.leaves, room[at] - size
        room[at] = left
        while at > 1:
            at //= 2
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
        return found, left


def pack(sizes: list[int], length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces ``(document, start, length)`` for documents of the given sizes."""
    full = [[(d, s, length)] for d, n in enumerate(sizes) for s in range(0, n - length + 1, length)]
    rest = sorted(((n % length, d) for d, n in enumerate(sizes) if n % length), key=lambda x: (-x[0], x[1]))
    tree, bins = Rooms(len(rest), length), []
    for size, d in rest:
        at, _ = tree.take(size)
        if at == len(bins):
            bins.append([])
        bins[at].append((d, sizes[d] - size, size))
    fill = lambda b: sum(p[2] for p in b)
    full += [b for b in bins if fill(b) == length]
    part = sorted((b for b in bins if fill(b) < length), key=fill, reverse=True)
    while len(part) > 1:
        into, gap = part[0], length - fill(part[0])
        while gap and len(part) > 1:  # cut from the end of the emptiest
            d, s, n = part[-1].pop()
            cut = min(n, gap)
            into.append((d, s + n - cut, cut))
            if n > cut:
                part[-1].append((d, s, n - cut))
            elif not part[-1]:
                part.pop()
            gap -= cut
        if not gap:
            full.append(part.pop(0))
    for b in part:
        left, at = fill(b), 0
        run = [(d, s + i, 1) for d, s, n in b for i in range(n)]
        while left:
            size = 1 << (left.bit_length() - 1)
            seq = []
            for d, s, _ in run[at:at + size]:
                if seq and seq[-1][0] == d and seq[-1][1] + seq[-1][2] == s:
                    seq[-1] = (d, seq[-1][1], seq[-1][2] + 1)
                else:
                    seq.append((d, s, 1))
            full.append(seq)
            at, left = at + size, left - size
    return full


def pack_documents(tokens: DataFrame, n_docs: int, width: int, length: int = LENGTH, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Pieces of the documents of ``tokenize``; ``n_docs`` sets the number of groups, ``width`` is the bytes of an id."""
    groups = max(1, -(-n_docs // group_docs))

    def run(key, t):
        group = key[0].as_py()
        t = t.sort_by([("place", "ascending"), ("doc_id", "ascending")])
        doc = t["doc_id"].to_pylist()
        ids = [np.frombuffer(x.as_buffer(), dtype=f"<u{width}") for x in t["ids"]]
        sizes = [len(x) for x in ids]
        rows = []
        for k, seq in enumerate(pack(sizes, length)):
            at = 0
            for d, s, n in seq:
                rows.append((doc[d], s, n, zlib.crc32(ids[d][s:s + n].astype("<u4").tobytes()), sizes[d], (group << 32) + k, at))
                at += n
        names = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]
        return pa.table({c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(names)})

    g = tokens.withColumn("g", F.pmod(F.xxhash64("doc_id", "place"), F.lit(groups)))
    return g.groupBy("g").applyInArrow(run, PIECE_SCHEMA)


def pack_texts(docs: DataFrame, path: str, length: int = LENGTH, closing_id: int = CLOSING_ID,
               group_docs: int = GROUP_DOCS) -> DataFrame:
    return pack_documents(tokenize(docs, path, closing_id), docs.count(), words(path).kind.itemsize, length, group_docs)


@register("op5_packing")
def op5_packing(spark, sf_dir, path: str | None = None):
    import public_tokenizers

    return pack_texts(table(spark, sf_dir, "documents"), path or public_tokenizers.path("word_bpe_49k.json"))
