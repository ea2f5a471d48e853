"""Byte-pair encoding and decoding with the files of public tokenizers.

Encoding finds, for every prefix of a piece of text, the one token that ends the encoding of that prefix. An
automaton with suffix links reports every token that is a suffix of the prefix; of these, the one whose boundary to
the last token of the prefix before it survives the merges is the last token (there is exactly one). Following
these back-pointers from the whole piece gives the ids. The cost is linear in the length of a piece, so one very long
word does no harm.

A boundary between two tokens survives unless, at some time in the order of merges, the symbol at the right edge
of the left token and the symbol at the left edge of the right token would have been merged with each other.

Defined results: a null text is the empty text and has no ids; strings of special tokens in a text become their ids,
as the tokenizer files say; ids that are null decode to the empty text, unknown ids to nothing, bytes that are no UTF-8 to
U+FFFD. Only the given column is read, so other columns may have any name.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from twinvec.llm.registry import register, table
from twinvec.llm.workers import one_memo

# Blanks of the tokenizer's regular expressions, and its pattern of pieces.
_BLANK = "\t\n\x0b\x0c\r \x85\xa0  -     　"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANK}\p{{L}}\p{{N}}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
NEVER = 1 << 60
#: Pieces and words remembered by a Python worker, the longest of them, and ids decoded at once.
MEMO_PIECES, MEMO_WORDS, MEMO_CHARS, PART = 100_000, 800_000, 64, 1 << 18
CLOSING = frozenset(".,;:!?")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """One vocabulary file. Instances live in Python workers and on the driver; they hold the vocabulary only."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        self.bytes = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        self.verdicts: dict[int, bool] = {}
        known = {i for i, b in self.bytes.items() if len(b) == 1}
        for k, (a, b) in enumerate(merges):
            self.rank[vocab[a], vocab[b]] = k
        for k, (a, b) in enumerate(merges):  # a token counts if the merges rebuild it from its own bytes
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            if whole not in self.parts and left in known and right in known and self._meet(left, right) == k:
                self.parts[whole] = (left, right, k)
                known.add(whole)
        self.automaton = ahocorasick.Automaton()
        for i in known:
            self.automaton.add_word(self.bytes[i].decode("latin-1"), (i, len(self.bytes[i])))
        self.automaton.make_automaton()
        self.pieces = regex.compile(PIECES).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.odd = regex.compile(f"[{_BLANK.replace(' ', '', 1).replace(chr(10), '', 1)}]").search
        self.memo = _Memo(lambda piece: array("i", self.piece_ids(piece)).tobytes(), MEMO_PIECES)
        self.words = _Words(self._word, MEMO_WORDS, self.memo)
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        top = max(self.bytes) + 2  # one more, without bytes, stands for unknown ids
        size = np.array([len(self.bytes.get(i, b"")) for i in range(top)], dtype=np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes.get(i, b"") for i in range(top)), dtype=np.uint8)
        self.size, self.start = size, np.cumsum(size) - size

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Symbols at one edge of a token from the first byte to the whole, each with the merge that uses it up."""
        out, used = [], NEVER
        while True:
            out.append((token, used))
            if token not in self.parts:
                return out[::-1]
            used, token = self.parts[token][2], self.parts[token][side]

    def _meet(self, left: int, right: int) -> int:
        """The merge that crosses the boundary between two tokens, or -1."""
        a, b, i, j = self._edge(left, 1), self._edge(right, 0), 0, 0
        while True:
            (x, x_used), (y, y_used) = a[i], b[j]
            k = self.rank.get((x, y), NEVER)
            if k < x_used and k <= y_used and k != NEVER:  # equal merges go from left to right
                return k
            if x_used == y_used == NEVER:
                return -1
            if x_used <= y_used:
                i += 1
            else:
                j += 1

    def piece_ids(self, piece: str) -> list[int]:
        """Ids of one piece by the dynamic program over its prefixes."""
        data = piece.encode("utf-8").decode("latin-1")
        last, verdicts, done = [-1] * (len(data) + 1), self.verdicts, 0
        for end, (token, size) in self.automaton.iter(data):
            if end < done:
                continue
            if size <= end:
                pair = last[end + 1 - size] << 20 | token
                fits = verdicts.get(pair)
                if fits is None:
                    fits = verdicts[pair] = self._meet(last[end + 1 - size], token) < 0
                if not fits:
                    continue
            done = end + 1
            last[done] = token
        ids, at = [], len(data)
        while at:
            ids.append(last[at])
            at -= len(self.bytes[last[at]])
        return ids[::-1]

    def _stretch(self, text: str) -> bytes:
        """Ids of a text without special tokens, piece by piece."""
        return b"".join(map(self.memo.__getitem__, self.pieces(text)))

    def _word(self, word: str) -> bytes:
        """Ids of a word with the blank before it (a space, unless the word begins with a line feed)."""
        if word.isalpha():  # letters after a space are one piece
            return array("i", self.piece_ids(" " + word)).tobytes()
        return self._stretch(word if word[:1] == "\n" else " " + word)

    def _text(self, text: str) -> bytes:
        if self.cut is not None and any(t in text for t in self.special):
            return b"".join(np.int32(self.special[part]).tobytes() if part in self.special else self._stretch(part)
                            for part in self.cut.split(text))
        if not text or self.odd(text) or "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
            return self._stretch(text)
        # No piece goes from a visible character on to a blank, so a text with single blanks falls into words, each
        # with the blank before it. A word's key leaves out that blank if it is a space.
        first, *rest = text.replace("\n", " \n").split(" ")
        return self._stretch(first) + b"".join(map(self.words.__getitem__, rest))

    def encode(self, texts: pa.Array) -> pa.Array:
        rows = [self._text(t or "") for t in texts.to_pylist()]
        ends = np.cumsum([0] + [len(r) // 4 for r in rows])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), dtype=np.int32)))

    def _bytes(self, ids: np.ndarray) -> bytes:
        ids = np.where((ids < 0) | (ids >= len(self.size)), len(self.size) - 1, ids)
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()

    def decode(self, ids: pa.Array) -> pa.Array:
        ids = ids.fill_null([]) if ids.null_count else ids
        at = ids.offsets.to_numpy()
        flat = ids.values.fill_null(-1).to_numpy()
        out = []
        for lo, hi in zip(at[:-1], at[1:]):  # a long text in parts; a part may end inside a character
            data = b"".join(self._bytes(flat[k:min(k + PART, hi)]) for k in range(lo, hi, PART))
            out.append(data.decode("utf-8", "replace"))
        return pa.array(out, pa.string())


class _Memo(dict):
    """Ids of short texts seen before, as 32-bit numbers; emptied when full."""

    def __init__(self, ids, most: int):
        super().__init__()
        self.ids, self.most = ids, most

    def __missing__(self, text: str) -> bytes:
        ids = self.ids(text)
        if len(text) <= MEMO_CHARS:
            if len(self) >= self.most:
                self.clear()
            self[text] = ids
        return ids


class _Words(_Memo):
    """The same for words; one with closing punctuation after a letter, a piece of its own, is put together each time."""

    def __init__(self, ids, most: int, pieces: _Memo):
        super().__init__(ids, most)
        self.pieces = pieces

    def __missing__(self, word: str) -> bytes:
        if word[-1:] in CLOSING and word[-2:-1].isalpha():
            return self[word[:-1]] + self.pieces[word[-1]]
        return super().__missing__(word)


def codec(path: str) -> Codec:
    return one_memo(("codec", path), lambda: Codec(path))


def encode(text: Column | str, path: str) -> Column:
    """Ids of a text as ``array<int>``."""
    @arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        return codec(path).encode(texts)
    return ids(text)


def decode(ids: Column | str, path: str) -> Column:
    """The text of ids, special tokens included."""
    @arrow_udf("string")
    def text(rows: pa.Array) -> pa.Array:
        return codec(path).decode(rows)
    return text(ids)


@register("op1_bpe")
def op1_bpe(spark, sf_dir, path: str | None = None):
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    d = table(spark, sf_dir, "documents").select("doc_id", encode("text", path).alias("ids"))
    d = d.select("doc_id", "ids", decode("ids", path).alias("decoded"))
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                    F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                    F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
