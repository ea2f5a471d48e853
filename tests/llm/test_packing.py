import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import prose, table
from twinvec.llm.packing import Rooms, pack, pack_texts

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.lists(st.integers(1, 64), max_size=60))
def test_tournament_tree_finds_the_first_fit(sizes):
    tree, room = Rooms(max(1, len(sizes)), 64), [64] * len(sizes)
    for size in sizes:
        want = next(i for i, r in enumerate(room) if r >= size)
        room[want] -= size
        assert tree.take(size) == (want, room[want])


@given(st.lists(st.integers(1, 300), max_size=80))
@settings(max_examples=150, deadline=None)
def test_every_token_once_and_no_padding_but_powers_of_two(sizes):
    got = defaultdict(list)
    for seq in pack(sizes, 64):
        n = sum(p[2] for p in seq)
        assert n == 64 or (n < 64 and n & (n - 1) == 0)
        for d, start, length in seq:
            got[d].append((start, length))
    for d, n in enumerate(sizes):
        at = 0
        for start, length in sorted(got[d]):
            assert start == at and length > 0
            at += length
        assert at == n


def check(pieces, texts):
    tokenizer = Tokenizer.from_file(PATH)
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4") for i, t in texts.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    assert set(by_doc) == set(ids)
    for i, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[i])
            assert p["ids_crc32"] == zlib.crc32(ids[i][at:at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids[i])
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096


def test_texts_of_every_kind(spark):
    texts = dict(enumerate([None, "", "One two.\nThree  four", "word " * 30_000, "é" * 70_000, "İstanbul ΑΣ <|endoftext|> x"] + [prose(i, 50 * i) for i in range(1, 25)]))
    check(pack_texts(table(spark, list(texts.values())), PATH, group_docs=7).collect(), texts)


def test_repeated_rows_and_no_rows(spark):
    pieces = pack_texts(table(spark, ["a b c"] * 5, ids=[3] * 5), PATH).collect()
    assert sum(p["length"] for p in pieces) == 5 * 4
    assert pack_texts(table(spark, []), PATH).collect() == []


def test_query(spark):
    from twinvec.llm.packing import op5_packing

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    check(op5_packing(spark, "/root/testdata/sf0.001").collect(), {r["doc_id"]: r["text"] for r in d})


def test_ids_equal_the_librarys_on_random_texts():
    """Letters that normalizing takes apart or puts together, marks, digits and punctuation in any order."""
    import random

    from twinvec.llm.packing import words

    tokenizer, own = Tokenizer.from_file(PATH), words(PATH)
    letters = list("aZkI") + ["é", "É", "İ", "ı", "ß", "ǆ", "ﬁ", "क", "़", "क़", "ñ", "ñ", "Å", "Å", "ª", "µ", "ÿ", "Ω", "한", "中", "ー", "Ａ", "́", "̇",
                             "‍", "\xa0", "日", "́a"]
    marks = list(".,;:!?'\"()-_&%$#@/\\0179 \n\t") + ["…", "。", "’", "½", "²", " "]
    r = random.Random(8)
    for n in range(20_000):
        text = "".join(r.choice(letters if r.random() < 0.6 else marks) for _ in range(r.randrange(1, 14)))
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.ids(text), dtype=own.kind).tolist() == want, (n, text)
    for text in ("BİTTİ.", "İ!", "日İ:", "क़:", "İstanbul ΑΣ."):
        assert np.frombuffer(own.ids(text), dtype=own.kind).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_a_workers_memo_goes_with_the_next_operator():
    from twinvec.llm import workers

    built = []
    assert workers.one_memo("first", lambda: built.append(1) or "a") == "a" and workers.one_memo("first", lambda: built.append(1) or "b") == "a"
    workers.lean()
    assert workers.per_process("memos", dict) == {}
    workers.one_memo("first", lambda: "c"), workers.one_memo("second", lambda: "d")
    assert workers.per_process("memos", dict) == {"second": "d"}
    workers.lean()
