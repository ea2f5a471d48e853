import hashlib

import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import table
from twinvec.llm.bpe import codec, decode, encode

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
#: Letters, digits, marks and blanks that old and new versions of Unicode class alike.
CHARS = st.sampled_from(list("abe thn'sred,.0 \n\t\r\x0b\x1c\x85éßñ日本語½Ⅷ́​👍🏽_-$") + ["<|endoftext|>", "the", " and", "'re", "  ", "aaaa", "\n\n"])


@given(st.lists(CHARS, max_size=40).map("".join))
@settings(max_examples=400, deadline=None)
def test_ids_and_round_trip_equal_the_library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    got = codec(PATH).encode(pa.array([text]))
    assert got[0].as_py() == ids
    assert codec(PATH).decode(got)[0].as_py() == LIBRARY.decode(ids, skip_special_tokens=False) == text


@given(st.lists(st.integers(0, 50256), max_size=30))
@settings(max_examples=200, deadline=None)
def test_decoding_of_any_ids_equals_the_library(ids):
    assert codec(PATH).decode(pa.array([ids], pa.list_(pa.int32())))[0].as_py() == LIBRARY.decode(ids, skip_special_tokens=False)


def test_columns_with_nulls_long_and_empty_texts(spark):
    texts = [None, "", "plain text", "a" * 200_000, "x<|endoftext|>y", "plain text"]
    d = table(spark, texts).withColumn("ids", F.lit("clash"))
    got = d.select("doc_id", encode("text", PATH).alias("i")).select("doc_id", "i", decode("i", PATH).alias("t")).orderBy("doc_id").collect()
    for row, text in zip(got, texts):
        assert row["i"] == LIBRARY.encode(text or "", add_special_tokens=False).ids
        assert row["t"] == (text or "")
    assert table(spark, []).select(encode("text", PATH)).collect() == []


def test_unknown_and_null_ids_decode_to_nothing(spark):
    d = spark.createDataFrame([(1, [15496, 99999999, -5, None]), (2, None)], "k long, ids array<int>")
    assert [r[0] for r in d.orderBy("k").select(decode("ids", PATH)).collect()] == ["Hello", ""]


def test_query_digests(spark):
    from twinvec.llm.bpe import op1_bpe

    rows = {r["doc_id"]: r for r in op1_bpe(spark, "/root/testdata/sf0.001").collect()}
    for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = LIBRARY.encode(d["text"] or "", add_special_tokens=False).ids
        r = rows[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
