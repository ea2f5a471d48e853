"""Texts that become numbers where they lie: the same rows as the joins of tokens, and no text under an exchange."""

import random
import re

import pytest
from pyspark.sql import functions as F

from twinvec.operators import corpus as C
from twinvec.operators import joins as J
from twinvec.operators import ordering as O
from twinvec.operators import tagging as T


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(4)
    word = lambda: r.choice(["The", "cat.", "sat,", "on", "UNK", "é", "elephants"]) if r.random() < 0.6 else f"w{r.randrange(200)}"
    texts = {i * 3 + (50_000 if i > 80 else 0): " ".join(word() for _ in range(r.choice([0, 0, 1, 5, 40]))) for i in range(120)}
    texts[1] = None
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)


def rows(df):
    return sorted(tuple(x) for x in df.collect())


def test_encoded_documents_equal_the_join_of_tokens(spark, docs, monkeypatch):
    vocab = C.build_vocab(None, 2, C.text_word_counts(docs))
    want = rows(C.encode(C.documents_tokens(docs), vocab))
    assert rows(C.encode_documents(docs, vocab)) == want and len(want) > 500
    monkeypatch.setattr(J, "MAX_LOOKUP_BYTES", 10)
    assert rows(C.encode_documents(docs, vocab)) == want
    assert C.encode_documents(docs.limit(0), vocab).count() == 0


def test_no_text_under_an_exchange(spark, docs):
    vocab = C.build_vocab(None, 2, C.text_word_counts(docs))
    texts = docs.select("doc_id", C.split_tokens("text").alias("w"))
    plan = J.lookup_arrays(texts, "w", vocab.where("word_id > 0"), "ids")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not re.search("Exchange (hash|range)", plan)


def test_next_tags_equal_the_shifted_join(spark, docs, monkeypatch):
    vocab = C.build_vocab(None, 2, C.text_word_counts(docs.select(F.lower("text").alias("text"))))
    some = vocab.where("word_id % 3 <> 1")
    tagged = T.rule_tags(C.documents_tokens(docs))
    for ids in (None, some):
        want = rows(T.next_tag_dataset(tagged, vocab, ids))
        assert rows(T.next_tag_documents(docs, vocab, ids)) == want and want
    monkeypatch.setattr(J, "MAX_LOOKUP_BYTES", 10)
    assert rows(T.next_tag_documents(docs, vocab, some)) == want
    assert T.next_tag_documents(docs.where("doc_id = 1"), vocab, some).count() == 0


@pytest.mark.parametrize("block,top", [(60, 5), (4096, 4096)])
def test_next_value(spark, block, top):
    r = random.Random(block)
    keys = r.sample(range(-200, 3000), 150)
    df = spark.createDataFrame([(k, f"v{k}") for k in keys], "k long, v string")
    got = {x["k"]: x["n"] for x in O.next_value(df, "k", "v", "n", block, top).collect()}
    keys.sort()
    assert got == {k: f"v{n}" if n is not None else None for k, n in zip(keys, keys[1:] + [None])}
    assert O.next_value(df.limit(0), "k", "v", "n", block, top).count() == 0


def test_few_texts_go_to_python_at_a_time(spark, docs, monkeypatch):
    vocab, seen, stored = C.build_vocab(None, 2, C.text_word_counts(docs)), [], J.checkpoint
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    monkeypatch.setattr(J, "checkpoint", lambda df: seen.append(int(spark.conf.get(key))) or stored(df))
    C.encode_documents(docs, vocab)
    T.next_tag_documents(docs, vocab)
    assert seen == [J.ARRAYS_AT_ONCE] * 2 and spark.conf.get(key) == before


def test_the_vocabulary_alone_encodes_no_tokens(spark, tmp_path, monkeypatch):
    from twinvec.plans import inputs

    spark.createDataFrame([(i, "a b c a b. " * 20) for i in range(5)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    with monkeypatch.context() as m:
        m.setattr(inputs.C, "encode_documents", lambda *a: 1 / 0)
        words = rows(inputs.vocab(spark, str(tmp_path)))
    assert words == rows(inputs.corpus(spark, str(tmp_path))[1]) and len(words) == 5


def test_tags_travel_as_bytes(spark):
    df = spark.createDataFrame([(1, ["X", None, "Y", "X"]), (2, []), (3, None)], "d long, t array<string>")
    coded, back = J.coded(df, "t")
    assert coded.schema["t"].dataType.simpleString() == "array<tinyint>"
    assert rows(coded.select("d", F.transform("t", back).alias("t"))) == rows(df)
    many = spark.createDataFrame([(1, [str(i) for i in range(J.MOST_CODES + 1)])], "d long, t array<string>")
    coded, back = J.coded(many, "t")
    assert rows(coded.select("d", F.transform("t", back).alias("t"))) == rows(many)


def test_a_large_vocabulary_is_asked_by_blocks(spark, docs, monkeypatch):
    """No word passes the driver and no token is joined; the rows are those of the small vocabulary's plan."""
    vocab = C.build_vocab(None, 2, C.text_word_counts(docs))
    texts, table = docs.select("doc_id", C.split_tokens("text").alias("w")), vocab.where("word_id > 0").select("word", "word_id")
    want = rows(J.lookup_arrays(texts, "w", table, "ids"))
    monkeypatch.setattr(J, "MAX_LOOKUP_BYTES", 10)
    for most in (1, 50, 1 << 20):  # a block a batch, some, one a task
        monkeypatch.setattr(J, "WORDS_ASKED", most)
        out = J.lookup_arrays(texts, "w", table, "ids")
        stored = out.made_from.stored_at
        assert rows(out) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate posexplode(_asked" in plan and "MapInArrow" not in plan  # the blocks were stored before
    from twinvec.session import checkpoint
    J.stored_arrays(out)
    fs = spark._jvm.org.apache.hadoop.fs.Path(stored)
    assert not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)
    encoded = rows(C.encode(C.documents_tokens(docs), vocab))
    monkeypatch.setattr(C, "MAX_BROADCAST_BYTES", 10)
    assert rows(C.encode_documents(docs, vocab)) == encoded
    monkeypatch.setattr(J, "MOST_RUNS", 1)
    assert rows(C.encode_documents(docs, vocab)) == encoded


def test_broadcasts_are_bounded_by_bytes(spark, monkeypatch):
    big, small = spark.range(100).selectExpr("id % 7 word_id"), spark.range(7).selectExpr("id word_id", "repeat('x', 1000) word")
    want = rows(J.lookup_join(big, small, "word_id"))
    monkeypatch.setattr(J, "MAX_BROADCAST_BYTES", 7 * J.ROW_BYTES + 6999)
    out = J.lookup_join(big, small, "word_id")
    assert "_salt" in out._jdf.queryExecution().toString() and rows(out) == want


def test_reports_send_only_words_with_vectors(spark, monkeypatch):
    """the table of words that is joined has no more rows than there are vectors."""
    from twinvec.operators import neighbors as N
    vocab = spark.range(500).selectExpr("id word_id", "concat('w', id) word", "500 - id freq")
    emb = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i), 2.0]) for i in range(20)], "word_id long, vec array<float>")
    sent, join = [], N.lookup_join
    monkeypatch.setattr(N, "lookup_join", lambda big, small, key: sent.append(small.count()) or join(big, small, key))
    report = N.neighbor_report(emb, vocab, emb.selectExpr("word_id q"), 3)
    assert sent == [20] and all(r["word"] == f"w{r['word_id']}" for r in report.collect())


def test_batches_are_numbered_without_their_pairs(spark):
    """F8 (neg_shared)."""
    from twinvec.params import Word2VecParams
    for n, size in ((2003, 50), (16_100, 1000), (5, 10), (40, 1), (0, 10)):
        kept, params = spark.range(n).selectExpr("id k", "id % 9 word_id"), Word2VecParams(window_size=3, sentence_size=size)
        want = C.pair_stream(kept, 3, 16, True, 42, 1, size, ["batch_id"]).distinct()
        out = C.stream_batches(kept, params, 1)
        assert rows(out) == rows(want) and "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
