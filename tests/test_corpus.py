import pytest
from pyspark.sql import functions as F

from twinvec.operators import corpus as C
from twinvec.params import Word2VecParams


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_vocab_ids_ties_and_unk(spark):
    docs = _docs(spark, ["the cat sat on the mat", "the dog sat", "a cat ran"])
    toks = C.documents_tokens(docs)
    vocab = {r["word"]: (r["word_id"], r["freq"]) for r in C.build_vocab(toks, min_count=2).collect()}
    # the:3, sat:2, cat:2 -> ties broken by word; rare words fold into UNK (id 0).
    assert vocab["the"] == (1, 3)
    assert vocab["cat"] == (2, 2) and vocab["sat"] == (3, 2)
    assert vocab["UNK"] == (0, 12 - 7)


def test_positions_follow_document_order(spark):
    docs = spark.createDataFrame([(5, "x y"), (2, "a b c"), (9, "z")], "doc_id long, text string").repartition(3)
    got = [r["word"] for r in C.documents_tokens(docs).orderBy("g").collect()]
    assert got == ["a", "b", "c", "x", "y", "z"]


def test_unk_literal_shadowing(spark):
    docs = _docs(spark, ["UNK UNK UNK UNK UNK rare other"])
    toks = C.documents_tokens(docs)
    vocab = C.build_vocab(toks, min_count=5)
    rows = {(r["word_id"], r["word"]) for r in vocab.collect()}
    assert (0, "UNK") in rows and (1, "UNK") in rows
    enc = C.encode(toks, vocab)
    ids = [r["word_id"] for r in enc.orderBy("g").collect()]
    assert ids == [1, 1, 1, 1, 1, 0, 0]


def test_too_little_data():
    with pytest.raises(ValueError):
        C.check_enough_data(49, 5)
    C.check_enough_data(50, 5)


def _brute_pairs(ids, window, size=1000):
    out = []
    for start in range(0, len(ids), size):
        sent = ids[start:start + size]
        for i in range(len(sent)):
            for j in range(max(0, i - window), min(len(sent), i + window + 1)):
                if j != i:
                    out.append((sent[i], sent[j]))
    return sorted(out)


def test_fixed_pairs_match_brute_force_across_partitions(spark):
    words = [f"w{i % 7}" for i in range(2500)]
    docs = _docs(spark, [" ".join(words[i:i + 300]) for i in range(0, 2500, 300)]).repartition(5)
    params = Word2VecParams(min_count=1, subsample=0.0, window_size=2)
    toks, vocab, enc, total = C.prepare_corpus(docs, params)
    prs = C.epoch_pairs(enc, total, params, 0, dynamic=False)
    got = sorted((r["input_id"], r["label_id"]) for r in prs.collect())
    ids = [r["word_id"] for r in enc.orderBy("g").collect()]
    assert got == _brute_pairs(ids, 2)


def test_dynamic_pairs_have_no_self_pairs_and_respect_width(spark):
    docs = _docs(spark, [" ".join(f"t{i}" for i in range(3000))])
    params = Word2VecParams(min_count=1, subsample=0.0, window_size=5)
    toks, vocab, enc, total = C.prepare_corpus(docs, params)
    prs = C.epoch_pairs(enc, total, params, 0, dynamic=True)
    bad = prs.where((F.col("i") == F.col("j")) | (F.abs(F.col("i") - F.col("j")) > 5) |
                    (F.col("j") < 0) | (F.col("j") >= 1000)).count()
    assert bad == 0
    assert prs.count() > 0


def test_subsample_keep_rate(spark):
    docs = _docs(spark, ["the " * 2000 + " ".join(f"u{i}" for i in range(2000))])
    params = Word2VecParams(min_count=1, subsample=1e-3)
    toks, vocab, enc, total = C.prepare_corpus(docs, params)
    kept = C.subsample(enc, total, params, 0)
    the_id = vocab.where(F.col("word") == "the").first()["word_id"]
    n_the = kept.where(F.col("word_id") == the_id).count()
    p = ((2000 / (1e-3 * 4000)) ** 0.5 + 1) * (1e-3 * 4000) / 2000
    sd = (2000 * p * (1 - p)) ** 0.5
    assert abs(n_the - 2000 * p) < 4 * sd + 1


def test_numbered_stream_is_the_pairs_in_order(spark):
    """The stream made group by group has the pairs of the window plan, numbered without gaps across groups."""
    kept = spark.range(40_321).selectExpr("id k", "id % 977 word_id").repartition(5)
    for dynamic in (True, False):
        got = C.pair_stream(kept, 3, 16, dynamic, 42, 1).orderBy("pair_idx").collect()
        want = C.pairs(kept, 3, dynamic, 42, 1).orderBy("k", "j").collect()
        assert [tuple(r[c] for c in ("sid", "i", "j", "k", "p", "input_id", "label_id")) for r in got] == \
            [tuple(r[c] for c in ("sid", "i", "j", "k", "p", "input_id", "label_id")) for r in want]
        assert [(r["pair_idx"], r["batch_id"]) for r in got] == [(n, n // 16) for n in range(len(got))]
    plan = C.pair_stream(kept, 3, columns=["batch_id"])
    assert plan.columns == ["batch_id"] and "Window [lag" not in plan._jdf.queryExecution().executedPlan().toString()


def test_counts_of_pairs_are_merged_from_packed_parts(spark, monkeypatch):
    """The counts equal those of the pair rows over many groups and buckets, and no join, window or row of a pair is in the plan."""
    monkeypatch.setattr(C, "SENTENCES_COUNTED", 2)
    monkeypatch.setattr(C, "PAIRS_MERGED", 500)
    rows = [(k, (k * k) % 11 if k % 3 else 0) for k in range(1003)]
    kept = spark.createDataFrame(rows, "k long, word_id long").repartition(7)
    for dynamic in (False, True):
        got = C.pair_counts(kept, 3, dynamic, 42, 1, sentence_size=50)
        want = C.pairs(kept, 3, dynamic, 42, 1, sentence_size=50).groupBy("input_id", "label_id").agg(F.count(F.lit(1)).alias("n"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Generate" not in plan
    assert C.pair_counts(kept.where("k < 1"), 3).collect() == [] and C.pair_counts(kept.where("k < 0"), 3).collect() == []
    numbers = [0, 1, 255, 256, 2 ** 40, 2 ** 62]
    import numpy as np
    assert C._unpack(C._pack(np.array(numbers)), 6).tolist() == numbers


def test_words_that_are_always_kept_draw_no_number(spark, monkeypatch):
    tokens = spark.createDataFrame([(g, g % 7, 3) for g in range(50)], "g long, word_id long, freq long")
    monkeypatch.setattr(C, "uniform", lambda *keys: F.raise_error(F.lit("drawn")).cast("double"))
    assert C.subsample(tokens, 100_000, Word2VecParams(), 0).count() == 50
