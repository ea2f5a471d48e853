import random

from pyspark.sql import functions as F

from twinvec.functions.text import parse_word_list, split_tokens
from twinvec.operators.ordering import dense_prefix, ordered_prefix, row_number_global


def test_tokenizer_ascii_blanks_only(spark):
    text = "a b\tc\nd\x0be\x0cf\rg  h i"
    got = spark.createDataFrame([(text,)], "t string").select(split_tokens("t").alias("w")).first()["w"]
    assert got == ["a", "b", "c", "d", "e", "f", "g", "h i"]


def test_tokenizer_empty_and_null(spark):
    rows = spark.createDataFrame([("   ",), (None,)], "t string").select(split_tokens("t").alias("w")).collect()
    assert [r["w"] for r in rows] == [[], []]


def test_parse_word_list(spark):
    df = spark.createDataFrame([("Dog",), ("Dog, Cat ,BIRD",), ("new york",)], "t string")
    got = [r["w"] for r in df.select(parse_word_list("t").alias("w")).collect()]
    assert got == [["dog"], ["dog", "cat", "bird"], ["new york"]]


def test_prefix_sums_match_brute_force(spark):
    rnd = random.Random(3)
    keys = rnd.sample(range(10_000), 500)
    rows = [(k, rnd.randint(0, 9)) for k in keys]
    df = spark.createDataFrame(rows, "k long, w long").repartition(7)
    expect, run = {}, 0
    for k, w in sorted(rows):
        expect[k] = run
        run += w
    got = {r["k"]: r["p"] for r in ordered_prefix(df, [F.col("k").asc()], {"p": F.col("w")}, n_parts=5).collect()}
    assert got == expect
    got2 = {r["k"]: r["p"] for r in dense_prefix(df, "k", {"p": F.col("w")}, block=128).collect()}
    assert got2 == expect


def test_row_number_global_with_desc_order(spark):
    rows = [("b", 3), ("a", 3), ("c", 5), ("d", 1)]
    df = spark.createDataFrame(rows, "word string, freq long")
    got = {r["word"]: r["rn"] for r in row_number_global(df, [F.col("freq").desc(), F.col("word").asc()], "rn").collect()}
    assert got == {"c": 1, "a": 2, "b": 3, "d": 4}


def test_salted_lookup_equals_broadcast(spark):
    from twinvec.operators.joins import lookup_join
    big = spark.createDataFrame([(i, f"w{i % 13}") for i in range(2000)] + [(5000 + i, "hot") for i in range(3000)],
                                "g long, word string")
    small = spark.createDataFrame([(f"w{i}", i + 1) for i in range(10)] + [("hot", 99)], "word string, word_id long")
    a = sorted(tuple(r) for r in lookup_join(big, small, "word").select("g", "word", "word_id").collect())
    b = sorted(tuple(r) for r in lookup_join(big, small, "word", max_broadcast_rows=0, salt=8)
               .select("g", "word", "word_id").collect())
    assert a == b and len(a) == 5000


def test_key_prefix_dense_and_sparse_keys(spark):
    from twinvec.operators.ordering import key_prefix
    rnd = random.Random(5)
    for keys in (list(range(100, 900)), rnd.sample(range(1 << 60), 800)):
        rows = [(k, rnd.randint(1, 5)) for k in keys]
        df = spark.createDataFrame(rows, "k long, w long").repartition(6)
        expect, run = {}, 0
        for k, w in sorted(rows):
            expect[k] = run
            run += w
        got = {r["k"]: r["p"] for r in key_prefix(df, "k", {"p": F.col("w")}).collect()}
        assert got == expect
