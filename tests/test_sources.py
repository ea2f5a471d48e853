import os
import tempfile

from pyspark.sql import functions as F

from twinvec.operators.analogy import read_questions
from twinvec.sources.corpus import read_similarity, read_tagged, read_text_corpus
from twinvec.sources.sinks import vector_lines, vocab_lines, write_lines, write_report


def _tmp():
    return tempfile.mkdtemp(prefix="twinvec-test-", dir="/tmp")


def test_text_corpus_global_order_over_files_and_splits(spark):
    d = _tmp()
    n = 300_000
    # One line per file, as text8 is; small max partition bytes force many splits per file.
    with open(os.path.join(d, "a.txt"), "w") as f:
        f.write(" ".join(f"w{i}" for i in range(0, n // 2)))
    with open(os.path.join(d, "b.txt"), "w") as f:
        f.write("\t".join(f"w{i}" for i in range(n // 2, n)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(256 * 1024))
    try:
        toks = read_text_corpus(spark, d)
        assert toks.count() == n
        bad = toks.where(F.col("word") != F.concat(F.lit("w"), F.col("g").cast("string"))).count()
        assert bad == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_read_questions_sections_and_skips(spark):
    d = _tmp()
    p = os.path.join(d, "q.txt")
    with open(p, "w") as f:
        f.write(": capital\nAthens Greece Berlin Germany\nathens greece rome\n: family\nboy girl king queen\n"
                "boy girl zzz queen\n")
    vocab = spark.createDataFrame([(0, "UNK", 1)] + [(i + 1, w, 10) for i, w in enumerate(
        ["athens", "greece", "berlin", "germany", "rome", "boy", "girl", "king", "queen"])],
        "word_id long, word string, freq long")
    good, skipped = read_questions(spark, p, vocab)
    rows = sorted((r["section"], r["a"], r["b"], r["c"], r["d"]) for r in good.collect())
    assert rows == [("capital", 1, 2, 3, 4), ("family", 6, 7, 8, 9)]
    assert skipped.first()["skipped"] == 2


def test_similarity_and_tagged_readers(spark):
    d = _tmp()
    p = os.path.join(d, "ws.txt")
    with open(p, "w") as f:
        f.write("Tiger\tcat\t7.35\nbook\tpaper\t7.46\n")
    rows = read_similarity(spark, p).collect()
    assert [(r["w1"], r["w2"], r["gold"]) for r in rows] == [("tiger", "cat", 7.35), ("book", "paper", 7.46)]
    tagged = spark.createDataFrame([(2, 0, "Dog", "NOUN"), (1, 1, "the", "DET"), (1, 0, "The", "DET")],
                                   "sent long, pos long, word string, tag string")
    out = [(r["g"], r["word"], r["tag"]) for r in read_tagged(tagged, ["sent", "pos"]).orderBy("g").collect()]
    assert out == [(0, "the", "DET"), (1, "the", "DET"), (2, "dog", "NOUN")]


def test_writers(spark):
    d = _tmp()
    vocab = spark.createDataFrame([(1, "cat", 7), (0, "UNK", 3)], "word_id long, word string, freq long")
    write_lines(vocab_lines(vocab), os.path.join(d, "vocab"))
    lines = [r["value"] for r in spark.read.text(os.path.join(d, "vocab")).collect()]
    assert sorted(lines) == ["UNK 3", "cat 7"]
    emb = spark.createDataFrame([(0, [0.25, -1.0, 0.5, 2.0])], "word_id long, vec array<float>")
    got = {r["kind"]: r["line"] for kind in "wxy" for r in vector_lines(emb, kind).collect()}
    assert got == {"w": "0.2500000000 -1.0000000000 0.5000000000 2.0000000000", "x": "-1.0000000000 2.0000000000",
                   "y": "0.2500000000 0.5000000000"}
    assert vector_lines(emb, "x", normal=True).first()["line"] == "-0.4472135955 0.8944271910"
    rep = spark.createDataFrame([(5, "near_w", 1, "cat"), (6, "near_w", 1, "dog")], "q long, panel string, rank long, word string")
    write_report(rep, os.path.join(d, "rep"))
    assert {x for x in os.listdir(os.path.join(d, "rep")) if x.startswith("q=")} == {"q=5", "q=6"}


def test_many_words_share_a_bounded_number_of_files(spark, tmp_path):
    from twinvec.operators.neighbors import panels_side_by_side
    from twinvec.sources.sinks import write_report_files

    rows = [(q, p, r, f"w{q + r}", 1.0 / r) for q in range(95) for p in ("near_w", "far_y") for r in range(1, 4) if (p, r, q % 2) != ("far_y", 3, 1)]
    rep = spark.createDataFrame(rows, "q long, panel string, rank long, word string, score double")
    write_report_files(rep, f"{tmp_path}/long", words_per_file=20)
    parts = list((tmp_path / "long").glob("part-*"))
    assert 1 < len(parts) <= 5
    seen = [set(r["q"] for r in spark.read.parquet(str(p)).collect()) for p in parts]
    assert sum(map(len, seen)) == 95
    wide = panels_side_by_side(rep, ("near_w", "far_y"), ("word", "score"))
    write_report_files(wide, f"{tmp_path}/wide", "csv", words_per_file=50)
    back = spark.read.option("header", True).csv(f"{tmp_path}/wide")
    assert back.columns == ["q", "rank", "near_w_word", "near_w_score", "far_y_word", "far_y_score"] and back.count() == 95 * 3
    assert back.where("far_y_word is null").count() == 47  # the shorter panel is padded
