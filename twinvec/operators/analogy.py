"""Analogies: ``a : b :: c : ?`` (N1-N6, N9, A7, A8, E2) and the question reader.

``questions(qid, a, b, c, d)`` hold word ids; a question whose ids lack a vector is skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinvec.operators.joins import lookup_join
from twinvec.operators.ordering import ordered_prefix
from twinvec.operators.neighbors import FAR_PANELS, LONG_LIST, PREDICT_TOP, lookup_ids
from twinvec.operators.scoring import (ANALOGY_EVAL_KERNEL, ANALOGY_EVAL_PANELS, ANALOGY_KERNEL, ANALOGY_PANELS,
                                       rank_interval, rank_stretch, topk_panels)


def read_questions(spark, path: str, vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Analogy file -> ``(qid, section, a, b, c, d)`` ids and a one-row ``skipped`` count.

    Lines starting with ``:`` open a section; others are lower-cased and split on spaces.
    A line is kept when it has exactly four words, all in the vocabulary (ids >= 1).
    All lines are parsed (the reference's loop only parses the last line: a known bug).
    """
    lines = (spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("_f"),
                                          F.col("_metadata.file_block_start").alias("_b"),
                                          F.monotonically_increasing_id().alias("_r")))
    is_header = F.col("line").startswith(":")
    # Section of a line = the last header at or before it: number the headers with a distributed
    # prefix sum in file order, then an equi-join on that number (no single-partition window).
    order = [F.col("_f").asc(), F.col("_b").asc(), F.col("_r").asc()]
    pos = ordered_prefix(lines.withColumn("_h", is_header.cast("long")), order,
                         {"_pos": F.lit(1).cast("long"), "_hb": F.col("_h")})
    pos = pos.withColumn("_hidx", F.col("_hb") + F.col("_h"))
    heads = pos.where(F.col("_h") == 1).select("_hidx", F.trim(F.expr("substring(line, 2)")).alias("section"))
    tagged = pos.join(heads, "_hidx", "left")
    body = tagged.where(~is_header).withColumn("words", F.split(F.lower(F.trim("line")), " "))
    ranked = vocab.where(F.col("word_id") >= 1).select("word", "word_id")
    q = body.withColumn("qid", F.col("_pos"))
    exploded = q.select("qid", "section", "words", F.posexplode("words").alias("slot", "word"))
    ids = lookup_join(exploded, ranked, "word")
    per_q = ids.groupBy("qid", "section").agg(
        F.count(F.lit(1)).alias("n_words"), F.count("word_id").alias("n_known"),
        *[F.max(F.when(F.col("slot") == i, F.col("word_id"))).alias(n) for i, n in enumerate("abcd")])
    ok = (F.col("n_words") == 4) & (F.col("n_known") == 4)
    good = per_q.where(ok).select("qid", "section", "a", "b", "c", "d")
    skipped = per_q.agg(F.count(F.when(~ok, 1)).alias("skipped"))
    return good, skipped


def _with_vectors(questions: DataFrame, emb: DataFrame, scalars: bool = False) -> DataFrame:
    e = emb.select("word_id", "vec")
    q = questions.select(F.col("qid").alias("q"), "a", "b", "c")
    for s in "abc":
        q = q.join(e.select(F.col("word_id").alias(s), F.col("vec").alias("v" + s)), s)
    return q


def known(questions: DataFrame, emb: DataFrame, cols: str = "abcd") -> DataFrame:
    """Questions whose ids in ``cols`` all have a vector."""
    ids = emb.select("word_id")
    q = questions
    for s in cols:
        q = q.join(ids.select(F.col("word_id").alias(s)), s, "left_semi")
    return q


# Far panels that the reference cuts from the end of its capped list (for y it shows the first ranks).
TAIL_PANELS = ("far_w", "far_x")


def analogy_panels(emb: DataFrame, questions: DataFrame, panels=ANALOGY_PANELS, k: int = PREDICT_TOP,
                   tail_of: int | None = None, **kw) -> DataFrame:
    """Top ``k`` per (question, panel): ``(q, panel, rank, id, score)``.

    Scores: ``(u_c + u_b - u_a) . u_v`` on unit whole vectors (near_w), unit x (near_x), unit y
    (near_y); the far panels rank the same score ascending. ``tail_of`` (1000 in the reference): far_w and far_x show the last ``k`` ranks of
    a list of that length, ``tail_of - k + 1`` to ``tail_of``, instead of the first ones.
    """
    queries = _with_vectors(questions, emb)
    cands = emb.select(F.col("word_id").alias("id"), "vec")
    tails = [p for p in panels if tail_of and p in TAIL_PANELS]
    heads = [p for p in panels if p not in tails]
    found = [topk_panels(queries, cands, ANALOGY_KERNEL, heads, k, **kw)] if heads else []
    stretch = rank_stretch if (tail_of or 0) <= LONG_LIST else rank_interval
    found += [stretch(queries, cands, ANALOGY_KERNEL, tails, tail_of - k + 1, tail_of, **kw)] if tails else []
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def analogy_words(emb: DataFrame, vocab: DataFrame, questions: DataFrame, panels=ANALOGY_PANELS, k: int = PREDICT_TOP, **kw) -> DataFrame:
    """N1-N6 for words ``(qid, wa, wb, wc)``: ``(qid, panel, rank, word, score)``; unknown words stand for UNK."""
    q = questions.select("qid", "wa", "wb", "wc")
    for c in "abc":
        q = lookup_ids(q, vocab, "w" + c).withColumnRenamed("word_id", c)
    top = analogy_panels(emb, q.select("qid", "a", "b", "c"), panels, k, **kw)
    words = vocab.select(F.col("word_id").alias("id"), "word")
    return lookup_join(top, words, "id").select(F.col("q").alias("qid"), "panel", "rank", "word", "score")


def answer(emb: DataFrame, questions: DataFrame, **kw) -> DataFrame:
    """First of the top 4 (whole vectors) that is not a, b or c; NULL means 'unknown'."""
    top = analogy_panels(emb, questions, ("near_w",), PREDICT_TOP, **kw)
    q = questions.select(F.col("qid").alias("q"), "a", "b", "c")
    j = top.join(q, "q")
    fresh = j.where(~F.col("id").isin(F.col("a"), F.col("b"), F.col("c")))
    best = fresh.groupBy("q").agg(F.min_by("id", "rank").alias("answer"))
    return q.select("q").join(best, "q", "left").select(F.col("q").alias("qid"), "answer")


def evaluate(emb: DataFrame, questions: DataFrame, **kw) -> DataFrame:
    """Precision at 1 the reference's way, with skipped questions counted.

    Walk the top 4: a hit if the id equals d (tested first), skip it if it is a, b or c, else stop.
    """
    good = known(questions, emb)
    top = analogy_panels(emb, good, ("near_w",), PREDICT_TOP, **kw)
    j = top.join(good.select(F.col("qid").alias("q"), "a", "b", "c", "d"), "q")
    stop = j.where((F.col("id") == F.col("d")) | ~F.col("id").isin(F.col("a"), F.col("b"), F.col("c")))
    first = stop.groupBy("q").agg(F.min_by(F.col("id") == F.col("d"), "rank").alias("hit"))
    correct = first.agg(F.count(F.when(F.col("hit"), 1)).alias("correct"))
    total = good.agg(F.count(F.lit(1)).alias("total"))
    all_q = questions.agg(F.count(F.lit(1)).alias("all_q"))
    out = correct.withColumn("_k", F.lit(1)).join(total.withColumn("_k", F.lit(1)), "_k") \
        .join(all_q.withColumn("_k", F.lit(1)), "_k")
    acc = F.when(F.col("total") > 0, F.round(F.col("correct") * 100.0 / F.col("total"), 6))
    return out.select(F.col("correct").cast("long"), F.col("total").cast("long"),
                      (F.col("all_q") - F.col("total")).cast("long").alias("skipped"), acc.alias("accuracy"))


def report(emb: DataFrame, vocab: DataFrame, questions: DataFrame, k: int = 20, **kw) -> DataFrame:
    """N9 in long form: six panels, ``(qid, panel, rank, word_id, word, score)``; far panels show the similarity (``tail_of``: see
    :func:`analogy_panels`)."""
    top = analogy_panels(emb, questions, ANALOGY_PANELS, k, **kw)
    score = F.when(F.col("panel").isin(*FAR_PANELS), -F.col("score")).otherwise(F.col("score"))
    words = vocab.select(F.col("word_id").alias("id"), "word")
    j = lookup_join(top, words, "id")
    return j.select(F.col("q").alias("qid"), "panel", "rank", F.col("id").alias("word_id"), "word", score.alias("score"))


def eval_objectives(emb: DataFrame, questions: DataFrame, **kw) -> DataFrame:
    """Answers by 3CosAdd and 3CosMul for vectors w, x, y, question words excluded.

    Returns ``(qid, method, kind, answer, correct)``; unknown questions are left out (see
    :func:`known`).
    """
    good = known(questions, emb)
    q = _with_vectors(good, emb)
    cands = emb.select(F.col("word_id").alias("id"), "vec")
    top = topk_panels(q, cands, ANALOGY_EVAL_KERNEL, ANALOGY_EVAL_PANELS, 1, **kw)
    j = top.join(good.select(F.col("qid").alias("q"), "d"), "q")
    return j.select(F.col("q").alias("qid"), F.split("panel", "_")[0].alias("method"),
                    F.split("panel", "_")[1].alias("kind"), F.col("id").alias("answer"),
                    (F.col("id") == F.col("d")).alias("correct"))


def accuracy_by_kind(objectives: DataFrame) -> DataFrame:
    return objectives.groupBy("method", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"))
