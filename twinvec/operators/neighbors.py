"""Vector queries: nearest / farthest / context panels, similarities, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinvec.functions.vectors import dot, safe_norm, sq_norm, x_part, y_part
from twinvec.operators.joins import lookup_join
from twinvec.operators.scoring import (FEW_QUERIES, NEIGHBOR_KERNEL, NEIGHBOR_PANELS, RANKS_KERNEL, REPORT_PANELS,
                                       SCORE_DECIMALS, rank_interval, topk_panels)

PREDICT_TOP = 4

# Our own bound: longer lists are found by rank_interval, in memory that does not grow with them.
LONG_LIST = 1000

# Panels whose score is a negated similarity (ranked ascending); reports show the similarity.
FAR_PANELS = {"far_y", "far_w", "far_x"}


def lookup_ids(words: DataFrame, vocab: DataFrame, word_col: str = "word") -> DataFrame:
    """Word -> id with the UNK fallback (0) of the query functions."""
    ranked = vocab.where(F.col("word_id") >= 1).select(F.col("word").alias(word_col), "word_id")
    return lookup_join(words, ranked, word_col).withColumn("word_id", F.coalesce("word_id", F.lit(0)).cast("long"))


def query_vectors(query_ids: DataFrame, emb: DataFrame, q_col: str = "q", few: bool = False) -> DataFrame:
    """Attach the vector of each query id (inner join on ``word_id``). ``few``: the ids go to the vectors, which stay where they lie."""
    ids = query_ids.select(F.col(q_col).cast("long").alias("q"))
    return emb.select(F.col("word_id").alias("q"), "vec").join(F.broadcast(ids) if few else ids, "q")


def nearby(emb: DataFrame, query_ids: DataFrame, panels=NEIGHBOR_PANELS, k: int = 20, cosines: bool = True, **kw) -> DataFrame:
    """Top ``k`` per (query, panel): ``(q, panel, rank, id, score, cos_w, cos_x, cos_y)``, without the last three unless ``cosines``.

    ``query_ids`` has a column ``q`` of word ids; ``emb`` is ``(word_id, vec)``. Up to ``FEW_QUERIES`` queries are answered by a scan of
    ``emb`` without a shuffle of it; lists longer than ``LONG_LIST`` by two passes in bounded memory.
    """
    n = query_ids.count()
    queries = query_vectors(query_ids, emb, few=n <= FEW_QUERIES)
    cands = emb.select(F.col("word_id").alias("id"), "vec")
    kernel = NEIGHBOR_KERNEL if cosines else RANKS_KERNEL
    if k > LONG_LIST:
        return rank_interval(queries, cands, kernel, panels, 1, k, n_queries=n, **kw)
    return topk_panels(queries, cands, kernel, panels, k, n_queries=n, **kw)


def neighbor_report(emb: DataFrame, vocab: DataFrame, query_ids: DataFrame, k: int | dict | None = 20,
                    panels=REPORT_PANELS, decimals: int | None = None, **kw) -> DataFrame:
    """N8 / N10 in long form: ``(q, panel, rank, word_id, word, score, cos_w, cos_x, cos_y)``.

    One scored pass serves all panels; far panels report the similarity itself. ``k`` (K9) is the
    caller's choice: one length, a dict with one for each panel, or None for whole lists. Ranking, cut,
    then the id -> word join (J2) on the kept rows only. ``decimals=3`` rounds the shown values
    after ranking, as the reference displays them (P15).
    """
    k = emb.count() if k is None else k
    caps = k if isinstance(k, dict) else {p: k for p in panels}
    top = nearby(emb, query_ids, panels, max(caps[p] for p in panels), **kw)
    if isinstance(k, dict):
        cap = F.lit(0)
        for p in panels:
            cap = F.when(F.col("panel") == p, F.lit(caps[p])).otherwise(cap)
        top = top.where(F.col("rank") <= cap)
    score = F.when(F.col("panel").isin(*FAR_PANELS), -F.col("score")).otherwise(F.col("score"))
    # Only words with a vector can be found; the whole vocabulary would be sent for them.
    words = vocab.join(emb.select("word_id"), "word_id", "left_semi").select(F.col("word_id").alias("id"), "word")
    joined = lookup_join(top, words, "id")
    shown = [score.alias("score"), F.col("cos_w"), F.col("cos_x"), F.col("cos_y")]
    if decimals is not None:
        shown = [F.round(c, decimals).alias(n) for c, n in zip(shown, ("score", "cos_w", "cos_x", "cos_y"))]
    return joined.select("q", "panel", "rank", F.col("id").alias("word_id"), "word", *shown)


def report_wide(report: DataFrame) -> DataFrame:
    """Side-by-side panels aligned on ``(q, rank)``; a panel shorter than another is padded with NULL."""
    panels = [r for r in REPORT_PANELS]
    wide = report.groupBy("q", "rank").pivot("panel", panels).agg(F.max("word").alias("word"))
    return wide.select("q", "rank", *[F.col(p).alias(f"{p}_word") for p in panels])


MEASURES = ("word", "score", "cos_w", "cos_x", "cos_y")


def panels_side_by_side(report: DataFrame, panels, measures=MEASURES, key: str = "q") -> DataFrame:
    """J6 in full: one row per ``(key, rank)`` with columns ``<panel>_<measure>``, the two header levels of the reference's table. One
    aggregation; a panel shorter than another is padded with NULL."""
    cell = F.struct(*measures)
    wide = report.groupBy(key, "rank").agg(*[F.first(F.when(F.col("panel") == p, cell), ignorenulls=True).alias(p) for p in panels])
    return wide.select(key, "rank", *[F.col(p)[m].alias(f"{p}_{m}") for p in panels for m in measures])


def near_words(emb: DataFrame, vocab: DataFrame, words: DataFrame, k: int | dict | None = 20, panels=REPORT_PANELS, **kw) -> DataFrame:
    """P13 + P10 + N8: the report for query words ``words(word)``; unknown words ask for the UNK vector (id 0).

    ``(query_word, panel, rank, word_id, word, score, cos_w, cos_x, cos_y)``; words of one id share one scoring.
    """
    ids = lookup_ids(words.select("word").distinct(), vocab).select(F.col("word").alias("query_word"), F.col("word_id").alias("q"))
    report = neighbor_report(emb, vocab, ids.select("q").distinct(), k, panels, **kw)
    return ids.join(report, "q").drop("q")


def similar_words(emb: DataFrame, vocab: DataFrame, pairs: DataFrame) -> DataFrame:
    """N7 / J5 for pairs of words ``(a_word, b_word)``; unknown words stand for UNK."""
    a = lookup_ids(pairs.select("a_word", "b_word"), vocab, "a_word").withColumnRenamed("word_id", "a")
    return similarities(emb, lookup_ids(a, vocab, "b_word").withColumnRenamed("word_id", "b"))


def similarities(emb: DataFrame, pairs: DataFrame, a_col: str = "a", b_col: str = "b") -> DataFrame:
    """Cosine of w, x and y for each ``(a, b)`` pair of word ids."""
    e = emb.select("word_id", x_part("vec").alias("x"), y_part("vec").alias("y"))
    ea = e.select(F.col("word_id").alias(a_col), F.col("x").alias("xa"), F.col("y").alias("ya"))
    eb = e.select(F.col("word_id").alias(b_col), F.col("x").alias("xb"), F.col("y").alias("yb"))
    j = pairs.join(ea, a_col).join(eb, b_col)
    xx, yy = dot("xa", "xb"), dot("ya", "yb")
    sxa, sya, sxb, syb = sq_norm("xa"), sq_norm("ya"), sq_norm("xb"), sq_norm("yb")
    cos_w = (xx + yy) / (safe_norm(sxa + sya) * safe_norm(sxb + syb))
    cos_x = xx / (safe_norm(sxa) * safe_norm(sxb))
    cos_y = yy / (safe_norm(sya) * safe_norm(syb))
    keep = [c for c in pairs.columns if c not in (a_col, b_col)]
    return j.select(a_col, b_col, *keep, F.round(cos_w, SCORE_DECIMALS).alias("cos_w"),
                    F.round(cos_x, SCORE_DECIMALS).alias("cos_x"), F.round(cos_y, SCORE_DECIMALS).alias("cos_y"))


def neighborhood(emb: DataFrame, query_ids: DataFrame, limit: int = 50, **kw) -> DataFrame:
    """The ids a plot of a word's neighbourhood would show, for modes w, x, y and far y.

    Far mode also lists the query word itself (rank ``limit + 1``), as the reference appends it.
    """
    top = nearby(emb, query_ids, ("near_w", "near_x", "near_y", "far_y"), limit, cosines=False, **kw)
    mode = (F.when(F.col("panel") == "near_w", "w").when(F.col("panel") == "near_x", "x")
            .when(F.col("panel") == "near_y", "y").otherwise("far_y"))
    rows = top.select("q", mode.alias("mode"), "rank", F.col("id").alias("vec_id"))
    me = query_vectors(query_ids, emb).select("q", F.lit("far_y").alias("mode"),
                                              F.lit(limit + 1).cast("long").alias("rank"),
                                              F.col("q").alias("vec_id"))
    return rows.unionByName(me)
