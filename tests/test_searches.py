"""The plans for a few queries, for long lists and for stretches of ranks give the rows of the blocked plan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinvec.operators import analogy as A
from twinvec.operators import neighbors as N
from twinvec.operators import scoring as S
from twinvec.session import checkpoint


@pytest.fixture(scope="module")
def emb(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(0, 1, (300, 6)).round(1)
    v[20:40] = v[0]  # ties
    v[50] = 0
    v[60, 2] = np.nan
    return checkpoint(spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(300)], "word_id long, vec array<float>").repartition(5))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def blocked(monkeypatch):
    monkeypatch.setattr(S, "FEW_QUERIES", -1)
    monkeypatch.setattr(N, "FEW_QUERIES", -1)


def test_few_queries_equal_the_blocked_plan_and_move_no_candidates(spark, emb, monkeypatch):
    ids = spark.createDataFrame([(0,), (25,), (50,), (60,), (299,), (1000,)], "q long")
    few = N.nearby(emb, ids, k=30)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "CoGroup" not in plan
    below = plan[plan.index("MapInPandas"):]
    assert "Exchange" not in below  # candidates are scanned where they lie
    want = rows(few)
    blocked(monkeypatch)
    assert want == rows(N.nearby(emb, ids, k=30)) and len(want) > 900


def test_many_queries_take_the_blocked_plan(spark, emb):
    ids = emb.select(F.col("word_id").alias("q")).limit(S.FEW_QUERIES + 1)
    assert "CoGroup" in N.nearby(emb, ids, k=3)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("first,last", [(1, 1), (1, 40), (7, 31), (281, 300), (1, 5000), (400, 500)])
def test_rank_intervals(spark, emb, first, last):
    ids = emb.select(F.col("word_id").alias("q"))
    q, c = N.query_vectors(ids, emb), emb.select(F.col("word_id").alias("id"), "vec")
    every = S.topk_panels(q, c, S.NEIGHBOR_KERNEL, S.NEIGHBOR_PANELS, 300)
    want = rows(every.where(F.col("rank").between(first, last)))
    got = S.rank_interval(q, c, S.NEIGHBOR_KERNEL, S.NEIGHBOR_PANELS, first, last, query_block=70, cand_chunk=90)
    assert rows(got) == want


@pytest.mark.parametrize("first,last", [(1, 1), (1, 40), (7, 31), (281, 300), (400, 500)])
def test_rank_stretches_from_bounds(spark, emb, first, last):
    ids = emb.select(F.col("word_id").alias("q"))
    ids = ids.unionByName(ids.where("q < 10"))  # some queries come twice
    q, c = N.query_vectors(ids, emb), emb.select(F.col("word_id").alias("id"), "vec")
    every = S.topk_panels(q, c, S.RANKS_KERNEL, S.NEIGHBOR_PANELS, 600)
    want = rows(every.where(F.col("rank").between(first, last)))
    assert rows(S.rank_stretch(q, c, S.RANKS_KERNEL, S.NEIGHBOR_PANELS, first, last, query_block=70, cand_chunk=90)) == want


def test_best_of_a_slice_equals_sorting():
    r = np.random.default_rng(5)
    s = r.normal(0, 1, (40, 3000))
    s[3, :2900] = 0.25  # more ties than the close look takes
    s[4, 10:60] = s[4].max() + 4e-7 * r.random(50)  # equal once rounded
    s[5], s[6, ::2], s[7, 5] = np.nan, -np.inf, np.inf
    for k in (1, 10, 400):
        rr, cc, vv = S._best(s, k)
        got = sorted(zip(rr.tolist(), cc.tolist(), vv.tolist()))
        want = []
        for i, row in enumerate(np.round(s, S.SCORE_DECIMALS)):
            good = np.flatnonzero(np.isfinite(row))
            want += [(i, int(j), row[j]) for j in good[np.lexsort((good, -row[good]))][:k]]
        assert got == sorted(want)


def test_a_slice_leaves_no_matrices_behind():
    import gc
    import weakref

    import pyarrow as pa
    v = pa.array(np.random.default_rng(2).normal(0, 1, (50, 6)).tolist(), pa.list_(pa.float32()))
    q, c = pa.table({"q": range(50), "q__vec": v}), pa.table({"id": range(50), "c__vec": v})
    left = []
    gc.disable()  # as between two runs of the collector, which counts objects and not their size
    try:
        for _, _, scores, _ in S._slices(S.NEIGHBOR_KERNEL, 10, q, c):
            left.append(weakref.ref(scores["near_w"]()))
            assert sum(x() is not None for x in left) == 1
    finally:
        gc.enable()


def test_long_lists_split_the_queries():
    n_qb, n_ch = S.plan_blocks(100_000, 100_000, 8, list_rows=140)
    assert 100_000 / n_qb * 140 <= S.LIST_ROWS and n_ch == 2
    assert S.plan_blocks(10_000, 10_000, 8, list_rows=140) == (8, 1)


def test_bins_rise_with_the_score():
    r = np.random.default_rng(1)
    x = np.sort(np.concatenate([r.normal(0, 1, 2000), r.normal(0, 1e6, 2000), [0.0, -0.0, 1e-300, -1e-300, 5e300, -5e300], r.normal(0, 1e-9, 500)]))
    assert (np.diff(S._bins(x)) >= 0).all() and S._bins(np.array([-0.0]))[0] == S._bins(np.array([0.0]))[0]
    assert np.abs(S._bins(x)).max() < 1 << 16


def test_long_lists_need_no_list_in_memory(spark, emb, monkeypatch):
    monkeypatch.setattr(N, "LONG_LIST", 10)
    ids = emb.select(F.col("word_id").alias("q")).where("q < 80")
    got = rows(N.nearby(emb, ids, ("near_w", "dot_y"), 100))
    monkeypatch.setattr(N, "LONG_LIST", 1000)
    assert got == rows(N.nearby(emb, ids, ("near_w", "dot_y"), 100))


def test_tails_of_far_panels(spark, emb):
    qs = spark.createDataFrame([(i, 3 * i, 3 * i + 1, 3 * i + 2) for i in range(70)], "qid long, a long, b long, c long")
    e = emb.where("word_id <> 60")
    every = A.analogy_panels(e, qs, k=299)
    got = rows(A.analogy_panels(e, qs, k=20, tail_of=100))
    cut = F.when(F.col("panel").isin("far_w", "far_x"), F.col("rank").between(81, 100)).otherwise(F.col("rank") <= 20)
    assert got == rows(every.where(cut))


def test_objectives_leave_out_question_words_in_place(monkeypatch):
    """F10 (analogy_objectives): the scores of the plain formulas, with no comparison of every candidate; an id may come twice."""
    import numpy as np

    from twinvec.operators import scoring as S
    rng = np.random.default_rng(2)
    ids, vec = np.sort(np.concatenate([np.arange(0, 60, 2), [8, 8, 58]])), rng.normal(size=(33, 6))
    abc = rng.integers(0, 62, (3, 9))
    q = rng.normal(size=(3, 9, 6))
    cm, qm = S._analogy_prepare_c({"vec": vec}) | {"_id": ids}, S._analogy_prepare_q(dict(zip(("va", "vb", "vc"), q))) | dict(zip("abc", abc))
    out = (ids == abc[:, :, None]).any(axis=0)
    scores = S._eval_scores(qm, cm)
    for kind in "wxy":
        u = cm["u" + kind].T
        a, b, c = (qm[x + kind] for x in "abc")
        pa, pb, pc = ((x @ u + 1.0) / 2.0 for x in (a, b, c))
        assert (scores["add_" + kind]() == np.where(out, -np.inf, (c + (b - a)) @ u)).all()
        assert (scores["mul_" + kind]() == np.where(out, -np.inf, pb * pc / (pa + S.MUL_EPS))).all()
    assert not hasattr(S, "_exclusion") and out.any()


def test_best_scores_with_what_has_no_rank():
    """matrices with infinities and NaN in stretches, ends and whole rows, against a sort."""
    import numpy as np

    from twinvec.operators import scoring as S
    rng = np.random.default_rng(3)
    for k in (1, 4):
        for n in (700, 1500, 5003):
            plain = np.round(rng.normal(size=(6, n)), 3)
            for odd in ([], [-np.inf], [np.nan], [np.inf, -np.inf, np.nan]):
                score = plain.copy()
                for x in odd:
                    score[rng.integers(0, 6, 40), rng.integers(0, n, 40)] = x
                    score[2, -3:] = x
                if odd:
                    score[4] = odd[0]
                r, c, v = S._best(score.copy(), k)
                want = [(i, j, score[i, j]) for i in range(6) for j in np.lexsort((np.arange(n), -np.where(np.isfinite(score[i]), score[i], -np.inf)))[:k]
                        if np.isfinite(score[i, j])]
                assert sorted(zip(r.tolist(), c.tolist(), v.tolist())) == sorted(want)
