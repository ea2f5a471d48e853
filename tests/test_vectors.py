import numpy as np
import pytest
from pyspark.sql import functions as F

from twinvec.operators import analogy as A
from twinvec.operators import neighbors as N
from twinvec.operators.evaluate import spearman
from twinvec.operators.scoring import NEIGHBOR_PANELS

# Eight 4-slot vectors: one all zero, two equal.
VECS = [[0.5, 1.0, -0.2, 0.3], [0.5, 1.0, -0.2, 0.3], [0.0, 0.0, 0.0, 0.0], [1.0, -1.0, 2.0, 0.5],
        [-0.3, 0.2, 0.1, -0.9], [0.7, 0.7, 0.7, 0.7], [2.0, 0.1, -1.5, 0.4], [-1.0, -0.5, 0.3, 1.2]]


def _emb(spark, vecs=VECS):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "word_id long, vec array<float>")


def _brute(vecs, panel, q):
    W = np.asarray(vecs, dtype=np.float32).astype(np.float64)
    x, y = W[:, 1::2], W[:, 0::2]
    n = lambda m: np.sqrt(np.maximum((m * m).sum(1), 1e-12))
    xx, yy = x @ x[q], y @ y[q]
    s = {"near_w": (xx + yy) / (n(W) * n(W)[q]), "near_x": xx / (n(x) * n(x)[q]), "near_y": yy / (n(y) * n(y)[q]),
         "far_y": -yy / (n(y) * n(y)[q]), "context": xx - yy, "dot_w": xx + yy, "dot_x": xx, "dot_y": -yy}[panel]
    s = np.round(s, 6)
    return sorted(range(len(vecs)), key=lambda i: (-s[i], i))


@pytest.mark.parametrize("panel", NEIGHBOR_PANELS)
def test_panels_match_brute_force(spark, panel):
    emb = _emb(spark)
    q = spark.createDataFrame([(i,) for i in range(8)], "q long")
    top = N.nearby(emb, q, (panel,), 3, query_block=3, cand_chunk=3)
    got = {}
    for r in top.collect():
        got.setdefault(r["q"], []).append((r["rank"], r["id"]))
    for qi in range(8):
        assert [i for _, i in sorted(got[qi])] == _brute(VECS, panel, qi)[:3], (panel, qi)


def test_rank_one_is_the_word_itself_or_its_twin(spark):
    emb = _emb(spark)
    q = spark.createDataFrame([(3,), (0,), (1,)], "q long")
    top = N.nearby(emb, q, ("near_w",), 1).collect()
    got = {r["q"]: r["id"] for r in top}
    assert got[3] == 3 and got[0] == 0 and got[1] == 0  # ties go to the lower id


def test_zero_vector_has_zero_cosine(spark):
    emb = _emb(spark)
    pairs = spark.createDataFrame([(2, 3), (0, 1)], "a long, b long")
    rows = {(r["a"], r["b"]): r for r in N.similarities(emb, pairs).collect()}
    assert rows[(2, 3)]["cos_w"] == 0.0 and rows[(0, 1)]["cos_w"] == pytest.approx(1.0)


def test_planted_analogy(spark):
    rng = np.random.default_rng(0)
    base = {"king": [1, 1, 0, 0], "man": [1, 0, 0, 0], "woman": [0, 0, 1, 0], "queen": [0, 1, 1, 0]}
    vecs = [np.asarray(base[w], dtype=float) * 3 + rng.normal(0, 0.05, 4) for w in ["king", "man", "woman", "queen"]]
    vecs += [rng.normal(0, 1, 4) for _ in range(20)]
    emb = _emb(spark, [list(v) for v in vecs])
    # man : king :: woman : ?  -> queen (id 3)
    q = spark.createDataFrame([(0, 1, 0, 2, 3)], "qid long, a long, b long, c long, d long")
    ans = A.answer(emb, q).first()
    assert ans["answer"] == 3
    ev = A.evaluate(emb, q).first()
    assert ev["total"] == 1 and ev["skipped"] == 0
    unknown = spark.createDataFrame([(0, 1, 0, 2, 3), (1, 1, 0, 2, 999)], "qid long, a long, b long, c long, d long")
    assert A.evaluate(emb, unknown).first()["skipped"] == 1


def test_spearman_average_ranks(spark):
    import pandas as pd
    rows = [(1.0, 0.5), (2.0, 0.1), (2.0, 0.3), (3.0, 0.3), (5.0, 0.9)]
    df = spark.createDataFrame([("g",) + r for r in rows], "g string, a double, b double")
    got = spearman(df, ["g"], "a", "b").first()["rho"]
    pdf = pd.DataFrame(rows, columns=["a", "b"])
    assert got == pytest.approx(round(pdf["a"].rank().corr(pdf["b"].rank()), 6))


def test_report_caps_and_display_rounding(spark):
    emb = _emb(spark)
    vocab = spark.createDataFrame([(i, f"w{i}", 10 - i) for i in range(8)], "word_id long, word string, freq long")
    q = spark.createDataFrame([(3,)], "q long")
    caps = {p: 2 if p == "near_w" else 8 for p in N.REPORT_PANELS}
    rep = N.neighbor_report(emb, vocab, q, k=caps, decimals=3).collect()
    per = {}
    for r in rep:
        per.setdefault(r["panel"], []).append(r)
    assert len(per["near_w"]) == 2 and len(per["dot_x"]) == 8
    whole = N.neighbor_report(emb, vocab, q, k=None).groupBy("panel").count().collect()
    assert {r["count"] for r in whole} <= {7, 8}
    assert all(round(r["cos_w"], 3) == r["cos_w"] for r in rep)


def test_eval_similarity_on_word_pairs(spark):
    from twinvec import api
    emb = _emb(spark)
    vocab = spark.createDataFrame([(0, "UNK", 5)] + [(i, f"w{i}", 10) for i in range(1, 8)], "word_id long, word string, freq long")
    pairs = spark.createDataFrame([("w1", "w3", 1.0), ("w4", "w5", 3.0), ("w6", "w7", 2.0), ("w1", "zzz", 5.0),
                                   ("w3", "w6", 4.0)], "w1 string, w2 string, gold double")
    got = {r["kind"]: r for r in api.eval_similarity(emb, vocab, pairs).collect()}
    assert set(got) == {"w", "x", "y"} and all(r["n"] == 4 and r["n_unknown"] == 1 for r in got.values())
    assert -1.0 <= got["w"]["rho"] <= 1.0


def test_panels_match_brute_force_many_blocks(spark):
    # Enough rows for several query blocks and candidate chunks (the cogroup keys must meet).
    rng = np.random.default_rng(11)
    vecs = rng.normal(0, 1, (1500, 8)).astype(np.float32)
    emb = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "word_id long, vec array<float>")
    q = spark.createDataFrame([(i,) for i in range(1500)], "q long")
    top = N.nearby(emb, q, ("near_w", "dot_y"), 3, query_block=200, cand_chunk=300)
    got = {}
    for r in top.collect():
        got.setdefault((r["q"], r["panel"]), []).append((r["rank"], r["id"]))
    assert len(got) == 3000
    for qi in range(0, 1500, 97):
        for panel in ("near_w", "dot_y"):
            assert [i for _, i in sorted(got[(qi, panel)])] == _brute(vecs.tolist(), panel, qi)[:3]


def test_word_level_analogy_file_end_to_end(spark, tmp_path):
    from twinvec import api
    rng = np.random.default_rng(0)
    names = ["king", "man", "woman", "queen"] + [f"n{i}" for i in range(20)]
    base = {"king": [1, 1, 0, 0], "man": [1, 0, 0, 0], "woman": [0, 0, 1, 0], "queen": [0, 1, 1, 0]}
    vecs = [np.asarray(base.get(w, rng.normal(0, 0.3, 4)), dtype=float) * 3 + rng.normal(0, 0.05, 4) for w in names]
    emb = spark.createDataFrame([(i + 1, [float(x) for x in v]) for i, v in enumerate(vecs)],
                                "word_id long, vec array<float>")
    vocab = spark.createDataFrame([(0, "UNK", 1)] + [(i + 1, w, 100 - i) for i, w in enumerate(names)],
                                  "word_id long, word string, freq long")
    p = tmp_path / "questions.txt"
    p.write_text(": family\nMan King Woman Queen\nman king woman nobody\n")
    good, skipped = api.read_questions(spark, str(p), vocab)
    assert skipped.first()["skipped"] == 1
    ev = api.eval_analogies(emb, good).first()
    assert (ev["correct"], ev["total"]) == (1, 1)
