import numpy as np
from pyspark.sql import functions as F

from twinvec.operators.project import project_2d
from twinvec.operators.tagging import next_tag_dataset, tag_accuracy


def test_next_tag_accuracy_near_one_when_tag_follows_the_word(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(10)]
    tag_after = {w: ["NOUN", "VERB", "DET", "ADJ"][i % 4] for i, w in enumerate(words)}
    seq = [words[int(i)] for i in rng.integers(0, 10, 400)]
    tagged = spark.createDataFrame(
        [(g, w, "X" if g == 0 else tag_after[seq[g - 1]]) for g, w in enumerate(seq)], "g long, word string, tag string")
    vocab = spark.createDataFrame([(i + 1, w, 10) for i, w in enumerate(words)], "word_id long, word string, freq long")
    emb = spark.createDataFrame([(i + 1, [float(x) for x in rng.normal(0, 1, 16)]) for i in range(10)],
                                "word_id long, vec array<float>")
    data = next_tag_dataset(tagged, vocab)
    assert data.count() == 399
    acc = {(r["kind"], r["split"]): r["accuracy"] for r in tag_accuracy(data, emb, kinds=("w",)).collect()}
    assert acc[("w", "train")] > 0.95 and acc[("w", "test")] > 0.95


def test_cells_give_the_costs_of_the_rows(spark):
    from twinvec.operators.tagging import TAG_BATCH, tag_cells, tag_cost

    rng = np.random.default_rng(7)
    n, n_train = 700, 560
    word, tag = rng.integers(0, 12, n), rng.integers(0, 3, n)
    data = spark.createDataFrame([(p, int(word[p]), "abc"[tag[p]], "train" if p < n_train else "test") for p in range(n)],
                                 "pos long, word_id long, tag string, split string")
    assert tag_cells(data).count() <= 12 * 3 * 2
    vec = rng.normal(0, 1, (12, 4))
    emb = spark.createDataFrame([(i, [float(x) for x in vec[i]]) for i in range(12)], "word_id long, vec array<float>")
    w = rng.normal(0, 2, (3, 4))
    got = {r["split"]: r for r in tag_cost(data, emb, {t: list(w[i]) for i, t in enumerate("abc")}, "w").collect()}
    z = (vec / np.linalg.norm(vec, axis=1)[:, None])[word] @ w.T
    cost = np.log(np.exp(z).sum(1)) - z[np.arange(n), tag]
    batches = np.array_split(cost[:n_train], n_train // TAG_BATCH)
    assert abs(got["train"]["ref_cost"] - sum(b.mean() for b in batches) / n_train) < 1e-5 and got["test"]["ref_cost"] is None
    for split, own in (("train", slice(0, n_train)), ("test", slice(n_train, n))):
        assert abs(got[split]["mean_cost"] - cost[own].mean()) < 1e-5
        assert abs(got[split]["accuracy"] - (z.argmax(1) == tag)[own].mean()) < 1e-6


def test_pca_recovers_planted_plane(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 5, 200), rng.normal(0, 2, 200)
    basis = np.linalg.qr(rng.normal(size=(8, 2)))[0]
    pts = np.outer(a, basis[:, 0]) + np.outer(b, basis[:, 1]) + rng.normal(0, 0.01, (200, 8))
    emb = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(pts)], "word_id long, vec array<float>")
    out = {r["word_id"]: (r["p1"], r["p2"]) for r in project_2d(emb, "w").collect()}
    p = np.asarray([out[i] for i in range(200)])
    assert abs(np.corrcoef(p[:, 0], a)[0, 1]) > 0.99 and abs(np.corrcoef(p[:, 1], b)[0, 1]) > 0.99
    assert len(project_2d(emb, "x", first_n=50).collect()) == 50
