import numpy as np
import pytest
from pyspark.sql import functions as F

from twinvec.operators import corpus as C
from twinvec.operators import training as TR
from twinvec.operators.sampling import cdf_buckets, inverse_cdf, noise, shared_negatives
from twinvec.params import Word2VecParams


def _vocab(spark, freqs):
    return spark.createDataFrame([(i, f"w{i}", f) for i, f in enumerate(freqs)], "word_id long, word string, freq long")


def test_inverse_cdf_matches_searchsorted(spark):
    freqs = [50, 30, 0, 20, 7, 1, 1, 300]
    vocab = _vocab(spark, freqs)
    nz = noise(vocab)
    us = np.random.default_rng(1).random(3000)
    draws = spark.createDataFrame([(i, float(u)) for i, u in enumerate(us)], "i long, u double")
    got = {r["i"]: r["sample"] for r in inverse_cdf(draws, cdf_buckets(nz, 16), 16).collect()}
    w = np.round(np.asarray(freqs, dtype=float) ** 0.75 * 4096).astype(np.int64)  # fixed-point weights
    lo = np.concatenate([[0], np.cumsum(w)[:-1]]).astype(float) / float(w.sum())
    pos = np.flatnonzero(w > 0)
    expect = pos[np.searchsorted(lo[pos], us, side="right") - 1]
    assert len(got) == len(us)
    assert all(got[i] == expect[i] for i in range(len(us)))


def test_shared_negatives_are_distinct_and_complete(spark):
    vocab = _vocab(spark, [1000, 5, 5, 5, 5, 5, 5, 5])
    batches = spark.createDataFrame([(b,) for b in range(30)], "batch_id long")
    negs = shared_negatives(batches, noise(vocab), 6, first_draws=2)
    per = negs.groupBy("batch_id").agg(F.count("*").alias("n"), F.countDistinct("word_id").alias("d")).collect()
    assert len(per) == 30 and all(r["n"] == 6 and r["d"] == 6 for r in per)
    with pytest.raises(ValueError):
        shared_negatives(batches, noise(vocab), 9)


def test_tied_gradient_matches_finite_difference():
    rng = np.random.default_rng(0)
    W = rng.normal(0, 0.3, (6, 4))
    q = TR.sign_vector(4)
    ii, jj, kk = np.array([0, 1, 0]), np.array([2, 3, 1]), np.array([4, 2])  # a negative equals a label
    loss, rows, grads = TR.tied_loss_and_grads(W, ii, jj, kk, q)
    G = np.zeros_like(W)
    np.add.at(G, rows, grads)
    eps = 1e-6
    for r in range(6):
        for c in range(4):
            Wp, Wm = W.copy(), W.copy()
            Wp[r, c] += eps
            Wm[r, c] -= eps
            fd = (TR.tied_loss_and_grads(Wp, ii, jj, kk, q)[0] - TR.tied_loss_and_grads(Wm, ii, jj, kk, q)[0]) / (2 * eps)
            assert abs(fd - G[r, c]) < 1e-7


def test_untied_step_matches_loop():
    rng = np.random.default_rng(2)
    w_in, w_out = rng.normal(0, 0.1, (5, 3)), rng.normal(0, 0.1, (5, 3))
    a_in, a_out = w_in.copy(), w_out.copy()
    ex, lab, negs = np.array([0, 1]), np.array([2, 2]), [np.array([2, 3]), np.array([4, 4, 1])]
    TR.untied_step(w_in, w_out, ex, lab, negs, 0.5)
    for e, l, ns in zip(ex, lab, negs):
        x, move = a_in[e].copy(), 0
        for t in [l, *ns[ns != l]]:
            err = 0.5 * ((t == l) - 1 / (1 + np.exp(-a_out[t] @ x)))
            move, a_out[t] = move + err * a_out[t], a_out[t] + err * x
        a_in[e] = x + move
    assert np.allclose(w_in, a_in) and np.allclose(w_out, a_out)


def test_untied_step_saturates():
    for z in (2000.0, -2000.0):
        w_in, w_out = np.array([[z, 0.0]]), np.array([[1.0, 0.0], [1.0, 0.0]])
        TR.untied_step(w_in, w_out, np.array([0]), np.array([0]), [np.array([1])], 0.1)
        # Far right: the label is certain and the negative costs a whole step; far left the other way round.
        assert np.allclose(w_out[:, 0], [1.0, 1.0 - 0.1 * z] if z > 0 else [1.0 + 0.1 * z, 1.0])
        assert np.isfinite(w_in).all()


def test_vectors_do_not_depend_on_the_cores(spark):
    docs = spark.createDataFrame([(i, " ".join(f"t{(i * 7 + k * k) % 30}" for k in range(80))) for i in range(40)], "doc_id long, text string")
    params = Word2VecParams(min_count=1, subsample=0.0, window_size=2, shards=3, pairs_per_round=1024, learning_rate=0.3)
    got, evals = [], []
    for parts in (2, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        _, vocab, enc, total = C.prepare_corpus(docs.repartition(parts), params)
        st = TR.train(enc, vocab, total, params, dim=6, epochs=2, neg_k=4, evaluate=lambda theta, e: evals.append((e, theta.count())))
        got.append(np.asarray([r["vec"] for r in st.theta.orderBy("word_id").collect()], dtype=np.float64))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert np.allclose(got[0], got[1], atol=1e-6)
    assert evals == [(0, vocab.count()), (1, vocab.count())] * 2


def test_resume_continues_from_the_newest_checkpoint(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"t{(i * 7 + k * k) % 30}" for k in range(80))) for i in range(20)], "doc_id long, text string")
    params = Word2VecParams(min_count=1, subsample=0.0, window_size=2, shards=2, learning_rate=0.3, resume_epochs=2, resume_learning_rate=0.05)
    _, vocab, enc, total = C.prepare_corpus(docs, params)
    TR.train(enc, vocab, total, params, dim=6, epochs=2, neg_k=4, checkpoint_path=str(tmp_path))
    st = TR.resume_from(str(tmp_path), enc, vocab, total, params, dim=6, neg_k=4)
    m = st.metrics.orderBy("epoch", "round").collect()
    assert [r["epoch"] for r in m] == [2, 3] and st.epoch == 4
    assert m[0]["lr"] == 0.05  # the schedule restarts and falls over this run's two epochs
    assert abs(m[1]["lr"] - 0.05 * (1 - 1.2 * m[1]["words_before"] / (total * 2.0))) < 1e-12


def test_training_lowers_the_loss(spark):
    rng = np.random.default_rng(5)
    # A corpus with structure: word pairs that always co-occur.
    words = []
    for _ in range(3000):
        a = int(rng.integers(0, 20))
        words += [f"a{a}", f"b{a}"]
    docs = spark.createDataFrame([(i, " ".join(words[i:i + 500])) for i in range(0, len(words), 500)],
                                 "doc_id long, text string")
    params = Word2VecParams(min_count=1, subsample=0.0, window_size=1, pairs_per_round=3008, learning_rate=0.5)
    toks, vocab, enc, total = C.prepare_corpus(docs, params)
    st = TR.train(enc, vocab, total, params, dim=8, epochs=3, neg_k=5, shards=2)
    m = [r["mean_batch_loss"] for r in st.metrics.orderBy("epoch", "round").collect()]
    assert len(m) >= 6 and m[-1] < m[0]
    assert st.theta.count() == vocab.count()


def test_untied_round_single_shard_equals_sequential_loop(spark):
    rng = np.random.default_rng(4)
    V, d = 7, 4
    w_in, w_out = rng.normal(0, 0.2, (V, d)), rng.normal(0, 0.2, (V, d))
    pairs = [(p, p // 3, int(rng.integers(0, V)), int(rng.integers(0, V))) for p in range(12)]
    negs = [(p, j, int(rng.integers(0, V))) for p, *_ in pairs for j in range(3)]
    negs = [(p, j, s) for p, j, s in negs if s != pairs[p][3]]
    stream = spark.createDataFrame([(p, b, i, l, 0.3) for p, b, i, l in pairs],
                                   "pair_idx long, batch_id long, input_id long, label_id long, lr double")
    ndf = spark.createDataFrame(negs, "pair_idx long, draw long, sample long")
    tin = spark.createDataFrame([(i, [float(x) for x in w_in[i]]) for i in range(V)], "word_id long, vec array<float>")
    tout = spark.createDataFrame([(i, [float(x) for x in w_out[i]]) for i in range(V)], "word_id long, vec array<float>")
    new_in, new_out = TR.untied_round(stream, ndf, tin, tout, shards=1)
    a_in = np.asarray([r["vec"] for r in tin.orderBy("word_id").collect()], dtype=np.float64)
    a_out = np.asarray([r["vec"] for r in tout.orderBy("word_id").collect()], dtype=np.float64)
    for p, b, i, l in pairs:
        TR.untied_step(a_in, a_out, np.array([i]), np.array([l]), [np.array([s for q, _, s in negs if q == p])], 0.3)
    got_in = np.asarray([r["vec"] for r in new_in.orderBy("word_id").collect()])
    got_out = np.asarray([r["vec"] for r in new_out.orderBy("word_id").collect()])
    assert np.allclose(got_in, a_in, atol=1e-6) and np.allclose(got_out, a_out, atol=1e-6)


def test_untied_epoch_runs_in_bounded_rounds(spark):
    rng = np.random.default_rng(6)
    V, d, shards, per_round = 9, 4, 2, 2
    pairs = [(p, p // 3, int(rng.integers(0, V)), int(rng.integers(0, V))) for p in range(40)]
    negs = [(p, j, int(rng.integers(0, V))) for p, *_ in pairs for j in range(3)]
    negs = [(p, j, s) for p, j, s in negs if s != pairs[p][3]]
    stream = spark.createDataFrame([(p, b, i, l, 0.3) for p, b, i, l in pairs],
                                   "pair_idx long, batch_id long, input_id long, label_id long, lr double")
    ndf = spark.createDataFrame(negs, "pair_idx long, draw long, sample long")
    theta = [spark.createDataFrame([(i, [float(x) for x in rng.normal(0, 0.2, d)]) for i in range(V)], "word_id long, vec array<float>")
             for _ in range(2)]
    work = TR.untied_epoch_work(stream, ndf, shards, 14, per_round)
    sizes = [r["count"] for r in work.where("kind = 0").groupBy("round", "shard").count().collect()]
    assert sum(sizes) == len(pairs) and max(sizes) <= 3 * per_round and work.where("kind = 1").count() == len(negs)
    want = [np.asarray([r["vec"] for r in t.orderBy("word_id").collect()], dtype=np.float64) for t in theta]
    for r in range(4):
        deltas = []
        for s in range(shards):
            own = [x.copy() for x in want]
            for p, b, i, l in pairs:
                if b // 7 == s and b % 7 // per_round == r:
                    TR.untied_step(*own, np.array([i]), np.array([l]), [np.array([x for q, _, x in negs if q == p])], 0.3)
            deltas.append([a - w for a, w in zip(own, want)])
        for k in range(2):
            moved = sum(np.any(x[k] != 0, axis=1).astype(int) for x in deltas)
            want[k] = want[k] + sum(x[k] for x in deltas) / np.maximum(moved, 1)[:, None]
    got = TR.untied_epoch(stream, ndf, *theta, shards, per_round)
    for g, w in zip(got, want):
        assert np.allclose(np.asarray([r["vec"] for r in g.orderBy("word_id").collect()]), w, atol=1e-5)
    assert TR.untied_epoch(stream.limit(0), ndf, *theta, shards, per_round)[0].count() == V


def test_one_shard_one_round_equals_sequential_sgd(spark):
    from twinvec.operators.sampling import noise
    rng = np.random.default_rng(9)
    words = [f"t{int(x)}" for x in rng.integers(0, 12, 600)]
    docs = spark.createDataFrame([(i, " ".join(words[i:i + 100])) for i in range(0, 600, 100)],
                                 "doc_id long, text string")
    params = Word2VecParams(min_count=1, subsample=0.0, window_size=2, learning_rate=0.3)
    toks, vocab, enc, total = C.prepare_corpus(docs, params)
    theta0 = TR.start_matrix(vocab, 6, params.seed)
    st = TR.train(enc, vocab, total, params, dim=6, epochs=1, theta=theta0, neg_k=4, shards=1)
    # Sequential replay of the same stream, negatives and rate with the NumPy kernel.
    stream = C.epoch_stream(enc, total, params, 0)
    pairs = sorted((r["batch_id"], r["pair_idx"], r["input_id"], r["label_id"]) for r in stream.collect())
    negs = shared_negatives(stream.select("batch_id").distinct(), noise(vocab), 4, params.seed, 0)
    by_batch = {}
    for r in negs.collect():
        by_batch.setdefault(r["batch_id"], []).append((r["draw"], r["word_id"]))
    ids = sorted(r["word_id"] for r in vocab.collect())
    W = np.asarray([r["vec"] for r in theta0.orderBy("word_id").collect()], dtype=np.float64)
    q = TR.sign_vector(6)
    batches = sorted({p[0] for p in pairs})
    for b in batches:
        bp = [p for p in pairs if p[0] == b]
        ii = np.asarray([ids.index(p[2]) for p in bp])
        jj = np.asarray([ids.index(p[3]) for p in bp])
        kk = np.asarray([ids.index(w) for _, w in sorted(by_batch[b])])
        _, rows, grads = TR.tied_loss_and_grads(W, ii, jj, kk, q)
        np.add.at(W, rows, -params.learning_rate * grads)
    got = np.asarray([r["vec"] for r in st.theta.orderBy("word_id").collect()], dtype=np.float64)
    assert np.allclose(got, W.astype(np.float32), atol=1e-6)


def test_training_queries_take_epochs_dimensions_and_negatives(spark):
    from twinvec.plans import catalog
    sf = "/root/testdata/sf0.001"
    m = catalog.train_epoch_q(spark, sf, epochs=2, dim=8, neg_k=5).collect()
    assert {r["epoch"] for r in m} == {0, 1}
    m = catalog.resume_q(spark, sf, epochs=2, resume_epochs=2, dim=8, neg_k=5).collect()
    assert {r["epoch"] for r in m} == {2, 3}
    assert catalog.neg_shared_q(spark, sf, neg_k=5).groupBy("batch_id").count().select("count").distinct().collect()[0][0] == 5


def test_md5_of_many_keys_is_the_library_s():
    import hashlib

    from twinvec.functions.rand import md5_numbers
    keys = np.array([0, 9, 10, 99, 100, 999_999_999, 10 ** 9, 12345678901, 10 ** 18, 5])
    for before in ("42:negp:0:", "x" * 50):  # the second is longer than one block holds
        got = md5_numbers(before, keys, ":3")
        assert got.tolist() == [np.frombuffer(hashlib.md5(f"{before}{k}:3".encode()).digest(), dtype=">u4").tolist() for k in keys.tolist()]


def test_negatives_drawn_in_tasks_are_those_of_the_join(spark):
    """without a join or an exchange of the draws, the same rows as the bucketed join gives."""
    from twinvec.operators.sampling import per_pair_negatives
    vocab = spark.createDataFrame([(i, f"w{i}", 100 // (i + 1) + 1) for i in range(12)], "word_id long, word string, freq long")
    stream = spark.range(3000).selectExpr("id pair_idx", "id % 12 label_id", "id div 16 batch_id")
    nz = noise(vocab)
    pairs = per_pair_negatives(stream, nz, 6, 5, 2)
    assert sorted(pairs.collect()) == sorted(per_pair_negatives(stream, nz, 6, 5, 2, n_buckets=64).collect())
    assert "Join" not in pairs._jdf.queryExecution().executedPlan().toString()
    for k in (4, 12):  # 12: some batches need further draws
        shared = shared_negatives(stream.select("batch_id"), nz, k, 5, 2)
        want = shared_negatives(stream.select("batch_id"), nz, k, 5, 2, n_buckets=64)
        assert sorted(shared.select("batch_id", "word_id", "draw").collect()) == sorted(want.select("batch_id", "word_id", "draw").collect())
        assert "Join" not in shared._jdf.queryExecution().executedPlan().toString()


def test_batches_with_drawn_negatives_are_those_with_stored_ones(spark):
    """no negative is a row and, without gradients, no gradient either; losses, logit sums and gradients stay."""
    rng = np.random.default_rng(4)
    vocab = spark.createDataFrame([(i, f"w{i}", int(f)) for i, f in enumerate(rng.integers(1, 90, 40))], "word_id long, word string, freq long")
    rows = [(i, i // 16, int(a), int(b)) for i, (a, b) in enumerate(rng.integers(0, 40, (1003, 2)))]  # the last batch is short
    stream = spark.createDataFrame(rows, "pair_idx long, batch_id long, input_id long, label_id long")
    nz, theta = noise(vocab), TR.start_matrix(vocab, 6, 42)
    theta = theta.select("word_id", F.transform("vec", lambda v: (v * 20).cast("float")).alias("vec"))
    want = TR.evaluate_at(stream, shared_negatives(stream.select("batch_id"), nz, 5, 42, 0), theta)
    got = TR.evaluate_drawn(stream, nz, 5, 42, 0, theta, batches=7)

    def sums(df):
        return {(r["kind"], r["batch_id"]): r["loss"] for r in df.where("kind <> 'row'").collect()}
    a, b = sums(want), sums(got)
    assert a.keys() == b.keys() and len(a) == 3 * 63 and all(abs(a[x] - b[x]) < 1e-9 for x in a)
    ga, gb = ({r["word_id"]: r["grad"] for r in TR.merge_gradients(df).collect()} for df in (want, got))
    assert ga.keys() == gb.keys() and all(np.allclose(ga[x], gb[x], atol=1e-9) for x in ga)
    bare = TR.evaluate_drawn(stream, nz, 5, 42, 0, theta, gradients=False, batches=7)
    assert sums(bare) == b and bare.where("kind = 'row'").count() == 0


def test_pairs_without_a_common_row_run_together():
    # Three centres with their own words: the pairs of one centre follow each other, those of different centres need not wait.
    waves = TR._waves([0, 0, 1, 1, 2], [[10, 11], [12, 13], [20, 21], [10, 22], [30, 31]])
    assert waves.tolist() == [0, 1, 0, 1, 0]
    rng = np.random.default_rng(5)
    w_in, w_out = rng.normal(0, 0.3, (40, 4)), rng.normal(0, 0.3, (40, 4))
    one_in, one_out = w_in.copy(), w_out.copy()
    ex, lab = rng.integers(0, 40, 300), rng.integers(0, 40, 300)
    negs = [rng.integers(0, 40, n) for n in rng.integers(0, 6, 300)]
    loss = TR.untied_step(w_in, w_out, ex, lab, negs, 0.2)
    alone = sum(TR.untied_step(one_in, one_out, ex[i:i + 1], lab[i:i + 1], negs[i:i + 1], 0.2) for i in range(300))
    assert np.allclose(w_in, one_in) and np.allclose(w_out, one_out) and abs(loss - alone) < 1e-9


def test_batches_in_a_run_equal_batches_by_themselves():
    rng = np.random.default_rng(6)
    W, q = rng.normal(0, 0.3, (12, 4)), TR.sign_vector(4)
    one, total = W.copy(), 0.0
    ii, jj = rng.integers(0, 12, (20, 3)), rng.integers(0, 12, (20, 3))
    kk = np.stack([rng.choice(12, 5, replace=False) for _ in range(20)])
    for i, j, k in zip(ii, jj, kk):
        loss, rows, grads = TR.tied_loss_and_grads(one, i, j, k, q)
        np.add.at(one, rows, -0.1 * grads)
        total += loss
    assert abs(TR.tied_steps(W, ii, jj, kk, q, 0.1) - total) < 1e-9 and np.allclose(W, one)


def test_means_of_changed_rows(spark):
    rows = [(w, i, s, np.array([s + i, 1.0 * w], dtype="<f8").tobytes(), 0.0, 1) for w in (0, 1) for i in range(30) for s in range(1 + i % 3)]
    changed = spark.createDataFrame([(-1, -1, 0, None, 2.0, 1)] + rows, TR.CHANGED)
    got = {(r["which"], r["word_id"]): r["vec"] for r in TR.averaged(changed, len(rows)).collect()}
    assert got == {(w, i): [i + (i % 3) / 2, w] for w in (0, 1) for i in range(30)}
