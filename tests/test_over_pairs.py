"""Pairs that are used where they are made: no pair, draw or gradient of a pair is a row."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinvec.operators import corpus as C
from twinvec.operators import sampling as S
from twinvec.params import Word2VecParams


def kept_tokens(spark, n=2003, words=40):
    return spark.range(n).selectExpr("id k", f"(id * id + id div 7) % {words} word_id").repartition(5)


def vocabulary(spark, words=40):
    return spark.createDataFrame([(i, f"w{i}", 900 // (i + 1) + 1) for i in range(words)], "word_id long, word string, freq long")


@pytest.mark.parametrize("n,size,parts,window", [(2003, 50, 9, 3), (1003, 7, 30, 2), (16_100, 1000, 2, 2), (5, 1000, 4, 3), (40, 1, 3, 2), (0, 10, 2, 2)])
def test_tasks_get_the_stream_s_pairs_in_whole_batches(spark, n, size, parts, window):
    """every pair once, with its number, in order; a batch is never cut by the end of a task's range."""
    kept = kept_tokens(spark, n, 977)

    def task(copy, chunks, given):
        told = len(list(given))
        for found in chunks:
            yield pa.RecordBatch.from_arrays([*map(pa.array, found), pa.array(np.full(len(found[0]), copy)), pa.array(np.full(len(found[0]), told)),
                                              pa.array(np.full(len(found[0]), found[0][0]))], names=["p", "i", "l", "copy", "told", "first"])
    first = spark.createDataFrame([(b"x",), (b"y",)], "data binary")
    got = C.over_pairs(kept, task, "p long, i long, l long, copy long, told long, first long", window, True, 42, 1, size, 16, parts, 2, first).collect()
    want = sorted(map(tuple, C.pair_stream(kept, window, 16, True, 42, 1, size, ["pair_idx", "input_id", "label_id"]).collect()))
    for copy in (0, 1):
        assert sorted((r["p"], r["i"], r["l"]) for r in got if r["copy"] == copy) == want
    assert all(r["told"] == 2 and r["first"] % 16 == 0 for r in got)


def test_counted_negatives_are_those_of_the_rows(spark, monkeypatch):
    """F2 (neg_pair): the counts of the rows' draws, while only packed tokens and counts are exchanged."""
    monkeypatch.setattr(S, "DRAWS_SORTED", 3000)
    kept, nz, params = kept_tokens(spark), S.noise(vocabulary(spark)), Word2VecParams(window_size=3, sentence_size=50, seed=5)
    stream = C.pair_stream(kept, 3, 16, True, 5, 2, 50)
    want = S.per_pair_negatives(stream, nz, 5, 5, 2).groupBy("sample").agg(F.count(F.lit(1)).alias("n"))
    got = S.negative_counts(kept, nz, 5, params, 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan and "pair_idx" not in plan
    monkeypatch.setattr(S, "MAX_SAMPLER_WORDS", 3)
    assert sorted(map(tuple, S.negative_counts(kept, nz, 5, params, 2).collect())) == sorted(map(tuple, want.collect()))


def test_the_cdf_travels_as_runs(spark):
    """F2, F8: what the driver collects and sends are the runs of one weight; ids in another order are sent as they are."""
    import pickle
    many = spark.range(20_000).selectExpr("id word_id", "cast(id as string) word", "1 + (20000 - id) div 5000 freq")
    nz = S.noise(many)
    own = S.Sampler.of(nz)
    assert len(pickle.dumps(own)) < 2000
    rows = sorted(nz.select("lo", "word_id").collect())
    assert own.lo.tolist() == [r["lo"] for r in rows] and own.ids.tolist() == [r["word_id"] for r in rows]
    mixed = S.noise(spark.range(50).selectExpr("id word_id", "'w' word", "1 + id % 3 freq"))
    assert sorted(zip(S.Sampler.of(mixed).ids.tolist(), S.Sampler.of(mixed).lo.tolist())) == sorted((r["word_id"], r["lo"]) for r in mixed.collect())


def test_guided_draws_are_those_of_the_search():
    rng = np.random.default_rng(1)
    for words in (1, 3, 50, 5000):
        w = rng.zipf(1.2, words).clip(1, 10 ** 6).astype(np.int64)
        own = S.Sampler(np.arange(words), (np.cumsum(w) - w) / w.sum())
        draws = rng.integers(0, 1 << 32, 20_000, dtype=np.uint32)
        draws[:2] = 0, (1 << 32) - 1
        edges = np.minimum(own._steps, (1 << 32) - 1).astype(np.uint32)[:9000]
        draws[2:2 + len(edges)] = edges
        draws[10_000:10_000 + len(edges) - 1] = edges[1:] - np.uint32(1)
        assert (own.drawn(draws) == own.words(draws / 2.0 ** 32)).all()


@pytest.mark.parametrize("held", [256 << 20, 9 * 6 * 4])
def test_losses_where_pairs_are_made_are_those_of_stored_pairs(spark, monkeypatch, held):
    """F1, F4, F5 (nce_loss, tied_logits, tied_grad): same losses, sums and gradients, with known vectors for some words, while no pair, no
    negative and no matrix is stored or shuffled. The second case keeps nine rows of a task's vectors and draws the others as they come."""
    from twinvec.operators import training as TR
    monkeypatch.setattr(TR, "HELD_BYTES", held)
    kept, vocab, params = kept_tokens(spark), vocabulary(spark), Word2VecParams(window_size=3, sentence_size=50, seed=5)
    rng = np.random.default_rng(3)
    known = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=6)]) for i in (0, 3, 7, 11, 20, 39, 55)] + [(5, None)],
                                  "word_id long, vec array<float>")
    nz = S.noise(vocab)
    stream = C.pair_stream(kept, 3, 16, True, 5, 2, 50)
    want = TR.evaluate_drawn(stream, nz, 5, 5, 2, TR.start_matrix(vocab, 6, 5, known))
    out = TR.evaluate_kept(kept, vocab, nz, 5, params, 2, 6, known)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "pair_idx" not in plan and "FlatMapCoGroups" not in plan
    got = {(x, r["batch_id"]): r[x] for r in out.collect() for x in ("loss", "sum_true", "sum_sampled")}
    told = {(r["kind"], r["batch_id"]): r["loss"] for r in want.where("kind <> 'row'").collect()}
    assert got.keys() == told.keys() and all(abs(got[x] - told[x]) < 1e-9 for x in got)
    sums, whole = ({r["word_id"]: r["grad"] for r in df.collect()} for df in
                   (TR.gradients_kept(kept, vocab, nz, 5, params, 2, 6, known), TR.merge_gradients(want)))
    assert sums.keys() == whole.keys() and all(np.allclose(sums[x], whole[x], atol=1e-9) for x in sums)


def test_rows_drawn_in_a_task_are_the_start_matrix(spark):
    from twinvec.operators import training as TR
    rows = TR.StartRows(40, 6, 5)
    want = {r["word_id"]: r["vec"] for r in TR.start_matrix(vocabulary(spark), 6, 5).collect()}
    ids = np.array([[3, 39], [0, 3]])
    assert [[x.tolist() for x in pair] for pair in rows.meet(ids)[ids]] == [[want[i] for i in pair] for pair in ids.tolist()]


def test_copies_of_one_range_run_side_by_side(spark):
    """Spark runs a union of single partitions in one task."""
    kept = kept_tokens(spark, 300)
    out = C.over_pairs(kept, lambda copy, chunks, given: (pa.RecordBatch.from_arrays([pa.array([copy])], names=["c"]) for _ in chunks), "c long",
                       2, sentence_size=1000, parts=1, copies=3)
    assert sorted(r[0] for r in out.select(F.spark_partition_id().alias("p"), "c").groupBy("p").agg(F.count("c")).select(F.col("count(c)")).collect()) == [1, 1, 1]
