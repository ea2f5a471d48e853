import numpy as np
import pytest

from twinvec.llm import embedding_dedup as E


def brute(vecs):
    ids = sorted(vecs)
    root, n = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def unit(v):
        if v is None or any(x is None for x in v):
            return None
        v = np.array(v, dtype=np.float64)
        return v / np.linalg.norm(v) if np.isfinite(v).all() and (v != 0).any() else None

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    u = {i: unit(vecs[i]) for i in ids}
    for a in ids:
        for b in ids:
            if a < b and u[a] is not None and u[b] is not None and len(u[a]) == len(u[b]) and u[a] @ u[b] >= 0.9:
                n[a] += 1
                n[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (n[i], find(i), find(i) == i) for i in ids}


def collection():
    r = np.random.default_rng(8)
    base = r.standard_normal((60, 24))
    vecs = [b.astype(np.float32).tolist() for b in base]
    vecs += [(base[0] + 0.05 * r.standard_normal(24)).astype(np.float32).tolist() for _ in range(90)]
    vecs += [(base[1] + 0.2 * r.standard_normal(24)).astype(np.float32).tolist() for _ in range(30)]
    vecs += [vecs[2]] * 6 + [[2 * x for x in vecs[2]], None, [0.0] * 24, [float("nan")] * 24, [float("inf")] + [0.0] * 23, [None] + [1.0] * 23, [],
                            [1.0, 0.0], [1.0, 0.0], [1e-30] * 24, [1e30] * 24]
    return dict(enumerate(vecs))


@pytest.mark.parametrize("tile", [2048, 16])
def test_equals_brute_force(spark, tile):
    vecs = collection()
    d = spark.createDataFrame([(i, v, 0, "x") for i, v in vecs.items()], "vec_id long, embedding array<float>, label int, cls string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in E.near_duplicates(d, recall=0.9999, tile=tile).collect()}
    assert got == brute(vecs)


def test_doubles_repeated_rows_and_no_rows(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 1e-12]), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = {(r["vec_id"], r["n_links"], r["component_id"]) for r in E.near_duplicates(d).collect()}
    assert got == {(1, 1, 1), (2, 1, 1), (None, 0, None)}
    assert E.near_duplicates(d.limit(0)).collect() == []


def test_recall_on_the_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    want = sum(brute_links([r["embedding"] for r in rows]))
    got = sum(r["n_links"] for r in E.op4_embedding_dedup(spark, "/root/testdata/sf0.1").collect())
    assert 0.9 * want <= got <= want


def brute_links(vecs):
    v = np.array(vecs, dtype=np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return (v @ v.T >= 0.9).sum(axis=1) - 1
