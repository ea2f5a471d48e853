import hashlib
import itertools
import random
import zlib

import pytest

from tests.llm.helpers import table
from twinvec.llm import merkle as M


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row):
    return h("".join(map(enc, (row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"]))))


def tree(nodes):
    """Levels of a tree, by the definition."""
    rows = [nodes]
    while len(rows[-1]) > 1:
        rows.append([h("".join(rows[-1][i:i + 2])) for i in range(0, len(rows[-1]), 2)])
    return rows


def siblings(rows, p):
    out = []
    for row in rows[:-1]:
        out.append((row[p ^ 1] if p ^ 1 < len(row) else None, p & 1))
        p //= 2
    return out


def brute(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r["lang"], []).append(r)
    key = lambda x: (x is not None, (x or "").encode())
    trees = {}
    for lang, own in langs.items():
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[lang] = tree([leaf(r) for r in own])
    order = sorted(langs, key=key)
    top = tree([trees[x][-1][0] for x in order])
    out = []
    for lang, own in langs.items():
        for p, r in enumerate(own):
            steps = siblings(trees[lang], p) + siblings(top, order.index(lang))
            now = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None:
                now["n_chars"] += 1
            cur = leaf(now)
            for s, left in steps:
                cur = h(cur if s is None else s + cur if left else cur + s)
            out.append((r["doc_id"], leaf(r), trees[lang][-1][0], top[-1][0], h("".join(s for s, _ in steps if s)), cur, cur == top[-1][0]))
    return sorted(out, key=str)


def check(spark, df, levels):
    rows = [r.asDict() for r in df.collect()]
    got = sorted((tuple(x) for x in M.manifest(df, levels).collect()), key=str)
    assert got == brute(rows)
    return got


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_equals_brute_force(spark, levels):
    r = random.Random(levels)
    texts = [f"text {i} é" * r.randrange(5) for i in range(150)] + [None, "", "long " * 200_000]
    langs = [r.choice(["en", "de", "fr", None, "", "é", "z"]) for _ in texts]
    langs[7] = "only one"
    got = check(spark, table(spark, texts, langs=langs), levels)
    assert {x[-1] for x in got} == {True, False}


def test_null_fields_and_ids(spark):
    rows = [(1, None, "en", "s", 3), (None, "a", "en", "s", 1), (None, "b", "en", None, 1), (2, "c", None, None, None), (7, "x", "en", "s", None)]
    rows += [(i, "t", "en", "s", None if i % 2 else 5) for i in range(20, 60)]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), 2)


def test_repeated_rows(spark):
    got = check(spark, table(spark, ["same"] * 9 + ["other"] * 4, ids=[3] * 9 + [3, 3, 4, 5]), 2)
    assert len(got) == 13


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_few_documents(spark, n):
    check(spark, table(spark, ["t"] * n), 2)


def test_every_language_is_one_document(spark):
    check(spark, table(spark, ["t"] * 70, langs=[f"l{i}" for i in range(70)]), 2)


def test_missing_is_the_smallest_union():
    for n in range(1, 40):
        for some in ([0], [n - 1], list(range(n // 3, n)), list(range(0, n, 3)), list(range(n))):
            leaves = {p: f"{p:064d}" for p in some}
            rows = tree([f"{p:064d}" for p in range(n)])
            need = M.missing(some, n)
            assert len(set(need)) == len(need)
            on_paths = {(level, p >> level) for p in some for level in range(len(rows))}
            wanted = {(level, p >> level ^ 1) for p in some for level in range(len(rows) - 1) if p >> level ^ 1 < len(rows[level])}
            assert set(need) == wanted - on_paths  # nothing that can be derived, nothing twice
            got = M.interiors(leaves, n, {c: rows[c[0]][c[1]] for c in need})
            for p in some:
                assert M.path(got, p, n) == [(s, bool(left)) for s, left in siblings(rows, p)]
                assert M.fold(leaves[p], M.path(got, p, n), {}) == rows[-1][0]


def test_proofs_reject_any_other_leaf():
    rows = tree([h(str(i)) for i in range(13)])
    got = M.interiors(dict(enumerate(rows[0])), 13, {})
    for p, q in itertools.product(range(13), repeat=2):
        assert (M.fold(rows[0][q], M.path(got, p, 13), {}) == rows[-1][0]) == (p == q)


def test_hot_nodes_are_fetched_from_each_salt(spark):
    check(spark, table(spark, [f"t{i}" for i in range(600)]), 1)
