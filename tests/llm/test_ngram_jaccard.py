import random
from collections import Counter, defaultdict

import pytest

from tests.llm.helpers import prose, table, words
from twinvec.llm import ngram_jaccard as N
from twinvec.llm.components import components


def shingles(text):
    ws = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(ws[i:i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())


def brute(docs):
    sets, where, root = {i: shingles(t) for i, t in docs.items()}, defaultdict(list), {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in sorted(docs):
        both = Counter(j for g in sets[i] for j in where[g])
        for j, n in both.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for g in sets[i]:
            where[g].append(i)
    return {i: (len(sets[i]), find(i)) for i in docs}


def collection(seed=4):
    r, docs = random.Random(seed), []
    for k in range(12):
        base = prose(k, r.choice([1, 4, 5, 8, 30, 90, 200]), 3000).split()
        for _ in range(r.randrange(1, 14)):
            ws = list(base)
            for _ in range(r.randrange(0, 1 + len(ws) // 25)):
                ws[r.randrange(len(ws))] = f"x{r.randrange(10 ** 6)}"
            docs.append(" ".join(w.upper() if r.random() < 0.1 else w for w in ws))
    hot = prose(77, 60)
    docs += [prose(500 + i, 80, 10 ** 6) + " " + hot for i in range(40)] + [None, "", "\t", "É é", "é É", docs[0], prose(9, 30_000, 10 ** 6)]
    # A chain: each text shares four fifths with the next only.
    chain = prose(1234, 400, 10 ** 6).split()
    docs += [" ".join(chain[20 * i:20 * i + 200]) for i in range(8)]
    r.shuffle(docs)
    return dict(enumerate(docs))


@pytest.mark.parametrize("few", [0, 32])
def test_equals_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(N, "FEW_PAIRS", few)  # 0: rounds of centres are always taken first
    docs = collection(4 + few)
    got = N.near_duplicates(table(spark, list(docs.values()), ids=list(docs)))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute(docs)


def test_repeated_rows_null_ids_and_no_rows(spark):
    t = prose(3, 40)
    got = N.near_duplicates(table(spark, [t, t, t, t], ids=[7, 7, 9, None])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in got) == sorted([(7, 7), (7, 7), (9, 7), (-1, None)], key=lambda x: x[0])
    assert N.near_duplicates(table(spark, [])).collect() == []


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 50)] + [(70, 71), (71, 70), (72, 72)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 5 for i in range(5, 50)} | {70: 70, 71: 70}


def test_an_id_with_two_texts_is_one_node(spark):
    a, b = prose(21, 60, 10 ** 6), prose(22, 60, 10 ** 6)
    near = lambda t: t.rsplit(" ", 1)[0] + " other"
    got = N.near_duplicates(table(spark, [a, b, near(b), near(a), prose(23, 60, 10 ** 6)], ids=[1, 1, 2, 3, 4])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_tables_are_deleted_after_use(spark):
    import os

    got = N.near_duplicates(table(spark, list(collection(9).values())))
    root = os.path.dirname(got.stored_at.removeprefix("file:"))
    held = set(os.listdir(root))
    again = N.near_duplicates(table(spark, list(collection(9).values())))
    assert set(os.listdir(root)) - held == {os.path.basename(again.stored_at)}


def test_two_groups_that_share_many_ngrams_are_a_pair_about_once(spark):
    """Thirty groups have 200 n-grams in common but for a few: 435 pairs, not one for each shared n-gram."""
    r = random.Random(4)
    held = {g: sorted(r.sample(range(200), 170)) for g in range(30)}
    heads = spark.createDataFrame([(gram, g, 200, g, g, 1, [0] * (N.BITS // 64), [0] * (N.BITS // 64)) for g, own in held.items() for gram in own],
                                  "gram long, gid long, n long, lo long, hi long, m long, every array<long>, some array<long>")
    got = [(x["gid1"], x["gid2"]) for x in N.group_pairs(heads, 80).collect()]
    assert set(got) == {(a, b) for a in held for b in held if a < b} and len(got) < 3 * 435


def test_no_pair_of_groups_is_lost_whatever_lies_before_the_shared_ngram(spark):
    held = {0: [1, 5, 9], 1: [2, 5], 2: [9], 3: [1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12, 13], 4: [20], 5: [13, 20]}
    heads = spark.createDataFrame([(gram, g, 200, g, g, 2, [0] * (N.BITS // 64), [0] * (N.BITS // 64)) for g, own in held.items() for gram in own],
                                  "gram long, gid long, n long, lo long, hi long, m long, every array<long>, some array<long>")
    got = {(x["gid1"], x["gid2"]) for x in N.group_pairs(heads, 80).collect()}
    assert got == {(a, b) for a in held for b in held if a < b and set(held[a]) & set(held[b])}


def test_groups_of_several_are_a_pair_only_if_members_may_be_similar(spark):
    """No member of group 0 has a bit of the first 40, all of group 1 have them; group 2 has members with and without."""
    bits = {0: (0, 0), 1: ((1 << 40) - 1, (1 << 40) - 1), 2: (0, (1 << 40) - 1)}
    rest = [0] * (N.BITS // 64 - 1)
    heads = spark.createDataFrame([(7, g, 100, g, g, 3, [a, *rest], [b, *rest]) for g, (a, b) in bits.items()],
                                  "gram long, gid long, n long, lo long, hi long, m long, every array<long>, some array<long>")
    assert {(x["gid1"], x["gid2"]) for x in N.group_pairs(heads, 80).collect()} == {(0, 2), (1, 2)}
