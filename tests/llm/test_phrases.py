import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import table
from twinvec.llm import phrases as P

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest=4, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cand.items():
            inside = lambda q: any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and 100 * b >= 80 * a and inside(q) for q, b in cand.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows.append((lang, " ".join(p), a, left, right, n[lang], score))
        rows.sort(key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], i, *r[1:]) for i, r in enumerate(rows[:top], 1)]
    return sorted(out)


def texts(seed, n, vocabulary):
    r = random.Random(seed)
    fixed = ["new york city", "New York", "a b c d e f", "é ü", "of the", "x x x x x x"]
    word = lambda: r.choice(fixed) if r.random() < 0.3 else f"w{int(vocabulary * r.random() ** 3)}"
    return ["".join(word() + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ;", "\x0b", "!?", "\xa0"]) for _ in range(r.randrange(40))) for _ in range(n)]


def got(df, **kw):
    return sorted(tuple(x) for x in P.mine(df, **kw).collect())


@pytest.mark.parametrize("least,small", [(3, False), (2, True)])
def test_equals_brute_force(spark, monkeypatch, least, small):
    if small:  # many blocks and shards
        monkeypatch.setattr(P, "SHARD_BYTES", 2000)
        monkeypatch.setattr(P.words, "__defaults__", (700,))
    own = texts(least, 160, 60) + [None, "", " . ,", "one", "dog cat " * 3000]
    r = random.Random(9)
    langs = [r.choice(["en", "de", None, "und", ""]) for _ in own]
    assert got(table(spark, own, langs=langs), min_count=least) == brute(list(zip(langs, own)), least)


def test_top_and_ties(spark):
    own = ["b a. d c. f e. a b c"] * 5 + ["z y x w v u"] * 4
    rows = list(zip(["en"] * 9, own))
    for top in (1, 2, 3, 100):
        assert got(table(spark, own), min_count=2, top=top) == brute(rows, 2, top=top)


def test_no_words(spark):
    assert got(table(spark, [])) == [] == got(table(spark, [None, "", ".."]))


def test_a_long_phrase_takes_the_place_of_its_parts(spark):
    own = ["alpha beta gamma delta"] * 50 + ["beta gamma"] * 20
    assert [x[2] for x in got(table(spark, own))] == ["beta gamma", "alpha beta gamma delta"]


def test_scores_beyond_64_bits(spark):
    big = 4_000_000_000_000_000_000  # counts of a corpus no test can hold, as streams
    words = spark.createDataFrame([(0, "en", "p", big), (1, "en", "q", big)], "name long, lang string, word string, c long")
    pairs = spark.createDataFrame([(0, 0, 1, big - 7)], "name long, a long, b long, c long")
    none = pairs.where("false")
    n = spark.createDataFrame([("en", 2 * big)], "lang string, n long")
    keep, P.count = P.count, lambda *a: (n, [words, pairs, none, none])
    try:
        assert got(table(spark, [])) == [("en", 1, "p q", big - 7, big, big, 2 * big, 2_000_000 * (big - 7) // (2 * big))]
    finally:
        P.count = keep


def test_stretches_are_cut_between_pieces():
    r = random.Random(2)
    for _ in range(200):
        parts = ["".join(r.choice("ab \n") for _ in range(r.randrange(30))) for _ in range(r.randrange(1, 6))]
        data = np.frombuffer("".join(parts).encode(), dtype=np.uint8)
        ends = np.cumsum([len(p) for p in parts])
        at = 0
        for lo, hi in P._stretches(data, ends, 8):
            assert lo == at < hi
            assert hi in ends or data[hi - 1] == P.BREAK
            if hi - lo > 8:
                assert P.BREAK not in data[lo:hi - 1] and not any(lo < e < hi for e in ends)
            at = hi
        assert at == len(data)
