from collections import Counter

from tests.llm.helpers import prose, table, words
from twinvec.llm import quality_rules as Q


def brute(text):
    text = text or ""
    ws, lines = words(text), [x for x in text.split("\n") if words(x)]
    grams = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    times = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if times[g] > 1 for j in range(3)}
    joined = "".join(ws)
    return len(ws), len(joined), sum(c in "#*$%&|<>" for c in joined), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n\t\x0b ", "one", "a b c a b c", "x " * 500, "é# $ü\n\né# $ü\n" * 3, "a\x85b c d " * 20, prose(1, 30_000, 50), prose(2, 60), "\n".join(["l m"] * 40),
         "very " + "long" * 50_000]


def test_statistics_equal_brute_force(spark):
    got = {r["doc_id"]: r for r in Q.statistics(table(spark, TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(t), t[:40] if t else t


def test_sketch_quartiles_are_exact_to_a_bin_and_merge(spark):
    n = [i * i % 997 for i in range(600)]
    rows = [("en", "a" if i % 3 else "b", "symbols", x, 1) for i, x in enumerate(n)]
    sk = spark.createDataFrame(rows, "lang string, source string, rate string, bin long, n long")
    q = Q.quartiles(sk, ["lang"]).first()
    s = sorted(n)
    assert (q["docs"], q["q25"], q["q75"]) == (600, s[149], s[449])


def test_outliers_go_and_clean_documents_stay(spark):
    clean = [prose(i, 120, 5000) for i in range(200)]
    junk = [" ".join(w + "$$$" for w in prose(900 + i, 120, 5000).split()) for i in range(10)]
    short, repeated = ["too short"], ["the same words " * 60]
    d = table(spark, clean + junk + short + repeated + [None], langs=[None] * 100 + ["en"] * 113)
    got = {r["doc_id"]: r for r in Q.judge(d).collect()}
    assert all(got[i]["kept"] for i in range(200))
    assert not any(got[i]["kept"] for i in range(200, 213))
    assert [got[i]["base_failed"] for i in (0, 200, 210, 211, 212)] == [False, False, True, True, True]


def test_no_rows_and_only_failures(spark):
    assert Q.judge(table(spark, [])).collect() == []
    assert [r["kept"] for r in Q.judge(table(spark, ["a", None])).collect()] == [False, False]
