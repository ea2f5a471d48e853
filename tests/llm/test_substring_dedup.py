import random

from pyspark.sql import functions as F

from tests.llm.helpers import prose, table, words
from twinvec.llm import shingles
from twinvec.llm.substring_dedup import dedup


def brute(docs, window):
    seen, out = set(), {}
    for i, text in sorted(docs.items()):
        ws, lost = words(text), set()
        for s in range(len(ws) - window + 1):
            key = tuple(ws[s:s + window])
            if key in seen:
                lost |= set(range(s, s + window))
            seen.add(key)
        out[i] = (" ".join(x for k, x in enumerate(ws) if k not in lost), len(ws), len(lost))
    return out


def collection():
    r = random.Random(11)
    passages = [prose(100 + i, n) for i, n in enumerate((19, 20, 21, 60, 200))]
    docs = {}
    for i in range(80):
        parts = [prose(i * 7 + k, r.randrange(0, 40), 10_000) for k in range(3)]
        docs[i] = "\n".join(x + "  " + r.choice(passages) for x in parts)
    docs |= {80: None, 81: "", 82: " \t\n", 83: "one", 84: docs[3], 85: "again " * 5000, 86: prose(5, 60_000, 10 ** 6), 87: prose(5, 60_000, 10 ** 6)[40:],
             88: "é " * 30 + "\x85 x y " * 30}
    return docs


def test_equals_brute_force(spark, monkeypatch):
    docs = collection()
    for window, phrase in ((20, 10), (5, 2)):
        d = dedup(table(spark, list(docs.values()), ids=list(docs)), True, window, phrase)
        assert {x["doc_id"]: (x["text"], x["n_words"], x["n_removed"]) for x in d.collect()} == brute(docs, window)


def test_many_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(shingles, "BLOCK_ROWS", 3)
    docs = collection()
    d = dedup(table(spark, list(docs.values()), ids=list(docs)).repartition(5), True)
    assert {x["doc_id"]: (x["text"], x["n_words"], x["n_removed"]) for x in d.collect()} == brute(docs, 20)


def test_untouched_texts_and_other_columns(spark):
    texts = ["a  b\nc", None, prose(1, 30), prose(1, 30)]
    got = dedup(table(spark, texts)).orderBy("doc_id").collect()
    assert [x["text"] for x in got] == texts[:3] + [""]
    assert {x["own"] for x in got} == {"x"} and got[3]["n_removed"] == 30
    assert dedup(table(spark, [])).collect() == []


def test_rows_of_one_id_and_null_ids(spark):
    t = prose(2, 40)
    got = dedup(table(spark, [t, t, t], ids=[None, 5, 5])).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    assert [x["n_removed"] for x in got] == [0, 40, 40]
