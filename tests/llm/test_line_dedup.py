import random

from pyspark.sql import functions as F

from tests.llm.helpers import table
from twinvec.llm.line_dedup import dedup


def brute(docs, window):
    seen, out = set(), {}
    for i, text in sorted(docs.items()):
        if text is None:
            out[i] = (None, 0, 0)
            continue
        lines, lost = text.split("\n"), set()
        for s in range(len(lines) - window + 1):
            key = tuple(lines[s:s + window])
            if key in seen:
                lost |= set(range(s, s + window))
            seen.add(key)
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in lost), len(lines), len(lost))
    return out


def test_equals_brute_force(spark):
    r = random.Random(3)
    docs = {i: "\n".join(r.choice("abcdefgh") for _ in range(r.randrange(0, 40))) for i in range(60)}
    docs |= {60: None, 61: "", 62: "\n" * 3000, 63: "one line", 64: docs[5], 65: "\n".join(str(i) for i in range(20_000))}
    for window in (1, 2, 3, 5):
        d = dedup(table(spark, list(docs.values()), ids=list(docs)), window)
        assert {x["doc_id"]: (x["text"], x["n_lines"], x["n_removed"]) for x in d.collect()} == brute(docs, window)


def test_other_columns_stay_and_no_rows(spark):
    d = dedup(table(spark, ["a\nb\nc", "a\nb\nc\nd"]))
    assert d.select("own", "starts", "k", "row").distinct().collect() == [("x", "x", "x", "x")]
    assert dedup(table(spark, [])).count() == 0


def test_rows_of_one_id(spark):
    got = dedup(table(spark, ["a\nb\nc"] * 3 + ["a\nb\nc"], ids=[1, 1, 1, 2])).orderBy("doc_id").collect()
    assert [x["text"] for x in got] == ["a\nb\nc"] * 3 + [""]
    none = dedup(table(spark, ["a\nb\nc", "a\nb\nc"], ids=[None, 1])).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    assert [x["text"] for x in none] == ["a\nb\nc", ""]


def test_line_that_very_many_documents_share(spark):
    texts = [f"hot\n{i}\nhot\nhot" for i in range(2000)]
    assert dedup(table(spark, texts)).where("n_removed > 0").count() == 0
