"""Small tables for the tests of the training-data operators."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Column names that the operators use inside; inputs may have them too.
CLASHING = "starts string, k string, own string, row string, h string, n_words string, n_removed string, kept string"


def table(spark, texts, ids=None, clashing=True, langs=None, sources=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, (langs or ["en"] * len(texts))[k], (sources or ["s"] * len(texts))[k], len(t or ""))
            + (("x",) * 8 if clashing else ()) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA + (", " + CLASHING if clashing else ""))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))
