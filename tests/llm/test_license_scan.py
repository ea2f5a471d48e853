import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import prose, table
from twinvec.llm import license_scan as L


@pytest.fixture(scope="module")
def model():
    r = random.Random(1)
    common = "the a of to and in is it you may use this work by for with on at from version file part year city public general terms under".split()
    return L.Model([" ".join(r.choice(common + prose(i, 40).split()) for _ in range(r.randrange(5, 60))) for i in range(400)])


def test_held_out_accuracy(model):
    rng, filler, right, total = np.random.default_rng(77), prose(1, 300).split(), 0, 0
    for name, templates in L.TEMPLATES.items():
        for t in templates:
            for _ in range(10):
                _, found, unknown = model.scan(pa.array([L.vary(t, filler, rng, 11)]))[0]
                right += found == [name] if name != "unknown" else not found and unknown == 1
                total += 1
    assert right / total > 0.85
    plain = model.scan(pa.array([prose(i, 80) for i in range(300)]))
    assert sum(bool(f) or u > 0 for _, f, u in plain) <= 3


def test_notices_in_documents(spark, model):
    texts = [None, "", "\n \n", prose(1, 20) + "\nReleased under the MIT License.\n" + prose(2, 20),
             "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0.", prose(3, 3000) + " This work is licensed under the GNU General Public License, version 3. " + prose(4, 3000),
             "Licensed under the Apache License, Version 2.0.\n" * 2, "Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0."]
    got = [(r["families"], r["n_licenses"], r["n_paragraphs"]) for r in L.scan(table(spark, texts), model).orderBy("doc_id").collect()]
    assert got == [("", 0, 0), ("", 0, 0), ("", 0, 0), ("MIT", 1, 3), ("Apache-2.0,CC-BY-NC-4.0", 2, 2), ("GPL-3.0", 1, 1), ("Apache-2.0", 2, 2),
                   ("CC-BY-4.0", 1, 1), ("CC-BY-SA-4.0", 1, 1)]
    assert L.scan(table(spark, []), model).collect() == []


def test_training_on_tables(spark):
    texts = [prose(i, 30) + "\n" + prose(i + 50, 10) for i in range(40)] + ["Released under the MIT License."]
    d = table(spark, texts)
    assert L.scan(d, L.train(d)).where("families = 'MIT'").count() == 1
    empty = L.train(table(spark, []))
    assert L.scan(d, empty).count() == 41


def test_query_finds_the_planted_lines(spark):
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT",
             "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    got = {r["doc_id"]: r["families"] for r in L.op2_license_scan(spark, "/root/testdata/sf0.01").collect()}
    for d in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        assert got[d["doc_id"]] == ",".join(sorted({f for x, f in lines.items() if x in (d["text"] or "").split("\n")}))
