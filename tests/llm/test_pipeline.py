"""The pipeline's stages one after the other on the smallest tables, each against brute force on its own input."""

import corpus_pipeline as P
from tests.llm import test_line_dedup, test_ngram_jaccard, test_packing, test_substring_dedup
from twinvec.llm import quality_lm
from twinvec.session import checkpoint

SF = "/root/testdata/sf0.001"


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_every_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [by_id(docs)]
    names = [n for n, _ in P.STAGES]
    for name, stage in P.STAGES:
        docs = checkpoint(stage(spark, docs, SF))
        if name == names[-1]:
            test_packing.check(docs.collect(), {i: r["text"] for i, r in tables[-1].items()})
            break
        assert docs.columns == P.COLUMNS
        before, after = tables[-1], by_id(docs)
        assert len(after) == docs.count() and set(after) <= set(before)
        assert all((r["lang"], r["source"]) == (before[i]["lang"], before[i]["source"]) for i, r in after.items())
        assert all(r["n_chars"] == len(r["text"]) for i, r in after.items() if r["text"] != before[i]["text"])
        texts = {i: r["text"] for i, r in before.items()}
        if name == "quality classifier":
            kept = {
                r["doc_id"] for r in quality_lm.op6_quality_lm(spark, SF).collect() if r["kept"]}
            assert set(after) == kept and 0 < len(after) < len(before)
        elif name == "line dedup":
            want = test_line_dedup.brute(texts, 3)
            assert {i: r["text"] for i, r in after.items()} == {i: w[0] for i, w in want.items()}
        elif name == "n-gram Jaccard join":
            assert set(after) == {i for i, (_, c) in test_ngram_jaccard.brute(texts).items() if c == i}
        elif name == "substring dedup":
            for i, (text, _, n) in test_substring_dedup.brute(texts, 20).items():
                assert after[i]["text"] == (text if n else texts[i])
        tables.append(after)
    assert docs.count() == P.run(spark, SF).count()


def test_stages_on_no_rows_and_nulls(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    nulls = spark.createDataFrame([(1, None, None, None, None), (None, "a b c", "en", None, 5), (1, None, None, None, None)], empty.schema)
    for rows, docs in ((0, empty), (3, nulls)):
        for name, stage in P.STAGES:
            docs = checkpoint(stage(spark, docs, SF))
            assert docs.count() == rows


def test_no_text_is_shuffled_for_the_ids_that_go(spark, monkeypatch):
    docs = spark.range(100).selectExpr("id AS doc_id", "'a b' AS text", "'en' AS lang", "'web' AS source", "3L AS n_chars")
    ids = docs.where("doc_id % 3 = 0").repartition(2).select("doc_id")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        left = P._without(docs, ids)
        assert "SortMergeJoin" not in left._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(P, "MOST_SENT", 10)
        more = P._without(docs, ids)
        assert "SortMergeJoin" in more._jdf.queryExecution().executedPlan().toString()
        assert sorted(left.collect()) == sorted(more.collect()) == sorted(docs.where("doc_id % 3 <> 0").collect())
    finally:
        spark.conf.set(key, before)
