import __spark_entry__ as E


def test_entry_runs_on_smoke_data(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["q", "panel", "rank", "word_id", "word", "score", "cos_w", "cos_x", "cos_y"]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
