import __spark_entry__ as E


def test_all_queries_are_registered():
    names = [q for q in E.queries() if q.startswith("op") or q == "pipeline"]
    assert sorted(int(q[2:].split("_")[0]) for q in names if q != "pipeline") == list(range(1, 14))
    assert "pipeline" in names and set(E.oracle_sql()) <= set(E.queries())
