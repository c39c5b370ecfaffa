import pytest
from compare import assert_same
from gossamer.plans import QUERIES, SQL

#: Queries over bodies, state machines and hashes that SQL can't express.
ROWS_ONLY = sorted(set(QUERIES) - set(SQL))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data, duck, name):
    assert_same(QUERIES[name](spark, data), duck, SQL[name])


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert len(df.columns) == len(set(df.columns))
    assert df.count() > 0


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_hot_path_python_in_native_queries(spark, data):
    for name in ("u1_normalize_url", "p6_host_messages", "w2_budget", "a9_degrees", "j6_lsh_pairs"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().toString()
        assert "Python" not in plan and "ArrowEval" not in plan, name
        assert "CartesianProduct" not in plan, name


def test_pushdown(spark, data):
    plan = QUERIES["f1_domain"](spark, data)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(registered_domain), EqualTo(registered_domain" in plan
    assert "ReadSchema: struct<id:bigint,url:string,registered_domain:string>" in plan
