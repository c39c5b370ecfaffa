import pytest
from compare import assert_same

from gossamer.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, data, duck, name):
    assert_same(queries()[name](spark, data), duck, oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, data, name):
    df = queries()[name](spark, data)
    assert len(set(df.columns)) == len(df.columns)
    df.count()


@pytest.mark.parametrize(
    "name,columns",
    [
        ("p1_found", [("content_hash_a", "string"), ("content_hash_b", "string")]),
        ("p2_found", [("document_id", "bigint")]),
        ("p3_found", [("content_hash", "string"), ("node_no", "int")]),
        ("p4_found", [("msg_id", "bigint")]),
        ("p5_found", [("document_id", "bigint")]),
        ("p7_found", [("doc_id", "bigint"), ("item_id", "bigint")]),
        ("p9_found", [("doc_id", "bigint"), ("para_no", "int"), ("lang", "string")]),
    ],
)
def test_columns(spark, data, name, columns):
    assert queries()[name](spark, data).dtypes == columns


@pytest.mark.parametrize("name", sorted(queries()))
def test_empty_tables(spark, data, tmp_path, name):
    for table in ("document", "page_body", "frontier_message", "documents", "eval_item", "mix_target"):
        spark.read.parquet(f"{data}/{table}.parquet").limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    rows = queries()[name](spark, str(tmp_path)).collect()
    assert len(rows) <= (1 if name == "p4_wrong_answers" else 0)


def test_nothing_else_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(__file__).parents[2] / "gossamer"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "gossamer.llm" not in path.read_text(), path
