import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_outside_imports_the_subpackage():
    for path in (ROOT / "marketweave").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_queries_and_sql():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "p3_found" in e.queries()


def test_columns_agree_with_sql(spark):
    import duckdb

    from marketweave.plans import queries

    data, con = "/root/testdata/sf0.001", duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    for name in ("flt3_open", "win1_to_win3_prj7_returns", "tmp1_to_tmp6_jn3_jn4_aligned", "ml5_measures"):
        got, want = queries.QUERIES[name](spark, data).toPandas(), con.execute(queries.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
