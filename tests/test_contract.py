import ast
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

ROOT, DATA = Path(__file__).resolve().parents[1], Path("/root/testdata/sf0.001")


def test_nothing_outside_imports_the_subpackage():
    for path in (ROOT / "skylattice").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("skylattice.llm") for n in names), path


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", ["a9_mass_function", "a1_cloud_in_cell", "p2_found", "p3_found", "p4_found", "p6_found"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    got = __spark_entry__.queries()[name](spark, str(DATA)).select(*columns).collect()
    assert sorted(map(key, got)) == sorted(map(key, want.fetchall()))


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_whole_run(spark):
    from skylattice.plans import pipeline
    from skylattice.plans.config import Grid, Settings, from_dict
    from skylattice.plans.views import high, low

    settings = from_dict(Settings, {"features": ["log10_m200b"], "properties": ["cv", "spin"], "n_bins": 2, "min_rows": 20, "calibration": {"method": "abundance"}})
    settings = Settings(**(vars(settings) | {"grid": Grid(n=4)}))
    made = pipeline.run(high(spark, str(DATA)), low(spark, str(DATA)).drop("spin"), settings)
    assert made.enriched.where("cv IS NOT NULL").count() > 50
    assert set(made.bias.select("catalog").distinct().toPandas().catalog) == {"high", "low"}
