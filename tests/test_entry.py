import __spark_entry__ as entry_points

from quernstone.plans import catalog

SMALL = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_entry_runs(spark):
    assert entry_points.entry(spark).columns == ["run_tag", "rank", "exp_no", "delta", "val_bpb", "description"]


def test_core_queries_agree_with_sql(spark):
    import glob
    import math
    import os

    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    for name, sql in catalog.oracle_sql().items():
        df = catalog.queries()[name](spark, SMALL)
        cur = con.execute(sql)
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(df.columns), name
        want = sorted(str([plain(v) for v in r]) for r in cur.fetchall())
        got = sorted(str([plain(v) for v in r]) for r in df.select(*names).collect())
        assert got == want, name


def test_what_is_broken_inside_the_subpackage_shows(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry_points.__file__).parent
    shutil.copytree(root / "quernstone", tmp_path / "quernstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}, capture_output=True, text=True)
    assert run().stdout.split() == [str(len(catalog.queries()))]
    (tmp_path / "quernstone/llm").mkdir()
    (tmp_path / "quernstone/llm/__init__.py").write_text("")
    (tmp_path / "quernstone/llm/queries.py").write_text("import no_such_module\n")
    assert "no_such_module" in run().stderr
