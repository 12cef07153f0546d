import importlib.util
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from foliant import oracles, queries

TABLES = "documents embeddings benchmark labels conversations".split()
#: The seeded samples are drawn from as many positions as the larger table has.
LARGER = [q for q in oracles.SQL if q.startswith("sample_") or q.startswith("shard")]


def test_entry_has_rows(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "n_chunks", "reduction_layers", "final_tokens", "final_summary", "concatenated_intermediate"] and df.count() > 0


def test_names():
    q = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(q) and set(oracles.SQL) <= set(queries.QUERIES)
    if importlib.util.find_spec("foliant.llm"):
        assert "pipeline" in q and all(any(x.startswith(f"op{n}_") for x in q) for n in range(1, 11))


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_queries_against_duckdb(spark, name):
    sf = "/root/testdata/sf0.01" if name in LARGER else "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    show = lambda v: "null" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    got = con.execute(oracles.SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == cols
    want = sorted(tuple(show(r[names.index(c)]) for c in cols) for r in got.fetchall())
    assert sorted(tuple(show(r[c]) for c in cols) for r in df.collect()) == want


def test_rest_passes_without_the_training_data_folders(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for p in ("foliant", "tests", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", f"{root}/{p}", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/foliant/llm", f"{tmp_path}/tests/llm"], check=True)
    out = subprocess.run([sys.executable, "-m", "pytest", "-q", "tests/test_entry.py", "-k", "test_names"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert "1 passed" in out.stdout, out.stdout


def test_import_without_the_training_data_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for p in ("foliant", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", f"{root}/{p}", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/foliant/llm"], check=True)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, len(e.oracle_sql()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.stdout.split() == [str(len(queries.QUERIES)), "False", str(len(oracles.SQL))], out.stderr
