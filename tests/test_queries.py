"""Every registered query against its SQL, over the smallest tables."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
import __spark_entry__ as entry  # noqa: E402

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(base):
    con = duckdb.connect()
    for f in Path(base).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, base, name):
    df = QUERIES[name](spark, base)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name in SQL:
        result = duck.execute(SQL[name])
        at = {d[0]: i for i, d in enumerate(result.description)}
        assert sorted(at) == columns
        assert got == sorted(repr([plain(r[at[c]]) for c in columns]) for r in result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)


def test_core_does_not_need_the_subpackage():
    code = "import sys; sys.modules['evtide.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(n in e.queries() for n in ('p1_found', 'p10_found'))"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    for f in (ROOT / "evtide").rglob("*.py"):
        if "llm" not in f.parts:
            assert "evtide.llm" not in f.read_text(), f
