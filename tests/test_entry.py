"""The driver contract, and that the text operators are optional."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from hydrospark.plans import catalogue

REPO = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")
#: Queries without rounds, cheap enough for every run.
PLAIN = [n for n in catalogue.oracle_sql() if n[0] in "bcdef" and n not in ("c7_erase_layers", "c8_stream_threshold", "f4_terminal_min_neighbour")] + ["a4_overlay", "a6_tile_query", "a8_layer_extent", "a11_mosaic_last_wins", "h1_divide_variance", "h2_basins_to_divide", "h6_outlet_order", "h7_outlet_groups", "h9_spill_point"]


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",), ("hydrospark/llm/__pycache__",)])
def test_imports_without_the_text_operators(tmp_path, left):
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    shutil.copytree(REPO / "hydrospark", tmp_path / "hydrospark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in left:
        if name.endswith(".py"):
            shutil.copy(REPO / name, tmp_path)
        else:
            (tmp_path / name).mkdir(parents=True)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 60 and not [n for n in e.queries() if n.startswith('op')]; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


@pytest.mark.skipif(not (REPO / "hydrospark/llm").exists(), reason="no text operators")
def test_other_missing_modules_are_errors(tmp_path):
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    shutil.copy(REPO / "corpus_pipeline.py", tmp_path)
    shutil.copytree(REPO / "hydrospark", tmp_path / "hydrospark", ignore=shutil.ignore_patterns("__pycache__"))
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True).returncode != 0


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    made = duckdb.connect()
    for name in ("orders", "part", "customer", "supplier", "lineitem", "events"):
        made.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return made


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    return repr(float(v) + 0.0)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", PLAIN)
def test_query_matches_sql(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, str(DATA))
    rel = duck.sql(catalogue.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(rel.columns)
    want = sorted(tuple(plain(v) for v in row) for row in rel.select(*(f'"{n}"' for n in names)).fetchall())
    assert sorted(tuple(plain(r[n]) for n in names) for r in got.collect()) == want


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_flagship(spark):
    assert __spark_entry__.entry(spark).columns == ["x", "y", "acc"]
