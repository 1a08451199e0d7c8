"""Every registered query against its DuckDB oracle at sf0.001 (rows-only where no oracle)."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pytest

from panelcast.plans.catalog import load_all

SF = os.environ.get("PANELCAST_TEST_SF", "/root/testdata/sf0.001")
REG = load_all()


@pytest.fixture(scope="module")
def duck():
    from oracle_check import duck as mk
    return mk(SF)


@pytest.mark.parametrize("name", sorted(REG))
def test_query_matches_oracle(spark, duck, name):
    from oracle_check import compare
    status, msg = compare(spark, duck, name, REG[name], SF)
    assert status in ("OK", "ROWS"), msg


def test_entry_smoke(spark):
    import importlib.util
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(here, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    df = mod.entry(spark)
    assert df.count() > 0
    assert set(mod.oracle_sql()) <= set(mod.queries())
