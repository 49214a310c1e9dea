"""Every registered query against its DuckDB oracle (row count, columns, values)."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from funnelkit.oracle import ORACLE_SQL
from funnelkit.registry import QUERIES
from tests.conftest import SF_CHECK
from tests.helpers import canon

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = Path(SF_CHECK) / f"{t}.parquet"
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    yield con
    con.close()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_oracle(spark, duck, name):
    sdf = entry.queries()[name](spark, SF_CHECK)
    rows, cols = [tuple(r) for r in sdf.collect()], sdf.columns
    rel = duck.sql(entry.oracle_sql()[name])
    drows, dcols = rel.fetchall(), rel.columns
    assert sorted(cols) == sorted(dcols)
    assert len(rows) == len(drows)
    assert canon(rows, cols) == canon(drows, dcols)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["country", "viewers", "carted", "purchasers",
                          "view_to_cart_pct", "cart_to_purchase_pct", "overall_cvr_pct"]
    assert len(rows) == 4
