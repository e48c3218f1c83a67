"""The registered queries against their SQL."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from marlstone.plans import catalog, registry
from marlstone.streaming import event_stream, windowed

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rounded(rows):
    """Rows in an order of their own; numbers agree to 9 digits."""
    value = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(value, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, str(DATA))
    columns = sorted(found.columns)
    rows = found.select(*columns).collect()
    assert rows
    want = duck.execute(registry.ORACLES[name])
    assert sorted(d[0] for d in want.description) == columns
    order = ", ".join(f'"{c}"' for c in columns)
    assert rounded(rows) == rounded(duck.execute(f"SELECT {order} FROM ({registry.ORACLES[name]})").fetchall())


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_gives_the_table_s_windows(spark, tmp_path):
    stream = windowed(event_stream(spark, str(DATA))).writeStream.outputMode("complete").format("memory").queryName("event_windows").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    stream.awaitTermination(120)
    got = {(r.window_start.strftime("%Y-%m-%d"), r.event_type, r.n, r.total) for r in spark.table("event_windows").collect()}
    assert got == {(r.window_start, r.event_type, r.n, r.total) for r in catalog.event_windows(spark, str(DATA)).collect()}
