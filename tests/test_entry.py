import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["service_name", "total_errors", "error_rate"]


def test_every_query_has_an_oracle():
    own = set(E.registry.QUERIES)
    assert own <= set(E.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())


FAST = ["metrics_1s", "top_service_errors", "ingestion_series", "search_logs", "search_json",
        "storage_outlook", "retention_bytes", "queue_stability", "short_number",
        "live_tail_view", "otlp_flatten"]


@pytest.mark.parametrize("key", FAST)
def test_oracle_matches_small(spark, key):
    from logpond.plans.check import TABLES, _canon
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = E.queries()[key](spark, SF_SMALL)
    res = con.execute(E.oracle_sql()[key])
    s = _canon(df.columns, [tuple(r) for r in df.collect()])
    o = _canon([d[0] for d in res.description], res.fetchall())
    assert s == o
