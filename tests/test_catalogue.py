"""Every registered query against its SQL on the smallest sample, and registry hygiene."""

from pathlib import Path

import pytest

from check_oracle import TABLES, rows_of
from quietwire.plans import catalogue

SF = "/root/testdata/sf0.001"
# the slow ones are compared by tests/check_oracle.py
QUICK = ("packet_scan", "conversation_keys", "flow_counters", "flow_features", "gap_sessions", "trailing_destination_totals",
         "dns_pairing", "tls_fingerprints", "confusion_matrix", "per_class_metrics", "threshold_sweep", "curve_areas",
         "scenario_split", "stage_latency", "label_mapping")


def test_every_sql_has_a_plan():
    assert set(catalogue.SQL) <= set(catalogue.PLANS) and len(catalogue.PLANS) > 120


@pytest.mark.skipif(not Path(SF).exists(), reason="sample tables are not here")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalogue.PLANS[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(catalogue.SQL[name])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())
