"""Registered queries against their SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_queries import TABLES, canonical  # noqa: E402
from quire.plans import registry  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "chunk_documents", "audit_spans", "ask_judged", "scan_judged", "phrase_hits", "leak_verdict",
    "excise_runs", "lines", "plan_edits", "merge_docs", "relink", "apply_fill", "patch_metadata", "traffic",
]


def test_every_query_has_its_sql():
    names, stated = registry.queries(), registry.oracle_sql()
    assert set(stated) == set(names) and len(names) >= 100


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = registry.queries()[name](spark, FOLDER)
    cur = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cur.fetchall(), names)
