"""Registered queries against their SQL checks on the smallest tables."""

import duckdb
import pytest
from small_tables import SMALL

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# each of these compiles every request; one of them covers the shared steps
COMPILED = {
    "compressed_groups", "injected_memory", "payload_entries", "payload", "context_checks", "search_needs", "omission_report", "top_omitted", "decision_cards",
    "decision_counts", "trace_sections", "understanding", "memory_provenance", "savings_partition",
}
NAMES = sorted(set(entry.oracle_sql()) - COMPILED)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


def norm(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    res = con.execute(entry.oracle_sql()[name])
    order = [[d[0] for d in res.description].index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in order) for r in res.fetchall()), key=repr)
    assert got == want


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
