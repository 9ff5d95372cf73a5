"""Tables that grow with the input are joined by sort and merge: Parquet files tell too little about rows in memory to broadcast them."""

import datetime as dt

import pytest
from pyspark.sql.readwriter import DataFrameWriter

import __spark_entry__
from threadloom.plans import routing_queries as Q

ROUTED = [
    "compressed_groups", "context_checks", "decision_card_texts", "decision_cards", "decision_counts", "evaluation_prompts", "expansion_items", "expansion_report",
    "identifier_checks", "injected_memory", "memory_checks", "memory_provenance", "omission_report", "payload", "payload_entries", "retrieval_prompts",
    "route_messages", "savings_partition", "search_needs", "search_pool", "top_omitted", "trace_sections", "understanding",
]


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    first = dt.datetime(2024, 1, 1)
    kinds = ["error", "view", "purchase", "signup", "click"]
    events = [(i, first + dt.timedelta(minutes=i // 3), i % 2, kinds[i * 7 % 5], float(i), f'{{"k": {i * 3 % 17}}}') for i in range(80)]
    orders = [(i, i % 3, "FOP"[i % 3], 10.0 * i, first + dt.timedelta(days=i % 5), "1-URGENT") for i in range(12)]
    lines = [(i % 12, i, i % 4, 1 + i // 12, 1.0 + i % 5, 2.0 * i, 0.1, 0.1, "ANR"[i % 3], "FO"[i % 2], first + dt.timedelta(days=i)) for i in range(40)]
    spark.createDataFrame(events, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(f"{at}/events.parquet")
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{at}/orders.parquet")
    line = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    spark.createDataFrame(lines, line).write.parquet(f"{at}/lineitem.parquet")
    return str(at)


@pytest.fixture(scope="module")
def sent():
    """Plans with broadcasts, of all tables written meanwhile; messages are compiled once for all queries, and once for a recovery."""
    found, write, service, compile_requests, done = [], DataFrameWriter.parquet, Q._service, Q.G.compile_requests, {}

    def written(self, *args, **kwargs):
        found.extend(p for p in [plan(self._df)] if "Broadcast" in p)
        return write(self, *args, **kwargs)

    def once(key, make):
        if key not in done:
            done[key] = make()
        return done[key]

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(DataFrameWriter, "parquet", written)
        patch.setattr(Q, "_service", lambda spark, sf: once("messages", lambda: service(spark, sf)))
        patch.setattr(Q.G, "compile_requests", lambda *args, **kwargs: once("expansion" in kwargs, lambda: compile_requests(*args, **kwargs)))
        yield found


@pytest.mark.parametrize("name", ["attempt_details", *ROUTED])
def test_nothing_is_broadcast(spark, folder, sent, name):
    sent.clear()
    out = __spark_entry__.queries()[name](spark, folder)
    assert "Broadcast" not in plan(out)
    assert not sent
