import re

import pytest
from small_tables import SMALL
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import annotate as A
from threadloom.operators import ordered
from threadloom.operators import recovery as Y
from threadloom.operators import relevance as R
from threadloom.operators import routing as G
from threadloom.sources import tables as S

SCHEMA = "conv_id bigint, turn bigint, pos bigint, role string, text string"


def compile_texts(spark, texts, **extra):
    rows = [(1, i, i, role, text) for i, (role, text) in enumerate(texts)]
    messages = spark.createDataFrame(rows, SCHEMA)
    annotated = A.annotate(messages)
    requests = R.request_features(R.latest_requests(messages))
    c = G.compile_requests(messages, R.message_features(annotated), requests, A.statements_of(annotated), **extra)
    return messages, c


def actions(c):
    return {r["turn"]: r for r in c.decisions.collect()}


@pytest.fixture(scope="module")
def service(spark):
    messages = ordered.cut_lineage(S.service_messages(spark, SMALL))
    annotated = A.annotate(messages)
    requests = ordered.cut_lineage(R.request_features(R.latest_requests(messages)))
    c = G.compile_requests(messages, R.message_features(annotated), requests, A.statements_of(annotated))
    return messages, c


def test_every_message_has_one_route_and_protected_ones_are_kept(service):
    messages, c = service
    d = c.decisions
    assert d.where(F.col("action").isNull()).count() == 0
    assert d.count() == d.select("conv_id", "req_turn", "turn").distinct().count()
    assert d.where("protected and (action != 'KEEP' or group_id is not null)").count() == 0


def test_removed_tokens_are_partitioned_exactly(service):
    _, c = service
    s = G.savings(c)
    assert s.count() > 0
    assert s.where("original_tokens - compiled_tokens != omission + deduplication + compression + memory").count() == 0


def test_payload_entries_add_up_and_checks_pass(service):
    messages, c = service
    e = ordered.cut_lineage(G.payload_entries(c, messages))
    sums = e.groupBy(*R.KEYS).agg(F.sum("tokens").alias("t")).join(G.savings(c), R.KEYS).join(c.requests.select(*R.KEYS, "request_tokens"), R.KEYS)
    assert sums.where("t + request_tokens != compiled_tokens").count() == 0
    assert G.check_context(c, e, messages).where(~F.col("passed")).count() == 0


def test_order_of_input_rows_does_not_matter(spark, service):
    messages, c = service
    shuffled = messages.orderBy(F.xxhash64("text", "turn"))
    annotated = A.annotate(shuffled)
    requests = R.request_features(R.latest_requests(shuffled))
    again = G.compile_requests(shuffled, R.message_features(annotated), requests, A.statements_of(annotated))
    cols = ["conv_id", "turn", "action", "group_id", "duplicate_of", "score"]
    assert sorted(map(str, again.decisions.select(*cols).collect())) == sorted(map(str, c.decisions.select(*cols).collect()))


def test_span_size_does_not_change_the_result(spark, service, short_spans):
    messages, c = service
    annotated = A.annotate(messages)
    again = G.compile_requests(messages, R.message_features(annotated), c.requests, A.statements_of(annotated))
    cols = ["conv_id", "turn", "action", "group_id", "duplicate_of", "score"]
    assert sorted(map(str, again.decisions.select(*cols).collect())) == sorted(map(str, c.decisions.select(*cols).collect()))


def test_continuity_gives_way_when_one_of_the_two_is_huge(spark):
    _, c = compile_texts(spark, [("user", "Hello there friend."), ("assistant", "word " * 3000), ("user", "Anything about gardening?")])
    assert actions(c)[1]["action"] == "OMIT" and actions(c)[0]["action"] == "OMIT"


def test_antecedent_block_stops_at_a_topic_break(spark):
    logs = "ERROR payment declined\nhost=gateway-{}\nreason=closed"
    texts = [("user", logs.format(1)), ("user", "Plan the picnic on the hill."), ("user", logs.format(2)), ("assistant", "Noted."), ("user", logs.format(3))]
    texts += [("assistant", "Which one?"), ("user", "The last."), ("user", "Why did those failures occur?")]
    _, c = compile_texts(spark, texts)
    block = c.antecedents.first()
    # "The last." is an incompatible user message before the block starts, so it does not end it
    assert (block["kind"], block["phrase"], block["selected"]) == ("error", "those failures", [2, 4])


def test_copies_and_templates(spark):
    texts = [("assistant", "The deploy pipeline failed during the payment migration step because the ledger table was locked.")] * 4
    texts += [("user", "2024-01-05T10:00:01 ERROR worker {} lost".format(n)) for n in range(5)]
    texts += [("user", "Nice."), ("assistant", "Sure thing."), ("user", "Tell me about the payment migration deploy pipeline")]
    _, c = compile_texts(spark, texts)
    groups = {g["group_id"]: g for g in c.groups.collect()}
    assert groups["text:0"]["summary"].startswith("Repeated message (4x): The deploy pipeline failed")
    d = actions(c)
    assert all(d[t]["action"] == "COMPRESS" for t in range(4))
    # the template group is unrelated: nothing of it is sent
    assert all(d[t]["action"] == "OMIT" for t in range(4, 9))


def test_related_logs_show_first_and_last(spark):
    texts = [("user", "2024-01-05T10:00:01 ERROR payment gateway {} lost its socket connection".format(n)) for n in range(5)]
    texts += [("user", "Nice."), ("assistant", "Sure thing."), ("user", "payment gateway socket connection")]
    _, c = compile_texts(spark, texts)
    g = c.groups.first()
    assert g["kind"] == "related_logs" and g["n_sources"] == 5
    assert re.match(r"Related logs \(5x; 3 similar lines omitted between first and last\): .*gateway 0.* \| .*gateway 4", g["summary"])


def test_memory_stands_in_for_a_complete_statement(spark):
    said = "We decided to use PostgreSQL 17 for the analytics warehouse."
    texts = [("user", said + " "), ("assistant", "Fine."), ("user", "We decided to use PostgreSQL 18 for the analytics warehouse."), ("user", "We decided to use PostgreSQL 19 for the analytics warehouse.")]
    texts += [("user", "Nice."), ("assistant", "Sure."), ("user", "Which database is the analytics warehouse on?")]
    _, c = compile_texts(spark, texts)
    d = actions(c)
    assert d[0]["action"] == d[2]["action"] == d[3]["action"] == "MEMORY"
    item = c.memory.first()
    assert (item["key"], item["value"]) == ("analytics_warehouse_database", "PostgreSQL 19")


def test_identifiers_must_stay_resolvable(spark):
    texts = [("user", "The key is in config/app.yaml today."), ("assistant", "Seen."), ("user", "Other topic."), ("assistant", "Right."), ("user", "Open config/app.yaml and lib/none.py")]
    messages, c = compile_texts(spark, texts)
    entries = G.payload_entries(c, messages)
    rows = G.check_identifiers(c.requests, entries, messages).collect()
    assert [(r["identifier"], r["passed"]) for r in rows] == [("config/app.yaml", True)]


def recovery(spark, ids, budget, sent=(), texts=None):
    texts = texts or [
        ("user", "Should the harbour crane use the red or the blue cable for lifting containers?"),
        ("assistant", "The second one."),
        ("user", "x" * 400),
        ("user", "y" * 40),
        ("assistant", "Alpha."),
        ("user", "Beta gamma."),
        ("user", "Unrelated question"),
    ]
    plan = spark.createDataFrame([(1, len(texts) - 1, list(ids), budget, None)], "conv_id bigint, req_turn bigint, include_ids array<bigint>, token_budget bigint, min_score double")
    already = spark.createDataFrame([(1, len(texts) - 1, t) for t in sent], "conv_id bigint, req_turn bigint, turn bigint")
    _, c = compile_texts(spark, texts, expansion=plan, already_sent=already)
    items = {(r["turn"], r["kind"]): (r["representation"], r["tokens"], r["skipped"]) for r in c.recovered.collect()}
    return items, actions(c), Y.report_totals(c.recovered).first()


def test_recovery_brings_the_partner_of_a_dependent_answer(spark):
    items, d, total = recovery(spark, [1], 100)
    assert items == {(1, "named"): ("original", 8, False), (0, "partner"): ("original", 24, False)}
    assert d[0]["action"] == d[1]["action"] == "RETRIEVE"
    assert total["used_tokens"] == 32 and not total["exceeded_by_required"]


def test_recovery_overrun_by_the_first_closes_the_budget(spark):
    items, d, total = recovery(spark, [2, 3], 50)
    assert items == {(2, "named"): ("original", 104, False), (3, "named"): ("original", 0, True)}
    assert d[3]["action"] == "OMIT" and total["exceeded_by_required"]


def test_recovery_skips_what_was_sent(spark):
    items, _, total = recovery(spark, [3, 4], 50, sent=[3])
    assert items == {(3, "named"): ("already_in_payload", 0, False), (4, "named"): ("already_in_payload", 0, False)}
    assert total["used_tokens"] == 0


def test_prompt_is_refused_above_the_limit(spark, monkeypatch):
    messages, c = compile_texts(spark, [("user", "Never skip tests."), ("assistant", "Sure."), ("user", "Next")])
    entries = G.payload_entries(c, messages)
    shown = G.render_prompts(entries, c.requests).first()
    assert shown["prompt"].endswith("<current_request>\nNext\n</current_request>\n") and "[user] Never skip tests." in shown["prompt"]
    monkeypatch.setattr(G.V, "MAX_REQUEST_TOKENS", 5)
    refused = G.render_prompts(entries, c.requests).first()
    assert refused["too_large"] and refused["prompt"] is None


def test_messages_are_numbered_once_and_signatures_are_short(spark):
    from threadloom.plans.routing_queries import _service

    messages, _, features, _ = _service(spark, SMALL)
    # read from the written table: no window numbers them again for each step that needs texts
    assert "Window" not in messages._jdf.queryExecution().executedPlan().toString()
    assert {r["n"] for r in features.select(F.octet_length("sig").alias("n")).distinct().collect()} == {16}
    assert features.select("sig").distinct().count() == messages.select("role", T.signature(F.col("text"))).distinct().count()
