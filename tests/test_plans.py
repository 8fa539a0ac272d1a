"""Plan shapes that matter at scale."""

import contextlib
import io

import pytest

import __spark_entry__ as entry
from conftest import SMALL

QUERIES = entry.queries()
EAGER = {"answer_with_evidence", "operational_csv", "triage_export", "stream_bounded_ingest", "evidence_topk", "evidence_context", "question_evidence", "evidence_load_tolerant", "stream_evidence_ingest", "stream_hazard_unique"}


def plan(spark, name):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        QUERIES[name](spark, SMALL).explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - EAGER if not n.startswith("op") and n != "pipeline"))
def test_no_cross_join_and_no_python(spark, name):
    text = plan(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "MapInPandas", "FlatMapGroups"):
        assert bad not in text


@pytest.mark.parametrize("name", [
    "top_request_per_need", "top_supply_per_type", "dispatch_recommendations", "evidence_insert_new", "event_latest",
    "conversation_title", "gazetteer_lookup",
])
def test_ranks_are_limited_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


@pytest.mark.parametrize("name", ["triage_queue", "hazard_recent", "reports_latest"])
def test_limits_need_no_full_sort(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


def test_row_work_is_not_shuffled(spark):
    for name in ("event_key", "record_id", "display_value", "hazard_normalize", "weather_daily", "raw_json_status"):
        assert "Exchange" not in plan(spark, name)


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "hazard_recent")
    assert "GreaterThanOrEqual(ts" in text
    assert "n_chars" not in plan(spark, "event_key")
    # the units come from the big line table, which totals by need never touch
    assert "lineitem" not in plan(spark, "need_totals")


def test_units_are_summed_for_chosen_requests_only(spark):
    text = plan(spark, "dispatch_recommendations")
    assert "LeftSemi" in text and "lineitem" in text
    # the line table meets the requests after the rank: ranking reads no line
    assert "lineitem" not in plan(spark, "kpis_filtered")
