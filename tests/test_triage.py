import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from aidlens.operators import graph, triage
from samples import REQUEST_COLUMNS, REQUESTS, RESOURCE_COLUMNS, RESOURCES, SCORES, SHELTER_COLUMNS, SHELTERS


@pytest.fixture
def requests(rows):
    return rows(REQUESTS, REQUEST_COLUMNS)


@pytest.fixture
def scored(requests):
    return triage.score_requests(requests)


def test_scores(scored):
    got = {r.request_id: r.priority_score for r in scored.collect()}
    assert got == pytest.approx(SCORES)


def test_missing_people_scores_zero(rows):
    row = ("x", "l", "z", "Water", None, 1, "Critical", "Verified", "", 0.0, 0.0)
    assert triage.score_requests(rows([row], REQUEST_COLUMNS)).first().priority_score == 0.0


def test_unknown_and_missing_categories_score_nothing(rows):
    data = [("x", "l", "z", "Ice", 200, 1, "Odd", None, "", 0.0, 0.0), ("y", "l", "z", None, 200, 1, None, "Odd", "", 0.0, 0.0)]
    assert {r.priority_score for r in triage.score_requests(rows(data, REQUEST_COLUMNS)).collect()} == {10.0}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(
    st.one_of(st.none(), st.integers(0, 2**31 - 1)),
    st.sampled_from(["Critical", "High", "Medium", "Low", "?", None]),
    st.sampled_from(["Medical", "Rescue", "Water", "Food", "Shelter", "Transport", "?", None]),
    st.sampled_from(["Unverified", "Verified", "Assigned", "Completed", "?", None]),
), min_size=1, max_size=30))
def test_scores_stay_in_range(spark, data):
    df = spark.createDataFrame(data, "people_affected int, priority string, need_type string, status string")
    scores = [r.priority_score for r in triage.score_requests(df).collect()]
    assert len(scores) == len(data) and all(0.0 <= s <= 100.0 for s in scores)


def test_filter_is_conjunctive_and_empty_choice_keeps_nothing(scored):
    kept = triage.filter_requests(scored, ["Verified"], ["Water", "Food"], ["East", "West"])
    assert [r.request_id for r in triage.by_urgency(kept).collect()] == ["1010", "1006"]
    assert triage.filter_requests(scored, [], ["Water"], ["East"]).count() == 0


def test_missing_status_is_open(rows):
    row = ("x", "l", "z", "Water", 1, 1, "High", None, "", 0.0, 0.0)
    df = rows([row], REQUEST_COLUMNS)
    assert triage.open_requests(df).count() == 1
    assert triage.request_kpis(df).first().open_requests == 1


def test_kpis(requests, rows):
    shelters = rows(SHELTERS, SHELTER_COLUMNS)
    assert tuple(triage.kpi_snapshot(requests, shelters).first()) == (4, 13, 2355, 5)


def test_empty_sums_are_zero(requests, rows):
    none = requests.filter("false")
    assert tuple(triage.kpi_snapshot(none, rows(SHELTERS, SHELTER_COLUMNS)).first()) == (0, 0, 0, 5)


def test_need_totals_ascending(requests):
    got = [tuple(r) for r in triage.need_totals(requests).collect()]
    assert got == [("Rescue", 72), ("Transport", 96), ("Medical", 182), ("Shelter", 350), ("Food", 610), ("Water", 1045)]


def test_filter_values(requests):
    got = [tuple(r) for r in triage.filter_values(requests).filter("field = 'zone'").collect()]
    assert got == [("zone", z) for z in ["Central", "East", "North", "South", "West"]]


def test_queue_order_and_half_even_rounding(scored):
    queue = triage.triage_queue(scored).collect()
    assert [r.request_id for r in queue] == [
        "1001", "1002", "1010", "1005", "1003", "1006", "1014", "1011", "1007", "1008", "1004", "1015",
    ]
    shown = {r.request_id: r.priority_score for r in queue}
    assert shown["1003"] == 58 and shown["1014"] == 50


def test_dispatch(scored, rows):
    got = [tuple(r) for r in triage.dispatch_recommendations(scored, rows(RESOURCES, RESOURCE_COLUMNS)).collect()]
    assert got == [
        ("Food", "Dharavi", 31, "Central Depot", "High priority; 310 people affected"),
        ("Medical", "Kurla West", 18, "East Medical Hub", "Critical priority; 85 people affected"),
        ("Rescue", "Sion Koliwada", 3, "West Equipment Hub", "Critical priority; 44 people affected"),
        ("Shelter", "Chunabhatti", 48, "North Logistics Hub", "High priority; 190 people affected"),
        ("Transport", "Wadala", 4, "South Fleet Yard", "Medium priority; 96 people affected"),
        ("Water", "Shivaji Nagar", 42, "Central Depot", "Critical priority; 420 people affected"),
    ]


def test_dispatch_case_variants_share_stock_and_empty_is_typed(scored, rows):
    lower = rows([("l1", "Here", "z", "water", 50, 500, "Low", "Verified", "", 0.0, 0.0)], REQUEST_COLUMNS)
    both = scored.unionByName(triage.score_requests(lower))
    stock = rows([("R-1", "WATER", "Depot", 30, "u"), ("R-2", "Food", "Depot", 0, "u")], RESOURCE_COLUMNS)
    got = [(r.need, r.recommended_units) for r in triage.dispatch_recommendations(both, stock).collect()]
    assert got == [("Water", 30), ("water", 30)]
    done = both.filter("status = 'Completed'")
    empty = triage.dispatch_recommendations(done, stock)
    assert empty.count() == 0 and empty.columns[0] == "need"


def test_radar(rows):
    data = [(1, "shortage", 92, 95), (2, "earthquake", 86, 88), (3, "weather", 82, 80), (4, "fragments", 79, 84), (5, "others", 70, 65)]
    df = rows(data, "position int, problem string, impact int, urgency int")
    ranked = triage.radar_rank(df).collect()
    assert [r.radar_score for r in ranked] == [94, 87, 82, 81, 67]
    assert triage.radar_lookup(df, "weather").first().impact == 82


def test_map_points(requests):
    assert {"lat", "lon"} <= set(triage.request_map_points(requests).columns)


def test_graph_edges(rows):
    labels = ["India", "Low rainfall", "Crop production", "Food prices", "Inflation", "Consumer spending", "Business impact"]
    nodes = rows(list(enumerate(labels)), "id int, label string")
    edges = rows([(i, i + 1, 8 - i) for i in range(6)], "src int, dst int, value int")
    got = {r.src: (r.source_label, r.target_label, r.value) for r in graph.signal_graph_edges(edges, nodes).collect()}
    assert got[0] == ("India", "Low rainfall", 8) and got[5] == ("Consumer spending", "Business impact", 3)
