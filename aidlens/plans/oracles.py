"""The same results in DuckDB SQL, one statement per query, over the same views."""

from aidlens import fixed, schemas
from aidlens.functions.text import FOLDED
from aidlens.operators.questions import RANKED_TERMS
from aidlens.plans import queries as q
from aidlens.plans.workload import view_sql


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _with(*ctes: str) -> str:
    """A WITH clause from view names and ready-made ``name AS (...)`` texts."""
    return "WITH " + ",\n".join(c if " AS (" in c else f"{c} AS ({view_sql(c)})" for c in ctes) + "\n"


def _points(column: str, table: dict[str, int]) -> str:
    whens = " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in table.items())
    return f"(CASE {column} {whens} ELSE 0 END)"


SCORE = (
    "CASE WHEN people_affected IS NULL THEN cast(0 AS double) ELSE greatest(cast(0 AS double), least("
    "least(people_affected / cast(20 AS double), cast(30 AS double)) + "
    f"{_points('priority', fixed.PRIORITY_POINTS)} + {_points('need_type', fixed.NEED_POINTS)} + "
    f"{_points('status', fixed.STATUS_POINTS)}, cast(100 AS double))) END"
)
SCORED = f"scored AS (SELECT *, {SCORE} AS priority_score FROM requests)"
OPEN = "status IS DISTINCT FROM 'Completed'"
KPIS = (
    "kpis AS (SELECT cast(count(*) FILTER (WHERE priority = 'Critical') AS bigint) AS critical_requests, "
    f"cast(count(*) FILTER (WHERE {OPEN}) AS bigint) AS open_requests, "
    "cast(coalesce(sum(people_affected), 0) AS bigint) AS people_affected FROM requests)"
)
CHOSEN = (
    "status IN ('Unverified', 'Verified', 'Assigned') AND need_type IN ('Water', 'Food', 'Medical', 'Rescue') "
    "AND zone IN ('AFRICA', 'ASIA', 'EUROPE')"
)
TOP_REQUEST = (
    "top_request AS (SELECT * FROM scored {where} QUALIFY row_number() OVER "
    "(PARTITION BY need_type ORDER BY priority_score DESC, request_id) = 1)"
)
TOP_SUPPLY = (
    "top_supply AS (SELECT *, lower(resource_type) AS supply_type FROM resources WHERE available_units > 0 "
    "QUALIFY row_number() OVER (PARTITION BY lower(resource_type) ORDER BY available_units DESC, resource_id) = 1)"
)


def _slug(x: str) -> str:
    return f"left(trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-'), {fixed.SLUG_CHARS})"


def _event_key(domain: str, title: str, location: str) -> str:
    return f"left(sha256({_slug(domain)} || '|' || {_slug(title)} || '|' || {_slug(location)}), {fixed.EVENT_KEY_CHARS})"


def _records(source: str = "evidence_in") -> str:
    key = _event_key("domain", "title", "location")
    return (
        f"records AS (SELECT *, left(sha256(event_key || '|' || source_name || '|' || observed_at), {fixed.RECORD_ID_CHARS}) AS record_id "
        f"FROM (SELECT *, {key} AS event_key FROM {source}))"
    )


STORE = f"store AS (SELECT * FROM records WHERE source_tier = {_q(fixed.PRIMARY_TIER)})"
NEW = (
    "fresh AS (SELECT * FROM (SELECT * FROM records QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY seq) = 1) "
    "WHERE record_id NOT IN (SELECT record_id FROM store))"
)


def _display(x: str, fallback: str = fixed.NOT_REPORTED) -> str:
    text = f"cast({x} AS varchar)"
    blanks = ", ".join(_q(b) for b in fixed.BLANK_VALUES)
    return f"(CASE WHEN {text} IS NULL OR trim({text}, ' ' || chr(9) || chr(10) || chr(13)) IN ({blanks}) THEN {_q(fallback)} ELSE {text} END)"


# --- questions ------------------------------------------------------------


def _any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {_q(w)})" for w in words) + ")"


def _folded(text: str) -> str:
    out = f"lower({text})"
    for letter, plain in FOLDED.items():
        out = f"replace({out}, '{letter}', '{plain}')"
    return out


def _classified(source: str, text: str) -> str:
    hits = ", ".join(
        f"CASE WHEN contains(folded, {_q(t)}) THEN {{'d': {_q(d)}, 't': {_q(t)}}} END" for _, d, t in RANKED_TERMS
    )
    return (
        f"hit AS (SELECT *, list_filter([{hits}], lambda h: h IS NOT NULL) AS hits "
        f"FROM (SELECT *, {_folded(text)} AS folded, lower({text}) AS q FROM {source})), "
        f"classified AS (SELECT *, coalesce(hits[1].d, {_q(fixed.NO_DOMAIN)}) AS domain, "
        f"coalesce(replace(hits[1].d, '_', ' '), {_q(fixed.NO_DOMAIN_LABEL)}) AS label FROM hit)"
    )


ROUTED = (
    "routed AS (SELECT *, CASE WHEN route = 'domain_unconnected' THEN CASE "
    f"WHEN {_any('q', fixed.HEALTH_WORDS)} THEN {_q(fixed.HEALTH_LABEL)} "
    f"WHEN {_any('q', fixed.CONFLICT_WORDS)} THEN {_q(fixed.CONFLICT_LABEL)} ELSE {_q(fixed.ECONOMY_LABEL)} END END AS sub_domain, "
    f"{_any('q', fixed.CASUALTY_STEMS)} AS death_requested FROM (SELECT *, CASE "
    "WHEN domain = 'earthquake' THEN 'earthquake' "
    f"WHEN {_any('q', fixed.RESOURCE_WORDS)} THEN 'resource' "
    f"WHEN {_any('q', fixed.UNCONNECTED_WORDS)} THEN 'domain_unconnected' "
    f"WHEN {_any('q', fixed.SCAN_WORDS)} THEN 'global_scan' "
    f"WHEN contains(q, 'assam') AND {_any('q', fixed.ASSAM_FLOOD_WORDS)} THEN 'assam_flood' "
    "WHEN domain = 'flood' THEN 'flood' "
    f"WHEN {_any('q', fixed.WEATHER_WORDS)} THEN 'weather' "
    f"WHEN {_any('q', fixed.CAPABILITY_WORDS)} THEN 'capability' "
    f"WHEN domain <> {_q(fixed.NO_DOMAIN)} THEN 'domain_report' ELSE 'default' END AS route FROM classified))"
)
HISTORY = (
    "history AS (SELECT *, coalesce(string_agg(upper(role) || ': ' || text, chr(10)) OVER "
    f"(PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {fixed.HISTORY_MESSAGES} PRECEDING AND 1 PRECEDING), '') AS history FROM questions)"
)
ROUTING = (
    f"routing AS (SELECT conv_id, turn, text, CASE WHEN history <> '' THEN {_q(fixed.HISTORY_HEADING)} || chr(10) || history || "
    f"chr(10) || chr(10) || {_q(fixed.CURRENT_MESSAGE)} || text ELSE text END AS routing_text FROM history)"
)
ALL_ROUTED = ["questions", HISTORY, ROUTING, _classified("routing", "routing_text"), ROUTED]

# --- search ---------------------------------------------------------------

SEARCH = [
    "questions",
    "evidence_in",
    "asked AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM questions)",
    "hay AS (SELECT seq, lower(domain || ' ' || title || ' ' || summary || ' ' || location || ' ' || country) AS hay FROM evidence_in)",
    "found AS (SELECT term, seq FROM (SELECT DISTINCT term FROM asked) t JOIN hay ON contains(hay, term))",
    "hits AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, seq) AS rank FROM "
    "(SELECT conv_id, turn, seq, count(*) AS score FROM asked JOIN found USING (term) GROUP BY conv_id, turn, seq) "
    f"QUALIFY rank <= {q.SEARCH_LIMIT})",
]

CONTEXTS = (
    "contexts AS (SELECT conv_id, turn, cast(to_json(list({event: title, domain: domain, location: location, summary: summary, source: source_name, "
    "source_url: source_url, observed_at: observed_at, affected_people: affected_people, deaths: deaths, confidence: 'unverified'} ORDER BY rank)) AS varchar) AS context, cast(count(*) AS int) AS matches "
    "FROM hits JOIN evidence_in USING (seq) GROUP BY conv_id, turn)"
)

# --- whole answers ----------------------------------------------------------


def _filled(template: str, *values: str) -> str:
    first, *rest = template.split("{}")
    return " || ".join([_q(first), *[part for v, piece in zip(values, rest) for part in (f"({v})", _q(piece))]])


RESOURCE_TEXT = _filled(
    fixed.RESOURCE_ANSWER, "k.critical_requests", "k.open_requests", "format('{:,}', k.people_affected)",
    f"CASE WHEN death_requested THEN {_q(fixed.RESOURCE_DEATHS)} ELSE '' END",
)

# --- pages ----------------------------------------------------------------


REFERENCES = {
    "&nbsp;": " ", "&middot;": "·", "&copy;": "©", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'",
    "&eacute;": "é", "&hellip;": "…", "&#8364;": "€", "&#x41;": "A", "&#150;": "–", "&not": "¬", "&amp;": "&",
}


def _visible(html: str) -> str:
    inside = """(?:=\\s*(?:"[^"]*"|'[^']*')|[^>])*"""
    raw = "|".join(f"<{n}(?:[\\s/]{inside})?(?:>.*?(?:</{n}(?:[\\s/][^>]*)?(?:>|\\z)|\\z)|\\z)" for n in ("script", "style", "template"))
    markup = f"(?is)<!--(?:-?>|.*?(?:--!?>|\\z))|{raw}|</?[a-z]{inside}(?:>|\\z)|<[!?/][^>]*(?:>|\\z)"
    out = f"regexp_replace({html}, {_q(markup)}, chr(1), 'g')"
    for entity, char in REFERENCES.items():
        out = f"replace({out}, {_q(entity)}, {_q(char)})"
    out = f"replace({out}, chr(160), ' ')"
    out = f"regexp_replace({out}, '\\s*\\x01[\\s\\x01]*', chr(1), 'g')"
    out = f"regexp_replace({out}, '^[\\s\\x01]+|[\\s\\x01]+$', '', 'g')"
    return f"replace({out}, chr(1), ' ')"


PATTERN = _q(fixed.ALERT_PATTERN)
ALERTS = [
    "alert_pages",
    f"found AS (SELECT page_id, regexp_extract_all(page_text, {PATTERN}, 1) AS labels, regexp_extract_all(page_text, {PATTERN}, 2) AS details "
    f"FROM (SELECT page_id, {_visible('html')} AS page_text FROM alert_pages))",
    "alerts AS (SELECT page_id, cast(pos AS int) AS pos, labels[pos + 1] AS label, "
    "trim(regexp_replace(details[pos + 1], '\\s+', ' ', 'g'), ' -:') AS detail FROM "
    f"(SELECT *, unnest(range(least(len(labels), {fixed.ALERT_LIMIT}))) AS pos FROM found) "
    "QUALIFY row_number() OVER (PARTITION BY page_id, detail ORDER BY pos) = 1)",
]

# --- reports --------------------------------------------------------------


def _links(report: dict) -> str:
    return _q(" · ".join(f"[{n}]({u})" for n, u in report["links"]))


def _by_route(flood: str, other: str) -> str:
    return f"CASE WHEN route = 'flood' THEN {flood} ELSE {other} END"


SITUATION = (
    f"SELECT conv_id, turn, text AS question, initcap_words(label) AS problem_type, "
    f"{_by_route(_q(fixed.FLOOD_REPORT['status']), _q(fixed.DOMAIN_REPORT['status']))} AS status, "
    + ", ".join(
        f"{_q(fixed.NOT_REPORTED)} AS {c}"
        for c in ("location", "event_time", "affected_people", "deaths", "injuries", "missing_people", "affected_areas", "responders")
    )
    + f", {_by_route(_q(', '.join(fixed.FLOOD_REPORT['needs'])), _q(fixed.REPORT_NO_NEEDS))} AS needs, "
    f"{_by_route(_links(fixed.FLOOD_REPORT), _links(fixed.DOMAIN_REPORT))} AS sources, "
    + _by_route("'Disaster domain recognized; connect the current official bulletin before treating the report as live'",
                "'Domain recognized; source adapter required for live impact figures'") + " AS evidence_status, "
    + _by_route("'Low without a named location and current impact bulletin'", "'Low until a current source record is attached'") + " AS confidence, "
    + _by_route(
        "'Weather forecasts do not prove inundation, and no casualty figure is shown unless an impact source explicitly reports it.'",
        "'The agent will not invent affected people, deaths, injuries, or responders. "
        "Add a location and time range for a source-bounded answer.'") + " AS limitations, label "
    "FROM routed WHERE route IN ('flood', 'domain_report')"
).replace("initcap_words(label)", "upper(left(label, 1)) || substr(label, 2)")

_UNKNOWN = _q(fixed.NOT_REPORTED)
EVIDENCE_CELLS = (
    "cells AS (SELECT seq AS record_id, title AS question, domain AS label, upper(left(domain, 1)) || substr(domain, 2) AS problem_type, "
    f"{_q(fixed.REPORT_NO_STATUS)} AS status, {_display('location')} AS location, {_display('observed_at')} AS event_time, "
    f"{_display('affected_people')} AS affected_people, {_display('deaths')} AS deaths, {_UNKNOWN} AS injuries, {_UNKNOWN} AS missing_people, "
    f"location AS affected_areas, {_q(fixed.REPORT_NO_NEEDS)} AS needs, {_UNKNOWN} AS responders, "
    "'[' || source_name || '](' || source_url || ')' AS sources, "
    f"{_q(fixed.REPORT_EVIDENCE_STATUS)} AS evidence_status, {_q(schemas.EVIDENCE_DEFAULTS['confidence'])} AS confidence FROM evidence_in)"
)


def _markdown(limitations: str = _q(fixed.REPORT_LIMITATIONS)) -> str:
    nl, gap = "chr(10)", "chr(10) || chr(10)"
    cells = [
        "problem_type", "location", "event_time", "affected_people", "deaths", "injuries", "missing_people",
        "affected_areas", "evidence_status", "confidence",
    ]
    table = f" || {nl} || ".join(
        ["'| Field | Report |'", "'|---|---|'"]
        + [f"'| {name} | ' || {cell} || ' |'" for name, cell in zip(fixed.REPORT_FIELDS, cells)]
    )
    return f" || {gap} || ".join([
        "'### ' || problem_type || ' situation report'",
        "'**Question received:** ' || question",
        "'**Direct status:** ' || status",
        table,
        "'**What may be happening:** The agent has identified this as a ' || label || ' question. It should combine hazard observations, "
        "official warnings, humanitarian reports, and impact assessments rather than relying on a single severity score.'",
        "'**Who may need help:** ' || needs || '.'",
        "'**Who may be responding:** ' || responders || '.'",
        "'**Casualty rule:** Death and injury figures are shown only when an attached source explicitly reports them. The agent must not "
        "infer deaths from magnitude, rainfall, population, media attention, or a generic risk label.'",
        "'**Recommended response workflow:** Confirm the exact city, district, block, or village; check the newest official bulletin; compare "
        "affected-population and casualty figures across sources; identify verified shelters and responders; and record the last retrieval "
        "time before taking action.'",
        "'**Sources:** ' || sources",
        f"'**Limitations:** ' || {limitations}",
    ])


SITUATION_ROWS = f"SELECT * EXCLUDE (label), {_markdown('limitations')} AS report FROM cells"

# --- feeds ----------------------------------------------------------------

HAZARD_ROWS = (
    "SELECT 'us' || event_id AS event_id, 'Earthquake' AS hazard, "
    f"CASE WHEN event_id % 6 <> 0 THEN title ELSE {_q(fixed.HAZARD_NAME)} END AS title, "
    f"CASE WHEN event_id % 7 <> 0 THEN place ELSE {_q(fixed.HAZARD_NO_PLACE)} END AS place, "
    "CASE WHEN event_id % 5 <> 0 THEN severity ELSE cast(0 AS double) END AS severity, "
    "date_trunc('millisecond', time) AS time, "
    "CASE WHEN event_id % 9 <> 0 THEN severity END AS latitude, depth_km AS longitude, "
    "CASE WHEN event_id % 9 <> 0 THEN depth_km / 2 END AS depth_km, "
    f"'https://example.org/e/' || cast(event_id AS varchar) AS url, {_q(fixed.HAZARD_SOURCE)} AS source FROM hazards"
)
STRONG = (
    f"strong AS (SELECT * FROM rows_ WHERE time >= timestamp '{q.AS_OF}' - INTERVAL 7 DAYS AND time <= timestamp '{q.AS_OF}' AND severity >= 4.5)"
)
RECENT = (
    f"recent AS (SELECT * FROM hazards WHERE time >= timestamp '{q.AS_OF}' - INTERVAL 7 DAYS AND time <= timestamp '{q.AS_OF}' "
    "AND severity >= 4.5 ORDER BY time DESC, event_id LIMIT 500)"
)


def _peak(source: str) -> str:
    return (
        "SELECT cast(count(*) AS bigint) AS events, max(severity) AS peak_severity, "
        f"(SELECT place FROM {source} ORDER BY severity DESC, event_id LIMIT 1) AS peak_place FROM {source}"
    )


REPORT_ROWS = (
    f"SELECT page_id, coalesce(title, {_q(fixed.REPORT_TITLE)}) AS title, coalesce(country, {_q(fixed.REPORT_COUNTRY)}) AS country, "
    f"coalesce(source, {_q(fixed.REPORT_SOURCE)}) AS source, created, url FROM reports_flat"
)
KEPT_DOMAINS = "domain NOT IN ('flood', 'earthquake', 'cyclone', 'fire', 'landslide')"

ORACLES: dict[str, str] = {
    # triage
    "priority_score": _with("requests", SCORED) + "SELECT request_id, priority_score FROM scored",
    "filtered_requests": _with("requests", SCORED)
    + "SELECT request_id, zone, need_type, status, people_affected, priority_score FROM scored "
    "WHERE status IN ('Unverified', 'Verified', 'Assigned') AND need_type IN ('Water', 'Food', 'Medical', 'Rescue') "
    "AND zone IN ('AFRICA', 'ASIA', 'EUROPE') ORDER BY priority_score DESC, request_id",
    "open_requests": _with("requests")
    + f"SELECT request_id, location, need_type, priority, status, people_affected, requested_units FROM requests WHERE {OPEN}",
    "kpi_snapshot": _with("requests", "shelters", KPIS)
    + "SELECT *, (SELECT cast(count(*) AS bigint) FROM shelters WHERE status = 'Open') AS open_shelters FROM kpis",
    "kpi_display": _with("requests", "shelters", KPIS)
    + "SELECT format('{:,}', critical_requests) AS critical_requests, format('{:,}', open_requests) AS open_requests, "
    "format('{:,}', people_affected) AS people_affected, "
    "format('{:,}', (SELECT cast(count(*) AS bigint) FROM shelters WHERE status = 'Open')) AS open_shelters FROM kpis",
    "need_totals": _with("requests")
    + "SELECT need_type, cast(coalesce(sum(people_affected), 0) AS bigint) AS people_affected FROM requests GROUP BY need_type ORDER BY 2, 1",
    "filter_values": _with("requests")
    + "SELECT 'status' AS field, status AS value FROM requests UNION SELECT 'need_type', need_type FROM requests "
    "UNION SELECT 'zone', zone FROM requests ORDER BY 1, 2",
    "triage_queue": _with("requests", SCORED)
    + "SELECT request_id, location, zone, need_type, people_affected, priority, cast(round_even(priority_score, 0) AS int) AS priority_score, "
    "status, reported_at FROM (SELECT * FROM scored ORDER BY priority_score DESC, people_affected DESC, request_id LIMIT 12)",
    "top_request_per_need": _with("requests", SCORED, TOP_REQUEST.format(where=""))
    + "SELECT need_type, request_id, location, priority, people_affected, requested_units, priority_score FROM top_request",
    "top_supply_per_type": _with("resources", TOP_SUPPLY)
    + "SELECT supply_type, resource_id, resource_type, warehouse, available_units FROM top_supply",
    "dispatch_recommendations": _with("requests", "resources", SCORED, TOP_REQUEST.format(where=f"WHERE {OPEN}"), TOP_SUPPLY)
    + "SELECT need_type AS need, location AS priority_location, least(requested_units, available_units) AS recommended_units, "
    "warehouse AS dispatch_from, priority || ' priority; ' || people_affected || ' people affected' AS reason "
    "FROM top_request JOIN top_supply ON lower(need_type) = supply_type ORDER BY need",
    "dispatch_filtered": _with(
        "requests", "resources", SCORED, TOP_REQUEST.format(where=f"WHERE {OPEN} AND {CHOSEN}"), TOP_SUPPLY
    )
    + "SELECT need_type AS need, location AS priority_location, least(requested_units, available_units) AS recommended_units, "
    "warehouse AS dispatch_from, priority || ' priority; ' || people_affected || ' people affected' AS reason "
    "FROM top_request JOIN top_supply ON lower(need_type) = supply_type ORDER BY need",
    "kpis_filtered": _with("requests", KPIS[:-1] + f" WHERE {CHOSEN})") + "SELECT * FROM kpis",
    "need_totals_filtered": _with("requests")
    + f"SELECT need_type, cast(coalesce(sum(people_affected), 0) AS bigint) AS people_affected FROM requests WHERE {CHOSEN} GROUP BY need_type",
    "request_map_points": _with("requests")
    + "SELECT request_id, location, latitude AS lat, longitude AS lon, priority, people_affected, need_type, status FROM requests",
    "radar_rank": _with("problems")
    + "SELECT problem, impact, urgency, cast(round_even(impact * cast(0.45 AS double) + urgency * cast(0.55 AS double), 0) AS int) AS radar_score "
    "FROM problems ORDER BY radar_score DESC, problem",
    "radar_lookup": _with("problems")
    + "SELECT problem, impact, urgency FROM problems WHERE problem = 'red widget 1' ORDER BY position LIMIT 1",
    "signal_graph_edges": _with("graph_edges")
    + "SELECT src, dst, a.n_name AS source_label, b.n_name AS target_label, value FROM graph_edges "
    "JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst",
    # evidence
    "event_key": _with("evidence_in", _records()) + f"SELECT seq, {_slug('title')} AS slug, event_key FROM records",
    "record_id": _with("evidence_in", _records()) + "SELECT seq, record_id FROM records",
    "evidence_build": _with("evidence_in", _records())
    + "SELECT seq, record_id, event_key, lower(domain) AS domain, title, summary, location, country, source_name, source_url, source_tier, "
    f"observed_at, {_q(q.FETCHED_AT)} AS fetched_at, 'unknown' AS freshness, 'unknown' AS severity, affected_people, deaths, "
    "cast(NULL AS int) AS injuries, cast(NULL AS int) AS missing, 'unverified' AS confidence FROM records",
    "evidence_insert_new": _with("evidence_in", _records(), STORE, NEW)
    + "SELECT seq, record_id, event_key, source_name, observed_at FROM fresh",
    "evidence_merged": _with("evidence_in", _records(), STORE, NEW)
    + "SELECT seq, record_id, event_key, source_tier FROM store UNION ALL SELECT seq, record_id, event_key, source_tier FROM fresh",
    "evidence_load_tolerant": _with("evidence_in", _records())
    + "SELECT record_id, event_key, domain, title, summary, 'unknown' AS freshness, deaths, affected_people FROM records "
    f"WHERE {KEPT_DOMAINS}",
    "evidence_provenance": _with("evidence_in", _records())
    + f"SELECT record_id, event_key, title, location, source_name, source_url, source_tier, observed_at, {_q(q.FETCHED_AT)} AS fetched_at, "
    f"'unknown' AS freshness, 'unverified' AS confidence, CASE WHEN source_tier = {_q(fixed.PRIMARY_TIER)} THEN 'official' ELSE 'corroborating' END "
    f"AS verification_state, {_display('affected_people')} AS affected_people, {_display('deaths')} AS deaths, {_UNKNOWN} AS injuries, "
    f"{_UNKNOWN} AS missing FROM records",
    "evidence_topk": _with(*SEARCH) + "SELECT conv_id, turn, seq, cast(score AS int) AS score, cast(rank AS int) AS rank FROM hits",
    "evidence_context": _with(*SEARCH, CONTEXTS) + "SELECT conv_id, turn, context, matches FROM contexts",
    "question_evidence": _with(*SEARCH, CONTEXTS)
    + f"SELECT conv_id, turn, coalesce(matches, 0) AS matches, coalesce(context, {_q(fixed.NO_MATCH)}) AS context "
    "FROM questions LEFT JOIN contexts USING (conv_id, turn)",
    # events
    "event_rollup": _with("evidence_in", _records())
    + "SELECT event_key, cast(count(*) AS bigint) AS records, cast(count(DISTINCT (source_name, source_url)) AS bigint) AS sources, "
    "min(observed_at) AS first_observed, max(observed_at) AS last_observed FROM records GROUP BY event_key",
    "event_sources": _with("evidence_in", _records())
    + "SELECT event_key, source_name, source_url, cast(count(*) AS bigint) AS records, min(observed_at) AS first_observed, "
    "max(observed_at) AS last_observed FROM records GROUP BY event_key, source_name, source_url",
    "event_latest": _with("evidence_in", _records())
    + "SELECT event_key, seq, record_id, observed_at, source_name, deaths FROM records "
    "QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY observed_at DESC, record_id, seq) = 1",
    "casualty_ranges": _with("evidence_in", _records())
    + "SELECT event_key, min(deaths) AS deaths_min, max(deaths) AS deaths_max, cast(count(deaths) AS bigint) AS figures, "
    "cast(count(*) AS bigint) AS records, coalesce(min(deaths) < max(deaths), false) AS conflicting FROM records GROUP BY event_key",
    "casualty_figures": _with("evidence_in", _records())
    + "SELECT event_key, observed_at, source_name, deaths, cast(count(*) AS bigint) AS records FROM records "
    "WHERE deaths IS NOT NULL GROUP BY event_key, observed_at, source_name, deaths",
    "casualty_primary_only": _with("evidence_in", _records())
    + f"SELECT event_key, min(d) AS deaths_min, max(d) AS deaths_max, cast(count(d) AS bigint) AS figures, "
    "cast(count(*) FILTER (WHERE p) AS bigint) AS primary_records, cast(count(*) FILTER (WHERE NOT p) AS bigint) AS corroborating_records "
    f"FROM (SELECT event_key, source_tier = {_q(fixed.PRIMARY_TIER)} AS p, CASE WHEN source_tier = {_q(fixed.PRIMARY_TIER)} THEN deaths END AS d "
    "FROM records) GROUP BY event_key",
    # questions
    "classify_question": _with("questions", _classified("questions", "text"))
    + "SELECT conv_id, turn, domain, label, "
    "coalesce(array_to_string(list_transform(list_filter(hits, lambda h: h.d = domain), lambda h: h.t), '|'), '') AS matched_terms FROM classified",
    "refresh_trigger": _with("questions") + f"SELECT conv_id, turn, {_any('lower(text)', fixed.REFRESH_TERMS)} AS refresh FROM questions",
    "death_question_flag": _with("questions")
    + f"SELECT conv_id, turn, {_any('lower(text)', fixed.CASUALTY_STEMS)} AS death_requested FROM questions",
    "query_terms": _with("questions")
    + "SELECT conv_id, turn, cast(len(t) AS int) AS n_terms, coalesce(array_to_string(list_sort(t), ' '), '') AS terms FROM "
    "(SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM questions)",
    "conversation_context": _with("questions", HISTORY) + "SELECT conv_id, turn, history FROM history",
    "routing_text": _with("questions", HISTORY, ROUTING) + "SELECT conv_id, turn, routing_text FROM routing",
    "answer_route": _with(*ALL_ROUTED) + "SELECT conv_id, turn, domain, route, sub_domain, death_requested FROM routed",
    "answer_route_current": _with("questions", _classified("questions", "text"), ROUTED)
    + "SELECT conv_id, turn, domain, route, sub_domain, death_requested FROM routed",
    "situation_report": _with(*ALL_ROUTED, f"cells AS ({SITUATION})") + SITUATION_ROWS,
    "situation_report_current": _with("questions", _classified("questions", "text"), ROUTED, f"cells AS ({SITUATION})") + SITUATION_ROWS,
    "evidence_situation_report": _with("evidence_in", EVIDENCE_CELLS)
    + f"SELECT * EXCLUDE (label), {_markdown()} AS report FROM cells",
    "resource_answer": _with("requests", KPIS, *ALL_ROUTED) + f"SELECT conv_id, turn, {RESOURCE_TEXT} AS answer FROM routed CROSS JOIN kpis k WHERE route = 'resource'",
    "answer_with_evidence": _with("requests", KPIS, *SEARCH, HISTORY, ROUTING, _classified("routing", "routing_text"), ROUTED, CONTEXTS)
    + f"SELECT conv_id, turn, {RESOURCE_TEXT} || CASE WHEN context IS NULL THEN {_q(fixed.NO_EVIDENCE_SECTION)} ELSE {_filled(fixed.EVIDENCE_SECTION, 'context')} END AS answer "
    "FROM routed CROSS JOIN kpis k LEFT JOIN contexts USING (conv_id, turn) WHERE route = 'resource'",
    "hazard_answer": _with("hazards", f"rows_ AS ({HAZARD_ROWS})", STRONG, f"peak AS ({_peak('strong')})", *ALL_ROUTED)
    + "SELECT conv_id, turn, "
    + _filled(
        fixed.HAZARD_ANSWER, "p.events", "coalesce('M' || format('{:.1f}', round_even(p.peak_severity, 1)), 'not available')",
        "coalesce(p.peak_place, 'not available')", f"CASE WHEN death_requested THEN {_q(fixed.HAZARD_DEATHS_ASKED)} ELSE {_q(fixed.HAZARD_DEATHS)} END",
    )
    + " AS answer FROM routed CROSS JOIN peak p WHERE route = 'earthquake'",
    "conversation_counts": _with("questions") + "SELECT conv_id, cast(count(*) AS bigint) AS messages FROM questions GROUP BY conv_id",
    "conversation_title": _with("questions")
    + f"SELECT conv_id, left(text, {fixed.TITLE_CHARS}) || CASE WHEN length(text) > {fixed.TITLE_CHARS} THEN '…' ELSE '' END AS title "
    "FROM questions QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1",
    "conversation_transcript": _with(
        "questions",
        "numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM questions)",
    )
    + "SELECT conv_id, cast(pos // 500 AS int) AS part, "
    "string_agg(upper(left(role, 1)) || substr(role, 2) || ': ' || text, chr(10) || chr(10) ORDER BY pos) AS transcript "
    "FROM numbered GROUP BY conv_id, part",
    "transcript_export": _with(
        "questions",
        "numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM questions)",
    )
    + "SELECT conv_id, cast(pos // 500 AS int) AS part, "
    "string_agg(upper(left(role, 1)) || substr(role, 2) || ': ' || text, chr(10) || chr(10) ORDER BY pos) AS transcript "
    "FROM numbered WHERE conv_id % 7 <> 0 GROUP BY conv_id, part UNION ALL "
    f"SELECT DISTINCT conv_id, 0, {_q(fixed.EMPTY_TRANSCRIPT)} FROM questions WHERE conv_id % 7 = 0",
    "operational_csv": _with("resources")
    + "SELECT resource_id, resource_type, warehouse, CASE WHEN available_units % 9 <> 0 THEN available_units END AS available_units, unit FROM resources",
    "triage_export": _with("requests", SCORED)
    + "SELECT request_id, location, zone, need_type, people_affected, requested_units, priority, status, "
    "cast(round_even(priority_score, 0) AS int) AS priority_score FROM scored",
    "document_excerpt": f"SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN left(text, {fixed.EXCERPT_CHARS}) ELSE {_q(fixed.BINARY_ATTACHMENT)} END AS excerpt, "
    f"CASE WHEN doc_id % 4 <> 0 THEN source WHEN doc_id % 8 <> 0 THEN lang ELSE {_q(fixed.NO_ATTACHMENT)} END AS label FROM documents",
    "display_value": _with("evidence_in")
    + f"SELECT seq, {_display('deaths')} AS deaths, {_display('odd')} AS shown FROM (SELECT *, CASE domain WHEN 'flood' THEN chr(9) || chr(13) || chr(10) || ' ' "
    "WHEN 'fire' THEN 'nan' WHEN 'drought' THEN ' None ' WHEN 'heat' THEN ' kept ' ELSE title END AS odd FROM evidence_in)",
    # feeds
    "hazard_normalize": _with("hazards") + HAZARD_ROWS,
    "hazard_recent": _with("hazards", RECENT) + "SELECT * FROM recent",
    "hazard_peak": _with("hazards", f"rows_ AS ({HAZARD_ROWS})") + _peak("rows_"),
    "hazard_display": _with("hazards", f"rows_ AS ({HAZARD_ROWS})")
    + "SELECT event_id, format('{:.5f}', longitude) AS longitude, 'M' || format('{:.1f}', round_even(severity, 1)) AS magnitude FROM rows_",
    "reports_normalize": _with("reports_flat") + REPORT_ROWS,
    "reports_landed": _with("reports_flat") + f"SELECT * FROM ({REPORT_ROWS}) WHERE page_id % 10 > 2 AND page_id % 20 <> 13",
    "reports_rescued": _with("reports_flat")
    + "SELECT cast(page_id % 20 AS int) AS source, CASE page_id % 10 WHEN 0 THEN 'unparsable' WHEN 1 THEN 'foreign' ELSE 'empty' END AS reason, "
    "CASE page_id % 10 WHEN 0 THEN left('{\"page_id\":' || page_id || ',\"data\":[{', 20) WHEN 1 THEN '[1]' ELSE ' ' END AS raw, count(*) AS documents "
    "FROM reports_flat WHERE page_id % 10 <= 2 OR page_id % 20 = 13 GROUP BY ALL",
    "landed_status": _with("reports_flat")
    + "SELECT cast(i AS int) AS source, CASE WHEN coalesce(documents, 0) > 0 THEN 'ok' ELSE 'unavailable' END AS status, cast(coalesce(documents, 0) AS bigint) AS documents, "
    "cast(coalesce(empty, 0) AS bigint) AS empty, cast(coalesce(damaged, 0) AS bigint) AS damaged FROM range(21) t(i) LEFT JOIN "
    "(SELECT page_id % 20 AS s, count(*) FILTER (WHERE page_id % 10 > 2 AND page_id % 20 <> 13) AS documents, "
    "count(*) FILTER (WHERE page_id % 10 = 2 OR page_id % 20 = 13) AS empty, count(*) FILTER (WHERE page_id % 10 < 2) AS damaged FROM reports_flat GROUP BY 1) ON s = i",
    "reports_latest": _with("reports_flat", f"rows_ AS ({REPORT_ROWS})")
    + "SELECT title, country, source, created, url FROM rows_ ORDER BY created DESC, url LIMIT 20",
    "gazetteer_lookup": _with(
        "requests",
        "asked AS (SELECT DISTINCT CASE need_type WHEN 'Water' THEN lower(location) WHEN 'Food' THEN ' ' || location || ' ' "
        "WHEN 'Rescue' THEN 'Lost ' || location WHEN 'Transport' THEN ' ' ELSE location END AS query FROM requests)",
    )
    + "SELECT query, n_name AS display_name, cast(n_nationkey AS double) AS latitude, cast(-n_nationkey AS double) AS longitude, "
    f"CASE WHEN n_name IS NOT NULL THEN {_q(fixed.GAZETTEER_SOURCE)} END AS source "
    "FROM asked LEFT JOIN nation ON lower(trim(query)) = lower(trim(n_name))",
    "weather_current": _with("weather_flat")
    + "SELECT station_id, temperature_2m, relative_humidity_2m, precipitation, wind_speed_10m, weather_code, "
    "temperature_2m IS NOT NULL AS temperature_shown, wind_speed_10m IS NOT NULL AS wind_shown FROM weather_flat",
    "weather_daily": _with("weather_flat")
    + "SELECT station_id, 0 AS day, day0 AS time, v0 AS precipitation_sum, v2 AS wind_gusts_10m_max, v1 AS temperature_2m_max FROM weather_flat "
    "UNION ALL SELECT station_id, 1, day1, v1, v1, v1 FROM weather_flat UNION ALL SELECT station_id, 2, day2, v2, v0, v1 FROM weather_flat",
    "page_text": _with("alert_pages") + f"SELECT page_id, {_visible('html')} AS page_text FROM alert_pages",
    "alert_extract": _with(*ALERTS) + "SELECT page_id, pos, label, detail FROM alerts",
    "alert_records": _with(
        *ALERTS,
        f"built AS (SELECT page_id, pos, label AS domain, 'SACHET ' || label || ' alert' AS title, detail AS summary, detail AS location, "
        f"{_q(fixed.ALERT_SOURCE)} AS source_name, {_q(q.FETCHED_AT)} AS observed_at FROM alerts)",
        _records("built"),
    )
    + "SELECT page_id, pos, record_id, event_key, lower(domain) AS domain, title, summary, "
    f"{_q(fixed.ALERT_FRESHNESS)} AS freshness, {_q(fixed.ALERT_CONFIDENCE)} AS confidence FROM records",
    "raw_json_status": "SELECT event_id, 'Events' AS source, 'props' AS label, "
    "CASE WHEN json_valid(payload) THEN 'https://example.org/reference' END AS reference, CASE WHEN json_valid(payload) THEN payload END AS payload, "
    "CASE WHEN json_valid(payload) THEN 'ok' ELSE 'unavailable' END AS status FROM "
    "(SELECT event_id, CASE WHEN event_id % 10 = 0 THEN left(props, 3) ELSE props END AS payload FROM events)",
    "ingest_status": _with("evidence_in")
    + "SELECT source, url, CASE WHEN n IS NULL THEN 'unavailable' ELSE 'ok' END AS status, cast(coalesce(n, 0) AS bigint) AS records FROM "
    "(SELECT 'src' || i AS source, 'https://example.org/src' || i AS url FROM range(21) t(i)) "
    "LEFT JOIN (SELECT source_name AS source, source_url AS url, count(*) AS n FROM evidence_in GROUP BY ALL) USING (source, url)",
    # streams
    "stream_evidence_ingest": _with(
        "evidence_in", "dated AS (SELECT * REPLACE (CASE WHEN seq % 11 <> 0 THEN observed_at ELSE '' END AS observed_at) FROM evidence_in)", _records("dated"),
        "firsts AS (SELECT *, CASE WHEN seq % 3 < 2 THEN 0 WHEN seq % 2 = 0 THEN 1 ELSE 2 END AS k FROM records "
        "QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY seq) = 1)",
    )
    + "SELECT record_id, event_key, source_name, observed_at, k || ' ' || summary AS summary, cast(deaths + k AS int) AS deaths, affected_people FROM firsts",
    "raw_json_fields": "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN cast(json_extract_string(props, '$.k') AS int) END AS k, "
    "CASE WHEN event_id % 10 <> 0 THEN json_extract_string(props, '$.k') END AS k_text, cast(NULL AS double) AS absent FROM events",
    "stream_bounded_ingest": _with(
        "evidence_in", "dated AS (SELECT * REPLACE (CASE WHEN seq % 11 <> 0 THEN observed_at ELSE '' END AS observed_at) FROM evidence_in)", _records("dated"),
        "days AS (SELECT *, substr(observed_at, 9, 2) AS day FROM records)",
        "landed AS (SELECT *, 0 AS k FROM days WHERE day <= '10' AND seq % 3 < 2 UNION ALL SELECT *, 1 FROM days WHERE day <= '20' AND seq % 5 > 0 "
        "UNION ALL SELECT *, 2 FROM days WHERE day <= '04' OR day > '18' UNION ALL SELECT *, 3 FROM days)",
        "firsts AS (SELECT * FROM landed QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY k, seq) = 1)",
    )
    + "SELECT record_id, event_key, source_name, observed_at, k || ' ' || summary AS summary, deaths, affected_people FROM firsts",
    "stream_hazard_unique": _with("hazards") + HAZARD_ROWS,
}
