"""Canonical input views over the given tables.

The SQL is valid in Spark and in DuckDB, so the same text feeds the queries and their oracles.
Table names are placeholders, ``{orders}``; an oracle uses the plain name.
"""

import re

from pyspark.sql import DataFrame, SparkSession

from aidlens import schemas

VIEWS = {
    "requests": """
SELECT 'REQ-' || cast(o.o_orderkey AS string) AS request_id, n.n_name AS location, r.r_name AS zone,
  split_part('Water|Food|Medical|Shelter|Rescue|Transport', '|', cast(o.o_orderkey % 6 + 1 AS int)) AS need_type,
  cast(floor(o.o_totalprice / 500) AS int) AS people_affected,
  cast(coalesce(l.qty, 0) AS int) AS requested_units,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High'
    WHEN '3-MEDIUM' THEN 'Medium' WHEN '5-LOW' THEN 'Low' ELSE 'Unspecified' END AS priority,
  CASE WHEN o.o_orderstatus = 'F' THEN 'Completed' WHEN o.o_orderstatus = 'P' THEN 'Assigned'
    WHEN o.o_orderkey % 2 = 0 THEN 'Unverified' ELSE 'Verified' END AS status,
  o.o_orderdate AS reported_at,
  cast(o.o_custkey % 180 - 90 AS double) AS latitude, cast(o.o_custkey % 360 - 180 AS double) AS longitude
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
JOIN {region} r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS qty FROM {lineitem} GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey""",
    "request_heads": """
SELECT 'REQ-' || cast(o.o_orderkey AS string) AS request_id, o.o_orderkey AS order_key, n.n_name AS location, r.r_name AS zone,
  split_part('Water|Food|Medical|Shelter|Rescue|Transport', '|', cast(o.o_orderkey % 6 + 1 AS int)) AS need_type,
  cast(floor(o.o_totalprice / 500) AS int) AS people_affected,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High'
    WHEN '3-MEDIUM' THEN 'Medium' WHEN '5-LOW' THEN 'Low' ELSE 'Unspecified' END AS priority,
  CASE WHEN o.o_orderstatus = 'F' THEN 'Completed' WHEN o.o_orderstatus = 'P' THEN 'Assigned'
    WHEN o.o_orderkey % 2 = 0 THEN 'Unverified' ELSE 'Verified' END AS status
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
JOIN {region} r ON n.n_regionkey = r.r_regionkey""",
    "resources": """
SELECT 'R-' || cast(s_suppkey AS string) AS resource_id,
  CASE WHEN s_suppkey % 4 = 1 THEN upper(split_part('Water|Food|Medical|Shelter|Rescue|Transport', '|', cast(s_suppkey % 6 + 1 AS int)))
       ELSE split_part('Water|Food|Medical|Shelter|Rescue|Transport', '|', cast(s_suppkey % 6 + 1 AS int)) END AS resource_type,
  s_name AS warehouse, cast(floor(s_acctbal / 10) AS int) AS available_units, 'units' AS unit
FROM {supplier}""",
    "shelters": """
SELECT 'S-' || cast(s.s_suppkey AS string) AS shelter_id, s.s_name AS name, r.r_name AS zone,
  CASE WHEN s.s_suppkey % 3 = 0 THEN 'At Capacity' ELSE 'Open' END AS status,
  cast(200 + s.s_suppkey % 500 AS int) AS capacity, cast(100 + s.s_suppkey % 100 AS int) AS occupied
FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey""",
    "hazards": """
SELECT event_id, 'Earthquake' AS hazard, event_type AS title, 'place ' || cast(user_id AS string) AS place,
  value / cast(50 AS double) AS severity, ts AS time, cast(regexp_extract(props, '([0-9]+)', 1) AS double) AS depth_km
FROM {events}""",
    "evidence_in": """
SELECT doc_id AS seq, split_part('flood|earthquake|cyclone|fire|landslide|drought|heat|conflict|health', '|', cast(length(split_part(text, ' ', 1)) % 9 + 1 AS int)) AS domain,
  left(text, 60) AS title, text AS summary, lang AS location, lang AS country, source AS source_name,
  'https://example.org/' || source AS source_url,
  CASE WHEN doc_id % 3 = 0 THEN 'primary-government' ELSE 'secondary-news' END AS source_tier,
  '2026-01-' || lpad(cast(1 + n_chars % 28 AS string), 2, '0') || 'T00:00:00Z' AS observed_at,
  CASE WHEN doc_id % 3 <> 1 THEN cast(doc_id % 100 AS int) END AS deaths,
  CASE WHEN doc_id % 4 = 0 THEN cast(doc_id % 1000000 AS int) END AS affected_people
FROM {documents}""",
    "questions": """
SELECT conv_id, turn, role, text || ' ' || split_part('assam baadh|earthquake tremor|storm surge|forest fire|mudslide|water scarcity|heatwave|outbreak|food shortage|inflation|blood|risk in asia|how many|hello|violence', '|',
  cast((conv_id * 8 + turn) % 15 + 1 AS int)) AS text
FROM {conversations}""",
    "alert_pages": """
SELECT page_id, url, html || '<p title="a > b">Caf&eacute; &#8364;5 &#x41;&#150;&hellip; &notit; AT&T</p><p>|</p><p>Flood  warning for zone ' || cast(page_id % 10 AS string) || ' -</p><p>|</p><p>FIRE near site ' || cast(page_id % 7 AS string)
  || '</p><p>|</p><p>Flood warning for zone ' || cast(page_id % 10 AS string) || '</p>'
  || CASE page_id % 4 WHEN 0 THEN '<script>x = "Flood in zone 11' WHEN 1 THEN '<!-- Fire near zone 12' WHEN 2 THEN '<a href="Rain in zone 13' ELSE '' END AS html
FROM {pages}""",
    "reports_flat": """
SELECT page_id, CASE WHEN page_id % 6 = 0 THEN NULL ELSE url END AS title, CASE WHEN page_id % 5 = 0 THEN NULL ELSE 'NATION_' || cast(page_id % 25 AS string) END AS country,
  CASE WHEN page_id % 7 = 0 THEN NULL ELSE 'src' || cast(page_id % 20 AS string) END AS source,
  '2026-01-' || lpad(cast(1 + page_id % 28 AS string), 2, '0') AS created, url
FROM {pages}""",
    "graph_edges": """
SELECT s.s_nationkey AS src, c.c_nationkey AS dst, count(*) AS value
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
GROUP BY s.s_nationkey, c.c_nationkey""",
    "problems": """
SELECT p_partkey AS position, p_name || ' ' || cast(p_partkey AS string) AS problem,
  cast(p_size + 50 AS double) AS impact, cast(cast(floor(p_retailprice) AS bigint) % 100 AS double) AS urgency
FROM {part}""",
    "weather_flat": """
SELECT event_id AS station_id, CASE WHEN event_id % 5 <> 0 THEN value / cast(10 AS double) END AS temperature_2m,
  value % cast(100 AS double) AS relative_humidity_2m, value / cast(100 AS double) AS precipitation,
  CASE WHEN event_id % 7 <> 0 THEN value / cast(4 AS double) END AS wind_speed_10m,
  cast(event_id % 100 AS int) AS weather_code,
  cast(cast(ts AS date) AS string) AS day0, cast(cast(ts AS date) + 1 AS string) AS day1, cast(cast(ts AS date) + 2 AS string) AS day2,
  value AS v0, value / cast(2 AS double) AS v1, value / cast(4 AS double) AS v2
FROM {events}""",
}

# Unique keys of the tables that carry costly work per row, to rebalance them by.
SPREAD_KEYS = {
    "orders": ["o_orderkey"],
    "events": ["event_id"],
    "documents": ["doc_id"],
    "pages": ["page_id"],
    "conversations": ["conv_id", "turn"],
}


def tables_of(view: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", VIEWS[view])))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(schemas.GIVEN[name]).parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, rebalance: bool = False) -> DataFrame:
    """A view as a DataFrame; ``rebalance`` deals rows of costly work anew, in sizes that Spark chooses."""
    frames = {}
    for t in tables_of(name):
        frame = table(spark, sf_dir, t)
        frames[t] = frame.hint("rebalance", *SPREAD_KEYS[t]) if rebalance and t in SPREAD_KEYS else frame
    return spark.sql(VIEWS[name], **frames)


def view_sql(name: str) -> str:
    """The view's text over plain table names."""
    return VIEWS[name].format(**{t: t for t in tables_of(name)})
