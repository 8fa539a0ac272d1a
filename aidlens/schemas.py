"""Explicit schemas of every table the package reads."""

from pyspark.sql import types as T

REQUESTS = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("zone", T.StringType()),
    T.StructField("need_type", T.StringType()),
    T.StructField("people_affected", T.IntegerType()),
    T.StructField("requested_units", T.IntegerType()),
    T.StructField("priority", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("reported_at", T.TimestampNTZType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
])

SHELTERS = T.StructType([
    T.StructField("shelter_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("zone", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("capacity", T.IntegerType()),
    T.StructField("occupied", T.IntegerType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
])

HOSPITALS = T.StructType([
    T.StructField("hospital_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("zone", T.StringType()),
    T.StructField("beds_available", T.IntegerType()),
    T.StructField("icu_available", T.IntegerType()),
    T.StructField("medical_stock_level", T.StringType()),
    T.StructField("status", T.StringType()),
])

RESOURCES = T.StructType([
    T.StructField("resource_id", T.StringType()),
    T.StructField("resource_type", T.StringType()),
    T.StructField("warehouse", T.StringType()),
    T.StructField("available_units", T.IntegerType()),
    T.StructField("unit", T.StringType()),
])

# The first twelve fields must be present in a stored record; the rest have defaults.
EVIDENCE_REQUIRED = [
    "record_id", "event_key", "domain", "title", "summary", "location", "country",
    "source_name", "source_url", "source_tier", "observed_at", "fetched_at",
]
EVIDENCE_DEFAULTS = {
    "freshness": "unknown",
    "severity": "unknown",
    "affected_people": None,
    "deaths": None,
    "injuries": None,
    "missing": None,
    "confidence": "unverified",
    "raw": "{}",
}
EVIDENCE_FIGURES = ["affected_people", "deaths", "injuries", "missing"]
EVIDENCE = T.StructType(
    [T.StructField(name, T.StringType()) for name in EVIDENCE_REQUIRED]
    + [
        T.StructField(name, T.IntegerType() if name in EVIDENCE_FIGURES else T.StringType())
        for name in EVIDENCE_DEFAULTS
    ]
)

HAZARD_FEED = T.StructType([
    T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("properties", T.StructType([
            T.StructField("title", T.StringType()),
            T.StructField("mag", T.DoubleType()),
            T.StructField("place", T.StringType()),
            T.StructField("time", T.LongType()),
            T.StructField("url", T.StringType()),
        ])),
        T.StructField("geometry", T.StructType([
            T.StructField("coordinates", T.ArrayType(T.DoubleType())),
        ])),
    ]))),
])

_NAMED = T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))
REPORT_FEED = T.StructType([
    T.StructField("data", T.ArrayType(T.StructType([
        T.StructField("fields", T.StructType([
            T.StructField("title", T.StringType()),
            T.StructField("url", T.StringType()),
            T.StructField("date", T.StructType([T.StructField("created", T.StringType())])),
            T.StructField("primary_country", _NAMED),
            T.StructField("source", _NAMED),
        ])),
    ]))),
])
REPORTS = T.StructType([
    T.StructField(name, T.StringType()) for name in ("title", "country", "source", "created", "url")
])

WEATHER_FEED = T.StructType([
    T.StructField("current", T.StructType([
        T.StructField("temperature_2m", T.DoubleType()),
        T.StructField("relative_humidity_2m", T.DoubleType()),
        T.StructField("precipitation", T.DoubleType()),
        T.StructField("wind_speed_10m", T.DoubleType()),
        T.StructField("weather_code", T.IntegerType()),
    ])),
    T.StructField("daily", T.StructType([
        T.StructField("time", T.ArrayType(T.StringType())),
        T.StructField("precipitation_sum", T.ArrayType(T.DoubleType())),
        T.StructField("wind_gusts_10m_max", T.ArrayType(T.DoubleType())),
        T.StructField("temperature_2m_max", T.ArrayType(T.DoubleType())),
    ])),
])

GEOCODE_FEED = T.StructType([
    T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("geometry", T.StructType([
            T.StructField("coordinates", T.ArrayType(T.DoubleType())),
        ])),
        T.StructField("properties", T.StructType([
            T.StructField("label", T.StringType()),
            T.StructField("geocoding", T.StringType()),
        ])),
    ]))),
])

# The given tables, with the columns in use, so that no query starts with a job over file footers.
GIVEN = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": "l_orderkey bigint, l_suppkey bigint, l_quantity double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
