"""Literal fixtures: a small request table, stock, shelters and evidence records."""

_REQUESTS = """
1001|Shivaji Nagar|North|Water|420|42|Critical|Verified
1002|Kurla West|East|Medical|85|18|Critical|Assigned
1003|Dharavi|Central|Food|310|31|High|Verified
1004|Chembur Camp|East|Shelter|160|40|High|Unverified
1005|Sion Koliwada|Central|Rescue|44|3|Critical|Assigned
1006|Malad Creek|West|Water|225|23|High|Verified
1007|Mankhurd|East|Food|180|18|High|Unverified
1008|Jogeshwari East|West|Medical|62|12|Medium|Verified
1009|Wadala|Central|Transport|96|4|Medium|Assigned
1010|Govandi|East|Water|260|26|Critical|Verified
1011|Andheri Subway|West|Rescue|28|2|High|Unverified
1012|Byculla|South|Food|120|12|Medium|Completed
1013|Colaba|South|Medical|35|6|Low|Completed
1014|Chunabhatti|Central|Shelter|190|48|High|Verified
1015|Versova|West|Water|140|14|Medium|Unverified
"""
REQUEST_COLUMNS = (
    "request_id string, location string, zone string, need_type string, people_affected int, "
    "requested_units int, priority string, status string, reported_at string, latitude double, longitude double"
)
REQUESTS = [
    (f[0], f[1], f[2], f[3], int(f[4]), int(f[5]), f[6], f[7], "2026-08-19 07:20", 19.0, 72.8)
    for f in (line.split("|") for line in _REQUESTS.split("\n") if line)
]
SCORES = {
    "1001": 78.0, "1002": 70.25, "1003": 58.5, "1004": 43.0, "1005": 66.2, "1006": 58.25, "1007": 46.0,
    "1008": 45.1, "1009": 35.8, "1010": 70.0, "1011": 46.4, "1012": 2.0, "1013": 0.0, "1014": 50.5, "1015": 37.0,
}

RESOURCE_COLUMNS = "resource_id string, resource_type string, warehouse string, available_units int, unit string"
RESOURCES = [
    ("R-01", "Water", "Central Depot", 260, "tanks"),
    ("R-02", "Food", "Central Depot", 180, "packages"),
    ("R-03", "Medical", "East Medical Hub", 72, "kits"),
    ("R-04", "Shelter", "North Logistics Hub", 120, "tents"),
    ("R-05", "Rescue", "West Equipment Hub", 14, "teams"),
    ("R-06", "Transport", "South Fleet Yard", 9, "vehicles"),
]

SHELTER_COLUMNS = "shelter_id string, status string"
SHELTERS = [(f"S-0{i}", "At Capacity" if i == 3 else "Open") for i in range(1, 7)]

EVIDENCE_COLUMNS = (
    "seq bigint, domain string, title string, summary string, location string, country string, source_name string, "
    "source_url string, source_tier string, observed_at string, deaths int, affected_people int"
)


def record(seq, **changes):
    base = {
        "seq": seq, "domain": "flood", "title": "SACHET Flood alert", "summary": "Flood alert for Assam",
        "location": "Assam", "country": "India", "source_name": "NDMA SACHET", "source_url": "https://example.org/",
        "source_tier": "primary-government", "observed_at": "2026-08-20T00:00:00Z", "deaths": None,
        "affected_people": None,
    }
    return tuple((base | changes).values())
