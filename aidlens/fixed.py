"""Weights, word lists, patterns and texts that decide results.

They are plain data. Nothing here computes anything.
"""

# --- priority score -------------------------------------------------------
PRIORITY_POINTS = {"Critical": 35, "High": 25, "Medium": 14, "Low": 5}
NEED_POINTS = {"Medical": 22, "Rescue": 20, "Water": 16, "Food": 12, "Shelter": 10, "Transport": 8}
STATUS_POINTS = {"Unverified": 0, "Verified": 6, "Assigned": 9, "Completed": -30}
PEOPLE_PER_POINT = 20
PEOPLE_POINTS_MAX = 30
SCORE_MAX = 100

# --- radar score ----------------------------------------------------------
RADAR_IMPACT_WEIGHT = 0.45
RADAR_URGENCY_WEIGHT = 0.55

# --- question domains -----------------------------------------------------
DOMAIN_TERMS = {
    "flood": ["flood", "flooding", "baadh", "inundation", "waterlogging", "river overflow"],
    "earthquake": ["earthquake", "seismic", "tremor", "bhukamp"],
    "cyclone": ["cyclone", "hurricane", "typhoon", "storm surge", "toofan"],
    "fire": ["wildfire", "forest fire", "active fire", "bushfire", "aag"],
    "landslide": ["landslide", "mudslide", "rockfall", "land slide"],
    "drought": ["drought", "dry spell", "water scarcity", "sukha"],
    "heat": ["heatwave", "heat wave", "extreme heat", "loo"],
    "conflict": ["war", "conflict", "violence", "attack", "battle"],
    "health": ["outbreak", "epidemic", "pandemic", "disease", "health emergency"],
}
NO_DOMAIN = "general"
NO_DOMAIN_LABEL = "world issue"

# --- answer routes --------------------------------------------------------
REFRESH_TERMS = ["india", "assam", "flood", "baadh", "cyclone", "earthquake", "alert", "disaster"]
CASUALTY_STEMS = ["die", "died", "death", "deaths", "fatalit", "casualt"]
RESOURCE_WORDS = ["resource", "shortage", "food", "water", "medicine", "supply", "help"]
UNCONNECTED_WORDS = [
    "conflict", "war", "violence", "health", "disease", "outbreak", "epidemic", "pandemic",
    "agriculture", "crop", "drought", "energy", "oil", "gas", "economy", "inflation", "market",
    "stock", "supply chain", "internet", "outage", "housing", "city", "science",
]
HEALTH_WORDS = ["health", "disease", "outbreak", "epidemic", "pandemic"]
CONFLICT_WORDS = ["conflict", "war", "violence"]
HEALTH_LABEL = "public health"
CONFLICT_LABEL = "conflict and violence"
ECONOMY_LABEL = "economy, markets, and supply chains"
SCAN_WORDS = ["asia", "emerging", "global problem", "world issue", "biggest problem", "risk"]
ASSAM_FLOOD_WORDS = ["flood", "flooding", "baadh", "water", "inundat"]
WEATHER_WORDS = ["climate", "weather", "heat", "rain"]
CAPABILITY_WORDS = ["how", "what can you", "capability", "source", "data"]

# --- conversations --------------------------------------------------------
HISTORY_MESSAGES = 8
TITLE_CHARS = 52
EMPTY_TRANSCRIPT = "No messages yet."
HISTORY_HEADING = "Previous conversation:"
CURRENT_MESSAGE = "Current user message: "
TEXT_MIME_TYPES = ["text/plain", "text/markdown", "text/csv", "application/json"]
EXCERPT_CHARS = 12000
BINARY_ATTACHMENT = "Binary document attached; inspect it with Gemini when configured."
NO_ATTACHMENT = "No attachment"

# --- evidence -------------------------------------------------------------
NO_MATCH = "No matching stored evidence records."
NOT_REPORTED = "Not reported by the connected source"
BLANK_VALUES = ["", "nan", "NaN", "None"]
SLUG_CHARS = 80
EVENT_KEY_CHARS = 20
RECORD_ID_CHARS = 24

# --- feeds ----------------------------------------------------------------
HAZARD_NAME = "Earthquake"
HAZARD_NO_PLACE = "Unknown location"
HAZARD_SOURCE = "USGS Earthquake Hazards Program"
REPORT_TITLE = "Humanitarian update"
REPORT_COUNTRY = "Global"
REPORT_SOURCE = "ReliefWeb"
GAZETTEER_SOURCE = "OpenStreetMap Nominatim"
NO_READING = "—"
ALERT_PATTERN = (
    r"(?i)(Flood|Cyclone|Earthquake|Landslide|Lightning|Thunderstorm|Heat Wave|Fire|Rain|Tsunami)"
    r"\s+([^|]{3,140})"
)
ALERT_LIMIT = 30
ALERT_SOURCE = "NDMA SACHET"
ALERT_URL = "https://sachet.ndma.gov.in/"
ALERT_COUNTRY = "India"
ALERT_TIER = "primary-government"
ALERT_FRESHNESS = "live-page"
ALERT_CONFIDENCE = "source-reported"
PRIMARY_TIER = "primary-government"

# --- situation report -----------------------------------------------------
REPORT_FIELDS = [
    "Problem type", "Location", "Event or report time", "Affected people", "Deaths", "Injuries",
    "Missing people", "Affected areas", "Evidence status", "Confidence",
]
REPORT_NO_STATUS = "Not confirmed by the connected source"
REPORT_NO_NEEDS = "Assess water, food, medicine, shelter, rescue, and communications needs"
REPORT_NO_LINKS = "No source link attached yet"
REPORT_EVIDENCE_STATUS = "Prototype routing; verify with an authoritative live source"
REPORT_CONFIDENCE = "Low until a current source record is attached"
REPORT_LIMITATIONS = (
    "Unknown values are not treated as zero. Casualties must be explicitly reported by a source."
)
FLOOD_REPORT = {
    "status": "No location-specific live flood impact record is attached yet",
    "needs": ["water, food, medicine, shelter, rescue, and communications"],
    "links": [
        ("ASDMA", "https://asdma.assam.gov.in/"),
        ("GDACS", "https://gdacs.org/"),
        ("ReliefWeb", "https://reliefweb.int/"),
    ],
    "evidence_status": "Disaster domain recognized; connect the current official bulletin before treating the report as live",
    "confidence": "Low without a named location and current impact bulletin",
    "limitations": "Weather forecasts do not prove inundation, and no casualty figure is shown unless an impact source explicitly reports it.",
}
DOMAIN_REPORT = {
    "status": "Recognized, but a current domain-specific impact record is not attached",
    "needs": [],
    "links": [("GDACS", "https://gdacs.org/"), ("ReliefWeb", "https://reliefweb.int/")],
    "evidence_status": "Domain recognized; source adapter required for live impact figures",
    "confidence": "Low until a current source record is attached",
    "limitations": (
        "The agent will not invent affected people, deaths, injuries, or responders. "
        "Add a location and time range for a source-bounded answer."
    ),
}
# Policy paragraphs of every report: fixed texts, the first around the problem's label.
REPORT_HAPPENING = (
    "The agent has identified this as a ",
    " question. It should combine hazard observations, official warnings, humanitarian reports, and impact assessments "
    "rather than relying on a single severity score.",
)
REPORT_CASUALTY_RULE = (
    "Death and injury figures are shown only when an attached source explicitly reports them. The agent must not infer deaths "
    "from magnitude, rainfall, population, media attention, or a generic risk label."
)
REPORT_WORKFLOW = (
    "Confirm the exact city, district, block, or village; check the newest official bulletin; compare affected-population and "
    "casualty figures across sources; identify verified shelters and responders; and record the last retrieval time before taking action."
)

# The texts of whole answers; {} stands for a figure or a line.
RESOURCE_ANSWER = (
    "### Resource and humanitarian situation\n\n"
    "**Current operational snapshot:** The selected view contains **{} critical request(s)**, **{} open request(s)**, and **{} affected people**.\n\n"
    "**Affected groups:** The dashboard can show locations, need types, people affected, request status, and priority. It does not identify private individuals.\n\n"
    "**Resource action:** The system suggests a dispatch location, resource type, quantity, and source warehouse. These are decision-support recommendations, not autonomous orders.\n\n"
    "{}\n\n**Evidence status:** Prototype request and inventory data.\n\n"
    "**Recommended next step:** Review verified requests first, compare inventory, confirm the destination with a responsible coordinator, and record the completed dispatch."
)
RESOURCE_DEATHS = "**Deaths/casualties:** Not reported in the connected operational dataset."
HAZARD_ANSWER = (
    "### Earthquake situation\n\n"
    "**What is happening:** The live USGS layer currently contains **{} event(s)** in the last seven days at or above M4.5. "
    "The highest-magnitude event in the retrieved set is **{}** near **{}**.\n\n"
    "**Affected people:** Not reported by the connected event feed. Affected population requires a separate exposure or humanitarian source.\n\n"
    "{}\n\n**Evidence status:** Live observational event data; not a forecast.\n\n"
    "**Source:** [USGS Earthquake Catalog](https://earthquake.usgs.gov/fdsnws/event/1/)\n\n"
    "**Recommended next step:** Open the live hazard map, select the event, compare with official local alerts, "
    "and verify casualty figures through local authorities or humanitarian situation reports."
)
HAZARD_DEATHS_ASKED = "**Deaths/casualties:** Not reported by the connected USGS event feed; do not infer deaths from magnitude."
HAZARD_DEATHS = "**Deaths/casualties:** Not provided by this hazard feed."
EVIDENCE_SECTION = (
    "\n\n### Retrieved evidence records\n\n{}\n\nThese records are source-linked observations. They do not override newer official bulletins, "
    "and missing casualty fields remain **Not reported**."
)
NO_EVIDENCE_SECTION = (
    "\n\n### Evidence store status\n\nNo matching saved official evidence record was found for this wording. "
    "Enable **Refresh official India evidence** and ask with a location, event type, and time period."
)
ATTACHED = "\n\nAttached document: {}\n{}"
