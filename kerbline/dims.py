"""Dimension tables and constants of the cost model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Multipliers of each protection class for each rider, the pipeline's two scales first.
CLASSES = ("path", "separated", "buffered", "lane", "quiet_street", "service", "sharrow", "moderate_street", "busy_street")
YOUNG_KIDS = dict(zip(CLASSES, (1.0, 1.0, 2.0, 3.0, 1.4, 2.0, 6.0, 8.0, 25.0)))
OLDER_KIDS = dict(zip(CLASSES, (1.0, 1.0, 1.5, 2.0, 1.2, 1.6, 3.5, 4.0, 12.0)))
SOLO = dict(zip(CLASSES, (1.0, 1.0, 1.1, 1.3, 1.1, 1.3, 2.0, 2.5, 6.0)))
#: profile: (multipliers, busy lane, busy buffered lane, km/h, penalty scale, next milder profile)
PROFILES = {
    "young_kids": (YOUNG_KIDS, 10.0, 6.0, 8.0, 1.0, "older_kids"),
    "older_kids": (OLDER_KIDS, 5.0, 3.0, 11.0, 0.6, "solo"),
    "solo": (SOLO, 2.5, 1.8, 16.0, 0.3, None),
}

KID_SAFE_MAX = 2.0
CRASH_WEIGHT, CRASH_CAP, CORRIDOR_FACTOR = 0.6, 2.5, 1.5
CRASH_RADIUS_M, CORRIDOR_RADIUS_M, FACILITY_RADIUS_M, FACILITY_MAX_ANGLE, STRESS_RADIUS_M = 25.0, 15.0, 18.0, 30.0, 15.0
CROSSING_M, SIGNALISED_CROSSING_M = 250.0, 30.0
W_SEVERANCE, W_ACCESS, W_CRASH, W_COVERAGE = 0.40, 0.30, 0.15, 0.15
ACCESS_BUDGET_M, CLAMP = 2500.0, 4.0
DESTINATIONS = ("school", "playground", "library")
CANDIDATE_MIN_M, CANDIDATE_MAX_M, CROSSING_MIN_M, SPOT_FIX_MAX_M, REAL_ISLAND_M = 25.0, 1500.0, 5.0, 60.0, 200.0
UNIT_COST = {"separated": 900.0, "spot_fix": 150000.0}
SNAP_NODE_M, SNAP_SKETCHY_M, SNAP_CONSTRUCTION_M, SNAP_WHAT_IF_M = 500.0, 30.0, 40.0, 30.0
SKETCHY, CONSTRUCTION, LOOP_REUSE, AVOID_FLOOR = 5.0, 4.0, 4.0, 30.0
HILL_M_PER_M, STEEP_GRADE, STEEP = 12.0, 0.04, 2.0
WALK_FACTOR, DISMOUNT, MOUNT, WALK_KMH = 2.4, 90.0, 40.0, 4.0
HOTSPOT_FACTOR, CAUTION_MIN_M, CROSSING_FLAG_M = 1.25, 15.0, 100.0
TILE_LON0, TILE_LAT0, TILE_DEG = -73.6, 41.1, 0.02
HEAT_LON, HEAT_LAT, COVERAGE_DEG = 0.0012, 0.0009, 0.005
PROTECTED = ("path", "separated")
PROTECTED_OR_BUFFERED = ("path", "separated", "buffered")
QUIET = ("quiet_street", "service")
CAUTION = ("sharrow", "moderate_street", "busy_street")

# Words of road tags.
ROADS_BUSY = ("primary", "primary_link", "secondary", "secondary_link", "trunk", "trunk_link")
ROADS_MODERATE = ("tertiary", "tertiary_link")
PATH_TAGS = ("cycleway", "path", "footway", "pedestrian", "track", "bridleway", "steps")

# Facility names of each inventory and the class they stand for.
CROSSWALKS = {
    "cambridge": {
        "Grade-Separated Bike Lane": "separated", "Separated Bike Lane": "separated", "Separated Bike Lane with Contra-flow": "separated", "Bike Path/Multi-Use Path": "path", "Buffered Bike Lane": "buffered",
        "Bike Lane": "lane", "Contra-flow": "lane", "Bus/Bike Lane": "lane", "Shared Street": "quiet_street", "Shared Lane Pavement Marking": "sharrow",
    },
    "newton": {"Bicycle Lane": "lane", "Separated Bicycle Lane": "separated", "Contraflow Bicycle Lane": "lane", "Bike Boulevard": "quiet_street", "Shared Use Path": "path"},
    "everett": {"Cycle Track": "separated", "Raised Bike Lane": "separated", "Unprotected Bike Lane": "lane", "Bus-Bike Lane": "lane", "Trail": "path"},
    "natick": {"Conventional Bike Lane": "lane", "Buffered Bike Lane": "buffered", "Separated Bike Lane": "separated"},
    "salem": {"Conventional Bike Lane": "lane", "Protected Bike Lane": "separated", "Shared Use Path": "path"},
    "mapc": {"0": "separated", "2": "lane", "8": "path", "11": "path"},
    "boston": {
        "SBL": "separated", "SBLBL": "separated", "SBLSL": "separated", "BFBL": "buffered", "BFBLSL": "buffered", "BLBFBL": "buffered", "BL": "lane", "BLSL": "lane", "CFBL": "lane", "BL-PEAKBUS": "lane",
        "SLM": "sharrow", "SLMTC": "sharrow", "SLMSUP": "sharrow", "SUP": "path", "SUPM": "path", "SUPN": "path",
    },
}

#: Overlays in the order in which they are folded onto the base class.
OVERLAY_ORDER = ("massdot", "mapc", "cambridge", "boston", "newton", "everett", "natick", "salem")


def class_dim(spark: SparkSession) -> DataFrame:
    """cls, kids, older, solo, place: nine rows."""
    return spark.createDataFrame([(c, YOUNG_KIDS[c], OLDER_KIDS[c], SOLO[c], i) for i, c in enumerate(CLASSES)], "cls string, kids double, older double, solo double, place int")


def profile_dim(spark: SparkSession) -> DataFrame:
    """profile, cls, mult, busy_mult, pace_kmh, penalty_scale: 27 rows. busy_mult is mult where no override applies."""
    rows = []
    for name, (mult, lane, buffered, pace, scale, _) in PROFILES.items():
        for c in CLASSES:
            rows.append((name, c, mult[c], lane if c == "lane" else buffered if c == "buffered" else mult[c], pace, scale))
    return spark.createDataFrame(rows, "profile string, cls string, mult double, busy_mult double, pace_kmh double, penalty_scale double")


def crosswalk_dim(spark: SparkSession) -> DataFrame:
    """source, facility, cls."""
    return spark.createDataFrame([(s, f, c) for s, m in CROSSWALKS.items() for f, c in m.items()], "source string, facility string, cls string")
