"""Fixed values that the results depend on."""

# The kind of vehicle that each agency runs.
AGENCY_VEHICLES = {
    "CTA": "bus", "CTA_M": "minibus", "LTRA_M": "minibus", "BOX": "microbus", "P_B_8": "microbus", "P_O_14": "microbus", "COOP": "bus",
    "MM": "bus", "GRN": "bus", "PGT": "microbus", "NAT": "metro", "CAI_APM": "apm", "GOV_CTA": "bus", "GOV_CTA_M": "minibus",
}
# Route types of GTFS that stand for rail, and agencies whose routes were reconstructed.
ROUTE_TYPE_VEHICLES = {"0": "tram", "1": "metro", "2": "lrt", "12": "monorail"}
RAIL = ("metro", "monorail", "lrt", "apm", "tram")
RECONSTRUCTED = ("GOV_CTA", "GOV_CTA_M")

# Fares. Tiers are (most hops, fare); the last has no upper end.
BANDED_FARES = {
    "metro": [(8, 10), (15, 12), (22, 15), (None, 20)],
    "monorail": [(5, 20), (10, 40), (15, 55), (None, 80)],
    "lrt": [(3, 10), (7, 15), (None, 20)],
    "apm": [(None, 0)],
}
FLAT_FARES = {"bus": 20, "minibus": 20, "tram": 0}
FLAT_DEFAULT, GREEN_FARE, MICROBUS_MIN, MICROBUS_PER_KM = 20, 25, 10, 1.25

# Speeds (m/s, km/h), times (s) and distances (m).
EARTH_M = 6371000.0
RAIL_CAP, SURFACE_CAP = 28.0, 15.3
RAIL_KMH, SURFACE_KMH, LEAST_HOP_S = 45.0, 20.0, 10.0
SLOW_RATIO, SLOW_LEAST_S = 3.0, 90
MEDIAN_ROUTES, MEDIAN_RATIO, MEDIAN_BLEND = 3, 1.5, 0.5
ROAD_CAP = 20.0
CLUSTER_M, WALK_M, RAIL_WALK_M, WALK_SPEED = 150.0, 500.0, 750.0, 1.25
SNAP_M, DIRECT_WALK_M, WALK_CEILING_M, WALK_CIRCUITY, WALK_SLACK_M = 5000.0, 3000.0, 4500.0, 1.6, 400.0
FALLBACK_HEADWAY_MIN, WAIT_CAP_S, GRACE_S = 20.0, 1200.0, 2700
LIVE_TTL_S, LIVE_KEEP, LIVE_LEAST_DT, LIVE_SPEEDS = 90, 5, 2.0, (1.0, 25.0)
LIVE_DEFAULTS = {"bus": 6.0, "minibus": 7.0, "microbus": 7.0, "metro": 11.0}
FUZZY_LEAST, CONTAINS_CHARS, CONTAINS_RATIO, CANDIDATES = 0.86, 5, 0.45, 12

# Weights of a search by profile: transfer seconds, times walking, seconds for a pound, gated transfer seconds.
PROFILES = {"recommended": (420, 1.6, 90, 180), "regular": (900, 1.5, 0, 450), "cheapest": (240, 1.0, 10000, 120), "fastest": (240, 1.0, 0, 120)}
MICROBUS_TRANSFER_S = 300

# The colour of each kind of vehicle on a map.
COLOURS = {
    "metro": "#6DA4C2", "monorail": "#9C6DC2", "lrt": "#4DA89B", "tram": "#C2A76D", "apm": "#8895A0", "bus": "#E29578",
    "minibus": "#D4A373", "microbus": "#C77DFF",
}
