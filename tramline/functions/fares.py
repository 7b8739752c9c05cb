"""Vehicle kinds, fares and waits as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tramline.functions import constants as C


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def vehicle_type(route_type, agency_id) -> Column:
    by_agency, by_type = literal_map(C.AGENCY_VEHICLES)[agency_id], literal_map(C.ROUTE_TYPE_VEHICLES)[F.trim(route_type)]
    return F.when(by_agency == "apm", by_agency).otherwise(F.coalesce(by_type, by_agency, F.lit("bus")))


def is_rail(vehicle) -> Column:
    return vehicle.isin(*C.RAIL)


def banded_fare(vehicle, hops) -> Column:
    """Fare of a journey by the hops ridden on one mode with bands; 0 for other modes, or no hops."""
    fare = F.lit(0)
    for kind, tiers in C.BANDED_FARES.items():
        tier = F.lit(tiers[-1][1])
        for most, price in reversed(tiers[:-1]):
            tier = F.when(hops <= most, price).otherwise(tier)
        fare = F.when((vehicle == kind) & (hops > 0), tier).otherwise(fare)
    return fare


def leg_fare(vehicle, agency_id, metres) -> Column:
    """Fare of one boarding; modes with bands cost nothing here, as they are charged once for a journey."""
    by_distance = F.greatest(F.lit(C.MICROBUS_MIN), F.bround(metres / 1000 * C.MICROBUS_PER_KM).cast("int"))
    flat = F.coalesce(literal_map(C.FLAT_FARES)[vehicle], F.lit(C.FLAT_DEFAULT))
    return F.when(vehicle.isin(*C.BANDED_FARES), 0).when(vehicle == "microbus", by_distance).when(agency_id == "GRN", C.GREEN_FARE).otherwise(flat)


def shown_flat_fare(vehicle, agency_id) -> Column:
    """The one figure of a route's fare, null where hops or distance decide it."""
    return F.when(~vehicle.isin(*C.BANDED_FARES, "microbus"), leg_fare(vehicle, agency_id, F.lit(0.0)))


def fare_bands(vehicle) -> Column:
    """Bands of a kind of vehicle, as an array of (up_to_stops, fare_egp); null for kinds without."""
    kind = "array<struct<up_to_stops:int,fare_egp:int>>"
    bands = F.lit(None).cast(kind)
    for name, tiers in C.BANDED_FARES.items():
        rows = F.array(*[F.struct(F.lit(most).cast("int").alias("up_to_stops"), F.lit(price).alias("fare_egp")) for most, price in tiers])
        bands = F.when(vehicle == name, rows.cast(kind)).otherwise(bands)
    return bands


def route_colour(vehicle) -> Column:
    return F.coalesce(literal_map(C.COLOURS)[vehicle], F.lit(C.COLOURS["bus"]))


def price_text(kind, fare) -> Column:
    return F.when(kind == "walk", "Free").otherwise(F.concat(fare.cast("string"), F.lit(" EGP")))


def expected_wait(headway_min, floor=None) -> Column:
    """Seconds: half of the headway up to a cap, but no less than floor."""
    wait = F.least(F.coalesce(F.nullif(headway_min, F.lit(0.0)), F.lit(C.FALLBACK_HEADWAY_MIN)) * 30.0, F.lit(C.WAIT_CAP_S))
    return F.greatest(wait, F.lit(0.0) if floor is None else floor)


def walk_plausible(walk_m, direct_m) -> Column:
    return (walk_m <= C.WALK_CEILING_M) & (walk_m <= F.greatest(direct_m * C.WALK_CIRCUITY, direct_m + C.WALK_SLACK_M))


def walk_offered(walk_m, direct_m) -> Column:
    """Whether walking all the way is offered: short, or a detour that no ride would spare, and plausible."""
    near = direct_m <= C.DIRECT_WALK_M
    return near & F.when(walk_m > 2.2 * direct_m, walk_m <= C.WALK_CEILING_M).otherwise(True) & walk_plausible(walk_m, direct_m)
