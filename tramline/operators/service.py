"""Headways, hours and days of service."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions import constants as C


def headways(frequencies: DataFrame) -> DataFrame:
    """Typical headway in minutes of each route and direction: blocks weigh by how long they last."""
    last = F.col("end_sec") - F.col("start_sec")
    good = frequencies.where((last > 0) & (F.col("headway_secs") > 0))
    return good.groupBy("route_id", "direction_id").agg(F.bround(F.sum(F.col("headway_secs") * last) / F.sum(last) / 60.0, 1).alias("headway_min"))


def service_windows(frequencies: DataFrame) -> DataFrame:
    """Each route's blocks as a union of intervals; those that touch become one. Ends may pass midnight (86400)."""
    blocks = frequencies.where("end_sec > start_sec").select("route_id", "start_sec", "end_sec").distinct()
    order = Window.partitionBy("route_id").orderBy("start_sec", "end_sec")
    before = F.max("end_sec").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start_sec") <= F.col("reach"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = blocks.withColumn("reach", before).withColumn("island", island)
    return marked.groupBy("route_id", "island").agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec")).drop("island")


def service_span(windows: DataFrame) -> DataFrame:
    return windows.agg(F.min("start_sec").alias("earliest"), F.max("end_sec").alias("latest"))


def _open_at(windows: DataFrame, now: int) -> DataFrame:
    holds = lambda t: (F.col("start_sec") - C.GRACE_S <= t) & (F.lit(t) <= F.col("end_sec"))
    return windows.groupBy("route_id").agg(F.max(holds(now) | holds(now + 86400)).alias("open"))


def closed_at(windows: DataFrame, now: int) -> DataFrame:
    """Routes none of whose windows, with a grace before the start, holds now (or now on the day before's clock)."""
    return _open_at(windows, now).where(~F.col("open")).select("route_id")


def inactive_on(trips: DataFrame, calendar: DataFrame, day: str) -> DataFrame:
    """Routes none of whose services runs on a weekday."""
    services = trips.select("route_id", "service_id").distinct()
    running = services.join(calendar.where(F.col("dow") == day), "service_id", "left_semi").select("route_id").distinct()
    return services.select("route_id").distinct().join(running, "route_id", "left_anti")


def runnable(edges: DataFrame, inactive: DataFrame, closed: DataFrame) -> DataFrame:
    """Edges of routes that run on the day and at the hour."""
    return edges.join(inactive.union(closed).distinct(), "route_id", "left_anti")


def network_state(windows: DataFrame, now: int) -> DataFrame:
    """One row: how many routes have hours, how many are closed, and whether that closes the network."""
    counted = _open_at(windows, now).agg(F.count("*").alias("serviced"), F.count_if(~F.col("open")).alias("closed"))
    return counted.withColumn("reason", F.when(F.col("closed") >= F.col("serviced"), "outside_service_hours").otherwise("no_route"))
