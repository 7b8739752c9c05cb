"""Readers and writers on a small feed written to a temporary folder."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tramline.sources import gtfs, maps

FEED = {
    "stops": "﻿stop_id,stop_name,stop_lat,stop_lon\ns1,\"A, first\",30.0,31.0\ns2,B,30.01,31.0\n",
    "routes": "agency_id,route_id,route_short_name,route_long_name,route_type\nCTA,r1,12,A - B,3\nNAT,r2,M1,Line 1,1\nGOV_CTA,g1,9,G,3\n",
    "trips": "route_id,service_id,trip_id,direction_id,shape_id\nr1,wk,t1,,x1\nr1,wk,t2,,x2\nr2,sat,t3,1,\n",
    "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt1,25:10:00,25:10:00,s1,1\nt1,,,s2,2\n",
    "frequencies": "trip_id,start_time,end_time,headway_secs\nt1,06:00:00,24:30:00,600\nt1,bad,07:00:00,600\nt1,08:00:00,07:00:00,600\nt1,06:00:00,07:00:00,0\n",
    "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nwk,1,1,0,0,0,0,0,20260101,20261231\nsat,0,0,0,0,0,1,0,20260101,20261231\n",
    "translations": "table_name,field_name,language,field_value,translation\nstops,stop_name,ar,B,ب\nstops,stop_name,ar,B,باء\nstops,stop_name,en,B,Bee\n",
}


@pytest.fixture
def feed(spark, tmp_path):
    for name, body in FEED.items():
        (tmp_path / f"{name}.txt").write_text(body, encoding="utf-8")
    return gtfs.GtfsFeed(spark, str(tmp_path))


def test_feed(feed):
    assert [tuple(r) for r in feed.stops.orderBy("stop_id").collect()][0] == ("s1", "A, first", 30.0, 31.0)
    assert {r.route_id: (r.vehicle_type, r.reconstructed) for r in feed.routes.collect()} == {"r1": ("bus", False), "r2": ("metro", False), "g1": ("bus", True)}
    assert {r.t for r in feed.stop_times.collect()} == {90600, None}
    assert [(r.start_sec, r.end_sec, r.direction_id) for r in feed.frequencies.collect()] == [(21600, 88200, "")]
    assert {(r.service_id, r.dow) for r in feed.calendar.collect()} == {("wk", "monday"), ("wk", "tuesday"), ("sat", "saturday")}
    assert [r.translation for r in feed.translations.collect()] == ["باء"]
    assert [(r.route_id, r.direction_id, r.shape_id) for r in feed.route_shapes.collect()] == [("r1", "", "x1")]
    assert feed.shape_points.count() == 0 and tuple(feed.validity().first()) == ("20260101", "20261231")


def test_a_required_table_must_be_there(spark, tmp_path):
    with pytest.raises(AnalysisException):
        gtfs.GtfsFeed(spark, str(tmp_path)).stops.count()


def test_write_and_read_again(spark, feed, tmp_path):
    gtfs.write_table(feed.raw("trips"), str(tmp_path / "out"), "trips")
    assert sorted(r.trip_id for r in gtfs.GtfsFeed(spark, str(tmp_path / "out")).trips.collect()) == ["t1", "t2", "t3"]


def test_merge_is_idempotent(spark, feed):
    existing, added = feed.raw("routes"), spark.createDataFrame([("g2", "GOV_CTA")], "route_id string, agency_id string")
    once = gtfs.merged(existing, added, gtfs.reconstructed_rows(F.col("agency_id")))
    twice = gtfs.merged(once, added, gtfs.reconstructed_rows(F.col("agency_id"), F.col("route_id")))
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect())) and {r.route_id for r in once.collect()} == {"r1", "r2", "g2"}


def test_documents(spark, tmp_path):
    line = {"key": "L1", "short_name": "1", "route_type": 1, "agency_id": "NAT", "headway_sec": 300, "dwell_sec": 20, "journey_minutes": 10, "directions": [{"direction_id": 0, "hop_seconds": [60], "stations": [{"osm_node": 1, "name_en": "A", "name_ar": "ا", "lat": 30.0, "lon": 31.0}, {"osm_node": 2, "name_en": "B", "name_ar": "ب", "lat": 30.1, "lon": 31.0}]}]}
    (tmp_path / "rail.json").write_text(json.dumps({"lines": [line]}))
    assert [(r.pos, r.name_en, r.hop_sec) for r in gtfs.rail_stations(spark, str(tmp_path / "rail.json")).orderBy("pos").collect()] == [(0, "A", 60), (1, "B", None)]
    (tmp_path / "osm.json").write_text(json.dumps({"elements": [{"type": "relation", "id": 7, "tags": {"ref": "12"}}, {"type": "node", "id": 8}]}))
    assert [tuple(r) for r in gtfs.osm_relations(spark, str(tmp_path / "osm.json")).collect()] == [(7, "ref", "12")]
    (tmp_path / "cache.json").write_text(json.dumps({"a|b": {"duration_s": 1.5, "distance_m": 20.0, "source": "x"}}))
    assert [tuple(r)[:4] for r in gtfs.edge_cache(spark, str(tmp_path / "cache.json")).collect()] == [("a", "b", 1.5, 20.0)]


def test_caches_and_logs(spark, tmp_path):
    cache = spark.createDataFrame([("k1", 200.0, 160.0), ("k2", 5000.0, 4000.0)], "cache_key string, distance_m double, duration_sec double")
    walks = spark.createDataFrame([(1, "k1", 150.0), (2, "k2", 150.0), (3, "k3", 100.0)], "walk_id long, key string, direct_m double")
    assert {r.walk_id: (r.distance_m, r.source) for r in gtfs.walk_route(walks, cache).collect()} == {1: (200.0, "cache"), 2: (150.0, "straight"), 3: (100.0, "straight")}
    fresh = spark.createDataFrame([("k2", 160.0, 128.0), ("k3", 1.0, 1.0)], cache.schema)
    assert {r.cache_key: r.distance_m for r in gtfs.upserted(cache, fresh, "cache_key").collect()} == {"k1": 200.0, "k2": 160.0, "k3": 1.0}
    assert [r.cache_key for r in gtfs.not_yet_known(fresh, cache, "cache_key").collect()] == ["k3"]
    for _ in range(2):
        gtfs.log_gaps(spark.createDataFrame([("x", [30.12345, 31.0])], "kind string, start array<double>"), str(tmp_path / "log"))
    assert [r.start for r in spark.read.json(str(tmp_path / "log")).collect()] == [[30.123, 31.0]] * 2


def test_map_extract_and_stations(spark, tmp_path):
    member = lambda kind, ref: {"type": kind, "ref": ref, "role": ""}
    node = lambda k, lat, lon, **tags: {"id": k, "lat": lat, "lon": lon, "tags": tags}
    doc = {
        "routes": [
            {"id": 1, "tags": {"type": "route", "route": "monorail"}, "members": [member("n", 11), member("w", 12), member("n", 13), member("n", 14), member("n", 10)]},
            {"id": 2, "tags": {"type": "route", "route": "bus"}, "members": [member("n", 15)]},
            {"id": 3, "tags": {"type": "site", "route": "tram"}, "members": []},
        ],
        "nodes": {"10": node(10, 50.0, 31.0, name="Far"), "11": node(11, 30.0, 31.0, **{"name:en": "A", "name": "x", "name:ar": "أ"}), "13": node(13, None, None), "14": node(14, 30.1234567, 31.0), "15": node(15, 30.0, 31.0), "16": node(16, 30.0, 31.0, railway="station"), "17": node(17, 50.0, 31.0, railway="station")},
    }
    (tmp_path / "extract.json").write_text(json.dumps(doc), encoding="utf-8")
    relations, nodes = maps.read_extract(spark, str(tmp_path / "extract.json"))
    routes, kept = maps.transit_extract(relations, nodes)
    assert [r.id for r in routes.collect()] == [1] and sorted(r.id for r in kept.collect()) == [10, 11, 13, 14, 16]
    stations = maps.ordered_stations(routes, kept).orderBy("pos").collect()
    assert [tuple(r) for r in stations] == [(1, 0, 11, "A", "أ", 30.0, 31.0), (1, 1, 14, "node 14", "", 30.123457, 31.0), (1, 2, 10, "Far", "", 50.0, 31.0)]


def test_documents_beside_a_network(spark, tmp_path):
    (tmp_path / "marks.json").write_text(json.dumps({"documents": {"t": [{"route": "r", "route_num": "5", "fare_egp": 7.5, "corridor": "a – b - c"}]}}), encoding="utf-8")
    rows = maps.landmark_corridors(spark, str(tmp_path / "marks.json")).orderBy("pos").collect()
    assert [(r.tag, r.route, r.fare_egp, r.pos, r.landmark) for r in rows] == [("t", "r", 7.5, 0, "a"), ("t", "r", 7.5, 1, "b"), ("t", "r", 7.5, 2, "c")]
    (tmp_path / "roads.json").write_text(json.dumps({"a": 1, "b": 2, "coordinates": [[31.0, 30.0], [31.1, 30.1]]}) + "\n")
    assert [tuple(r) for r in maps.road_geometry(spark, str(tmp_path / "roads.json")).orderBy("seq").collect()] == [(1, 2, 0, 30.0, 31.0), (1, 2, 1, 30.1, 31.1)]
    (tmp_path / "notes.json").write_text(json.dumps({"station_notes": {"k": {"station_ar": "ا", "note_ar": "ب"}}, "lines": {}}), encoding="utf-8")
    assert [tuple(r) for r in maps.station_notes(spark, str(tmp_path / "notes.json")).collect()] == [("k", "ا", "ب")]
    (tmp_path / "none.json").write_text("{}")
    assert maps.station_notes(spark, str(tmp_path / "none.json")).count() == 0


def test_walks_and_drives_between_places(spark):
    pairs = spark.createDataFrame([(0, 30.0, 31.0, 30.0, 31.01), (1, 30.0, 31.0, 30.01, 31.0), (2, 30.0, 31.0, 30.02, 31.0)], "ordinal int, lat1 double, lon1 double, lat2 double, lon2 double")
    cache = spark.createDataFrame([("30.0,31.0;30.0,31.01", 1200.0, 900.0), ("30.0,31.0;30.01,31.0", 9000.0, 7000.0), ("drive_30.0,31.0;30.02,31.0", 3000.0, 300.0)], "cache_key string, distance_m double, duration_sec double")
    walks = maps.routes_between(pairs, cache).orderBy("ordinal").collect()
    assert [r.source for r in walks] == ["cache", "straight", "straight"] and walks[0].distance_m == 1200.0 and abs(walks[1].duration_sec - walks[1].distance_m / 1.25) < 1e-9
    drives = maps.routes_between(pairs, cache, "drive").orderBy("ordinal").collect()
    assert [r.source for r in drives] == ["straight", "straight", "cache"] and abs(drives[0].duration_sec - drives[0].distance_m / 11) < 1e-9
    places = spark.createDataFrame([(1, 0, 30.0, 31.0), (1, 1, 30.0, 31.01), (1, 2, 30.0, 31.02), (2, 0, 30.0, 31.0)], "table_id int, ordinal int, lat double, lon double")
    table = maps.walking_table(places, cache).collect()
    assert len(table) == 6 and {(r["from"], r["to"]): r.distance_m for r in table}[0, 1] == 1200.0


def test_translations_sheets_reports_and_versions(spark, tmp_path):
    columns = "table_name string, field_name string, language string, field_value string, translation string"
    old = spark.createDataFrame([("stops", "stop_name", "ar", "A", "one")], columns)
    new = spark.createDataFrame([("stops", "stop_name", "A", "two"), ("stops", "stop_name", "B", "three"), ("stops", "stop_name", "B", "three"), ("stops", "stop_name", "C", "")], "table_name string, field_name string, field_value string, translation string")
    assert sorted((r.field_value, r.translation) for r in maps.with_translations(old, new).collect()) == [("A", "one"), ("B", "three")]
    near = spark.createDataFrame([("x", "n1", 0.5), ("x", "n2", 0.9), ("x", "n3", 0.9), ("x", "n4", 0.1)], "landmark string, name string, score double")
    sheet = maps.review_sheet(spark.createDataFrame([("x",), ("y",)], "landmark string"), near)
    assert {r.landmark: (r.candidate_1, r.candidate_2, r.candidate_3) for r in sheet.collect()} == {"x": ("n2", "n3", "n1"), "y": (None, None, None)}
    maps.write_sheet(sheet, str(tmp_path / "sheet"))
    assert spark.read.csv(str(tmp_path / "sheet"), header=True).count() == 2
    for _ in range(2):
        maps.write_report(near, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 4
    copy = maps.write_version(near, str(tmp_path / "table"), "20260101")
    assert spark.read.parquet(copy).count() == 4
    with pytest.raises(AnalysisException):
        maps.write_version(near, str(tmp_path / "table"), "20260101")
