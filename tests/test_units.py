"""Known facts about fares, walks, texts, times, shapes, corridors and live vehicles on literal rows."""

import difflib
import math
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tramline.functions import constants as C
from tramline.functions import fares, geo, schedule, text
from tramline.operators import audits, edges, matching, patterns, reconstruct, search, service, shapes, spatial
from tramline.streaming import live


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_banded_fares(spark):
    rows = [("metro", 5, 10), ("metro", 8, 10), ("metro", 9, 12), ("metro", 23, 20), ("monorail", 5, 20), ("monorail", 21, 80), ("monorail", 0, 0), ("lrt", 3, 10), ("lrt", 8, 20), ("apm", 3, 0), ("bus", 3, 0)]
    assert all(a == b for a, b in values(spark, rows, "v string, hops int, want int", fares.banded_fare(F.col("v"), F.col("hops")), "want"))


def test_leg_fares(spark):
    rows = [("microbus", "BOX", 1000.0, 10), ("microbus", "BOX", 12000.0, 15), ("microbus", "BOX", 10000.0, 12), ("bus", "GRN", 1.0, 25), ("bus", "CTA", 1.0, 20), ("metro", "NAT", 1.0, 0)]
    assert all(a == b for a, b in values(spark, rows, "v string, a string, m double, want int", fares.leg_fare(F.col("v"), F.col("a"), F.col("m")), "want"))


def test_vehicle_types(spark):
    rows = [("1", "CTA", "metro"), ("3", "CTA_M", "minibus"), ("1", "CAI_APM", "apm"), (" 12 ", None, "monorail"), (None, None, "bus"), ("3", "new", "bus")]
    assert all(a == b for a, b in values(spark, rows, "t string, a string, want string", fares.vehicle_type(F.col("t"), F.col("a")), "want"))


def test_plausible_walks(spark):
    rows = [(9285.4, 3367.0, False), (4100.0, 3367.0, True), (9000.0, 9000.0, False), (4400.0, 4300.0, True), (300.0, 120.0, True), (480.0, 100.0, True), (900.0, 150.0, False)]
    assert all(a == b for a, b in values(spark, rows, "w double, d double, want boolean", fares.walk_plausible(F.col("w"), F.col("d")), "want"))


def test_waits(spark):
    rows = [(None, 600.0), (180.0, 1200.0), (10.0, 300.0), (0.0, 600.0)]
    assert all(a == b for a, b in values(spark, rows, "h double, want double", fares.expected_wait(F.col("h")), "want"))
    assert values(spark, [(10.0,)], "h double", fares.expected_wait(F.col("h"), F.lit(420.0))) == [(420.0,)]


def test_times(spark):
    rows = [("25:10:00", 90600), ("06:00:00", 21600), ("", None), ("6:0", None), ("x:1:2", None), (None, None)]
    assert all(a == b for a, b in values(spark, rows, "t string, want int", schedule.gtfs_seconds(F.col("t")), "want"))
    assert values(spark, [(90600,)], "s int", schedule.gtfs_text(F.col("s"))) == [("25:10:00",)]
    assert values(spark, [(64.5,), (12.0,), (None,)], "m double", schedule.minutes_text(F.col("m"))) == [("1h04m",), ("12m",), ("-",)]


def test_a_degree_of_latitude(spark):
    (m,) = values(spark, [(30.0,)], "x double", geo.haversine(F.col("x"), F.lit(31.0), F.col("x") + 1, F.lit(31.0)))[0]
    assert abs(m - 111195) < 500


def test_names(spark):
    rows = [("شارع الثورة", "ثوره"), ("الشارع الثورة", "ثوره"), ("ش ميدان التحرير", "تحرير"), ("أحمد (عرابي)", "احمدعرابي"), ("", ""), (None, "")]
    assert all(a == b for a, b in values(spark, rows, "n string, want string", text.normalise(F.col("n")), "want"))
    rows = [("Mini Bus 12!", "minibus 12"), ("مينى باص", "مينيباص"), ("إلى", "الي"), (None, "")]
    assert all(a == b for a, b in values(spark, rows, "n string, want string", text.search_text(F.col("n")), "want"))
    assert values(spark, [("A (B) C",)], "n string", text.variants(F.col("n")), text.in_parentheses(F.col("n"))) == [(["A (B) C", "A C"], ["B"])]
    assert values(spark, [("M5 12",), ("x",)], "n string", text.route_number(F.col("n"))) == [("512",), (None,)]
    assert values(spark, [("a – b-c",)], "n string", text.corridor_stops(F.col("n"))) == [(["a", "b", "c"],)]
    assert values(spark, [("محور",), ("ثوره",)], "n string", text.is_road(F.col("n"))) == [(True,), (False,)]


def test_matching_cascade(spark):
    stops = spark.createDataFrame([(1, "عتبة (الجراج)", "Attaba"), (2, "طريق العروبة (شارع الثورة)", "Orouba"), (3, "Ramses Square", None)], "stop_id long, name_ar string, name_en string")
    marks = spark.createDataFrame([("Attaba",), ("عتبة",), ("الدائري",), ("Ramses Sqare",), ("Square",), ("nowhere at all",)], "landmark string")
    found = {r.landmark: r.how for r in matching.cascade(marks, stops).collect()}
    assert found == {"Attaba": "exact", "عتبة": "exact", "الدائري": "road", "Ramses Sqare": "fuzzy", "Square": "contains", "nowhere at all": "unresolved"}


def test_fuzzy_is_the_ratio_of_the_standard_library(spark):
    names = ["kitten", "sitting", "mitten", "written", "kitchen"]
    table = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "stop_id long, key string")
    got = {(r.landmark, r.name): r.score for r in matching.fuzzy(table.select(F.col("key").alias("landmark"), "key"), table, 0.6, 10).collect()}
    want = {(a, b): difflib.SequenceMatcher(None, a, b).ratio() for a in names for b in names}
    assert got == {k: v for k, v in want.items() if v >= 0.6}


def mini(spark):
    stops = spark.createDataFrame([(1, "A", 30.000, 31.0), (2, "A", 30.0009, 31.0), (3, "B", 30.01, 31.0), (4, "C", 30.02, 31.0), (5, "D", 30.03, 31.0), (6, "E", 30.0036, 31.0)], "stop_id long, stop_name string, lat double, lon double")
    routes = spark.createDataFrame([(k, "bus", "CTA", False, k == 4) for k in (1, 2, 3, 4)], "route_id long, vehicle_type string, agency_id string, rail boolean, reconstructed boolean")
    trips = spark.createDataFrame([(k, k, 0) for k in (1, 2, 3, 4)], "trip_id long, route_id long, direction_id int")
    times = []
    for trip, first in ((1, 100), (2, 110), (3, 900), (4, 900)):
        times += [(trip, 1, 1, 0), (trip, 2, 3, first), (trip, 3, 3, first + 5), (trip, 4, 4, first + 120), (trip, 5, 5, first + 130)]
    return stops, routes, trips, spark.createDataFrame(times, "trip_id long, seq int, stop_id long, t long")


def test_edge_times(spark):
    stops, routes, trips, times = mini(spark)
    hops = edges.guarded(edges.hops(times, trips, routes, stops))
    rows = {(r.trip_id, r.u): r for r in edges.riding_times(hops).collect()}
    assert len(rows) == 12  # the repeated stop gives no hop
    assert rows[1, 4].timed is None and abs(rows[1, 4].sec - rows[1, 4].dist_m / (20 / 3.6)) < 1e-9  # too fast: a usual speed
    assert rows[3, 1].slow is False or rows[3, 1].sec < 900
    blended = {(r.route_id, r.u): r for r in edges.blended(edges.edge_means(edges.riding_times(hops))).collect()}
    assert blended[4, 1].blended == blended[3, 1].blended  # reconstructed routes don't vote but are corrected
    votes = sorted(blended[k, 1].sec for k in (1, 2))
    assert votes[0] >= 100


def test_service(spark):
    blocks = spark.createDataFrame([(1, 0, 21600, 36000, 600), (1, 0, 36000, 50000, 1200), (1, 0, 60000, 70000, 600), (2, 0, 82800, 90000, 600), (2, 0, 5, 5, 600)], "route_id long, direction_id int, start_sec long, end_sec long, headway_secs long")
    windows = service.service_windows(blocks)
    assert sorted(map(tuple, windows.collect())) == [(1, 21600, 50000), (1, 60000, 70000), (2, 82800, 90000)]
    closed = lambda now: {r.route_id for r in service.closed_at(windows, now).collect()}
    assert closed(7200) == {1, 2} and closed(19800) == {2} and closed(1800) == {1}  # grace before; after midnight counts
    assert service.headways(blocks.where("route_id = 2")).first().headway_min == 10.0


def test_clusters_links_and_nearest(spark):
    stops, *_ = mini(spark)
    assert dict(map(tuple, spatial.cluster_same_names(stops).collect()))[2] == 1
    links = {(r.u, r.v) for r in spatial.walk_links(stops).collect()}
    assert (1, 2) in links and (2, 1) in links and (1, 6) in links and (1, 3) not in links
    points = spark.createDataFrame([(1, 30.0, 31.0), (2, 40.0, 31.0)], "point_id long, lat double, lon double")
    assert [(r.point_id, r.rank, r.stop_id) for r in spatial.nearest_stops(points, stops, 2).orderBy("rank").collect()] == [(1, 1, 1), (1, 2, 2)]
    assert dict(map(tuple, reconstruct.grid_clusters(stops, 150.0).collect())) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}


def test_water_crossing(spark):
    paths = spark.createDataFrame([(1, 30.0, 31.0, 30.0, 31.2), (2, 30.0, 31.0, 30.0, 31.05)], "path_id long, lat1 double, lon1 double, lat2 double, lon2 double")
    bank = spark.createDataFrame([(1, 29.9, 31.1, 30.1, 31.1)], "edge_id long, a_lat double, a_lon double, b_lat double, b_lon double")
    bridges = lambda rows: spark.createDataFrame(rows, "lat double, lon double")
    assert [r.path_id for r in spatial.crossings(paths, bank, bridges([(30.5, 31.5)])).collect()] == [1]
    assert spatial.crossings(paths, bank, bridges([(30.0, 31.1)])).count() == 0
    assert spatial.crossings(paths, bank, bridges([])).count() == 0


def test_search_and_itinerary(spark):
    stops, routes, trips, times = mini(spark)
    all_edges = edges.edge_means(edges.riding_times(edges.guarded(edges.hops(times, trips, routes, stops))))
    heads = spark.createDataFrame([(1, 0, 4.0)], "route_id long, direction_id int, headway_min double")
    start = lambda stop: spark.createDataFrame([(0, stop, 0.0)], "od_id long, stop_id long, cost double")
    walks = spatial.walk_links(stops)
    labels = search.search(all_edges, search.boardings(all_edges, routes, heads, "fastest"), walks, start(1))
    answers = search.traced(search.best_by_stop(labels), labels)
    best = {r.stop_id: r for r in answers.collect()}
    ride = sum(r.sec for r in all_edges.where("route_id = 1").collect())
    assert abs(best[5].cost - (120.0 + ride)) < 1e-6 and [(s.kind, s.route_id, s.start, s.end, s.hops) for s in best[5].path] == [("ride", 1, 1, 5, 3)]
    told = search.itineraries(answers.where("stop_id = 5"), routes, heads).first()
    assert (told.boardings, told.fare) == (1, 20) and told.minutes == -(-(120 + ride) // 60)
    cheap = search.best_by_stop(search.search(all_edges, search.boardings(all_edges, routes, heads, "cheapest"), walks, start(1))).where("stop_id = 5").first()
    assert cheap.cost >= best[5].cost
    # Nothing leaves stop 2 but walks: to stop 1 and on by its lines, or to stop 6.
    on_foot = search.search(all_edges, search.boardings(all_edges, routes, heads, "fastest"), walks, start(2))
    path = search.traced(search.best_by_stop(on_foot).where("stop_id = 5"), on_foot).first().path
    assert [(s.kind, s.start, s.end) for s in path] == [("walk", 2, 1), ("ride", 1, 5)]


def random_network(seed: int, stops: int = 14, runs: int = 7):
    import random

    r = random.Random(seed)
    edge = {}
    for k in range(runs):
        for _ in range(2):
            line = r.sample(range(stops), 4)
            edge |= {(u, v, k // 2, k % 2): (float(r.randint(20, 200)), float(r.randint(100, 900))) for u, v in zip(line, line[1:])}
    boards = {(k // 2, k % 2): (float(r.randint(10, 60)), float(r.randint(60, 200)), (0, 1, 2)[k // 2 % 3], (0.0, 300.0, 120.0)[k // 2 % 3], 0.1 * (k // 2 % 2)) for k in range(runs)}
    walks = {tuple(r.sample(range(stops), 2)): float(r.randint(100, 400)) for _ in range(5)}
    return edge, boards, walks


def dijkstra(edge, boards, walks, starts, times=1.5):
    """Least costs of (stop, run, mask, ridden), all of them, without any pruning."""
    import heapq

    best, queue = {}, [(c, s, (), 0, False) for s, c in starts.items()]
    while queue:
        cost, stop, run, mask, ridden = heapq.heappop(queue)
        if (stop, run, mask, ridden) in best:
            continue
        best[stop, run, mask, ridden] = cost
        for (u, v, *own), (sec, metres) in edge.items():
            own = tuple(own)
            if u == stop and own in boards:
                first, later, bit, money, per_metre = boards[own]
                if own == run:
                    heapq.heappush(queue, (cost + sec + metres * per_metre, v, run, mask, True))
                heapq.heappush(queue, (cost + sec + (later if ridden else first) + (0.0 if bit & mask else money), v, own, mask | bit, True))
        for (u, v), sec in walks.items():
            if u == stop:
                heapq.heappush(queue, (cost + sec * times, v, (), mask, ridden))
    return best


def network_frames(spark, edge, boards, walks):
    return (
        spark.createDataFrame([(*k, *x) for k, x in edge.items()], "u long, v long, route_id long, direction_id int, sec double, dist_m double"),
        spark.createDataFrame([(*k, *x) for k, x in boards.items()], "route_id long, direction_id int, first double, later double, bit int, money double, per_metre double"),
        spark.createDataFrame([(*k, x) for k, x in walks.items()], "u long, v long, sec double"),
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_search_finds_what_an_exhaustive_one_does(spark, seed):
    edge, boards, walks = random_network(seed)
    want = {}
    for (stop, *_), cost in dijkstra(edge, boards, walks, {0: 0.0, 3: 50.0}).items():
        want[stop] = min(cost, want.get(stop, cost))
    frames = network_frames(spark, edge, boards, walks)
    labels = search.search(*frames, spark.createDataFrame([(0, 0, 0.0), (0, 3, 50.0)], "od_id long, stop_id long, cost double"), walk_times=1.5)
    answers = search.traced(search.best_by_stop(labels), labels).collect()
    assert {r.stop_id: pytest.approx(r.cost) for r in answers} == want
    for r in answers:  # a path costs what its label says
        at, mask, ridden = (r.path[0].start if r.path else r.stop_id), 0, False
        costs = {50.0 if at == 3 else 0.0}  # as many as there are first hops that the leg may have begun with
        for step in r.path:
            assert step.start == at
            at = step.end
            if step.kind == "walk":
                costs = {c + 1.5 * walks[step.start, step.end] for c in costs}
                continue
            first, later, bit, money, per_metre = boards[step.route_id, step.direction_id]
            begun = [m for (u, v, *own), (_, m) in edge.items() if u == step.start and tuple(own) == (step.route_id, step.direction_id)]
            paid = 0.0 if bit & mask else money
            costs = {c + (later if ridden else first) + paid + step.sec + per_metre * (step.metres - m) for m in begun for c in costs}
            mask, ridden = mask | bit, True
        assert at == r.stop_id and min(abs(c - r.cost) for c in costs) < 1e-6


def test_a_bound_gives_the_same_answers_with_fewer_labels(spark):
    edge, boards, walks = random_network(3, stops=40, runs=12)
    frames = network_frames(spark, edge, boards, walks)
    stops = spark.createDataFrame([(k, 30.0, 31.0 + 0.01 * k) for k in range(40)], "stop_id long, lat double, lon double")
    start = spark.createDataFrame([(0, 0, 0.0), (1, 4, 0.0)], "od_id long, stop_id long, cost double")
    free, bound = [], []
    everything = search.search(*frames, start, counted=free.append)
    best = search.best_by_stop(everything).where("cost > 0").groupBy("od_id").agg(F.min_by("stop_id", "cost").alias("near"), F.max_by("stop_id", "cost").alias("far")).collect()
    exits = spark.createDataFrame([(r.od_id, s, c) for r in best for s, c in ((r.near, 400.0), (r.far, 0.0))], "od_id long, stop_id long, exit_cost double")
    held = search.search(*frames, start, bound=search.Bound(exits, stops, fastest=1e9), counted=bound.append)
    answer = lambda labels: sorted(tuple(r) for r in search.best_by_stop(labels.where(F.col("mask") >= search.RIDDEN)).join(exits, ["od_id", "stop_id"]).groupBy("od_id").agg(F.round(F.min(F.col("cost") + F.col("exit_cost")), 6)).collect())
    assert answer(held) == answer(everything) and len(answer(held)) == 2
    assert sum(bound) < sum(free)


def test_bounded_reach(spark):
    frame = spark.createDataFrame
    chain = frame([(k, k + 1, 10.0) for k in range(20)], "u long, v long, dist_m double")
    reached = search.bounded_reach(chain, frame([(0, 0)], "source_id long, stop_id long"), 155.0)
    assert sorted((r.stop_id, r.metres) for r in reached.collect()) == [(k, 10.0 * k) for k in range(16)]


def test_shapes(spark):
    rows = [("s", k, 30.0 + 0.01 * k, 31.0) for k in range(6)]
    line = spark.createDataFrame(rows, "shape_id string, seq int, lat double, lon double")
    measured = shapes.measured(line)
    assert abs(measured.agg(F.max("along")).first()[0] - 5 * 1111.95) < 1
    out = [("u", 0, 30.0, 31.0), ("u", 1, 30.02, 31.0), ("u", 2, 30.04, 31.0), ("u", 3, 30.02, 31.0), ("u", 4, 30.001, 31.0), ("v", 0, 30.0, 31.0), ("v", 1, 30.01, 31.0)]
    assert [r.seq_id for r in shapes.spurs(spark.createDataFrame(out, "seq_id string, pos int, lat double, lon double")).collect()] == ["u"]
    spike = [(30.0, 31.0), (30.02, 31.0), (30.0001, 31.0), (30.0, 31.01), (30.0, 31.02)]
    kept = spark.createDataFrame([(spike,)], "p array<struct<lat:double,lon:double>>").select(shapes.without_needles(F.col("p")).alias("p")).first().p
    assert [tuple(x) for x in kept] == [spike[0], *spike[2:]]
    near = spark.createDataFrame([(1, 30.025, 31.0005), (2, 30.005, 31.0005), (3, 30.025, 31.01)], "stop_id long, lat double, lon double")
    assert [r.stop_id for r in shapes.stops_along(line, near).orderBy("n").collect()] == [2, 1]
    cut = shapes.segment(line, spark.createDataFrame([(1, "s", 4, 2)], "query_id long, shape_id string, from_seq int, to_seq int"))
    assert [round(r.lat, 2) for r in cut.orderBy("n").collect()] == [30.04, 30.03, 30.02]


def test_first_heads_are_those_of_a_walk_in_order(spark):
    import random

    r = random.Random(3)
    rows = [(k, f"n{k % 3}", 30.0 + r.random() * 0.01, 31.0 + r.random() * 0.01) for k in range(120)] + [(200 + k, "chain", 30.1, 31.0 + 0.0008 * k) for k in range(25)]
    table = spark.createDataFrame(rows, "stop_id long, stop_name string, lat double, lon double")

    def brute(metres, by_name):
        heads, out = [], {}
        for k, name, lat, lon in rows:
            out[k] = next((h for h, n, a, b in heads if (n == name or not by_name) and spatial._metres(a, b, lat, lon) <= metres), None)
            if out[k] is None:
                heads.append((k, name, lat, lon))
                out[k] = k
        return out

    assert dict(map(tuple, spatial.cluster_same_names(table, 150.0).collect())) == brute(150.0, True)
    assert dict(map(tuple, reconstruct.grid_clusters(table, 100.0).collect())) == brute(100.0, False)
    merged = spatial.canonical(spark.createDataFrame([(1, 5), (2, 6)], "trip_id long, stop_id long"), spark.createDataFrame([(5, 4), (6, 6)], "stop_id long, canonical_id long"), "stop_id")
    assert sorted((x.trip_id, x.stop_id) for x in merged.collect()) == [(1, 4), (2, 6)]


def test_a_long_chain_in_order_takes_few_rounds(spark):
    chain = spark.createDataFrame([(k, 30.0, 31.0 + 0.0004 * k) for k in range(10_000)], "stop_id long, lat double, lon double")
    near, rounds = spatial.near_pairs(spatial._side(chain, 1), spatial._side(chain, 2), 60.0).where("id1 < id2"), []
    got = dict(map(tuple, spatial.first_heads(chain, near, lambda: rounds.append(1)).collect()))
    assert len(rounds) < 10 and got == {k: k - k % 2 for k in range(10_000)}
    # Tiles with too many pairs stay small: the same, but slower.
    short = chain.where("stop_id < 60")
    most, spatial.TILE_PAIRS = spatial.TILE_PAIRS, 5
    try:
        assert dict(map(tuple, spatial.first_heads(short, near.where("id2 < 60")).collect())) == {k: k - k % 2 for k in range(60)}
    finally:
        spatial.TILE_PAIRS = most


def test_near_pairs_hold_anywhere_on_earth(spark):
    import random

    r, rows = random.Random(8), []
    for lat, lon in ((70.0, 20.0), (-84.9, 3.0), (89.9, 0.0), (0.0, 180.0), (65.0, -180.0), (30.0, 31.0)):
        for _ in range(25):
            spread = 0.01 / max(0.002, math.cos(math.radians(lat)))
            a, b = lat + r.uniform(-0.01, 0.01), (lon + r.uniform(-spread, spread) + 180) % 360 - 180
            rows.append((len(rows), a, b))
    table = spark.createDataFrame(rows, "stop_id long, lat double, lon double")
    got = {(x.id1, x.id2) for x in spatial.near_pairs(spatial._side(table, 1), spatial._side(table, 2), 500.0).collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if spatial._metres(*a[1:], *b[1:]) <= 500.0}
    nearest = {(x.point_id, x.rank): x.stop_id for x in spatial.nearest_stops(table.withColumnRenamed("stop_id", "point_id"), table, 2, 800.0).collect()}
    want = {}
    for a in rows:
        near = sorted((d, b[0]) for b in rows if (d := spatial._metres(*a[1:], *b[1:])) <= 800.0)[:2]
        want |= {(a[0], n + 1): s for n, (_, s) in enumerate(near)}
    assert nearest == want


def test_nearest_stops_are_those_of_all_distances(spark):
    import random

    r = random.Random(4)
    stops = [(k, 30.0 + r.random() * 0.05, 31.0 + r.random() * 0.05) for k in range(150)] + [(500, 30.0, 31.0), (501, 30.0, 31.0)]
    points = [(k, 29.98 + r.random() * 0.1, 30.98 + r.random() * 0.1) for k in range(40)] + [(90, 30.0, 31.0), (91, 45.0, 31.0), (92, -33.0, -70.0)]
    frame = spark.createDataFrame(stops, "stop_id long, lat double, lon double"), spark.createDataFrame(points, "point_id long, lat double, lon double")
    got = {(x.point_id, x.rank): x.stop_id for x in spatial.nearest_stops(frame[1], frame[0], 4, 3000.0).collect()}
    want = {}
    for k, lat, lon in points:
        near = sorted((spatial._metres(lat, lon, a, b), s) for s, a, b in stops)
        want |= {(k, n + 1): s for n, (d, s) in enumerate(near[:4]) if d <= 3000}
    assert got == want
    anywhere = {x.point_id: x.stop_id for x in spatial.nearest_anywhere(frame[1], frame[0]).collect()}
    assert anywhere == {k: min((spatial._metres(lat, lon, a, b), s) for s, a, b in stops)[1] for k, lat, lon in points}


def test_snapping_prefers_connected_dry_and_really_near_stops(spark):
    stops = spark.createDataFrame([(1, 30.0, 31.0), (2, 30.0, 31.002), (3, 30.0, 31.004), (4, 30.0, 31.006), (9, 31.0, 31.0)], "stop_id long, lat double, lon double")
    points = spark.createDataFrame([(1, 30.0, 31.001), (2, 31.0, 31.001), (3, 33.0, 31.0)], "point_id long, lat double, lon double")
    degrees = spark.createDataFrame([(1, 1), (2, 5), (3, 2), (4, 3), (9, 1)], "stop_id long, degree long")
    of = lambda df: [(x.point_id, x.stop_id) for x in df.orderBy("point_id", "rank").collect()]
    pool = spatial.snap_candidates(points, stops, degrees)
    assert of(pool) == [(1, 2), (1, 3), (1, 4), (2, 9)]  # the last has no stop with two edges: its nearest stays
    alias = spark.createDataFrame([(2, 3)], "stop_id long, canonical_id long")
    assert of(spatial.snap_candidates(points, stops, degrees, alias)) == [(1, 3), (1, 4), (2, 9)]
    bank = spark.createDataFrame([(1, 29.99, 31.003, 30.01, 31.003)], "edge_id long, a_lat double, a_lon double, b_lat double, b_lon double")
    far = spark.createDataFrame([(30.5, 31.0)], "lat double, lon double")
    assert of(spatial.snap_candidates(points, stops, degrees, None, bank, far)) == [(1, 2), (2, 9)]
    wet = spark.createDataFrame([(1, 29.99, 31.0015, 30.01, 31.0015)], bank.schema)
    assert of(spatial.snap_candidates(points, stops, degrees, None, wet, far)) == [(1, 2), (1, 3), (1, 4), (2, 9)]  # all are across
    walked = spark.createDataFrame([(1, 2, 900.0), (1, 4, 700.0)], "point_id long, stop_id long, distance_m double")
    ranked = [(x.point_id, x.rank, x.stop_id) for x in spatial.reranked(pool, walked, 2).orderBy("point_id", "rank").collect()]
    assert ranked == [(1, 1, 4), (1, 2, 2), (2, 1, 9)]


def test_bridges_gather_crossings_in_order(spark):
    rows = [("a", 1, 30.0, 31.0), ("a", 5, 30.002, 31.0), ("b", 1, 30.0035, 31.0), ("b", 2, 30.0, 31.0), ("c", 1, 30.1, 31.0)]
    found, want = spatial.bridges(spark.createDataFrame(rows, "shape_id string, seq int, lat double, lon double")), []
    for lat, n in ((30.0, 2), (30.002, 1), (30.0035, 1), (30.1, 1)):
        own = next((c for c in want if spatial._metres(c[0], 31.0, lat, 31.0) <= 300), None)
        if own:
            own[:] = [(own[0] * own[1] + lat * n) / (own[1] + n), own[1] + n]
        else:
            want.append([lat, n])
    assert sorted((round(x.lat, 6), x.crossings) for x in found.collect()) == sorted((round(a, 6), n) for a, n in want)


def test_fares_colours_and_modes_shown(spark):
    rows = spark.createDataFrame([("metro",), ("bus",), ("apm",), ("new",)], "v string")
    got = {x.v: x for x in rows.select("v", fares.fare_bands(F.col("v")).alias("b"), fares.route_colour(F.col("v")).alias("c"), fares.price_text(F.lit("walk"), F.lit(0)).alias("w"), fares.price_text(F.lit("x"), F.lit(20)).alias("p")).collect()}
    assert [tuple(x) for x in got["metro"].b] == [(8, 10), (15, 12), (22, 15), (None, 20)] and got["bus"].b is None and [tuple(x) for x in got["apm"].b] == [(None, 0)]
    assert got["new"].c == got["bus"].c != got["metro"].c and (got["bus"].w, got["bus"].p) == ("Free", "20 EGP")
    modes = spark.createDataFrame([("Metro, lrt,,metro",), ("boat,bus,tram",), ("",), (None,)], "m string")
    assert values(spark, [tuple(x) for x in modes.collect()], "m string", *text.wanted_modes(F.col("m"))) == [(["metro", "lrt"], []), (["tram"], ["boat", "bus"]), (None, None), (None, None)]
    assert values(spark, [(30.0, 31.123456, 30.5, 31.1)], "a double, b double, c double, d double", text.place_key(*map(F.col, "abcd"))) == [("30.0,31.12346;30.5,31.1",)]


def test_segments_start_and_end_at_their_places(spark):
    points = shapes.measured(spark.createDataFrame([("s", k, 30.0 + 0.01 * k, 31.0) for k in range(6)] + [("t", 0, 30.0, 31.0), ("t", 1, 30.0, 31.5)], "shape_id string, seq int, lat double, lon double"))
    rows = [(1, "s", 30.01, 31.0, 30.0301, 31.001), (2, "s", 30.0302, 31.0, 30.01, 31.00001), (3, "s", 30.01, 31.1, 30.03, 31.0), (4, "s", 30.01, 31.0, 30.0101, 31.0), (5, "none", 30.0, 31.0, 30.1, 31.0)]
    got = shapes.segment_between(spark.createDataFrame(rows, "query_id long, shape_id string, lat1 double, lon1 double, lat2 double, lon2 double"), points)
    lines = {}
    for r in got.orderBy("query_id", "n").collect():
        lines.setdefault(r.query_id, []).append((round(r.lat, 5), round(r.lon, 5)))
    assert lines[1] == [(30.01, 31.0), (30.02, 31.0), (30.03, 31.0), (30.0301, 31.001)]
    assert lines[2] == [(30.0302, 31.0), (30.03, 31.0), (30.02, 31.0), (30.01, 31.00001)]
    assert all(len(lines[k]) == 2 for k in (3, 4, 5))


def test_corridors_are_joined_by_edges_siblings_roads_or_not(spark):
    frame = spark.createDataFrame
    stops = frame([(k, 30.0, 31.0 + 0.01 * k) for k in range(8)] + [(13, 30.002, 31.03), (20, 30.0, 31.0451), (21, 30.0, 31.0549)], "stop_id long, lat double, lon double")
    edge_rows = [(0, 1, 960.0), (1, 2, 960.0), (0, 2, 5000.0), (2, 13, 1000.0)]
    chosen = frame([(1, n, s) for n, s in enumerate([0, 2, 3, 4, 6])] + [(2, 0, 5)], "corridor_id long, n int, stop_id long")
    candidates = frame([(1, n, 0, s) for n, s in enumerate([0, 2, 3, 4, 6])] + [(1, 2, 1, 13)], "corridor_id long, pos int, rank int, stop_id long")
    roads = frame([(4, 6, k, 30.0, 31.04 + 0.005 * k) for k in range(5)] + [(3, 4, 0, 30.0, 31.03), (3, 4, 1, 30.9, 31.0), (3, 4, 2, 30.0, 31.04)], "a long, b long, seq int, lat double, lon double")
    joined = reconstruct.connected(chosen, candidates, frame(edge_rows, "u long, v long, dist_m double"), stops, roads)
    assert [(x.n, x.how, x.stops) for x in joined.orderBy("n").collect()] == [(0, "direct", [0, 1, 2]), (1, "sibling", [2, 13]), (2, "gap", None), (3, "road", [4, 20, 5, 21, 6])]
    one = reconstruct.rebuilt(joined).first()
    assert one.stops == [0, 1, 2, 13, 4, 20, 5, 21, 6] and (one.segments, one.connected, one.siblings, one.roads) == (4, 3, 1, 1)
    assert abs(one.unconnected_m - spatial._metres(30.0, 31.03, 30.0, 31.04)) < 1e-6
    without = reconstruct.connected(chosen, candidates, frame(edge_rows, "u long, v long, dist_m double"), stops)
    assert [x.how for x in without.orderBy("n").collect()] == ["direct", "sibling", "gap", "gap"]


def test_what_a_rider_is_told(spark):
    frame = spark.createDataFrame
    path = [("ride", 1, 0, 10, 12, 200.0, 2, 2000.0), ("walk", None, None, 12, 20, 100.0, 0, 0.0), ("ride", 2, 0, 20, 21, 90.0, 1, 500.0), ("ride", 3, 0, 21, 22, 60.0, 1, 700.0)]
    answers = frame([(0, 22, 900.0, path)], "od_id long, stop_id long, cost double, path " + search.PATH)
    routes = frame([(1, "metro", "NAT"), (2, "metro", "NAT"), (3, "bus", "CTA")], "route_id long, vehicle_type string, agency_id string")
    heads = frame([(1, 0, 4.0), (2, 0, 10.0)], "route_id long, direction_id int, headway_min double")
    pattern = frame([(1, 0, [10, 11, 12, 13]), (2, 0, [20, 21]), (3, 0, [21, 22])], "route_id long, direction_id int, stops array<long>")
    ridden = search.rides(answers, routes, heads)
    legs = [(x.n, x.route_id, x.stops, x.towards, x.from_route, x.on_foot) for x in search.rail_legs(ridden, answers, pattern).orderBy("n").collect()]
    assert legs == [(1, 1, 2, 13, None, None), (2, 2, 1, 21, 1, True), (3, 3, 1, 22, 2, False)]
    assert {x.vehicle_type: (x.stops, x.fare_egp) for x in search.fare_breakdown(ridden).collect()} == {"metro": (3, 10), "bus": (1, 20)}
    told = search.instructions(ridden, answers).orderBy("n").collect()
    assert [(x.kind, x.route_id, x.stops, x.fare_egp) for x in told] == [("ride", 1, 2, 10), ("walk", None, 0, 0), ("ride", 2, 1, 0), ("ride", 3, 1, 20)]
    total = search.itineraries(answers, routes, heads).first()
    assert total.fare == sum(x.fare_egp for x in told) and total.minutes == -(-sum(x.sec + x.wait_sec for x in told) // 60)


def test_equivalents_with_a_vehicle_under_way_come_first(spark):
    frame = spark.createDataFrame
    pattern = frame([(k, 0, [1, 2, 3]) for k in range(1, 7)] + [(9, 0, [3, 2, 1])], "route_id long, direction_id int, stops array<long>")
    routes = frame([(k, "bus" if k in (1, 4, 9) else "metro") for k in (1, 2, 3, 4, 5, 6, 9)], "route_id long, vehicle_type string")
    coming = frame([(3, 0, 1, 500), (5, 0, 1, 90), (5, 0, 1, 30), (2, 0, 2, 5)], "route_id long, direction_id int, stop_id long, eta_sec long")
    found = patterns.equivalent_routes(pattern, frame([(7, 1, 1, 3)], "journey_id long, route_id long, board long, alight long"), routes, coming)
    assert [(x.other, x.eta_sec) for x in found.orderBy("place").collect()] == [(1, None), (5, 30), (3, 500), (4, None)]
    arriving = frame([(1, "s", None), (2, "s", 5), (3, "s", 2)], "session_id long, stop string, eta_sec long")
    assert [x.session_id for x in live.next_arrivals(arriving, "stop", 2).orderBy("n").collect()] == [3, 2]
    fixes = frame([(1, 1, 30.0, 31.0, 1.0), (None, 1, 30.0, 31.0, 1.0), (2, 1, 40.0, 31.0, 1.0), (3, 1, 30.0, 31.0, None)], "session_id long, route_id long, lat double, lon double, at double")
    assert [x.error for x in live.report_errors(fixes).orderBy("session_id").collect()] == ["missing", None, "outside", "time"]


def test_reports_on_answers_and_matches(spark):
    frame = spark.createDataFrame
    options = frame([(1, "walk"), (1, "fastest"), (2, "partial"), (3, "none")], "od_id long, kind string")
    pairs = frame([(k, "a", f"b{k}") for k in range(1, 5)], "od_id long, origin string, destination string")
    assert [(x.answered, x.complete) for x in audits.answered(options, pairs).orderBy("od_id").collect()] == [(True, True), (True, False), (False, False), (False, False)]
    assert [tuple(x) for x in audits.frequency_order(frame([("x",), ("y",), ("y",), ("a",)], "k string"), "k").collect()] == [("y", 2), ("a", 1), ("x", 1)]
    matches = frame([(1, "exact"), (1, "fuzzy"), (1, "unresolved"), (2, "road"), (3, "alias")], "corridor_id long, how string")
    assert {x.bucket: x.corridors for x in audits.resolved_shares(matches).collect()} == {">=60%": 1, "<40%": 1, ">=80%": 1}


def test_anchors_drop_outliers(spark):
    rows = [(1, k, 0, k, 30.0 + 0.01 * k, 31.0) for k in range(6)]
    rows[3] = (1, 3, 0, 99, 31.0, 32.0)
    rows.append((1, 2, 1, 50, 35.0, 31.0))
    got = reconstruct.anchors(spark.createDataFrame(rows, "corridor_id long, pos int, rank int, stop_id long, lat double, lon double"))
    assert [r.stop_id for r in got.orderBy("n").collect()] == [0, 1, 2, 4, 5]


def reports(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "event_id long, " + live.REPORT)


def test_live_vehicles(spark):
    fix = lambda s, at, lat=30.0, route=1, ended=False: (s, route, 0, lat, 31.0, float(at), ended)
    rows = [fix(1, 0), *(fix(2, 10 * k, 30.0 + 0.001 * k) for k in range(10)), fix(3, 0), fix(3, 1, 30.001), fix(4, 0), fix(4, 10, 30.001, route=2), fix(5, 0), fix(5, 10, ended=True)]
    found = {r.session_id: r for r in live.latest(reports(spark, rows), 90.0).collect()}
    assert set(found) == {1, 2, 3, 4}
    assert found[1].speed is None and found[3].speed is None and found[4].speed is None and found[4].route_id == 2
    assert found[2].fixes == C.LIVE_KEEP and abs(found[2].speed - 11.1195) < 0.01
    assert {r.session_id for r in live.latest(reports(spark, rows), 90.5).collect()} == {2, 3, 4}
    eta = live.arrivals(live.latest(reports(spark, rows), 90.0), F.lit(30.0), F.lit(31.0), 90.0, F.lit("metro"))
    at = {r.session_id: r for r in eta.collect()}
    assert at[1].eta_sec == 0 and at[2].eta_sec == round(at[2].distance_m / found[2].speed) and at[3].eta_sec == round(at[3].distance_m / 11)


def test_live_stream(spark, tmp_path):
    source, sink = tmp_path / "in", []
    source.mkdir()
    fix = lambda s, at, lat=30.0, route=1, ended=False: (s, route, 0, lat, 31.0, 1000.0 + at, ended)
    batches = [[fix(1, 0), fix(1, 10, 30.001), fix(2, 0)], [fix(1, 20, 30.002, route=2), fix(2, 5, ended=True)], [fix(3, 300)], [fix(1, 310)]]
    for k, rows in enumerate(batches):
        frame = pd.DataFrame(rows, columns=[c.split()[0] for c in live.REPORT.split(", ")]).astype({"direction_id": "int32"})
        frame.to_parquet(source / f"{k}.parquet")
        os.utime(source / f"{k}.parquet", (1e9 + 10 * k, 1e9 + 10 * k))  # files are taken by age
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(live.REPORT).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = live.vehicles(stream).writeStream.foreachBatch(lambda df, _: sink.append(sorted(map(tuple, df.select("session_id", "route_id", "fixes").collect())))).outputMode("update").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    try:
        query.awaitTermination(180)
    finally:
        query.stop()
    assert [b for b in sink if b] == [[(1, 1, 2), (2, 1, 1)], [(1, 2, 1)], [(3, 1, 1)], [(1, 1, 1)]]


def test_streamed_windows_and_late_reports(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    fix = lambda s, at: (s, 1, 0, 30.0, 31.0, 6000.0 + at, False)
    # The third batch is up to 90 seconds late for the first minute; the fifth is too late for it, as its window is closed.
    for k, rows in enumerate([[fix(1, 0), fix(1, 30), fix(2, 70)], [fix(1, 130)], [fix(1, 45), fix(1, 400)], [fix(2, 410)], [fix(1, 50)], [fix(3, 2000)]]):
        frame = pd.DataFrame(rows, columns=[c.split()[0] for c in live.REPORT.split(", ")]).astype({"direction_id": "int32"})
        frame.to_parquet(source / f"{k}.parquet")
        os.utime(source / f"{k}.parquet", (1e9 + 10 * k, 1e9 + 10 * k))
    stream = live.timed(spark.readStream.schema(live.REPORT).option("maxFilesPerTrigger", 1).parquet(str(source)))
    minutes = live.reports_per_minute(stream, "route_id").select("route_id", F.unix_seconds("window.start").alias("minute_sec"), "reports")
    got = {r.minute_sec - 6000: r.reports for r in live.replayed(minutes, ["route_id", "minute_sec"], "minutes").collect()}
    assert got == {0: 3, 60: 1, 120: 1, 360: 2, 1980: 1}
    rides = live.ride_sessions(live.timed(spark.read.parquet(str(source))))
    assert sorted((r.session_id, r.fixes) for r in rides.collect()) == [(1, 1), (1, 5), (2, 1), (2, 1), (3, 1)]


def test_audits(spark):
    pairs = spark.createDataFrame([("a", "b", True, True), ("b", "a", True, False), ("a", "c", False, False)], "origin string, destination string, answered boolean, complete boolean")
    rows = {(r.origin, r.destination): (r.answered_pct, r.complete_pct) for r in audits.coverage(pairs).collect()}
    assert rows[None, None] == (66.7, 33.3) and rows["a", None] == (50.0, 50.0)
    points = spark.createDataFrame([(n, 30.0 + k * 0.01, 31.0) for k, n in enumerate("abcdef")], "name string, lat double, lon double")
    assert audits.ordered_pairs(points).count() == 30
    assert audits.far_pairs(points, 2).count() == 2
    assert spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double").agg(audits.upper_median("x")).first()[0] == 3.0


@pytest.mark.parametrize("many", [True, False])
def test_options_alike(spark, many):
    rows = [(0, "ride", 20, 15), (0, "ride", 20, 15), (0, "walk", 0, 15), (0, "walk", 0, 15)]
    df = spark.createDataFrame(rows if many else rows[:1], "od_id long, kind string, fare int, minutes int")
    assert search.distinct_options(df, ["fare", "minutes"], "kind").count() == (3 if many else 1)


def test_avoided_routes_cost_more(spark):
    stops, routes, trips, times = mini(spark)
    all_edges = edges.edge_means(edges.riding_times(edges.guarded(edges.hops(times, trips, routes, stops))))
    heads, walks = spark.createDataFrame([(1, 0, 4.0)], "route_id long, direction_id int, headway_min double"), spatial.walk_links(stops)
    boards, start = search.boardings(all_edges, routes, heads, "fastest"), spark.createDataFrame([(0, 1, 0.0)], "od_id long, stop_id long, cost double")

    def to_five(avoid=None):
        return search.best_by_stop(search.search(all_edges, boards, walks, start, avoid=avoid)).where("stop_id = 5").first()

    shun = lambda *routes: spark.createDataFrame([(0, k) for k in routes], "od_id long, route_id long")
    one = to_five()
    two = to_five(shun(one.route_id))
    assert two.route_id != one.route_id and two.cost > one.cost
    assert abs(to_five(shun(1, 2, 3, 4)).cost - one.cost - 1800 - 3 * 300) < 1e-6


def test_station_notes(spark):
    from tramline.operators import journey

    stations = spark.createDataFrame([(1, "شارع السادات (التحرير)"), (2, "مار جرجس"), (3, "x")], "stop_id long, name string")
    notes = spark.createDataFrame([("السادات", "note one"), ("مار جرجس", "note two")], "station_ar string, note_ar string")
    assert {r.stop_id: r.note for r in journey.station_notes(stations, notes).collect()} == {1: "note one", 2: "note two", 3: None}


def test_trusted_corridors_count_as_faster(spark):
    rows = spark.createDataFrame([(1, 2, 7, 0, 100.0), (2, 3, 7, 0, 100.0), (1, 2, 8, 0, 100.0)], "u long, v long, route_id long, direction_id int, sec double")
    trusted = spark.createDataFrame([(7, 1), (7, 2)], "route_id long, stop_id long")
    assert {(r.u, r.route_id): r.sec for r in edges.discounted(rows, trusted).collect()} == {(1, 7): 75.0, (2, 7): 100.0, (1, 8): 100.0}


def _shared_places(spark, n=120):
    """Stops, many of them in one place, with how far each is from each."""
    spots = [(30.0 + (k * 7 % 11) * 0.0011, 31.2 + (k * 5 % 7) * 0.0013) for k in range(12)]
    rows = [(k, "ab"[k % 2], *spots[k * 13 % 12]) for k in range(n)]
    return spark.createDataFrame(rows, "stop_id long, stop_name string, lat double, lon double"), rows, lambda a, b: spatial._metres(a[-2], a[-1], b[-2], b[-1])


def test_pairs_of_places_become_pairs_of_all_their_stops(spark, monkeypatch):
    monkeypatch.setattr(spatial, "PLACE_STOPS", 3)
    stops, rows, apart = _shared_places(spark)
    want = {(a[0], b[0]) for a in rows for b in rows if 0 < apart(a, b) <= 500.0}
    assert spatial.place_links(stops).count() < len(want) / 50  # places are measured once
    got = [(x.u, x.v) for x in spatial.walk_links(stops).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    edges = spark.createDataFrame([(k, k, "metro" if k % 3 else "tram") for k in range(100)], "u long, v long, vehicle_type string")
    mode = lambda k: k % 3 > 0
    linked = {(a[0], b[0]) for a in rows[:100] for b in rows[:100] if a[0] < b[0] and mode(a[0]) != mode(b[0]) and apart(a, b) <= 750.0 and not 0 < apart(a, b) <= 500.0}
    assert {(x.u, x.v) for x in spatial.rail_links(stops, edges).collect()} == linked and linked


def test_nearest_stops_of_shared_places(spark):
    stops, rows, apart = _shared_places(spark)
    points = spark.createDataFrame([(k, 30.0 + k % 4 * 0.002, 31.2 + k % 3 * 0.003) for k in range(50)], "point_id long, lat double, lon double")
    for k in (1, 7, 40):
        want = {}
        for p in points.collect():
            near = sorted((round(apart(p, s), 6), s[0]) for s in rows if apart(p, s) <= 900.0)[:k]
            want |= {(p.point_id, r + 1): s for r, (_, s) in enumerate(near)}
        assert {(x.point_id, x.rank): x.stop_id for x in spatial.nearest_stops(points, stops, k, 900.0).collect()} == want
    assert spatial._nearest_of_places(spatial.places(points.withColumnRenamed("point_id", "stop_id")), stops, 1, 900.0).count() == 12  # not one row for each of 50 points
    spots = points.groupBy("lat", "lon").agg(F.min("point_id").alias("point_id"))
    on_foot = lambda at, x: F.when(at % 3 != 0, x["dist_m"] * (1 + (at + x["stop_id"]) % 5 * 0.25))
    near = spatial.nearest_stops(points, stops, 20)
    walked = near.where("point_id % 3 <> 0").select("point_id", "stop_id", on_foot(F.col("point_id"), {"dist_m": F.col("dist_m"), "stop_id": F.col("stop_id")}).alias("distance_m"))
    by_place = spatial.reranked_alike(points, spots, spatial.nearest_stops(spots, stops, 20), on_foot, 3)
    assert sorted(map(tuple, by_place.collect())) == sorted(map(tuple, spatial.reranked(near, walked, 3).collect()))


def test_clusters_of_shared_places(spark, monkeypatch):
    stops, rows, apart = _shared_places(spark)
    seen, heads = [], spatial.first_heads
    monkeypatch.setattr(spatial, "first_heads", lambda nodes, pairs, *more: seen.append(nodes.count()) or heads(nodes, pairs, *more))

    def brute(metres, by_name):
        found, of = [], {}
        for r in rows:
            own = next((h for h in found if (not by_name or h[1] == r[1]) and apart(h, r) <= metres), r)
            of[r[0]] = own[0]
            found += [r] if own is r else []
        return of

    assert dict(map(tuple, spatial.cluster_same_names(stops, 300.0).collect())) == brute(300.0, True)
    assert dict(map(tuple, reconstruct.grid_clusters(stops, 200.0).collect())) == brute(200.0, False)
    assert max(seen) <= 24  # places and names, not all 120 stops


def test_canonical_stop_times_merge_within_a_kilometre(spark, monkeypatch):
    from tramline import queries

    asked = []
    monkeypatch.setattr(queries.spatial, "cluster_same_names", lambda stops, metres=150.0: asked.append(metres) or stops.select("stop_id", F.col("stop_id").alias("canonical_id")))
    queries.QUERIES["stop_times_canonical"](spark, "/root/testdata/sf0.001")
    assert asked == [1000.0]


def test_walks_between_places_cost_what_walks_between_all_stops_do(spark):
    stops, rows, _ = _shared_places(spark, 60)
    ways = [(k, (k * 17 + 5) % 60, k % 3, 0, 40.0 + k, 100.0) for k in range(0, 60, 2)]
    known = search.materialize(spark.createDataFrame(ways, "u long, v long, route_id long, direction_id int, sec double, dist_m double"), "ways")
    boards = spark.createDataFrame([(r, 0, 30.0, 90.0, 0, 0.0, 0.0) for r in range(3)], "route_id long, direction_id int, first double, later double, bit int, money double, per_metre double")
    origins = spark.createDataFrame([(0, 0, 0.0), (7, 7, 0.0)], "od_id long, stop_id long, cost double")
    pairs, links = (search.materialize(x, "walks") for x in (spatial.walk_links(stops, 300.0), spatial.place_links(stops, 300.0)))
    assert links.count() * 20 < pairs.count()
    costs = lambda walks, **more: {(x.od_id, x.stop_id): x.cost for x in search.best_by_stop(search.search(known, boards, walks, origins, **more)).collect()}
    assert costs(links, spots=search.materialize(spatial.spots(stops), "spots")) == costs(pairs)
