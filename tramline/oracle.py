"""SQL for DuckDB that expresses the registered queries on the same tables, written apart from the Spark code."""

from __future__ import annotations

_AGENCIES = "['CTA','CTA_M','LTRA_M','BOX','P_B_8','P_O_14','COOP','MM','GRN','PGT','NAT','CAI_APM','GOV_CTA','GOV_CTA_M']"



def _m(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Metres between two places."""
    return f"(12742000e0*asin(sqrt(pow(sin((radians({lat2})-radians({lat1}))/2),2)+cos(radians({lat1}))*cos(radians({lat2}))*pow(sin((radians({lon2})-radians({lon1}))/2),2))))"


def _turn(a: str, b: str, c: str) -> str:
    """Whether going from a to b to c (columns' prefixes) turns left."""
    return f"(({c}_lon-{a}_lon)*({b}_lat-{a}_lat)>({b}_lon-{a}_lon)*({c}_lat-{a}_lat))"


def _heads(metres: int, by: str) -> str:
    """Of each group of stops, those that are near no head of a smaller id."""
    return f"""SELECT {by} AS grp, list_reduce(list([{{'id':stop_id,'lat':lat,'lon':lon}}] ORDER BY stop_id), lambda acc, x: CASE WHEN len(list_filter(acc, lambda h: {_m('h.lat','h.lon','x[1].lat','x[1].lon')}<={metres}))>0 THEN acc ELSE list_concat(acc, x) END) AS heads FROM stops GROUP BY 1"""


def _canonical(heads: str, metres: int, by: str) -> str:
    return f"SELECT s.stop_id, list_filter(heads, lambda h: {_m('h.lat','h.lon','s.lat','s.lon')}<={metres})[1].id AS canonical_id FROM stops s JOIN {heads} h ON h.grp={by}"


def _boards(transfer: int, gated: int, per_pound: int) -> str:
    """What boarding each run costs: seconds at first and later, bit of its mode, money in seconds, and per metre ridden on."""
    wait = "least(coalesce(nullif(headway_min,0),20e0)*30,1200e0)"
    bits = "CASE vehicle_type WHEN 'metro' THEN 1 WHEN 'monorail' THEN 2 WHEN 'lrt' THEN 4 WHEN 'apm' THEN 8 ELSE 0 END" if per_pound else "0"
    money = "CASE vehicle_type WHEN 'metro' THEN 10 WHEN 'monorail' THEN 20 WHEN 'lrt' THEN 10 WHEN 'apm' THEN 0 WHEN 'tram' THEN 0 WHEN 'microbus' THEN 10 ELSE CASE WHEN agency_id='GRN' THEN 25 ELSE 20 END END"
    return f"""SELECT p.route_id, p.direction_id, {wait} AS first, greatest({wait}, CASE WHEN rail THEN {gated}e0 WHEN vehicle_type='microbus' THEN {transfer + 300}e0 ELSE {transfer}e0 END) AS later, {bits} AS bit, {money}*{per_pound}e0 AS money,
        CASE WHEN vehicle_type='microbus' THEN 0.00125e0*{per_pound} ELSE 0e0 END AS per_metre
        FROM (SELECT DISTINCT route_id, direction_id FROM blend) p JOIN routes r ON r.route_id=p.route_id LEFT JOIN headways h ON h.route_id=p.route_id AND h.direction_id=p.direction_id"""


def _reached(own: str, starts: str, edges: str, boards: str, walks: str, times: float) -> str:
    """The least cost of each arrival at a stop by a run with some tickets paid, and on route -1, of standing there, until
    none gets less. Bit 16 of the mask: something was ridden."""
    ways = f"(SELECT e.u, e.v, e.route_id, e.direction_id, e.sec, e.sec+e.dist_m*b.per_metre AS on_sec, b.first, b.later, b.bit, b.money FROM {edges} e JOIN {boards} b ON b.route_id=e.route_id AND b.direction_id=e.direction_id)"
    ride = f"SELECT r.od_id, e.v AS stop_id, e.route_id, e.direction_id, r.mask, r.cost+e.on_sec AS cost FROM {own} r JOIN {ways} e ON e.u=r.stop_id AND e.route_id=r.route_id AND e.direction_id=r.direction_id"
    board = f"SELECT r.od_id, e.v, e.route_id, e.direction_id, (r.mask|e.bit|65536)::INTEGER, r.cost+CASE WHEN r.mask<65536 THEN e.first ELSE e.later END+CASE WHEN r.mask&e.bit>0 THEN 0e0 ELSE e.money END+e.sec FROM {own} r JOIN {ways} e ON e.u=r.stop_id WHERE r.route_id=-1"
    walk = f"SELECT r.od_id, w.v, -1::BIGINT, 0, r.mask, r.cost+w.sec*{times}e0 FROM {own} r JOIN {walks} w ON w.u=r.stop_id WHERE r.route_id=-1"
    both = f"SELECT unnest([{{'r':g.route_id,'d':g.direction_id}},{{'r':-1::BIGINT,'d':0}}]) AS k, g.* FROM ({ride} UNION ALL {board}) g"
    return f"""SELECT od_id, stop_id, -1::BIGINT AS route_id, 0 AS direction_id, 0 AS mask, 0e0 AS cost FROM {starts}
        UNION SELECT c.od_id, c.stop_id, c.route_id, c.direction_id, c.mask, min(c.cost) AS cost FROM (SELECT od_id, stop_id, k.r AS route_id, k.d AS direction_id, mask, cost FROM ({both}) UNION ALL {walk}) c
        LEFT JOIN recurring.{own} o ON o.od_id=c.od_id AND o.stop_id=c.stop_id AND o.route_id=c.route_id AND o.direction_id=c.direction_id AND o.mask=c.mask WHERE o.cost IS NULL OR c.cost<o.cost GROUP BY 1,2,3,4,5"""


#: The keys of recursive parts, whose rows are replaced by better ones until none is found.
KEYS = {**{t: "od_id, stop_id, route_id, direction_id, mask" for t in ("reached", "reached_recommended", "reached_cheapest", "zoned", "railed")}, "walked": "source_id, stop_id"}

#: Common table expressions; sql() prepends those that a query names.
PARTS = {
    "stops": "SELECT s_suppkey AS stop_id, n_name AS stop_name, 30.02e0+((s_suppkey*7919)%1000)*0.00003e0 AS lat, 31.20e0+((s_suppkey*6271)%1000)*0.000035e0 AS lon FROM supplier JOIN nation ON s_nationkey=n_nationkey",
    "routes": f"""SELECT *, vehicle_type IN ('metro','monorail','lrt','apm','tram') AS rail, agency_id IN ('GOV_CTA','GOV_CTA_M') AS reconstructed, upper(vehicle_type[1]) || route_id AS route_short_name FROM (
        SELECT *, CASE WHEN agency_id='CAI_APM' THEN 'apm' WHEN route_type='0' THEN 'tram' WHEN route_type='1' THEN 'metro' WHEN route_type='2' THEN 'lrt' WHEN route_type='12' THEN 'monorail'
          WHEN agency_id IN ('CTA_M','LTRA_M','GOV_CTA_M') THEN 'minibus' WHEN agency_id IN ('BOX','P_B_8','P_O_14','PGT') THEN 'microbus' WHEN agency_id='NAT' THEN 'metro' ELSE 'bus' END AS vehicle_type FROM (
          SELECT r AS route_id, {_AGENCIES}[(r%14+1)::int] AS agency_id, CASE WHEN r=57 THEN '0' WHEN r=58 THEN '2' WHEN r=59 THEN '12' WHEN r%14=10 THEN '1' ELSE '3' END AS route_type, p_name AS route_long_name FROM range(60) t(r) LEFT JOIN part ON p_partkey=r))""",
    "trips": "SELECT o_orderkey AS trip_id, o_custkey%60 AS route_id, (o_orderkey%2)::int AS direction_id, o_orderpriority AS service_id FROM orders",
    "stop_times": """SELECT l_orderkey AS trip_id, row_number() OVER w AS seq, l_suppkey AS stop_id, (21600+sum(floor(60+l_quantity*20)::bigint) OVER (w ROWS UNBOUNDED PRECEDING))::bigint AS t FROM lineitem
        WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber,l_suppkey,l_partkey,l_shipdate,l_extendedprice)""",
    "frequencies": """SELECT trip_id, route_id, direction_id, (5+trip_id%3)*3600 AS start_sec, (5+trip_id%3)*3600+54000 AS end_sec, 300+(trip_id%7)*150 AS headway_secs FROM trips WHERE route_id%10<>9
        UNION ALL SELECT trip_id, route_id, direction_id, 82800, 90000, 1800 FROM trips WHERE trip_id%5=0 AND route_id%10<>9""",
    "calendar": """SELECT * FROM (VALUES ('1-URGENT','monday'),('1-URGENT','tuesday'),('1-URGENT','wednesday'),('1-URGENT','thursday'),('1-URGENT','friday'),('1-URGENT','saturday'),('1-URGENT','sunday'),
        ('2-HIGH','monday'),('2-HIGH','tuesday'),('2-HIGH','wednesday'),('2-HIGH','thursday'),('2-HIGH','friday'),('3-MEDIUM','saturday'),('3-MEDIUM','sunday'),('4-NOT SPECIFIED','friday'),('5-LOW','monday'),('5-LOW','tuesday'),('5-LOW','wednesday')) t(service_id,dow)""",
    "hops": """SELECT p.trip_id, seq, u, v, dt, t.route_id, direction_id, rail, reconstructed, vehicle_type,
        12742000e0*asin((0e0+sqrt(pow(sin((radians(b.lat)-radians(a.lat))/2),2)+cos(radians(a.lat))*cos(radians(b.lat))*pow(sin((radians(b.lon)-radians(a.lon))/2),2)))) AS dist_m
        FROM (SELECT trip_id, seq, stop_id AS u, lead(stop_id) OVER w AS v, lead(t) OVER w - t AS dt FROM stop_times WINDOW w AS (PARTITION BY trip_id ORDER BY seq)) p
        JOIN trips t USING (trip_id) JOIN routes r ON r.route_id=t.route_id JOIN stops a ON a.stop_id=u JOIN stops b ON b.stop_id=v WHERE u<>v""",
    "guarded": "SELECT *, CASE WHEN dt>0 AND dist_m/dt<=CASE WHEN rail THEN 28e0 ELSE 15.3e0 END THEN dt::double END AS timed FROM hops",
    "paced": "SELECT *, CASE WHEN sum(timed) OVER w>0 THEN sum(CASE WHEN timed IS NOT NULL THEN dist_m END) OVER w/sum(timed) OVER w END AS pace FROM guarded WINDOW w AS (PARTITION BY trip_id)",
    "riding": """SELECT *, CASE WHEN timed IS NULL THEN greatest(dist_m/(CASE WHEN rail THEN 45e0 ELSE 20e0 END/3.6e0),10e0) WHEN slow THEN dist_m/pace ELSE timed END AS sec FROM (
        SELECT *, coalesce(dist_m>0 AND pace>0 AND dist_m/timed<pace/3 AND timed>=90,false) AS slow FROM paced)""",
    "edges": "SELECT u, v, route_id, direction_id, avg(sec) AS sec, count(*) AS samples, any_value(dist_m) AS dist_m, any_value(reconstructed) AS reconstructed, any_value(vehicle_type) AS vehicle_type FROM riding GROUP BY 1,2,3,4",
    "medians": """SELECT u, v, median(vote) AS med FROM (SELECT u, v, route_id, max_by(sec,direction_id) AS vote FROM edges WHERE NOT reconstructed GROUP BY 1,2,3) GROUP BY 1,2 HAVING count(*)>=3""",
    "blend": """SELECT u, v, route_id, direction_id, dist_m, vehicle_type, off AS blended, CASE WHEN off THEN sec+(med-sec)*0.5e0 ELSE sec END AS sec FROM (
        SELECT e.*, med, coalesce(med>0 AND (sec/med>=1.5e0 OR sec/med<=1/1.5e0),false) AS off FROM edges e LEFT JOIN medians m ON m.u=e.u AND m.v=e.v)""",
    "headways": "SELECT route_id, direction_id, round_even(sum(headway_secs*(end_sec-start_sec))/sum(end_sec-start_sec)/60e0,1) AS headway_min FROM frequencies GROUP BY 1,2",
    "windows": """SELECT route_id, min(start_sec) AS start_sec, max(end_sec) AS end_sec FROM (SELECT *, sum(CASE WHEN start_sec<=reach THEN 0 ELSE 1 END) OVER (PARTITION BY route_id ORDER BY start_sec,end_sec) AS island FROM (
        SELECT *, max(end_sec) OVER (PARTITION BY route_id ORDER BY start_sec,end_sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT DISTINCT route_id,start_sec,end_sec FROM frequencies))) GROUP BY route_id, island""",
    "closed": "SELECT route_id FROM windows GROUP BY 1 HAVING NOT bool_or((start_sec-2700<=10800 AND 10800<=end_sec) OR (start_sec-2700<=97200 AND 97200<=end_sec))",
    "inactive": "SELECT DISTINCT route_id FROM trips WHERE route_id NOT IN (SELECT t.route_id FROM trips t JOIN calendar c USING (service_id) WHERE dow='saturday' AND t.route_id IS NOT NULL)",
    "pairs": """SELECT a.stop_id AS u, b.stop_id AS v, 12742000e0*asin((0e0+sqrt(pow(sin((radians(b.lat)-radians(a.lat))/2),2)+cos(radians(a.lat))*cos(radians(b.lat))*pow(sin((radians(b.lon)-radians(a.lon))/2),2)))) AS dist_m FROM stops a, stops b""",
    "walks": "SELECT u, v, dist_m, dist_m/1.25e0 AS sec FROM pairs WHERE u<>v AND dist_m>0 AND dist_m<=500",
    "sequences": """SELECT trip_id, route_id, direction_id, list(stop_id ORDER BY seq) AS stops FROM (SELECT *, lag(stop_id) OVER (PARTITION BY trip_id ORDER BY seq) AS b FROM stop_times) JOIN trips USING (trip_id)
        WHERE b IS NULL OR b<>stop_id GROUP BY 1,2,3""",
    "patterns": "SELECT route_id, direction_id, stops, trip_id FROM (SELECT *, row_number() OVER (PARTITION BY route_id,direction_id ORDER BY len(stops) DESC,trip_id) AS n FROM sequences) WHERE n=1",
    "visits": "SELECT route_id, direction_id, unnest(stops) AS stop_id, unnest(range(len(stops))) AS pos FROM patterns",
    "first_visits": "SELECT route_id, direction_id, stop_id, min(pos) AS pos FROM visits GROUP BY 1,2,3",
    "spots": """SELECT route_id || '_' || direction_id AS shape_id, t.route_id, t.direction_id, s.seq, s.stop_id, lat, lon FROM stop_times s JOIN (SELECT route_id, direction_id, min(trip_id) AS trip_id FROM trips GROUP BY 1,2) t USING (trip_id) JOIN stops p ON p.stop_id=s.stop_id""",
    "spot_steps": """SELECT *, coalesce(12742000e0*asin((0e0+sqrt(pow(sin((radians(lat)-radians(lag(lat) OVER w))/2),2)+cos(radians(lag(lat) OVER w))*cos(radians(lat))*pow(sin((radians(lon)-radians(lag(lon) OVER w))/2),2)))),0) AS step FROM spots WINDOW w AS (PARTITION BY shape_id ORDER BY seq)""",
    "spot_along": "SELECT *, sum(step) OVER (PARTITION BY shape_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS along FROM spot_steps",
    "journeys": "SELECT trip_id, route_id, vehicle_type, count(*) AS hops, sum(dist_m) AS metres FROM hops GROUP BY 1,2,3",
    "boards": _boards(240, 120, 0), "boards_recommended": _boards(420, 180, 90), "boards_cheapest": _boards(240, 120, 10000),
    "positions": """SELECT event_id, user_id AS session_id, user_id%60 AS route_id, (floor(epoch_us(ts)/86400e6)::bigint%2)::int AS direction_id, 30.0e0+value*0.0001e0 AS lat, 31.2e0+json_extract_string(props,'$.k')::int*0.0005e0 AS lon,
        epoch_us(ts)/600e6 AS tm, event_type='error' AS ended FROM events""",
    "last_fix": """SELECT * FROM (SELECT *, least(row_number() OVER r,5)::int AS fixes, CASE WHEN tm-lag(tm) OVER r>=2 THEN 12742000e0*asin((0e0+sqrt(pow(sin((radians(lat)-radians(lag(lat) OVER r))/2),2)+cos(radians(lag(lat) OVER r))*cos(radians(lat))*pow(sin((radians(lon)-radians(lag(lon) OVER r))/2),2))))/(tm-lag(tm) OVER r) END AS speed, row_number() OVER (PARTITION BY session_id ORDER BY tm DESC,event_id DESC) AS n FROM (
        SELECT *, sum(changed) OVER (PARTITION BY session_id ORDER BY tm,event_id ROWS UNBOUNDED PRECEDING) AS ride FROM (SELECT *, coalesce((lag(route_id) OVER s<>route_id OR lag(direction_id) OVER s<>direction_id OR lag(ended) OVER s)::int,0) AS changed FROM positions WHERE tm<=(SELECT min(tm)+4000 FROM positions) WINDOW s AS (PARTITION BY session_id ORDER BY tm,event_id)))
        WINDOW r AS (PARTITION BY session_id,ride ORDER BY tm,event_id)) WHERE n=1 AND NOT ended AND (SELECT min(tm)+4000 FROM positions)-tm<=90""",
    "cards": """SELECT p.route_id, nullif(regexp_replace(route_short_name,'[^0-9]','','g'),'') AS number, route_long_name, route_short_name, vehicle_type, a.stop_name AS first, b.stop_name AS last, len(stops)::int AS stop_count
        FROM (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY direction_id) AS n FROM patterns) p JOIN routes r ON r.route_id=p.route_id JOIN stops a ON a.stop_id=p.stops[1] JOIN stops b ON b.stop_id=p.stops[len(p.stops)] WHERE n=1""",
    "starts": "SELECT stop_id AS od_id, stop_id FROM stops WHERE stop_id%20=0",
    "reached": _reached("reached", "starts", "blend", "boards", "walks", 1.0),
    "all_starts": "SELECT stop_id AS od_id, stop_id FROM stops",
    "reached_recommended": _reached("reached_recommended", "all_starts", "blend", "boards_recommended", "walks", 1.6),
    "reached_cheapest": _reached("reached_cheapest", "starts", "blend", "boards_cheapest", "walks", 1.0),
    "zones": """SELECT cell_x || '_' || cell_y AS name, arg_min(stop_id, (off, stop_id)) AS stop_id FROM (SELECT *, pow(lat-(cell_y+0.5e0)*0.01e0,2)+pow(lon-(cell_x+0.5e0)*0.01e0,2) AS off FROM (SELECT *, floor(lon/0.01e0)::bigint AS cell_x, floor(lat/0.01e0)::bigint AS cell_y FROM stops)) GROUP BY cell_x, cell_y""",
    "zone_starts": "SELECT stop_id AS od_id, stop_id FROM zones",
    "zoned": _reached("zoned", "zone_starts", "blend", "boards", "walks", 1.0),
    "rail_edges": "SELECT u, v, route_id, direction_id, 1e0 AS sec, dist_m FROM edges WHERE vehicle_type IN ('metro','monorail','lrt','apm','tram')",
    "rail_stops": "SELECT u AS stop_id FROM rail_edges UNION SELECT v FROM rail_edges",
    "rail_boards": "SELECT DISTINCT route_id, direction_id, 0e0 AS first, 3e0 AS later, 0 AS bit, 0e0 AS money, 0e0 AS per_metre FROM rail_edges",
    "rail_start": "SELECT 0 AS od_id, min(stop_id) AS stop_id FROM rail_stops",
    "rail_walks": "SELECT u, v, 3e0 AS sec FROM pairs WHERE u<>v AND dist_m>0 AND dist_m<=750 AND u IN (SELECT stop_id FROM rail_stops) AND v IN (SELECT stop_id FROM rail_stops)",
    "railed": _reached("railed", "rail_start", "rail_edges", "rail_boards", "rail_walks", 1.0),
    "marks": "SELECT trip_id AS id, ((seq-1)//2)::int AS pos, list({'id':s.stop_id,'lat':lat,'lon':lon} ORDER BY seq, s.stop_id) AS opts FROM stop_times s JOIN stops p ON p.stop_id=s.stop_id GROUP BY 1,2",
    "turns": "SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) AS k, opts, lead(opts) OVER (PARTITION BY id ORDER BY pos) AS following FROM marks",
    "chain": f"""SELECT id, 1::BIGINT AS k, [CASE WHEN following IS NULL THEN opts[1] ELSE list_reduce(opts, lambda a, b: CASE WHEN list_min(list_transform(following, lambda y: {_m('b.lat','b.lon','y.lat','y.lon')}))<list_min(list_transform(following, lambda y: {_m('a.lat','a.lon','y.lat','y.lon')})) THEN b ELSE a END) END] AS line FROM turns WHERE k=1
        UNION ALL SELECT c.id, c.k+1, list_append(c.line, list_reduce(t.opts, lambda a, b: CASE WHEN {_m('c.line[len(c.line)].lat','c.line[len(c.line)].lon','b.lat','b.lon')}<{_m('c.line[len(c.line)].lat','c.line[len(c.line)].lon','a.lat','a.lon')} THEN b ELSE a END)) FROM chain c JOIN turns t ON t.id=c.id AND t.k=c.k+1""",
    "chosen": "SELECT id, list_filter(line, lambda x, i: i=1 OR x.id<>line[i-1].id) AS line FROM (SELECT id, line FROM chain QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC)=1)",
    "thinned": f"""SELECT id, 0 AS n, line FROM chosen
        UNION ALL SELECT id, n+1, list_filter(line, lambda x, i: i<>worst) AS line FROM (SELECT id, n, line, list_reduce(list_prepend({{'g':0e0,'at':0::BIGINT}}, list_transform(list_filter(range(2, len(line)), lambda i: steps[i-1]+steps[i]>4*usual), lambda i: {{'g':steps[i-1]+steps[i]-{_m('line[i-1].lat','line[i-1].lon','line[i+1].lat','line[i+1].lon')},'at':i}})), lambda a, b: CASE WHEN b.g>a.g THEN b ELSE a END).at AS worst
            FROM (SELECT *, list_sort(steps)[len(steps)//2+1] AS usual FROM (SELECT *, list_transform(range(1, len(line)), lambda i: {_m('line[i].lat','line[i].lon','line[i+1].lat','line[i+1].lon')}) AS steps FROM thinned WHERE len(line)>=4)) WHERE usual>0) WHERE worst>0""",
    "undirected": "SELECT u, v, min(d) AS d FROM (SELECT u, v, dist_m AS d FROM edges UNION ALL SELECT v, u, dist_m FROM edges) GROUP BY 1,2",
    "walked": """SELECT stop_id AS source_id, stop_id, 0e0 AS m FROM stops
        UNION SELECT r.source_id, e.v AS stop_id, min(r.m+e.d) AS m FROM walked r JOIN undirected e ON e.u=r.stop_id LEFT JOIN recurring.walked o ON o.source_id=r.source_id AND o.stop_id=e.v WHERE r.m+e.d<=1500 AND (o.m IS NULL OR r.m+e.d<o.m) GROUP BY 1,2""",
    "heads_150": _heads(150, "stop_name"),
    "heads_1000": _heads(1000, "stop_name"),
    "heads_60": _heads(60, "1"),
    "merged_1000": _canonical("heads_1000", 1000, "s.stop_name"),
    "places": "SELECT c_custkey AS point_id, 30.0e0+(c_custkey%97)*0.001e0 AS lat, 31.19e0+(c_custkey%89)*0.001e0 AS lon FROM customer",
    "raw_near": f"SELECT point_id, stop_id, d, row_number() OVER (PARTITION BY point_id ORDER BY d, stop_id) AS rank FROM (SELECT point_id, stop_id, {_m('p.lat','p.lon','s.lat','s.lon')} AS d FROM places p, stops s) WHERE d<=5000 QUALIFY rank<=100",
    "good_near": "SELECT *, max(good) OVER (PARTITION BY point_id) AS any_good FROM (SELECT n.*, coalesce(degree>=2,false) AS good FROM raw_near n LEFT JOIN (SELECT u, count(*) AS degree FROM edges GROUP BY 1) e ON e.u=n.stop_id)",
    "pool": "SELECT point_id, stop_id, d, CASE WHEN point_id%3<>0 THEN d*(1+(point_id+stop_id)%5*0.25e0) ELSE d END AS metres FROM good_near WHERE good OR (NOT any_good AND rank=1) QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY d, stop_id)<=50",
    "water": "SELECT * FROM (VALUES (0,30.028e0,31.205e0,30.045e0,31.205e0),(1,30.045e0,31.205e0,30.045e0,31.225e0),(2,30.045e0,31.225e0,30.036e0,31.215e0),(3,30.036e0,31.215e0,30.028e0,31.225e0),(4,30.028e0,31.225e0,30.028e0,31.205e0)) t(edge_id,a_lat,a_lon,b_lat,b_lon)",
    "far_water": f"SELECT * FROM water w WHERE NOT EXISTS (SELECT 1 FROM stops s WHERE s.stop_id%10=0 AND {_m('(a_lat+b_lat)/2','(a_lon+b_lon)/2','s.lat','s.lon')}<=500) AND EXISTS (SELECT 1 FROM stops WHERE stop_id%10=0)",
    "walk_ends": "SELECT w.u, w.v, a.lat AS p_lat, a.lon AS p_lon, b.lat AS q_lat, b.lon AS q_lon FROM walks w JOIN stops a ON a.stop_id=w.u JOIN stops b ON b.stop_id=w.v",
    "coming": f"""SELECT t.route_id, t.direction_id, t.stop_id, min(round_even({_m('f.lat','f.lon','s.lat','s.lon')}/CASE WHEN speed BETWEEN 1 AND 25 THEN speed WHEN vehicle_type='metro' THEN 11e0 WHEN vehicle_type IN ('minibus','microbus') THEN 7e0 ELSE 6e0 END,0)::bigint) AS eta_sec
        FROM last_fix f JOIN routes r ON r.route_id=f.route_id JOIN (SELECT DISTINCT route_id, direction_id, stop_id FROM visits) t ON t.route_id=f.route_id AND t.direction_id=f.direction_id JOIN stops s ON s.stop_id=t.stop_id GROUP BY 1,2,3""",
    "bends": "SELECT shape_id, seq, lat, lon, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon, count(*) OVER (PARTITION BY shape_id) AS n FROM spots WINDOW w AS (PARTITION BY shape_id ORDER BY seq)",
    "short_walks": "SELECT p.u, p.v, p.dist_m, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2, greatest(3,trunc(p.dist_m/60)::int) AS steps FROM pairs p JOIN stops a ON a.stop_id=p.u JOIN stops b ON b.stop_id=p.v WHERE p.u<p.v AND p.dist_m>0 AND p.dist_m<=500",
    "samples": "SELECT u, v, i, i=0 OR i=steps AS edge, lat1+(lat2-lat1)*(i/steps) AS lat, lon1+(lon2-lon1)*(i/steps) AS lon FROM (SELECT *, unnest(range(steps+1)) AS i FROM short_walks)",
    "road_points": "SELECT DISTINCT lat, lon FROM spots",
    "gaps": "SELECT u, v, i, edge, coalesce(min(sqrt(pow((r.lat-s.lat)*111000e0,2)+pow((r.lon-s.lon)*96000e0,2))),2*0.002e0*111000e0) AS gap FROM samples s LEFT JOIN road_points r ON abs(floor(r.lat/0.002e0)-floor(s.lat/0.002e0))<=2 AND abs(floor(r.lon/0.002e0)-floor(s.lon/0.002e0))<=2 GROUP BY 1,2,3,4",
    "tracks": "SELECT trip_id AS id, seq, lat, lon FROM stop_times s JOIN stops p ON p.stop_id=s.stop_id",
}


def sql(query: str) -> str:
    """The query with the common table expressions that it needs, in order."""
    import re

    needed: set[str] = set()

    def need(text: str) -> None:
        for name in PARTS:
            if name not in needed and re.search(rf"\b(FROM|JOIN|,)\s*\(?\s*{name}\b", text):
                needed.add(name)
                need(PARTS[name])

    need(query)
    head = lambda name: f"{name} USING KEY ({KEYS[name]}) AS" if name in KEYS else f"{name} AS MATERIALIZED"
    parts = [f"{head(name)} ({PARTS[name]})" for name in PARTS if name in needed]
    return f"WITH RECURSIVE {', '.join(parts)} {query}" if parts else query


QUERIES = {
    "hop_guard": "SELECT route_id, direction_id, count(*) AS hops, sum((timed IS NULL)::int)::bigint AS guarded, round(sum(dist_m))::bigint AS metres FROM guarded GROUP BY 1,2",
    "trip_pace": "SELECT trip_id, round(max(pace)*1000)::bigint AS pace_mm_s, sum(slow::int)::bigint AS slow FROM riding GROUP BY 1",
    "hop_times": "SELECT trip_id, seq, u, v, round(sec*10)::bigint AS sec10, slow FROM riding",
    "edge_mean": "SELECT u, v, route_id, direction_id, round(sec*10)::bigint AS sec10, samples FROM edges",
    "edge_cross_route_median": "SELECT u, v, route_id, direction_id, round(sec*10)::bigint AS sec10, blended FROM blend",
    "edge_road_floor": """SELECT e.u, e.v, route_id, direction_id, round(coalesce(greatest(sec, CASE WHEN vehicle_type IN ('bus','minibus','microbus') THEN 1.6e0*e.dist_m/20e0 END),sec)*10)::bigint AS sec10 FROM edges e""",
    "headway_weighted": "SELECT route_id, direction_id, round(headway_min*10)::bigint AS headway10 FROM headways",
    "service_windows_union": "SELECT route_id, start_sec, end_sec FROM windows",
    "service_span": "SELECT min(start_sec) AS earliest, max(end_sec) AS latest FROM windows",
    "routes_closed_at": "SELECT route_id FROM closed",
    "routes_inactive_on": "SELECT route_id FROM inactive",
    "edges_runnable": "SELECT route_id, count(*) AS edges FROM blend WHERE route_id NOT IN (SELECT route_id FROM closed) AND route_id NOT IN (SELECT route_id FROM inactive) GROUP BY 1",
    "network_state": "SELECT serviced, closed, CASE WHEN closed>=serviced THEN 'outside_service_hours' ELSE 'no_route' END AS reason FROM (SELECT (SELECT count(DISTINCT route_id) FROM windows) AS serviced, (SELECT count(*) FROM closed) AS closed)",
    "walk_links": "SELECT u, v, round(dist_m*10)::bigint AS dist10, round(sec*10)::bigint AS sec10 FROM walks",
    "rail_links": """SELECT p.u, p.v, round(p.dist_m*10)::bigint AS dist10 FROM pairs p JOIN (SELECT s, list(DISTINCT m) AS m FROM (SELECT u AS s, vehicle_type AS m FROM edges WHERE vehicle_type IN ('metro','monorail','lrt','apm','tram') UNION SELECT v, vehicle_type FROM edges WHERE vehicle_type IN ('metro','monorail','lrt','apm','tram')) GROUP BY 1) a ON a.s=p.u
        JOIN (SELECT s, list(DISTINCT m) AS m FROM (SELECT u AS s, vehicle_type AS m FROM edges WHERE vehicle_type IN ('metro','monorail','lrt','apm','tram') UNION SELECT v, vehicle_type FROM edges WHERE vehicle_type IN ('metro','monorail','lrt','apm','tram')) GROUP BY 1) b ON b.s=p.v
        WHERE p.u<p.v AND p.dist_m<=750 AND NOT list_has_any(a.m,b.m) AND NOT EXISTS (SELECT 1 FROM walks w WHERE w.u=p.u AND w.v=p.v)""",
    "knn_stops": """SELECT point_id, rank, stop_id, round(dist_m*10)::bigint AS dist10 FROM (SELECT c_custkey AS point_id, stop_id, d AS dist_m, row_number() OVER (PARTITION BY c_custkey ORDER BY d,stop_id) AS rank FROM (SELECT c_custkey, stop_id,
        12742000e0*asin((0e0+sqrt(pow(sin((radians(lat)-radians(30.0e0+(c_custkey%97)*0.001e0))/2),2)+cos(radians(30.0e0+(c_custkey%97)*0.001e0))*cos(radians(lat))*pow(sin((radians(lon)-radians(31.19e0+(c_custkey%89)*0.001e0))/2),2)))) AS d FROM customer, stops) WHERE d<=5000) WHERE rank<=3""",
    "stop_degree": "SELECT u AS stop_id, count(*) AS degree FROM edges GROUP BY 1",
    "cell_representatives": """SELECT cell_x, cell_y, arg_min(stop_id, (off, stop_id)) AS stop_id, count(*) AS stops FROM (SELECT *, pow(lat-(cell_y+0.5e0)*0.01e0,2)+pow(lon-(cell_x+0.5e0)*0.01e0,2) AS off FROM (SELECT *, floor(lon/0.01e0)::bigint AS cell_x, floor(lat/0.01e0)::bigint AS cell_y FROM stops)) GROUP BY 1,2""",
    "pattern_longest": "SELECT route_id, direction_id, trip_id, len(stops)::int AS n, array_to_string(stops,',') AS stops FROM patterns",
    "pattern_variants": """SELECT route_id, direction_id, row_number() OVER (PARTITION BY route_id,direction_id ORDER BY len(stops) DESC, first_trip)::int AS variant, trips, array_to_string(stops,',') AS stops FROM (SELECT route_id, direction_id, stops, min(trip_id) AS first_trip, count(*) AS trips FROM sequences GROUP BY 1,2,3)""",
    "equivalent_routes": """SELECT journey_id, place, other, direction_id, eta_sec, same_kind FROM (SELECT *, row_number() OVER (PARTITION BY journey_id ORDER BY (other=route_id) DESC, eta_sec NULLS LAST, same_kind DESC, other) AS place FROM (SELECT j.journey_id, j.route_id, o.other, o.direction_id, c.eta_sec, x.vehicle_type=y.vehicle_type AS same_kind
        FROM (SELECT route_id*2+direction_id AS journey_id, route_id, stops[1] AS board, stops[4] AS alight FROM patterns WHERE len(stops)>=4) j JOIN (SELECT b.route_id AS other, b.stop_id AS board, a.stop_id AS alight, min(b.direction_id) AS direction_id FROM first_visits b JOIN first_visits a ON a.route_id=b.route_id AND a.direction_id=b.direction_id AND b.pos<a.pos GROUP BY 1,2,3) o ON o.board=j.board AND o.alight=j.alight
        JOIN routes x ON x.route_id=j.route_id JOIN routes y ON y.route_id=o.other LEFT JOIN coming c ON c.route_id=o.other AND c.direction_id=o.direction_id AND c.stop_id=j.board)) WHERE place<=4""",
    "route_towards": """SELECT pair_id, arg_min(stops[len(stops)], direction_id) AS terminus FROM (SELECT route_id AS pair_id, route_id, stops[2] AS f, stops[4] AS s FROM patterns WHERE direction_id=1 AND len(stops)>=4) q JOIN patterns p USING (route_id)
        WHERE list_position(stops,f)>0 AND list_position(stops,s)>list_position(stops,f) GROUP BY 1""",
    "interchange_stations": "SELECT stop_id, count(DISTINCT v.route_id) AS lines, count(DISTINCT vehicle_type) AS modes, count(DISTINCT v.route_id)>1 OR count(DISTINCT vehicle_type)>1 AS interchange FROM visits v JOIN routes r ON r.route_id=v.route_id WHERE rail GROUP BY 1",
    "coverage_overlap": """SELECT c.corridor_id, c.size, coalesce(shared,0) AS shared, route_id, round(coalesce(shared,0)/c.size*1000)::bigint AS permille FROM (SELECT trip_id AS corridor_id, count(DISTINCT stop_id) AS size FROM stop_times GROUP BY 1) c LEFT JOIN (
        SELECT corridor_id, shared, route_id FROM (SELECT *, row_number() OVER (PARTITION BY corridor_id ORDER BY shared DESC, route_id) AS n FROM (SELECT t.trip_id AS corridor_id, v.route_id, count(*) AS shared FROM (SELECT DISTINCT trip_id, stop_id FROM stop_times) t JOIN (SELECT DISTINCT route_id, stop_id FROM visits) v USING (stop_id) GROUP BY 1,2)) WHERE n=1) b USING (corridor_id)""",
}

QUERIES |= {
    "stream_report_minutes": "SELECT route_id, (floor(trunc(tm*1000)/60000)*60)::BIGINT AS minute_sec, count(*) AS reports FROM positions GROUP BY 1,2",
    "fare_banded": """SELECT trip_id, vehicle_type, hops, CASE vehicle_type WHEN 'metro' THEN CASE WHEN hops<=8 THEN 10 WHEN hops<=15 THEN 12 WHEN hops<=22 THEN 15 ELSE 20 END WHEN 'monorail' THEN CASE WHEN hops<=5 THEN 20 WHEN hops<=10 THEN 40 WHEN hops<=15 THEN 55 ELSE 80 END WHEN 'lrt' THEN CASE WHEN hops<=3 THEN 10 WHEN hops<=7 THEN 15 ELSE 20 END ELSE 0 END::bigint AS fare FROM journeys WHERE vehicle_type IN ('metro','monorail','lrt','apm')""",
    "leg_fares": """SELECT trip_id, CASE WHEN j.vehicle_type IN ('metro','monorail','lrt','apm') THEN 0 WHEN j.vehicle_type='microbus' THEN greatest(10,round_even(metres/1000*1.25e0,0)::bigint) WHEN agency_id='GRN' THEN 25 WHEN j.vehicle_type='tram' THEN 0 ELSE 20 END::bigint AS fare FROM journeys j JOIN routes r ON r.route_id=j.route_id""",
    "expected_waits": """SELECT route_id, direction_id, round(least(coalesce(nullif(headway_min,0),20e0)*30,1200e0)*10)::bigint AS wait10, round(greatest(least(coalesce(nullif(headway_min,0),20e0)*30,1200e0),420e0)*10)::bigint AS later10 FROM (SELECT DISTINCT route_id, direction_id FROM trips) t LEFT JOIN headways h USING (route_id, direction_id)""",
    "walk_offers": """SELECT c_custkey, ok AS plausible, d<=3000 AND (w<=2.2e0*d OR w<=4500) AND ok AS offered FROM (SELECT *, w<=4500 AND w<=greatest(d*1.6e0,d+400) AS ok FROM (SELECT c_custkey, (c_custkey%5000+1)::double AS d, (c_custkey%5000+1)*(1+c_custkey%7*0.25e0) AS w FROM customer))""",
    "gtfs_times": """SELECT trip_id, seq, printf('%02d:%02d:%02d', t//3600, t%3600//60, t%60) AS text, t::int AS sec FROM stop_times""",
    "order_clock": """SELECT event_id, lower(dayname(ts)) AS dow, (hour(ts)*3600+minute(ts)*60+second(ts))::int AS sec, strftime(CASE WHEN date_trunc('day',ts+INTERVAL 3 HOUR)+INTERVAL 9 HOUR>ts+INTERVAL 3 HOUR THEN date_trunc('day',ts+INTERVAL 3 HOUR)+INTERVAL 6 HOUR ELSE date_trunc('day',ts+INTERVAL 3 HOUR)+INTERVAL 30 HOUR END,'%Y-%m-%dT%H:%M:%SZ') AS next,
        CASE WHEN round_even(value,0)>=60 THEN printf('%dh%02dm', round_even(value,0)::bigint//60, round_even(value,0)::bigint%60) ELSE printf('%dm', round_even(value,0)::bigint) END AS text FROM events""",
    "corridor_anchors": "SELECT id AS corridor_id, unnest(range(len(line)))::int AS n, unnest(list_transform(line, lambda x: x.id)) AS stop_id FROM (SELECT id, line FROM thinned QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC)=1)",
    "search_rounds": "SELECT od_id, stop_id, round(min(cost)*10)::bigint AS cost10 FROM reached WHERE route_id=-1 GROUP BY 1,2",
    "search_recommended": "SELECT od_id, stop_id, round(min(cost)*10)::bigint AS cost10 FROM reached_recommended WHERE route_id=-1 GROUP BY 1,2",
    "search_cheapest": "SELECT od_id, stop_id, round(min(cost)*10)::bigint AS cost10 FROM reached_cheapest WHERE route_id=-1 GROUP BY 1,2",
    "shape_lengths": """SELECT shape_id, count(*) AS points, round(max(along))::bigint AS metres FROM spot_along GROUP BY 1""",
    "shape_along": """SELECT shape_id AS query_id, s1<=500 AND s2<=500 AS on_shape, round(CASE WHEN s1<=500 AND s2<=500 THEN abs(a2-a1) ELSE 12742000e0*asin((0e0+sqrt(pow(sin((radians(lat2)-radians(lat1))/2),2)+cos(radians(lat1))*cos(radians(lat2))*pow(sin((radians(lon2)-radians(lon1))/2),2)))) END)::bigint AS metres FROM (SELECT q.shape_id, lat1, lon1, lat2, lon2, min(d1) AS s1, arg_min(along,(d1,seq)) AS a1, min(d2) AS s2, arg_min(along,(d2,seq)) AS a2 FROM (
        SELECT q.*, p.seq, p.along, 12742000e0*asin((0e0+sqrt(pow(sin((radians(p.lat)-radians(lat1))/2),2)+cos(radians(lat1))*cos(radians(p.lat))*pow(sin((radians(p.lon)-radians(lon1))/2),2)))) AS d1, 12742000e0*asin((0e0+sqrt(pow(sin((radians(p.lat)-radians(lat2))/2),2)+cos(radians(lat2))*cos(radians(p.lat))*pow(sin((radians(p.lon)-radians(lon2))/2),2)))) AS d2 FROM (SELECT shape_id, arg_min(lat,seq) FILTER (seq=2)+0.0001e0 AS lat1, arg_min(lon,seq) FILTER (seq=2)+0.0001e0 AS lon1, arg_max(lat,seq)+0.0002e0 AS lat2, arg_max(lon,seq)+0.0002e0 AS lon2 FROM spots GROUP BY 1 HAVING max(seq)>=3) q JOIN spot_along p USING (shape_id)) q GROUP BY 1,2,3,4,5)""",
    "boundary_flips": """SELECT shape_id, seq, round((lat+blat)/2*1e5)::bigint AS lat5, round((lon+blon)/2*1e5)::bigint AS lon5 FROM (SELECT *, lag(boxed) OVER w AS bb, lag(ins) OVER w AS bi, lag(lat) OVER w AS blat, lag(lon) OVER w AS blon FROM (SELECT *, lat BETWEEN 30.0e0 AND 30.06e0 AND lon BETWEEN 31.19e0 AND 31.25e0 AS boxed, (((((30.045e0>lat)<>(30.028e0>lat)) AND lon<(lat-30.045e0)*((31.205e0-31.205e0)/(30.028e0-30.045e0))+31.205e0)::int+(((30.036e0>lat)<>(30.045e0>lat)) AND lon<(lat-30.036e0)*((31.225e0-31.215e0)/(30.045e0-30.036e0))+31.215e0)::int+(((30.028e0>lat)<>(30.036e0>lat)) AND lon<(lat-30.028e0)*((31.215e0-31.225e0)/(30.036e0-30.028e0))+31.225e0)::int)%2=1) AS ins FROM spots) WINDOW w AS (PARTITION BY shape_id ORDER BY seq)) WHERE boxed AND bb AND ins<>bi""",
    "point_in_polygon": """SELECT stop_id, (((((30.045e0>lat)<>(30.028e0>lat)) AND lon<(lat-30.045e0)*((31.205e0-31.205e0)/(30.028e0-30.045e0))+31.205e0)::int+(((30.036e0>lat)<>(30.045e0>lat)) AND lon<(lat-30.036e0)*((31.225e0-31.215e0)/(30.045e0-30.036e0))+31.215e0)::int+(((30.028e0>lat)<>(30.036e0>lat)) AND lon<(lat-30.028e0)*((31.215e0-31.225e0)/(30.036e0-30.028e0))+31.225e0)::int)%2=1) AS inside FROM stops""",
    "spur_detect": """SELECT DISTINCT a.shape_id AS seq_id FROM spots a JOIN spots b ON a.shape_id=b.shape_id AND b.seq>=a.seq+4 WHERE 12742000e0*asin((0e0+sqrt(pow(sin((radians(b.lat)-radians(a.lat))/2),2)+cos(radians(a.lat))*cos(radians(b.lat))*pow(sin((radians(b.lon)-radians(a.lon))/2),2))))<600 AND EXISTS (SELECT 1 FROM spots m WHERE m.shape_id=a.shape_id AND m.seq>a.seq AND m.seq<b.seq AND 12742000e0*asin((0e0+sqrt(pow(sin((radians(m.lat)-radians(a.lat))/2),2)+cos(radians(a.lat))*cos(radians(m.lat))*pow(sin((radians(m.lon)-radians(a.lon))/2),2))))>=1500)""",
    "live_latest": """SELECT session_id, route_id, direction_id, fixes, round(speed*1000)::bigint AS mm_s, round(tm*1000)::bigint AS at_ms FROM last_fix""",
    "coverage_cube": """SELECT origin, destination, count(*) AS pairs, round_even(avg(answered::int::double)*100,1) AS answered_pct, round_even(avg(complete::int::double)*100,1) AS complete_pct, grouping(origin,destination)::int AS level FROM (SELECT a.name AS origin, b.name AS destination, cost IS NOT NULL AS answered, coalesce(cost<=1500,false) AS complete
        FROM zones a JOIN zones b ON a.name<>b.name LEFT JOIN (SELECT od_id, stop_id, min(cost) AS cost FROM zoned WHERE route_id=-1 AND mask>=65536 GROUP BY 1,2) r ON r.od_id=a.stop_id AND r.stop_id=b.stop_id) GROUP BY GROUPING SETS ((origin),(destination),())""",
    "suspicious_pairs": """SELECT u, v, round(d/s*10)::bigint AS speed10 FROM (SELECT u, v, min(sec) AS s, any_value(dist_m) AS d FROM edges WHERE vehicle_type IN ('bus','minibus','microbus') AND dist_m>=300 GROUP BY 1,2) WHERE s>0 AND d/s>8""",
    "ab_compare": """SELECT CASE WHEN b<a THEN 'better' WHEN b>a THEN 'worse' ELSE 'same' END AS outcome, count(*) AS pairs FROM (SELECT ceil(e.sec/60) AS a, ceil(x.sec/60) AS b FROM edges e JOIN blend x USING (u,v,route_id,direction_id)) GROUP BY 1""",
    "step_upper_median": """SELECT route_id, round(list_sort(list(dist_m))[(count(*)//2+1)::int]*10)::bigint AS upper10, round(median(dist_m)*10)::bigint AS median10 FROM hops GROUP BY 1""",
    "bbox_errors": """SELECT CASE WHEN lat IS NULL OR lon IS NULL THEN 'missing' WHEN lat NOT BETWEEN 22 AND 32 OR lon NOT BETWEEN 24 AND 37 THEN 'outside' ELSE 'ok' END AS code, count(*) AS n FROM (SELECT CASE WHEN session_id%11=0 THEN lat+10 ELSE lat END AS lat, lon FROM positions) GROUP BY 1""",
    "hop_apportioned": """SELECT route_id AS line, direction_id, pos, round_even(d/nullif(sum(d) OVER (PARTITION BY route_id, direction_id),0)*40*60,0)::bigint AS hop_sec FROM (SELECT route_id, direction_id, seq AS pos, 12742000e0*asin((0e0+sqrt(pow(sin((radians(lead(lat) OVER w)-radians(lat))/2),2)+cos(radians(lat))*cos(radians(lead(lat) OVER w))*pow(sin((radians(lead(lon) OVER w)-radians(lon))/2),2)))) AS d FROM spots WINDOW w AS (PARTITION BY shape_id ORDER BY seq)) WHERE d IS NOT NULL""",
    "corridor_timetable": """SELECT route_id, direction_id, (pos+1)::int AS seq, stop_id, sec, printf('%02d:%02d:%02d', sec//3600, sec%3600//60, sec%60) AS time FROM (SELECT *, (21600+sum(step) OVER (PARTITION BY route_id,direction_id ORDER BY pos ROWS UNBOUNDED PRECEDING))::bigint AS sec FROM (SELECT *, coalesce(trunc(12742000e0*asin((0e0+sqrt(pow(sin((radians(lat)-radians(lag(lat) OVER w))/2),2)+cos(radians(lag(lat) OVER w))*cos(radians(lat))*pow(sin((radians(lon)-radians(lag(lon) OVER w))/2),2))))*1.3e0/5.61e0)::bigint+20,0) AS step FROM (
        SELECT route_id, 0 AS direction_id, seq-1 AS pos, stop_id, lat, lon FROM spots WHERE direction_id=0 UNION ALL SELECT route_id, 1, max(seq) OVER (PARTITION BY route_id)-seq, stop_id, lat, lon FROM spots WHERE direction_id=0) WINDOW w AS (PARTITION BY route_id,direction_id ORDER BY pos)))""",
    "route_detail": """SELECT direction_id, variant, variant=1 AS main, pos::int AS pos, v.stop_id, stop_name FROM (SELECT direction_id, variant, unnest(stops) AS stop_id, unnest(range(len(stops))) AS pos FROM (SELECT route_id, direction_id, stops, row_number() OVER (PARTITION BY route_id,direction_id ORDER BY len(stops) DESC, first_trip)::int AS variant FROM (SELECT route_id, direction_id, stops, min(trip_id) AS first_trip FROM sequences GROUP BY 1,2,3)) WHERE route_id=3) v JOIN stops s ON s.stop_id=v.stop_id""",
    "route_cards": """SELECT p.route_id, nullif(regexp_replace(route_short_name,'[^0-9]','','g'),'') AS number, vehicle_type, a.stop_name AS "from", b.stop_name AS "to", len(stops)::int AS stop_count, round(headway_min*10)::bigint AS headway10, reconstructed, CASE WHEN vehicle_type IN ('metro','monorail','lrt','apm','microbus') THEN NULL WHEN agency_id='GRN' THEN 25 WHEN vehicle_type='tram' THEN 0 ELSE 20 END::bigint AS fare
        FROM (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY direction_id) AS n FROM patterns) p JOIN routes r ON r.route_id=p.route_id JOIN stops a ON a.stop_id=p.stops[1] JOIN stops b ON b.stop_id=p.stops[len(p.stops)] LEFT JOIN headways h ON h.route_id=p.route_id AND h.direction_id=p.direction_id WHERE n=1""",
    "match_contains": """SELECT landmark, stop_id, matched FROM (SELECT l.landmark, n.stop_id, n.k AS matched, row_number() OVER (PARTITION BY l.landmark ORDER BY abs(length(n.k)-length(l.k)), n.k, n.stop_id) AS r FROM (SELECT DISTINCT p_name AS landmark, replace(p_name,' ','') AS k FROM part) l JOIN (SELECT replace(p_name||p_type,' ','') AS k, min(p_partkey) AS stop_id FROM part GROUP BY 1) n
        ON n.k<>l.k AND length(l.k)>=5 AND length(n.k)>=5 AND (contains(n.k,l.k) OR contains(l.k,n.k)) AND least(length(n.k),length(l.k))/greatest(length(n.k),length(l.k))>=0.45e0) WHERE r=1""",
    "live_active": """SELECT route_id, count(*) AS active FROM last_fix GROUP BY 1""",
    "rail_plan": "SELECT stop_id, min(cost)::bigint AS cost FROM railed WHERE route_id=-1 GROUP BY 1",
    "live_eta": """SELECT session_id, round_even(d/v,0)::bigint AS eta_sec, round_even(d,0)::bigint AS distance_m, round_even((SELECT min(tm)+4000 FROM positions)-tm,0)::bigint AS age_sec FROM (SELECT *, 12742000e0*asin((0e0+sqrt(pow(sin((radians(30.05e0)-radians(lat))/2),2)+cos(radians(lat))*cos(radians(30.05e0))*pow(sin((radians(31.22e0)-radians(lon))/2),2)))) AS d, CASE WHEN speed BETWEEN 1 AND 25 THEN speed WHEN vehicle_type='metro' THEN 11e0 WHEN vehicle_type IN ('minibus','microbus') THEN 7e0 ELSE 6e0 END AS v FROM last_fix f JOIN routes r ON r.route_id=f.route_id)""",
    "bounded_reach": "SELECT source_id, stop_id, round(m*10)::bigint AS metres10 FROM walked",
    "route_search": """SELECT route_id, 1 AS rank, number, stop_count FROM cards WHERE vehicle_type='minibus' AND contains(lower(concat_ws(' ',number,route_long_name,first,last,route_short_name)),'1')""",
    "corridor_gates": """SELECT reason, count(*) AS corridors FROM (SELECT id, CASE WHEN id%3=0 AND id%101/100e0>=0.5e0 THEN 'covered' WHEN id%3<>0 AND id%101/100e0>=0.98e0 AND id%2=0 THEN 'duplicate' WHEN id%4<1 THEN 'gap' WHEN n<5 THEN 'few stops' WHEN km/(1+id%9*0.1e0)>0.5e0 AND km/(km/(1+id%9*0.1e0))>1.6e0 THEN 'wanders' WHEN km>80 THEN 'too long' WHEN od>2 AND km/od>3.2e0 THEN 'zigzag'
        WHEN id IN (SELECT a.id FROM tracks a JOIN tracks b ON a.id=b.id AND abs(a.seq-b.seq)>=4 JOIN tracks m ON m.id=a.id AND m.seq>least(a.seq,b.seq) AND m.seq<greatest(a.seq,b.seq) WHERE 12742000e0*asin((0e0+sqrt(pow(sin((radians(b.lat)-radians(a.lat))/2),2)+cos(radians(a.lat))*cos(radians(b.lat))*pow(sin((radians(b.lon)-radians(a.lon))/2),2))))<1200 AND 12742000e0*asin((0e0+sqrt(pow(sin((radians(m.lat)-radians(a.lat))/2),2)+cos(radians(a.lat))*cos(radians(m.lat))*pow(sin((radians(m.lon)-radians(a.lon))/2),2))))>=3500) THEN 'spur' ELSE 'picked' END AS reason
        FROM (SELECT id, count(*) AS n, coalesce(sum(d),0)/1000 AS km, 12742000e0*asin((0e0+sqrt(pow(sin((radians(arg_max(lat,seq))-radians(arg_min(lat,seq)))/2),2)+cos(radians(arg_min(lat,seq)))*cos(radians(arg_max(lat,seq)))*pow(sin((radians(arg_max(lon,seq))-radians(arg_min(lon,seq)))/2),2))))/1000 AS od FROM (SELECT *, 12742000e0*asin((0e0+sqrt(pow(sin((radians(lat)-radians(lag(lat) OVER w))/2),2)+cos(radians(lag(lat) OVER w))*cos(radians(lat))*pow(sin((radians(lon)-radians(lag(lon) OVER w))/2),2)))) AS d FROM tracks WINDOW w AS (PARTITION BY id ORDER BY seq)) GROUP BY 1)) GROUP BY 1""",
    "stops_along_shape": """SELECT shape_id, count(*) AS stops, round(max(off))::bigint AS farthest FROM (SELECT shape_id, stop_id, min(sqrt(pow(px-t*qx,2)+pow(py-t*qy,2))) AS off FROM (SELECT *, CASE WHEN qx*qx+qy*qy>0 THEN least(1e0,greatest(0e0,(px*qx+py*qy)/(qx*qx+qy*qy))) ELSE 0e0 END AS t FROM (
        SELECT g.shape_id, s.stop_id, (s.lon-g.lon)*cos(radians(s.lat))*111320 AS px, (s.lat-g.lat)*111320e0 AS py, (lon2-g.lon)*cos(radians(s.lat))*111320 AS qx, (lat2-g.lat)*111320e0 AS qy FROM (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM spots WINDOW w AS (PARTITION BY shape_id ORDER BY seq)) g, stops s WHERE lat2 IS NOT NULL)) GROUP BY 1,2) WHERE off<=120 GROUP BY 1""",
}

QUERIES |= {
    "stop_clusters": _canonical("heads_150", 150, "s.stop_name"),
    "grid_clusters": _canonical("heads_60", 60, "1"),
    "stop_times_canonical": "SELECT canonical_id AS stop_id, count(*) AS visits, count(DISTINCT trip_id) AS trips FROM stop_times s JOIN merged_1000 m ON m.stop_id=s.stop_id GROUP BY 1",
    "snapped_stops": "SELECT point_id, rank, stop_id, round(metres*10)::bigint AS metres10 FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY metres, stop_id)::int AS rank FROM pool) WHERE rank<=3",
    "nearest_hubs": f"SELECT point_id, arg_min(stop_id, (d, stop_id)) AS stop_id, round(min(d))::bigint AS metres FROM (SELECT point_id, stop_id, {_m('(p.lat+CASE WHEN point_id%10=0 THEN 5e0 ELSE 0e0 END)', 'p.lon', 's.lat', 's.lon')} AS d FROM places p, stops s) GROUP BY 1",
    "water_crossings": f"SELECT u, v FROM walk_ends w WHERE NOT EXISTS (SELECT 1 FROM (SELECT a_lat, a_lon, b_lat, b_lon FROM far_water) f WHERE {_turn('p', 'a', 'b')}<>{_turn('q', 'a', 'b')} AND {_turn('p', 'q', 'a')}<>{_turn('p', 'q', 'b')})",
    "route_facts": """SELECT r.route_id, direction_id, nullif(regexp_replace(route_short_name,'[^0-9]','','g'),'') AS number, CASE vehicle_type WHEN 'metro' THEN '#6DA4C2' WHEN 'monorail' THEN '#9C6DC2' WHEN 'lrt' THEN '#4DA89B' WHEN 'tram' THEN '#C2A76D' WHEN 'apm' THEN '#8895A0' WHEN 'minibus' THEN '#D4A373' WHEN 'microbus' THEN '#C77DFF' ELSE '#E29578' END AS colour,
        CASE WHEN vehicle_type IN ('metro','monorail','lrt','apm','microbus') THEN NULL WHEN agency_id='GRN' THEN 25 WHEN vehicle_type='tram' THEN 0 ELSE 20 END::bigint AS fare, CASE vehicle_type WHEN 'metro' THEN '8:10;15:12;22:15;:20' WHEN 'monorail' THEN '5:20;10:40;15:55;:80' WHEN 'lrt' THEN '3:10;7:15;:20' WHEN 'apm' THEN ':0' END AS bands, first_sec, last_sec, round(headway_min*10)::bigint AS headway10
        FROM routes r LEFT JOIN (SELECT route_id, min(start_sec) AS first_sec, max(end_sec) AS last_sec FROM windows GROUP BY 1) w ON w.route_id=r.route_id LEFT JOIN headways h ON h.route_id=r.route_id""",
    "station_list": "SELECT v.stop_id, stop_name AS name, array_to_string(list_sort(list(DISTINCT v.route_id)),',') AS lines, array_to_string(list_sort(list(DISTINCT vehicle_type)),',') AS modes, count(DISTINCT v.route_id)>1 OR count(DISTINCT vehicle_type)>1 AS interchange FROM visits v JOIN routes r ON r.route_id=v.route_id JOIN stops s ON s.stop_id=v.stop_id WHERE vehicle_type IN ('metro','tram') GROUP BY 1,2",
    "name_frequencies": "SELECT stop_name, count(*) AS n FROM stop_times t JOIN stops s ON s.stop_id=t.stop_id GROUP BY 1",
    "report_errors": "SELECT CASE WHEN session_id%13=0 THEN 'missing' WHEN lat NOT BETWEEN 22 AND 32 OR lon NOT BETWEEN 24 AND 37 THEN 'outside' ELSE 'taken' END AS error, count(*) AS n FROM (SELECT session_id, CASE WHEN session_id%11=0 THEN lat+10 ELSE lat END AS lat, lon FROM positions) GROUP BY 1",
    "barrier_flags": "SELECT u, v, round(ends)::bigint AS ends, round(worst)::bigint AS worst FROM (SELECT u, v, max(gap) FILTER (edge) AS ends, max(gap) FILTER (NOT edge) AS worst FROM gaps GROUP BY 1,2) WHERE ends<=150 AND worst>=180 AND worst>=greatest(ends,30e0)*2.5e0",
    "needle_spikes": f"""SELECT shape_id, n::int AS before, CASE WHEN n>4 THEN len(list_reduce(list([{{'lat':lat,'lon':lon,'nlat':nlat,'nlon':nlon}}] ORDER BY seq) FILTER (nlat IS NOT NULL), lambda acc, x: CASE WHEN {_m('acc[len(acc)].lat', 'acc[len(acc)].lon', 'x[1].lat', 'x[1].lon')}>800 AND {_m('x[1].lat', 'x[1].lon', 'x[1].nlat', 'x[1].nlon')}>800
        AND {_m('acc[len(acc)].lat', 'acc[len(acc)].lon', 'x[1].nlat', 'x[1].nlon')}<120 THEN acc ELSE list_concat(acc, x) END))+1 ELSE n END::int AS after FROM bends GROUP BY shape_id, n""",
}


def oracle() -> dict[str, str]:
    return {name: sql(query) for name, query in QUERIES.items()}
