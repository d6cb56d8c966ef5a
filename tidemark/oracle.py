"""The same results in plain SQL, written independently of the operators.

Percentiles come from ``quantile_disc`` over raw rows, legs from brute-force
products, points from an unindexed join, routes from flat rows instead of documents.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

_BLOCKS = (("early", 0, 420), ("am", 420, 600), ("midday", 600, 960), ("pm", 960, 1140), ("evening", 1140, 1440))
_BLOCK_ROWS = "(VALUES (0,'early',0,420),(1,'am',420,600),(2,'midday',600,960),(3,'pm',960,1140),(4,'evening',1140,1440)) AS b(pos, block, lo, hi)"


def _block(ts: str) -> str:
    minute = f"(hour({ts})*60+minute({ts}))"
    arms = " ".join(f"WHEN {minute} < {end} THEN '{name}'" for name, _, end in _BLOCKS)
    return f"CASE {arms} END"


def _tenth(x: str) -> str:
    """Half-even to one decimal on the binary value."""
    k, s = f"floor(({x})*10e0)", f"(({x})*134217729e0)"
    high = f"({s}-({s}-({x})))"
    beyond = f"(({high}*20e0-({k}*2e0+1e0))+(({x})-{high})*20e0)"
    return f"(({k}+CASE WHEN {beyond}>0 THEN 1e0 WHEN {beyond}<0 THEN 0e0 ELSE abs({k}%2) END)/10e0)"


_TRIPS = f"""raw AS (
  SELECT l_suppkey % 4 AS airport, l_partkey % 40 AS origin, l_returnflag AS company,
    l_shipdate + to_seconds((l_orderkey*7919 + l_partkey*104729 + l_linenumber*3571) % 86400) AS pickup,
    CAST(l_quantity AS BIGINT)*120 + l_partkey % 600 AS trip_time, l_orderkey % 41 - 20 AS noise,
    CAST(round(l_extendedprice*100) AS BIGINT)//1000 AS base_cents,
    CASE WHEN l_linenumber <> 7 THEN (l_partkey % 7)*100 END AS tolls_cents, (l_suppkey % 100)*9 AS tip_cents,
    CAST(l_quantity AS BIGINT)*40 + l_orderkey % 173 AS miles, l_suppkey % 2 AS leg,
    strftime(l_shipdate, '%Y-%m') AS year_month
  FROM lineitem),
trips AS (
  SELECT *, {_block("pickup")} AS block, trip_time AS dur_s, trip_time + noise AS gap_s,
    (coalesce(base_cents,0)+coalesce(tolls_cents,0)-coalesce(tip_cents,0))/100e0 AS fare,
    isodow(pickup) <= 5 AS working, least(trip_time//60, 90) AS minutes
  FROM raw),
good AS (
  SELECT *, least(CAST(round(fare) AS INT), 300) AS dollars FROM trips
  WHERE airport IN (0,1,2) AND working AND dur_s > 0 AND dur_s < 21600 AND fare BETWEEN 0 AND 500)"""

_ZONES = """zones AS (
  SELECT zone, 'ZONE_' || zone AS name, CASE zone WHEN 3 THEN 'Unknown' WHEN 17 THEN 'N/A' ELSE r_name END AS borough
  FROM (SELECT DISTINCT CAST(p_partkey % 40 AS INT) AS zone FROM part) LEFT JOIN region ON zone % 5 = r_regionkey),
reportable AS (
  SELECT * FROM zones WHERE zone NOT IN (0,1,2) AND borough NOT IN ('Unknown','N/A') AND name NOT LIKE 'Unknown zone%')"""

_CELLS = f"""time_cells AS (
  SELECT airport, origin, coalesce(block,'day') AS grain, count(*) AS n, sum(minutes)/CAST(count(*) AS DOUBLE) AS mean,
    quantile_disc(minutes, 0.5) AS p50, quantile_disc(minutes, 0.9) AS p90, quantile_disc(minutes, 0.95) AS p95,
    quantile_disc(dollars, 0.5) AS fare, quantile_disc(dollars, 0.9) AS fare_p90
  FROM good WHERE origin IN (SELECT zone FROM reportable)
  GROUP BY GROUPING SETS ((airport, origin, block), (airport, origin))),
cells AS (
  SELECT airport, origin, grain, CAST(n AS BIGINT) AS n, {_tenth("mean")} AS mean, CAST(p50 AS INT) AS p50,
    CAST(p90 AS INT) AS p90, CAST(p95 AS INT) AS p95, CAST(fare AS INT) AS fare, CAST(fare_p90 AS INT) AS fare_p90
  FROM time_cells WHERE n >= 30)"""

_SEGMENTS = """seg AS (
  SELECT leg, date_trunc('month', pickup) AS m, isodow(pickup) AS dow, hour(pickup) AS hr, count(*) AS n,
    CAST(sum(trip_time) AS DOUBLE)/CAST(count(*) AS DOUBLE)/60e0 AS att
  FROM raw GROUP BY ALL),
seg_rows AS (
  SELECT 'L' || leg AS route_id, CASE WHEN m < TIMESTAMP '1998-06-01' THEN 'v1' ELSE 'v2' END AS dataset,
    strftime(m, '%Y-%m') AS year_month, dow, hr, n, att, CASE WHEN n % 17 <> 16 THEN leg + 4e0 END AS dist,
    (leg + 4e0)/att*60e0 AS speed FROM seg)"""

_LEGS = f"""leg_work AS (SELECT s.*, b.block FROM seg_rows s JOIN {_BLOCK_ROWS} ON hr*60 >= lo AND hr*60 < hi WHERE dow <= 5),
leg_lists AS (
  SELECT route_id, block, count(*) AS cells, sum(n)/CAST(count(*) AS DOUBLE) AS bpc, median(att) AS med,
    list(att ORDER BY att) AS v FROM leg_work GROUP BY ALL HAVING count(*) >= 10),
leg_sum AS (
  SELECT route_id, block, CAST(cells AS BIGINT) AS cells, {_tenth("bpc")} AS buses_per_cell, {_tenth("med")} AS typical,
    {_tenth("v[CAST(floor(0.1*(cells-1)) AS INT)+1]")} AS low, {_tenth("v[CAST(floor(0.9*(cells-1)) AS INT)+1]")} AS high,
    {_tenth("v[cells]")} AS worst_cell FROM leg_lists),
leg_tot AS (SELECT route_id, CAST(count(DISTINCT year_month) AS BIGINT) AS months, CAST(sum(n) AS BIGINT) AS buses_observed FROM leg_work GROUP BY 1)"""

_RIDES = f"""ev AS (
  SELECT event_type AS route, CAST(user_id % 12 AS INT) AS station, {_block("ts")} AS block,
    least(CAST(floor(value) AS INT), 180) AS minutes FROM events),
rides AS (
  SELECT route, station, ev.block, count(*) AS n, quantile_disc(minutes, 0.5) AS p50, quantile_disc(minutes, 0.9) AS p90,
    (1 + (station*7 + length(route)*3 + b.pos) % 13)/4e0 AS median_wait
  FROM ev JOIN {_BLOCK_ROWS} ON b.block = ev.block GROUP BY route, station, ev.block, b.pos),
waits AS (SELECT *, greatest(1, CAST(round_even(median_wait*2, 0) AS INT)) AS headway FROM rides)"""

_JOURNEYS = f"""links(airport, link_pos, route_pos, route, conn, link, r_lo, r_hi, w_lo, w_hi) AS (VALUES
  (0,0,0,'click',8,'rail',10,15,0,10), (0,1,0,'view',11,'rail',8,12,0,10), (0,1,1,'purchase',11,'rail',8,12,0,10),
  (1,0,0,'error',5,'bus',NULL,NULL,0,12), (1,1,0,'signup',11,'bus',NULL,NULL,0,12)),
dirs(dir) AS (VALUES (0),(1),(2)),
placed AS (
  SELECT l.*, r.station, r.block, r.n, d.dir, r.p50 + d.dir AS ride_p50, r.p90 + d.dir AS ride_p90, r.median_wait, r.headway,
    CASE d.dir WHEN 0 THEN r.station WHEN 1 THEN 11 - r.station ELSE r.station*5 % 12 END AS idx,
    CASE d.dir WHEN 0 THEN conn WHEN 1 THEN 11 - conn ELSE conn*5 % 12 END AS target
  FROM links l JOIN waits r USING (route) CROSS JOIN dirs d),
ahead AS (SELECT * FROM placed WHERE idx < target)"""

_BEST = f"""ranges AS (
  SELECT block, CAST(trunc(low) AS INT) AS s_lo, greatest(CAST(trunc(high) AS INT), CAST(trunc(low) AS INT) + 1) AS s_hi
  FROM leg_sum WHERE route_id = 'L0'),
ranged AS (
  SELECT a.*, coalesce(r_lo, s_lo) AS lo, coalesce(r_hi, s_hi) AS hi FROM ahead a LEFT JOIN ranges USING (block)
  WHERE n >= 30 AND coalesce(r_lo, s_lo) IS NOT NULL),
combos AS (SELECT DISTINCT headway, w_lo, w_hi, lo, hi FROM ranged),
overhead AS (
  SELECT c.*, quantile_disc(least(i + j + k + l, 180), 0.5) AS o50, quantile_disc(least(i + j + k + l, 180), 0.9) AS o90
  FROM combos c, range(0, 40) t1(i), range(3, 9) t2(j), range(0, 20) t3(k), range(0, 181) t4(l)
  WHERE i <= headway AND k BETWEEN w_lo AND w_hi AND l BETWEEN lo AND hi GROUP BY ALL),
doors AS (
  SELECT r.*, o50, o90, ride_p50 + o50 AS d50, ride_p90 + o90 AS d90
  FROM ranged r JOIN overhead USING (headway, w_lo, w_hi, lo, hi)),
latest AS (
  SELECT * FROM doors QUALIFY dir = max(dir) OVER (PARTITION BY airport, link_pos, route_pos, station)),
typed AS (
  SELECT *, sum(d50) OVER w / CAST(count(*) OVER w AS DOUBLE) AS typical FROM latest
  WINDOW w AS (PARTITION BY airport, link_pos, route_pos, station)),
best AS (
  SELECT * FROM typed QUALIFY dense_rank() OVER (PARTITION BY airport, station ORDER BY typical, link_pos, route_pos) = 1)"""

_COMPARE = f"""station_zone AS (
  SELECT CAST(p_partkey % 40 AS INT) AS zone, CAST(p_partkey*7 % 12 AS INT) AS station, min(p_partkey) AS pos FROM part GROUP BY ALL),
zone_best AS (
  SELECT airport, zone, station, route, link, conn FROM (SELECT DISTINCT airport, station, route, link, conn, typical FROM best)
  JOIN station_zone USING (station)
  QUALIFY row_number() OVER (PARTITION BY airport, zone ORDER BY typical, pos) = 1),
transit AS (
  SELECT z.airport, z.zone, b.block, b.d50, b.d90 FROM zone_best z JOIN best b ON b.airport = z.airport AND b.station = z.station),
car_zone AS (SELECT airport, origin AS zone FROM cells WHERE grain = 'day'),
keys AS (
  SELECT airport, zone, block FROM (
    SELECT airport, origin AS zone, grain AS block FROM cells WHERE grain <> 'day'
    UNION SELECT airport, zone, block FROM transit) JOIN car_zone USING (airport, zone)),
cmp AS (
  SELECT k.airport, k.zone, coalesce(z.name, CAST(k.zone AS VARCHAR)) AS name, coalesce(z.borough, '') AS borough, k.block,
    c.p50 AS car_p50, c.p90 AS car_p90, c.n AS car_n, c.fare AS car_fare,
    CAST(t.d50 AS INT) AS transit_p50, CAST(t.d90 AS INT) AS transit_p90,
    CASE WHEN t.d90 IS NOT NULL THEN CASE k.airport WHEN 0 THEN 11.75e0 WHEN 1 THEN 3e0 END END AS transit_fare,
    CAST(least(c.p90, t.d90) AS INT) AS lead_minutes,
    CASE WHEN c.p90 IS NULL THEN 'transit only' WHEN t.d90 IS NULL THEN 'car only'
      WHEN abs(c.p90 - t.d90) < 5 THEN 'too close to call' WHEN c.p90 > t.d90 THEN 'transit' ELSE 'car' END AS verdict,
    c.p90 - c.p50 AS car_buffer, CAST(abs(c.p90 - t.d90) AS INT) AS margin,
    'S' || v.station AS station, v.route, v.link, 'S' || v.conn AS connector,
    CASE WHEN v.station IS NOT NULL THEN CASE k.airport WHEN 0 THEN 'rail' WHEN 1 THEN 'rail and bus' END END AS transit_evidence,
    CASE WHEN c.p90 IS NOT NULL THEN 'recorded trips' END AS car_evidence
  FROM keys k LEFT JOIN cells c ON c.airport = k.airport AND c.origin = k.zone AND c.grain = k.block
  LEFT JOIN transit t ON t.airport = k.airport AND t.zone = k.zone AND t.block = k.block
  LEFT JOIN zone_best v ON v.airport = k.airport AND v.zone = k.zone
  LEFT JOIN zones z ON z.zone = k.zone)"""

_SHAPES = """corner(part, ring, n, seq, dx, dy, ux, uy) AS (VALUES
  (0,0,8,0,0e0,0e0,0,0), (0,0,8,1,10e0,0e0,0,1), (0,0,8,2,20e0,0e0,0,0), (0,0,8,3,20e0,10e0,-1,0),
  (0,0,8,4,20e0,20e0,0,0), (0,0,8,5,10e0,20e0,0,-1), (0,0,8,6,0e0,20e0,0,0), (0,0,8,7,0e0,10e0,1,0),
  (0,1,4,0,5e0,5e0,0,0), (0,1,4,1,5e0,15e0,0,0), (0,1,4,2,15e0,15e0,0,0), (0,1,4,3,15e0,5e0,0,0),
  (1,0,4,0,205e0,9e0,0,0), (1,0,4,1,205.5e0,9e0,0,0), (1,0,4,2,205.5e0,9.5e0,0,0), (1,0,4,3,205e0,9.5e0,0,0)),
vert AS (
  SELECT c_custkey AS zone, c_name AS name, part, ring, n, seq,
    (c_custkey % 400)*20 + (dx + ux*((c_custkey % 5)*0.00015e0)) AS x,
    (c_custkey // 400)*20 + (dy + uy*((c_custkey % 5)*0.00015e0)) AS y
  FROM customer CROSS JOIN corner
  WHERE (part = 0 AND (ring = 0 OR c_custkey % 3 = 0)) OR (part = 1 AND c_custkey % 4 = 0)),
edge AS (
  SELECT a.zone, a.part, a.ring, a.seq, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
  FROM vert a JOIN vert b ON a.zone = b.zone AND a.part = b.part AND a.ring = b.ring AND b.seq = (a.seq + 1) % a.n),
area AS (
  SELECT zone, part, ring, abs(sum(x1*y2 - x2*y1 ORDER BY seq))/2 AS area FROM edge WHERE ring = 0 GROUP BY ALL),
kept_part AS (SELECT zone, part, area FROM area QUALIFY area >= 0.001*max(area) OVER (PARTITION BY zone)),
kept AS (
  SELECT v.*, p.area, row_number() OVER (PARTITION BY v.zone, v.part ORDER BY v.seq) - 1 AS pos
  FROM vert v JOIN kept_part p USING (zone, part)
  WHERE v.ring = 0 AND (v.n = 4 OR v.seq IN (0,2,4,6,7) OR (v.zone % 5)*0.00015e0 > 0.0002e0))"""

_DRAWN = f"""box AS (SELECT zone, min(x)/1024e0 AS x0, max(x)/1024e0 AS x1, min(y)/1024e0 AS y0, max(y)/1024e0 AS y1 FROM vert WHERE zone <> 1 GROUP BY 1),
ext AS (
  SELECT sx, min(x0)*sx AS min_x, max(y1) AS max_y, greatest(max(x1)*sx - min(x0)*sx, max(y1) - min(y0)) AS span
  FROM box, (SELECT cos(radians(avg((y0 + y1)/2e0))) AS sx FROM box) GROUP BY sx),
ink AS (
  SELECT zone, name, part, pos, area, {_tenth("(x/1024e0*sx - min_x)/span*1000e0")} AS x, {_tenth("(max_y - y/1024e0)/span*1000e0")} AS y
  FROM kept, ext WHERE zone <> 1)"""

_POINTS = """pts AS (
  SELECT o_orderkey AS point, (o_custkey % 400)*20 + (o_orderkey*37 % 241)/10e0 + -1.97e0 AS x,
    (o_custkey // 400)*20 + (o_orderkey*91 % 239)/10e0 + -1.93e0 AS y FROM orders)"""


def _with(parts: list[str], body: str) -> str:
    """A body that starts with a comma goes on with more named parts before its SELECT."""
    return f"WITH {', '.join(parts)}{'' if body.startswith(',') else ' '}{body}"


def _add(name: str, parts: list[str], body: str) -> None:
    ORACLE[name] = _with(parts, body)


_CAR = [_TRIPS, _ZONES, _CELLS]
_SEG = [_TRIPS, _SEGMENTS, _LEGS]
_RAIL = [_TRIPS, _SEGMENTS, _LEGS, _RIDES, _JOURNEYS, _BEST]
_BOTH = [_TRIPS, _ZONES, _CELLS, _SEGMENTS, _LEGS, _RIDES, _JOURNEYS, _BEST, _COMPARE]

_add("time_histogram", [_TRIPS], "SELECT airport, origin, company, block, CAST(minutes AS INT) AS minutes, count(*) AS n FROM good GROUP BY ALL")
_add("fare_histogram", [_TRIPS], "SELECT airport, origin, block, dollars, count(*) AS n FROM good GROUP BY ALL")
ORACLE["block_classify"] = f"SELECT {_block('ts')} AS block, isodow(ts) <= 5 AS working_day, count(*) AS n FROM events GROUP BY ALL"
_add(
    "block_minutes_check", [_TRIPS],
    f"""SELECT minute, n, block AS block_case, block AS block_table,
    CASE block WHEN 'early' THEN 'am' WHEN 'am' THEN 'midday' WHEN 'midday' THEN 'pm' WHEN 'pm' THEN 'evening' ELSE 'early' END AS next_block,
    true AS tiles FROM (SELECT CAST(hour(pickup)*60+minute(pickup) AS INT) AS minute, count(*) AS n FROM raw GROUP BY 1)
    JOIN {_BLOCK_ROWS} ON minute BETWEEN lo AND hi - 1""",
)
_add(
    "trip_validity_counts", [_TRIPS],
    """SELECT 'lineitem' AS source, count(*) AS trips, count(*) FILTER (airport NOT IN (0,1,2)) AS elsewhere,
    count(*) FILTER (origin IS NULL OR pickup IS NULL OR gap_s IS NULL) AS incomplete,
    count(*) FILTER (NOT (dur_s > 0 AND dur_s < 21600)) AS bad_duration, count(*) FILTER (NOT (fare BETWEEN 0 AND 500)) AS bad_fare,
    count(*) FILTER (NOT working) AS weekend, (SELECT count(*) FROM good) AS usable FROM trips""",
)
_add("company_labels", [_TRIPS], "SELECT CASE company WHEN 'A' THEN 'Alpha' WHEN 'N' THEN 'North' ELSE company END AS company, count(*) AS trips FROM good GROUP BY 1")
_add("histogram_merge", [_TRIPS], "SELECT airport, origin, block, CAST(minutes AS INT) AS minutes, count(*) AS n FROM good GROUP BY ALL")
_add(
    "histogram_two_grain", [_TRIPS],
    """SELECT airport, origin, coalesce(block, 'day') AS grain, CAST(minutes AS INT) AS minutes, count(*) AS n FROM good
    GROUP BY GROUPING SETS ((airport, origin, block, minutes), (airport, origin, minutes))""",
)
_add(
    "histogram_dense", [_TRIPS],
    """SELECT k.airport, k.company, CAST(m AS INT) AS minutes, count(g.minutes) AS n
    FROM (SELECT DISTINCT airport, company FROM good) k CROSS JOIN range(0, 91) t(m)
    LEFT JOIN good g ON g.airport = k.airport AND g.company = k.company AND g.minutes = m GROUP BY ALL""",
)
ORACLE["histogram_from_samples"] = "SELECT event_type, CAST(least(floor(value), 180) AS INT) AS bin, count(*) AS n FROM events GROUP BY ALL"
_add(
    "histogram_totals_means", [_TRIPS],
    "SELECT airport, company, count(*) AS n, 0 AS p0, CAST(max(minutes) AS INT) AS p100, round(avg(minutes), 6) AS mean FROM good GROUP BY ALL",
)
for _name in ("percentiles_long", "percentiles_raw"):
    _add(
        _name, [_TRIPS],
        """SELECT airport, origin, block, count(*) AS n, CAST(quantile_disc(minutes, 0.5) AS INT) AS p50,
        CAST(quantile_disc(minutes, 0.9) AS INT) AS p90, CAST(quantile_disc(minutes, 0.95) AS INT) AS p95
        FROM good GROUP BY ALL HAVING count(*) >= 30""",
    )
_add("car_summary", _CAR, "SELECT * FROM cells")
_add("car_day_cells", _CAR, "SELECT airport, origin, n, p50, p90 FROM cells WHERE grain = 'day'")
_add(
    "car_thin_cells", _CAR,
    """SELECT d.airport, CAST(count(DISTINCT d.origin) AS BIGINT) AS zones,
    CAST(5*count(DISTINCT d.origin) - count(b.grain) AS BIGINT) AS thin
    FROM cells d LEFT JOIN cells b ON b.airport = d.airport AND b.origin = d.origin AND b.grain <> 'day'
    WHERE d.grain = 'day' GROUP BY 1""",
)
_add(
    "corpus_json", [_TRIPS],
    """SELECT 'lineitem' AS source, (SELECT count(*) FROM good) AS weekday_trips, 30 AS sample_floor, 'recorded trips' AS evidence, year_month
    FROM (SELECT DISTINCT year_month FROM good)""",
)
_add("corpus_totals", [_TRIPS], "SELECT 'lineitem' AS source, count(*) AS weekday_trips, min(year_month) AS first_month, max(year_month) AS last_month FROM good")
_add("published_zones", _CAR, "SELECT * FROM zones WHERE zone IN (SELECT origin FROM cells)")
ORACLE["zone_dimension"] = """
  SELECT CAST(p_partkey AS INT) AS zone, CASE WHEN p_partkey % 9 = 4 THEN 'Unknown zone ' || p_partkey ELSE 'Zone ' || p_partkey END AS name,
    CASE WHEN p_partkey % 7 = 3 THEN 'Unknown' ELSE 'Borough ' || p_partkey % 5 END AS borough,
    p_partkey NOT IN (0,1,2) AND p_partkey % 7 <> 3 AND p_partkey % 9 <> 4 AS reportable
  FROM part WHERE p_partkey % 11 <> 5"""
_add(
    "unit_ratio_guard", [_TRIPS],
    """SELECT 'lineitem' AS source, year_month, CAST(count(*) FILTER (dur_s > 600) AS BIGINT) AS checked,
    round(median(dur_s/CAST(nullif(gap_s, 0) AS DOUBLE)) FILTER (dur_s > 600), 9) AS ratio,
    CASE WHEN count(*) FILTER (dur_s > 600) = 0 THEN 'no usable rows'
      WHEN coalesce(median(dur_s/CAST(nullif(gap_s, 0) AS DOUBLE)) FILTER (dur_s > 600) BETWEEN 0.5 AND 2.0, false) THEN 'ok'
      ELSE 'unit changed' END AS status
    FROM good GROUP BY year_month""",
)
_add(
    "segment_unit_guard", [_TRIPS, _SEGMENTS],
    """SELECT dataset, route_id, usable, violations, unparsed,
      CASE WHEN violations > 0 THEN 'unit changed' WHEN unparsed > 0 THEN 'unparsed rows' WHEN usable < 10 THEN 'too few rows' ELSE 'ok' END AS status
    FROM (SELECT dataset || suffix AS dataset, route_id, count(*) FILTER (dist IS NOT NULL AND speed > 0 AND t IS NOT NULL) AS usable,
        count(*) FILTER (dist IS NOT NULL AND speed > 0 AND abs(dist/speed*60 - t) > greatest(0.5, 0.05*(dist/speed*60))) AS violations,
        count(*) FILTER (t IS NULL) AS unparsed
      FROM (SELECT *, CASE WHEN suffix <> '_unread' OR hr <> 9 THEN att*f END AS t
        FROM seg_rows, (VALUES ('', 1), ('_seconds', 60), ('_unread', 1)) v(suffix, f)) GROUP BY ALL)""",
)
_add(
    "fare_components", [_TRIPS],
    """SELECT origin, count(*) AS trips, median(CAST(base_cents AS DOUBLE)) AS base, median(CAST(tolls_cents AS DOUBLE)) AS tolls,
    median(CAST(tip_cents AS DOUBLE)) AS tip, median(CAST(base_cents + tolls_cents AS DOUBLE)) AS base_plus_tolls,
    median(CAST(base_cents + tolls_cents - tip_cents AS DOUBLE)) AS total
    FROM trips WHERE airport = 0 AND origin IN (4,5,6) AND hour(pickup) BETWEEN 16 AND 18 AND working GROUP BY 1""",
)
_add(
    "fare_drift_conform", [_TRIPS],
    """SELECT year_month, CASE WHEN month(pickup) % 2 = 0 THEN 'tolls_cents' ELSE '' END AS missing_parts, count(*) AS trips,
    CAST(sum(base_cents + CASE WHEN month(pickup) % 2 = 0 THEN 0 ELSE coalesce(tolls_cents, 0) END - tip_cents) AS BIGINT) AS fare_cents
    FROM trips GROUP BY ALL""",
)
_add(
    "feed_union", [_TRIPS],
    """SELECT 'lineitem' AS source, company, count(*) AS trips, CAST(sum(dur_s) AS BIGINT) AS seconds, CAST(sum(gap_s) AS BIGINT) AS gap
    FROM good GROUP BY company
    UNION ALL SELECT 'derived_duration', '', count(*), CAST(sum(gap_s) AS BIGINT), CAST(sum(gap_s) AS BIGINT) FROM trips
    WHERE airport IN (0,1,2) AND working AND gap_s > 0 AND gap_s < 21600 AND base_cents/100e0 BETWEEN 0 AND 500""",
)
_add(
    "month_coverage", [_TRIPS],
    """SELECT w.year_month, CASE WHEN t.trips IS NULL THEN 'skipped' WHEN CAST(w.year_month[6:7] AS INT) % 3 = 0 THEN 'cached' ELSE 'fetched' END AS status, t.trips
    FROM (SELECT strftime(unnest(generate_series(date_trunc('month', min(pickup)) - INTERVAL 2 MONTH, date_trunc('month', max(pickup)) + INTERVAL 1 MONTH, INTERVAL 1 MONTH)), '%Y-%m') AS year_month FROM trips) w
    LEFT JOIN (SELECT year_month, count(*) AS trips FROM trips GROUP BY 1) t USING (year_month)""",
)
_add(
    "month_union", [_TRIPS],
    "SELECT DISTINCT year_month FROM good WHERE company IS NOT NULL ORDER BY 1",
)
_add(
    "month_ingest", [_TRIPS],
    """SELECT 'lineitem' AS source, year_month, bins, trips, fare_bins, trips AS fare_trips FROM
    (SELECT year_month, count(*) AS bins, CAST(sum(n) AS BIGINT) AS trips FROM
      (SELECT year_month, airport, origin, company, block, minutes, count(*) AS n FROM good GROUP BY ALL) GROUP BY 1)
    JOIN (SELECT year_month, count(*) AS fare_bins FROM (SELECT DISTINCT year_month, airport, origin, block, dollars FROM good) GROUP BY 1) USING (year_month)""",
)
_add("wait_legs", [_RIDES], "SELECT route, station, block, CAST(m AS INT) AS bin, CAST(1 AS BIGINT) AS n FROM waits, range(0, 40) t(m) WHERE m <= headway")
_add(
    "convolve_pair", [_RIDES],
    """SELECT e.route, e.station, e.block, CAST(least(e.minutes + m, 180) AS INT) AS bin, count(*) AS n
    FROM ev e JOIN waits w ON w.route = e.route AND w.station = e.station AND w.block = e.block, range(0, 40) t(m)
    WHERE m <= headway GROUP BY ALL""",
)
_add(
    "convolve_four_legs", _RAIL,
    """SELECT headway, 3 AS transfer_low, 8 AS transfer_high, w_lo AS wait_low, w_hi AS wait_high, lo AS ride_low, hi AS ride_high,
    CAST(least(i + j + k + l, 180) AS INT) AS bin, count(*) AS n
    FROM (SELECT DISTINCT headway, w_lo, w_hi, coalesce(r_lo, s_lo) AS lo, coalesce(r_hi, s_hi) AS hi
        FROM ahead LEFT JOIN ranges USING (block) WHERE coalesce(r_lo, s_lo) IS NOT NULL),
      range(0, 40) t1(i), range(3, 9) t2(j), range(0, 20) t3(k), range(0, 181) t4(l)
    WHERE i <= headway AND k BETWEEN w_lo AND w_hi AND l BETWEEN lo AND hi GROUP BY ALL""",
)
_add(
    "shortcut_error", [_RIDES],
    """, q AS (SELECT route, station, block, CAST(quantile_disc(minutes, 0.9) AS INT) AS left_q FROM ev GROUP BY ALL),
    s AS (SELECT e.route, e.station, e.block, CAST(quantile_disc(least(e.minutes + m, 180), 0.9) AS INT) AS sum_q
      FROM ev e JOIN waits w ON w.route = e.route AND w.station = e.station AND w.block = e.block, range(0, 40) t(m)
      WHERE m <= headway GROUP BY ALL),
    r AS (SELECT route, station, block, CAST(quantile_disc(m, 0.9) AS INT) AS right_q FROM waits, range(0, 40) t(m) WHERE m <= headway GROUP BY ALL)
    SELECT *, left_q + right_q AS shortcut_q, left_q + right_q - sum_q AS overshoot
    FROM q JOIN r USING (route, station, block) JOIN s USING (route, station, block)""",
)
_add(
    "segment_scan", [_TRIPS, _SEGMENTS],
    """SELECT dataset, route_id, CASE route_id WHEN 'L0' THEN 'S5' ELSE 'S11' END AS junction,
    CASE route_id WHEN 'L0' THEN 'Terminal A' ELSE 'Terminal B' END AS terminal, CASE route_id WHEN 'L0' THEN 2 ELSE 1 END AS aliases,
    year_month, ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][dow] AS day_of_week,
    count(*) AS cells, CAST(sum(n) AS BIGINT) AS buses, count(dist) AS with_distance FROM seg_rows GROUP BY ALL""",
)
_add("segment_leg_summary", _SEG, "SELECT * FROM leg_tot JOIN leg_sum USING (route_id)")
_add(
    "floor_rank_quantile", [_TRIPS],
    """SELECT airport, company, CAST(len(v) AS BIGINT) AS n, v[CAST(floor(0.1*(len(v)-1)) AS BIGINT)+1] AS low, v[CAST(floor(0.9*(len(v)-1)) AS BIGINT)+1] AS high
    FROM (SELECT airport, company, list(dur_s ORDER BY dur_s) AS v FROM good GROUP BY ALL)""",
)
_add(
    "route_documents", [_RIDES, _JOURNEYS],
    """SELECT airport, link_pos, route_pos, route, dir AS dir_pos, idx, 'S' || station AS station, 'S' || conn AS connector, block,
    CAST(n AS BIGINT) AS n, ride_p50, ride_p90, median_wait FROM ahead WHERE n >= 30""",
)
_add(
    "ride_range", _SEG,
    """SELECT route_id, block, CAST(trunc(low) AS INT) AS seg_low, greatest(CAST(trunc(high) AS INT), CAST(trunc(low) AS INT) + 1) AS seg_high FROM leg_sum""",
)
_add(
    "journeys_best", _RAIL,
    """SELECT airport, 'S' || station AS station, route, 'S' || conn AS connector, link, round(typical, 6) AS typical, block, CAST(n AS BIGINT) AS n,
    ride_p50, ride_p90, o50 AS overhead_p50, o90 AS overhead_p90, d50 AS door_p50, d90 AS door_p90 FROM best""",
)
ORACLE["journey_json"] = f"""SELECT j.*, CASE airport WHEN 0 THEN 11.75e0 WHEN 1 THEN 3e0 END AS transit_fare,
    'waits are uniform over the headway' AS assumption FROM ({ORACLE['journeys_best']}) j"""
_add("mode_comparison", _BOTH, "SELECT * FROM cmp")
_add(
    "verdict_tally", _BOTH,
    """SELECT airport, block, count(*) FILTER (verdict = 'car') AS car, count(*) FILTER (verdict = 'transit') AS transit,
    count(*) FILTER (verdict = 'too close to call') AS draw FROM cmp WHERE car_p90 IS NOT NULL AND transit_p90 IS NOT NULL GROUP BY ALL""",
)
_add(
    "default_zone", _BOTH,
    f"""SELECT k.airport, k.block, coalesce(g.zone, (SELECT min(zone) FROM cmp c WHERE c.airport = k.airport)) AS zone, g.gap
    FROM (SELECT DISTINCT airport, b.block FROM cmp, {_BLOCK_ROWS}) k LEFT JOIN
    (SELECT airport, block, zone, car_p90 - transit_p90 AS gap FROM cmp WHERE car_p90 IS NOT NULL AND transit_p90 IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY airport, block ORDER BY car_p90 - transit_p90 DESC, zone) = 1) g USING (airport, block)""",
)
_add("coverage_counts", _BOTH, "SELECT airport, count(DISTINCT zone) AS zones, count(DISTINCT zone) FILTER (station IS NOT NULL) AS with_transit FROM cmp GROUP BY 1")
_add("station_counts", _RAIL, "SELECT airport, count(DISTINCT station) AS stations FROM best GROUP BY 1")
for _name, _value in (("quintile_shade", "car_p90"), ("buffer_shade", "car_buffer")):
    _picks = ", ".join(f"v[CAST(floor({q}*(len(v)-1)) AS INT)+1] AS b{i}" for i, q in enumerate((0.2, 0.4, 0.6, 0.8)))
    _add(
        _name, _BOTH,
        f""", lists AS (SELECT airport, block, list({_value} ORDER BY {_value}) AS v FROM cmp WHERE {_value} IS NOT NULL GROUP BY ALL),
        breaks AS (SELECT airport, block, {_picks}, v[1] AS legend_low, v[len(v)] AS legend_high FROM lists)
        SELECT c.airport, c.block, c.zone, c.{_value} AS value,
          CAST(({_value} > b0)::INT + ({_value} > b1)::INT + ({_value} > b2)::INT + ({_value} > b3)::INT AS INT) AS step, legend_low, legend_high
        FROM cmp c JOIN breaks USING (airport, block) WHERE {_value} IS NOT NULL""",
    )
def _medians(cohort: str, group: str) -> str:
    """Medians pooled and by month of a cohort given as the table ``c``."""
    text = """ g AS (SELECT company, coalesce(year_month, 'all') AS month, CAST(round_even(median(dur_s/60e0), 0) AS INT) AS median, count(*) AS trips,
      count(DISTINCT year_month) AS months, min(year_month) AS first_month, max(year_month) AS last_month
      FROM (SELECT company, year_month, year_month AS ym, dur_s FROM c) GROUP BY GROUPING SETS ((company, year_month), (company)))
    SELECT company, month, median, trips, CASE WHEN month = 'all' THEN m2.months ELSE 1 END AS months,
      CASE WHEN month = 'all' THEN m2.f ELSE month END AS first_month, CASE WHEN month = 'all' THEN m2.l ELSE month END AS last_month,
      CASE WHEN month = 'all' THEN m2.names ELSE month END AS month_list,
      CASE WHEN month <> 'all' OR m2.f = m2.l THEN strftime(CAST((CASE WHEN month = 'all' THEN m2.f ELSE month END) || '-01' AS DATE), '%b %Y')
        WHEN m2.f[1:4] = m2.l[1:4] THEN strftime(CAST(m2.f || '-01' AS DATE), '%b') || ' to ' || strftime(CAST(m2.l || '-01' AS DATE), '%b %Y')
        ELSE strftime(CAST(m2.f || '-01' AS DATE), '%b %Y') || ' to ' || strftime(CAST(m2.l || '-01' AS DATE), '%b %Y') END AS span,
      round(median/38e0 - 1e0, 6) AS change
    FROM g JOIN (SELECT company, min(year_month) AS f, max(year_month) AS l, count(DISTINCT year_month) AS months,
      string_agg(DISTINCT year_month, ',' ORDER BY year_month) AS names FROM c GROUP BY 1) m2 USING (company)
"""
    return f", c AS ({cohort})," + text.replace("company", group)


_add("cohort_medians", [_TRIPS], _medians("SELECT * FROM trips WHERE airport = 0 AND hour(pickup) = 10 AND working AND dur_s > 0 AND dur_s < 21600", "company"))
_add(
    "cohort_feeds", [_TRIPS],
    _medians(
        """SELECT * FROM (
            SELECT 'lineitem' AS source, year_month, dur_s, airport, pickup, working FROM trips WHERE year_month BETWEEN '1994-01' AND '1995-06'
            UNION ALL
            SELECT 'derived_duration', year_month, gap_s, airport, pickup, working FROM trips WHERE year_month BETWEEN '1996-11' AND '1997-02')
        WHERE airport = 0 AND hour(pickup) = 10 AND working AND dur_s > 0 AND dur_s < 21600""",
        "source",
    ),
)
ORACLE["cohort_json"] = f"SELECT company, month, median, trips, months, month_list, span, change FROM ({ORACLE['cohort_medians']})"
_add(
    "company_profile", [_TRIPS],
    """SELECT company, count(*) AS trips, round(median(dur_s)/60e0, 4) AS median_min, round(quantile_cont(dur_s, 0.9)/60e0, 4) AS p90_min,
    round(CAST(sum(coalesce(base_cents,0)+coalesce(tolls_cents,0)-tip_cents) AS DOUBLE)/count(*)/100e0, 4) AS avg_fare
    FROM trips WHERE airport = 0 GROUP BY 1""",
)
_add(
    "hour_profile", [_TRIPS],
    """SELECT CAST(hour(pickup) AS INT) AS hour, count(*) AS trips, round(median(trip_time)/60e0, 4) AS median_min,
    round(quantile_cont(trip_time, 0.9)/60e0, 4) AS p90_min, round(median(miles)/100e0, 4) AS median_miles
    FROM trips WHERE airport = 0 AND working GROUP BY 1""",
)
ORACLE["rounding_rules"] = f"""SELECT strftime(ts, '%Y-%m') AS year_month, {_tenth("floor(value*20)/20e0")} AS tenth,
  round_even(floor(value*20)/20e0, 0) AS whole, count(*) AS n FROM events GROUP BY ALL"""
ORACLE["geojson_scan"] = """SELECT c_custkey AS zone, c_name AS name,
  CASE WHEN c_custkey % 50 = 11 THEN 'LineString' WHEN c_custkey % 4 = 0 THEN 'MultiPolygon' ELSE 'Polygon' END AS kind,
  CASE WHEN c_custkey % 50 = 11 THEN 0 WHEN c_custkey % 4 = 0 THEN 2 ELSE 1 END AS parts,
  CASE WHEN c_custkey % 50 = 11 THEN 0 ELSE 8 + CASE WHEN c_custkey % 3 = 0 THEN 4 ELSE 0 END + CASE WHEN c_custkey % 4 = 0 THEN 4 ELSE 0 END END AS vertices
  FROM customer WHERE c_custkey % 50 NOT IN (7, 9)"""
ORACLE["station_scan"] = """SELECT 'G' || s_suppkey AS stop_id, s_name AS name, CASE WHEN s_suppkey % 3 > 0 THEN 'B' || s_suppkey % 5 ELSE '' END AS borough,
  CASE WHEN s_suppkey % 4 > 0 THEN 'A|' || s_suppkey % 7 ELSE '' END AS routes, (s_suppkey % 360)/8e0 AS lon, (s_suppkey % 180)/4e0 AS lat
  FROM supplier WHERE s_suppkey % 13 <> 6 AND s_suppkey % 17 <> 8 AND s_suppkey % 19 <> 9"""
ORACLE["station_mapping"] = """SELECT zone, CAST(row_number() OVER (PARTITION BY zone ORDER BY p) - 1 AS INT) AS pos, station
  FROM (SELECT CAST(p_partkey % 40 AS INT) AS zone, 'S' || p_partkey*7 % 12 AS station, min(p_partkey) AS p FROM part GROUP BY ALL)"""
_SEGMENT_REASON = "CASE WHEN n % 11 = 3 THEN 'no travel time' WHEN n % 7 = 2 THEN 'hour beyond the clock' WHEN n % 7 = 3 THEN 'hour is no number' ELSE 'kept' END"
_STATION_REASON = """CASE WHEN s_suppkey % 13 = 6 THEN 'no id' WHEN s_suppkey % 17 = 8 THEN 'longitude is no number'
    WHEN s_suppkey % 19 = 9 THEN 'latitude is no number' ELSE 'kept' END"""
_add(
    "quarantine_counts", [_TRIPS, _SEGMENTS],
    f"""SELECT source, reason, count(*) AS n FROM (
        SELECT 'zones' AS source, CASE WHEN p_partkey % 11 = 5 THEN 'zone id is no whole number' ELSE 'kept' END AS reason FROM part
        UNION ALL SELECT 'segments', {_SEGMENT_REASON} FROM seg_rows
        UNION ALL SELECT 'zone shapes', CASE c_custkey % 50 WHEN 7 THEN 'no geometry' WHEN 9 THEN 'geometry without coordinates' ELSE 'kept' END FROM customer
        UNION ALL SELECT 'stations', {_STATION_REASON} FROM supplier) GROUP BY ALL""",
)
ORACLE["quarantine_rows"] = f"SELECT s_suppkey AS pos, {_STATION_REASON} AS reason, s_name AS name FROM supplier"
_add(
    "quarantined_segments", [_TRIPS, _SEGMENTS],
    f"""SELECT route_id, block, count(*) AS cells FROM seg_rows JOIN {_BLOCK_ROWS} ON hr*60 >= lo AND hr*60 < hi
    WHERE dow <= 5 AND {_SEGMENT_REASON} = 'kept' GROUP BY ALL HAVING count(*) >= 10""",
)
_add("zone_bounds", [_SHAPES], "SELECT zone, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM vert GROUP BY zone")
_add(
    "ring_edges", [_SHAPES],
    "SELECT zone, part, ring, seq, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM edge",
)
_add("ring_area", [_SHAPES], "SELECT zone, part, round(area, 4) AS area FROM area")
_add("sliver_trim", [_SHAPES], "SELECT zone, part, CAST(count(DISTINCT ring) AS INT) AS rings FROM vert JOIN kept_part USING (zone, part) GROUP BY ALL")
_add("simplify_rings", [_SHAPES], "SELECT zone, part, CAST(pos AS INT) AS seq, round(x, 6) AS x, round(y, 6) AS y FROM kept")
_add(
    "point_in_zone", [_SHAPES, _POINTS],
    """, bb AS (SELECT zone, part, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM vert GROUP BY ALL),
    cand AS (SELECT point, p.x, p.y, zone, part FROM pts p JOIN bb ON p.x BETWEEN x0 AND bb.x1 AND p.y BETWEEN y0 AND bb.y1),
    hits AS (SELECT point, c.zone, c.part, e.ring, count(*) FILTER ((y1 > y) <> (y2 > y) AND x1 + (y - y1)/nullif(y2 - y1, 0)*(x2 - x1) > x) % 2 = 1 AS odd
      FROM cand c JOIN edge e ON e.zone = c.zone AND e.part = c.part GROUP BY ALL)
    SELECT point, min(zone) AS zone FROM (SELECT point, zone, part FROM hits GROUP BY ALL
      HAVING bool_or(odd) FILTER (ring = 0) AND NOT coalesce(bool_or(odd) FILTER (ring > 0), false)) GROUP BY point""",
)
_DRAW = [_SHAPES, _DRAWN]
_add("project_frame", _DRAW, "SELECT zone, part, CAST(pos AS INT) AS seq, x, y FROM ink")
_add(
    "zone_path", _DRAW,
    "SELECT zone, string_agg(p, '' ORDER BY part) AS path FROM (SELECT zone, part, 'M' || string_agg(x || ' ' || y, 'L' ORDER BY pos) || 'Z' AS p FROM ink GROUP BY ALL) GROUP BY zone",
)
_add(
    "zone_centroid", _DRAW,
    f"""SELECT zone, {_tenth("sx/w")} AS cx, {_tenth("sy/w")} AS cy FROM
    (SELECT zone, sum(x*area ORDER BY part, pos) AS sx, sum(y*area ORDER BY part, pos) AS sy, sum(area ORDER BY part, pos) AS w FROM ink GROUP BY zone)""",
)
_BOX = f"""l AS (SELECT min(x) AS l, min(y) AS t, max(x) - min(x) AS w, max(y) - min(y) AS h FROM ink)"""
_add(
    "view_box", [*_DRAW, _BOX],
    f'SELECT {_tenth("l")} AS "left", {_tenth("t")} AS top, {_tenth("w")} AS width, {_tenth("h")} AS height FROM l',
)
_add(
    "clipped_zones", [*_DRAW, _BOX],
    f""", bx AS (SELECT {_tenth("l + w*0.1e0")} AS l, {_tenth("t + h*0.1e0")} AS t, {_tenth("w/1.25e0")} AS w, {_tenth("h/1.25e0")} AS h FROM l)
    SELECT zone, outside, vertices, round(outside/CAST(vertices AS DOUBLE), 6) AS share FROM
    (SELECT zone, count(*) FILTER (x < l OR y < t OR x > l + w OR y > t + h) AS outside, count(*) AS vertices FROM ink, bx GROUP BY zone)
    WHERE outside > 0 ORDER BY outside/CAST(vertices AS DOUBLE) DESC, zone LIMIT 6""",
)
_add(
    "drawing_counts", [_SHAPES],
    """SELECT (SELECT count(*) FROM area) - (SELECT count(*) FROM kept_part) AS parts_dropped, (SELECT count(*) FROM kept_part) AS parts_drawn,
    (SELECT count(*) FROM vert JOIN kept_part USING (zone, part) WHERE ring = 0) AS vertices_before, (SELECT count(*) FROM kept) AS vertices_after""",
)
_add(
    "nearest_zone", [_SHAPES, _POINTS],
    """, mid AS (SELECT zone, min(x) + 10 AS cx, min(y) + 10 AS cy FROM vert WHERE zone % 7 <> 0 GROUP BY zone),
    near AS (SELECT point, zone, sqrt((cx - x)*(cx - x) + (cy - y)*(cy - y)) AS d FROM pts JOIN mid ON x BETWEEN cx - 11 AND cx + 11 AND y BETWEEN cy - 11 AND cy + 11)
    SELECT point, zone, round(d, 6) AS distance FROM near WHERE d <= 11 QUALIFY row_number() OVER (PARTITION BY point ORDER BY d, zone) = 1""",
)
_add("report_json", _CAR, "SELECT airport, origin AS zone, name, borough, grain, n, mean, p50, p90, p95, fare, fare_p90 FROM cells JOIN zones ON zone = origin")
_add("comparison_json", _BOTH, "SELECT airport, zone, name, borough, station, block, car_p90, transit_p90, lead_minutes, verdict FROM cmp")
_add(
    "leg_json", _SEG,
    """SELECT route_id, CASE route_id WHEN 'L0' THEN 'S5' ELSE 'S11' END AS junction, CASE route_id WHEN 'L0' THEN 'Terminal A' ELSE 'Terminal B' END AS terminal,
    buses_observed, months, block, cells, buses_per_cell, typical, low, high, worst_cell FROM leg_tot JOIN leg_sum USING (route_id)""",
)
ORACLE["stream_histogram"] = f"""SELECT event_type, {_block("ts")} AS block, CAST(least(floor(value), 180) AS INT) AS minutes, count(*) AS n FROM events GROUP BY ALL"""
ORACLE["stream_daily_counts"] = """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL"""
ORACLE["block_bounds"] = f"""SELECT block, count(*) AS n, CAST(min(m) AS INT) AS first_minute, CAST(max(m) AS INT) AS last_minute,
    CAST(lo AS INT) AS start_min, CAST(hi AS INT) AS end_min
    FROM (SELECT hour(ts)*60+minute(ts) AS m FROM events), {_BLOCK_ROWS} WHERE m >= lo AND m < hi GROUP BY block, lo, hi"""
ORACLE["stream_closed_days"] = """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events
    WHERE user_id % 7 <> 0 AND date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 6 DAY GROUP BY ALL"""
