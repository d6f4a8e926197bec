"""Queries of the operators on the views over the driver's tables, with SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from railweave.functions import clock, geo, keys, names
from railweave.operators import canon, filters, linkage, lookups, sequences, spatial, summaries, tables, timetables
from railweave.operators.graph import shared_dir
from railweave.plans import journeys, network
from railweave.plans.views import Tables, twin
from railweave.sources import readers, writers
from railweave.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def no_codes():
    return F.array().cast(linkage.NO_CODES)



def query(name: str, sql: str | None = None):
    def add(make: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
        if sql:
            SQL[name] = twin(sql)
        return make

    return add


def r6(c):
    return F.round(c if not isinstance(c, str) else F.col(c), 6)


def hav(a: str, b: str, c: str, d: str) -> str:
    """The haversine distance in SQL."""
    return f"(12742.0 * asin(sqrt(least(1.0, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))))"


LEGS = "legs AS (SELECT trip_id, seq, stop_id AS from_stop, lead(stop_id) OVER w AS to_stop, departure_s, lead(arrival_s) OVER w AS raw FROM v_stop_times WINDOW w AS (PARTITION BY trip_id ORDER BY seq)), conn AS (SELECT trip_id, seq, from_stop, to_stop, departure_s, CASE WHEN raw < departure_s THEN raw + 86400 ELSE raw END AS arrival_s FROM legs WHERE to_stop IS NOT NULL)"


def bus_legs(t: Tables) -> DataFrame:
    return sequences.build_connections(t.v_stop_times).withColumn("mode", F.lit("bus"))


@query("flagship_legs_by_region", f"""WITH {LEGS} SELECT a.region, count(*) AS legs, count(*) FILTER (km >= 5 AND h > 0 AND km / h > 120) AS implausible FROM (
    SELECT x.region, {hav('x.lat', 'x.lon', 'y.lat', 'y.lon')} AS km, (c.arrival_s - c.departure_s) / 3600.0 AS h FROM conn c JOIN v_stops x ON c.from_stop = x.stop_id JOIN v_stops y ON c.to_stop = y.stop_id) a GROUP BY a.region""")
def _(t):
    told = filters.leg_speeds(bus_legs(t), t.v_stops)
    rows = told.join(t.v_stops.select(F.col("stop_id").alias("from_stop"), "region"), "from_stop")
    return rows.groupBy("region").agg(F.count("*").alias("legs"), F.count_if(filters.is_implausible(F.col("mode"))).alias("implausible"))


# ---- filters


@query("b01_filter_bbox", "SELECT stop_id FROM v_stops WHERE lat BETWEEN 54.5 AND 55.2 AND lon BETWEEN 82.2 AND 84.0")
def _(t):
    return filters.filter_bbox(t.v_stops, (54.5, 82.2, 55.2, 84.0)).select("stop_id")


@query("b02_auto_bbox", "SELECT terminal_id FROM v_terminals, (SELECT min(lat) - 1 AS a, max(lat) + 1 AS b, min(lon) - 1 AS c, max(lon) + 1 AS d FROM v_stops WHERE region = 'ASIA') q WHERE lat BETWEEN a AND b AND lon BETWEEN c AND d")
def _(t):
    return filters.auto_bbox(filters.filter_regions(t.v_stops, ["ASIA"]), t.v_terminals).select("terminal_id")


@query("b03_filter_regions", "SELECT stop_id, region FROM v_stops WHERE region IN ('ASIA', 'EUROPE')")
def _(t):
    return filters.filter_regions(t.v_stops, ["ASIA", " EUROPE "]).select("stop_id", "region")


@query("b04_filter_modes", "SELECT route_id, mode FROM v_routes WHERE mode = 'bus'")
def _(t):
    return filters.filter_modes(t.v_routes, "coach, ,bus,boat").select("route_id", "mode")


@query("b05_filter_service_days", "SELECT trip_id FROM v_trips WHERE service_days = '' OR list_contains(string_split(service_days, ','), CAST(dayofweek(service_date) AS VARCHAR))")
def _(t):
    return filters.filter_service_days(t.v_trips, F.col("service_date")).select("trip_id")


@query("b06_service_active", """WITH req AS (SELECT DISTINCT service_id, service_date AS day FROM v_trips), svc AS (SELECT range AS service_id, DATE '1993-01-01' AS s, DATE '1996-12-31' AS e FROM range(5)),
    exc AS (SELECT DISTINCT service_id, service_date AS day, CASE WHEN service_id % 2 = 0 THEN 'removed' ELSE 'added' END AS x FROM v_trips WHERE trip_id % 11 = 0)
    SELECT req.service_id, req.day, CASE WHEN s IS NULL THEN TRUE WHEN req.day < s OR req.day > e THEN FALSE WHEN x = 'removed' THEN FALSE WHEN x = 'added' THEN TRUE WHEN req.service_id = 4 THEN TRUE ELSE dayofweek(req.day) = req.service_id END AS active
    FROM req LEFT JOIN svc ON svc.service_id = req.service_id LEFT JOIN exc ON exc.service_id = req.service_id AND exc.day = req.day""")
def _(t):
    req = t.v_trips.select("service_id", F.col("service_date").alias("day")).distinct()
    svc = req.select("service_id").distinct().where("service_id < 5").select("service_id", F.to_date(F.lit("1993-01-01")).alias("start_date"), F.to_date(F.lit("1996-12-31")).alias("end_date"))
    days = svc.where("service_id < 4").select("service_id", F.col("service_id").alias("weekday"))
    exc = t.v_trips.where("trip_id % 11 = 0").select("service_id", F.col("service_date").alias("date"), F.when(F.col("service_id") % 2 == 0, "removed").otherwise("added").alias("exception_type")).distinct()
    return filters.service_active(req, svc, days, exc)


@query("b07_drop_implausible", f"""WITH {LEGS} SELECT c.trip_id, c.seq FROM conn c JOIN v_stops x ON c.from_stop = x.stop_id JOIN v_stops y ON c.to_stop = y.stop_id
    WHERE NOT ({hav('x.lat', 'x.lon', 'y.lat', 'y.lon')} >= 5 AND c.arrival_s > c.departure_s AND {hav('x.lat', 'x.lon', 'y.lat', 'y.lon')} / ((c.arrival_s - c.departure_s) / 3600.0) > 120)""")
def _(t):
    return filters.drop_implausible(bus_legs(t), t.v_stops).select("trip_id", "seq")


@query("b08_live_only", "SELECT t.trip_id FROM v_trips t JOIN v_routes r ON t.route_id = r.route_id WHERE t.valid_to IS NULL AND r.valid_to IS NULL")
def _(t):
    return filters.live_trips(t.v_trips, t.v_routes).select("trip_id")


@query("b09_filter_providers", "SELECT route_id FROM v_routes WHERE provider = 'north'")
def _(t):
    return filters.filter_providers(t.v_routes, ["north"]).select("route_id")


@query("b10_exclude_bad_stops", "WITH bad AS (SELECT stop_id FROM v_stops WHERE lat > 55.8), gone AS (SELECT DISTINCT trip_id FROM v_stop_times WHERE stop_id IN (SELECT stop_id FROM bad)) SELECT trip_id, seq, stop_id FROM v_stop_times WHERE trip_id NOT IN (SELECT trip_id FROM gone)")
def _(t):
    issues = filters.validate_bounds(t.v_stops, (0.0, 0.0, 55.8, 180.0))
    return filters.exclude_bad_stops({"stops": t.v_stops, "trips": t.v_trips, "stop_times": t.v_stop_times}, issues)["stop_times"].select("trip_id", "seq", "stop_id")


@query("b11_search_text", "SELECT place_id FROM v_places WHERE contains(lower(name), 'a') OR (place_id >= 3000000 AND place_id % 2 = 0)")
def _(t):
    alias = t.supplier.select((F.col("s_suppkey") + 3000000).alias("place_id"), F.concat("s_name", F.lit(" Area")).alias("alias"))
    return filters.search_text(t.v_places, "A", ["name"], alias.where("place_id % 2 = 0"), "place_id").select("place_id")


@query("b12_is_village_name", "SELECT p_partkey, p_partkey % 4 IN (0, 1) AS village, CASE WHEN p_partkey % 4 IN (0, 1) THEN 15 ELSE 0 END AS penalty FROM part")
def _(t):
    n = F.when(F.col("p_partkey") % 4 == 0, "Остановочный пункт 7").when(F.col("p_partkey") % 4 == 1, "ОП «Сад»").when(F.col("p_partkey") % 4 == 2, "Оптика").otherwise("Вокзал")
    return t.part.select("p_partkey", names.is_village_name(n).alias("village"), names.village_penalty(n).alias("penalty"))


@query("b13_is_plausible_settlement", "SELECT name, length(trim(name)) BETWEEN 4 AND 60 AND regexp_matches(trim(name), '^[A-Z]') AS ok FROM v_places")
def _(t):
    return t.v_places.select("name", names.is_plausible_settlement(F.col("name")).alias("ok"))


@query("b14_validate_bounds", "SELECT 'stop' AS entity, stop_id AS entity_id, 'warn' AS severity FROM v_stops WHERE NOT (lat BETWEEN 54 AND 55 AND lon BETWEEN 82 AND 84)")
def _(t):
    return filters.validate_bounds(t.v_stops, (54.0, 82.0, 55.0, 84.0)).select("entity", "entity_id", "severity")


@query("b15_region_plausible", f"WITH c AS (SELECT region, avg(lat) AS clat, avg(lon) AS clon FROM v_stops WHERE region <> 'AFRICA' GROUP BY region) SELECT terminal_id, CASE WHEN clat IS NULL THEN lat BETWEEN 41 AND 82 AND lon BETWEEN 19 AND 191 ELSE {hav('lat', 'lon', 'clat', 'clon')} <= CASE WHEN t.region = 'ASIA' THEN 300 ELSE 200 END END AS plausible FROM v_terminals t LEFT JOIN c ON c.region = t.region")
def _(t):
    c = t.v_stops.where("region <> 'AFRICA'").groupBy("region").agg(F.avg("lat").alias("clat"), F.avg("lon").alias("clon"))
    return filters.region_plausible(t.v_terminals, c, ["ASIA"], 200.0, 300.0).select("terminal_id", "plausible")


@query("b16_route_attachable", "SELECT route_id, count(*) FILTER (region = 'ASIA') = 0 AS attachable FROM v_outcomes GROUP BY route_id")
def _(t):
    return filters.route_attachable(t.v_outcomes.groupBy("route_id").agg(F.collect_set("region").alias("regions")), ["ASIA"]).select("route_id", "attachable")


@query("b17_barrier_waiting", "SELECT coalesce(string_agg(region, ',' ORDER BY region), '') AS waiting, count(*) = 0 AS open FROM (SELECT DISTINCT region FROM v_stops WHERE region NOT IN (SELECT region FROM v_stops WHERE stop_id % 50 = 0))")
def _(t):
    return filters.barrier_waiting(t.v_stops.where("stop_id % 50 = 0"), t.v_stops).select(F.array_join("waiting", ",").alias("waiting"), "open")


@query("b18_with_settlement", "SELECT terminal_id, CASE WHEN terminal_id % 3 = 0 THEN settlement ELSE '' END AS settlement, terminal_id % 3 = 0 AS manual FROM v_terminals")
def _(t):
    return filters.with_settlement(t.v_terminals, t.v_terminals.where("terminal_id % 3 = 0").select("terminal_id", "settlement")).select("terminal_id", "settlement", "manual")


# ---- joins

STOP_PAIRS = f"SELECT a.stop_id, b.stop_id AS other_id, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km FROM v_stops a JOIN v_stops b ON a.stop_id < b.stop_id"


@query("c12_radius_join", f"SELECT stop_id, other_id, round(km, 6) AS km FROM ({STOP_PAIRS}) WHERE km <= 30")
def _(t):
    return spatial.radius_join(t.v_stops, 30.0).withColumn("km", r6("km"))


@query("c13_walk_transfers", f"WITH p AS (SELECT * FROM ({STOP_PAIRS}) WHERE km <= 30 AND stop_id % 6 <> 0 AND other_id % 6 <> 0), b AS (SELECT stop_id AS from_stop, other_id AS to_stop, km FROM p UNION ALL SELECT other_id, stop_id, km FROM p) SELECT from_stop, to_stop, CAST(floor(km * 1000 / 5000 * 60) + 2 AS INT) AS minutes FROM b WHERE from_stop % 10 <> 1")
def _(t):
    have = t.v_stops.where("stop_id % 10 = 1").select(F.col("stop_id").alias("from_stop")).crossJoin(t.v_stops.select(F.col("stop_id").alias("to_stop")))
    return spatial.walk_transfers(t.v_stops.withColumn("provisional", F.col("stop_id") % 6 == 0), have, 30000.0)


@query("c14_transfer_links", f"WITH p AS (SELECT * FROM ({STOP_PAIRS}) WHERE km <= 30) SELECT stop_id AS from_stop, other_id AS to_stop, CAST(ceil(km / 5 * 60) AS INT) AS minutes, CAST(round(km * 1000) AS INT) AS metres FROM p UNION ALL SELECT other_id, stop_id, CAST(ceil(km / 5 * 60) AS INT), CAST(round(km * 1000) AS INT) FROM p")
def _(t):
    return spatial.transfer_links(t.v_stops, 30.0)


NEAR = f"SELECT t.terminal_id AS point_id, s.stop_id, {hav('t.lat', 't.lon', 's.lat', 's.lon')} AS km FROM v_terminals t JOIN v_stops s ON abs(t.lat - s.lat) < 0.2"


@query("c15_nearest_stops", f"SELECT point_id, stop_id, round(km, 6) AS km, rank FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY km, stop_id) AS rank FROM ({NEAR}) WHERE km <= 10) WHERE rank <= 3")
def _(t):
    return spatial.nearest_stops(t.v_terminals.withColumnRenamed("terminal_id", "point_id"), t.v_stops, 120.0, 3).withColumn("km", r6("km"))


@query("c16_knn_staged", f"SELECT code, other_code, round(km, 6) AS km, rank FROM (SELECT t.terminal_id AS code, r.record_id AS other_code, {hav('t.lat', 't.lon', 'r.lat', 'r.lon')} AS km, row_number() OVER (PARTITION BY t.terminal_id ORDER BY {hav('t.lat', 't.lon', 'r.lat', 'r.lon')}, r.record_id) AS rank FROM v_terminals t JOIN v_records r ON abs(t.lat - r.lat) < 0.1 WHERE {hav('t.lat', 't.lon', 'r.lat', 'r.lon')} <= 2) WHERE rank <= 2")
def _(t):
    run = F.lit("run1").alias("run_id")
    a = t.v_terminals.select(run, "source", F.col("terminal_id").alias("code"), "lat", "lon")
    b = t.v_records.select(run, "source", F.col("record_id").alias("code"), "lat", "lon")
    return spatial.knn_staged(a, b, 2.0, 2).select("code", "other_code", r6("km").alias("km"), "rank")


@query("c23_gazetteer_resolve", "SELECT n_nationkey AS query_id, n_name AS place, 'exact' AS method FROM nation")
def _(t):
    q = t.nation.select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit(" "), F.lower("n_name"), F.lit("  ")).alias("text"))
    p = t.nation.select(F.col("n_nationkey").alias("place_id"), F.col("n_name").alias("name"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))
    return spatial.gazetteer_resolve(q, p).select("query_id", "place", "method")


@query("c25_fare_for_leg", """WITH leg AS (SELECT l_orderkey * 100 + l_linenumber AS leg_id, l_suppkey AS s FROM lineitem GROUP BY ALL), x AS (SELECT leg_id, s, s % 5 AS route_id, s % 3 AS z FROM leg)
    SELECT leg_id, s, CASE WHEN route_id = 1 AND z = 2 THEN 10.0 WHEN route_id = 1 THEN 20.0 WHEN z = 0 THEN 30.0 WHEN route_id <> 4 THEN 40.0 END AS price FROM x""")
def _(t):
    legs = t.lineitem.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("leg_no"), F.col("l_suppkey").alias("s")).distinct()
    legs = legs.select(F.concat_ws("-", "leg_no", "s").alias("leg_id"), "leg_no", "s", (F.col("s") % 5).alias("route_id"), F.col("s").alias("from_stop"), F.col("s").alias("to_stop"))
    zones = t.supplier.select(F.col("s_suppkey").alias("stop_id"), (F.col("s_suppkey") % 3).cast("string").alias("zone_id"))
    rules = t.region.limit(0).select(F.lit(0).alias("rule_no"), F.lit("").alias("route_id"), F.lit("").alias("from_zone"), F.lit("").alias("to_zone"), F.lit("").alias("fare_id"))
    rows = [(1, "1", "2", "", "a"), (2, "1", "", "", "b"), (3, "", "0", "0", "c"), (4, "0", "", "", "d"), (5, "2", "", "", "d"), (6, "3", "", "", "d")]
    rules = rules.union(t.spark.createDataFrame(rows, "rule_no int, route_id string, from_zone string, to_zone string, fare_id string"))
    fares = t.spark.createDataFrame([("a", 10.0, "RUB"), ("b", 20.0, "RUB"), ("c", 30.0, "RUB"), ("d", 40.0, "RUB")], "fare_id string, price double, currency string")
    return lookups.fare_for_leg(legs, rules, zones, fares).select(F.col("leg_no").alias("leg_id"), "s", "price")


@query("c30_geocode_cache_join", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'miss' WHEN event_id % 4 = 1 THEN 'stale' ELSE CASE WHEN event_id % 4 = 2 THEN 'fresh' ELSE 'stale' END END AS state FROM events")
def _(t):
    q = t.events.select("event_id", F.concat(F.lit(" Q  "), (F.col("event_id") % 4).cast("string")).alias("text"), F.lit("p").alias("provider"))
    cache = t.spark.range(1, 4).select(F.concat(F.lit("q "), F.col("id").cast("string")).alias("query"), F.lit("p").alias("provider"), (F.timestamp_seconds(F.lit(1_000_000_000)) - F.expr("make_dt_interval(CAST(CASE id WHEN 1 THEN 10 WHEN 2 THEN 60 ELSE 100 END AS INT))")).alias("cached_at"), F.when(F.col("id") == 1, "seed").otherwise("live").alias("origin"), F.lit(True).alias("verified"))
    return spatial.geocode_cache_join(q, cache, F.timestamp_seconds(F.lit(1_000_000_000))).select("event_id", "state")


@query("c32_join_by_code", "WITH one AS (SELECT system, code, arg_min(terminal_id, (CASE WHEN is_primary THEN 0 ELSE 1 END) * 1000000 + terminal_id) AS terminal_id FROM v_identifiers GROUP BY ALL) SELECT i.arrived, o.terminal_id FROM v_identifiers i JOIN one o ON o.system = i.system AND o.code = i.code")
def _(t):
    return lookups.join_by_code(t.v_identifiers.select("arrived", "system", "code"), t.v_identifiers).select("arrived", "terminal_id")


@query("c33_dead_terminals", "SELECT terminal_id FROM v_terminals WHERE terminal_id NOT IN (SELECT stop_id FROM v_stop_times)")
def _(t):
    return lookups.dead_terminals(t.v_terminals, t.v_stop_times.select(F.col("stop_id").alias("terminal_id"))).select("terminal_id")


@query("c34_legacy_terminals", "SELECT terminal_id FROM v_terminals WHERE terminal_id NOT IN (SELECT entity_id FROM v_candidates WHERE source = 'osm')")
def _(t):
    a = t.v_candidates.select(F.col("entity_id").alias("terminal_id"), F.when(F.col("source") == "osm", "skeleton").otherwise("other").alias("run_kind"))
    return lookups.legacy_terminals(t.v_terminals, a).select("terminal_id")


@query("c35_review_view", "WITH c AS (SELECT terminal_id, min(code) AS code FROM v_identifiers WHERE is_primary GROUP BY 1), s AS (SELECT entity_id, arg_max(field, (observed_at, field)) AS stage FROM v_candidates GROUP BY 1) SELECT r.review_id, t.name, t.locked, c.code, s.stage FROM v_reviews r LEFT JOIN v_terminals t ON t.terminal_id = r.terminal_id LEFT JOIN c ON c.terminal_id = r.terminal_id LEFT JOIN s ON s.entity_id = r.terminal_id")
def _(t):
    log = t.v_candidates.select(F.col("entity_id").alias("terminal_id"), F.col("field").alias("stage"), F.col("observed_at").alias("at"))
    return lookups.review_view(t.v_reviews, t.v_terminals, t.v_identifiers, log).select("review_id", "name", "locked", "code", "stage")


@query("c36_code_conflicts", """WITH m AS (SELECT DISTINCT (arrived + 1) % 500 AS terminal_id, code FROM v_identifiers WHERE system = 'osm' AND arrived % 3 = 0), h AS (SELECT code, terminal_id AS owner FROM v_identifiers WHERE system = 'osm')
    SELECT m.terminal_id, m.code, h.owner FROM m JOIN h ON h.code = m.code WHERE m.terminal_id <> h.owner UNION SELECT h.owner, h.code, h.owner FROM h WHERE h.owner IN (SELECT terminal_id FROM m) AND h.code NOT IN (SELECT code FROM m)""")
def _(t):
    m = t.v_identifiers.where("system = 'osm' AND arrived % 3 = 0").select(((F.col("arrived") + 1) % 500).alias("terminal_id"), "code").distinct()
    return lookups.code_conflicts(m, t.v_identifiers, "osm").select("terminal_id", "code", "owner")


@query("c37_place_city", "SELECT 3000000 + s_suppkey AS place_id, n_name AS city FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 2000000 + n_nationkey, n_name FROM nation")
def _(t):
    places = t.v_places.withColumn("tz", F.lit("UTC"))
    return lookups.place_city(places, summaries.closure_table(places)).select("place_id", "city")


@query("c38_terminal_card", "SELECT t.terminal_id, (SELECT count(*) FROM v_identifiers i WHERE i.terminal_id = t.terminal_id) AS codes, (SELECT count(*) FROM v_reviews r WHERE r.terminal_id = t.terminal_id) AS reviews FROM v_terminals t")
def _(t):
    tags = t.v_terminals.select("terminal_id", F.lit("settlement").alias("key"), F.col("settlement").alias("value"))
    stats = t.v_terminals.select("terminal_id", F.lit(0).alias("times"))
    alias = t.v_terminals.select("terminal_id", F.col("name").alias("alias"))
    card = lookups.terminal_card(t.v_terminals, tags, stats, alias, t.v_reviews, t.v_identifiers)
    return card.select("terminal_id", F.when(F.col("identifiers").isNull(), 0).otherwise(F.size("identifiers")).cast("long").alias("codes"), F.when(F.col("reviews").isNull(), 0).otherwise(F.size("reviews")).cast("long").alias("reviews"))


# ---- linkage


def sim_sql(x: str, y: str) -> str:
    """Similarity of two names of one word each, of which neither holds the other."""
    return f"CASE WHEN {x} = {y} THEN 1e0 ELSE 1e0 - levenshtein({x}, {y}) / greatest(length({x}), length({y}))::DOUBLE END"


def left_side(t: Tables) -> DataFrame:
    return t.v_terminals.select(F.col("terminal_id").alias("left_id"), F.col("terminal_id").alias("ordinal"), "name", "lat", "lon", "settlement", "transport", "source", no_codes().alias("codes"))


def right_side(t: Tables) -> DataFrame:
    return t.v_records.select(F.col("record_id").alias("right_id"), F.col("record_id").alias("ordinal"), "name", "lat", "lon", "settlement", "transport", "source", no_codes().alias("codes"))


def records_sql(settlement: str = "settlement") -> str:
    """All pairs of terminals and records with their scores, as C03 has them for this data."""
    place = f"CASE WHEN {settlement} IS NULL THEN 0e0 ELSE 15e-2 END"
    return f"""names AS (SELECT terminal_id AS left_id, name, lat, lon, {settlement} AS settlement, transport, trim(lower(replace(name, '#', ''))) AS x FROM v_terminals), held AS (SELECT record_id AS right_id, name AS rname, lat AS rlat, lon AS rlon, settlement AS rset, trim(regexp_replace(lower(name), '[ .,-]+', ' ', 'g')) AS y FROM v_records),
both_sides AS (SELECT *, CASE WHEN rlat IS NOT NULL THEN {hav('lat', 'lon', 'rlat', 'rlon')} * 1000e0 END AS metres FROM names, held),
scored AS (SELECT left_id, right_id, metres, (((({sim_sql('x', 'y')}) * 45e-2 + CASE WHEN metres IS NULL THEN 0e0 WHEN metres <= 100 THEN 3e-1 WHEN metres <= 500 THEN 6e-1 * 3e-1 WHEN metres <= 2000 THEN 25e-2 * 3e-1 ELSE 0e0 END) + CASE WHEN settlement = rset THEN 15e-2 ELSE 0e0 END) + CASE WHEN transport = 'bus' THEN 1e-1 ELSE 0e0 END) / (45e-2 + CASE WHEN metres IS NULL THEN 0e0 ELSE 3e-1 END + {place.replace(settlement, 'settlement')} + 1e-1) AS score,
    metres IS NULL OR pow((lat - rlat) * 111000.0, 2) + pow((lon - rlon) * 111000.0 * (1.0 - 0.0000152 * lat * lat), 2) <= 4000000 AS near, right(settlement, 1) = right(rset, 1) AS akin FROM both_sides)"""


RECORDS = records_sql()


def greedy_sql(settlement: str = "settlement") -> str:
    """The serial loop of C04 over the left rows, with the right rows used so far as a list."""
    return f"""RECURSIVE {records_sql(settlement)},
cand AS MATERIALIZED (SELECT left_id, right_id, score, coalesce(metres <= 500, FALSE) AS guard, count(*) OVER (PARTITION BY left_id) AS size FROM scored WHERE near AND score > 0 AND (metres IS NOT NULL OR score >= 0.45 - 1e-9)),
ids AS (SELECT left_id, row_number() OVER (ORDER BY left_id) AS i FROM names),
run AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS used, NULL::BIGINT AS left_id, NULL::BIGINT AS right_id, 0e0 AS score, 0e0 AS second, '' AS result
    UNION ALL SELECT i, CASE WHEN result <> 'identity_only' THEN list_append(used, right_id) ELSE used END, left_id, right_id, score, second, result
    FROM (SELECT *, CASE WHEN score >= 0.6 AND (score - second >= 0.1 OR second = 0) AND guard THEN 'enriched' WHEN size > 1 AND score >= 0.5 AND score - second < 0.05 THEN 'ambiguous' ELSE 'identity_only' END AS result
        FROM (SELECT n.i, any_value(r.used) AS used, n.left_id, arg_max(c.right_id, (c.score, -c.right_id)) AS right_id, coalesce(max(c.score), 0e0) AS score, coalesce(list_reverse_sort(list(c.score) FILTER (c.score IS NOT NULL))[2], 0e0) AS second, coalesce(arg_max(c.guard, (c.score, -c.right_id)), FALSE) AS guard, coalesce(max(c.size), 0) AS size
            FROM run r JOIN ids n ON n.i = r.i + 1 LEFT JOIN cand c ON c.left_id = n.left_id AND NOT list_contains(r.used, c.right_id) GROUP BY n.i, n.left_id) x) y),
greedy AS (SELECT left_id, right_id AS best, CASE WHEN result <> 'identity_only' THEN right_id END AS right_id, score, second, result FROM run WHERE i > 0)"""


GREEDY = greedy_sql()


@query("c01_blocked_fuzzy_join", f"WITH {GREEDY} SELECT left_id, right_id, round(score, 6) AS score, round(second, 6) AS second, result FROM greedy")
def _(t):
    return linkage.blocked_fuzzy_join(left_side(t), right_side(t)).withColumns({"score": r6("score"), "second": r6("second")})


@query("c01_candidates_near", f"WITH {RECORDS} SELECT left_id, right_id FROM scored WHERE near AND (metres IS NOT NULL OR score >= 0.45 - 1e-9)")
def _(t):
    return linkage.link_candidates(left_side(t), right_side(t))


@query("c02_full_fuzzy_join", f"""WITH {RECORDS}, ranked AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS after FROM scored WHERE score > 0 WINDOW w AS (PARTITION BY left_id ORDER BY score DESC, right_id)),
top AS (SELECT left_id, right_id, score, coalesce(after, 0) AS second, metres FROM ranked WHERE k = 1),
told AS (SELECT *, CASE WHEN score >= 0.6 AND (score - second >= 0.1 OR second = 0) AND coalesce(metres <= 500, FALSE) THEN 'enriched' WHEN score >= 0.5 AND score - second < 0.05 THEN 'ambiguous' ELSE 'identity_only' END AS result FROM top)
SELECT t.terminal_id AS left_id, CASE WHEN result <> 'identity_only' THEN right_id END AS right_id, coalesce(result, 'identity_only') AS result FROM v_terminals t LEFT JOIN told ON told.left_id = t.terminal_id""")
def _(t):
    return linkage.full_fuzzy_join(left_side(t), right_side(t)).select("left_id", "right_id", "result")


@query("c05_unmatched_right", f"WITH {GREEDY} SELECT right_id FROM held WHERE right_id NOT IN (SELECT right_id FROM greedy WHERE right_id IS NOT NULL)")
def _(t):
    return linkage.unmatched_right(right_side(t), linkage.blocked_fuzzy_join(left_side(t), right_side(t))).select("right_id")


@query("c06_merge_enrichment", f"""WITH {greedy_sql("CASE WHEN terminal_id % 2 = 0 THEN settlement END")}
SELECT n.left_id, n.name, h.rname AS alt_name, round(n.lat, 6) AS lat, round(n.lon, 6) AS lon, coalesce(n.settlement, h.rset) AS settlement, n.transport FROM names n LEFT JOIN greedy g ON g.left_id = n.left_id AND g.result = 'enriched' LEFT JOIN held h ON h.right_id = g.right_id""")
def _(t):
    l, r = left_side(t).withColumn("settlement", F.when(F.col("left_id") % 2 == 0, F.col("settlement"))), right_side(t)
    return linkage.merge_enrichment(l, r, linkage.blocked_fuzzy_join(l, r)).drop("codes").withColumns({"lat": r6("lat"), "lon": r6("lon")})


def stop_side(t: Tables) -> DataFrame:
    return t.v_terminals.select(F.col("terminal_id").alias("stop_key"), "name", (F.col("lat") + 0.001).alias("lat"), "lon", "settlement", F.lit("").alias("transport"), F.lit("mintrans").alias("source"), F.lit("urban").alias("density"), no_codes().alias("codes"))


def term_side(t: Tables) -> DataFrame:
    return t.v_terminals.select("terminal_id", "name", "lat", "lon", "settlement", "transport", "source", no_codes().alias("codes"), (F.col("terminal_id") % 3 != 0).alias("final"))


@query("c07_attach_candidates", "SELECT s.terminal_id AS stop_key, t.terminal_id FROM v_terminals s JOIN v_terminals t ON floor((s.lat + 0.001) / 0.5) - floor(t.lat / 0.5) BETWEEN -1 AND 1 AND floor(s.lon / 0.5) - floor(t.lon / 0.5) BETWEEN -1 AND 1")
def _(t):
    return linkage.attach_candidates(stop_side(t), term_side(t))


#: Candidates of stops with name similarity, distance, score and guard, as C08 has them for this data: names of one word, no codes, no transport, sources of two voices.
SCORED = f"""pair AS (SELECT s.terminal_id AS stop_key, t.terminal_id AS cand_no, {hav('(s.lat + 0.001)', 's.lon', 't.lat', 't.lon')} * 1000e0 AS metres, s.settlement = t.settlement AS same,
    {sim_sql("lower(replace(s.name, '#', ''))", "lower(replace(t.name, '#', ''))")} AS sim
    FROM v_terminals s JOIN v_terminals t ON floor((s.lat + 0.001) / 0.5) - floor(t.lat / 0.5) BETWEEN -1 AND 1 AND floor(s.lon / 0.5) - floor(t.lon / 0.5) BETWEEN -1 AND 1),
scored AS (SELECT stop_key, cand_no, metres, metres <= 500 AS guard, ((sim * 45e-2 + CASE WHEN metres <= 100 THEN 1e0 WHEN metres <= 500 THEN 6e-1 WHEN metres <= 2000 THEN 25e-2 ELSE 0e0 END * 3e-1) + CASE WHEN same THEN 15e-2 ELSE 0e0 END) / (45e-2 + 3e-1 + 15e-2) AS value FROM pair)"""


@query("c08_score_pair_attach", f"WITH {SCORED} SELECT stop_key, cand_no, round(value, 6) AS value, 1e0 AS trust, guard, round(metres, 6) AS metres FROM scored")
def _(t):
    s, m = stop_side(t), term_side(t)
    return linkage.scored_attach(s, m).select("stop_key", "cand_no", r6("s.value").alias("value"), "s.trust", "s.guard", r6("s.metres").alias("metres"))


@query("c09_trust", "SELECT event_id, CASE WHEN origin = 'seed' THEN 0.4 WHEN source = 'osm' THEN 0.6 ELSE 1.0 END AS trust FROM v_candidates")
def _(t):
    return t.v_candidates.select("event_id", linkage.trust(F.when(F.col("origin") == "seed", "seed").otherwise(F.col("source")), F.lit("MOTIS ")).alias("trust"))


@query("c10_match_best", f"""WITH {SCORED}, best AS (SELECT stop_key, count(*) AS n, arg_max(cand_no, (value, -cand_no)) AS cand_no, max(value) AS value, arg_max(guard, (value, -cand_no)) AS guard FROM scored GROUP BY stop_key),
other AS (SELECT b.*, (SELECT min(s.value) FROM scored s WHERE s.stop_key = b.stop_key AND s.cand_no <> b.cand_no) AS low FROM best b)
SELECT stop_key, cand_no, n, CASE WHEN n > 1 AND value >= 0.5 AND value - low < 0.05 THEN 'duplicate_ambiguous' WHEN value >= 0.6 AND guard THEN 'verified' WHEN value >= 0.5 THEN 'low_confidence' ELSE 'rejected' END AS decision, round(value, 6) AS value FROM other""")
def _(t):
    return linkage.best_attach(stop_side(t), term_side(t)).select("stop_key", "cand_no", "n", "decision", r6("s.value").alias("value"))


@query("c11_match_trip_stops")
def _(t):
    s, m = stop_side(t), term_side(t)
    trips = t.v_stop_times.join(s.select(F.col("stop_key").alias("stop_id")), "stop_id", "left_semi").select("trip_id", F.col("seq").cast("int").alias("seq"), F.col("stop_id").alias("stop_key"))
    # Stops that no trip asks for need no candidates.
    asked = s.join(trips.select("stop_key"), "stop_key", "left_semi")
    scored = linkage.few_attach(asked, m, linkage.longest_trip(trips) + 1)
    return linkage.match_trip_stops(trips, scored).withColumn("value", r6("value"))


@query("c18_legacy_match", f"""WITH {RECORDS}, best AS (SELECT left_id, arg_max(right_id, (score, -right_id)) AS right_id, max(score) AS score FROM scored WHERE near AND (metres IS NOT NULL OR score >= 0.45 - 1e-9) GROUP BY left_id)
SELECT t.terminal_id AS left_id, CASE WHEN score >= 0.6 THEN right_id END AS right_id, round(coalesce(score, 0), 6) AS score, CASE WHEN score >= 0.6 THEN 'matched' ELSE 'review' END AS outcome, CASE WHEN score >= 0.6 THEN NULL ELSE 'legacy_unmatched' END AS reason FROM v_terminals t LEFT JOIN best ON best.left_id = t.terminal_id""")
def _(t):
    return linkage.legacy_match(left_side(t), right_side(t)).withColumn("score", r6("score"))


@query("d11_collapse_stop_area", "SELECT min(terminal_id) AS record_id, count(*) AS members FROM (SELECT terminal_id, lat, lon FROM v_terminals) GROUP BY lat, lon")
def _(t):
    rows = t.v_terminals.select(F.col("terminal_id").alias("record_id"), F.col("terminal_id").alias("ordinal"), F.lit("Same place").alias("name"), "lat", "lon", "transport", no_codes().alias("codes"))
    return linkage.collapse_stop_area(rows).select("record_id", "members")


@query("d12_group_terminals", "SELECT terminal_id AS stop_id, min(terminal_id) OVER (PARTITION BY lat, lon) AS terminal_id FROM v_terminals")
def _(t):
    return linkage.group_terminals(t.v_terminals.select(F.col("terminal_id").alias("stop_id"), F.col("terminal_id").alias("ordinal"), "lat", "lon"))


# ---- summaries


@query("d01_coverage_by_region", "SELECT region, count(*) AS total, count(*) FILTER (score >= 0.4) AS matched, round(count(*) FILTER (score >= 0.4) / count(*)::DOUBLE, 6) AS ratio FROM v_best GROUP BY region")
def _(t):
    return summaries.coverage_by_region(t.v_best, 0.4).withColumn("ratio", r6("ratio"))


@query("d02_gate_pass", "SELECT coalesce(string_agg(region, ',' ORDER BY region), '') AS below, count(*) = 0 AS passed FROM (SELECT region FROM v_best GROUP BY region HAVING count(*) FILTER (score >= 0.4) / count(*)::DOUBLE < 0.55)")
def _(t):
    return summaries.gate_pass(summaries.coverage_by_region(t.v_best, 0.4), 0.55).select(F.array_join("below", ",").alias("below"), "passed")


#: Each stop by its best score alone; a stop without one has 0. Whether the pair is near isn't asked.
SWEEP = "SELECT threshold, count(*) FILTER (coalesce(score, 0) >= threshold) AS verified, count(*) FILTER (coalesce(score, 0) < threshold AND coalesce(score, 0) >= threshold - 0.1) AS in_margin, count(*) AS total FROM v_best, (SELECT unnest([0.5, 0.7, 0.9])::DOUBLE AS threshold) GROUP BY threshold"


@query("d03_threshold_sweep", f"SELECT *, total - verified - in_margin AS rejected, round(verified / total::DOUBLE, 6) AS rate FROM ({SWEEP})")
def _(t):
    return summaries.threshold_sweep(t.v_best, [0.5, 0.7, 0.9]).withColumn("rate", r6("rate"))


@query("d04_calibrate", f"SELECT threshold, verified, 'clean' AS set, 0.0 AS shift_m FROM ({SWEEP}) UNION ALL SELECT threshold, count(*) FILTER (score - 0.15 >= threshold), 'shifted', 555.0 FROM v_best, (SELECT unnest([0.5, 0.7, 0.9])::DOUBLE AS threshold) GROUP BY threshold")
def _(t):
    worse = t.v_best.withColumn("score", F.col("score") - 0.15)
    return summaries.calibrate(t.v_best, worse, [0.5, 0.7, 0.9], 0.005).select("threshold", "verified", "set", "shift_m")


@query("d05_recommend_threshold", f"SELECT coalesce(max(threshold) FILTER (verified / total::DOUBLE >= 0.3), min(threshold)) AS threshold FROM ({SWEEP})")
def _(t):
    return summaries.recommend_threshold(summaries.threshold_sweep(t.v_best, [0.5, 0.7, 0.9]), 0.3).select("threshold")


@query("d06_compare_gates", "SELECT region, round(count(*) FILTER (score >= 0.4) / count(*)::DOUBLE, 6) AS soft_rate, round(count(*) FILTER (decision = 'verified') / count(*)::DOUBLE, 6) AS verified_rate FROM v_best GROUP BY region")
def _(t):
    return summaries.compare_gates(t.v_best, 0.4).select("region", r6("soft_rate").alias("soft_rate"), r6("verified_rate").alias("verified_rate"))


@query("d07_summarize_by_route", "SELECT route_id, count(*) AS n_in, count(*) FILTER (outcome = 'promoted') AS promoted, count(*) FILTER (outcome = 'staged') AS staged, count(*) FILTER (outcome = 'dead') AS dead FROM v_outcomes GROUP BY route_id")
def _(t):
    return summaries.summarize_by_route(t.v_outcomes)


@query("d08_full_trip_rate", "SELECT round(count(*) FILTER (outcome = 'promoted') / count(*)::DOUBLE, 6) AS rate FROM v_outcomes")
def _(t):
    return summaries.full_trip_rate(t.v_outcomes).select(r6("rate").alias("rate"))


CHURN = "WITH p AS (SELECT trip_id FROM v_trips WHERE trip_id % 3 <> 0), c AS (SELECT trip_id FROM v_trips WHERE trip_id % 5 <> 0), q AS (SELECT (SELECT count(*) FROM p) AS old, (SELECT count(*) FROM c) AS new, (SELECT count(*) FROM c WHERE trip_id NOT IN (SELECT trip_id FROM p)) AS added, (SELECT count(*) FROM p WHERE trip_id NOT IN (SELECT trip_id FROM c)) AS removed)"


@query("d09_churn", f"{CHURN} SELECT old, new, added, removed, round((added + removed) / greatest(old, new)::DOUBLE, 6) AS churn, round(removed / old::DOUBLE, 6) AS disappeared, (added + removed) / greatest(old, new)::DOUBLE > 0.2 OR removed / old::DOUBLE > 0.2 AS alert FROM q")
def _(t):
    out = summaries.churn(t.v_trips.where("trip_id % 3 <> 0"), t.v_trips.where("trip_id % 5 <> 0"))
    return out.withColumn("churn", r6("churn")).withColumn("disappeared", r6("disappeared"))


@query("d10_row_balance", "SELECT route_id, count(*) AS n_in, TRUE AS balanced FROM v_outcomes GROUP BY route_id")
def _(t):
    return summaries.row_balance(summaries.summarize_by_route(t.v_outcomes), "n_in", summaries.OUTCOMES).select("route_id", "n_in", "balanced")


@query("d13_count_by_state", "SELECT state, count(*) AS n FROM v_outcomes GROUP BY state")
def _(t):
    return summaries.count_by_state(t.v_outcomes)


@query("d14_terminal_stats", "WITH x AS (SELECT s.stop_id, provisional, CASE WHEN t.valid_to IS NULL THEN s.trip_id END AS live FROM v_stop_times s JOIN v_trips t ON t.trip_id = s.trip_id) SELECT terminal_id, count(x.stop_id) AS times, count(*) FILTER (provisional) AS provisional, count(DISTINCT live) AS live_trips, count(x.stop_id) = 0 AS dead FROM v_terminals LEFT JOIN x ON x.stop_id = terminal_id GROUP BY terminal_id")
def _(t):
    return summaries.terminal_stats(t.v_terminals, t.v_stop_times.withColumnRenamed("stop_id", "terminal_id"), t.v_trips)


@query("d15_route_listing", "SELECT r.route_id, r.name, r.carrier, (SELECT count(*) FROM v_trips t WHERE t.route_id = r.route_id AND t.valid_to IS NULL) AS live_trips FROM v_routes r")
def _(t):
    return summaries.route_listing(t.v_routes, t.v_trips).select("route_id", "name", "carrier", "live_trips")


@query("d16_trip_listing", "SELECT t.trip_id, count(s.seq) AS stops, count(*) FILTER (s.provisional) AS provisional, t.valid_to IS NULL AS live FROM v_trips t LEFT JOIN v_stop_times s ON s.trip_id = t.trip_id GROUP BY t.trip_id, t.valid_to")
def _(t):
    trips = t.v_trips.dropDuplicates(["trip_id"])
    return summaries.trip_listing(trips, t.v_stop_times).select("trip_id", "stops", "provisional", "live")


@query("d17_route_regions", "SELECT route_id, substr(code, 1, 2) AS region FROM v_routes UNION SELECT route_id, region FROM v_outcomes")
def _(t):
    return summaries.route_regions(t.v_routes, t.v_outcomes)


@query("d18_price_totals", "WITH p AS (SELECT l_orderkey AS journey_id, l_returnflag AS currency, sum(l_quantity) AS amount FROM lineitem GROUP BY ALL) SELECT journey_id, count(*) > 1 AS mixed, CASE WHEN count(*) = 1 THEN round(max(amount), 6) END AS total FROM p GROUP BY journey_id")
def _(t):
    legs = t.lineitem.select(F.col("l_orderkey").alias("journey_id"), F.col("l_returnflag").alias("currency"), F.col("l_quantity").alias("price"))
    return summaries.price_totals(legs).select("journey_id", "mixed", F.round("total", 6).alias("total"))


@query("d19_registry_stops", "SELECT DISTINCT s.stop_id, n.name, '' AS settlement FROM v_stop_times s JOIN v_stops n ON n.stop_id = s.stop_id")
def _(t):
    return summaries.registry_stops(t.v_stop_times.join(t.v_stops.select("stop_id", "name"), "stop_id"))


@query("d20_origin_stops", "SELECT DISTINCT stop_id FROM v_stop_times WHERE seq = 0")
def _(t):
    return summaries.origin_stops(t.v_stop_times)


@query("d21_network_bounds", f"WITH {LEGS} SELECT min(departure_s) AS first_departure_s, max(arrival_s) AS last_arrival_s FROM conn")
def _(t):
    return summaries.network_bounds(bus_legs(t))


@query("d22_feed_stats", 'SELECT \'stops\' AS "table", count(*) AS rows FROM v_stops UNION ALL SELECT \'trips\', count(*) FROM v_trips UNION ALL SELECT \'stop_times\', count(*) FROM v_stop_times')
def _(t):
    return summaries.feed_stats({"stops": t.v_stops, "trips": t.v_trips, "stop_times": t.v_stop_times})


@query("d23_provider_health", "SELECT settlement AS provider, count(*) AS records, count(*) FILTER (lat > 55) AS issues, count(DISTINCT stop_id) FILTER (lat > 55) AS excluded FROM v_stops GROUP BY settlement")
def _(t):
    stops = t.v_stops.withColumnRenamed("settlement", "provider")
    issues = filters.validate_bounds(stops, (0.0, 0.0, 55.0, 180.0)).join(stops.select(F.col("stop_id").alias("entity_id"), "provider"), "entity_id")
    return summaries.provider_health(stops, issues)


@query("d24_daily_quota", "SELECT event_id, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) <= 3 AS admitted FROM events")
def _(t):
    calls = t.events.select("event_id", "ts", F.col("event_type").alias("provider"))
    limits = calls.select("provider").distinct().withColumn("quota", F.lit(3))
    return summaries.daily_quota(calls, limits).select("event_id", "admitted")


@query("d25_kpi_report", f"{CHURN}, k AS (SELECT 'match_rate' AS kpi, region, count(*) FILTER (score >= 0.4) / count(*)::DOUBLE AS value FROM v_best GROUP BY region UNION ALL SELECT 'full_trip_rate', region, count(*) FILTER (outcome = 'promoted') / count(*)::DOUBLE FROM v_outcomes GROUP BY region UNION ALL SELECT 'stuck_staging', NULL, count(*) FILTER (state <> 'expired')::DOUBLE FROM v_outcomes UNION ALL SELECT 'churn', NULL, (added + removed) / greatest(old, new)::DOUBLE FROM q) SELECT kpi, region, round(value, 6) AS value FROM k")
def _(t):
    c = summaries.churn(t.v_trips.where("trip_id % 3 <> 0"), t.v_trips.where("trip_id % 5 <> 0"))
    return summaries.kpi_report(summaries.coverage_by_region(t.v_best, 0.4), t.v_outcomes, t.v_outcomes, c).withColumn("value", r6("value"))


CLOSURE = "WITH RECURSIVE closure(ancestor, descendant, depth) AS (SELECT place_id, place_id, 0 FROM v_places UNION ALL SELECT p.parent_id, c.descendant, c.depth + 1 FROM closure c JOIN v_places p ON p.place_id = c.ancestor WHERE p.parent_id IS NOT NULL)"


@query("d26_closure_table", f"{CLOSURE} SELECT ancestor, descendant, depth FROM closure")
def _(t):
    return summaries.closure_table(t.v_places)


@query("d26_closure_subtree", f"{CLOSURE}, b AS (SELECT descendant FROM closure WHERE ancestor = 1000002) SELECT ancestor, descendant, depth FROM closure WHERE ancestor IN (SELECT descendant FROM b) AND descendant IN (SELECT descendant FROM b)")
def _(t):
    return summaries.closure_table(t.v_places, 1000002)


MOVED = "CASE WHEN level = 2 AND place_id % 2 = 1 THEN 1000000 WHEN level = 4 AND place_id % 5 = 0 THEN place_id + 1 ELSE parent_id END"


@query("d26_closure_update", f"{CLOSURE.replace('closure(', 'moved AS (SELECT place_id, ' + MOVED + ' AS parent_id FROM v_places), closure(').replace('FROM v_places UNION', 'FROM moved UNION').replace('JOIN v_places', 'JOIN moved')} SELECT ancestor, descendant, depth FROM closure")
def _(t):
    moved = t.v_places.withColumn("old_id", F.col("parent_id")).withColumn("parent_id", F.expr(MOVED).cast("bigint"))
    return summaries.closure_update(summaries.closure_table(t.v_places), moved, moved.where("NOT old_id <=> parent_id").select("place_id"))


@query("d27_closure_diff", f"{CLOSURE} SELECT descendant, string_agg(CAST(ancestor AS VARCHAR), ',' ORDER BY ancestor) AS missing FROM closure WHERE descendant % 10 = 0 AND depth > 0 GROUP BY descendant")
def _(t):
    broken = summaries.closure_table(t.v_places).where("descendant % 10 <> 0 OR depth = 0")
    return summaries.closure_diff(t.v_places, broken).select("descendant", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"))


@query("d28_network_indexes", "SELECT trip_id, string_agg(CAST(stop_id AS VARCHAR), '>' ORDER BY seq) AS stops FROM v_stop_times GROUP BY trip_id")
def _(t):
    return summaries.trip_stop_lists(t.v_stop_times).select("trip_id", F.array_join(F.transform("stops", lambda x: x.cast("string")), ">").alias("stops"))


@query("d28_provisional_stops", "SELECT DISTINCT stop_id FROM v_stop_times WHERE provisional")
def _(t):
    return summaries.provisional_stops(t.v_stop_times)


@query("d28_route_stop_lists", "SELECT t.route_id, count(DISTINCT s.stop_id) AS n FROM v_stop_times s JOIN v_trips t ON t.trip_id = s.trip_id GROUP BY t.route_id")
def _(t):
    return summaries.route_stop_lists(t.v_stop_times, t.v_trips).select("route_id", F.size("stops").cast("long").alias("n"))


# ---- sequences


@query("e01_build_connections", f"WITH {LEGS} SELECT trip_id, seq, from_stop, to_stop, departure_s, arrival_s FROM conn")
def _(t):
    return sequences.build_connections(t.v_stop_times)


@query("e02_unwrap_midnight", """WITH raw AS (SELECT trip_id, seq, arrival_s // 60 % 1440 AS arr, departure_s // 60 % 1440 AS dep FROM v_stop_times), f AS (SELECT trip_id, seq, 0 AS half, arr AS t FROM raw UNION ALL SELECT trip_id, seq, 1, dep FROM raw),
    d AS (SELECT *, CASE WHEN t < lag(t) OVER (PARTITION BY trip_id ORDER BY seq, half) THEN 1 ELSE 0 END AS down FROM f), u AS (SELECT trip_id, seq, half, t + 1440 * sum(down) OVER (PARTITION BY trip_id ORDER BY seq, half) AS t FROM d)
    SELECT trip_id, seq, CAST(max(t) FILTER (half = 0) AS BIGINT) AS arr, CAST(max(t) FILTER (half = 1) AS BIGINT) AS dep FROM u GROUP BY trip_id, seq""")
def _(t):
    minute = lambda c: (F.floor(F.col(c) / 60) % 1440).alias(c[:3])
    return sequences.unwrap_midnight(t.v_stop_times.select("trip_id", "seq", minute("arrival_s"), minute("departure_s")))


@query("e05_collapse_consecutive", "WITH m AS (SELECT *, stop_id // 40 AS k FROM v_stop_times), i AS (SELECT *, sum(CASE WHEN k = p THEN 0 ELSE 1 END) OVER (PARTITION BY trip_id ORDER BY seq) AS island FROM (SELECT *, lag(k) OVER (PARTITION BY trip_id ORDER BY seq) AS p FROM m)) SELECT trip_id, CAST(island - 1 AS INT) AS seq, any_value(k) AS stop_id, arg_min(arrival_s, seq) AS arrival_s, arg_max(departure_s, seq) AS departure_s FROM i GROUP BY trip_id, island")
def _(t):
    return sequences.collapse_consecutive(t.v_stop_times.withColumn("stop_id", F.floor(F.col("stop_id") / 40)))


@query("e06_check_monotonic", "SELECT trip_id, min(seq) AS seq FROM (SELECT *, lag(departure_s) OVER (PARTITION BY trip_id ORDER BY seq) AS p FROM (SELECT trip_id, seq, arrival_s - CASE WHEN stop_id % 17 = 0 THEN 5000 ELSE 0 END AS arrival_s, departure_s FROM v_stop_times)) WHERE arrival_s > departure_s OR arrival_s < p GROUP BY trip_id")
def _(t):
    return sequences.check_monotonic(t.v_stop_times.withColumn("arrival_s", F.col("arrival_s") - F.when(F.col("stop_id") % 17 == 0, 5000).otherwise(0)))


@query("e07_check_speeds", f"""WITH x AS (SELECT s.trip_id, s.seq, s.arrival_s, s.departure_s, p.lat, p.lon, p.stop_id % 3 <> 0 AS fin FROM v_stop_times s JOIN v_stops p ON p.stop_id = s.stop_id), y AS (SELECT *, lag(lat) OVER w AS a, lag(lon) OVER w AS b, lag(fin) OVER w AS pf, lag(departure_s) OVER w AS pd FROM x WINDOW w AS (PARTITION BY trip_id ORDER BY seq))
    SELECT trip_id, seq, CASE WHEN fin AND pf THEN 'dead' ELSE 'needs_review' END AS verdict FROM y WHERE a IS NOT NULL AND {hav('a', 'b', 'lat', 'lon')} / (floor((arrival_s - pd) / 60) / 60.0) > 200""")
def _(t):
    terms = t.v_stops.select(F.col("stop_id").alias("terminal_id"), "lat", "lon", (F.col("stop_id") % 3 != 0).alias("final"))
    return sequences.check_speeds(t.v_stop_times.withColumnRenamed("stop_id", "terminal_id"), terms).select("trip_id", "seq", "verdict")


@query("e08_interpolate_position", """WITH x AS (SELECT s.trip_id, s.seq, p.lat, s.stop_id % 3 <> 0 AS m FROM v_stop_times s JOIN v_stops p ON p.stop_id = s.stop_id), y AS (SELECT *, max(CASE WHEN m THEN seq END) OVER (PARTITION BY trip_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ps, min(CASE WHEN m THEN seq END) OVER (PARTITION BY trip_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ns FROM x)
    SELECT y.trip_id, y.seq, round(p.lat + (n.lat - p.lat) * (y.seq - y.ps) / (y.ns - y.ps)::DOUBLE, 6) AS lat, 'seq_proportional' AS method FROM y JOIN x p ON p.trip_id = y.trip_id AND p.seq = y.ps JOIN x n ON n.trip_id = y.trip_id AND n.seq = y.ns WHERE NOT y.m""")
def _(t):
    rows = t.v_stop_times.join(t.v_stops.select("stop_id", "lat", "lon"), "stop_id").select("trip_id", "seq", "lat", "lon", (F.col("stop_id") % 3 != 0).alias("matched"), F.lit(0.0).alias("duration"), F.lit(0.0).alias("distance"))
    return sequences.interpolate_position(rows).select("trip_id", "seq", r6("lat").alias("lat"), "method")


ELECT = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, field ORDER BY CASE WHEN actor_id IS NOT NULL THEN 0 ELSE 1 END, CASE WHEN actor_id IS NOT NULL THEN event_id END, CASE WHEN origin = 'seed' AND actor_id IS NULL THEN 1 ELSE 0 END, confidence DESC, observed_at DESC, event_id) AS n FROM v_candidates) WHERE n = 1"


@query("e09_elect_field", f"SELECT entity_id, field, event_id FROM ({ELECT})")
def _(t):
    return sequences.elect_field(t.v_candidates).select("entity_id", "field", "event_id")


@query("e10_legacy_vote", "WITH b AS (SELECT entity_id, source, confidence FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, event_id) AS n FROM v_candidates) WHERE n = 1) SELECT c_custkey AS entity_id, coalesce(source, 'mintrans') AS source, coalesce(confidence, 0.5) AS confidence FROM customer LEFT JOIN b ON entity_id = c_custkey")
def _(t):
    return sequences.legacy_vote(t.v_candidates, t.customer.select(F.col("c_custkey").alias("entity_id")))


@query("e11_contest_fields", f"SELECT entity_id, field, value, actor_id IS NULL AND entity_id % 2 = 0 AS updated FROM ({ELECT})")
def _(t):
    now = sequences.elect_field(t.v_candidates).where("entity_id % 2 = 1").select("entity_id", "field", "value")
    return sequences.contest_fields(t.v_candidates, now).select("entity_id", "field", "value", "updated")


@query("e12_primary_identifier", "SELECT terminal_id, arrived FROM (SELECT *, row_number() OVER (PARTITION BY terminal_id ORDER BY CASE system WHEN 'manual' THEN 4 WHEN 'yandex' THEN 3 WHEN 'osm' THEN 2 WHEN 'mintrans' THEN 1 ELSE 0 END DESC, arrived) AS n FROM v_identifiers) WHERE n = 1")
def _(t):
    return sequences.primary_identifier(t.v_identifiers).select("terminal_id", "arrived")


@query("e13_settlement_representative", "SELECT settlement, terminal_id FROM (SELECT settlement, terminal_id, row_number() OVER (PARTITION BY settlement ORDER BY n DESC, CASE WHEN transport = 'bus' THEN 0 ELSE 1 END, terminal_id) AS r FROM (SELECT t.settlement, t.terminal_id, t.transport, (SELECT count(*) FROM v_stop_times s WHERE s.stop_id = t.terminal_id) AS n FROM v_terminals t)) WHERE r = 1")
def _(t):
    terms = t.v_terminals.withColumn("kind", F.when(F.col("transport") == "bus", "bus_station").otherwise("station"))
    return sequences.settlement_representative(terms, t.v_stop_times.withColumnRenamed("stop_id", "terminal_id")).select("settlement", "terminal_id")


@query("e14_load_settlements", "SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 AND length(n_name) >= 4 THEN 'replaced' ELSE 'kept' END AS outcome FROM nation UNION ALL SELECT upper(p_brand), 'added' FROM (SELECT DISTINCT p_brand FROM part)")
def _(t):
    canon_rows = t.nation.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), F.lit(1.0).alias("lat"), F.lit(1.0).alias("lon")).union(t.part.select(F.upper("p_brand"), F.lit(2.0), F.lit(2.0)).distinct())
    gaz = t.nation.select(F.col("n_name").alias("name"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))
    return sequences.load_settlements(gaz, canon_rows).select("name", "outcome")


@query("e15_add_stops_to_gazetteer", "SELECT lower(trim(p_name)) AS alias, min(p_partkey) AS stop_id FROM part GROUP BY 1")
def _(t):
    stops = t.part.select(F.col("p_partkey").alias("stop_id"), F.concat("p_name", F.lit(", platform")).alias("name"))
    return sequences.add_stops_to_gazetteer(stops).select("alias", "stop_id")


@query("e16_terminal_schedule", "WITH x AS (SELECT s.stop_id, s.trip_id, s.departure_s, s.seq FROM v_stop_times s JOIN v_trips t ON t.trip_id = s.trip_id WHERE CASE WHEN t.service_id = 1 THEN FALSE WHEN t.service_id = 2 THEN TRUE ELSE t.service_days = '' OR list_contains(string_split(t.service_days, ','), CAST(dayofweek(DATE '1995-03-15') AS VARCHAR)) END) SELECT stop_id, n, trip_id, departure_s FROM (SELECT *, row_number() OVER (PARTITION BY stop_id ORDER BY departure_s, trip_id, seq) AS n FROM x) WHERE n <= 5")
def _(t):
    day = F.to_date(F.lit("1995-03-15"))
    exc = t.v_trips.where("service_id IN (1, 2)").select("service_id", day.alias("date"), F.when(F.col("service_id") == 1, "removed").otherwise("added").alias("exception_type")).distinct()
    return sequences.terminal_schedule(t.v_stop_times, t.v_trips, exc, day, 5)


@query("e17_trip_stop_times", "SELECT trip_id, seq, p.name, coalesce(CASE WHEN s.stop_id % 5 <> 0 THEN arrival_s END, departure_s) AS arrival_s, departure_s FROM v_stop_times s LEFT JOIN v_stops p ON p.stop_id = s.stop_id")
def _(t):
    return sequences.trip_stop_times(t.v_stop_times.withColumn("arrival_s", F.when(F.col("stop_id") % 5 != 0, F.col("arrival_s"))), t.v_stops)


@query("e18_trip_duration", "SELECT trip_id, CASE WHEN count(*) >= 2 THEN arg_max(departure_s, seq) - arg_min(arrival_s, seq) END AS duration_s FROM v_stop_times GROUP BY trip_id")
def _(t):
    return sequences.trip_duration(t.v_stop_times)


@query("e19_backbone_promotable", "SELECT trip_id, count(*) FILTER (stop_id % 4 <> 0) >= 2 AND count(*) FILTER (stop_id % 4 <> 0) * 3 >= count(*) * 2 AS ok FROM v_stop_times GROUP BY trip_id")
def _(t):
    return t.v_stop_times.groupBy("trip_id").agg(F.count_if(F.col("stop_id") % 4 != 0).alias("m"), F.count("*").alias("n")).select("trip_id", sequences.backbone_promotable(F.col("m"), F.col("n")).alias("ok"))


JOURNEYS = "SELECT l_orderkey % 500 AS request_id, l_partkey AS arrival_s, l_linenumber AS transfers, min(l_orderkey) AS journey_id FROM lineitem GROUP BY ALL"


def some_journeys(t: Tables) -> DataFrame:
    return t.lineitem.groupBy((F.col("l_orderkey") % 500).alias("request_id"), F.col("l_partkey").alias("arrival_s"), F.col("l_linenumber").alias("transfers")).agg(F.min("l_orderkey").alias("journey_id"))


@query("e20_pareto_top", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY transfers, arrival_s, journey_id) AS rank FROM (SELECT l_orderkey % 500 AS request_id, l_partkey AS arrival_s, l_linenumber AS transfers, min(l_orderkey) AS journey_id FROM lineitem GROUP BY l_orderkey % 500, l_partkey, l_linenumber)) WHERE rank <= 3")
def _(t):
    return sequences.pareto_top(some_journeys(t))


@query("e20_true_front", "WITH j AS (SELECT l_orderkey % 500 AS request_id, l_partkey AS arrival_s, l_linenumber AS transfers FROM lineitem GROUP BY ALL) SELECT a.request_id, a.arrival_s, a.transfers FROM j a WHERE NOT EXISTS (SELECT 1 FROM j b WHERE b.request_id = a.request_id AND b.arrival_s <= a.arrival_s AND b.transfers <= a.transfers AND (b.arrival_s < a.arrival_s OR b.transfers < a.transfers))")
def _(t):
    return sequences.true_front(some_journeys(t)).select("request_id", "arrival_s", "transfers")


@query("e21_pick_by_preference", "SELECT request_id, arrival_s, transfers FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY arrival_s, transfers, journey_id) AS rank FROM (SELECT l_orderkey % 500 AS request_id, l_partkey AS arrival_s, l_linenumber AS transfers, min(l_orderkey) AS journey_id FROM lineitem GROUP BY l_orderkey % 500, l_partkey, l_linenumber)) WHERE rank = 1")
def _(t):
    return sequences.pick_by_preference(some_journeys(t), "arrival").select("request_id", "arrival_s", "transfers")


@query("e22_latest_per_key", "SELECT entity_id, field, event_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, field ORDER BY observed_at DESC, event_id DESC) AS n FROM v_candidates) WHERE n = 1")
def _(t):
    return sequences.latest_per_key(t.v_candidates, ["entity_id", "field"], [F.desc("observed_at"), F.desc("event_id")]).select("entity_id", "field", "event_id")


@query("e23_attribute_upsert", f"WITH o AS ({ELECT}) SELECT entity_id, field, CASE WHEN event_id % 3 = 0 THEN value || '!' ELSE value END AS value, CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2030-01-01' ELSE observed_at END AS observed_at FROM o")
def _(t):
    old = sequences.elect_field(t.v_candidates)
    new = old.where("event_id % 3 = 0 OR event_id % 2 = 0").select("entity_id", "field", F.when(F.col("event_id") % 3 == 0, F.concat("value", F.lit("!"))).otherwise(F.col("value")).alias("value"), "confidence", F.to_timestamp(F.lit("2030-01-01")).alias("observed_at"))
    return sequences.attribute_upsert(old, new).select("entity_id", "field", "value", F.col("observed_at").cast("timestamp_ntz").alias("observed_at"))


# ---- orders, pages and sets


@query("f01_page", "SELECT terminal_id, name, (SELECT count(*) FROM v_terminals) AS total FROM v_terminals ORDER BY name DESC, terminal_id LIMIT 20 OFFSET 40")
def _(t):
    return tables.page(t.v_terminals.select("terminal_id", "name"), "name", 20, 40, "terminal_id", True)


@query("f02_sort_connections", f"WITH {LEGS} SELECT trip_id, seq, departure_s, arrival_s FROM conn")
def _(t):
    return tables.sort_connections(bus_legs(t)).select("trip_id", "seq", "departure_s", "arrival_s")


@query("f03_chunk_rows", "SELECT terminal_id, CAST((row_number() OVER (PARTITION BY region ORDER BY transport, terminal_id) - 1) // 100 AS INT) AS chunk_no FROM v_terminals")
def _(t):
    return tables.chunk_rows(t.v_terminals.withColumn("code", F.col("terminal_id")), ["region", "transport", "terminal_id"], 500).select("terminal_id", "chunk_no")


@query("f04_review_list", "SELECT review_id, score FROM v_reviews ORDER BY observed_at DESC, review_id DESC LIMIT 50")
def _(t):
    return tables.review_list(t.v_reviews, 50, "observed_at", "review_id").select("review_id", "score")


@query("f05_staging_list", "SELECT trip_id, route_id FROM v_outcomes WHERE region = 'ASIA' ORDER BY route_id, trip_id LIMIT 100")
def _(t):
    return tables.staging_list(t.v_outcomes, "ASIA").select("trip_id", "route_id")


@query("f06_history_list", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 30")
def _(t):
    return tables.history_list(t.events, 30, "ts", "event_id").select("event_id")


@query("g01_union_sources", "SELECT terminal_id AS id, name, transport FROM v_terminals UNION ALL SELECT record_id, name, NULL FROM v_records")
def _(t):
    return tables.union_sources(t.v_terminals.select(F.col("terminal_id").alias("id"), "name", "transport"), t.v_records.select(F.col("record_id").alias("id"), "name"))


@query("g02_intersect_days", "SELECT trip_id, CASE service_days WHEN '' THEN '' WHEN '1,2,3,4,5' THEN '3,5' WHEN '0,6' THEN '6' ELSE '3' END AS days FROM v_trips")
def _(t):
    days = F.transform(F.filter(F.split("service_days", ","), lambda x: x != ""), lambda x: x.cast("int"))
    return t.v_trips.select("trip_id", clock.weekday_csv(clock.intersect_days(days, F.array(F.lit(6), F.lit(5), F.lit(3)))).alias("days"))


@query("g03_diff_projections", "SELECT terminal_id, CASE WHEN terminal_id % 5 = 0 THEN 'removed' ELSE 'changed' END AS change FROM v_terminals WHERE terminal_id % 5 = 0 OR terminal_id % 7 = 0")
def _(t):
    new = t.v_terminals.where("terminal_id % 5 <> 0").withColumn("name", F.when(F.col("terminal_id") % 7 == 0, "x").otherwise(F.col("name")))
    return tables.diff_projections(t.v_terminals.withColumn("observed_at", F.lit(1)), new.withColumn("observed_at", F.lit(2)), ["terminal_id"])


@query("g04_compare_snapshots", "SELECT count(*) AS old, count(*) FILTER (route_id % 10 <> 0) AS new, 0 AS added, count(*) FILTER (route_id % 10 = 0) AS removed, count(*) FILTER (route_id % 10 <> 0 AND route_id % 4 = 0) AS changed FROM v_routes")
def _(t):
    stops = t.v_outcomes.select("route_id", F.lit("forward").alias("direction"), F.col("trip_id").alias("seq"), "region").select("route_id", "direction", "seq", F.col("region").alias("stop_id"))
    new = t.v_routes.where("route_id % 10 <> 0").withColumn("carrier", F.when(F.col("route_id") % 4 == 0, "other").otherwise(F.col("carrier")))
    return tables.compare_snapshots(tables.route_signatures(t.v_routes, stops), tables.route_signatures(new, stops), 0.2).select("old", "new", "added", "removed", "changed")


@query("g05_minus_previous", "SELECT DISTINCT trip_id FROM v_trips WHERE trip_id % 5 = 0 AND trip_id % 3 <> 0")
def _(t):
    return tables.minus_previous(t.v_trips.where("trip_id % 3 <> 0"), t.v_trips.where("trip_id % 5 <> 0"))


@query("a15_stage_records", "SELECT terminal_id AS code, max(arrived) AS arrived FROM v_identifiers GROUP BY terminal_id")
def _(t):
    rows = t.v_identifiers.select(F.lit("r1").alias("run_id"), F.lit("osm").alias("source"), F.col("terminal_id").alias("code"), "arrived")
    return tables.stage_records(rows).select("code", "arrived")


@query("a16_merge_by_key", "SELECT route_id, CASE WHEN route_id % 3 = 0 THEN 'new' ELSE carrier END AS carrier, CASE WHEN route_id % 3 <> 0 THEN valid_to END AS valid_to FROM v_routes")
def _(t):
    return tables.merge_by_key(t.v_routes.select("route_id", "carrier", "valid_to"), t.v_routes.where("route_id % 3 = 0").select("route_id", F.lit("new").alias("carrier")), ["route_id"])


@query("a17_append_stop_times", "SELECT trip_id, seq, CASE WHEN trip_id % 2 = 0 THEN departure_s + 60 ELSE departure_s END AS departure_s FROM v_stop_times")
def _(t):
    old = t.v_stop_times.select("trip_id", "seq", F.col("departure_s").cast("long").alias("departure_s"))
    return tables.append_stop_times(old, old.where("trip_id % 2 = 0").withColumn("departure_s", F.col("departure_s") + 60))


# ---- columns


@query("h01_normalize_name", "SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(trim(c_name)), '[^a-z0-9 .,-]', '', 'g'), '[ .,-]+', ' ', 'g')) AS n FROM customer")
def _(t):
    return t.customer.select("c_custkey", names.normalize_name(F.col("c_name")).alias("n"))


@query("h02_core_name", "SELECT p_partkey, lower(trim(p_name)) AS core FROM part")
def _(t):
    return t.part.select("p_partkey", names.core_name(F.concat(F.lit("г. "), "p_name", F.lit(" автовокзал"))).alias("core"))


@query("h03_extract_settlement", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'бердск' WHEN p_partkey % 3 = 1 THEN 'кемеровский' ELSE '' END AS settlement FROM part")
def _(t):
    n = F.when(F.col("p_partkey") % 3 == 0, "ОП г. Бердск вокзал").when(F.col("p_partkey") % 3 == 1, "Кемеровский АВ").otherwise("Вокзал")
    return t.part.select("p_partkey", names.extract_settlement(n).alias("settlement"))


@query("h04_same_settlement", "SELECT p_partkey, p_partkey % 2 = 0 AS same, TRUE AS keyed FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, FALSE, FALSE FROM part WHERE p_partkey % 2 = 1")
def _(t):
    a, b = F.when(F.col("p_partkey") % 2 == 0, "Мариинский").otherwise("Томск"), F.lit("Мариинск")
    return t.part.select("p_partkey", names.same_settlement(a, b).alias("same"), F.arrays_overlap(names.settlement_keys(a), names.settlement_keys(b)).alias("keyed"))


SIM = "CASE WHEN x = y THEN 1.0 WHEN length(x) >= 3 AND length(y) >= 3 AND (contains(x, y) OR contains(y, x)) THEN 0.9 ELSE 1 - levenshtein(x, y) / greatest(length(x), length(y))::DOUBLE END"


@query("h06_name_similarity", f"SELECT p_partkey, round({SIM}, 6) AS sim, round(CASE WHEN x = y THEN 0 ELSE levenshtein(x, y) / greatest(length(x), length(y))::DOUBLE END, 6) AS lev FROM (SELECT p_partkey, lower(replace(p_name, ' ', '')) AS x, lower(replace(p_brand, '#', '')) AS y FROM part)")
def _(t):
    a, b = F.replace("p_name", F.lit(" "), F.lit("")), F.col("p_brand")
    return t.part.select("p_partkey", r6(names.name_similarity(a, b)).alias("sim"), r6(names.lev_ratio(a, b)).alias("lev"))


@query("h08_expand_abbreviations", "SELECT p_partkey, 'остановочный пункт ' || trim(p_name) || ' автовокзал' AS full_name FROM part")
def _(t):
    return t.part.select("p_partkey", names.expand_abbreviations(F.concat(F.lit("ОП "), "p_name", F.lit(" «ав»"))).alias("full_name"))


@query("h09_transliterate", "SELECT p_partkey, 'Shhuka Yo`' || p_partkey AS latin, 'Tomskaya Oblast' AS admin FROM part")
def _(t):
    return t.part.select("p_partkey", names.transliterate(F.concat(F.lit("Щука Ёь"), F.col("p_partkey").cast("string"))).alias("latin"), names.translate_admin(F.lit("Томская область")).alias("admin"))


@query("h10_slug", "SELECT c_custkey, rtrim(substr(trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-'), 1, 40)) AS slug, substr(sha256(c_name || '|' || '54'), 1, 8) AS hash FROM customer")
def _(t):
    return t.customer.select("c_custkey", names.slug(F.col("c_name")).alias("slug"), names.name_hash(F.col("c_name"), F.lit("54")).alias("hash"))


@query("h11_distances", f"SELECT terminal_id, round({hav('lat', 'lon', '55.0', '83.0')}, 6) AS km, round((pow((lat - 55.0) * 111000.0, 2) + pow((lon - 83.0) * 111000.0 * (1.0 - 0.0000152 * lat * lat), 2)) / 1e6, 6) AS m2 FROM v_terminals")
def _(t):
    a = (F.col("lat"), F.col("lon"), F.lit(55.0), F.lit(83.0))
    return t.v_terminals.select("terminal_id", r6(geo.haversine_km(*a)).alias("km"), r6(geo.planar_m2(*a) / 1e6).alias("m2"))


@query("h12_walking", "SELECT p_partkey, CAST(ceil(p_partkey / 1000.0 / 5 * 60) AS INT) AS minutes, CAST(floor(p_partkey / 5000.0 * 60) + 2 AS INT) AS transfer, round(p_partkey / 60.0 * 5, 6) AS radius FROM part")
def _(t):
    k = F.col("p_partkey").cast("double")
    return t.part.select("p_partkey", geo.walk_minutes(k / 1000.0).alias("minutes"), geo.walk_transfer_minutes(k).alias("transfer"), r6(geo.walk_radius_km(k)).alias("radius"))


@query("h13_grid_cell", "SELECT terminal_id, CAST(floor(lat / 0.5) AS INT) AS r, CAST(floor(lon / 0.5) AS INT) AS c, printf('%.4f,%.4f', lat, lon) AS cache_key, (CAST(floor(lat / 0.5) AS BIGINT) << 32) | CAST(floor(lon / 0.5) AS BIGINT) AS packed FROM v_terminals")
def _(t):
    cell = geo.grid_cell(F.col("lat"), F.col("lon"), 0.5)
    return t.v_terminals.select("terminal_id", cell["r"].alias("r"), cell["c"].alias("c"), geo.geo_cache_key(F.col("lat"), F.col("lon")).alias("cache_key"), geo.geo_cell(F.col("lat"), F.col("lon"), 0.5).alias("packed"))


@query("h14_stop_types", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'airport' WHEN 1 THEN 'hub' WHEN 2 THEN 'platform' ELSE 'station' END AS kind, CASE p_partkey % 4 WHEN 0 THEN 'airport' WHEN 2 THEN 'platform' ELSE 'hub' END AS tagged FROM part")
def _(t):
    n = F.element_at(F.array(F.lit("Аэропорт Томск"), F.lit("Томск АВ"), F.lit("Пов. на сад"), F.lit("Томск")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t.part.select("p_partkey", names.infer_stop_type(n).alias("kind"), names.classify_stop(n, F.create_map(F.lit("amenity"), F.lit("bus_station"))).alias("tagged"))


@query("h15_signals", "SELECT p_partkey, p_partkey % 2 = 0 AS signal, p_partkey % 2 = 1 AS contrast FROM part")
def _(t):
    n = F.when(F.col("p_partkey") % 2 == 0, "Томск, автовокзал").otherwise("Томск, речной вокзал")
    return t.part.select("p_partkey", names.stop_type_signal(F.lit("hub"), n).alias("signal"), names.has_contrast_word(F.lit("Томский АВ"), n).alias("contrast"))


@query("h16_parse_cell_time", "SELECT p_partkey, CASE WHEN p_partkey % 30 < 24 THEN (p_partkey % 30) * 60 + 5 END AS minutes, CASE WHEN p_partkey % 30 < 24 THEN '1,3' END AS days, p_partkey % 30 < 24 AS ok FROM part")
def _(t):
    c = clock.parse_cell_time(F.format_string("%d:05 (ср, Пн)", F.col("p_partkey") % 30))
    return t.part.select("p_partkey", c["minutes"].cast("long").alias("minutes"), clock.weekday_csv(c["days"]).alias("days"), c["ok"].alias("ok"))


@query("h17_parse_block_days", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'all' WHEN 1 THEN 'none' WHEN 2 THEN 'parity' WHEN 3 THEN 'days' WHEN 4 THEN 'error' ELSE 'all' END AS kind, CASE WHEN p_partkey % 6 = 3 THEN '0,1,5' END AS days FROM part")
def _(t):
    text = F.element_at(F.array(F.lit(""), F.lit("Нет отправлений"), F.lit("через день"), F.lit("пт; пн, вс"), F.lit("пн; завтра"), F.lit("ежедневно")), (F.col("p_partkey") % 6 + 1).cast("int"))
    b = clock.parse_block_days(text)
    return t.part.select("p_partkey", b["kind"].alias("kind"), clock.weekday_csv(b["days"]).alias("days"))


@query("h18_parse_days_range", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '0,1,5,6' WHEN 1 THEN '2,4' ELSE '0,1,2,3,4,5,6' END AS days, '2024-05-01' AS s, '2024-09-30' AS e FROM part")
def _(t):
    text = F.element_at(F.array(F.lit("пт-пн"), F.lit("вт, четверг"), F.lit("иногда")), (F.col("p_partkey") % 3 + 1).cast("int"))
    p = clock.parse_period(F.lit("с 01.05 по 30.09"), F.lit("2024-03-03"))
    return t.part.select("p_partkey", clock.weekday_csv(clock.parse_days_range(text)).alias("days"), p["start"].alias("s"), p["end"].alias("e"))


@query("h19_feed_times", "SELECT p_partkey, CAST(p_partkey % 30 * 3600 + 125 AS BIGINT) AS s, printf('%02d:02:05', p_partkey % 30) AS hms, DATE '2024-02-29' AS d FROM part")
def _(t):
    text = F.format_string("%d:2:05", F.col("p_partkey") % 30)
    return t.part.select("p_partkey", clock.feed_seconds(text).cast("long").alias("s"), clock.normalize_time(text).alias("hms"), clock.feed_date(F.lit("20240229")).alias("d"))


@query("h20_modes", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'tram' WHEN 1 THEN 'rail' WHEN 2 THEN 'rail' WHEN 4 THEN 'flight' ELSE 'bus' END AS mode, CASE p_partkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 4 THEN 1100 ELSE 3 END AS kind, CASE p_partkey % 6 WHEN 1 THEN 250.0 WHEN 2 THEN 250.0 WHEN 4 THEN 1000.0 ELSE 120.0 END AS cap FROM part")
def _(t):
    m = clock.feed_mode((F.col("p_partkey") % 6).cast("string"))
    return t.part.select("p_partkey", m.alias("mode"), clock.route_type(m).alias("kind"), clock.max_speed(m).alias("cap"))


@query("h21_weekday_flags", "SELECT trip_id, CASE WHEN service_days = '1,2,3,4,5' THEN 1 ELSE 0 END AS monday, CASE WHEN service_days IN ('0,6', '0,3') THEN 1 ELSE 0 END AS sunday FROM v_trips")
def _(t):
    days = F.transform(F.filter(F.split("service_days", ","), lambda x: x != ""), lambda x: x.cast("int"))
    flags = clock.weekday_flags(days)
    return t.v_trips.select("trip_id", flags[0], flags[6])


@query("h22_route_keys", "SELECT route_id, 'synthetic:' || substr(code, 1, 2) || ':' || substr(code, 4) || ':A-B:x:77' AS key, 'forward:3:1' AS part, CASE WHEN route_id % 2 = 0 THEN 0 END AS direction FROM v_routes")
def _(t):
    return t.v_routes.select("route_id", keys.route_key_of_code(F.col("code"), F.lit("A / B"), F.lit("--"), F.lit("77")).alias("key"), keys.split_trip_key(F.concat(F.col("code"), F.lit("|forward:3:1"))).alias("part"), keys.direction_id(F.when(F.col("route_id") % 2 == 0, " Forward")).alias("direction"))


@query("h23_surrogate_id", "SELECT min(review_id) AS first, count(*) AS n, TRUE AS negative FROM v_reviews GROUP BY reason, fingerprint")
def _(t):
    rows = t.v_reviews.select("review_id", keys.surrogate_id(F.lit("terminal"), F.col("reason"), F.lit("osm"), F.col("fingerprint")).alias("id"))
    return rows.groupBy("id").agg(F.min("review_id").alias("first"), F.count("*").alias("n"), F.bool_and(F.col("id") < 0).alias("negative")).drop("id")


@query("h05_settlement_keys", "SELECT DISTINCT n_name, key FROM (SELECT n_name, unnest([c, CASE WHEN length(c) > 4 THEN c[:-2] END, CASE WHEN length(c) > 5 THEN c[:-3] END]) AS key FROM (SELECT n_name, lower(replace(n_name, '_', '')) AS c FROM nation)) WHERE key IS NOT NULL")
def _(t):
    return t.nation.select("n_name", F.explode(names.settlement_keys(F.col("n_name"))).alias("key"))


@query("h07_normalized_similarity", f"SELECT stop_id, round(greatest(0e0, {sim_sql('x', 'y')}), 6) AS similarity, round(1e0 - ({sim_sql('x', 'y')}), 6) AS distance FROM (SELECT stop_id, lower(replace(name, '#', '')) AS x, lower(replace(settlement, '_', '')) AS y FROM v_stops)")
def _(t):
    return t.v_stops.select("stop_id", r6(names.normalized_similarity(F.col("name"), F.col("settlement"))).alias("similarity"), r6(names.lev_ratio(F.col("name"), F.col("settlement"))).alias("distance"))


@query("h24_plan_id", "SELECT route_id, sha256('v1' || chr(0) || 'cfg' || chr(0) || 'a' || chr(0) || '~' || name) AS plan, TRUE AS fresh FROM v_routes")
def _(t):
    p = keys.plan_id(F.lit("v1"), F.lit("cfg"), F.array(F.col("name"), F.lit("a")))
    return t.v_routes.select("route_id", keys.plan_id(F.lit("v1"), F.lit("cfg"), F.array(F.concat(F.lit("~"), "name"), F.lit("a"))).alias("plan"), keys.is_fresh(p, p).alias("fresh"))


@query("h25_price_estimate", "SELECT p_partkey, CAST(floor(greatest(50.0, greatest(1.0, p_partkey / 7.0) * CASE WHEN p_partkey % 2 = 0 THEN 3.5 ELSE 2.5 END) + 0.5) AS DOUBLE) AS price, CASE WHEN p_partkey % 3 = 0 THEN 'USD' ELSE 'RUB' END AS currency FROM part")
def _(t):
    k = F.col("p_partkey")
    return t.part.select("p_partkey", keys.price_estimate(k / 7.0, F.when(k % 2 == 0, "rail").otherwise("coach")).alias("price"), keys.currency_or_default(F.when(k % 3 == 0, " usd").when(k % 3 == 1, "XXX")).alias("currency"))


@query("h26_levels", "SELECT p_partkey, CASE p_partkey % 11 WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 2 WHEN 6 THEN 3 WHEN 8 THEN 4 WHEN 9 THEN 5 WHEN 10 THEN 5 END AS level, CASE WHEN p_partkey % 2 = 0 THEN 'R, ' ELSE '' END || p_name AS query FROM part")
def _(t):
    k = F.col("p_partkey")
    return t.part.select("p_partkey", keys.admin_level((k % 11).cast("int")).alias("level"), keys.geocode_query(F.when(k % 2 == 0, "R"), F.col("p_name")).alias("query"))


@query("h27_transport", "SELECT terminal_id, CASE WHEN transport = 'rail' THEN 'bus+rail' ELSE 'bus' END AS modes, TRUE AS shared, TRUE AS context FROM v_terminals")
def _(t):
    x = F.concat_ws("+", F.col("transport"), F.lit("bus"), F.lit(""), F.col("transport"))
    return t.v_terminals.select("terminal_id", names.normalize_transport(x).alias("modes"), names.transport_overlap(x, F.lit("tram+bus")).alias("shared"), names.name_adds_context(F.concat("settlement", F.lit(", "), "name"), F.col("name")).alias("context"))


@query("h28_query_words", "SELECT p_partkey, lower(p_name) AS q, TRUE AS inside, FALSE AS broken, TRUE AS words FROM part")
def _(t):
    n = F.col("p_name")
    q = names.normalize_query(F.concat(F.lit("  "), F.replace(n, F.lit(" "), F.lit("   "))))
    return t.part.select("p_partkey", q.alias("q"), names.word_bound_contains(F.concat(F.lit("at "), n, F.lit(".")), n).alias("inside"), names.word_bound_contains(F.concat(F.lit("x"), n), n).alias("broken"), names.token_name_match(n, F.concat(n, F.lit(" stop"))).alias("words"))


# ---- registry, attach and canon jobs on tables derived from the driver's

BLOCK = "struct<days:string,dep:array<string>,dwell:array<string>,arr:array<string>,period:string>"


def registry(t: Tables) -> dict[str, DataFrame]:
    """Registry tables of the trips: two runs a schedule, winter times, one direction each."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    at = lambda c, hours: F.concat(two((F.floor(F.col(c) / 3600) + hours) % 24), F.lit(":"), two(F.floor(F.col(c) / 60) % 60))
    hm, later = lambda c: at(c, 0), lambda c: at(c, 1)
    rows = t.v_stop_times.join(t.v_trips.select("trip_id", "direction", "service_id").dropDuplicates(["trip_id"]), "trip_id")
    block = F.struct(F.when(F.col("trip_id") % 4 == 1, "пн, вт, ср, чт, пт").otherwise("ежедневно").alias("days"), F.array(hm("departure_s"), later("departure_s")).alias("dep"), F.array().cast("array<string>").alias("dwell"), F.array(hm("arrival_s"), later("arrival_s")).alias("arr"), F.lit("").alias("period"))
    stop = F.struct(F.col("stop_id").cast("string").alias("stop"), two(F.col("stop_id") % 30).alias("region"), block.alias("winter"), F.lit(None).cast(BLOCK).alias("summer"))
    code = F.concat(two(F.col("trip_id") % 30), F.lit("."), F.col("trip_id").cast("string"))
    schedules = rows.select(code.alias("route"), "direction", (F.col("service_id").cast("long") + 1).alias("service_id"), "seq", stop.alias("s")).groupBy("route", "direction", "service_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "s"))), lambda x: x["s"]).alias("stops"))
    routes = schedules.select(F.col("route").alias("reg"), F.concat(F.lit("route "), "route").alias("name"), F.lit(None).cast("double").alias("order"), F.lit("firm").alias("carrier"), F.lit("77").alias("carrier_inn"))
    stops = t.v_stops.select(F.col("stop_id").cast("string").alias("id"), "name", F.format_string("%02d", F.col("stop_id") % 30).alias("region"), F.lit("").alias("op_reg"), "lat", "lon")
    services = t.v_trips.select((F.col("service_id").cast("long") + 1).alias("id")).distinct().select("id", F.lit("s").alias("name"), F.lit("1992-01-01").alias("start_date"), F.lit("1999-12-31").alias("end_date"))
    days = services.select(F.col("id").alias("service_id"), (F.col("id") % 7).cast("int").alias("weekday"))
    none = services.where("id < 0").select(F.col("id").alias("service_id"), F.lit("1995-01-01").alias("date"), F.lit("added").alias("exception_type"))
    meta = t.region.agg(F.lit("registry").alias("source"), F.lit("1995-01-01").alias("snapshot"))
    return {"meta": meta, "routes": routes, "stops": stops, "services": services, "service_days": days, "service_exceptions": none, "schedules": schedules, "carriers": routes.select(F.col("carrier").alias("name"), F.col("carrier_inn").alias("inn")).distinct()}


@query("e03_flatten_trips", "SELECT count(*) AS stops, sum(CASE WHEN n THEN 1 ELSE 0 END) AS runs FROM (SELECT row_number() OVER (PARTITION BY trip_id, k) = 1 AS n FROM v_stop_times, (SELECT unnest([1, 2]) AS k)) t")
def _(t):
    out = timetables.flatten_trips(registry(t)["schedules"])
    return out["stops"].agg(F.count("*").alias("stops"), F.count_distinct("trip_key").alias("runs"))


@query("e04_flatten_trips_daily", "SELECT lpad(CAST(trip_id % 30 AS VARCHAR), 2, '0') || '.' || trip_id AS route, direction, CAST(run AS INT) AS run, n AS timed FROM (SELECT trip_id, count(*) AS n FROM v_stop_times GROUP BY trip_id HAVING count(*) >= 2) JOIN v_trips USING (trip_id), (SELECT unnest([0, 1]) AS run) WHERE service_id = 2")
def _(t):
    return timetables.flatten_trips_daily(registry(t), F.to_date(F.lit("1995-03-15")))["trips"].select("route", "direction", "run", "timed")


@query("i01_validate_contract", "SELECT 'stop' AS entity, CAST(stop_id AS VARCHAR) AS key, 'point out of range' AS rule FROM v_stops WHERE stop_id % 10 = 0")
def _(t):
    reg = registry(t)
    reg["stops"] = reg["stops"].withColumn("lat", F.when(F.col("id").cast("int") % 10 == 0, 100.0).otherwise(F.col("lat")))
    return timetables.validate_contract(reg)


@query("i02_validate_network", f"""WITH {LEGS}, g AS (SELECT c.trip_id, {hav('x.lat', 'x.lon', 'y.lat', 'y.lon')} AS km, (c.arrival_s - c.departure_s) / 3600.0 AS h FROM conn c JOIN v_stops x ON x.stop_id = c.from_stop JOIN v_stops y ON y.stop_id = c.to_stop),
found AS (SELECT 'stop' AS entity, 'info' AS severity, 'stop_times' AS field, 'no stop times' AS message, stop_id AS id FROM v_stops WHERE stop_id NOT IN (SELECT stop_id FROM v_stop_times)
UNION SELECT 'stop', 'error', 'id', 'repeated id', stop_id FROM v_stops GROUP BY stop_id HAVING count(*) > 1
UNION SELECT 'stop_time', 'error', 'stop', 'unknown stop', stop_id FROM v_stop_times WHERE stop_id NOT IN (SELECT stop_id FROM v_stops)
UNION SELECT 'stop_time', 'error', 'time', 'departure before arrival', trip_id FROM v_stop_times WHERE departure_s < arrival_s
UNION SELECT 'trip', 'error', 'stop_times', 'empty trip', trip_id FROM v_trips WHERE trip_id NOT IN (SELECT trip_id FROM v_stop_times)
UNION SELECT 'connection', 'error', 'time', 'arrival before departure', trip_id FROM g WHERE h < 0
UNION SELECT 'connection', 'warn', 'distance', 'very long leg', trip_id FROM g WHERE km > 800
UNION SELECT 'connection', 'warn', 'speed', 'too fast for its mode', trip_id FROM g WHERE km > 10 AND h > 0 AND km / h > 180)
SELECT entity, severity, field, message, count(*) AS n FROM found GROUP BY ALL""")
def _(t):
    net = {"stops": t.v_stops, "trips": t.v_trips, "stop_times": t.v_stop_times, "transfers": t.v_stops.limit(0).select(F.col("stop_id").alias("from_stop"), F.col("stop_id").alias("to_stop")), "connections": bus_legs(t)}
    return timetables.validate_network(net).groupBy("entity", "severity", "field", "message").agg(F.count("*").alias("n"))


def attached(t: Tables) -> dict[str, DataFrame]:
    trips, stops = timetables.registry_trips(registry(t))
    terms = t.v_stops.select(F.col("stop_id").alias("terminal_id"), "name", (F.col("lat") + 0.0005).alias("lat"), "lon", "settlement", F.lit("bus").alias("transport"), F.lit("osm").alias("source"), no_codes().alias("codes"), F.lit(True).alias("final"))
    previous = trips.select(F.col("trip_nk").alias("trip_id"))
    return timetables.attach_trips(trips, stops, terms, previous, linkage.LinkConfig(), cap_kmh=5000.0, churn_threshold=2.0)


@query("i03_attach_trips")
def _(t):
    return attached(t)["outcomes"].groupBy("state", "outcome").agg(F.count("*").alias("n"))


@query("i04_run_trips_sync")
def _(t):
    terms = t.v_stops.select(F.col("stop_id").alias("terminal_id"), "name", "lat", "lon", "settlement", F.lit("bus").alias("transport"), F.lit("osm").alias("source"), no_codes().alias("codes"), F.lit(True).alias("final"))
    reg = registry(t)
    out = timetables.run_trips_sync(reg, terms, t.v_trips.limit(0).select(F.col("trip_id").cast("string").alias("trip_id")), cfg=linkage.LinkConfig(), cap_kmh=5000.0)
    return out["by_route"]


@query("i05_persist_attach")
def _(t):
    now = F.to_timestamp(F.lit("2030-01-01"))
    out = attached(t)
    none = out["outcomes"].limit(0)
    canon_now = {
        "trips": none.select(F.col("trip_nk").alias("trip_id"), "route_id", F.lit(None).cast("timestamp").alias("valid_to")),
        "stop_times": none.select(F.col("trip_nk").alias("trip_id"), F.lit(0).alias("seq"), F.lit(0).cast("long").alias("terminal_id"), F.lit(0).alias("arrival_s"), F.lit(0).alias("departure_s")),
        "staging": none.select(F.col("trip_nk").alias("trip_id"), "route_id", "state", now.alias("observed_at")),
        "reviews": none.select(F.lit("trip").alias("entity_type"), F.xxhash64("trip_nk").alias("entity_id"), F.col("state").alias("reason"), F.lit(0.0).alias("score"), F.col("trip_nk").alias("fingerprint"), F.lit(0).cast("long").alias("seen"), now.alias("observed_at"), F.lit("open").alias("state")),
    }
    return canon.persist_attach(out, canon_now, now)["trips"].select("trip_id", "route_id")


@query("i06_promote_skeleton", f"WITH {GREEDY} SELECT left_id, n.name, CASE WHEN result = 'enriched' THEN round(score, 6) ELSE 0.4 END AS confidence FROM names n JOIN greedy USING (left_id) WHERE result <> 'ambiguous'")
def _(t):
    l, r = left_side(t), right_side(t)
    return canon.promote_skeleton(linkage.blocked_fuzzy_join(l, r), l, r)["terminals"].select("left_id", "name", r6("confidence").alias("confidence"))


@query("i07_tombstone_routes", "SELECT trip_id, route_id % 2 = 0 OR valid_to IS NOT NULL AS closed FROM v_trips")
def _(t):
    _, trips = canon.tombstone_routes(t.v_routes, t.v_trips, t.v_trips.where("route_id % 2 = 0"), F.to_date(F.lit("2030-01-01")))
    return trips.select("trip_id", F.col("valid_to").isNotNull().alias("closed"))


@query("i08_expire_staging", "SELECT trip_id, CASE WHEN state <> 'done' AND observed_at < DATE '1998-01-01' - INTERVAL 365 DAY THEN 'expired' ELSE state END AS state FROM v_outcomes")
def _(t):
    return canon.expire_staging(t.v_outcomes, 365, F.to_date(F.lit("1998-01-01"))).select("trip_id", "state")


@query("i09_resolve_reviews", "SELECT review_id, CASE WHEN CAST(fingerprint AS INT) % 2 = 0 THEN 'resolved' ELSE 'open' END AS state FROM v_reviews")
def _(t):
    r = t.v_reviews.withColumn("entity_type", F.lit("trip")).withColumn("state", F.lit("open"))
    return canon.resolve_reviews(r, r.where("CAST(fingerprint AS INT) % 2 = 0")).select("review_id", "state")


@query("i10_upsert_reviews", "SELECT terminal_id AS entity_id, reason, count(*) + 1 AS seen, arg_max(score, (observed_at, score)) AS score FROM v_reviews GROUP BY terminal_id, reason")
def _(t):
    new = t.v_reviews.select(F.lit("terminal").alias("entity_type"), F.col("terminal_id").alias("entity_id"), "reason", "score", "fingerprint", "observed_at")
    old = new.groupBy("entity_type", "entity_id", "reason").agg(F.lit(0.5).alias("score"), F.lit("f").alias("fingerprint"), F.lit(1).cast("long").alias("seen"), F.min("observed_at").alias("observed_at"), F.lit("open").alias("state"))
    return canon.upsert_reviews(old, new).select("entity_id", "reason", "seen", "score")


@query("i11_apply_overrides", f"SELECT entity_id, field, CASE WHEN entity_id % 5 = 0 THEN 'by hand' ELSE value END AS value, entity_id % 5 = 0 AS manual FROM ({ELECT})")
def _(t):
    now = sequences.elect_field(t.v_candidates)
    hand = now.where("entity_id % 5 = 0").select("entity_id", "field", F.lit("by hand").alias("value"), F.lit(1).alias("actor_id"))
    bad = now.where("entity_id % 5 = 1").select("entity_id", "field", F.lit("").alias("value"), F.lit(1).alias("actor_id"))
    return canon.apply_overrides(now.select("entity_id", "field", "value"), hand.unionByName(bad))[0]


@query("i12_approve_terminals", "SELECT terminal_id, CASE WHEN terminal_id % 3 = 0 THEN 'ok' WHEN NOT locked AND terminal_id % 2 = 0 THEN 'upd' ELSE name END AS name, locked OR terminal_id % 3 = 0 AS locked FROM v_terminals")
def _(t):
    rows = t.v_terminals.withColumn("verified_at", F.lit(None).cast("timestamp"))
    ok = rows.where("terminal_id % 3 = 0").select("terminal_id", F.lit("ok").alias("name"), "lat", "lon")
    upd = rows.where("terminal_id % 2 = 0").select("terminal_id", F.lit("upd").alias("name"), "lat", "lon")
    return canon.approve_terminals(rows, ok, upd, F.to_timestamp(F.lit("2030-01-01")))[0].select("terminal_id", "name", "locked")


@query("i13_clear_provider", "SELECT trip_id, seq FROM v_stop_times WHERE trip_id NOT IN (SELECT trip_id FROM v_trips WHERE route_id IN (SELECT route_id FROM v_routes WHERE provider = 'north'))")
def _(t):
    services = t.v_trips.select("service_id", F.lit("north").alias("provider"))
    return canon.clear_provider({"routes": t.v_routes, "trips": t.v_trips, "stop_times": t.v_stop_times, "services": services}, "north")["stop_times"].select("trip_id", "seq")


@query("i14_ensure_stops", "SELECT terminal_id, CASE WHEN terminal_id < 1000000 AND terminal_id % 2 = 0 THEN terminal_id ELSE -1 END AS stop_id, lat, terminal_id % 2 = 1 AS created FROM v_terminals")
def _(t):
    have = t.v_terminals.where("terminal_id % 2 = 0").select("terminal_id", F.explode(F.array(F.col("terminal_id"), F.col("terminal_id") + 7)).alias("stop_id"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))
    out = canon.ensure_stops(t.v_terminals, have)
    return out.select("terminal_id", F.when(F.col("created"), -1).otherwise(F.col("stop_id")).alias("stop_id"), "lat", "created")


@query("i15_skip_fresh_chunks", "SELECT region AS chunk_key, count(*) AS n FROM v_terminals WHERE region <> 'ASIA' GROUP BY region")
def _(t):
    chunks = t.v_terminals.select(F.col("region").alias("chunk_key"), F.lit("p1").alias("plan_id"), "terminal_id")
    done = chunks.select("chunk_key", F.when(F.col("chunk_key") == "ASIA", "p1").otherwise("p0").alias("plan_id")).distinct()
    return canon.skip_fresh_chunks(chunks, done).groupBy("chunk_key").agg(F.count("*").alias("n"))


@query("i16_record_provenance", "SELECT entity_id, source, max(observed_at) AS observed_at FROM v_candidates GROUP BY entity_id, source")
def _(t):
    v = t.v_candidates.select(F.lit("terminal").alias("entity_type"), "entity_id", "source", "confidence", "observed_at")
    return canon.record_provenance(v.where("confidence < 0.5"), v.where("confidence >= 0.5"))[0].select("entity_id", "source", F.col("observed_at").cast("timestamp_ntz").alias("observed_at"))


@query("i17_orphan_check", "SELECT DISTINCT entity_id, 'terminal' AS entity_type FROM v_candidates WHERE entity_id NOT IN (SELECT stop_id FROM v_stops)")
def _(t):
    p = t.v_candidates.select(F.lit("terminal").alias("entity_type"), "entity_id").distinct()
    return canon.orphan_check(p, {"terminal": t.v_stops.select(F.col("stop_id").alias("entity_id"))})


@query("i18_audit_sample", "SELECT source AS method, least(count(*), 20) AS n FROM v_candidates WHERE confidence >= 0.6 GROUP BY source")
def _(t):
    m = t.v_candidates.select(F.col("event_id").alias("match_id"), F.col("source").alias("method"), F.when(F.col("confidence") >= 0.6, "verified").otherwise("rejected").alias("decision"))
    return canon.audit_sample(m, 20).groupBy("method").agg(F.count("*").alias("n"))


@query("i19_golden_check", "SELECT terminal_id AS id, 'verified' AS expect, 'verified' AS decision, 1 AS expect_best, 1 AS best, TRUE AS ok FROM v_terminals")
def _(t):
    side = "struct<name:string,lat:double,lon:double,source:string,settlement:string,transport:string,codes:" + linkage.NO_CODES + ">"
    pair = F.struct("name", "lat", "lon", F.lit("mintrans").alias("source"), F.lit("").alias("settlement"), F.lit("").alias("transport"), no_codes().alias("codes")).cast(side)
    far = F.struct(F.lit("elsewhere").alias("name"), (F.col("lat") + 3).alias("lat"), "lon", F.lit("osm").alias("source"), F.lit("").alias("settlement"), F.lit("").alias("transport"), no_codes().alias("codes")).cast(side)
    near = F.struct("name", "lat", "lon", F.lit("osm").alias("source"), F.lit("").alias("settlement"), F.lit("").alias("transport"), no_codes().alias("codes")).cast(side)
    cases = t.v_terminals.select(F.col("terminal_id").alias("id"), F.lit("urban").alias("class"), pair.alias("stop"), F.array(far, near).alias("terminals"), F.lit("verified").alias("expect"), F.lit(1).alias("expect_best"))
    return timetables.golden_check(cases)


@query("i20_log_stages", "SELECT event_id AS record_id, unnest(['normalize', 'enrich', 'dedup', 'verify', 'canonical']) AS stage FROM events")
def _(t):
    return canon.log_stages(t.events.select(F.col("event_id").alias("record_id"), F.lit(1.0).alias("confidence"), F.lit(0.0).alias("distance_m"), F.lit("osm").alias("source"))).select("record_id", "stage")


@query("i21_apply_review_decisions", "SELECT review_id FROM v_reviews WHERE review_id % 4 > 1")
def _(t):
    d = t.v_reviews.select("review_id", F.when(F.col("review_id") % 4 == 0, "approve").when(F.col("review_id") % 4 == 1, "dismiss").otherwise("later").alias("decision"), F.lit(1).alias("actor_id"))
    return canon.apply_review_decisions(t.v_reviews, d, t.v_terminals, F.to_timestamp(F.lit("2030-01-01")))["reviews"].select("review_id")


@query("i22_apply_terminal_edits", "SELECT terminal_id, CASE WHEN terminal_id % 3 = 0 THEN 'edited' ELSE name END AS name, locked OR terminal_id % 3 = 0 AS locked FROM v_terminals")
def _(t):
    e = t.v_terminals.where("terminal_id % 3 <> 2").select(F.col("terminal_id").alias("edit_id"), "terminal_id", F.when(F.col("terminal_id") % 3 == 0, "edited").otherwise(" ").alias("name"), "lat", "lon", "settlement", (F.col("terminal_id") % 2 == 0).alias("approved"))
    return canon.apply_terminal_edits(t.v_terminals, e, t.v_reviews, F.to_timestamp(F.lit("2030-01-01")))["terminals"].select("terminal_id", "name", "locked")


@query("i23_dedupe_carriers", "SELECT CAST(n_nationkey AS VARCHAR) AS carrier_key, n_name AS name FROM nation UNION ALL SELECT DISTINCT 'name:' || p_brand, p_brand FROM part")
def _(t):
    firms = t.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("inn"))
    routes = t.customer.select(F.lit("other").alias("carrier"), F.col("c_nationkey").cast("string").alias("carrier_inn")).union(t.part.select("p_brand", F.lit("")))
    return canon.dedupe_carriers(firms, routes).select("carrier_key", "name")


# ---- network and journeys


def canon_tables(t: Tables) -> dict[str, DataFrame]:
    stops = t.v_stops.select("stop_id", F.col("stop_id").alias("terminal_id"), F.when(F.col("stop_id") % 2 == 0, F.col("name")).otherwise("").alias("name"), F.when(F.col("stop_id") % 3 != 0, F.col("lat")).alias("lat"), F.when(F.col("stop_id") % 3 != 0, F.col("lon")).alias("lon"), F.lit("north").alias("provider"))
    return {"terminals": t.v_stops.withColumnRenamed("stop_id", "terminal_id"), "stops": stops, "routes": t.v_routes, "trips": t.v_trips, "stop_times": t.v_stop_times}


@query("c27_load_network", f"WITH {LEGS} SELECT c.trip_id, c.seq, r.mode FROM conn c JOIN v_trips t ON t.trip_id = c.trip_id JOIN v_routes r ON r.route_id = t.route_id WHERE t.valid_to IS NULL AND r.valid_to IS NULL AND (t.service_days = '' OR list_contains(string_split(t.service_days, ','), '3'))")
def _(t):
    return network.load_network(canon_tables(t), F.to_date(F.lit("1995-03-15")))["connections"].select("trip_id", "seq", "mode")


@query("c26_merge_networks", "SELECT CAST(stop_id AS VARCHAR) AS stop_id FROM v_stops UNION ALL SELECT CASE WHEN stop_id % 2 = 0 THEN 'b:' || stop_id ELSE 'x' || stop_id END FROM v_stops")
def _(t):
    a = {"stops": t.v_stops.select(F.col("stop_id").cast("string").alias("stop_id"), "name")}
    b = {"stops": t.v_stops.select(F.when(F.col("stop_id") % 2 == 0, F.col("stop_id").cast("string")).otherwise(F.concat(F.lit("x"), "stop_id")).alias("stop_id"), "name")}
    return network.merge_networks([("a", a), ("b", b)])["stops"].select("stop_id")


def parts_of(t: Tables) -> DataFrame:
    return journeys.trip_parts(t.v_stop_times, t.v_stops, t.v_trips.select("trip_id", F.lit("flight").alias("mode")).dropDuplicates(["trip_id"]))


def walks_of(t: Tables) -> journeys.Walks:
    return journeys.Walks.within(t.v_stops, 2.0)


def nation_requests(t: Tables) -> DataFrame:
    """A request from the first stop of each nation at eight; its labels are those of all stops."""
    first = t.v_stops.groupBy("settlement").agg(F.min("stop_id").alias("stop_id"))
    return first.select(F.col("stop_id").alias("request_id"), "stop_id", F.lit(28800).alias("departure_s"))


def walks_sql(km: float, doublings: int) -> str:
    """Walks over chains of links within ``km``, doubled as often as given; CTEs w0, w1, ..."""
    near = f"SELECT a.stop_id AS f, b.stop_id AS t, CAST(ceil({hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} / 5 * 60) AS INT) AS m FROM v_stops a JOIN v_stops b ON a.stop_id <> b.stop_id WHERE {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= {km}"
    steps = [f"w0 AS ({near})"]
    for i in range(doublings):
        steps.append(f"w{i + 1} AS (SELECT f, t, min(m) AS m FROM (SELECT * FROM w{i} UNION ALL SELECT x.f, y.t, x.m + y.m FROM w{i} x JOIN w{i} y ON x.t = y.f WHERE x.f <> y.t) GROUP BY f, t)")
    return ", ".join(steps)


def arrivals_sql(rounds: int, doublings: int = 3) -> str:
    """Earliest arrivals t_s after so many rides, each followed by a walk; CTEs a0, a1, ..."""
    walk = lambda x: f"SELECT r, s, min(t_s) AS t_s FROM (SELECT * FROM ({x}) UNION ALL SELECT z.r, w.t, z.t_s + w.m * 60 FROM ({x}) z JOIN w{doublings} w ON w.f = z.s) GROUP BY r, s"
    steps = [walks_sql(2.0, doublings), "q AS (SELECT min(stop_id) AS s FROM v_stops GROUP BY settlement)", f"a0 AS MATERIALIZED ({walk('SELECT s AS r, s, 28800 AS t_s FROM q')})"]
    for i in range(rounds):
        ride = f"SELECT b.r, e.stop_id AS s, min(e.arrival_s) AS t_s FROM (SELECT a.r, p.trip_id, min(p.seq) AS seq FROM a{i} a JOIN st p ON p.stop_id = a.s AND p.departure_s >= a.t_s GROUP BY a.r, p.trip_id) b JOIN st e ON e.trip_id = b.trip_id AND e.seq > b.seq GROUP BY b.r, e.stop_id"
        steps.append(f"b{i} AS MATERIALIZED ({ride})")
        steps.append(f"a{i + 1} AS MATERIALIZED (SELECT r, s, min(t_s) AS t_s FROM (SELECT * FROM a{i} UNION ALL SELECT * FROM ({walk(f'SELECT * FROM b{i}')})) GROUP BY r, s)")
    return "WITH st AS MATERIALIZED (SELECT trip_id, seq, stop_id, arrival_s, departure_s FROM v_stop_times), " + ", ".join(steps)


@query("p01_trip_parts", "SELECT trip_id, count(DISTINCT part) AS parts FROM (SELECT trip_id, sum(cut) OVER (PARTITION BY trip_id ORDER BY seq) AS part FROM (SELECT s.trip_id, s.seq, CASE WHEN s.arrival_s < lag(s.departure_s) OVER (PARTITION BY s.trip_id ORDER BY s.seq) THEN 1 ELSE 0 END AS cut FROM v_stop_times s)) GROUP BY trip_id")
def _(t):
    return parts_of(t).groupBy("trip_id").agg(F.count_distinct("part").alias("parts"))


@query("p02_earliest_arrival", f"{arrivals_sql(8)} SELECT r AS request_id, s AS stop_id, t_s AS arrival_s FROM a8")
def _(t):
    return journeys.earliest_arrival(nation_requests(t), parts_of(t), walks_of(t)).select("request_id", "stop_id", "arrival_s")


@query("p03_walk_relax", f"WITH {walks_sql(30.0, 7)} SELECT stop_id AS request_id, stop_id, 28800 AS arrival_s FROM v_stops UNION ALL SELECT f, t, 28800 + m * 60 FROM w7")
def _(t):
    seed = t.v_stops.select(F.col("stop_id").alias("request_id"), "stop_id", F.lit(28800).alias("departure_s"))
    return journeys.walk_relax(journeys.seeds(seed), journeys.Walks.within(t.v_stops, 30.0)).select("request_id", "stop_id", "arrival_s")


def nation_journeys(t: Tables) -> DataFrame:
    found = journeys.search(nation_requests(t), parts_of(t), walks_of(t))
    return found.paths(found.best())


@query("p04_journey_legs")
def _(t):
    return journeys.journey_legs(nation_journeys(t))


@query("p04_journey_ends", f"{arrivals_sql(8)} SELECT r AS request_id, s AS stop_id, r AS from_stop, s AS to_stop, 28800 <= t_s AS in_order, 0 AS breaks, t_s AS arrival_s FROM a8 WHERE r <> s")
def _(t):
    legs = journeys.journey_legs(nation_journeys(t))
    w = Window.partitionBy("request_id", "stop_id").orderBy("leg_no")
    broken = (F.lag("to_stop").over(w) != F.col("from_stop")) | (F.lag("arrival_s").over(w) > F.col("departure_s")) | (F.col("departure_s") > F.col("arrival_s"))
    rows = legs.withColumn("broken", F.coalesce(broken, F.lit(False)).cast("int"))
    at = "leg_no"
    return rows.groupBy("request_id", "stop_id").agg(F.min_by("from_stop", at).alias("from_stop"), F.max_by("to_stop", at).alias("to_stop"), (F.min("departure_s") >= 28800).alias("in_order"), F.sum("broken").cast("int").alias("breaks"), F.max_by("arrival_s", at).alias("arrival_s"))


DIRECT = """, l0 AS (SELECT s AS r, s, 28800 AS t_s, 0 AS legs FROM q UNION ALL SELECT q.s, w.t, 28800 + w.m * 60, 1 FROM q JOIN w3 w ON w.f = q.s),
boarded AS (SELECT l.r, p.trip_id, min(p.seq) AS seq, arg_min(l.legs, p.seq) AS legs FROM l0 l JOIN st p ON p.stop_id = l.s AND p.departure_s >= l.t_s GROUP BY l.r, p.trip_id),
rode AS (SELECT b.r, e.stop_id AS s, e.arrival_s AS t_s, b.legs + 1 AS legs FROM boarded b JOIN st e ON e.trip_id = b.trip_id AND e.seq > b.seq WHERE b.legs = 0),
few AS (SELECT * FROM l0 UNION ALL SELECT DISTINCT x.* FROM rode x LEFT JOIN l0 ON l0.r = x.r AND l0.s = x.s WHERE l0.t_s IS NULL OR x.t_s < l0.t_s)"""


@query("p05_limit_transfers", f"{arrivals_sql(8)}{DIRECT} SELECT few.r AS request_id, few.s AS stop_id, few.t_s AS arrival_s, few.legs FROM few JOIN a8 ON a8.r = few.r AND a8.s = few.s AND a8.t_s = few.t_s")
def _(t):
    labels = journeys.earliest_arrival(nation_requests(t), parts_of(t), walks_of(t))
    return journeys.limit_transfers(labels, 0).select("request_id", "stop_id", "arrival_s", "legs")


@query("p06_access_egress", f"SELECT point_id, stop_id, CAST(ceil(km / 5 * 60) AS INT) AS walk_minutes FROM ({NEAR}) WHERE km <= 10")
def _(t):
    return journeys.access_egress(t.v_terminals.withColumnRenamed("terminal_id", "point_id"), t.v_stops, 120.0)[0].select("point_id", "stop_id", "walk_minutes")


@query("p06_points_out_of_range", f"""WITH alone AS (SELECT terminal_id, lat, lon FROM v_terminals WHERE terminal_id NOT IN (SELECT point_id FROM ({NEAR}) WHERE km <= 2.5)),
every AS (SELECT a.terminal_id, s.stop_id, round({hav('a.lat', 'a.lon', 's.lat', 's.lon')}, 9) AS km FROM alone a, v_stops s)
SELECT terminal_id AS point_id, arg_min(stop_id, (km, stop_id)) AS nearest_stop, CAST(ceil(min(km) / 5 * 60) AS INT) AS needed_minutes FROM every GROUP BY terminal_id""")
def _(t):
    return journeys.access_egress(t.v_terminals.withColumnRenamed("terminal_id", "point_id"), t.v_stops, 30.0)[1].select("point_id", "nearest_stop", "needed_minutes")


@query("p07_gap_leg", f"SELECT terminal_id AS request_id, 28800 + CAST(ceil({hav('lat', 'lon', 'lat + 0.01', 'lon')} / 5 * 60) AS INT) * 60 AS arrival_s FROM v_terminals WHERE terminal_id % 2 = 0")
def _(t):
    req = t.v_terminals.select(F.col("terminal_id").alias("request_id"), F.col("lat").alias("from_lat"), F.col("lon").alias("from_lon"), (F.col("lat") + 0.01).alias("to_lat"), F.col("lon").alias("to_lon"), F.lit(28800).alias("departure_s"), F.lit(True).alias("allow_gap"))
    return journeys.gap_leg(req, t.v_terminals.where("terminal_id % 2 = 1").select(F.col("terminal_id").alias("request_id"))).select("request_id", "arrival_s")


@query("p08_arrive_by")
def _(t):
    req = t.v_stops.select(F.col("stop_id").alias("request_id"), "stop_id", F.pmod(F.col("stop_id") + 1, F.lit(10)).alias("goal_stop"), F.lit(36000).alias("limit_s"))
    return journeys.arrive_by(req, parts_of(t), walks_of(t)).select("request_id", "departure_s", "arrival_s")


@query("p09_alternatives")
def _(t):
    req = t.v_stops.select(F.col("stop_id").alias("request_id"), "stop_id", F.pmod(F.col("stop_id") + 1, F.lit(10)).alias("goal_stop"), F.lit(28800).alias("departure_s"))
    return journeys.alternatives(req, parts_of(t), walks_of(t)).select("request_id", "journey_id", "arrival_s", "transfers", "rank")


@query("p10_price_journeys", f"WITH {LEGS} SELECT c.trip_id, c.seq, CASE WHEN c.trip_id % 2 = 0 THEN 99.0 ELSE floor(greatest(50.0, greatest(1.0, {hav('x.lat', 'x.lon', 'y.lat', 'y.lon')}) * 2.5) + 0.5) END AS price FROM conn c JOIN v_stops x ON x.stop_id = c.from_stop JOIN v_stops y ON y.stop_id = c.to_stop")
def _(t):
    legs = bus_legs(t).withColumn("leg_id", F.concat_ws("-", "trip_id", "seq")).withColumn("route_id", F.col("trip_id") % 2)
    rules = t.region.where("r_regionkey = 0").select(F.lit(1).alias("rule_no"), F.lit("0").alias("route_id"), F.lit("").alias("from_zone"), F.lit("").alias("to_zone"), F.lit("a").alias("fare_id"))
    fares = rules.select("fare_id", F.lit(99.0).alias("price"), F.lit("RUB").alias("currency"))
    zones = t.v_stops.select("stop_id", F.lit("z").alias("zone_id"))
    return journeys.price_journeys(legs, t.v_stops, rules, zones, fares).select("trip_id", "seq", "price")


@query("p11_plan_requests")
def _(t):
    near = lambda c, d: (F.col(c) + d)
    other = t.v_stops.select((F.col("stop_id") - 1).alias("stop_id"), F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"))
    req = t.v_stops.join(other, "stop_id").select(F.col("stop_id").alias("request_id"), near("lat", 0.001).alias("from_lat"), F.col("lon").alias("from_lon"), F.lit(None).cast("string").alias("from_place"), "to_lat", "to_lon", F.lit(None).cast("string").alias("to_place"), F.lit(28800).alias("departure_s"), F.when(F.col("stop_id") % 20 == 0, 500).otherwise(60).alias("max_walk"), F.lit(5).alias("max_transfers"), F.lit(False).alias("allow_gap"))
    net = {"stops": t.v_stops, "stop_times": t.v_stop_times, "modes": t.v_trips.select("trip_id", F.lit("flight").alias("mode")).dropDuplicates(["trip_id"]), "transfers": spatial.transfer_links(t.v_stops, 2.0)}
    places = t.nation.select(F.col("n_nationkey").alias("place_id"), F.col("n_name").alias("name"), F.lit(55.0).alias("lat"), F.lit(83.0).alias("lon"))
    out = journeys.plan_requests(req, net, places)
    return out["journeys"].select("request_id", F.lit("planned").alias("outcome"), "arrival_s").unionByName(out["errors"].select("request_id", F.col("error").alias("outcome"), F.lit(None).cast("int").alias("arrival_s")), allowMissingColumns=True)


# ---- feeds: import of tables shaped as a feed, and export


def feed(t: Tables) -> dict[str, DataFrame]:
    hms = clock.feed_hms
    return {
        "stops": t.v_stops.select(F.col("stop_id").cast("string").alias("stop_id"), F.col("stop_id").cast("string").alias("stop_code"), F.col("name").alias("stop_name"), "lat", "lon"),
        "calendar": t.v_trips.select(F.col("service_id").cast("string").alias("service_id")).distinct().select("service_id", *[F.lit("1").alias(d) for d in ("monday", "tuesday", "wednesday", "thursday", "friday")], F.lit("0").alias("saturday"), F.lit("0").alias("sunday"), F.lit("19950101").alias("start_date"), F.lit("19951231").alias("end_date")),
        "calendar_dates": t.v_trips.select(F.col("service_id").cast("string").alias("service_id"), F.lit("19950501").alias("date"), F.lit("2").alias("exception_type")).distinct(),
        "routes": t.v_routes.select(F.col("route_id").cast("string").alias("route_id"), F.lit("a").alias("agency_id"), F.col("name").alias("route_short_name"), F.lit(None).cast("string").alias("route_long_name"), clock.route_type(F.col("mode")).cast("string").alias("route_type")),
        "trips": t.v_trips.select(F.col("route_id").cast("string").alias("route_id"), F.when(F.col("service_id") == 6, "weekend").otherwise(F.col("service_id").cast("string")).alias("service_id"), F.col("trip_id").cast("string").alias("trip_id"), F.when(F.col("direction") == "backward", "1").otherwise("0").alias("direction_id")),
        "frequencies": t.v_trips.where("trip_id % 10 = 0").select(F.col("trip_id").cast("string").alias("trip_id"), F.lit("06:00:00").alias("start_time"), F.lit("25:00:00").alias("end_time"), F.lit("600").alias("headway_secs")),
        "stop_times": t.v_stop_times.select(F.col("trip_id").cast("string").alias("trip_id"), hms(F.col("arrival_s")).alias("arrival_time"), hms(F.col("departure_s")).alias("departure_time"), F.col("stop_id").cast("string").alias("stop_id"), F.col("seq").cast("string").alias("stop_sequence")),
    }


@query("a02_import_feed", "SELECT CAST(s.trip_id AS VARCHAR) AS trip_id, s.seq, s.arrival_s, s.departure_s FROM v_stop_times s JOIN (SELECT DISTINCT trip_id FROM v_trips WHERE service_id <> 6) t ON t.trip_id = s.trip_id")
def _(t):
    return readers.import_feed(feed(t))["stop_times"].select("trip_id", "seq", "arrival_s", "departure_s")


@query("a02_import_feed_trips", "SELECT CAST(trip_id AS VARCHAR) AS trip_id, 10000000000 + service_id AS service_id, direction, '1,2,3,4,5' AS service_days FROM v_trips WHERE service_id <> 6")
def _(t):
    return readers.import_feed(feed(t))["trips"].select("trip_id", "service_id", "direction", "service_days")


@query("a08_explode_area_chain", "SELECT s_suppkey AS match_id, 0 AS pos, r_name AS name, NULL AS parent FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT s_suppkey, 1, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT s_suppkey, 2, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(t):
    m = t.v_stops.select(F.col("stop_id").alias("match_id"), "name", F.array(F.struct(F.col("region").alias("name"), F.lit(2).alias("admin_level")), F.struct(F.col("settlement").alias("name"), F.lit(8).alias("admin_level"))).alias("areas"))
    return readers.explode_area_chain(m).select("match_id", "pos", "name", "parent")


@query("a09_validate_match", "SELECT terminal_id, CASE WHEN terminal_id % 3 = 0 THEN 'no name' WHEN terminal_id % 3 = 1 THEN 'coordinates out of range' ELSE 'unknown type' END AS reason FROM v_terminals WHERE terminal_id % 3 <> 2 OR terminal_id % 2 = 0")
def _(t):
    m = t.v_terminals.select("terminal_id", F.when(F.col("terminal_id") % 3 == 0, " ").otherwise(F.col("name")).alias("name"), F.when(F.col("terminal_id") % 3 == 1, 99.0).otherwise(F.col("lat")).alias("lat"), "lon", F.when(F.col("terminal_id") % 2 == 0, "ROCK").otherwise("STOP").alias("type"))
    return readers.validate_match(m)[1].select("terminal_id", "reason")


@query("a13_write_feed", "SELECT CAST(trip_id AS VARCHAR) AS trip_id, printf('%02d:%02d:%02d', arrival_s // 3600, arrival_s % 3600 // 60, arrival_s % 60) AS arrival_time, CAST(seq AS INT) AS stop_sequence FROM v_stop_times")
def _(t):
    none = t.v_stops.limit(0)
    net = {"carriers": t.nation.select(F.col("n_nationkey").alias("carrier_id"), F.col("n_name").alias("name")), "zones": none.select("stop_id", F.lit("z").alias("zone_id")), "stops": t.v_stops, "routes": t.v_routes.withColumn("carrier_id", F.lit(1)), "trips": t.v_trips, "stop_times": t.v_stop_times, "services": t.v_trips.select("service_id", F.array(F.lit(1)).alias("weekdays"), F.col("service_date").alias("start_date"), F.col("service_date").alias("end_date")), "service_exceptions": t.v_trips.limit(0).select("service_id", F.col("service_date").alias("date"), F.lit("added").alias("exception_type")), "transfers": none.select(F.col("stop_id").alias("from_stop"), F.col("stop_id").alias("to_stop"), F.lit(1).alias("minutes")), "fares": none.select(F.lit("f").alias("fare_id"), F.lit(1.0).alias("price"), F.lit("RUB").alias("currency")), "fare_rules": none.select(F.lit("f").alias("fare_id"))}
    return writers.feed_tables(net)["stop_times"].select(F.col("trip_id").cast("string").alias("trip_id"), "arrival_time", F.col("stop_sequence").cast("int").alias("stop_sequence"))


@query("a14_region_feed", "SELECT trip_id FROM v_trips WHERE route_id IN (SELECT route_id FROM v_outcomes WHERE region = 'ASIA')")
def _(t):
    net = {"routes": t.v_trips.select("route_id").distinct(), "trips": t.v_trips, "stop_times": t.v_stop_times, "stops": t.v_stops, "transfers": t.v_stops.limit(0).select(F.col("stop_id").alias("from_stop"), F.col("stop_id").alias("to_stop"))}
    return writers.region_feed(net, t.v_outcomes.select("route_id", "region").distinct(), "ASIA", "1995-01-01")["trips"].select("trip_id")


@query("a21_build_gazetteer", "SELECT n_name AS name, min(lat) AS lat FROM v_terminals JOIN nation ON settlement = n_name GROUP BY n_name")
def _(t):
    rows = t.v_terminals.select(F.concat("settlement", F.lit(", автовокзал")).alias("name"), "lat", F.lit(1.0).alias("lon"), F.create_map(F.lit("a"), F.lit("b")).alias("tags"))
    curated = t.nation.select(F.col("n_name").alias("name"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon")).join(t.v_terminals.select(F.col("settlement").alias("name")), "name", "left_semi")
    return readers.build_gazetteer(rows, curated).select("name", "lat")


# ---- the batch twins of the streams


@query("s02_publish_events", """SELECT 'terminal' AS aggregate, CAST(event_id AS VARCHAR) AS aggregate_id, '{"event_type":"' || event_type || '"}' AS payload FROM events""")
def _(t):
    return streams.event_rows(t.events.select("event_id", "event_type"), "terminal", "event_id", "terminal_created").select("aggregate", "aggregate_id", "payload")


@query("s03_review_stream", "SELECT terminal_id AS entity_id, reason, count(*) AS seen, arg_max(score, (observed_at, score)) AS score FROM v_reviews GROUP BY terminal_id, reason")
def _(t):
    rows = t.v_reviews.select(F.lit("terminal").alias("entity_type"), F.col("terminal_id").alias("entity_id"), "reason", "score", "observed_at")
    return streams.review_stream(rows).select("entity_id", "reason", "seen", "score")


@query("s03_review_episodes", "SELECT terminal_id AS entity_id, reason, count(*) AS seen, max(observed_at) AS observed_at FROM (SELECT *, sum(opens) OVER (PARTITION BY terminal_id, reason ORDER BY observed_at) AS episode FROM (SELECT terminal_id, reason, observed_at, CASE WHEN observed_at - lag(observed_at) OVER (PARTITION BY terminal_id, reason ORDER BY observed_at) < INTERVAL 30 DAY THEN 0 ELSE 1 END AS opens FROM v_reviews)) GROUP BY terminal_id, reason, episode")
def _(t):
    rows = t.v_reviews.select(F.lit("terminal").alias("entity_type"), F.col("terminal_id").alias("entity_id"), "reason", "score", "observed_at")
    return streams.review_episodes(rows, 30 * 86400).select("entity_id", "reason", "seen", "observed_at")


@query("s05_quota_stream", "SELECT event_type AS provider, CAST(ts AS DATE) AS day, count(*) AS calls, count(*) > 10 AS over FROM events GROUP BY ALL")
def _(t):
    return streams.quota_stream(t.events.select(F.col("event_type").alias("provider"), "ts"), 10)


# ---- joins by name, and readers over rows shaped as their sources


@query("c03_score_pair_records", f"WITH {RECORDS} SELECT left_id, right_id, round(score, 6) AS score FROM scored WHERE akin")
def _(t):
    akin = lambda df: linkage.prepared(df).withColumn("akin", F.right("settlement", F.lit(1)))
    s = linkage.score_pair_records(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}"), ready=True)
    return linkage.tiles(akin(left_side(t)), akin(right_side(t)), ("akin",)).select("left_id", "right_id", r6(s["score"]).alias("score"))


@query("c04_decide_join", f"WITH {GREEDY} SELECT left_id, best AS right_id, result, round(score, 6) AS score FROM greedy WHERE best IS NOT NULL")
def _(t):
    return linkage.greedy_links(left_side(t), right_side(t)).select("left_id", "right_id", "result", r6("score").alias("score"))


@query("c17_resolve_stop_coords", "SELECT terminal_id AS stop_id, CASE WHEN terminal_id % 2 = 0 THEN lat END AS lat FROM v_terminals WHERE terminal_id % 2 = 1 UNION ALL SELECT terminal_id, lat FROM v_terminals WHERE terminal_id % 2 = 0")
def _(t):
    stops = t.v_terminals.select(F.col("terminal_id").alias("stop_id"), F.lit("unlike anything").alias("name"), F.when(F.col("terminal_id") % 2 == 0, F.col("lat")).alias("lat"), F.when(F.col("terminal_id") % 2 == 0, F.col("lon")).alias("lon"), "settlement")
    return spatial.resolve_stop_coords(stops, t.v_terminals).select("stop_id", "lat")


@query("c19_token_match", "SELECT p_partkey AS stop_id, p_partkey AS station_id, CASE WHEN p_partkey % 5 = 0 THEN 'override' ELSE 'tokens' END AS method FROM part")
def _(t):
    stops = t.part.select(F.col("p_partkey").alias("stop_id"), F.concat(F.lit("stop"), F.col("p_partkey").cast("string")).alias("name"), F.lit("").alias("settlement"))
    stations = t.part.select(F.col("p_partkey").alias("station_id"), F.concat(F.lit("Stop"), F.col("p_partkey").cast("string")).alias("name"), F.lit("bus").alias("transport"))
    fixed = t.part.where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("stop_id"), F.col("p_partkey").alias("station_id"))
    return spatial.token_match(stops, stations, fixed).select("stop_id", "station_id", "method")


@query("c20_token_geo_match", "SELECT terminal_id AS stop_id, terminal_id AS place_id, CASE WHEN terminal_id % 2 = 0 THEN 'near' ELSE 'words' END AS method FROM v_terminals")
def _(t):
    n = F.concat(F.lit("place"), F.col("terminal_id").cast("string")).alias("name")
    stops = t.v_terminals.select(F.col("terminal_id").alias("stop_id"), n, F.when(F.col("terminal_id") % 2 == 0, F.col("lat")).alias("lat"), F.when(F.col("terminal_id") % 2 == 0, F.col("lon")).alias("lon"))
    places = t.v_terminals.select(F.col("terminal_id").alias("place_id"), n, "lat", "lon")
    return spatial.token_geo_match(stops, places, 1.0).select("stop_id", "place_id", "method")


@query("c21_place_match_cascade", "SELECT terminal_id AS stop_id, CASE WHEN terminal_id % 2 = 0 THEN 1 ELSE 2 END AS rule FROM v_terminals")
def _(t):
    n = F.when(F.col("terminal_id") % 2 == 0, F.concat(F.lit("hub "), F.col("terminal_id").cast("string"))).otherwise("zzz")
    stops = t.v_terminals.select(F.col("terminal_id").alias("stop_id"), n.alias("name"), "region", "settlement")
    stations = t.v_terminals.where("terminal_id % 2 = 0").select(F.concat(F.lit("Hub "), F.col("terminal_id").cast("string")).alias("name"), "lat", "lon", F.lit(False).alias("hub"))
    over = t.v_terminals.groupBy("settlement").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    gaz = t.nation.select(F.col("n_name").alias("name"), F.lit(55.0).alias("lat"), F.lit(85.0).alias("lon"))
    centers = t.v_terminals.where("region = 'none'").groupBy("region").agg(F.avg("lat").alias("clat"), F.avg("lon").alias("clon"))
    return spatial.place_match_cascade(stops, stations, gaz, over, centers, []).select("stop_id", "rule")


@query("c22_resolve_hub", "SELECT n_nationkey AS hub_id, CASE WHEN n_nationkey % 2 = 0 THEN 'map' ELSE 'list' END AS source FROM nation")
def _(t):
    hubs = t.nation.select(F.col("n_nationkey").alias("hub_id"), F.concat("n_name", F.lit(" автовокзал")).alias("name"), F.array(F.lit("вокзал")).alias("aliases"))
    point = (F.lit(55.0).alias("lat"), F.lit(83.0).alias("lon"))
    a = t.nation.where("n_nationkey % 2 = 0").select(F.lit("map").alias("source"), F.lit(0).alias("priority"), F.col("n_name").alias("name"), *point)
    b = t.nation.select(F.lit("list").alias("source"), F.lit(1).alias("priority"), F.col("n_name").alias("name"), *point)
    return spatial.resolve_hub(hubs, a.unionByName(b)).select("hub_id", "source")


@query("c24_stop_for_place", "SELECT stop_id AS request_id, stop_id FROM v_stops")
def _(t):
    req = t.v_stops.select(F.col("stop_id").alias("request_id"), F.col("name").alias("place"), "lat", "lon")
    return spatial.stop_for_place(req, t.v_stops, summaries.origin_stops(t.v_stop_times), 5.0).select("request_id", "stop_id")


@query("c28_recover_unverified", f"SELECT record_id, min(stop_id) AS station_id FROM (SELECT r.record_id, s.stop_id, {hav('r.lat', 'r.lon', 's.lat', 's.lon')} AS km FROM (SELECT * FROM v_records WHERE lat IS NOT NULL ORDER BY record_id LIMIT 200) r JOIN v_stops s ON abs(r.lat - s.lat) < 0.2) WHERE km <= 20 GROUP BY record_id")
def _(t):
    u = t.v_records.withColumn("ordinal", F.col("record_id"))
    st = t.v_stops.select(F.col("stop_id").alias("station_id"), "name", "lat", "lon")
    return spatial.recover_unverified(u, st, 20.0).select("record_id", "station_id")


@query("c29_duplicate_suggestions", "SELECT n_nationkey AS review_id, n_nationkey AS terminal_id, 1 AS rank FROM nation")
def _(t):
    r = t.nation.select(F.col("n_nationkey").alias("review_id"), F.concat(F.lit("ОП "), F.lower(F.translate("n_name", " ", "x")), F.col("n_nationkey").cast("string")).alias("name"))
    m = t.nation.select(F.col("n_nationkey").alias("terminal_id"), F.concat(F.lower(F.translate("n_name", " ", "x")), F.col("n_nationkey").cast("string")).alias("name"))
    return spatial.duplicate_suggestions(r, m).select("review_id", "terminal_id", "rank")


@query("c31_name_gate", "SELECT region, settlement, min(terminal_id) AS candidate_id FROM v_terminals GROUP BY region, settlement")
def _(t):
    c = t.v_terminals.select(F.col("terminal_id").alias("candidate_id"), "region", "settlement", F.col("settlement").alias("name"))
    return spatial.name_gate(c).select("region", "settlement", "candidate_id")


@query("a04_stations_to_records", "SELECT terminal_id AS record_id, CASE WHEN terminal_id % 10 <> 0 THEN lat END AS lat, CAST(terminal_id AS VARCHAR) AS code FROM v_terminals WHERE terminal_id % 7 <> 0")
def _(t):
    zero = F.col("terminal_id") % 10 == 0
    rows = t.v_terminals.select(F.col("terminal_id").alias("id"), F.lit("node").alias("kind"), F.when(F.col("terminal_id") % 7 != 0, F.col("name")).otherwise(" ").alias("name"), F.create_map(F.lit("a"), F.lit("b")).alias("tags"), F.when(zero, 0.0).otherwise(F.col("lat")).alias("lat"), F.when(zero, 0.0).otherwise(F.col("lon")).alias("lon"))
    return readers.stations_to_records(rows).select("record_id", "lat", F.element_at("codes", 1)["code"].alias("code"))


@query("a05_flatten_station_tree", "SELECT settlement, name, lat, 'flight' AS transport FROM v_stops")
def _(t):
    station = F.struct(F.col("name").alias("title"), F.col("lon").cast("string").alias("longitude"), F.col("lat").cast("string").alias("latitude"), F.lit("plane").alias("transport_type"), F.lit("x").alias("station_type"), F.struct(F.col("stop_id").cast("string").alias("yandex_code"), F.lit("").alias("esr_code")).alias("codes"))
    places = t.v_stops.groupBy("region", "settlement").agg(F.collect_list(station).alias("stations"))
    regions = places.groupBy("region").agg(F.collect_list(F.struct(F.col("settlement").alias("title"), "stations")).alias("settlements"))
    doc = regions.agg(F.array(F.struct(F.lit("C").alias("title"), F.collect_list(F.struct(F.col("region").alias("title"), "settlements")).alias("regions"))).alias("countries"))
    return readers.flatten_station_tree(doc).select("settlement", "name", "lat", "transport")


@query("a10_filter_tagged_objects", "SELECT terminal_id AS id, CASE WHEN terminal_id % 2 = 0 THEN lat ELSE lat + 0.5 END AS lat FROM v_terminals WHERE terminal_id % 3 <> 0")
def _(t):
    k = F.col("terminal_id")
    objects = t.v_terminals.select(k.alias("id"), F.when(k % 2 == 0, "node").otherwise("way").alias("kind"), F.create_map(F.when(k % 3 == 0, "shop").otherwise("highway"), F.lit("bus_stop")).alias("tags"), F.when(k % 2 == 0, F.col("lat")).alias("lat"), F.when(k % 2 == 0, F.col("lon")).alias("lon"), F.array(k * 2, k * 2 + 1).alias("node_ids"))
    nodes = t.v_terminals.select((k * 2).alias("node_id"), "lat", "lon").union(t.v_terminals.select(k * 2 + 1, F.col("lat") + 1, "lon"))
    return readers.filter_tagged_objects(objects, nodes).select("id", "lat")


@query("a11_threads_to_feed", "SELECT CAST(trip_id AS VARCHAR) AS trip_id, CAST(seq AS INT) AS seq, departure_s % 86400 AS departure_s FROM v_stop_times")
def _(t):
    hms = clock.feed_hms(F.col("departure_s") % 86400)
    stop = F.struct(F.col("stop_id").cast("string").alias("code"), F.lit("x").alias("title"), F.lit(None).cast("string").alias("arrival"), hms.alias("departure"))
    lists = t.v_stop_times.select("trip_id", "seq", stop.alias("s")).groupBy("trip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "s"))), lambda x: x["s"]).alias("stops"))
    threads = lists.select(F.col("trip_id").cast("string").alias("thread_id"), F.lit("").alias("number"), F.lit("t").alias("title"), F.col("trip_id").cast("string").alias("uid"), F.lit("bus").alias("transport_type"), F.explode(F.array(F.lit("2024-01-01"), F.lit("2024-01-02"))).alias("date"), "stops")
    out = readers.threads_to_feed(threads, t.v_stops.select(F.col("stop_id").cast("string").alias("code")))
    return out["stop_times"].select("trip_id", F.col("seq").cast("int").alias("seq"), "departure_s")


@query("a12_extract_region_stations", "SELECT CAST(stop_id AS VARCHAR) AS code, settlement || ', ' || name AS display FROM v_stops WHERE region = 'ASIA'")
def _(t):
    tree = t.v_stops.select(F.lit("C").alias("country"), "region", "settlement", "name", F.lit("bus").alias("transport"), F.array(F.struct(F.lit("y").alias("system"), F.lit("y").alias("code_type"), F.col("stop_id").cast("string").alias("code"))).alias("codes"), F.col("stop_id").alias("ordinal"))
    return readers.extract_region_stations(tree, "ASIA", "bus", "C").select("code", "display")


@query("a22_build_registry", "SELECT region, count(DISTINCT name) AS stops FROM v_stops GROUP BY region")
def _(t):
    rows = t.v_stops.select(F.concat(F.lit("54."), F.col("settlement")).alias("reg"), F.col("stop_id").alias("seq"), "name", "region", F.lit("").alias("op_reg"), F.lit("10:00").alias("dep"), F.lit("10:05").alias("arr"), F.lit("пн-пт").alias("days"), F.lit("").alias("period"))
    firms = t.nation.select(F.col("n_name").alias("name"), F.lit("1").alias("inn"), F.col("n_nationkey").alias("ordinal"))
    out = readers.build_registry(rows.select("reg").distinct(), firms, rows, rows, [])
    return out["stops"].groupBy("region").agg(F.count("*").alias("stops"))


# ---- readers and writers over files made of the driver's tables, and streams over the tables


def folder(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("a01_read_feed", "SELECT CAST(trip_id AS VARCHAR) AS trip_id, printf('%02d:%02d:%02d', arrival_s // 3600, arrival_s % 3600 // 60, arrival_s % 60) AS arrival_time, CAST(stop_id AS VARCHAR) AS stop_id, CAST(seq AS VARCHAR) AS stop_sequence FROM v_stop_times")
def _(t):
    at = folder(t, "feed")
    for name, df in feed(t).items():
        df.withColumnsRenamed({"lat": " stop_lat", "lon": "stop_lon "} if name == "stops" else {}).write.option("header", True).csv(f"{at}/{name}.txt")
    return readers.read_feed(t.spark, at)["stop_times"].select("trip_id", "arrival_time", "stop_id", "stop_sequence")


def registry_documents(schedules: DataFrame) -> DataFrame:
    """Documents of a registry: the schedules of a region, some 3,300 trip numbers each, so that none grows with the table."""
    part = F.concat_ws("-", F.substring("route", 1, 2), F.floor(F.split_part("route", F.lit("."), F.lit(2)).cast("long") / 100_000))
    meta = F.struct(F.lit("registry").alias("source"), F.lit("1995-01-01").alias("snapshot"))
    return schedules.groupBy(part.alias("part")).agg(meta.alias("meta"), F.collect_list(F.struct("route", "direction", "service_id", "stops")).alias("schedules"))


@query("a03_read_registry", "SELECT lpad(CAST(trip_id % 30 AS VARCHAR), 2, '0') || '.' || trip_id AS route, direction, count(*) AS stops FROM v_stop_times JOIN v_trips USING (trip_id) GROUP BY trip_id, direction")
def _(t):
    reg, at = registry(t), folder(t, "registry")
    registry_documents(reg["schedules"]).drop("part").write.option("maxRecordsPerFile", 1).json(at)
    return readers.read_registry(t.spark, at)["schedules"].select("route", "direction", F.size("stops").cast("long").alias("stops"))


@query("a06_read_map_elements", "SELECT CAST(stop_id AS VARCHAR) AS code, name, lat FROM v_stops WHERE stop_id % 5 <> 0")
def _(t):
    at = folder(t, "elements")
    element = F.struct(F.lit("node").alias("type"), F.col("stop_id").alias("id"), F.when(F.col("stop_id") % 2 == 0, F.col("lat")).alias("lat"), F.when(F.col("stop_id") % 2 == 0, F.col("lon")).alias("lon"), F.when(F.col("stop_id") % 2 == 1, F.struct("lat", "lon")).alias("center"), F.when(F.col("stop_id") % 5 != 0, F.create_map(F.lit("name"), F.col("name"))).alias("tags"))
    t.v_stops.groupBy("settlement").agg(F.collect_list(element).alias("elements")).write.partitionBy("settlement").json(at)
    return readers.read_map_elements(t.spark, at).select("code", "name", "lat")


@query("a06_read_map_elements_split", "SELECT CAST(stop_id AS VARCHAR) AS code, name, lat FROM v_stops")
def _(t):
    # One large document a region, written as a stream of lines and read by many tasks.
    at = folder(t, "elements")
    element = F.struct(F.lit("node").alias("type"), F.col("stop_id").alias("id"), "lat", "lon", F.create_map(F.lit("name"), F.col("name"), F.lit("note"), F.lit('}, "elements": [{')).alias("tags"))
    rows = t.v_stops.select("region", F.lit(1).alias("part"), F.concat(F.lit(","), F.to_json(element)).alias("value"))
    for part, text in ((0, '{"version": {"n": {}}, "elements": [{}'), (2, "]}")):
        rows = rows.unionByName(t.region.select(F.col("r_name").alias("region"), F.lit(part).alias("part"), F.lit(text).alias("value")))
    rows.repartition("region").sortWithinPartitions("region", "part").select("region", "value").write.partitionBy("region").text(at)
    return readers.read_map_elements(t.spark, at, split=True).select("code", "name", "lat")


@query("a07_read_route_relations", "SELECT trip_id AS relation_id, CAST(trip_id AS VARCHAR) AS ref, CAST(count(*) AS INT) AS stop_count FROM v_stop_times GROUP BY trip_id")
def _(t):
    at = folder(t, "relations")
    members = F.transform(F.array_sort(F.collect_list(F.struct("seq", "stop_id"))), lambda x: F.struct(F.lit("node").alias("type"), x["stop_id"].alias("ref"), F.lit("").alias("role")))
    routes = t.v_stop_times.groupBy("trip_id").agg(members.alias("members")).withColumn("part", F.pmod("trip_id", F.lit(64)))
    name = F.col("trip_id").cast("string")
    element = F.struct(F.lit("relation").alias("type"), F.col("trip_id").alias("id"), "members", F.create_map(F.lit("ref"), name, F.lit("name"), name, F.lit("route"), F.lit("bus")).alias("tags"))
    routes.groupBy("part").agg(F.collect_list(element).alias("elements")).write.partitionBy("part").json(at)
    return readers.read_route_relations(t.spark, at).select("relation_id", "ref", "stop_count")


@query("a18_skip_unchanged", "SELECT 'first' AS run, 1 AS files UNION ALL SELECT 'second', 0")
def _(t):
    none = t.nation.limit(0).select(F.lit("p").alias("provider"), F.lit("h").alias("sha256"), F.lit(0).alias("imported_at"))
    first = readers.skip_unchanged(t.spark, f"{t.sf_dir}/supplier.parquet", "p", none)
    second = readers.skip_unchanged(t.spark, f"{t.sf_dir}/supplier.parquet", "p", first.select("provider", "sha256", F.lit(1).alias("imported_at")))
    return first.agg(F.lit("first").alias("run"), F.count("*").alias("files")).unionByName(second.agg(F.lit("second").alias("run"), F.count("*").alias("files")))


@query("a19_ops_log", "SELECT user_id AS chunk_key, arg_max(event_id, (us, event_id)) AS event_id FROM (SELECT user_id, event_id, epoch_us(ts) AS us FROM events WHERE event_id % 3 <> 0) GROUP BY user_id")
def _(t):
    at = folder(t, "ops")
    rows = t.events.select(F.col("user_id").alias("chunk_key"), "event_id", F.when(F.col("event_id") % 3 != 0, "done").otherwise("started").alias("state"), F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("n")).alias("at"))
    writers.write_ops_log(rows, at)
    return writers.read_ops_log(t.spark, at, "chunk_key long, event_id long, state string, at struct<us:long,n:long>").select("chunk_key", "event_id")


@query("a20_read_seed_places", "SELECT name, lower(name) AS query, 'seed' AS origin, lat FROM v_stops")
def _(t):
    at = folder(t, "places")
    place = F.struct("name", F.array("settlement").alias("aliases"), "lat", "lon")
    t.v_stops.groupBy("settlement").agg(F.to_json(F.collect_list(place)).alias("value")).write.partitionBy("settlement").text(at)
    return readers.read_seed_places(t.spark, at).select("name", "query", "origin", "lat")


@query("a23_write_review_csv", "SELECT CAST(terminal_id AS VARCHAR) AS entity_id, reason, round(score, 6) AS score FROM v_reviews")
def _(t):
    at = folder(t, "reviews")
    writers.write_review_csv(t.v_reviews.select(F.lit("terminal").alias("entity_type"), F.col("terminal_id").alias("entity_id"), "reason", "score", "observed_at"), at)
    back = t.spark.read.schema("entity_type string, entity_id string, reason string, score double, observed_at string").option("header", True).csv(at)
    return back.select("entity_id", "reason", r6("score").alias("score"))


@query("s01_consume_outbox", "SELECT DISTINCT event_type AS region FROM events")
def _(t):
    regions: list[str] = []
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/event[s].parquet")
    rows = stream.select(F.lit("terminal_created").alias("event"), F.col("event_type").alias("region"))
    streams.consume_outbox(rows, regions.extend, folder(t, "outbox")).trigger(availableNow=True).start().awaitTermination()
    return t.spark.createDataFrame([(r,) for r in sorted(set(regions))], "region string")


@query("s04_expiry_stream", "SELECT user_id, count(*) AS seen, CAST(floor(epoch(min(ts))) AS BIGINT) AS first_s, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_s FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, session")
def _(t):
    gone = streams.expiry_stream(t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts", "1 day")
    return gone.select("user_id", "seen", F.unix_timestamp("first_seen").alias("first_s"), F.unix_timestamp("last_seen").alias("last_s"))


@query("s06_cache_stream", "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN 'miss' WHEN (epoch(ts) - epoch((SELECT min(ts) FROM events))) / 86400 <= 10 THEN 'fresh' ELSE 'stale' END AS state FROM events")
def _(t):
    first = t.events.agg(F.min("ts").cast("timestamp").alias("cached_at"))
    asked = t.events.select("event_id", F.col("event_type").alias("text"), F.when(F.col("event_id") % 4 == 0, "osm").otherwise("yandex").alias("provider"), F.col("ts").cast("timestamp").alias("asked_at"))
    cache = t.events.select(names.normalize_query(F.col("event_type")).alias("query")).distinct().join(first).select("query", F.lit("osm").alias("provider"), "cached_at", F.lit("live").alias("origin"), F.lit(True).alias("verified"))
    return streams.cache_stream(asked, cache, days=10).select("event_id", "state")
