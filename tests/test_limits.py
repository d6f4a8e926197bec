"""Inputs beyond any round number: long chains, deep hierarchies, many regions, rows without a point."""

import random

import pytest
from pyspark.sql import functions as F

from railweave import catalog
from railweave.operators import linkage, lookups, spatial, summaries, timetables

NO_CODES = linkage.NO_CODES


def test_long_chain_of_stops_is_grouped_whole(spark):
    # Stops 150 m apart: each is in range of the one before only, so leaders and members take turns.
    stops = spark.createDataFrame([(i, i, 55.0 + i * 0.00135, 83.0) for i in range(80)], "stop_id long, ordinal long, lat double, lon double")
    got = {r.stop_id: r.terminal_id for r in linkage.group_terminals(stops).collect()}
    assert got == {i: i - i % 2 for i in range(80)}


def test_deep_hierarchy_and_circle(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(41)], "place_id long, parent_id long")
    full = summaries.closure_table(chain)
    assert full.count() == 41 * 42 // 2 and full.agg(F.max("depth")).first()[0] == 40
    circle = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "place_id long, parent_id long")
    with pytest.raises(ValueError, match="circle"):
        summaries.closure_table(circle)


def record_side(spark, key, rows):
    return spark.createDataFrame(rows, f"{key} long, ordinal long, name string, lat double, lon double, settlement string, transport string, source string, codes {NO_CODES}")


def test_records_without_a_point_lose_no_decision(spark):
    rng = random.Random(9)
    words = ["Томск", "Томск1", "Омск", "Бийск", "Бийск Южный", "Рынок", "Ринок", "Автовокзал", "Порт"]
    row = lambda i, bare: (i, i, rng.choice(words), None if bare else 55.0 + rng.randrange(4) * 0.003, None if bare else 83.0, rng.choice(["", "Томск", "Омск"]), rng.choice(["", "bus"]), "osm", [])
    left = record_side(spark, "left_id", [row(i, i % 3 == 0) for i in range(40)] + [(40, 40, "Томск", None, None, "", "", "osm", [])])
    right = record_side(spark, "right_id", [row(i, i % 2 == 0) for i in range(30)] + [(30, 30, "Томск1", None, None, "", "", "osm", [])])
    got = {r.left_id: (r.right_id, r.result) for r in linkage.blocked_fuzzy_join(left, right).collect()}
    # Every pair near enough or without a point, scored and settled by the same rule.
    point = F.col("a.lat").isNotNull() & F.col("b.lat").isNotNull()
    metres = F.sqrt(F.pow((F.col("a.lat") - F.col("b.lat")) * 111000, 2) + F.pow((F.col("a.lon") - F.col("b.lon")) * 60000, 2))
    pairs = left.alias("a").crossJoin(right.alias("b")).where(~point | (metres <= 2000)).select("left_id", "right_id")
    every = linkage.decide_join(linkage.scored_links(left, right, pairs))
    want = {r.left_id: (r.right_id if r.result != "identity_only" else None, r.result) for r in every.collect()}
    assert got == {i: want.get(i, (None, "identity_only")) for i in range(41)}
    assert any(r == "ambiguous" for _, r in got.values())


def serial(rows, cfg):
    """The greedy loop itself over (left_id, ordinal, right_id, right_no, score, metres, code)."""
    lists, used, out = {}, set(), {}
    for r in rows:
        lists.setdefault((r.ordinal, r.left_id), []).append(r)
    for (_, left), every in sorted(lists.items()):
        free = sorted((r for r in every if r.right_id not in used and r.score > 0), key=lambda r: (-r.score, r.right_no))
        if not free:
            continue
        best, second = free[0], free[1].score if len(free) > 1 else 0.0
        gap, result = best.score - second, "identity_only"
        if best.score >= cfg.threshold and (gap >= cfg.margin or second == 0) and (best.code or (best.metres is not None and best.metres <= cfg.distance_m)):
            result = "enriched"
        elif len(every) > 1 and best.score >= cfg.threshold - cfg.margin and gap < cfg.ambiguity:
            result = "ambiguous"
        if result != "identity_only":
            used.add(best.right_id)
        out[left] = (best.right_id, second, result)
    return out


LINKS = "left_id long, ordinal long, right_id long, right_no long, score double, metres double, code boolean"


@pytest.mark.parametrize("most", [1 << 21, 40])
def test_contested_links_are_settled_as_in_the_loop(spark, most):
    rng = random.Random(4)
    rows = [(i, (i * 7) % 60, r, r, rng.choice([0.0, 0.3, 0.46, 0.5, 0.52, 0.55, 0.6, 0.7, 0.9]), rng.choice([None, 100.0, 900.0]), rng.random() < 0.2) for i in range(60) for r in sorted(rng.sample(range(25), rng.randrange(1, 9)))]
    df = spark.createDataFrame(rows, LINKS)
    got = {r.left_id: (r.right_id, r.second, r.result) for r in linkage.decide_join(df, most=most).collect()}
    assert got == serial(df.collect(), linkage.LinkConfig())


def test_long_chain_of_contested_links(spark):
    # Row 0 takes 1; each row i prefers i, which the row before it has taken, and is left with i + 1.
    n = 100000
    rows = spark.range(n).selectExpr("id AS left_id", "id AS ordinal", "explode(array(id, id + 1)) AS right_id").selectExpr("left_id", "ordinal", "right_id", "right_id AS right_no", "CASE WHEN right_id = left_id THEN 0.8D ELSE 0.78D END AS score", "100.0D AS metres", "false AS code").where("right_id > 0")
    got = linkage.decide_join(rows)
    want = serial(rows.collect(), linkage.LinkConfig())
    assert want[n - 1][0] == n
    assert {r.left_id: (r.right_id, r.second, r.result) for r in got.collect()} == want


def test_similar_names_are_those_of_the_full_product(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("аабвгд ") for _ in range(rng.randrange(0, 31))).strip()
    some = [word() for _ in range(70)]
    bent = [w[: len(w) // 2] + rng.choice(["", "а", "ж"]) + w[len(w) // 2 + rng.randrange(2) :] for w in some[:40]] + [w[2:9] for w in some[40:60]] + [word() for _ in range(20)]
    least = {"low": 0.33, "high": 0.7}
    side = lambda lot: spark.createDataFrame([(k, w) for k in least for w in lot], "kind string, norm string")
    left, right = side(some), side(bent)
    got = {(r.kind, r.x, r.y) for r in linkage.similar_names(left, right, least).collect()}
    pairs = left.distinct().alias("a").join(right.distinct().alias("b"), "kind").select("kind", F.col("a.norm").alias("x"), F.col("b.norm").alias("y"))
    from railweave.functions import names

    every = pairs.select("*", names.plain_similarity(F.col("x"), F.col("y")).alias("s")).collect()
    assert got == {(r.kind, r.x, r.y) for r in every if r.s >= least[r.kind] - 1e-9}
    assert len(got) > 100


def test_stop_without_settlement_match_finds_a_like_name(spark):
    stops = spark.createDataFrame([(1, "Томск", None, None, "Томск")], "stop_id long, name string, lat double, lon double, settlement string")
    terminals = spark.createDataFrame([(7, "Томск1", 56.5, 85.0, "")], "terminal_id long, name string, lat double, lon double, settlement string")
    got = spatial.resolve_stop_coords(stops, terminals).first()
    assert (got.lat, got.resolved_by) == (56.5, 7)


def test_many_blocked_regions_block_all_their_routes(spark):
    n = 1500
    trips = spark.createDataFrame([(f"t{i}", str(i)) for i in range(n)], "trip_id string, route_id string")
    stops = spark.createDataFrame([(f"t{i}", f"r{i}") for i in range(n)], "trip_id string, region string")
    low = stops.select("region", F.when(F.col("region") == "r7", 0.9).otherwise(0.1).alias("ratio"))
    assert [r.trip_id for r in timetables.attachable_trips(trips, stops, low, 0.5).collect()] == ["t7"]
    assert timetables.attachable_trips(trips, stops, low, 0.5, force=True).count() == n


def test_nearest_stop_of_all_at_any_distance(spark):
    import math

    rng = random.Random(6)
    stops = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(40)] + [(40 + i, 55 + rng.random(), 82 + rng.random()) for i in range(60)] + [(200, 0.0, 0.0), (201, None, 5.0)]
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(40)] + [(50, 90.0, 0.0), (51, -90.0, 7.0), (52, 10.0, 180.0), (53, 10.0, -180.0), (54, 56.0, 83.0), (55, None, 1.0)]

    def km(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 12742.0 * math.asin(math.sqrt(min(1.0, h)))

    got = {r.point_id: r.stop_id for r in spatial.nearest_of_all(spark.createDataFrame(points, "point_id long, lat double, lon double"), spark.createDataFrame(stops, "stop_id long, lat double, lon double")).collect()}
    assert got == {p[0]: min(stops[:100], key=lambda s: (km(p, s), s[0]))[0] for p in points[:-1]}


def test_documents_of_a_region_stay_small(spark):
    rows = spark.range(0, 600_000, 30).select(F.concat(F.lit("00."), "id").alias("route"), F.lit("forward").alias("direction"), F.lit(1).alias("service_id"), F.array().cast("array<string>").alias("stops"))
    sizes = [r.n for r in catalog.registry_documents(rows).select(F.size("schedules").alias("n")).collect()]
    assert sum(sizes) == 20_000 and max(sizes) <= 3_334


def test_fares_are_found_by_case_and_not_by_leg(spark):
    rng = random.Random(4)
    zones = [(s, z) for s in range(9) for z in rng.sample(["1", "2", "3", None], rng.randrange(3))]
    rules = [(i, rng.choice(["", "0", "1"]), rng.choice(["", "1", "2"]), rng.choice(["", "2", "3"]), rng.choice("abc")) for i in range(25)]
    legs = [(i, rng.choice([None, 0, 1]), rng.randrange(11), rng.choice([None, *range(9)])) for i in range(200)]
    price = {"a": 1.0, "b": 2.0}
    out = lookups.fare_for_leg(
        spark.createDataFrame(legs, "leg_id int, route_id int, from_stop int, to_stop int"),
        spark.createDataFrame(rules, "rule_no int, route_id string, from_zone string, to_zone string, fare_id string"),
        spark.createDataFrame(zones, "stop_id int, zone_id string"),
        spark.createDataFrame([(k, v, "RUB") for k, v in price.items()], "fare_id string, price double, currency string"),
    )
    assert "hashpartitioning(leg_id" not in out._jdf.queryExecution().executedPlan().toString()
    of = lambda stop: {z or "" for s, z in zones if s == stop} or {""}
    want = {}
    for leg, route, a, b in legs:
        hits = [f for _, r, x, y, f in rules if r in ("", str(route) if route is not None else "") and x in {"", *of(a)} and y in {"", *of(b)}]
        want[leg] = price.get(hits[0]) if hits else None
    assert {r.leg_id: r.price for r in out.collect()} == want and out.count() == len(legs)


def test_periods_are_told_before_stops_are_rows(spark):
    rows = spark.createDataFrame([], f"route string, direction string, service_id long, stops array<struct<stop:string,region:string,winter:{catalog.BLOCK},summer:{catalog.BLOCK}>>")
    plan = timetables.run_rows(rows)._jdf.queryExecution().analyzed().toString()
    assert max(plan.index(f"posexplode({c}") for c in ("stops",)) < plan.index("Window [")
