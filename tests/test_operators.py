"""Order-dependent operators against plain loops on random data, and small golden cases."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from railweave.operators import canon, linkage, sequences, spatial, summaries, tables
from railweave.plans import journeys

NO_CODES = linkage.NO_CODES


def test_commit_rounds_equal_serial_greedy(spark):
    rng = random.Random(3)
    cfg = linkage.LinkConfig()
    rows = [(i, i, j, j, rng.choice([0.3, 0.52, 0.55, 0.7, 0.85, 0.9]), rng.choice([50.0, 450.0, 900.0]), rng.random() < 0.2) for i in range(40) for j in rng.sample(range(25), 4)]
    df = spark.createDataFrame(rows, "left_id long, ordinal long, right_id long, right_no long, score double, metres double, code boolean")
    used, want = set(), {}
    for i in range(40):
        mine = [r for r in rows if r[0] == i]
        free = sorted((r for r in mine if r[2] not in used), key=lambda r: (-r[4], r[3]))
        if not free:
            continue
        best, second = free[0], free[1][4] if len(free) > 1 else 0.0
        gap = best[4] - second
        if best[4] >= 0.6 and (gap >= 0.1 or second == 0) and (best[6] or best[5] <= 500):
            want[i] = (best[2], "enriched")
        elif len(mine) > 1 and best[4] >= 0.5 and gap < 0.05:
            want[i] = (best[2], "ambiguous")
        else:
            want[i] = (best[2], "identity_only")
        if want[i][1] != "identity_only":
            used.add(best[2])
    for rounds in (30, 1):
        got = {r.left_id: (r.right_id, r.result) for r in linkage.decide_join(df, cfg, rounds).collect()}
        assert got == want


def test_group_terminals_equals_first_fit(spark):
    rng = random.Random(5)
    stops = [(i, i, 55 + rng.random() * 0.01, 83 + rng.random() * 0.01) for i in range(60)]
    import math

    def metres(a, b):
        dy, dx = math.radians(a[2] - b[2]), math.radians(a[3] - b[3])
        h = math.sin(dy / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(dx / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(h))

    leaders, want = [], {}
    for s in stops:
        lead = next((x for x in leaders if metres(s, x) < 200), None)
        if lead is None:
            leaders.append(s)
            lead = s
        want[s[0]] = lead[0]
    df = spark.createDataFrame(stops, "stop_id long, ordinal long, lat double, lon double")
    assert {r.stop_id: r.terminal_id for r in linkage.group_terminals(df).collect()} == want


def test_unwrap_midnight_equals_loop(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for trip in range(20):
        last = None
        for seq in range(6):
            pair = []
            for _ in range(2):
                raw = rng.randrange(1440)
                t = raw
                while last is not None and t < last:
                    t += 1440
                last = t
                pair.append((raw, t))
            rows.append((trip, seq, pair[0][0], pair[1][0]))
            want[trip, seq] = (pair[0][1], pair[1][1])
    df = spark.createDataFrame(rows, "trip_id long, seq int, arr int, dep int")
    assert {(r.trip_id, r.seq): (r.arr, r.dep) for r in sequences.unwrap_midnight(df).collect()} == want


def test_labels_equal_serial_scan(spark):
    rng = random.Random(11)
    times, legs = [], []
    for trip in range(40):
        t = rng.randrange(20000, 40000)
        path = rng.sample(range(15), 5)
        for seq, stop in enumerate(path):
            times.append((trip, seq, stop, t, t + 30))
            if seq:
                legs.append((times[-2][4], t, times[-2][2], stop))
            t += rng.randrange(300, 1500)
    walks = [(0, 1, 5), (1, 0, 5), (4, 9, 7), (9, 4, 7)]
    best = {}
    for start in range(4):
        arr = {start: 21000}
        for _ in range(3):
            for a, b, m in walks:
                if a in arr and arr[a] + m * 60 < arr.get(b, 10**9):
                    arr[b] = arr[a] + m * 60
            for dep, at, a, b in sorted(legs):
                if a in arr and arr[a] <= dep and at < arr.get(b, 10**9):
                    arr[b] = at
                    for x, y, m in walks:
                        if x == b and at + m * 60 < arr.get(y, 10**9):
                            arr[y] = at + m * 60
        best.update({(start, s): t for s, t in arr.items()})
    parts = spark.createDataFrame([(a, 0, b, c, d, e, "bus") for a, b, c, d, e in times], "trip_id long, part int, seq int, stop_id long, arrival_s int, departure_s int, mode string")
    req = spark.createDataFrame([(i, i, 21000) for i in range(4)], "request_id long, stop_id long, departure_s int")
    links = spark.createDataFrame(walks, "from_stop long, to_stop long, minutes int")
    labels = journeys.earliest_arrival(req, parts, journeys.walk_closure(links), 10)
    assert {(r.request_id, r.stop_id): r.arrival_s for r in labels.collect()} == best


def test_journeys_of_many_rides(spark):
    # Trip i rides from stop i to i + 1 only, so stop 11 takes 11 rides; the slow trip 50 goes there directly.
    times = [(i, 0, i, 1000 * i, 1000 * i) for i in range(11)] + [(i, 1, i + 1, 1000 * i + 900, 1000 * i + 900) for i in range(11)]
    times += [(50, 0, 0, 0, 0), (50, 1, 11, 50000, 50000), (60, 0, 0, 7, 7), (60, 1, 40, 8, 8)]
    parts = spark.createDataFrame([(a, 0, b, c, d, e, "bus") for a, b, c, d, e in times], "trip_id long, part int, seq int, stop_id long, arrival_s int, departure_s int, mode string")
    walks = journeys.walk_closure(spark.createDataFrame([(100 + i, 101 + i, 1) for i in range(20)], "from_stop long, to_stop long, minutes int"))
    assert walks.count() == 20 * 21 // 2 and {r.minutes for r in walks.where("from_stop = 100 AND to_stop = 120").collect()} == {20}
    req = spark.createDataFrame([(1, 0, 0)], "request_id long, stop_id long, departure_s int")
    labels = {r.stop_id: (r.arrival_s, r.legs) for r in journeys.earliest_arrival(req, parts, walks).collect()}
    assert labels[11] == (10900, 11)
    limits = spark.createDataFrame([(1, 5)], "request_id long, most int")
    labels = {r.stop_id: (r.arrival_s, r.legs) for r in journeys.earliest_arrival(req, parts, walks, limits=limits).collect()}
    assert labels[5] == (4900, 5) and 6 not in labels and labels[11] == (50000, 1)
    by = spark.createDataFrame([(1, 0, 11, 20000), (2, 0, 11, 10000), (3, 0, 40, 20000), (4, 102, 110, 20000)], "request_id long, stop_id long, goal_stop long, limit_s int")
    assert {r.request_id: (r.departure_s, r.arrival_s, len(r.path)) for r in journeys.arrive_by(by, parts, walks).collect()} == {1: (0, 10900, 11), 3: (7, 8, 1), 4: (18200, 18680, 1)}


def test_arrive_by_is_the_last_departure_in_time(spark):
    rng = random.Random(11)
    times = []
    for trip in range(40):
        t = rng.randrange(20000, 40000)
        for seq, stop in enumerate(rng.sample(range(12), 4)):
            times.append((trip, 0, seq, stop, t, t + 30, "bus"))
            t += rng.randrange(300, 1500)
    parts = spark.createDataFrame(times, "trip_id long, part int, seq int, stop_id long, arrival_s int, departure_s int, mode string")
    walks = journeys.walk_closure(spark.createDataFrame([(0, 1, 5), (1, 0, 5), (4, 9, 7), (9, 4, 7)], "from_stop long, to_stop long, minutes int"))
    by = [(a * 100 + b, a, b, 38000) for a in range(4) for b in range(12)]
    runs = {(i, d): (i * 10**6 + d, a, d) for i, a, _, m in by for d in {x[5] for x in times if x[3] == a and x[5] <= m}}
    labels = journeys.earliest_arrival(spark.createDataFrame(list(runs.values()), "request_id long, stop_id long, departure_s int"), parts, walks)
    at = {(r.request_id, r.stop_id): r.arrival_s for r in labels.collect()}
    want = {}
    for i, _, b, m in by:
        good = [(d, at[k[0], b]) for (j, d), k in runs.items() if j == i and at.get((k[0], b), m + 1) <= m]
        if good:
            want[i] = max(good)
    got = journeys.arrive_by(spark.createDataFrame(by, "request_id long, stop_id long, goal_stop long, limit_s int"), parts, walks)
    assert {r.request_id: (r.departure_s, r.arrival_s) for r in got.collect()} == want and len(want) > 20


def test_match_trip_stops_is_exclusive(spark):
    s = lambda v: (v, 1.0, False, True, 10.0, 1.0, True)
    kind = "struct<value:double,trust:double,code:boolean,has_geom:boolean,metres:double,name_sim:double,guard:boolean>"
    scored = spark.createDataFrame([(1, 100, "urban", s(0.9)), (2, 100, "urban", s(0.95)), (2, 200, "urban", s(0.7)), (3, 100, "urban", s(0.9))], f"stop_key long, cand_no long, density string, s {kind}")
    trips = spark.createDataFrame([(7, 0, 1), (7, 1, 2), (7, 2, 3)], "trip_id long, seq int, stop_key long")
    got = {r.seq: (r.terminal_id, r.decision) for r in linkage.match_trip_stops(trips, scored).collect()}
    assert got == {0: (100, "verified"), 1: (200, "verified"), 2: (100, "verified")}


def test_full_fuzzy_join_takes_each_left_row_alone(spark):
    code = "array<struct<system:string,code_type:string,code:string>>"
    side = lambda key, rows: spark.createDataFrame(rows, "id long, name string, lat double, lon double").select(F.col("id").alias(key), F.col("id").alias("ordinal"), "name", "lat", "lon", F.lit("").alias("settlement"), F.lit("").alias("transport"), F.lit("osm").alias("source"), F.array().cast(code).alias("codes"))
    left = side("left_id", [(i, "Vokzal", 55.0, 83.0) for i in range(3)] + [(3, "Rynok", 56.0, 84.0)])
    # More than 10,000 right rows, of which one is the station.
    right = side("right_id", [(0, "Vokzal", 55.0, 83.0)] + [(i, f"Zavod {i}", 50.0 + i % 7, 70.0) for i in range(1, 10_003)])
    got = {r.left_id: (r.result, r.right_id) for r in linkage.full_fuzzy_join(left, right).collect()}
    assert {got[i] for i in range(3)} == {("enriched", 0)} and got[3] == ("identity_only", None)


def test_terminals_without_a_point_are_candidates_of_all(spark):
    code = "array<struct<system:string,code_type:string,code:string>>"
    stops = spark.createDataFrame([(1, "Vokzall", 55.0, 83.0, []), (2, "Rynok", None, None, [])], f"stop_key long, name string, lat double, lon double, codes {code}")
    terminals = spark.createDataFrame([(10, "Vokzal", None, None, []), (11, "Far", 58.0, 83.0, []), (12, "Near", 55.6, 83.0, [])], f"terminal_id long, name string, lat double, lon double, codes {code}")
    got = {(r.stop_key, r.terminal_id) for r in linkage.attach_candidates(stops, terminals).collect()}
    assert got == {(1, 10), (2, 10), (1, 12)}


def test_match_of_many_candidates(spark):
    kind = "struct<value:double,trust:double,code:boolean,has_geom:boolean,metres:double,name_sim:double,guard:boolean>"
    rng = random.Random(4)
    rows = [(k, c, "urban", (rng.choice([0.2, 0.5, 0.7, 0.72, 0.8, 0.9]), 1.0, False, True, 10.0, 1.0, True)) for k in range(8) for c in range(k, k * 5 + 1)]
    scored = spark.createDataFrame(rows, f"stop_key long, cand_no long, density string, s {kind}")
    trips = spark.createDataFrame([(k, 0, k) for k in range(8)], "trip_id long, seq int, stop_key long")
    best = {r.stop_key: (r.decision, r.s.value, r.cand_no) for r in linkage.match_best(scored, "stop_key").collect()}
    for r in linkage.match_trip_stops(trips, scored).collect():
        assert (r.decision, r.value) == best[r.stop_key][:2] and r.terminal_id in (None, best[r.stop_key][2])
    # Three visits of one stop take its terminals from the best on, those of one score by number.
    again = linkage.match_trip_stops(spark.createDataFrame([(1, i, 7) for i in range(4)], "trip_id long, seq int, stop_key long"), scored)
    order = [c for _, c in sorted((-x[3][0], x[1]) for x in rows if x[0] == 7)]
    assert [r.terminal_id for r in again.orderBy("seq").collect()][:3] == order[:3]


def test_second_run_changes_nothing(spark):
    now = F.to_timestamp(F.lit("2030-01-01"))
    old = datetime.datetime(2020, 1, 1)
    staging = spark.createDataFrame([("a", "awaiting_times", old), ("b", "done", old)], "trip_id string, state string, observed_at timestamp")
    first = canon.expire_staging(staging, 30, now)
    assert {r.trip_id: r.state for r in first.collect()} == {"a": "expired", "b": "done"}
    assert first.exceptAll(canon.expire_staging(first, 30, now)).isEmpty()
    with pytest.raises(ValueError):
        canon.expire_staging(staging, 0, now)


def test_merge_revives(spark):
    target = spark.createDataFrame([("a", "x", "2024"), ("b", "y", None)], "k string, v string, valid_to string")
    new = spark.createDataFrame([("a", None), ("c", "z")], "k string, v string")
    got = {r.k: (r.v, r.valid_to) for r in tables.merge_by_key(target, new, ["k"]).collect()}
    assert got == {"a": ("x", None), "b": ("y", None), "c": ("z", None)}


def test_diff_and_closure(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "k int, v string, observed_at int")
    b = spark.createDataFrame([(1, "x", 2), (3, "z", 1)], "k int, v string, observed_at int")
    assert {r.k: r.change for r in tables.diff_projections(a, b, ["k"]).collect()} == {2: "removed", 3: "added"}
    places = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (6, 5)], "place_id long, parent_id long")
    assert summaries.closure_table(places).count() == 21
    assert summaries.closure_diff(places, summaries.closure_table(places)).count() == 0


def test_balance_fails_loudly(spark):
    df = spark.createDataFrame([(3, 1, 1)], "n int, a int, b int")
    with pytest.raises(Exception, match="add up"):
        summaries.row_balance(df, "n", ["a", "b"]).collect()


def test_radius_join_at_cell_borders(spark):
    pts = [(i, 55 + i * 0.004, 83.0) for i in range(10)]
    df = spark.createDataFrame(pts, "stop_id long, lat double, lon double")
    got = {(r.stop_id, r.other_id) for r in spatial.radius_join(df, 1.0).collect()}
    assert got == {(i, j) for i in range(10) for j in range(i + 1, 10) if (j - i) * 0.004 * 111.19 <= 1.0}
