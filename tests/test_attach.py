"""Attachment: pairs are told apart and scored where they meet, and aren't shuffled."""

import random

from pyspark.sql import functions as F

from railweave.operators import linkage

CODES = linkage.NO_CODES


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_candidates_of_keys_with_several_rows_come_once_without_a_shuffle_of_pairs(spark):
    rng = random.Random(2)
    code = lambda: [("s", "t", str(rng.randrange(9)))] if rng.random() < 0.3 else []
    side = lambda n, keys: [(rng.randrange(keys), "n", *((None, None) if rng.random() < 0.05 else (rng.uniform(50, 53), rng.uniform(80, 83))), code()) for _ in range(n)]
    stops, terms = side(60, 45), side(50, 40)
    got = linkage.attach_candidates(spark.createDataFrame(stops, f"stop_key long, name string, lat double, lon double, codes {CODES}"), spark.createDataFrame(terms, f"terminal_id long, name string, lat double, lon double, codes {CODES}"))
    cell = lambda r: (r[2] // 0.5, r[3] // 0.5)
    near = lambda a, b: a[2] is not None and b[2] is not None and all(abs(p - q) <= 1 for p, q in zip(cell(a), cell(b), strict=True))
    want = {(a[0], b[0]) for a in stops for b in terms if b[2] is None or near(a, b) or {c[2] for c in a[4]} & {c[2] for c in b[4]}}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    # No branch of the union is an aggregate of pairs.
    assert not any(line.startswith((":- Aggregate", "+- Aggregate")) for line in _plan(got).splitlines())


def test_best_match_needs_one_aggregate_of_the_pairs(spark):
    kind = "struct<value:double,trust:double,code:boolean,has_geom:boolean,metres:double,name_sim:double,guard:boolean>"
    rng = random.Random(9)
    rows = [(k, c, "urban", (rng.choice([None, 0.5, 0.62, 0.65, 0.9]), 1.0, False, True, 10.0, 1.0, True)) for k in range(60) for c in range(k % 5 + 1)]
    got = linkage.match_best(spark.createDataFrame(rows, f"stop_key long, cand_no long, density string, s {kind}"), "stop_key")
    assert "Join" not in _plan(got)
    for r in got.collect():
        mine = sorted((x for x in rows if x[0] == r.stop_key), key=lambda x: (-(x[3][0] if x[3][0] is not None else -1), x[1]))
        best, rest = mine[0], [x[3][0] for x in mine[1:] if x[3][0] is not None]
        assert r.cand_no == best[1] and r.n == len(mine)
        if best[3][0] is not None:
            vague = bool(rest) and best[3][0] >= 0.5 and best[3][0] - min(rest) < 0.05
            assert r.decision == ("duplicate_ambiguous" if vague else "verified" if best[3][0] >= 0.6 else "low_confidence")


def test_stem_of_an_adjective_tells_what_the_full_comparison_tells(spark):
    from railweave.functions import names

    lot = ["томск", "томский", "томская", "омское", "омск", "белый", "бел", "", "новая", "новгородский", "новгород", "липецкий", "липе", "липецк", None]
    df = spark.createDataFrame([(x, y) for x in lot for y in lot], "x string, y string")
    x, y = F.col("x"), F.col("y")
    assert df.where(names.same_core(x, y) != names.same_core_by_stem(x, names.core_stem(x), y, names.core_stem(y))).count() == 0


def test_fold_along_trips_equals_a_loop(spark):
    kind = "struct<value:double,trust:double,code:boolean,has_geom:boolean,metres:double,name_sim:double,guard:boolean>"
    rng = random.Random(12)
    rows = [(k, c, "rural" if k % 2 else "urban", (rng.choice([0.4, 0.52, 0.6, 0.64, 0.7, 0.9]), 1.0, rng.random() < 0.1, rng.random() < 0.7, 10.0, 1.0, rng.random() < 0.9)) for k in range(12) for c in sorted(rng.sample(range(20), rng.randrange(0, 14)))]
    trips = [(t, i, rng.randrange(12)) for t in range(120) for i in range(rng.randrange(1, 7))]
    want = {}
    for t in range(120):
        mine = sorted(x for x in trips if x[0] == t)
        used, first = [], None
        for i, (_, seq, k) in enumerate(mine):
            last = i == len(mine) - 1 and i > 1
            free = [x for x in rows if x[0] == k and (x[1] not in used or (last and x[1] == first))]
            if not free:
                want[t, seq] = (None, "rejected", None)
                continue
            best = min(free, key=lambda x: (-x[3][0], x[1]))
            value, _, code, geom, _, _, guard = best[3]
            other = min((x[3][0] for x in free if x is not best), default=None)
            gap = None if other is None else value - other
            if gap is not None and value >= 0.5 and gap < 0.05:
                kind_of = "duplicate_ambiguous"
            elif value >= 0.6 and guard and (code or geom or best[2] == "urban" or gap is None or gap >= 0.05):
                kind_of = "verified"
            else:
                kind_of = "low_confidence" if value >= 0.5 else "rejected"
            want[t, seq] = (best[1] if kind_of == "verified" else None, kind_of, value)
            if kind_of == "verified":
                used.append(best[1])
                first = best[1] if first is None else first
    got = linkage.match_trip_stops(spark.createDataFrame(trips, "trip_id long, seq int, stop_key long"), spark.createDataFrame(rows, f"stop_key long, cand_no long, density string, s {kind}"))
    # Each list is filtered once a stop; the expression used to be repeated wherever it was named.
    assert _plan(got).count("filter(coalesce(") <= 4
    assert {(r.trip_id, r.seq): (r.terminal_id, r.decision, r.value) for r in got.collect()} == want


def _attached(spark, seed, size=60):
    rng = random.Random(seed)
    words = ["Томск", "Томск1", "Омск", "Бийск", "Бийск Южный", "Рынок", "Порт", "", None]
    code = lambda: [(rng.choice(["s", "u", None]), rng.choice(["t", "v"]), str(rng.randrange(6)))] if rng.random() < 0.15 else []
    lat, lon = [55.0, 55.001, 55.004, 55.01, 55.3, 56.0, 89.9, 0.0], [83.0, 83.002, 83.02, 83.4, 179.999, -179.999, 0.0]
    point = lambda: (None, None) if rng.random() < 0.1 else (rng.choice(lat[:6]), rng.choice(lon[:4])) if rng.random() < 0.9 else (rng.choice(lat), rng.choice(lon))
    row = lambda i, *more: (i if rng.random() < 0.9 else rng.randrange(size), rng.choice(words), *point(), rng.choice(["", "Томск", "Омск", None]), rng.choice(["", "bus", "rail"]), rng.choice(["osm", "seed", "yandex"]), code(), *more)
    schema = "name string, lat double, lon double, settlement string, transport string, source string, codes " + CODES
    return spark.createDataFrame([row(i, rng.choice(["urban", "rural"])) for i in range(size)], f"stop_key long, {schema}, density string"), spark.createDataFrame([row(i) for i in range(size * 2)], f"terminal_id long, {schema}")


def test_few_candidates_tell_what_all_of_them_tell(spark):
    seed = 3
    stops, terms = _attached(spark, seed)
    every = linkage.scored_attach(stops, terms)
    pick = ["stop_key", "cand_no", "n", "decision", "s.value", "s.code"]
    want = sorted(map(tuple, linkage.match_best(every, "stop_key").select(*pick).collect()), key=str)
    got = sorted(map(tuple, linkage.best_attach(stops, terms).select(*pick).collect()), key=str)
    assert [r[:1] + r[2:] for r in got] == [r[:1] + r[2:] for r in want] and len(want) > 40
    # Keys of several rows may give a candidate several best rows.
    assert got == want
    rng = random.Random(seed)
    trips = spark.createDataFrame([(t, i, rng.randrange(60)) for t in range(80) for i in range(rng.randrange(1, 5))], "trip_id long, seq int, stop_key long")
    few = linkage.few_attach(stops, terms, linkage.longest_trip(trips) + 1)
    fold = lambda scored: sorted(map(tuple, linkage.match_trip_stops(trips, scored).collect()), key=str)
    assert fold(few) == fold(every)


def test_stops_with_a_sure_best_have_few_candidates_scored(spark):
    schema = "name string, lat double, lon double, settlement string, transport string, source string, codes " + CODES
    rows = [(i, f"Stop {i % 40}", 55.0 + (i % 40) * 0.03, 83.0, "Томск", "bus", "osm", []) for i in range(400)]
    stops = spark.createDataFrame(rows, f"stop_key long, {schema}").withColumn("density", F.lit("urban")).withColumn("source", F.lit("mintrans"))
    terms = spark.createDataFrame(rows, f"terminal_id long, {schema}")
    few, every = linkage.few_attach(stops, terms, 3), linkage.scored_attach(stops, terms)
    assert few.count() * 4 < every.count()
    pick = ["stop_key", "cand_no", "n", "decision"]
    assert sorted(linkage.best_attach(stops, terms).select(*pick).collect()) == sorted(linkage.match_best(every, "stop_key").select(*pick).collect())
