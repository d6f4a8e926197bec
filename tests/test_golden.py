"""Expected outcomes on a slice of a register and on hand-made pairs (fixed values)."""

import pytest
from pyspark.sql import functions as F

from railweave.functions import names
from railweave.operators import linkage, summaries, timetables
from tests.register import SCHEDULES, STOPS

CODES = linkage.NO_CODES
BLOCK = "struct<days:string,dep:array<string>,dwell:array<string>,arr:array<string>,period:string>"
CELL = f"struct<stop:string,region:string,winter:{BLOCK},summer:{BLOCK}>"


@pytest.fixture(scope="module")
def register(spark):
    block = lambda days, dep, arr: (days, dep, [], arr, "")
    rows = [(r, d, 3, [(STOPS[i][0], STOPS[i][2], block(*w), block(*s)) for i, *x in cells for w, s in [(x[:3], x[3:])]]) for r, d, cells in SCHEDULES]
    return {
        "stops": spark.createDataFrame([(i, n, r, "", la, lo) for i, n, r, la, lo in STOPS], "id string, name string, region string, op_reg string, lat double, lon double"),
        "routes": spark.createDataFrame([(r, "1") for r in sorted({s[0] for s in SCHEDULES})], "reg string, carrier_inn string"),
        "schedules": spark.createDataFrame(rows, f"route string, direction string, service_id long, stops array<{CELL}>"),
    }


@pytest.fixture(scope="module")
def terminals(spark):
    rows = [(k, n, la, lo, "bus", "osm", [], True) for k, (_, n, _, la, lo) in enumerate(STOPS)]
    df = spark.createDataFrame(rows, f"terminal_id long, name string, lat double, lon double, transport string, source string, codes {CODES}, final boolean")
    return df.withColumn("settlement", names.extract_settlement(F.col("name")))


def test_attach_of_the_register_slice(spark, register, terminals):
    trips, stops = timetables.registry_trips(register)
    out = timetables.attach_trips(trips, stops, terminals, spark.createDataFrame([], "trip_id string"))
    rows = out["outcomes"].collect()
    assert sorted((r.outcome, r.state) for r in rows) == [("dead", "overspeed")] * 2 + [("promoted", "promoted")] * 4 + [("staged", "incomplete_trip")] * 2
    # A second run onto the result closes nothing.
    again = timetables.attach_trips(trips, stops, terminals, out["outcomes"].where("outcome = 'promoted'").select(F.col("trip_nk").alias("trip_id")))
    assert again["tombstones"].count() == 0


def test_sync_of_the_register_slice(spark, register, terminals):
    out = timetables.run_trips_sync(register, terminals, spark.createDataFrame([], "trip_id string"))
    total = out["by_route"].agg(*(F.sum(c).alias(c) for c in ("promoted", "staged", "dead"))).first()
    assert (total.promoted, total.staged, total.dead) == (4, 2, 2)
    assert {r.ratio for r in out["coverage"].collect()} == {1.0}


def matched(register, held):
    """The best terminal of each stop of the register, if any."""
    asked = register["stops"].select(F.xxhash64("id").alias("stop_key"), "name", "lat", "lon", names.extract_settlement(F.col("name")).alias("settlement"), F.lit("").alias("transport"), F.lit("mintrans").alias("source"), F.lit("urban").alias("density"), F.array().cast(CODES).alias("codes"))
    scored = linkage.scored_attach(asked, held, linkage.attach_candidates(asked, held))
    return linkage.match_best(scored, "stop_key")


def test_calibration_recommends_seven_tenths(register, terminals):
    best = lambda held: matched(register, held).select(F.col("s.value").alias("score"), F.col("s.guard").alias("guard"))
    shifted = terminals.withColumn("lat", F.col("lat") + 0.005).withColumn("lon", F.col("lon") + 0.005)
    report = summaries.calibrate(best(terminals), best(shifted), [0.3, 0.4, 0.5, 0.6, 0.7, 0.8], 0.005)
    assert summaries.recommend_threshold(report, 0.8).first().threshold == 0.7
    clean = {r.threshold: (r.verified, r.total) for r in report.where("set = 'clean'").collect()}
    assert clean[0.6] == (16, 16)


@pytest.mark.parametrize("kind", ["clean", "shifted", "empty"])
def test_gate_methods(register, terminals, kind):
    held = {"clean": terminals, "shifted": terminals.withColumn("lat", F.col("lat") + 0.005).withColumn("lon", F.col("lon") + 0.005), "empty": terminals.where("false")}[kind]
    best = matched(register, held).select("stop_key", F.col("s.value").alias("score"), "decision")
    rows = register["stops"].select(F.xxhash64("id").alias("stop_key"), "region").join(best, "stop_key", "left")
    rates = [(r.soft_rate, r.verified_rate) for r in summaries.compare_gates(rows, 0.4).collect()]
    assert rates and all(verified <= soft for soft, verified in rates)
    if kind == "clean":
        assert set(rates) == {(1.0, 1.0)}
    if kind == "empty":
        assert set(rates) == {(0.0, 0.0)}


KEMEROVO = {"name": "Кемерово автовокзал", "settlement": "кемерово"}
AT = {"lat": 55.3416, "lon": 86.061}
NEAR = KEMEROVO | {"lat": 55.3417, "lon": 86.0612, "source": "osm", "transport": "bus"}
FAR = {"name": "Новосибирск автовокзал", "lat": 55.0301, "lon": 82.8986, "source": "osm", "settlement": "новосибирск", "transport": "bus"}
CODE = [("yandex", "yandex_code", "c999")]
ASKED = KEMEROVO | {"source": "mintrans"}
PAIRS = [
    ("alike", "urban", ASKED | AT, [NEAR], "verified", 0),
    ("alike beside another", "urban", ASKED | AT, [NEAR, FAR], "verified", 0),
    ("one code", "urban", {"name": "ОП ЛПК", "source": "mintrans", "codes": CODE}, [{"name": "Заречная", "lat": 55.0, "lon": 83.0, "source": "yandex", "settlement": "заречная", "codes": CODE}], "verified", 0),
    ("far and different", "urban", ASKED | AT, [FAR], "rejected", 0),
    ("urban without a point", "urban", ASKED, [NEAR | AT], "low_confidence", 0),
    ("rural without a point", "rural", ASKED, [NEAR | AT], "verified", 0),
    ("twins", "urban", ASKED | AT, [NEAR, NEAR | {"source": "yandex"}], "duplicate_ambiguous", 0),
    ("one voice", "rural", ASKED, [ASKED], "low_confidence", 0),
    ("generic names far apart", "urban", {"name": "Автовокзал", "source": "mintrans"} | AT, [{"name": "Автовокзал", "lat": 55.0301, "lon": 82.8986, "source": "osm"}], "low_confidence", 0),
]


def test_golden_pairs(spark):
    side = lambda x: (x["name"], x.get("lat"), x.get("lon"), x["source"], x.get("settlement", ""), x.get("transport", ""), x.get("codes", []))
    pair = f"struct<name:string,lat:double,lon:double,source:string,settlement:string,transport:string,codes:{CODES}>"
    cases = spark.createDataFrame([(i, c, side(s), [side(t) for t in ts], e, b) for i, c, s, ts, e, b in PAIRS], f"id string, class string, stop {pair}, terminals array<{pair}>, expect string, expect_best int")
    got = {r.id: (r.decision, r.best) for r in timetables.golden_check(cases).collect()}
    assert got == {i: (e, b) for i, _, _, _, e, b in PAIRS}
