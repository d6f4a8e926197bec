"""Readers and writers on small files, and a feed round trip."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from railweave.sources import readers, writers


def put(path, value):
    path.write_text(json.dumps(value, ensure_ascii=False) if not isinstance(value, str) else value, encoding="utf-8")
    return str(path)


def test_feed(spark, tmp_path):
    d = tmp_path / "feed"
    d.mkdir()
    put(d / "stops.txt", "stop_id, stop_name ,stop_lat,stop_lon\ns1,One,55,83\n,Nameless,1,1\ns2,Two,x,83\n")
    put(d / "calendar.txt", "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\n7,1,0,0,0,0,0,1,20240101,20241231\nwk,1,1,1,1,1,0,0,20240101,20241231\n")
    put(d / "routes.txt", "route_id,route_short_name,route_long_name,route_type\nr1,10,,0\nr2,,Long,4\n")
    put(d / "trips.txt", "route_id,service_id,trip_id,direction_id\nr1,7,t1,1\nr1,wk,t2,0\nrX,7,t3,0\n")
    put(d / "stop_times.txt", "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt1,,25:10:00,s1,1\nt1,25:20:00,,s2,2\nt1,25:30:00,25:30:00,sX,3\nt2,01:00:00,01:00:00,s1,1\n")
    canon = readers.import_feed(readers.read_feed(spark, str(d)))
    assert [(r.trip_id, r.service_id, r.direction, r.service_days) for r in canon["trips"].collect()] == [("t1", 10**10 + 7, "backward", "0,1")]
    assert sorted((r.seq, r.arrival_s, r.departure_s) for r in canon["stop_times"].collect()) == [(1, 90600, 90600), (2, 91200, 91200)]
    assert {r.route_id: (r.name, r["mode"]) for r in canon["routes"].collect()} == {"r1": ("10", "tram"), "r2": ("Long", "flight")}
    assert {r.stop_id: (r.stop_code, r.lat) for r in canon["stops"].collect()} == {"s1": ("s1", 55.0), "s2": ("s2", None)}


def test_feed_without_stops_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_feed(spark, str(tmp_path))


def test_stations(spark, tmp_path):
    path = put(tmp_path / "s.json", [{"id": 1, "kind": "node", "name": "A", "tags": {"railway": "halt"}, "lat": 0.0, "lon": 0.0}, {"id": 2, "kind": "way", "name": "B", "tags": {}, "lat": 55.0, "lon": 83.0}, {"id": 3, "name": " ", "lat": 1.0, "lon": 1.0}])
    got = {r.record_id: (r.lat, r.transport, r.codes[0].code) for r in readers.read_stations(spark, path).collect()}
    assert got == {1: (None, "rail", "1"), 2: (55.0, "bus", "way/2")}


def test_station_tree(spark, tmp_path):
    s = lambda t, la, kind, codes: {"title": t, "latitude": la, "longitude": "83.1", "transport_type": kind, "station_type": "x", "codes": codes}
    tree = {"countries": [{"title": "C", "regions": [{"title": "R", "settlements": [{"title": "S", "stations": [s("a", 55.5, "train", {"yandex_code": "y1", "esr_code": "e1"}), s("b", "", "bus", {})]}]}]}]}
    got = {r.name: (r.lat, r.lon, r.transport, [c.code for c in r.codes]) for r in readers.read_station_tree(spark, put(tmp_path / "t.json", tree)).collect()}
    assert got == {"a": (55.5, 83.1, "rail", ["y1", "e1"]), "b": (None, 83.1, "bus", [])}


def test_map_elements_and_relations(spark, tmp_path):
    path = put(tmp_path / "m.json", {"elements": [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"name": "n"}}, {"type": "way", "id": 2, "center": {"lat": 3.0, "lon": 4.0}, "tags": {"name": "w"}}, {"type": "node", "id": 3, "tags": {"name": "nowhere"}}, {"type": "relation", "id": 4, "tags": {"ref": "10", "name": "R", "route": "bus"}, "members": [{"type": "node", "ref": 1, "role": ""}, {"type": "relation", "ref": 9, "role": "x"}, {"type": "way", "ref": 2, "role": "platform"}]}]})
    assert {r.code: r.lat for r in readers.read_map_elements(spark, path).collect()} == {"1": 1.0, "way/2": 3.0}
    (r,) = readers.read_route_relations(spark, path).collect()
    assert (r.ref, r.stop_count, [(s.code, s.role) for s in r.stops]) == ("10", 2, [("1", "stop"), ("way/2", "platform")])


def test_tagged_objects(spark):
    objects = spark.createDataFrame([(1, "node", {"highway": "bus_stop", "junk": "x"}, 1.0, 2.0, []), (2, "way", {"amenity": "bus_station"}, None, None, [10, 11, 12]), (3, "node", {"shop": "x"}, 1.0, 1.0, [])], "id long, kind string, tags map<string,string>, lat double, lon double, node_ids array<long>")
    nodes = spark.createDataFrame([(10, 2.0, 4.0), (11, 4.0, 6.0)], "node_id long, lat double, lon double")
    got = {r.id: (dict(r.tags), r.lat, r.lon) for r in readers.filter_tagged_objects(objects, nodes).collect()}
    assert got == {1: ({"highway": "bus_stop"}, 1.0, 2.0), 2: ({"amenity": "bus_station"}, 3.0, 5.0)}


def test_threads(spark):
    rows = [("u1", "10", "A - B", "u1", "bus", "2024-01-01", [("c1", "A", None, "10:00:00"), ("c2", "B", "10:30:00", None)]), ("u1", "10", "A - B", "u1", "bus", "2024-01-02", [("c1", "A", None, "10:00:00")])]
    threads = spark.createDataFrame(rows, "thread_id string, number string, title string, uid string, transport_type string, date string, stops array<struct<code:string,title:string,arrival:string,departure:string>>")
    out = readers.threads_to_feed(threads, spark.createDataFrame([("c1",)], "code string"))
    assert [(r.route_id, r.trip_id) for r in out["trips"].collect()] == [("10", "u1")]
    assert sorted((r.seq, r.arrival_s) for r in out["stop_times"].collect()) == [(0, 36000), (1, 37800)]
    assert out["service_exceptions"].count() == 2
    assert [r.stop_id for r in out["extra_stops"].collect()] == ["c2"]


def test_registry_of_sheets(spark):
    side = "reg string, seq int, name string, region string, op_reg string, dep string, arr string, days string, period string"
    fwd = spark.createDataFrame([("54.1", 0, "Томск", "54", "op1", "10:00", "", "пн-ср", ""), ("54.1", 1, "Омск", "55", None, "", "11:00", "пт", ""), ("77.2", 0, "Х", "77", "z", "1:00", "", "", "")], side)
    back = spark.createDataFrame([("54.1", 0, "Омск", "55", None, "12:00", "", "сб", "")], side)
    routes = spark.createDataFrame([("54.1",), ("77.2",)], "reg string")
    firms = spark.createDataFrame([("F", "1", 0), ("G", "1", 1)], "name string, inn string, ordinal int")
    out = readers.build_registry(routes, firms, fwd, back, ["54"])
    assert [r.reg for r in out["routes"].collect()] == ["54.1"]
    assert {r.name: r.stop_id for r in out["stops"].collect()}["Томск"] == "op1" and out["stops"].count() == 2
    assert [r.name for r in out["carriers"].collect()] == ["F"]
    assert out["services"].count() == 2 and out["schedules"].count() == 2
    assert sorted(r.weekday for r in out["service_days"].collect()) == [1, 2, 3, 6]


def test_seed_and_guard(spark, tmp_path):
    path = put(tmp_path / "p.json", [{"name": "  Big  Town ", "aliases": [], "lat": 55.12345, "lon": 83.0}])
    (r,) = readers.read_seed_places(spark, path).collect()
    assert (r.query, r.origin, r.cache_key) == ("big town", "seed", "55.1235,83.0000") or r.cache_key == "55.1234,83.0000"
    none = spark.createDataFrame([], "provider string, sha256 string, imported_at timestamp")
    first = readers.skip_unchanged(spark, path, "x", none)
    assert first.count() == 1
    done = first.withColumn("imported_at", F.current_timestamp())
    assert readers.skip_unchanged(spark, path, "x", done).count() == 0


def test_logs_and_reviews(spark, tmp_path):
    day = lambda d: datetime.datetime(2024, 1, d)
    schema = "chunk_key string, state string, at timestamp, rows int"
    writers.write_ops_log(spark.createDataFrame([("k", "done", day(1), 1), ("k", "done", day(2), 2), ("j", "open", day(1), 3)], schema), str(tmp_path / "log"))
    assert [(r.chunk_key, r.rows) for r in writers.read_ops_log(spark, str(tmp_path / "log"), schema).collect()] == [("k", 2)]
    writers.write_review_csv(spark.createDataFrame([("t", 1, "gap", 0.5, day(1))], "entity_type string, entity_id long, reason string, score double, observed_at timestamp"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["entity_type", "entity_id", "reason", "score", "observed_at"]


def test_feed_written_is_read_back(spark, tmp_path):
    make = spark.createDataFrame
    day = datetime.date(2024, 1, 1)
    net = {
        "carriers": make([(1, "firm")], "carrier_id long, name string"), "zones": make([("s1", "z")], "stop_id string, zone_id string"), "stops": make([("s1", "One", 55.0, 83.0), ("s2", "Two", 56.0, 83.0)], "stop_id string, name string, lat double, lon double"),
        "routes": make([("r", 1, "10", "bus")], "route_id string, carrier_id long, name string, mode string"), "trips": make([("t", "r", 0, "backward")], "trip_id string, route_id string, service_id long, direction string"),
        "stop_times": make([("t", 2, "s2", 90000, 90060), ("t", 10, "s1", 91000, 91000)], "trip_id string, seq int, stop_id string, arrival_s int, departure_s int"), "services": make([(1, [0, 1], day, day)], "service_id long, weekdays array<int>, start_date date, end_date date"),
        "service_exceptions": make([(1, day, "removed")], "service_id long, date date, exception_type string"), "transfers": make([("s1", "s2", 3)], "from_stop string, to_stop string, minutes int"), "fares": make([("f", 1.0, "RUB")], "fare_id string, price double, currency string"), "fare_rules": make([("f",)], "fare_id string"),
    }
    writers.write_feed(net, str(tmp_path / "out"))
    times = spark.read.csv(str(tmp_path / "out/stop_times"), header=True).collect()
    assert [(r.arrival_time, r.stop_sequence) for r in times] == [("25:00:00", "2"), ("25:16:40", "10")]
    trip = spark.read.csv(str(tmp_path / "out/trips"), header=True).first()
    assert (trip.service_id, trip.direction_id) == ("1", "1")
    assert spark.read.csv(str(tmp_path / "out/transfers"), header=True).first().min_transfer_time == "180"
