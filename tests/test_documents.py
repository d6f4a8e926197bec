"""Documents split into elements by many tasks, against json.loads."""

import json
import random

import pytest
from pyspark.sql import functions as F

from railweave.operators.graph import drop
from railweave.sources import documents, readers


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def found(table, name):
    rows = table.where(F.col("name") == name).orderBy("position").collect()
    return [json.loads(r.value) for r in rows]


def some(rng, deep=0):
    """A random value whose strings hold braces, quotes and backslashes."""
    kind = rng.randrange(6 if deep < 3 else 3)
    if kind == 0:
        return rng.choice([None, True, 3, -1.5e3])
    if kind in (1, 2):
        return "".join(rng.choice(['}', '{', '[', ']', '"', "\\", ":", ",", "a", "ж", "\n", "𝄞"]) for _ in range(rng.randrange(12)))
    if kind == 3:
        return [some(rng, deep + 1) for _ in range(rng.randrange(4))]
    return {f"k{i}}}": some(rng, deep + 1) for i in range(rng.randrange(4))}


def entry(rng, i):
    return {"id": i, "rows": [{"a": some(rng)} for _ in range(rng.randrange(3))], "x": some(rng)}


@pytest.mark.parametrize("indent", [None, 2])
def test_random_documents_equal_a_parser(small_blocks, tmp_path, indent):
    rng = random.Random(7)
    docs = {}
    for k in range(4):
        docs[f"d{k}.json"] = doc = {"meta": {"source": "s{", "deep": {"a": {"b": {}}}, "other": {"rows": [{"z": 1}]}}, "rows": [entry(rng, i) for i in range(60)], "none": [], "nested": [[{"a": 1}], [2]], "count": 5, "stops": [1, "x"] + [entry(rng, i) for i in range(40)], 'odd "name" [': [{"a": "]}"}, {}]}
        (tmp_path / f"d{k}.json").write_text(json.dumps(doc, ensure_ascii=k % 2 == 0, indent=indent), encoding="utf-8")
    table = documents.elements(small_blocks, str(tmp_path))
    for name, doc in docs.items():
        mine = table.where(F.col("file").endswith(name))
        assert found(mine, "rows") == doc["rows"]
        assert found(mine, "stops") == [x for x in doc["stops"] if isinstance(x, dict)]
        assert found(mine, 'odd "name" [') == [{"a": "]}"}, {}]
    assert {r.name for r in table.select("name").distinct().collect()} == {"rows", "stops", 'odd "name" [', None}
    frames = [json.loads(r.value.replace('[1, "x", ]', "[]")) if indent is None else None for r in documents.frame(table).collect()]
    if indent is None:
        assert all(f["meta"] == docs["d0.json"]["meta"] and f["rows"] == [] and f["count"] == 5 for f in frames) and len(frames) == 4
    drop(table)


def test_many_tasks_read_one_document(small_blocks, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps([{"id": i, "s": "}{" * (i % 50)} for i in range(500)]))
    raw = small_blocks.read.option("lineSep", "}").text(str(path))
    assert raw.rdd.getNumPartitions() > 10
    table = documents.elements(small_blocks, str(path), keyed=False)
    assert found(table, "") == json.loads(path.read_text())
    assert [r.position for r in table.where("name = ''").orderBy("position").collect()] == list(range(500))
    drop(table)


@pytest.mark.parametrize("text", ["", "[]", "{}", '{"elements": []}', '{"elements": {"a": {"b": 1}}}', " \n", '{"elements": [[{"a": 1}]]}', '{"elements": null}'])
def test_documents_without_elements(spark, tmp_path, text):
    (tmp_path / "e.json").write_text(text)
    table = documents.elements(spark, str(tmp_path))
    assert table.where("name IS NOT NULL").count() == 0
    drop(table)


def test_readers_give_the_same_rows_from_split_documents(small_blocks, tmp_path):
    rng, spark = random.Random(3), small_blocks
    tags = lambda i: {"name": f'n"{i}}}', "ref": str(i), "route": "bus"}
    shapes = [{"type": rng.choice(["node", "way", "relation"]), "id": i, "lat": i / 7, "lon": i / 9, "tags": tags(i), "members": [{"type": "node", "ref": 1, "role": ""}]} for i in range(200)]
    (tmp_path / "m.json").write_text(json.dumps({"version": 0.6, "osm3s": {"at": "}"}, "elements": shapes}, indent=1))
    (tmp_path / "s.json").write_text(json.dumps([{"id": i, "kind": "node", "name": f"s{{{i}", "tags": {"railway": "halt"}, "lat": 1.5, "lon": 2.5} for i in range(200)]))
    (tmp_path / "p.json").write_text(json.dumps([{"name": f"p{i}", "aliases": ["}"], "lat": 1.5, "lon": 2.5} for i in range(100)]))
    registry = {"meta": {"source": "reg", "snapshot": "2024"}, "routes": [{"reg": str(i), "name": "}"} for i in range(50)], "stops": [], "carriers": [{"name": "c", "inn": "1"}], "services": [], "service_days": [{"service_id": 1, "weekday": 2}], "service_exceptions": [], "schedules": [{"route": str(i), "direction": "forward", "service_id": i, "stops": [{"stop": "s", "winter": {"dep": ["10:00"]}}]} for i in range(50)]}
    (tmp_path / "r.json").write_text(json.dumps(registry))
    for read, name in ((readers.read_map_elements, "m"), (readers.read_route_relations, "m"), (readers.read_stations, "s"), (readers.read_seed_places, "p")):
        whole, split = (sorted(map(str, read(spark, str(tmp_path / f"{name}.json"), split=how).collect())) for how in (False, True))
        assert whole == split and whole
    whole, split = (readers.read_registry(spark, str(tmp_path / "r.json"), split=how) for how in (False, True))
    assert whole.keys() == split.keys()
    for name in whole:
        assert sorted(map(str, whole[name].collect())) == sorted(map(str, split[name].collect())), name
