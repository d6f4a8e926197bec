"""All-pairs rules: rows meet in tiles, whatever the keys' frequencies."""

import random

from pyspark.sql import functions as F

from railweave.operators import linkage, spatial


def test_tiles_hold_every_pair_of_a_key_once_and_share_it_out(spark):
    left = spark.range(300).select(F.col("id").alias("l"), F.when(F.col("id") < 280, "big").otherwise("small").alias("k"))
    right = spark.range(90).select(F.col("id").alias("r"), F.when(F.col("id") < 80, "big").when(F.col("id") < 88, "small").alias("k"))
    got = linkage.tiles(left, right, ("k",), (32, 16)).select("l", "r", "a.k", F.spark_partition_id().alias("task"))
    rows = got.collect()
    assert {(r.l, r.r) for r in rows} == {(i, j) for i in range(280) for j in range(80)} | {(i, j) for i in range(280, 300) for j in range(80, 88)}
    assert len(rows) == 280 * 80 + 20 * 8
    shares = [sum(r.task == t for r in rows if r.k == "big") for t in {r.task for r in rows}]
    assert len(shares) >= 16 and max(shares) < 280 * 80 / 4
    assert linkage.tiles(left.limit(0), right).count() == 0 and linkage.tiles(left, right).count() == 300 * 90

def test_stops_take_the_point_of_the_best_name_in_their_settlement(spark):
    rng = random.Random(4)
    words = ["Вокзал", "Автовокзал", "Аэропорт", "Речной вокзал", "Рынок", "Рынок Южный", "Томск Восточный", "Порт", ""]
    towns = ["Томск", "Томская", "Омск", "Омский", "", None]
    stops = spark.createDataFrame([(i, rng.choice(words + [None]), None, None, rng.choice(towns)) for i in range(60)], "stop_id long, name string, lat double, lon double, settlement string")
    terminals = spark.createDataFrame([(i, rng.choice(words + [None]), 50.0 + i, 80.0, rng.choice(towns)) for i in range(25)], "terminal_id long, name string, lat double, lon double, settlement string")
    from railweave.functions import names

    t = terminals.select("terminal_id", F.col("name").alias("tname"), F.coalesce("settlement", F.lit("")).alias("tplace"))
    fits = F.coalesce(names.same_settlement(F.col("settlement"), F.col("tplace")), F.lit(False))
    n, m = F.col("name"), F.col("tname")
    score = names.name_similarity(n, m) + F.when(names.stop_type_signal(names.infer_stop_type(n), m), 0.25).otherwise(0.0) - F.when(names.has_contrast_word(n, m), 0.25).otherwise(0.0)
    every = {}
    for r in stops.crossJoin(t).select("stop_id", "terminal_id", "tplace", fits.alias("own"), score.alias("score")).collect():
        every.setdefault(r.stop_id, []).append(r)
    want = {}
    for stop, rows in every.items():
        open_to = [r for r in rows if r.own] or [r for r in rows if r.tplace == ""]
        top = sorted(((-r.score, r.terminal_id) for r in open_to if r.score >= 0.6))
        want[stop] = top[0][1] if top and (len(top) < 2 or -top[0][0] + top[1][0] >= 0.15) else None
    got = spatial.resolve_stop_coords(stops, terminals)
    assert {r.stop_id: r.resolved_by for r in got.collect()} == want
    assert 5 < sum(x is not None for x in want.values()) < 60
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoop" not in plan and "CartesianProduct" not in plan


def sides(spark, seed):
    rng = random.Random(seed)
    words = ["Томск", "Томск1", "Омск", "Бийск", "Бийск Южный", "Рынок", "Ринок", "Порт", ""]
    code = lambda: [("esr", "id", str(rng.randrange(6)))] if rng.random() < 0.1 else []
    point = lambda: (None, None) if rng.random() < 0.3 else (rng.choice([55.0, 55.001, 55.01, 56.0, 89.9]), rng.choice([83.0, 83.002, 83.02, 179.999, -179.999]))
    row = lambda i: (i, i, rng.choice(words), *point(), rng.choice(["", "Томск", "Омск"]), rng.choice(["", "bus", "rail"]), "osm", code())
    schema = "{} long, ordinal long, name string, lat double, lon double, settlement string, transport string, source string, codes " + linkage.NO_CODES
    return spark.createDataFrame([row(i) for i in range(60)], schema.format("left_id")), spark.createDataFrame([row(i) for i in range(45)], schema.format("right_id"))


def ranked(rows):
    lists = {}
    for r in sorted((r for r in rows if r.score > 0), key=lambda r: (-r.score, r.right_no)):
        lists.setdefault(r.left_id, []).append(r)
    return lists


def test_full_join_by_bounds_is_that_of_the_whole_product(spark):
    cfg = linkage.LinkConfig()
    left, right = sides(spark, 11)
    lists = ranked(linkage.scored_links(left, right, left.select("left_id").crossJoin(right.select("right_id"))).collect())
    want = {i: (None, 0.0, 0.0) for i in range(60)}
    for i, rows in lists.items():
        best, second = rows[0], rows[1].score if len(rows) > 1 else 0.0
        sure = best.score >= cfg.threshold and (best.score - second >= cfg.margin or second == 0) and (best.code or (best.metres is not None and best.metres <= cfg.distance_m))
        vague = best.score >= cfg.threshold - cfg.margin and best.score - second < cfg.ambiguity
        want[i] = (best.right_id if sure or vague else None, best.score, second)
    got = {r.left_id: (r.right_id, r.score, r.second) for r in linkage.full_fuzzy_join(left, right).collect()}
    assert got == want and sum(x is not None for x, _, _ in want.values()) > 10


def test_legacy_rows_take_the_best_of_all_candidates(spark):
    left, right = sides(spark, 12)
    lists = ranked(linkage.scored_links(left, right, linkage.link_candidates(left, right)).collect())
    got = {r.left_id: (r.right_id, r.score) for r in linkage.legacy_match(left, right).collect()}
    assert got == {i: ((lists[i][0].right_id if lists[i][0].score >= 0.6 else None, lists[i][0].score) if i in lists else (None, 0.0)) for i in range(60)}
    a, b = linkage.prepared(left), linkage.prepared(right)
    few = linkage._top_pairs(a, b, linkage.LinkConfig(), pilot=8).collect()
    every = ranked(linkage.scored_links(left, right, left.select("left_id").crossJoin(right.select("right_id"))).collect())
    assert {i: [r.right_id for r in rows[:2]] for i, rows in ranked(few).items()} == {i: [r.right_id for r in rows[:2]] for i, rows in every.items()}
    assert len(few) < 60 * 45 / 2


def test_names_all_alike_give_the_pairs_of_the_similarity_join(spark):
    left, right = sides(spark, 13)
    cfg = linkage.LinkConfig()
    a, b = linkage.prepared(left), linkage.prepared(right)
    pair = lambda df: sorted((r.left_id, r.right_id) for r in df.collect())
    for floor in (0.45, 0.8):
        tiled, counted = linkage._alike(a, b, floor, cfg), linkage._alike(a, b, floor, cfg, dense=0)
        every = linkage._rated(a.alias("a").crossJoin(b.alias("b")), cfg).where(F.col("score") >= floor)
        want = pair(every.where("NOT code"))
        assert [x for x in pair(tiled) if x in set(want)] == want and len(want) > 100
        assert set(pair(counted)) >= {(r.left_id, r.right_id) for r in every.where("metres IS NULL AND NOT code").collect()}
    assert linkage._meetings(left.select("name"), right.select("name"), "name") == left.select("name").join(right.select("name"), "name").count()


def test_nearest_stops_pairs_only_the_first_of_a_place(spark, monkeypatch):
    rows = [(i, 55.0 + (i % 3) * 0.01, 83.0) for i in range(150)]
    stops = spark.createDataFrame(rows, "stop_id long, lat double, lon double")
    points = spark.createDataFrame([(1, 55.004, 83.0), (2, 55.02, 83.0), (3, 57.0, 83.0)], "point_id long, lat double, lon double")
    made, real = [], spatial.near_join

    def counted(*args):
        made.append(real(*args))
        return made[-1]

    monkeypatch.setattr(spatial, "near_join", counted)
    got = {(r.point_id, r.rank): r.stop_id for r in spatial.nearest_stops(points, stops, 60.0, 4).collect()}
    assert got == {(1, 1): 0, (1, 2): 3, (1, 3): 6, (1, 4): 9, (2, 1): 2, (2, 2): 5, (2, 3): 8, (2, 4): 11}
    assert made[0].count() <= 2 * 3 * 4


def test_names_of_a_settlement_are_compared_once(spark, monkeypatch):
    stops = spark.createDataFrame([(i, f"Рынок {i % 2}", None, None, "Томск") for i in range(90)], "stop_id long, name string, lat double, lon double, settlement string")
    terminals = spark.createDataFrame([(i, f"Рынок {min(i, 2)}", 50.0 + i, 80.0, "Томск") for i in range(80)], "terminal_id long, name string, lat double, lon double, settlement string")
    made, real = [], spatial.tiles

    def counted(*args):
        made.append(real(*args))
        return made[-1]

    monkeypatch.setattr(spatial, "tiles", counted)
    got = {(r.stop_id, r.resolved_by, r.lat) for r in spatial.resolve_stop_coords(stops, terminals).collect()}
    assert sum(df.count() for df in made) == 2 * 3
    # The other name is as good but for a letter: nearer than the gap allows.
    assert got == {(i, None, None) for i in range(90)}
    terminals = terminals.where("terminal_id <> 1 AND terminal_id < 4").withColumn("name", F.when(F.col("terminal_id") == 0, F.col("name")).otherwise("Вокзал"))
    got = {(r.stop_id, r.resolved_by, r.lat) for r in spatial.resolve_stop_coords(stops, terminals).collect()}
    assert got == {(i, 0, 50.0) for i in range(90)}


def test_links_in_shares_are_those_of_all_candidates(spark, monkeypatch):
    cfg = linkage.LinkConfig()
    pick = ["left_id", "right_id", "score", "second", "result"]
    told = lambda df: sorted(map(tuple, df.select(*pick).collect()))
    left, right = sides(spark, 14)
    scored = linkage.keep(linkage.scored_links(left, right, linkage.link_candidates(left, right)), "scored")
    want = told(linkage.decide_join(scored, cfg))
    made, real = [], linkage._in_order

    def counted(rows, cfg, cut=None):
        made.append(rows.count())
        return real(rows, cfg, cut)

    assert told(linkage.greedy_links(left, right, cfg)) == want and len(want) > 40
    monkeypatch.setattr(linkage, "_in_order", counted)
    # Short lists run out, and shares of a few rows only meet what is free.
    assert told(linkage.greedy_links(left, right, cfg, most=200, width=100)) == want
    assert len(made) > 1 and max(made) < scored.count() / 2
    assert linkage.greedy_links(left.limit(0), right, cfg).count() == 0


def test_alike_rows_without_a_point_are_tried_once(spark, monkeypatch):
    cfg = linkage.LinkConfig()
    left, right = sides(spark, 15)
    wide = lambda df, key: df.crossJoin(spark.range(4)).withColumn(key, F.col(key) + 100 * F.col("id")).withColumn("ordinal", F.col(key)).drop("id")
    a, b = linkage.prepared(wide(left, "left_id")), linkage.prepared(wide(right, "right_id").withColumn("lat", F.lit(None).cast("double")))
    every = ranked(linkage._rated(a.alias("a").crossJoin(b.alias("b")), cfg).collect())
    made, real = [], linkage.tiles

    def counted(*args):
        made.append(real(*args))
        return made[-1]

    monkeypatch.setattr(linkage, "tiles", counted)
    few = ranked(linkage._top_bare(a, b, cfg).collect())
    assert {i: [(r.right_id, r.score) for r in rows[:2]] for i, rows in few.items()} == {i: [(r.right_id, r.score) for r in rows[:2]] for i, rows in every.items()}
    assert made[-1].count() <= 60 * 45


def test_fine_cells_meet_what_coarse_ones_do(spark):
    rng = random.Random(16)
    point = lambda: (rng.choice([0.0, 55.0, 68.99, 69.5, 84.0]) + rng.uniform(0, 0.05), rng.choice([83.0, 179.99]) + rng.uniform(0, 0.1))
    rows = lambda n: [(i, *point(), []) for i in range(n)]
    left = spark.createDataFrame(rows(200), f"left_id long, lat double, lon double, codes {linkage.NO_CODES}")
    right = spark.createDataFrame(rows(200), f"right_id long, lat double, lon double, codes {linkage.NO_CODES}")
    told = lambda cell: {tuple(r) for r in linkage._meets(left, right, linkage.LinkConfig(cell=cell)).select("left_id", "right_id").collect()}
    pairs = left.alias("a").crossJoin(right.alias("b")).where(linkage.geo.planar_m2(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")) <= 2000**2)
    assert told(0.5) == {(r.left_id, r.right_id) for r in pairs.select("left_id", "right_id").collect()} and len(told(0.5)) > 100
