"""Record linkage and stop attachment: scores, decisions, exclusive matching."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railweave.functions import geo, names
from railweave.operators.graph import components, drop, keep
from railweave.operators.sequences import first_per_key
from railweave.operators.tiling import tiles

# Weights of name, geometry, settlement and transport.
WEIGHTS = (0.45, 0.30, 0.15, 0.10)
NO_CODES = "array<struct<system:string,code_type:string,code:string>>"


@dataclass(frozen=True)
class LinkConfig:
    threshold: float = 0.6
    margin: float = 0.1
    ambiguity: float = 0.05
    distance_m: float = 500.0
    cell: float = 0.5
    window_m: float = 2000.0


def codes_match(a: Column, b: Column) -> Column:
    """Some code of both with the same type or the same system."""
    hit = F.exists(a, lambda x: F.exists(b, lambda y: (x["code"] != "") & (x["code"] == y["code"]) & (x["code_type"].eqNullSafe(y["code_type"]) | x["system"].eqNullSafe(y["system"]))))
    return F.coalesce((F.size(a) > 0) & (F.size(b) > 0) & hit, F.lit(False))


def _facts(name: Column, settlement: Column, transport: Column) -> dict[str, Column]:
    """What the scores need of one side's names, each worked out once a record."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    return {"norm": names.normalize_name(name), "core": names.core_name(name), "place": names.core_name(settlement), "stem": names.core_stem(names.core_name(settlement)), "settled": some(settlement), "modes": names.modes(transport), "moved": some(transport)}


def prepared(df: DataFrame) -> DataFrame:
    """``df`` with a struct ``facts`` of its names, so that pairs don't normalise them again."""
    return df.withColumn("facts", F.struct(*[c.alias(k) for k, c in _facts(F.col("name"), F.col("settlement"), F.col("transport")).items()]))


def _known(side: Callable[[str], Column], ready: bool) -> Callable[[str], Column]:
    """A side's facts by name, from its ``facts`` column if it is prepared."""
    if ready:
        return lambda k: side("facts")[k]
    facts = _facts(side("name"), side("settlement"), side("transport"))
    return lambda k: facts[k]


def _same_place(x: Callable[[str], Column], y: Callable[[str], Column]) -> Column:
    return names.same_core_by_stem(x("place"), x("stem"), y("place"), y("stem"))


def _metres(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    return geo.haversine_km(a("lat"), a("lon"), b("lat"), b("lon")) * 1000.0


def _features(a: Callable[[str], Column], b: Callable[[str], Column], x: Callable[[str], Column], y: Callable[[str], Column], name: Column, t: Column | float, known: dict[str, Column] = {}) -> tuple[Column, Column]:
    """Weighted score over the features that are present, and the distance in metres; ``known`` may give metres and place."""
    metres = known["metres"] if "metres" in known else _metres(a, b)
    place = known["place"] if "place" in known else _same_place(x, y)
    far = t if isinstance(t, Column) else F.lit(float(t))
    band = F.when(metres <= far / 5, 1.0).when(metres <= far, 0.6).when(metres <= far * 4, 0.25).otherwise(0.0)
    has = [F.lit(True), metres.isNotNull(), x("settled") & y("settled"), x("moved") & y("moved")]
    value = [name, band, F.when(place, 1.0).otherwise(0.0), F.when(F.arrays_overlap(x("modes"), y("modes")), 1.0).otherwise(0.0)]
    top, bottom = F.lit(0.0), F.lit(0.0)
    for h, v, w in zip(has, value, WEIGHTS, strict=True):
        top = top + F.when(h, v * w).otherwise(0.0)
        bottom = bottom + F.when(h, F.lit(w)).otherwise(0.0)
    return top / bottom, metres


def score_pair_records(a: Callable[[str], Column], b: Callable[[str], Column], cfg: LinkConfig = LinkConfig(), ready: bool = False) -> Column:
    """Struct (score, metres, code) of two records; ``a`` and ``b`` give a side's column by name.

    With ``ready`` both sides come from :func:`prepared`.
    """
    x, y = _known(a, ready), _known(b, ready)
    code = codes_match(a("codes"), b("codes"))
    score, metres = _features(a, b, x, y, names.plain_similarity(x("norm"), y("norm")), cfg.distance_m)
    return F.struct(F.when(code, 1.0).otherwise(score).alias("score"), metres.alias("metres"), code.alias("code"))


def _voice(source: Column) -> Column:
    return F.regexp_replace(F.coalesce(F.nullif(F.lower(F.trim(source)), F.lit("")), F.lit("unknown")), "^motis$", "osm")


def _trust_of(x: Column, y: Column) -> Column:
    """C09 for two sources as :func:`_voice` gives them."""
    out = None
    for source, value in (("seed", 0.4), ("manual", 1.0), ("legacy", 0.7)):
        hit = (x == source) | (y == source)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.when(x == y, 0.6).otherwise(1.0)


def trust(a: Column, b: Column) -> Column:
    """How much a pair of sources may confirm each other."""
    return _trust_of(_voice(a), _voice(b))


def score_pair_attach(a: Callable[[str], Column], b: Callable[[str], Column], density: Column, distance_m: Column | float = 500.0, ready: bool = False, known: dict[str, Column] = {}) -> Column:
    """Struct (value, trust, code, has_geom, metres, name_sim, guard) of a stop and a terminal.

    ``known`` may give what is a column already: sim, metres, place, trust, code.
    """
    x, y = _known(a, ready), _known(b, ready)
    known = {"trust": trust(a("source"), b("source")), "code": codes_match(a("codes"), b("codes")), "sim": names.core_similarity(x("core"), y("core"), x("norm"), y("norm")), "place": _same_place(x, y)} | known
    t, code, sim = known["trust"], known["code"], known["sim"]
    score, metres = _features(a, b, x, y, sim, distance_m, known)
    rural = density.isin("rural", "suburban")
    close = F.coalesce(metres <= (distance_m if isinstance(distance_m, Column) else F.lit(float(distance_m))), F.lit(False))
    guard = code | close | F.coalesce(rural & (sim >= 0.8) & known["place"] & (t >= 1), F.lit(False))
    return F.struct(F.when(code, t).otherwise(t * score).alias("value"), t.alias("trust"), code.alias("code"), (~code & metres.isNotNull()).alias("has_geom"), F.when(~code, metres).alias("metres"), sim.alias("name_sim"), guard.alias("guard"))


def decide(best: Column, other: Column, n: Column, density: Column, cfg: LinkConfig = LinkConfig()) -> Column:
    """Decision on the best score struct; ``other`` is the score the gap is measured to, NULL if there is none."""
    gap = best["value"] - other
    vague = (n > 1) & (best["value"] >= cfg.threshold - cfg.margin) & F.coalesce(gap < cfg.ambiguity, F.lit(False))
    loose = ~best["code"] & ~best["has_geom"] & density.isin("rural", "suburban")
    margin = ~loose | gap.isNull() | (gap >= cfg.ambiguity)
    sure = (best["value"] >= cfg.threshold) & best["guard"] & margin
    return F.when(n == 0, "rejected").when(vague, "duplicate_ambiguous").when(sure, "verified").when(best["value"] >= cfg.threshold - cfg.margin, "low_confidence").otherwise("rejected")


def match_best(scored: DataFrame, key: str, cfg: LinkConfig = LinkConfig(), semantics: str = "smallest") -> DataFrame:
    """Best candidate and decision of each key; ``scored`` has (key, cand_no, density, s).

    The gap goes to the smallest other score, or to the second best with
    ``semantics='runner_up'``. Ties go to the smallest cand_no. The smallest other
    score is the smallest of all as soon as two are known: were it the best one's
    alone, it would be below the others. So one aggregate tells all, and of a
    task's candidates one row a key is shuffled.
    """
    best = _best(scored, key)
    if semantics == "smallest":
        rows = best.withColumn("other", F.when(F.col("known") > 1, F.col("low")))
    else:
        rest = scored.join(best.select(key, F.col("top.cand_no").alias("_b")), key).where(F.col("cand_no") != F.col("_b"))
        rows = best.join(rest.groupBy(key).agg(F.max("s.value").alias("other")), key, "left")
    return _verdict(rows, key, cfg)


def _best(scored: DataFrame, key: str) -> DataFrame:
    """(key, top, n, low, known, mine) of scored candidates; ``mine`` counts those marked as held, where they are."""
    rank = F.struct(F.col("s.value").alias("value"), (-F.col("cand_no")).alias("nth"))
    mine = [F.count_if("_held").alias("mine")] if "_held" in scored.columns else []
    return scored.groupBy(key).agg(F.max_by(F.struct("cand_no", "s", "density"), rank).alias("top"), F.count("*").alias("n"), F.min("s.value").alias("low"), F.count("s.value").alias("known"), *mine)


def _verdict(rows: DataFrame, key: str, cfg: LinkConfig) -> DataFrame:
    return rows.select(key, F.col("top.cand_no").alias("cand_no"), F.col("top.s").alias("s"), "n", decide(F.col("top.s"), F.col("other"), F.col("n"), F.col("top.density"), cfg).alias("decision"))


def _side(alias: str) -> Callable[[str], Column]:
    return lambda c: F.col(f"{alias}.{c}")


def _code_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, kind, group, code): one row for each way a code can match."""
    one = df.select(key, F.explode("codes").alias("x")).where("x.code <> ''")
    return one.select(key, F.explode(F.array(F.struct(F.lit("type").alias("kind"), F.coalesce("x.code_type", F.lit("")).alias("grp"), F.col("x.code").alias("code")), F.struct(F.lit("system").alias("kind"), F.coalesce("x.system", F.lit("")).alias("grp"), F.col("x.code").alias("code")))).alias("k")).select(key, "k.*").distinct()


def _letters(text: Column) -> Column:
    """Letters, each with its number among its like, so that multisets meet as sets; '' for an empty name."""
    chars = F.split(text, "")
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c)).cast("string"))))


def _grams(text: Column) -> Column:
    """Distinct runs of three letters."""
    return F.when(F.length(text) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def _least(least: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in least.items() for x in kv]), F.col("kind"))


def _lists(both: list[DataFrame], bound: Column, cut: Callable[[Column], Column]) -> list[DataFrame]:
    """(kind, norm, ts, first) of each side: a name's parts, rarest first, and those of which a like name has one."""
    lists = [df.select("kind", "norm", F.posexplode(cut(F.col("norm"))).alias("at", "t")).drop("at") for df in both]
    rare = lists[0].select("t").union(lists[1].select("t")).groupBy("t").agg(F.count("*").alias("n"))
    sides = []
    for rows in lists:
        ranked = rows.join(rare, "t").groupBy("kind", "norm").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]).alias("ts"))
        size = F.size("ts")
        sides.append(ranked.withColumn("first", F.slice("ts", F.lit(1), size - F.ceil(bound * size - 1e-9).cast("int") + 1) if cut is _letters else F.slice("ts", 1, 1)))
    return sides


def similar_names(left: DataFrame, right: DataFrame, least: dict[str, float]) -> DataFrame:
    """Pairs (x, y) of distinct names with a similarity of at least ``least[kind]``, exactly.

    Rows are (kind, norm); only rows of one kind meet. A similarity s of 1 - edits
    over the longer length leaves at least s times the longer length of letters in
    common, as multisets. Of letters in one order, rarest first, two such names
    share one among the first n - ceil(s n) + 1 of each (prefix filter), and their
    lengths differ by the factor s at most. A name inside another shares its
    rarest run of three letters with it. What meets is compared in full, once for
    each pair of names.
    """
    both = [df.distinct() for df in (left, right)]
    bound = _least(least)
    out = []
    for cut, fits in ((_letters, F.least(F.length("x"), F.length("y")) >= bound * F.greatest(F.length("x"), F.length("y")) - 1e-9), (_grams, F.contains("x", F.col("y")) | F.contains("y", F.col("x")))):
        sides = _lists(both, bound, cut)
        named = lambda df, name, lot: df.select("kind", F.col("norm").alias(name), F.col(lot).alias(f"{name}s"), F.explode(lot).alias("t"))
        l, r = sides
        if cut is _letters:
            met = named(l, "x", "first").join(named(r, "y", "first"), ["kind", "t"]).where(fits)
            # A pair meets at each common letter; it is compared at the first one only.
            met = met.where(F.element_at(F.array_intersect("xs", "ys"), 1) == F.col("t")).select("kind", "x", "y")
        else:
            one = named(l, "x", "first").join(named(r, "y", "ts"), ["kind", "t"])
            two = named(l, "x", "ts").join(named(r, "y", "first"), ["kind", "t"])
            met = one.select("kind", "x", "y").union(two.select("kind", "x", "y")).where(fits)
        out.append(met.where(names.plain_similarity(F.col("x"), F.col("y")) >= bound - 1e-9))
    return out[0].union(out[1]).select("x", "y", "kind").distinct()


def _meetings(left: DataFrame, right: DataFrame, *on: str) -> int:
    """How many pairs a join would make, from the counts of its keys."""
    n = left.groupBy(*on).agg(F.count("*").alias("n")).join(right.groupBy(*on).agg(F.count("*").alias("m")), [*on])
    return n.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0


def _alike(left: DataFrame, right: DataFrame, floor: float, cfg: LinkConfig, dense: int = 1 << 20) -> DataFrame:
    """(left_id, right_id) of prepared rows whose score without geometry reaches ``floor``.

    Rows of one settlement meet by its keys. Other pairs get nothing from the
    settlement, so their names alone must be like enough: by how much follows from
    the weights, the settlement being absent on a side or contradicting. Where keys
    or letters would meet more than an eighth of all pairs, as names all alike do,
    or all pairs are at most ``dense``, each pair is scored once in tiles instead;
    the rows are the same.
    """
    name, _, place, mode = WEIGHTS
    # The best the other features can do: the transport agrees, or is absent.
    need = lambda w: min((floor * (name + w + mode) - mode) / name, floor * (name + w) / name)
    least = {"any": need(0.0), "blank": need(0.0), "both": need(place)}
    keyed = lambda df, key, other: df.where("facts.place <> ''").select(F.col(key).alias(other), F.explode(names.core_keys(F.col("facts.place"))).alias("_key"))
    homes, guests = keyed(left, "left_id", "left_id"), keyed(right, "right_id", "right_id")
    at_home = homes.join(guests, "_key").select("left_id", "right_id").distinct()
    kinds = lambda yes, no: F.explode(F.when(F.col("facts.settled"), F.array(*[F.lit(k) for k in yes])).otherwise(F.array(*[F.lit(k) for k in no]))).alias("kind")
    l = left.select("left_id", "facts.norm", kinds(("blank", "both"), ("any",)))
    r = right.select("right_id", "facts.norm", kinds(("any", "both"), ("any", "blank")))
    pairs = left.count() * right.count()
    spelled = lambda: [x.select("kind", F.explode("first").alias("t")) for x in _lists([df.select("kind", "norm").distinct() for df in (l, r)], _least(least), _letters)]
    if pairs and (pairs <= dense or _meetings(homes, guests, "_key") > pairs / 8 or _meetings(*spelled(), "kind", "t") > pairs / 8):
        score = score_pair_records(_side("a"), _side("b"), cfg, ready=True)["score"]
        return tiles(left, right).where(score >= floor).select("left_id", "right_id")
    like = similar_names(l.select("kind", "norm"), r.select("kind", "norm"), least)
    abroad = l.withColumnRenamed("norm", "x").join(like, ["kind", "x"]).join(r.withColumnRenamed("norm", "y"), ["kind", "y"]).select("left_id", "right_id")
    pairs = at_home.union(abroad).distinct()
    rows = pairs.join(left.alias("a"), "left_id").join(right.alias("b"), "right_id")
    return rows.where(score_pair_records(_side("a"), _side("b"), cfg, ready=True)["score"] >= floor).select("left_id", "right_id")


def link_candidates(left: DataFrame, right: DataFrame, cfg: LinkConfig = LinkConfig()) -> DataFrame:
    """C01, blocking: distinct (left_id, right_id) that may link.

    Same or neighbouring grid cell within the window; equal codes; and where a side
    has no point, every pair that scores enough to change a decision, by a
    similarity join (see :func:`_alike`). The floor is ``threshold - margin -
    ambiguity``: a best pair below ``threshold - margin`` decides nothing, and a
    second one counts within ``ambiguity`` or ``margin`` of it only.
    """
    point = "lat IS NOT NULL AND lon IS NOT NULL"
    floor = cfg.threshold - cfg.margin - cfg.ambiguity - 1e-9
    a, b = keep(prepared(left), "left"), keep(prepared(right), "right")
    loose = _alike(a, b.where(f"NOT ({point})"), floor, cfg).union(_alike(a.where(f"NOT ({point})"), b.where(point), floor, cfg))
    return _meets(left, right, cfg).select("left_id", "right_id").union(loose).distinct()


def _meets(left: DataFrame, right: DataFrame, cfg: LinkConfig, near: Column | None = None) -> DataFrame:
    """(left_id, right_id, a, b) of rows ``near`` each other, by default within the window, or with a code in common; a and b are the whole rows."""
    whole = lambda df, name: F.struct(*df.columns).alias(name)
    within = geo.planar_m2(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")) <= cfg.window_m**2 if near is None else near
    # Away from the poles cells as wide as what is near have the same pairs: at a latitude of 70 both measures are wider in degrees than below.
    fine = 1.01 * max(cfg.window_m / (111000.0 * (1.0 - 0.0000152 * 70 * 70)), cfg.distance_m * 4 / (111000.0 * math.cos(math.radians(70))))
    calm = lambda lat: F.coalesce(lat.between(-69, 69), F.lit(False)) & F.lit(fine < min(cfg.cell, 0.5))
    placed = lambda df: df.where("lat IS NOT NULL AND lon IS NOT NULL")

    def meet(rows: DataFrame, cell: float) -> DataFrame:
        l = rows.select(whole(left, "a"), F.explode(F.array_distinct(geo.neighbour_cells(F.col("lat"), F.col("lon"), cell))).alias("_cell"))
        r = placed(right).select(whole(right, "b"), geo.geo_cell(F.col("lat"), F.col("lon"), cell).alias("_cell"))
        return l.join(r, "_cell").where(within).select("a", "b")

    beside = F.array_contains(geo.neighbour_cells(F.col("a.lat"), F.col("a.lon"), cfg.cell), geo.geo_cell(F.col("b.lat"), F.col("b.lon"), cfg.cell))
    coded = _code_keys(left, "left_id").join(_code_keys(right, "right_id"), ["kind", "grp", "code"]).select("left_id", "right_id").distinct()
    coded = coded.join(left.select("left_id", whole(left, "a")), "left_id").join(right.select("right_id", whole(right, "b")), "right_id").select("a", "b")
    pairs = meet(placed(left).where(calm(F.col("lat"))), fine).union(meet(placed(left).where(~calm(F.col("lat"))), cfg.cell)).union(coded.where(~F.coalesce(within & (calm(F.col("a.lat")) | beside), F.lit(False))))
    return pairs.select("a.left_id", "b.right_id", "a", "b")


def scored_links(left: DataFrame, right: DataFrame, pairs: DataFrame, cfg: LinkConfig = LinkConfig()) -> DataFrame:
    """(left_id, ordinal, right_id, right_no, score, metres, code) of candidate pairs."""
    rows = pairs.join(prepared(left).alias("a"), "left_id").join(prepared(right).alias("b"), "right_id")
    return rows.select("left_id", "a.ordinal", "right_id", F.col("b.ordinal").alias("right_no"), score_pair_records(_side("a"), _side("b"), cfg, ready=True).alias("s")).select("left_id", "ordinal", "right_id", "right_no", "s.*")


def _judge(cands: DataFrame, cfg: LinkConfig) -> DataFrame:
    """Decision of each left row from its free candidates; ``size`` counts used ones too."""
    w = Window.partitionBy("left_id").orderBy(F.desc("score"), "right_no")
    top = cands.withColumn("n", F.row_number().over(w)).withColumn("second", F.coalesce(F.lead("score").over(w), F.lit(0.0))).where("n = 1").drop("n")
    guard = F.col("code") | F.coalesce(F.col("metres") <= cfg.distance_m, F.lit(False))
    sure = (F.col("score") >= cfg.threshold) & ((F.col("score") - F.col("second") >= cfg.margin) | (F.col("second") == 0)) & guard
    vague = (F.col("size") > 1) & (F.col("score") >= cfg.threshold - cfg.margin) & (F.col("score") - F.col("second") < cfg.ambiguity)
    return top.withColumn("result", F.when(sure, "enriched").when(vague, "ambiguous").otherwise("identity_only"))


def decide_join(scored: DataFrame, cfg: LinkConfig = LinkConfig(), most: int = 1 << 21) -> DataFrame:
    """Greedy exclusive linkage in input order (ordinal, then left_id), as a serial loop gives it.

    A right row is used up by an enriched or an ambiguous result, so it can only
    be taken by a left row that scores ``threshold - margin`` with it. A left row's
    decision hangs on its two best free candidates alone; it is settled in a round
    if no earlier open row could take either. When such rounds settle few rows,
    the open rows contend in chains: then the earliest rows, with at most about
    ``most`` candidate pairs, are settled in order in one task, and rounds go on
    with what that leaves. A task's share is bounded, whatever the chains' length.
    """
    sizes = scored.groupBy("left_id").agg(F.count("*").alias("size"))
    live = keep(scored.where("score > 0").join(sizes, "left_id"), "live")
    order = F.struct("ordinal", "left_id")
    done, stuck = None, False
    while True:
        pairs = live.count()
        if done is not None and not pairs:
            break
        if stuck and pairs:
            last = live.agg(F.percentile_approx("ordinal", min(1.0, most / pairs), 10000)).first()[0]
            settled = keep(_in_order(live.where(F.col("ordinal") <= last), cfg), "settled")
        else:
            takers = live.where(F.col("score") >= cfg.threshold - cfg.margin).groupBy("right_id").agg(F.min(order).alias("first"))
            nth = F.row_number().over(Window.partitionBy("left_id").orderBy(F.desc("score"), "right_no"))
            two = live.withColumn("_n", nth).where("_n <= 2").drop("_n").join(takers, "right_id", "left")
            ready = two.groupBy("left_id").agg(F.bool_and(F.coalesce(F.col("first") >= order, F.lit(True))).alias("ready")).where("ready").select("left_id")
            settled = keep(_judge(two.drop("first").join(ready, "left_id"), cfg), "settled")
        stuck = not stuck and settled.count() * 8 < live.select("left_id").distinct().count()
        done = settled if done is None else done.unionByName(settled)
        # An earlier open row keeps a right row that a later one took: it can't take it, but it may report it.
        used = settled.where("result <> 'identity_only'").select(F.col("right_id").alias("_taken"), order.alias("_by"))
        open_rows = live.join(settled.select("left_id"), "left_id", "left_anti")
        before, live = live, keep(open_rows.join(used, (F.col("right_id") == F.col("_taken")) & (F.col("_by") < order), "left_anti"), "live")
        drop(before)
    drop(live)
    return done


def greedy_links(left: DataFrame, right: DataFrame, cfg: LinkConfig = LinkConfig(), most: int = 1 << 21, width: int = 1 << 22) -> DataFrame:
    """C04 of all pairs of :func:`link_candidates`, without a table of them.

    Left rows are settled in order, some at a time, so that they only meet right
    rows that no earlier one used up. Of each row the best candidates go to one
    task, about ``most`` in all; where these are used up and more were left out,
    the task stops, and the next share begins with that row. ``width`` bounds the
    pairs scored at once for each core. How many candidates a row has in all is not
    asked: a row without a second free one has the gap of its whole score.
    """
    if cfg.ambiguity > cfg.threshold - cfg.margin:
        return decide_join(scored_links(left, right, link_candidates(left, right, cfg), cfg), cfg)
    bare = F.col("lat").isNull() | F.col("lon").isNull()
    floor = cfg.threshold - cfg.margin - cfg.ambiguity - 1e-9
    a, b = keep(prepared(left).withColumn("_bare", bare), "left"), keep(prepared(right).withColumn("_bare", bare), "right")
    near = keep(_rated(_meets(a, b, cfg), cfg).where("score > 0"), "near")
    ids = ["left_id", "right_id"]
    met = keep(near.join(a.where("_bare").select("left_id"), "left_id", "left_semi").select(*ids).union(near.join(b.where("_bare").select("right_id"), "right_id", "left_semi").select(*ids)), "met")
    apart = not met.isEmpty()
    lefts, lone = a.count(), a.where("_bare").count()
    used = keep(b.select("right_id").limit(0), "used")
    order, key = F.struct("ordinal", "left_id"), [a.schema[c].dataType for c in ("ordinal", "left_id")]
    at = lambda row: F.struct(*[F.lit(row[i]).cast(kind) for i, kind in enumerate(key)])
    score = score_pair_records(_side("a"), _side("b"), cfg, ready=True)["score"]
    pieces, since, size = [], F.lit(True), 1 << 12
    while True:
        free = b.join(used, "right_id", "left_anti")
        loose, placed = [free.where("_bare" if x else "NOT _bare") for x in (True, False)]
        # Right rows that a left row meets without a point on some side.
        each = loose.count() + (placed.count() * lone / lefts if lone else 0)
        size = max(1, min(size, int(width * a.sparkSession.sparkContext.defaultParallelism / max(each, 1))))
        head = a.where(since).select("ordinal", "left_id").orderBy("ordinal", "left_id").limit(size)
        last = head.agg(F.max(order).alias("x")).first()["x"]
        if last is None:
            break
        share = since & (order <= at(last))
        mine = a.where(share)
        pairs = [tiles(mine, loose)] + ([tiles(mine.where("_bare"), placed)] if lone else [])
        rows = near.where(share).join(used, "right_id", "left_anti")
        for some in pairs:
            rated = _rated(some.where(score >= floor), cfg)
            rows = rows.unionByName(rated.join(met, ids, "left_anti") if apart else rated)
        cut = max(1, min(most // size, 999))
        nth = F.row_number().over(Window.partitionBy("left_id").orderBy(F.desc("score"), "right_no"))
        listed = rows.withColumn("_n", nth).where(F.col("_n") <= cut + 1).drop("_n").withColumn("size", F.lit(2).cast("long"))
        settled = keep(_in_order(listed, cfg, cut), "settled")
        pieces.append(settled)
        stop = settled.where("result = 'stop'").select("ordinal", "left_id").first()
        since = order > at(last) if stop is None else order >= at(stop)
        size = size * 2 if stop is None else max(1, size // 2)
        before, used = used, keep(used.union(settled.where("result NOT IN ('identity_only', 'stop')").select("right_id")).coalesce(8), "used")
        drop(before)
    if not pieces:
        return decide_join(scored_links(left, right, _meets(left, right, cfg).select("left_id", "right_id"), cfg), cfg)
    return a.sparkSession.read.schema(pieces[0].schema).parquet(*[x._kept_at for x in pieces]).where("result <> 'stop'")


def _in_order(rows: DataFrame, cfg: LinkConfig, cut: int | None = None) -> DataFrame:
    """The serial loop over a bounded number of candidate pairs.

    A list of more than ``cut`` candidates may lack some; where fewer than two of it
    are free the loop stops at its row, with the result ``stop``.
    """
    schema = rows.withColumn("second", F.lit(0.0)).withColumn("result", F.lit("")).schema

    def group(pdf):
        pdf = pdf.sort_values(["ordinal", "left_id", "score", "right_no"], ascending=[True, True, False, True], ignore_index=True)
        right = pdf.right_id.factorize()[0]
        free, left = np.ones(len(pdf), bool), pdf.left_id.to_numpy()
        score, size, code = pdf.score.to_numpy(), pdf["size"].to_numpy(), pdf.code.to_numpy(bool)
        near = pdf.metres.to_numpy(float, na_value=np.inf) <= cfg.distance_m
        starts = np.flatnonzero(np.append(True, left[1:] != left[:-1])) if len(pdf) else []
        at, second, result = [], [], []
        for lo, hi in zip(starts, np.append(starts[1:], len(pdf)), strict=True):
            two = np.flatnonzero(free[right[lo:hi]])[:2] + lo
            if len(two) < 2 and cut is not None and hi - lo > cut:
                at.append(lo)
                second.append(0.0)
                result.append("stop")
                break
            if not len(two):
                continue
            best, next_score = score[two[0]], score[two[1]] if len(two) > 1 else 0.0
            gap, kind = best - next_score, "identity_only"
            if best >= cfg.threshold and (gap >= cfg.margin or next_score == 0) and (code[two[0]] or near[two[0]]):
                kind = "enriched"
            elif size[two[0]] > 1 and best >= cfg.threshold - cfg.margin and gap < cfg.ambiguity:
                kind = "ambiguous"
            if kind != "identity_only":
                free[right[two[0]]] = False
            at.append(two[0])
            second.append(float(next_score))
            result.append(kind)
        return pdf.iloc[at].assign(second=second, result=result)[[f.name for f in schema]]

    return rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(group, schema)


def blocked_fuzzy_join(left: DataFrame, right: DataFrame, cfg: LinkConfig = LinkConfig()) -> DataFrame:
    """(left_id, right_id, score, second, result) for every left row.

    Result is enriched, ambiguous or identity_only; right_id is NULL for the last,
    whose score and second are those of the candidates of :func:`link_candidates`.
    Columns of both sides: their id, ordinal, name, lat, lon, settlement, transport, codes.
    """
    links = greedy_links(left, right, cfg)
    found = links.select("left_id", F.when(F.col("result") != "identity_only", F.col("right_id")).alias("right_id"), "score", "second", "result")
    return left.select("left_id").join(found, "left_id", "left").select("left_id", "right_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("second", F.lit(0.0)).alias("second"), F.coalesce("result", F.lit("identity_only")).alias("result"))


def _rated(rows: DataFrame, cfg: LinkConfig) -> DataFrame:
    """(left_id, ordinal, right_id, right_no, score, metres, code) of prepared rows that have met as a and b."""
    return rows.select("left_id", "a.ordinal", "right_id", F.col("b.ordinal").alias("right_no"), score_pair_records(_side("a"), _side("b"), cfg, ready=True).alias("s")).select("left_id", "ordinal", "right_id", "right_no", "s.*")


def _two_best(scored: DataFrame) -> DataFrame:
    """The two best rows of each left row; ranks are told in each task before the shuffle."""
    nth = F.row_number().over(Window.partitionBy("left_id").orderBy(F.desc("score"), "right_no"))
    return scored.withColumn("_n", nth).where("_n <= 2").drop("_n")


def _top_pairs(left: DataFrame, right: DataFrame, cfg: LinkConfig, floor: float = 0.0, pilot: int = 256) -> DataFrame:
    """Scored pairs of prepared rows, of all with all: among them each left row's two best of those that reach ``floor``.

    A few right rows (``pilot``) give each left row a second best score. No pair
    below it is among the two best of all, so of the whole product, each pair of
    which is scored, few rows are left to be ranked. With ``tiles`` nothing is
    broadcast, and what is asked for is exact whatever rows the pilot took.
    """
    some = right.orderBy(F.xxhash64("right_id")).limit(pilot)
    low = _two_best(_rated(tiles(left, some), cfg)).groupBy("left_id").agg(F.when(F.count("*") > 1, F.min("score")).alias("low"))
    told = left.join(low, "left_id", "left").withColumn("low", F.greatest("low", F.lit(floor)))
    score = score_pair_records(_side("a"), _side("b"), cfg, ready=True)["score"]
    return _rated(tiles(told, right).where(score >= F.col("a.low")), cfg)


def _top_bare(left: DataFrame, right: DataFrame, cfg: LinkConfig, floor: float = 0.0) -> DataFrame:
    """:func:`_top_pairs` of rows that lack a point on one side at least: rows of equal names, places, transports and codes score alike and are tried once.

    Of alike right rows the first two are enough.
    """
    same = ["facts", "codes"]
    no_point = [F.lit(None).cast("double").alias(c) for c in ("lat", "lon")]
    lots = keep(left.select(*same).distinct().select(F.monotonically_increasing_id().alias("left_id"), F.lit(0).alias("ordinal"), *same, *no_point), "lots")
    nth = F.row_number().over(Window.partitionBy(*same).orderBy("ordinal", "right_id"))
    two = right.select("right_id", "ordinal", *same).withColumn("_n", nth).where("_n <= 2").groupBy(*same).agg(F.array_sort(F.collect_list(F.struct("ordinal", "right_id"))).alias("two"))
    held = keep(two.select(F.monotonically_increasing_id().alias("right_id"), F.col("two")[0]["ordinal"].alias("ordinal"), "two", *same, *no_point), "held")
    best = _two_best(_top_pairs(lots, held.drop("two"), cfg, floor)).join(held.select("right_id", "two"), "right_id").select(F.col("left_id").alias("lot"), F.inline("two"), "score", "metres", "code")
    rows = left.alias("x").join(lots.select(F.col("left_id").alias("lot"), F.col("facts").alias("_f"), F.col("codes").alias("_c")), F.col("facts").eqNullSafe(F.col("_f")) & F.col("codes").eqNullSafe(F.col("_c"))).select("left_id", F.col("x.ordinal").alias("_o"), "lot")
    return rows.join(best, "lot").select("left_id", F.col("_o").alias("ordinal"), "right_id", F.col("ordinal").alias("right_no"), "score", "metres", "code")


def full_fuzzy_join(left: DataFrame, right: DataFrame, cfg: LinkConfig = LinkConfig()) -> DataFrame:
    """Each left row alone against all right rows, without blocking, so a right row can serve several.

    Rows without a point are tried with all rows, others with those near them
    first. A pair whose points are far apart gets nothing for them, so its score is
    bounded: a left row whose second best is above that bound is done, only the
    others visit the rest of the right side.
    """
    point = "lat IS NOT NULL AND lon IS NOT NULL"
    a, b = keep(prepared(left), "left"), keep(prepared(right), "right")
    placed = a.where(point)
    loose = _top_bare(placed, b.where(f"NOT ({point})"), cfg)
    in_reach = _metres(_side("a"), _side("b")) <= cfg.distance_m * 4
    first = keep(_two_best(loose.union(_rated(_meets(placed, b, cfg, in_reach), cfg)).where("score > 0")), "tried")
    name, _, place, mode = WEIGHTS
    most = WEIGHTS[1] + name + F.when(F.col("facts.settled"), place).otherwise(0.0) + F.when(F.col("facts.moved"), mode).otherwise(0.0)
    second = first.groupBy("left_id").agg(F.when(F.count("*") > 1, F.min("score")).alias("second"))
    # Near a pole or the date line the cells of _meets are no bound on the distance.
    plain = F.col("lat").between(-85, 85) & F.col("lon").between(-179, 179) & ~F.isnan("lat") & ~F.isnan("lon")
    done = keep(placed.join(second, "left_id").where(plain & (F.col("second") > (most - WEIGHTS[1]) / most + 1e-9)).select("left_id"), "done")
    rest = _top_pairs(placed.join(done, "left_id", "left_anti"), b, cfg).union(_top_bare(a.where(f"NOT ({point})"), b, cfg)).where("score > 0")
    two = first.join(done, "left_id", "left_semi").unionByName(_two_best(rest))
    links = _judge(two.withColumn("size", F.lit(right.count())), cfg)
    return left.select("left_id").join(links.select("left_id", F.when(F.col("result") != "identity_only", F.col("right_id")).alias("right_id"), "score", "second", "result"), "left_id", "left").na.fill({"score": 0.0, "second": 0.0, "result": "identity_only"})


def unmatched_right(right: DataFrame, links: DataFrame) -> DataFrame:
    """Right rows that no link used up."""
    return right.join(links.where("right_id IS NOT NULL").select("right_id"), "right_id", "left_anti")


def merge_enrichment(left: DataFrame, right: DataFrame, links: DataFrame) -> DataFrame:
    """Left records with what their right record adds; filled fields stay, codes are united."""
    blank = lambda c: F.nullif(c, F.lit(""))
    rows = left.alias("a").join(links.where("result = 'enriched'").select("left_id", "right_id"), "left_id", "left").join(right.alias("b"), "right_id", "left")
    fill = [F.coalesce(blank(F.col(f"a.{c}")), blank(F.col(f"b.{c}"))).alias(c) for c in ("settlement", "transport")]
    codes = F.array_union(F.coalesce("a.codes", F.array().cast(NO_CODES)), F.coalesce("b.codes", F.array().cast(NO_CODES)))
    return rows.select("left_id", "a.name", F.col("b.name").alias("alt_name"), "a.lat", "a.lon", *fill, codes.alias("codes"))


def _placed(df: DataFrame, key: str, cells: Column) -> DataFrame:
    """(key, _cells, _bare): all cells of a key's rows, and whether one of them has no point."""
    point = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return df.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(point, cells))))).alias("_cells"), F.bool_or(~point).alias("_bare"))


def _met(stops: DataFrame, terminals: DataFrame, cell: float, pick: Callable[[], list[Column]], rows: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``pick()`` of each candidate pair, once; ``rows`` makes what is carried to the pairs, as aliases a and b.

    Rows are sent to cells, pairs are not: a pair of keys is taken in the first
    cell that both have, so nothing has to be told apart afterwards.
    """
    s = _placed(stops, "stop_key", geo.neighbour_cells(F.col("lat"), F.col("lon"), cell))
    t = _placed(terminals, "terminal_id", F.array(geo.geo_cell(F.col("lat"), F.col("lon"), cell)))
    if rows is not None:
        s, t = s.join(rows(stops), "stop_key"), t.join(rows(terminals), "terminal_id")
    parts = int(stops.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = lambda df: df.withColumn("_cell", F.explode("_cells")).repartition(parts, "_cell")
    once = (F.size("b._cells") == 1) | (F.element_at(F.array_intersect("a._cells", "b._cells"), 1) == F.col("_cell"))
    near = at(s).alias("a").hint("merge").join(at(t.where("NOT _bare")).alias("b"), "_cell").where(once)
    code = lambda df, key: df.select(key, F.explode("codes").alias("x")).where("x.code <> ''").select(key, "x.system", "x.code").distinct()
    coded = code(stops, "stop_key").join(code(terminals, "terminal_id"), ["system", "code"]).select("stop_key", "terminal_id").distinct()
    apart = coded.join(s.alias("a"), "stop_key").join(t.where("NOT _bare").alias("b"), "terminal_id").where(~F.arrays_overlap("a._cells", "b._cells"))
    bare = tiles(s, t.where("_bare"))
    return near.select(*pick()).union(apart.select(*pick())).union(bare.select(*pick()))


def attach_candidates(stops: DataFrame, terminals: DataFrame, cell: float = 0.5) -> DataFrame:
    """Distinct (stop_key, terminal_id): cells around, equal (system, code), terminals without a point.

    Terminals without a point are candidates of every stop by rule.
    """
    return _met(stops, terminals, cell, lambda: [F.col("stop_key"), F.col("terminal_id")])


def scored_attach(stops: DataFrame, terminals: DataFrame, pairs: DataFrame | None = None, distance_m: float = 500.0, cell: float = 0.5) -> DataFrame:
    """(stop_key, cand_no, density, s): candidate terminals of stops with their scores.

    Without ``pairs`` those of :func:`attach_candidates` are scored where they meet.
    """
    if pairs is None:
        rows = _met(stops, terminals, cell, _pair, _carried)
    else:
        rows = pairs.join(_carried(stops).alias("a"), "stop_key").join(_carried(terminals).alias("b"), "terminal_id").select(*_pair())
    return _marked(rows, distance_m)


TOOK = ("density", "lat", "lon", "source", "codes", "facts")


def _carried(df: DataFrame) -> DataFrame:
    """What a stop or a terminal brings to its pairs."""
    told = prepared(df).withColumn("source", _voice(F.col("source")))
    return told.select(*[c for c in ("stop_key", "terminal_id", *TOOK) if c in told.columns])


def _pair() -> list[Column]:
    """Columns of a pair that met as a and b, from which :func:`_marked` makes the score.

    Worked out once a pair, in steps of their own: the score asks for each of them
    several times, and in one step the code would be too long to be compiled.
    """
    x, y = (_known(_side(alias), True) for alias in "ab")
    own = {"sim": names.core_similarity(x("core"), y("core"), x("norm"), y("norm")), "metres": _metres(_side("a"), _side("b")), "place": _same_place(x, y), "trust": _trust_of(F.col("a.source"), F.col("b.source")), "code": codes_match(F.col("a.codes"), F.col("b.codes"))}
    facts = lambda alias: F.struct(*[F.col(f"{alias}.{c}").alias(c) for c in TOOK[1:]]).alias(f"_{alias}")
    return [F.col("stop_key"), F.col("terminal_id").alias("cand_no"), F.col("a.density").alias("density"), facts("a"), facts("b"), *[v.alias(f"_{k}") for k, v in own.items()]]


def _marked(rows: DataFrame, distance_m: float, *also: str) -> DataFrame:
    known = {k: F.col(f"_{k}") for k in ("sim", "metres", "place", "trust", "code")}
    return rows.select("stop_key", "cand_no", "density", score_pair_attach(_side("_a"), _side("_b"), F.col("density"), distance_m, ready=True, known=known).alias("s"), *also)


@dataclass(frozen=True)
class _Few:
    """Some scored candidates of stops, and what is needed to tell whether they are enough.

    ``some`` has the columns of :func:`scored_attach`; ``facts`` (stop_key, bound,
    held): no other candidate of a stop scores above ``bound``, and ``held`` counts
    its candidates in cells. ``odd`` are candidates outside those, all of them, and
    ``rest`` makes every other one of given stops.
    """

    some: DataFrame
    odd: DataFrame
    facts: DataFrame
    rest: Callable[[DataFrame], DataFrame]


def _few_attach(stops: DataFrame, terminals: DataFrame, most: int, cfg: LinkConfig) -> _Few:
    """The candidates that can be among a stop's ``most`` best, and a few low ones of its cells.

    A pair farther apart than four times ``distance_m``, and with no code in common,
    gets nothing for its points, which bounds its score. So candidates within that
    distance are scored, those with a code in common, and ``most + 1`` terminals of
    each cell. Rows that have no plain point, or a key of several rows, are odd and
    meet all their candidates.
    """
    from railweave.operators.spatial import near_join

    reach, step = cfg.distance_m * 4, lambda df, key: df.withColumn("_plain", F.count("*").over(Window.partitionBy(key)) == 1)
    sides = [("stop_key", stops, (70, 179), F.array_distinct(geo.neighbour_cells(F.col("lat"), F.col("lon"), cfg.cell))), ("terminal_id", terminals, (90, 180), F.array(geo.geo_cell(F.col("lat"), F.col("lon"), cfg.cell)))]
    # Near a pole or the date line near_join is no bound on the distance; it leaves out (0, 0).
    s, t = (keep(step(_carried(df), key).withColumn("_plain", F.coalesce(F.col("_plain") & F.lit(reach <= 20000) & F.col("lat").between(-top, top) & F.col("lon").between(-side, side) & ((F.col("lat") != 0) | (F.col("lon") != 0)), F.lit(False))).withColumn("_cells", F.when(F.col("_plain"), cells)), key) for key, df, (top, side), cells in sides)
    plain, strange = [df.where("_plain").drop("_plain") for df in (s, t)], [df.where("NOT _plain").drop("_plain") for df in (s, t)]
    slim = lambda df: df.drop("_plain", "_cells")
    met = lambda a, b: _met(slim(a), slim(b), cfg.cell, _pair, lambda df: df)
    odd = met(strange[0], t) if not strange[0].isEmpty() else None
    if not strange[1].isEmpty():
        more = met(plain[0], strange[1])
        odd = more if odd is None else odd.union(more)
    (p, q), as_one = plain, lambda df, name: F.struct(*[c for c in df.columns]).alias(name)
    near = F.coalesce(_metres(_side("a"), _side("b")) <= reach, F.lit(False))
    same_cells = F.arrays_overlap("a._cells", "b._cells")
    close = near_join(p.select("lat", "lon", as_one(p, "a")), q.select(F.col("lat").alias("rlat"), F.col("lon").alias("rlon"), as_one(q, "b")), reach / 1000.0 * (1 + 1e-6))
    close = close.select("a.stop_key", "b.terminal_id", "a", "b").where(near & same_cells).select(*_pair(), F.lit(True).alias("_held"))
    by_code = lambda df, key: df.select(key, F.explode("codes").alias("x")).where("x.code <> ''").select(key, "x.system", "x.code").distinct()
    called = by_code(p, "stop_key").join(by_code(q, "terminal_id"), ["system", "code"]).select("stop_key", "terminal_id", F.lit(True).alias("_by")).distinct()
    coded = keep(_code_keys(p, "stop_key").join(_code_keys(q, "terminal_id"), ["kind", "grp", "code"]).select("stop_key", "terminal_id").distinct().join(called, ["stop_key", "terminal_id"], "left"), "coded")
    some = close
    nth = F.row_number().over(Window.partitionBy(F.element_at("_cells", 1)).orderBy(F.xxhash64("terminal_id"), "terminal_id"))
    low = q.withColumn("_n", nth).where(F.col("_n") <= most + 1).drop("_n").withColumn("_cell", F.element_at("_cells", 1)).alias("b")
    low = p.withColumn("_cell", F.explode("_cells")).alias("a").join(low, "_cell").where(~near)
    if not coded.isEmpty():
        low = low.join(coded, ["stop_key", "terminal_id"], "left_anti")
        told = coded.join(p.alias("a"), "stop_key").join(q.alias("b"), "terminal_id").where(~near & (F.coalesce("_by", F.lit(False)) | same_cells))
        some = some.union(told.select(*_pair(), same_cells.alias("_held")))
    some = _marked(some.union(low.select(*_pair(), F.lit(True).alias("_held"))), cfg.distance_m, "_held")
    per_cell = q.groupBy(F.element_at("_cells", 1).alias("_cell")).agg(F.count("*").alias("c"))
    held = p.select("stop_key", F.explode("_cells").alias("_cell")).join(per_cell, "_cell").groupBy("stop_key").agg(F.sum("c").alias("held"))
    name, point, place, mode = WEIGHTS
    more = lambda w: w + F.when(F.col("facts.settled"), place).otherwise(0.0) + F.when(F.col("facts.moved"), mode).otherwise(0.0)
    facts = p.select("stop_key", (more(name) / more(name + point) + 1e-9).alias("bound")).join(held, "stop_key", "left").na.fill(0, ["held"])
    odd = some.limit(0) if odd is None else _marked(odd, cfg.distance_m).withColumn("_held", F.lit(False))
    return _Few(some, odd, facts, lambda keys: _marked(met(p.join(keys.select("stop_key"), "stop_key", "left_semi"), q), cfg.distance_m).withColumn("_held", F.lit(True)))


def best_attach(stops: DataFrame, terminals: DataFrame, cfg: LinkConfig = LinkConfig()) -> DataFrame:
    """C10 of all candidates of :func:`attach_candidates`, without scoring most of them.

    A stop whose best near candidate is above what a far one can reach has its best.
    The smallest other score asks only whether some other candidate is lower by
    ``ambiguity``, so one that is says as much as the smallest. Stops that are not
    told by these have all their candidates scored.
    """
    few = _few_attach(stops, terminals, 1, cfg)
    best = keep(_best(few.some.union(few.odd), "stop_key").join(few.facts, "stop_key", "full"), "best")
    whole = F.col("bound").isNull() | (F.col("mine") == F.col("held"))
    told = whole | ((F.col("top.s.value") > F.col("bound")) & (F.col("known") > 1) & (F.col("top.s.value") - F.col("low") >= cfg.ambiguity))
    best = best.withColumn("told", F.coalesce(told, F.lit(False)))
    sure = best.where("told").withColumn("n", F.when(F.col("bound").isNull(), F.col("n")).otherwise(F.col("n") - F.col("mine") + F.col("held"))).where("n > 0")
    undone = best.where("NOT told").select("stop_key")
    rows = sure.drop("bound", "held", "told")
    if not undone.isEmpty():
        rows = rows.unionByName(_best(few.rest(undone).union(few.odd.join(undone, "stop_key", "left_semi")), "stop_key"))
    return _verdict(rows.withColumn("other", F.when(F.col("known") > 1, F.col("low"))), "stop_key", cfg)


def few_attach(stops: DataFrame, terminals: DataFrame, most: int, cfg: LinkConfig = LinkConfig()) -> DataFrame:
    """C08 for :func:`match_trip_stops` on trips of fewer than ``most`` stops: enough candidates of each stop.

    Enough are its ``most`` best, and as many that are lower than all of these by
    ``ambiguity``; whichever are used up, the best free one is among them, and so is
    a free one that the gap tells the same of as the smallest. Other stops have all.
    """
    few = _few_attach(stops, terminals, most, cfg)
    some = keep(few.some.union(few.odd), "some")

    def end(order: Column) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("stop_key").orderBy(order, "cand_no"))
        return some.select("stop_key", "cand_no", F.col("s.value").alias("value")).withColumn("_n", nth).where(F.col("_n") <= most).groupBy("stop_key")

    hi = end(F.desc("value")).agg(F.count("value").alias("high"), F.min("value").alias("kth"))
    lo = end(F.asc_nulls_last("value")).agg(F.count("value").alias("low"), F.max("value").alias("worst"))
    mine = some.groupBy("stop_key").agg(F.count_if("_held").alias("mine"))
    enough = (F.col("mine") == F.col("held")) | ((F.col("high") == most) & (F.col("kth") > F.col("bound")) & (F.col("low") == most) & (F.col("worst") <= F.col("kth") - cfg.ambiguity - 1e-9))
    undone = keep(few.facts.join(hi, "stop_key", "left").join(lo, "stop_key", "left").join(mine, "stop_key", "left").where(~F.coalesce(enough, F.lit(False))).select("stop_key"), "undone")
    rows = some.join(undone, "stop_key", "left_anti")
    if not undone.isEmpty():
        rows = rows.union(few.rest(undone)).union(few.odd.join(undone, "stop_key", "left_semi"))
    return rows.drop("_held")


def longest_trip(trip_stops: DataFrame) -> int:
    return trip_stops.groupBy("trip_id").count().agg(F.max("count")).first()[0] or 0


def match_trip_stops(trip_stops: DataFrame, scored: DataFrame, cfg: LinkConfig = LinkConfig()) -> DataFrame:
    """C11: exclusive matching along each trip, a fold over its ordered stops.

    ``trip_stops`` has (trip_id, seq, stop_key); ``scored`` as from :func:`scored_attach`
    or, with ``most`` above the longest trip, :func:`few_attach`. A terminal is used once in a trip, but the last stop may return to the first
    matched terminal if it isn't the second stop. Returns (trip_id, seq, stop_key,
    terminal_id, decision, value, code).

    A trip of n stops uses up at most n - 1 terminals before a stop, so of a stop's
    candidates the n + 1 best and the n + 1 worst of the longest trip tell all: the
    first free one of the best is taken, and the first free other one of the worst
    is what the gap is measured to. Both lists are sorted once a stop.
    """
    longest = longest_trip(trip_stops)

    def end(name: str, order: Column, *facts: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("stop_key").orderBy(order, "cand_no"))
        slim = scored.select("stop_key", "cand_no", "density", *[F.col(f"s.{c}").alias(c) for c in facts])
        few = slim.withColumn("_n", nth).where(F.col("_n") <= longest + 1)
        return few.groupBy("stop_key").agg(F.first("density").alias("density"), F.transform(F.array_sort(F.collect_list(F.struct("_n", "cand_no", *facts))), lambda c: F.struct(*[c[k].alias(k) for k in ("cand_no", *facts)])).alias(name))

    lists = end("hi", F.desc("value"), "value", "code", "has_geom", "guard").join(end("lo", F.asc_nulls_last("value"), "value").drop("density"), "stop_key")
    rows = trip_stops.join(lists, "stop_key", "left")
    trips = rows.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("seq", "stop_key", "density", "hi", "lo"))).alias("stops"))
    out_type = "array<struct<seq:int,stop_key:bigint,terminal_id:bigint,decision:string,value:double,code:boolean>>"
    start = F.struct(F.array().cast("array<bigint>").alias("used"), F.lit(None).cast("bigint").alias("first"), F.lit(0).alias("i"), F.array().cast(out_type).alias("out"))
    # A lambda's body works an expression out wherever it stands; as an argument it is worked out once.
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))

    def step(acc, x):
        last = (acc["i"] == F.size("stops") - 1) & (acc["i"] > 1)
        free = lambda end: F.filter(F.coalesce(x[end], F.array().cast(lists.schema[end].dataType)), lambda c: ~F.array_contains(acc["used"], c["cand_no"]) | (last & (c["cand_no"] == acc["first"])))
        picked = lambda f: F.struct(F.get(f["hi"], F.lit(0)).alias("best"), F.size(f["hi"]).alias("n"), f["lo"].alias("lo"))
        judged = lambda p: F.struct(p["best"].alias("best"), F.get(F.filter(p["lo"], lambda c: c["cand_no"] != p["best"]["cand_no"]), F.lit(0))["value"].alias("other"), p["n"].alias("n"))
        told = lambda j: F.struct(j["best"].alias("best"), decide(j["best"], j["other"], j["n"], x["density"], cfg).alias("verdict"))

        def after(v):
            best, verdict = v["best"], v["verdict"]
            hit = verdict == "verified"
            row = F.struct(x["seq"].cast("int").alias("seq"), x["stop_key"].cast("bigint").alias("stop_key"), F.when(hit, best["cand_no"]).alias("terminal_id"), verdict.alias("decision"), best["value"].alias("value"), best["code"].alias("code"))
            return F.struct(F.when(hit, F.array_append(acc["used"], best["cand_no"])).otherwise(acc["used"]).alias("used"), F.when(hit & acc["first"].isNull(), best["cand_no"]).otherwise(acc["first"]).alias("first"), (acc["i"] + 1).alias("i"), F.array_append(acc["out"], row).alias("out"))

        return let(F.struct(free("hi").alias("hi"), free("lo").alias("lo")), lambda f: let(picked(f), lambda p: let(judged(p), lambda j: let(told(j), after))))

    return trips.select("trip_id", F.explode(F.aggregate("stops", start, step)["out"]).alias("x")).select("trip_id", "x.*")


def legacy_match(legacy: DataFrame, skeleton: DataFrame, threshold: float = 0.6, cfg: LinkConfig = LinkConfig()) -> DataFrame:
    """Each legacy row alone against the skeleton: matched, or to review as legacy_unmatched."""
    point = "lat IS NOT NULL AND lon IS NOT NULL"
    floor = cfg.threshold - cfg.margin - cfg.ambiguity - 1e-9
    a, b = keep(prepared(legacy), "left"), keep(prepared(skeleton), "right")
    # The best of link_candidates, without a list of them: pairs that lack a point are scored where they meet.
    near = _rated(_meets(a, b, cfg), cfg)
    scored = near.union(_top_bare(a, b.where(f"NOT ({point})"), cfg, floor)).union(_top_bare(a.where(f"NOT ({point})"), b.where(point), cfg, floor))
    best = first_per_key(scored, ["left_id"], [F.desc("score"), "right_no"]).select("left_id", "right_id", "score")
    rows = legacy.select("left_id").join(best, "left_id", "left")
    hit = F.coalesce(F.col("score") >= threshold, F.lit(False))
    return rows.select("left_id", F.when(hit, F.col("right_id")).alias("right_id"), F.coalesce("score", F.lit(0.0)).alias("score"), F.when(hit, "matched").otherwise("review").alias("outcome"), F.when(~hit, "legacy_unmatched").alias("reason"))


def collapse_stop_area(records: DataFrame, metres: float = 300.0) -> DataFrame:
    """Records of one core name chained within ``metres`` become one; those without a point one for each name.

    The first record by input order is the base; transports and codes are united.
    """
    rows = records.withColumn("core", names.core_name(F.col("name")))
    placed = rows.where("lat IS NOT NULL AND lon IS NOT NULL AND core <> ''")
    dy, dx = metres / 111000.0, metres / (111000.0 * 0.3)
    cell = lambda df: df.withColumn("_r", F.floor(F.col("lat") / dy).cast("int")).withColumn("_c", F.floor(F.col("lon") / dx).cast("int"))
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    a = cell(placed).select("record_id", "core", "lat", "lon", "_r", "_c").withColumn("_i", F.explode(near)).withColumn("_j", F.explode(near)).withColumn("_r", F.col("_r") + F.col("_i")).withColumn("_c", F.col("_c") + F.col("_j"))
    b = cell(placed).select(F.col("record_id").alias("other"), "core", F.col("lat").alias("rlat"), F.col("lon").alias("rlon"), "_r", "_c")
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("rlat"), F.col("rlon"))
    edges = a.join(b, ["core", "_r", "_c"]).where("record_id < other").where(km * 1000 <= metres)
    roots = components(edges, "record_id", "other").select(F.col("node").alias("record_id"), "root")
    group = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull() | (F.col("core") == ""), F.concat(F.lit("r"), F.coalesce("root", "record_id").cast("string"))).otherwise(F.concat(F.lit("n"), "core"))
    tagged = rows.join(roots, "record_id", "left").withColumn("grp", group)
    base = F.struct("ordinal", "record_id")
    return tagged.groupBy("grp").agg(F.min_by("record_id", base).alias("record_id"), F.min_by("name", base).alias("name"), F.min_by("lat", base).alias("lat"), F.min_by("lon", base).alias("lon"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.filter(F.split(F.coalesce("transport", F.lit("")), r"\+"), lambda x: x != ""))))), "+").alias("transport"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("codes"), F.count("*").alias("members")).drop("grp")


def group_terminals(stops: DataFrame, metres: float = 200.0) -> DataFrame:
    """First-fit grouping: in input order a stop joins the first leader nearer than ``metres``, else leads.

    Rounds: a stop without an earlier undecided stop in range is decided, as a
    member of the earliest leader in range or as a leader. The first undecided
    stop is decided in every round, so the loop ends with none left. Stops without
    a point lead alone.
    """
    from railweave.operators.spatial import near_join

    held = stops.select(F.col("ordinal").alias("o2"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon"))
    pairs = keep(near_join(stops.select("stop_id", "ordinal", "lat", "lon"), held, metres / 1000.0).where(F.col("km") * 1000 < metres).where("o2 < ordinal").select("ordinal", "o2"), "fits")
    state = keep(stops.select("ordinal", F.lit(None).cast("long").alias("leader")), "state")
    while not state.where("leader IS NULL").isEmpty():
        known = pairs.join(state.select(F.col("ordinal").alias("o2"), F.col("leader").alias("l2")), "o2")
        seen = known.groupBy("ordinal").agg(F.bool_or(F.col("l2").isNull()).alias("wait"), F.min(F.when(F.col("l2") == F.col("o2"), F.col("o2"))).alias("lead"), F.min(F.when(F.col("l2").isNull(), F.col("o2"))).alias("pending"))
        now = state.join(seen, "ordinal", "left")
        # An earlier leader settles the matter even if later rows in range are still open.
        settle = F.when(F.col("lead").isNotNull() & (F.col("pending").isNull() | (F.col("lead") < F.col("pending"))), F.col("lead")).when(~F.coalesce("wait", F.lit(False)), F.col("ordinal"))
        before, state = state, keep(now.select("ordinal", F.coalesce("leader", settle).alias("leader")), "state")
        drop(before)
    return stops.select("stop_id", "ordinal").join(state, "ordinal").join(stops.select(F.col("ordinal").alias("leader"), F.col("stop_id").alias("terminal_id")), "leader").select("stop_id", "terminal_id")
