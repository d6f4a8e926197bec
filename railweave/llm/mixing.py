"""Operator 6, mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies, its source's
target over its source's size. Along the source's documents, largest first, the
prefix sums of expected copies are shifted by one offset, and a document is taken
once for each integer it crosses. The taken words then differ from the target by
less than the size of one document about the largest of the source.

Prefix sums are made in two steps, so that a source with a third of all rows is
never sorted in one task: documents are counted in cells (source, size class,
hash class), the cells' counts are summed up along the source, and places within
a cell come from a window over that cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railweave.llm.store import fresh

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) for rows (source, source_size).

    Weights repeat along the sources by code point, null last. Targets are a
    common level times the weight, stopped at ``most`` times the size; the level
    is where they sum to ``share`` of all sizes. Sources stop in the order of
    size over weight, so the level follows from running sums in that order. The
    table has one row for each source; windows over it are as small.
    """
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (n % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(most)
    up = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    rows = sizes.withColumn("w", w).withColumn("cap", cap)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    before = F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    heavy = F.sum("w").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("level", (total - before) / heavy).withColumn("stops", F.col("level") * F.col("w") >= F.col("cap"))
    level = F.first(F.when(~F.col("stops"), F.col("level")), ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(F.col("stops"), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("w")))
    return rows.select("source", "source_size", target.cast("double").alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, salts: int | None = None) -> DataFrame:
    """Copies to take of each document so that sources meet their targets.

    Returns (id_col, th, sh, size, source_size, target, copies, taken), one row per
    input row: size in words (null text: 0), taken = copies * size. th is the
    hash of the text, sh that of the source. A cell is dealt to ``salts`` hash
    classes, one more for each 2**18 rows if not given. The null source is a source. Reruns agree, as places follow
    size, hash, id and text; rows that repeat all of those are interchangeable.
    Sources without words have target 0 and are not taken. Other columns are
    ignored; an empty table gives an empty result.
    """
    salts = salts or 16 + (docs.count() >> 18)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), word_count(F.col(text_col)).alias("size"))
    rows = rows.withColumn("class", F.floor(F.log2(F.col("size") + 1.0) * 16).cast("int")).withColumn("salt", F.pmod(F.xxhash64("id", "th", F.lit(seed)), F.lit(salts)).cast("int"))
    cells = rows.groupBy("source", "class", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    targets = source_targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    along = Window.partitionBy("source").orderBy(F.desc("class"), "salt").rowsBetween(Window.unboundedPreceding, -1)
    ahead = cells.withColumn("ahead", F.coalesce(F.sum("n").over(along), F.lit(0))).drop("n", "words")
    told = ahead.alias("a").join(targets.alias("t"), F.col("a.source").eqNullSafe(F.col("t.source"))).select("a.*", "source_size", "target")
    place = F.row_number().over(Window.partitionBy("source", "class", "salt").orderBy(F.desc("size"), "id", "th"))
    placed = rows.withColumn("place", place)
    on = F.col("p.source").eqNullSafe(F.col("c.source")) & (F.col("p.class") == F.col("c.class")) & (F.col("p.salt") == F.col("c.salt"))
    full = placed.alias("p").join(told.alias("c"), on).select("id", "th", "size", "p.source", "source_size", "target", (F.col("ahead") + F.col("place")).alias("rank"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    copies = (F.floor(offset + rate * F.col("rank")) - F.floor(offset + rate * (F.col("rank") - 1))).cast("long")
    copies = F.least(copies, F.lit(int(most)))
    return full.withColumn("copies", copies).select(F.col("id").alias(id_col), "th", _source_hash(F.col("source")).alias("sh"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _source_hash(source: Column) -> Column:
    return F.xxhash64(source.isNull(), source)


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as it is taken; columns stay, whatever their names.

    Rows that repeat id, text and source share their copies: the first stands for all.
    Null ids, texts and sources are values like others here.
    """
    th, sh, copy = fresh(docs, "_th", "_sh", "_copy")
    found = mix_sources(docs, **options).groupBy("doc_id", "th", "sh").agg(F.sum("copies").alias("copies")).where("copies > 0")
    keyed = docs.withColumns({th: F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), sh: _source_hash(F.col("source").cast("string"))})
    key = ["doc_id", th, sh]
    once = keyed.groupBy(*key).count().where("count > 1").isEmpty()
    first = keyed if once else keyed.dropDuplicates(key)
    on = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col(f"d.{th}") == F.col("f.th")) & (F.col(f"d.{sh}") == F.col("f.sh"))
    return first.alias("d").join(found.alias("f"), on).select("d.*", F.explode(F.sequence(F.lit(1), F.col("f.copies"))).alias(copy)).drop(th, sh, copy)
