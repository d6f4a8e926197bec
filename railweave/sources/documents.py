"""One large JSON document read by many tasks.

A multi-line JSON file is one task to Spark, whatever its size. Here the text
reader splits it at closing braces into fragments, in blocks of
``spark.sql.files.maxPartitionBytes``. Counts of quotes and brackets per block,
added up along the document, tell each block in which state it begins; from then
on every fragment knows its depth, and the fragments between two ends of elements
are an element. Blocks and elements are the largest things a task holds.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from railweave.operators.graph import Scratch

BLOCK = ["file", "block"]
SIGNS = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]', re.S)
REGULAR = r"^\s*,\s*\{"


def _so_far(*keys: str, by: str):
    return Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(c: str, *keys: str, by: str) -> Column:
    return F.coalesce(F.sum(c).over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _change(bare: Column, outside_after: Column) -> Column:
    """The change of depth over a fragment: what it opens, less what it closes, its end included."""
    signs = F.regexp_replace(bare, r'"[^"]*+(?:"|\z)|[^"\[\]{]++', "")
    closed = F.length(signs) - F.length(F.replace(signs, F.lit("]"), F.lit("")))
    return (F.length(signs) - 2 * closed - outside_after.cast("int")).cast("long")


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """Fragments with running counts in their block, for a block that begins outside (0) and inside (1) a string."""
    rows = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    rows = rows.withColumn("bare", F.regexp_replace("value", r"(?s)\\.", "")).withColumn("quotes", (F.length("bare") - F.length(F.replace("bare", F.lit('"'), F.lit("")))).cast("long"))
    w = _so_far(*BLOCK, by="n")
    rows = rows.withColumn("quotes_here", F.sum("quotes").over(w))
    odd = (F.col("quotes_here") - F.col("quotes")) % 2
    for begin in (0, 1):
        text = F.when(odd == begin, F.col("bare")).otherwise(F.concat(F.lit('"'), "bare"))
        rows = rows.withColumn(f"change_{begin}", _change(text, (F.col("quotes_here") + begin) % 2 == 0))
        rows = rows.withColumn(f"depth_{begin}", F.sum(f"change_{begin}").over(w))
    return rows.drop("bare")


def _placed(rows: DataFrame, depth: int) -> DataFrame:
    """Fragments with the depth before them and whether they end an object at ``depth``, numbered by such ends."""
    blocks = rows.groupBy(*BLOCK).agg(*[F.sum(c).alias(c) for c in ("quotes", "change_0", "change_1")])
    blocks = blocks.withColumn("begins", _before("quotes", "file", by="block") % 2)
    blocks = blocks.withColumn("change", F.when(F.col("begins") == 0, F.col("change_0")).otherwise(F.col("change_1")))
    blocks = blocks.select(*BLOCK, "begins", _before("change", "file", by="block").alias("base"))
    after = F.col("base") + F.when(F.col("begins") == 0, F.col("depth_0")).otherwise(F.col("depth_1"))
    change = F.when(F.col("begins") == 0, F.col("change_0")).otherwise(F.col("change_1"))
    ends = ((F.col("begins") + F.col("quotes_here")) % 2 == 0) & (after == depth)
    rows = rows.join(blocks, BLOCK).select(*BLOCK, "n", "value", (after - change).alias("level"), after.alias("after"), ends.cast("long").alias("ends"))
    counts = rows.groupBy(*BLOCK).agg(F.sum("ends").alias("ends")).select(*BLOCK, _before("ends", "file", by="block").alias("gone"))
    here = F.sum("ends").over(_so_far(*BLOCK, by="n"))
    return rows.join(counts, BLOCK).withColumn("position", F.col("gone") + here - F.col("ends"))


def _head(text: str, level: int, depth: int) -> tuple[int, str | None, bool]:
    """Where the last object at ``depth`` starts (-1: no element of an array), its array's name, and whether that array began here."""
    start, name, last, inside = -1, None, "", "same"
    for sign in SIGNS.finditer(text):
        c = sign.group()
        if c[0] == '"':
            last = c
        elif c in "{[":
            if level == depth - 1:
                inside, name = ("array", json.loads(last) if level else "") if c == "[" else ("object", None)
            if c == "{" and level == depth:
                start = sign.start()
            level += 1
        else:
            level -= 1
    if inside == "object" or start < 0 or text[:start].rstrip().endswith(":"):
        return -1, None, True
    return start, name, inside == "array"


def _heads(depth: int):
    @F.pandas_udf("struct<start:int,name:string,fresh:boolean>")
    def heads(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, levels in batches:
            found = [(None, None, None) if x is None else _head(x, int(at), depth) for x, at in zip(texts, levels, strict=True)]
            yield pd.DataFrame(found, columns=["start", "name", "fresh"]).astype({"start": "Int32", "name": object, "fresh": "boolean"})

    return heads


def elements(spark: SparkSession, path: str, keyed: bool = True) -> DataFrame:
    """(file, name, position, value): the objects in the arrays of JSON documents, as text.

    ``keyed``: arrays are members of the document's object and ``name`` says which;
    else the document is one array, and ``name`` is empty. Rows with NULL as name
    hold what stands around the elements; joined in order of position they are the
    document with these elements left out (see :func:`frame`). Scalars and arrays
    inside an array are no elements. Files without an array give no elements, an
    empty file no row. Text that is no JSON gives no promise but ends. The table
    is kept in the shared folder until its caller drops it.
    """
    depth, scratch = 2 if keyed else 1, Scratch()
    rows = _placed(scratch.keep(_fragments(spark, path), "fragments"), depth)
    parts = F.array_sort(F.collect_list(F.struct("block", "n", "level", "after", "value")))
    rows = rows.groupBy("file", "position").agg(parts.alias("parts"), (F.max("ends") == 1).alias("whole"))
    # The reader doesn't say whether a file's last fragment had a brace; one that would go below depth 0 had none.
    closed = F.col("whole") | (F.element_at("parts", -1)["after"] == 0)
    text = F.concat(F.array_join(F.transform("parts", lambda p: p["value"]), "}"), F.when(closed, "}").otherwise(""))
    rows = rows.select("file", "position", "whole", text.alias("text"), F.col("parts")[0]["level"].alias("level"))
    rows = rows.withColumn("regular", F.col("whole") & (F.col("level") == depth) & F.col("text").rlike(REGULAR))
    rows = rows.withColumn("head", _heads(depth)(F.when(F.col("whole") & ~F.col("regular"), F.col("text")), "level"))
    rows = scratch.keep(rows.withColumn("run", F.floor(F.col("position") / 65536)), "elements")
    # The name of an array goes with its elements: within runs of positions, then from run to run.
    named = F.when(F.col("head.fresh"), F.struct("head.name"))
    ran = rows.where("head.fresh").groupBy("file", "run").agg(F.max_by(F.struct("head.name"), "position").alias("name"))
    ran = rows.select("file", "run").distinct().join(ran, ["file", "run"], "left")
    earlier = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    ran = ran.select("file", "run", F.last("name", ignorenulls=True).over(earlier).alias("earlier"))
    rows = rows.join(ran, ["file", "run"]).withColumn("array", F.coalesce(F.last(named, ignorenulls=True).over(_so_far("file", "run", by="position")), "earlier")["name"])
    start = F.when(F.col("regular"), F.length(F.regexp_extract("text", r"^\s*,\s*", 0))).when(F.col("head.start") >= 0, F.col("head.start"))
    inner = F.struct(F.col("array").alias("name"), F.substring("text", start + 1, F.length("text")).alias("value"))
    around = F.struct(F.lit(None).cast("string").alias("name"), F.when(start.isNull(), F.col("text")).otherwise(F.substring("text", F.lit(1), start)).alias("value"))
    pieces = F.when(F.col("regular"), F.array(inner)).when(start.isNotNull(), F.array(around, inner)).otherwise(F.array(around))
    rows = rows.select("file", "position", F.explode(pieces).alias("x")).select("file", "x.name", "position", "x.value")
    return scratch.result(rows, "document")


def frame(rows: DataFrame) -> DataFrame:
    """(file, value): each document without the elements, for its small members."""
    parts = F.array_sort(F.collect_list(F.struct("position", "value")))
    return rows.where("name IS NULL").groupBy("file").agg(F.array_join(F.transform(parts, lambda p: p["value"]), "").alias("value"))
