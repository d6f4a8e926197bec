"""Operator 11, a Merkle manifest of a table by nested-struct rollup.

Rows are leaves. Within a group (a source) they are ranked, and the rank is
written in base ``FAN``. The lowest ``DIGITS`` digits are columns that are grouped
away one after the other inside a block of ``FAN ** DIGITS`` consecutive nodes,
each grouping nesting up to ``FAN`` child structs in their parent. All of these
groupings share the shuffle by (group, block). The tops of blocks are the nodes
of the next round, until each group has one block; groups are then the leaves of
one more tree. Transforms over the nested structs and one explode emit the proofs
of a block without a join; the path above a block comes by one join with one row
on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railweave.llm.store import Scratch

FAN, DIGITS = 3, 5
STEP = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def canonical(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _ranked(rows: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """Adds ``rank``, the place in its group ``g`` along ``order``, and ``n``, the group's size.

    Rows are dealt by range over (g, order), so a large group is spread over many
    tasks; places in a task follow from its row numbers, and what lies before it
    from one count for each task and group.
    """
    session = rows.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), rows.count() >> 18)
    dealt = rows.repartitionByRange(parts, "g", *order).sortWithinPartitions("g", *order)
    dealt = scratch.keep(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "ranked")
    counts = dealt.groupBy("g", "part").agg(F.count("*").alias("c"), F.min("at").alias("low"))
    along = Window.partitionBy("g").orderBy("part")
    counts = counts.withColumn("ahead", F.sum("c").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("c")).withColumn("n", F.sum("c").over(Window.partitionBy("g"))).drop("c")
    return dealt.join(counts, ["g", "part"]).withColumn("rank", F.col("ahead") + F.col("at") - F.col("low")).drop("at", "part", "ahead", "low")


def _levels(n: Column) -> Column:
    """How often ``n`` nodes are grouped until one is left."""
    out = F.lit(0)
    for k in range(39):
        out = out + (n > F.lit(FAN**k)).cast("int")
    return out


def _block(nodes: DataFrame) -> DataFrame:
    """One row for each block: (g, block, blocks, height, top) from (g, rank, n, node)."""
    size = FAN**DIGITS
    places = [F.floor(F.pmod("rank", F.lit(FAN ** (k + 1))) / FAN**k).cast("int").alias(f"d{k}") for k in range(DIGITS)]
    rows = nodes.select("g", F.floor(F.col("rank") / size).alias("block"), F.ceil(F.col("n") / size).alias("blocks"), _levels(F.col("n")).alias("height"), *places, "node").repartition("g", "block")
    for k in range(DIGITS):
        keys = ["g", "block", "blocks", "height", *(f"d{j}" for j in range(k + 1, DIGITS))]
        kids = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(f"d{k}").alias("at"), "node"))).alias("kids"))
        joined = F.array_join(F.transform("kids", lambda x: x["node"]["digest"]), "")
        own = F.when(F.lit(k) < F.col("height"), F.sha2(joined, 256)).otherwise(joined)
        rows = kids.select(*keys, F.struct(own.alias("digest"), "kids").alias("node"))
    return rows.withColumnRenamed("node", "top")


def _climb(nodes: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Tables of blocks, the last with one block for each group."""
    tables = []
    while True:
        tables.append(scratch.keep(_block(nodes), "blocks"))
        if (tables[-1].agg(F.max("blocks")).first()[0] or 0) <= 1:
            return tables
        nodes = tables[-1].select("g", F.col("block").alias("rank"), F.col("blocks").alias("n"), F.struct(F.col("top.digest").alias("digest")).alias("node"))


def _kids(k: int) -> Callable[[Column], Column]:
    """The children of a node of level ``k`` + 1 with their paths and places."""

    def below(x):
        kids = x["node"]["kids"]
        told = lambda lot: F.array_join(F.transform(lot, lambda y: y["node"]["digest"]), "")
        step = lambda i: F.array(F.struct(told(F.slice(kids, F.lit(1), i)).alias("left"), told(F.slice(kids, i + 2, F.lit(FAN))).alias("right")))
        path = lambda i: F.when(F.lit(k) < F.col("height"), F.concat(step(i), x["path"])).otherwise(x["path"])
        return F.transform(kids, lambda kid, i: F.struct(kid["node"].alias("node"), path(i).alias("path"), (x["at"] * FAN + i).cast("int").alias("at")))

    return below


def _descend(tables: list[DataFrame], above: DataFrame | None) -> DataFrame:
    """(g, node, path, root, ..): the leaves with their paths, lowest level first.

    ``above`` has one row for each group: (g, path, ..), what follows the group's
    own path, and further columns that all leaves of the group get.
    """
    for table in reversed(tables):
        if table is tables[-1]:
            rows = table.withColumn("root", F.col("top.digest"))
            rows = rows.withColumn("path", F.array().cast(STEP)) if above is None else rows.join(above, "g")
        else:
            rows = table.join(above, ["g", "block"])
        lines = F.array(F.struct(F.col("top").alias("node"), "path", F.lit(0).alias("at")))
        for k in reversed(range(DIGITS)):
            lines = F.flatten(F.transform(lines, _kids(k)))
        others = [c for c in rows.columns if c not in ("block", "blocks", "height", "top", "path")]
        rows = rows.select(*others, "block", F.explode(lines).alias("x"))
        above = rows.select(*others, (F.col("block") * FAN**DIGITS + F.col("x.at")).alias("block"), F.col("x.node").alias("node"), F.col("x.path").alias("path"))
        if table is not tables[0]:
            above = above.drop("node")
    return above


def manifest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """Leaves, roots and proofs of all rows, and a check of rows that were tampered with.

    Returns (id_col, leaf, subroot, root, proof_sha256, folded_root, verified), one
    row per input row. A leaf is the digest of ``fields``, nulls told from empty
    texts. Leaves of a source ascend by id (null first), then by leaf, so repeated
    rows are interchangeable; the null source is a source, before all others. A
    row is tampered with if 2 divides the crc32 of its id: its text loses its line
    feeds. A table of one row has its leaf as root and an empty proof; an empty
    table gives an empty result. Other columns are ignored, so their names can't
    clash; texts of any length are hashed whole, and only digests are shuffled.
    """
    scratch = Scratch()
    leaf = lambda text: digest(*[canonical(text if f == text_col else F.col(f)) for f in fields])
    text = F.col(text_col)
    hit = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0, F.lit(False)) & F.contains(text, F.lit("\n"))
    group = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-"))
    rows = scratch.keep(docs.select(F.col(id_col).cast("long").alias("id"), group.alias("g"), leaf(text).alias("digest"), F.when(hit, leaf(F.replace(text, F.lit("\n")))).alias("altered")), "leaves")
    nodes = _ranked(rows, ["id", "digest"], scratch).select("g", "rank", "n", F.struct("digest", "id", "altered").alias("node"))
    tables = _climb(nodes, scratch)
    tops = tables[-1].select(F.lit("").alias("g"), F.col("g").alias("source"), F.col("top.digest").alias("digest"))
    groups = _climb(_ranked(tops, ["source"], scratch).select("g", "rank", "n", F.struct("digest", "source").alias("node")), scratch)
    above = _descend(groups, None).select(F.col("node.source").alias("g"), "path", F.col("root").alias("all"))
    found = _descend(tables, above)
    folded = F.aggregate("path", F.coalesce("node.altered", "node.digest"), lambda have, x: digest(x["left"], have, x["right"]))
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), ""), 256)
    out = found.select(F.col("node.id").alias(id_col), F.col("node.digest").alias("leaf"), F.col("root").alias("subroot"), F.col("all").alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return scratch.result(out.withColumn("verified", F.col("folded_root") == F.col("root")), "manifest")
