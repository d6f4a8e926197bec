"""Operator 9, n-gram Jaccard join by parity sketches.

A document's shingles are thrown into blocks by hash, and each block keeps the
XOR of its shingles' hashes. A shingle that only one of two documents has changes
one block at most, so the number of unequal blocks (the Hamming distance of the
sketches) never exceeds the size of the symmetric difference, which at Jaccard
similarity t is at most D = (|A| + |B|) * (1 - t) / (1 + t).

Sizes fall into bands of a factor 2. A document has a sketch in its own band and
in each lower one in which a smaller partner can be; a band's sketches have more
blocks than D for its sizes. Of the M blocks of a document that are not empty, at
least M - D equal its partner's. That is the pigeonhole, and it is used twice:

* a document stays only if M - D of its blocks occur with others at all;
* of those it enters as many of its rarest blocks as leave M - D - 1 out, since
  of M - D equal blocks one is then among them.

Nothing is left to chance: M > D is checked for every document, and the sketches
are made finer until it holds. Sets are compared exactly before a link is made.

A pair of sizes n and m differs by less than the worst partner of either, so a
block counts for it only if both have enough blocks left from there on.

Blocks of many documents are joined to a central one first. The documents of large
blocks that still hold several components afterwards are joined again by narrow
size bands on their rarest shingles, where the bound on the overlap is tight.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute is used inside tasks
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railweave.llm import repeats as R
from railweave.llm.rolling import joined_words, mix, prefix, span, within, word_hashes
from railweave.llm.store import Scratch, components, fresh

#: Blocks for each difference that a band allows, and the size up to which each shingle is a block of its own.
SPREAD, TINY = 1.5, 32
#: Blocks up to these numbers of documents are compared pair by pair, at once and after the first links.
SMALL, FEW = 4, 8
U = np.uint64
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_sets(bodies: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of ``width``-word shingles of many texts, sorted in each, and the sets' sizes.

    A text with fewer words is one shingle, one without words none. Long texts are
    hashed on their own, piece by piece.
    """
    words, counts = [], np.zeros(len(bodies), np.int64)
    for low, high in R.chunks([len(x) for x in bodies], 1 << 20):
        part = [x.translate(LOWER) for x in bodies[low:high]]
        if len(part) == 1:
            found = word_hashes(part[0])
            counts[low] = len(found)
        else:
            found, counts[low:high] = joined_words(part)
        words.append(found)
    every = np.concatenate(words) if words else np.zeros(0, U)
    start = np.cumsum(counts) - counts
    many = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    at = np.repeat(start, many) + within(many)
    size = np.minimum(np.repeat(counts, many), width)
    h = span(prefix(every), at, size) if len(at) else every
    own = np.repeat(np.arange(len(bodies)), many)
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return h[first], np.bincount(own[first], minlength=len(bodies))


def sketches(shingles: np.ndarray, counts: np.ndarray, num: int, den: int, spread: float, tiny: int, bits: int):
    """The sketches of each set: (set, back, need, blocks) by set, and the concatenated keys of their blocks.

    ``back`` is how far a sketch's band is below the set's own, ``need`` is M - D: so
    many of the blocks a partner has too.
    """
    own = np.repeat(np.arange(len(counts)), counts)
    band = np.frexp(np.maximum(counts, 1))[1].astype(np.int64) - 1
    found = []
    for back in range(1 + math.ceil(math.log2(den / num))):
        low = band - back
        most = (np.int64(2) << np.maximum(low, 0)) - 1  # the largest set of the band
        inside = (counts > 0) & (low >= 0) & ((back == 0) | (counts * num <= most * den))
        partner = counts * den // num if back == 0 else most
        differ = (counts + partner) * (den - num) // (den + num)
        blocks = np.ceil(spread * most * (den - num) / num).astype(np.int64)
        single = most <= tiny
        at = np.flatnonzero(inside[own])
        who = own[at]
        salt = mix((low + 1000).astype(U))[who]
        h = shingles[at]
        # A block of its own for each shingle is a block numbered by the shingle's place.
        place = np.where(single[who], at, (mix(h ^ salt) % np.maximum(blocks[who], 1).astype(U)).astype(np.int64))
        order = np.lexsort((place, who))
        who, place, h, salt = who[order], place[order], h[order], salt[order]
        if not len(who):
            continue
        new = np.ones(len(who), bool)
        new[1:] = (who[1:] != who[:-1]) | (place[1:] != place[:-1])
        first = np.flatnonzero(new)
        value = np.bitwise_xor.reduceat(h, first)
        number = np.where(single[who[first]], 0, place[first]).astype(U)
        key = mix(value ^ mix(number ^ salt[first])) >> U(64 - bits)
        many = np.bincount(who[first], minlength=len(counts))
        mine = np.flatnonzero(inside)
        found.append((mine, np.full(len(mine), back), (many - differ)[mine], many[mine], key))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(U)
    mine, back, need, many, key = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(mine, kind="stable")
    start = np.cumsum(many) - many
    many = many[order]
    return mine[order], back[order], need[order], many, key[np.repeat(start[order], many) + within(many)]


def _lists(flat: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), flat)


ABOUT = "kid long, th long, id long, n_shingles long, s1 long, s2 long, worst long, sketches array<struct<back:long,need:long,keys:array<long>>>"


def _described(texts: DataFrame, width: int, num: int, den: int, spread: float, tiny: int, bits: int) -> DataFrame:
    """Each row's set size, two sums that name the set, its sketches and the least of their needs."""

    def run(batches):
        for batch in batches:
            size = pa.compute.binary_length(batch.column("body")).to_pylist()
            for low, high in R.chunks(size, 1 << 20):
                s, counts = shingle_sets(batch.column("body").slice(low, high - low).to_pylist(), width)
                m = mix(s ^ U(0x2545F4914F6CDD1D))
                ends = np.cumsum(counts)
                sums = [np.concatenate((np.zeros(1, U), np.cumsum(x, dtype=U))) for x in (m, mix(m))]
                own, back, need, many, keys = sketches(s, counts, num, den, spread, tiny, bits)
                worst = np.full(len(counts), 1 << 60, np.int64)
                np.minimum.at(worst, own, need)
                inner = pa.StructArray.from_arrays([pa.array(back), pa.array(need), _lists(pa.array(keys.view(np.int64)), many)], ["back", "need", "keys"])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(x).slice(low, high - low) for x in ("kid", "th", "id")), pa.array(counts, pa.int64()), *(pa.array((x[ends] - x[ends - counts]).view(np.int64)) for x in sums), pa.array(worst), _lists(inner, np.bincount(own, minlength=len(counts)))],
                    ["kid", "th", "id", "n_shingles", "s1", "s2", "worst", "sketches"],
                )

    return texts.mapInArrow(run, ABOUT)


def _shared(about: DataFrame, rows: int) -> DataFrame:
    """(key, seen, node, tag): the blocks of each set that other sets have too.

    One shuffle of all blocks; ``tag`` packs the set's size, its sketch's number of
    blocks, and ``back``. Keys that a sample of some 8192 rows shows 16 times
    (few, as the sample is bounded) are dealt out over many tasks; they count as
    shared, and as the most frequent ones, whatever their number.
    """
    salts, part = max(8, rows >> 18), max(1, rows // 8192)
    sets = about.where("n_shingles > 0").select(F.xxhash64("n_shingles", "s1", "s2").alias("node"), "n_shingles", "kid", "th", F.explode("sketches").alias("x"))
    tag = F.shiftleft("n_shingles", 34) + F.shiftleft(F.size("x.keys").cast("long"), 4) + F.col("x.back")
    marks = lambda of: of.select("node", tag.alias("tag"), F.explode("x.keys").alias("key"))
    sample = marks(sets.where(F.pmod(F.xxhash64("kid", "th"), F.lit(part)) == 0))
    hot = sample.groupBy("key").agg(F.count("*").alias("m")).where("m >= 16").select("key", F.lit(True).alias("hot"))
    salted = marks(sets).join(F.broadcast(hot), "key", "left").withColumn("salt", F.when(F.col("hot"), F.pmod("node", F.lit(salts)) + 1).otherwise(0)).drop("hot")
    by_node = Window.partitionBy("key", "salt").orderBy("node")
    every = by_node.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = F.when(F.col("salt") > 0, F.lit(2**62)).otherwise(F.count("*").over(every))
    told = salted.select("*", F.lag("node").over(by_node).alias("before"), F.first("node").over(every).alias("low"), F.last("node").over(every).alias("high"), seen.alias("seen"))
    return told.where("(salt > 0 OR low <> high) AND (before IS NULL OR before <> node)").select("key", "seen", "node", "tag")


def _blocks(shared: DataFrame, num: int, den: int) -> DataFrame:
    """(key, node, n, m, slack, lack): of each set that has blocks enough in common with others, the rarest of them.

    ``slack`` is how many of the set's common blocks are more frequent than this
    one, ``lack`` is smaller the more of the set's ``m`` blocks others have.
    """
    held = shared.groupBy("node", "tag").agg(F.sort_array(F.collect_list(F.struct("seen", "key"))).alias("all")).withColumn("have", F.size("all"))
    held = held.withColumns({"n": F.shiftright("tag", 34), "m": F.shiftright("tag", 4).bitwiseAND(F.lit((1 << 30) - 1)), "back": F.col("tag").bitwiseAND(F.lit(15))})
    # As in sketches(): the largest partner, and by how much it can differ.
    below = F.pow(F.lit(2.0), F.floor(F.log2(F.col("n") + 0.5)) - F.col("back") + 1).cast("long") - 1
    partner = F.when(F.col("back") == 0, F.floor(F.col("n") * den / num)).otherwise(below)
    held = held.withColumn("need", F.col("m") - F.floor((F.col("n") + partner) * (den - num) / (den + num))).where("have >= need")
    each = held.select("node", "n", "m", "have", (F.col("need") / F.col("have")).alias("lack"), F.posexplode(F.expr("slice(all, 1, int(have - need + 1))")).alias("pos", "x"))
    return each.select("x.key", "node", "n", "m", (F.col("have") - F.col("pos") - 1).alias("slack"), "lack")


def _centred(blocks: DataFrame) -> DataFrame:
    """The rows of blocks of two or more sets, with their number and the set that has most in common with others."""
    centre = F.min(F.struct("lack", "node", "n", "m", "slack")).alias("c")
    return blocks.join(blocks.groupBy("key").agg(F.count("*").alias("seen"), centre).where("seen >= 2"), "key").select("key", "node", "n", "m", "slack", "seen", F.struct("c.node", "c.n", "c.m", "c.slack").alias("c"))


def _by_size(x: str, y: str, num: int, den: int):
    """Whether two sets are near enough in size to be similar."""
    a, b = F.col(f"{x}n"), F.col(f"{y}n")
    return (a * num <= b * den) & (b * num <= a * den)


def _by_blocks(x: str, y: str, num: int, den: int):
    """Whether two sets that meet in a block can be similar, if this is the rarest one they share."""
    a, b = (lambda c: F.col(f"{x}{c}")), (lambda c: F.col(f"{y}{c}"))
    differ = F.floor((a("n") + b("n")) * (den - num) / (den + num))
    return _by_size(x, y, num, den) & (a("slack") + 1 >= a("m") - differ) & (b("slack") + 1 >= b("m") - differ)


def _by_overlap(x: str, y: str, num: int, den: int):
    """The same for sets that meet in a shingle."""
    a, b = (lambda c: F.col(f"{x}{c}")), (lambda c: F.col(f"{y}{c}"))
    overlap = F.ceil((a("n") + b("n")) * num / (num + den))
    return _by_size(x, y, num, den) & (a("slack") + 1 >= overlap) & (b("slack") + 1 >= overlap)


def _candidates(rows: DataFrame, small: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of the blocks: with the central set, and all pairs up to ``small`` sets."""
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    star = rows.where("node <> c.node").where(_by_size("", "c.", num, den)).select(*ordered("node", "c.node"))
    few = rows.where(F.col("seen").between(3, small)).groupBy("key").agg(F.collect_list(F.struct("node", "n", "m", "slack")).alias("all"))
    inner = few.select("all", F.posexplode("all").alias("i", "x")).select("x", F.explode(F.expr("slice(all, i + 2, size(all))")).alias("y"))
    return star.union(inner.where(_by_size("x.", "y.", num, den)).select(*ordered("x.node", "y.node"))).distinct()


def _sets(nodes: DataFrame, texts: DataFrame, owner: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """(node, shingles): the sets of some nodes, as sorted 64-bit hashes, made anew from one text each."""

    def to_set(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                s, counts = shingle_sets([R.unsqueeze(x) for x in part.column("body").to_pylist()], width)
                sets = [s[e - n : e].tobytes() for e, n in zip(np.cumsum(counts), counts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])

    where = scratch.keep(nodes.join(owner.select("node", *R.KEY), "node"), "where")
    one = R.squeezed(texts, where).join(where, R.KEY).dropDuplicates(["node"])
    return scratch.keep(one.select("node", "body").mapInArrow(to_set, "node long, shingles binary"), "sets")


def _verified(pairs: DataFrame, texts: DataFrame, owner: DataFrame, width: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of nodes with den * |A & B| >= num * |A | B|."""
    sets = _sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), texts, owner, width, scratch)

    def compare(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return two.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def _rooted(marks: DataFrame, roots: DataFrame) -> DataFrame:
    return marks.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _open(rows: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (key, node, n, m, slack, root) of the blocks that hold several components, and (key, big, s) of these blocks.

    ``big`` is a block's largest component, ``s`` its number of sets.
    """
    now = _rooted(rows.select("key", "node", "n", "m", "slack"), roots)
    parts = now.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "root")).alias("x"), F.sum("c").alias("s"), F.count("*").alias("k")).where("k > 1")
    about = parts.select("key", F.col("x.root").alias("big"), "s")
    return now.join(about.select("key"), "key"), about


def _between(rows: DataFrame, about: DataFrame, can, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of a block's sets that are in different components: those outside its largest one with all that ``can`` be similar."""
    side = lambda df, c, *more: df.select("key", *more, *(F.col(x).alias(f"{c}{x}") for x in ("node", "n", "m", "slack", "root")))
    x = side(rows.join(about.select("key", "big"), "key").where("root <> big"), "x", "big")
    apart = (F.col("xroot") != F.col("yroot")) & ((F.col("yroot") == F.col("big")) | (F.col("xnode") < F.col("ynode")))
    both = x.join(side(rows, "y"), "key").where(apart & can("x", "y", num, den))
    return both.select(F.least("xnode", "ynode").alias("a"), F.greatest("xnode", "ynode").alias("b")).distinct()


def _by_shingles(nodes: DataFrame, texts: DataFrame, owner: DataFrame, width: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """(key, node, n, m, slack): rarest shingles of some sets for each pair of narrow size bands.

    Partners of sizes n and m have (n + m) * num / (num + den) shingles in common
    at least. Of the ``have`` shingles of a set that others have too, one of the
    ``have - overlap + 1`` rarest is therefore shared. A band keeps the first seven
    bits of a size, so sizes below 128 are bands of their own.
    """

    def explode(batches):
        for batch in batches:
            for node, x in zip(batch.column("node").to_pylist(), batch.column("shingles"), strict=True):
                h = np.frombuffer(x.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), node)), pa.array(h), pa.array(np.full(len(h), len(h)))], ["node", "h", "n"])

    every = scratch.keep(_sets(nodes, texts, owner, width, scratch).mapInArrow(R.gathered(explode), "node long, h long, n long"), "shingles")
    often = every.groupBy("h").agg(F.count("*").alias("seen")).where("seen >= 2")
    held = every.join(often, "h").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("seen", "h"))).alias("all"))
    cut = lambda n: F.greatest(F.floor(F.log2(n + 0.5)) - 6, F.lit(0)).cast("int")  # noqa: E731  bits that a band drops
    band = lambda n: cut(n) * 64 + F.call_function("shiftright", n, cut(n))
    lowest, highest = F.ceil(F.col("n") * num / den), F.floor(F.col("n") * den / num)
    of = held.select("node", "n", "all", band(F.col("n")).alias("i"), F.explode(F.sequence(band(lowest), band(highest))).alias("j"))
    dropped = F.greatest(F.floor(F.col("j") / 64) - 1, F.lit(0)).cast("int")
    least = F.greatest(F.call_function("shiftleft", F.col("j") - dropped * 64, dropped), F.lit(1))  # no set of band j is smaller
    deep = of.withColumn("depth", (F.size("all") - F.ceil((F.col("n") + least) * num / (num + den)) + 1).cast("int")).where("depth > 0")
    rare = deep.select("node", "n", F.size("all").alias("have"), F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), F.posexplode(F.expr("slice(all, 1, depth)")).alias("pos", "x"))
    return rare.select(F.xxhash64("lo", "hi", "x.h").alias("key"), "node", "n", F.col("n").alias("m"), (F.col("have") - F.col("pos") - 1).alias("slack"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 75, den: int = 100, small: int = SMALL, few: int = FEW, spread: float = SPREAD, tiny: int = TINY) -> DataFrame:
    """Link documents whose shingle sets reach Jaccard similarity num / den.

    Returns (id_col, n_shingles, component_id), one row per input row;
    component_id is the smallest id reachable by links, the own id included.
    Words are runs of non-space bytes with A-Z in lower case; a text with fewer
    than ``width`` words is one shingle; null, empty and blank texts have none and
    link with nothing. Documents with equal sets are one node, whatever their
    number. Rows with a null id are linked like others; their component_id is null
    only if no member has an id. An id that repeats with another text has the
    component of each text in that text's row. Other columns are ignored, so their
    names can't clash; an empty table gives an empty result.
    """
    found = _assigned(docs, id_col, text_col, width, num, den, small, few, spread, tiny)
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id")


def _assigned(docs: DataFrame, id_col: str, text_col: str, width: int = 5, num: int = 75, den: int = 100, small: int = SMALL, few: int = FEW, spread: float = SPREAD, tiny: int = TINY) -> DataFrame:
    """(id, th, n_shingles, root, component_id) of each row; root is one hash per component, null without shingles."""
    scratch = Scratch()
    texts = R.keyed(docs, id_col, text_col)
    rows = docs.count()
    bits = min(63, 30 + max(1, rows).bit_length())  # chance meetings of blocks stay rare; they only add candidates
    while True:
        about = scratch.keep(_described(texts, width, num, den, spread, tiny, bits), "sketches")
        if (about.agg(F.min("worst")).first()[0] or 1) >= 1:
            break
        spread *= 2  # more blocks, of which fewer are shared by several shingles
    same = ["n_shingles", "s1", "s2"]
    # A node is a distinct set, named by its hash, as ids can be null or repeat; equal sets have equal sketches.
    kinds = about.where("n_shingles > 0").groupBy(*same).agg(F.min(F.struct("kid", "th")).alias("rep"), F.min("id").alias("first"))
    owner = scratch.keep(kinds.select(F.xxhash64(*same).alias("node"), "rep.*", "first", *same), "nodes")
    rarest = scratch.keep(_blocks(_shared(about, rows), num, den), "rarest")
    wide, about = about, scratch.keep(about.select("id", "th", *same), "sizes")
    scratch.drop(wide)
    blocks = scratch.keep(_centred(rarest), "blocks")
    pairs = scratch.keep(_candidates(blocks, small, num, den), "pairs")
    links = scratch.keep(_verified(pairs, texts, owner, width, num, den, scratch), "links")
    links, roots = _leftover(blocks, pairs, links, texts, owner, width, num, den, few, scratch)
    named = _rooted(owner.select("node", "first", *same), roots)
    low = roots.join(owner.select("node", "first"), "node").groupBy("root").agg(F.min("first").alias("low"))
    named = named.join(low, "root", "left").select(*same, "root", F.coalesce("low", "first").alias("component_id"))
    member = about.select("id", "th", *same).join(named, same, "left")
    found = member.select("id", "th", "n_shingles", "root", F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return scratch.result(found, "components")


def _leftover(blocks, pairs, links, texts, owner, width, num, den, few, scratch):
    """Settle the blocks that still hold several components after the first comparison.

    Blocks of up to ``few`` sets are compared pair by pair. The sets of the others,
    which share passages without being alike, go to the narrow size bands, and what
    is open there is compared.
    """
    roots = scratch.add(components(links, "a", "b"))
    rows, about = (scratch.keep(x, "open") for x in _open(blocks, roots))
    light = about.where(F.col("s") <= few)
    more = scratch.keep(_between(rows, light, _by_blocks, num, den).join(pairs, ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        links = scratch.keep(links.union(_verified(more, texts, owner, width, num, den, scratch)), "links")
        roots = scratch.add(components(links, "a", "b"))
    heavy = about.where(F.col("s") > few).select("key")
    nodes = scratch.keep(_open(rows.join(heavy, "key"), roots)[0].select("node").distinct(), "rest")
    if nodes.isEmpty():
        return links, roots
    rows, about = (scratch.keep(x, "open") for x in _open(scratch.keep(_by_shingles(nodes, texts, owner, width, num, den, scratch), "rare"), roots))
    last = scratch.keep(_between(rows, about, _by_overlap, num, den).join(pairs.union(more), ["a", "b"], "left_anti"), "pairs")
    if not last.isEmpty():
        links = scratch.keep(links.union(_verified(last, texts, owner, width, num, den, scratch)), "links")
        roots = scratch.add(components(links, "a", "b"))
    return links, roots


def keep_first_of_each(docs: DataFrame, **options) -> DataFrame:
    """The row of ``docs`` with the smallest id of each component; columns stay.

    Rows with a null id stay: they have no order among themselves. A row that
    repeats an id and text stays once; texts of one id are told apart, so that
    none goes because another text of its id does.
    """
    (th,) = fresh(docs, "_th")
    found = _assigned(docs, "doc_id", "text", **options).where("id is not null")
    linked = found.where("root is not null").groupBy("root").agg(F.min(F.struct("id", "th")).alias("x")).select("x.*")
    first = linked.union(found.where("root is null").select("id", "th")).select(F.col("id").alias("doc_id"), F.col("th").alias(th))
    named = docs.where("doc_id is not null").withColumn(th, F.xxhash64(F.coalesce("text", F.lit(""))))
    return docs.where("doc_id is null").unionByName(named.join(first, ["doc_id", th], "left_semi").dropDuplicates(["doc_id", th]).drop(th))
