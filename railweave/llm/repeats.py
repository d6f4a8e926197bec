"""Shared second half of the two exact repeat removers: settle repeated windows.

Both removers parse texts into phrases (regions, see ``rolling.regions``): rows
(kid, th, a, n, k, e) for n consecutive window starts from a, k being the hash of
the trigger's context, which all windows of the phrase share, and e the hash of
everything they cover. A phrase runs on past its last start by the rest of a
window, so that it tells all its windows without the phrases after it. Equal
windows always lie in phrases of one k, so

* a k seen once holds no repeated window (dropped by a partial aggregate);
* a k with one e: its phrases are copies of each other, whole;
* otherwise the dictionary holds one phrase for each (k, e), with its number of
  uses in the parse, and its suffixes are put in order, to the depth of a window:
  by k, then by their symbols. Equal windows are then neighbours.

The dictionary is sorted in buckets of k, each small enough for a task. A context
with more windows than ``MOST`` is not: its windows are named by their hashes and
counted with partial aggregates. Other groups are only ever counted or reduced to
a minimum before the shuffle; the joins back are plain equi-joins, which adaptive
execution splits when a key is hot. Texts are keyed by (kid, th): the id, or
the smallest long if it is null, and the hash of the text, so rows that repeat
both are treated alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railweave.llm.rolling import mix, prefix, span, within
from railweave.llm.store import Scratch

KEY = ["kid", "th"]
REGION = "kid long, th long, a long, n long, k long, e long"
#: Windows of one context, and of one bucket of contexts on average, that are sorted in a task.
MOST, BUCKET = 1 << 17, 1 << 16


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(kid, th, id, body): body the UTF-8 bytes of the text, empty for null."""
    body = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("kid"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(id_col).cast("long").alias("id"), body.alias("body"))


#: Bits of the key filter, so that it has at most 512 KiB whatever the data.
FILTER_BITS = 1 << 22


def key_filter(keys: DataFrame) -> np.ndarray:
    """A bitmap of ``FILTER_BITS`` bits with a bit set for each (kid, th).

    It is made by partial aggregates; at most 129 rows of 4 KiB come to the driver.
    Keys that aren't there mostly miss; when there are too many keys for that, all pass.
    """
    bit = F.pmod(F.xxhash64(*KEY), F.lit(FILTER_BITS))
    rows = keys.select(bit.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
    out = np.zeros((FILTER_BITS // 32768 + 2, 4096), np.uint8)
    for row in rows.collect():
        out[row["n"]] = np.frombuffer(row["bits"], np.uint8)
    return out


def squeezed(texts: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """The same rows with zstd-compressed bodies, for shuffles of whole texts.

    With ``keys`` rows that surely aren't among them are left out beforehand, so
    that a join with a few documents doesn't shuffle all texts.
    """
    filtered = keys is not None
    if filtered:
        bits = texts.sparkSession.sparkContext.broadcast(key_filter(keys))
        texts = texts.withColumn("_b", F.pmod(F.xxhash64(*KEY), F.lit(FILTER_BITS))).select("kid", "th", "id", "body", F.bitmap_bucket_number("_b").alias("_n"), F.bitmap_bit_position("_b").alias("_p"))

    def pack(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            if filtered:
                n, at = (batch.column(x).to_numpy() for x in ("_n", "_p"))
                batch = batch.filter(pa.array((bits.value[n, at >> 3] >> (at & 7)) & 1 == 1))
            bodies = pa.array([press.compress(x) for x in batch.column("body").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("kid"), batch.column("th"), batch.column("id"), bodies], ["kid", "th", "id", "body"])

    return texts.mapInArrow(pack, "kid long, th long, id long, body binary")


def with_text(lists: DataFrame, texts: DataFrame, how: str = "inner") -> DataFrame:
    """Bring per-document lists (kid, th, items) to the compressed texts."""
    return texts.join(lists, KEY, how)


def unsqueeze(body: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompressobj().decompress(body)


def chunks(sizes: list[int], most: int):
    """Ranges of row numbers whose sizes add up to at most ``most``, or one row."""
    at = total = 0
    for i, size in enumerate(sizes):
        if i > at and total + size > most:
            yield at, i
            at, total = i, 0
        total += size
    if at < len(sizes):
        yield at, len(sizes)


def region_batch(kid, th, a, n, k, e) -> pa.RecordBatch:
    arrays = [pa.array(np.asarray(x, np.int64)) for x in (kid, th, a, n)] + [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (k, e)]
    return pa.RecordBatch.from_arrays(arrays, ["kid", "th", "a", "n", "k", "e"])


def suffix_order(table: pa.Table, width: int, item: int, first_stays: bool) -> pa.Table:
    """Runs (kid, th, a, n) of repeated windows, from the suffix array of a bucket of dictionary phrases.

    ``table``: (kid, th, a, k, open, body), bodies of ``item`` bytes a symbol. Each
    suffix is cut to ``width`` symbols and follows its k. Only windows of open
    phrases are told; with ``first_stays`` not the first of equal ones.
    """
    table = table.sort_by([(x, "ascending") for x in ("kid", "th", "a")])
    kid, th, a = (table[x].to_numpy() for x in ("kid", "th", "a"))
    # A row that repeats id and text has brought its phrases again.
    once = np.append(True, (kid[1:] != kid[:-1]) | (th[1:] != th[:-1]) | (a[1:] != a[:-1]))[: len(a)]
    table = table.filter(pa.array(once))
    kid, th, a, k = (table[x].to_numpy() for x in ("kid", "th", "a", "k"))
    bodies = table["body"].to_pylist()
    size = np.fromiter(map(len, bodies), np.int64, len(bodies))
    n = size // item - width + 1
    own = np.repeat(np.arange(len(n)), n)
    at = np.repeat(np.cumsum(size) - size, n) + within(n) * item
    text = np.frombuffer(b"".join(bodies), np.uint8)
    suffix = np.empty((len(at), 8 + width * item), np.uint8)
    suffix[:, :8] = k.astype(">i8").view(np.uint8).reshape(-1, 8)[own]
    suffix[:, 8:] = np.lib.stride_tricks.sliding_window_view(text, width * item)[at]
    order = np.argsort(suffix.view(f"S{suffix.shape[1]}").ravel(), kind="stable")
    ranked = suffix[order]
    same = (ranked[1:] == ranked[:-1]).all(1)
    after, before = np.append(False, same), np.append(same, False)
    hit = np.zeros(len(at), bool)
    hit[order[after if first_stays else after | before]] = True
    hit &= table["open"].to_numpy()[own]
    edge = np.ones(len(at), bool)
    edge[1:] = (own[1:] != own[:-1]) | (hit[1:] != hit[:-1])
    start = np.flatnonzero(edge)
    length = np.diff(np.append(start, len(at)))[hit[start]]
    start = start[hit[start]]
    row = own[start]
    return pa.table({"kid": kid[row], "th": th[row], "a": a[row] + within(n)[start], "n": length})


def covered(found: DataFrame, texts: DataFrame, raw_of, symbols_of, width: int, first_stays: bool, scratch: Scratch) -> DataFrame:
    """(kid, th, items array<struct<a,n>>): runs of window starts that are repeats.

    ``texts``: rows of :func:`keyed`. ``found``: phrases. ``raw_of(bytes)`` gives a
    text's symbols as they are compared, ``symbols_of(raw)`` as they are hashed. With
    ``first_stays`` the earliest window of equal ones, by (kid, th, start), is
    not a repeat; without, every window that has an equal one is.
    """
    item = raw_of(b"").itemsize
    place = F.struct("kid", "th", "a")
    first = [F.min(place).alias("first")] * first_stays
    # Written first, so that the join deals out both sides anew and a hot key can be split.
    seen = scratch.keep(found.groupBy("k").agg(F.count("*").alias("seen"), F.min("e").alias("low"), F.max("e").alias("high"), *first).where("seen >= 2").drop("seen"), "seen")
    cand = scratch.keep(found.join(seen, "k"), "regions")
    away = place != F.col("first") if first_stays else F.lit(True)
    plain = cand.where((F.col("low") == F.col("high")) & away).select(*KEY, "a", "n")
    mixed = cand.where("low <> high")
    kinds = scratch.keep(mixed.groupBy("k", "e").agg(F.count("*").alias("copies"), F.min(F.struct("kid", "th", "a", "n")).alias("rep")), "kinds")
    rep = kinds.where("copies >= 2").select("k", "e", F.col("rep.kid").alias("rk"), F.col("rep.th").alias("rt"), F.col("rep.a").alias("ra"))
    solid = mixed.join(rep, ["k", "e"]).where(~((F.col("kid") == F.col("rk")) & (F.col("th") == F.col("rt")) & (F.col("a") == F.col("ra"))) if first_stays else F.lit(True)).select(*KEY, "a", "n")
    wanted = F.lit(True) if first_stays else F.col("copies") == 1
    opened = kinds.select("k", wanted.alias("open"), "rep.*")
    sizes = opened.groupBy("k").agg(F.sum("n").alias("windows"), F.bool_or("open").alias("any")).where("any").select("k", "windows")
    opened = opened.join(sizes, "k").withColumn("hot", F.col("windows") > MOST).drop("windows")
    lists = scratch.keep(opened.groupBy(*KEY).agg(F.collect_list(F.struct("a", "n", "k", "open", "hot")).alias("items")), "lists")
    windows = lists.agg(F.sum(F.aggregate("items", F.lit(0).cast("long"), lambda x, y: x + y["n"]))).first()[0] or 0

    def phrases(batches):
        for batch in batches:
            for kid, th, body, items in zip(batch.column("kid").to_pylist(), batch.column("th").to_pylist(), batch.column("body").to_pylist(), batch.column("items"), strict=True):
                flat = items.values
                a, n, k = (flat.field(x).to_numpy() for x in ("a", "n", "k"))
                wants, hot = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("open", "hot"))
                raw = raw_of(unsqueeze(body))
                yield _rows(kid, th, a[~hot], k[~hot], wants[~hot], bodies=[raw[x : x + y + width - 1].tobytes() for x, y in zip(a[~hot].tolist(), n[~hot].tolist(), strict=True)])
                if hot.any():
                    a, n, k = a[hot], n[hot], k[hot]
                    at = np.repeat(a, n) + within(n)
                    name = mix(span(prefix(symbols_of(raw)), at, width) + np.repeat(k, n).view(np.uint64))
                    yield _rows(kid, th, at, np.repeat(k, n), np.repeat(wants[hot], n), names=name.view(np.int64))

    found = scratch.keep(with_text(lists, squeezed(texts, lists)).mapInArrow(gathered(phrases), "kid long, th long, a long, k long, open boolean, h long, body binary"), "phrases")
    dealt = found.where("body IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("k"), F.lit(max(1, windows // BUCKET))))
    ordered = dealt.select("part", *KEY, "a", "k", "open", "body").groupBy("part").applyInArrow(lambda t: suffix_order(t, width, item, first_stays), "kid long, th long, a long, n long")
    single = found.where("body IS NULL").dropDuplicates([*KEY, "a"])
    twice = single.groupBy("k", "h").agg(F.count("*").alias("seen"), *first).where("seen >= 2").drop("seen")
    loose = single.where("open").join(twice, ["k", "h"]).where(away).select(*KEY, "a", F.lit(1).cast("long").alias("n"))
    runs = plain.unionByName(solid).unionByName(ordered).unionByName(loose)
    return runs.groupBy(*KEY).agg(F.collect_list(F.struct("a", "n")).alias("items"))


def _rows(kid: int, th: int, a: np.ndarray, k: np.ndarray, wants: np.ndarray, names: np.ndarray | None = None, bodies: list[bytes] | None = None) -> pa.RecordBatch:
    size = len(a)
    none = [None] * size
    arrays = [pa.array(np.full(size, kid, np.int64)), pa.array(np.full(size, th, np.int64)), pa.array(a.astype(np.int64)), pa.array(k), pa.array(wants, pa.bool_()), pa.array(none if names is None else names, pa.int64()), pa.array(bodies or none, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["kid", "th", "a", "k", "open", "h", "body"])


def gathered(make, rows: int = 20_000):
    """Join the small record batches of ``make`` to larger ones."""

    def run(batches):
        held, size = [], 0
        for batch in make(batches):
            held.append(batch)
            size += batch.num_rows
            if size >= rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
        if size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return run


def gone(items, size: int, width: int) -> np.ndarray:
    """Which of ``size`` symbols are covered by the windows of the runs."""
    step = np.zeros(size + 1, np.int32)
    if items is not None and len(items):
        a, n = (items.field(x).to_numpy() for x in ("a", "n"))
        np.add.at(step, a, 1)
        np.add.at(step, a + n - 1 + width, -1)
    return np.cumsum(step[:-1]) > 0
