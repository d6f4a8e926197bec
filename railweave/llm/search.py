"""Operator 12, ranked lexical search by accumulator-limited term-at-a-time scoring.

Documents are read once into an inverted index of blocks: of each block of
documents and each term of a query, the documents and term counts. Statistics of
all documents (how many, how long, how many hold a term) come from the index by
partial aggregates. Blocks are then dealt to shards, and every query visits every
shard, in blocks of queries.

In a shard the terms of a query go rarest first. Each opens accumulators for its
documents until what the remaining terms can add at most, by their largest score
in the shard, stays below the k-th best partial score: a document without an
accumulator can't enter the result any more. The remaining terms update only the
accumulators that can still enter, and these get their exact scores. The k best of
all shards are ranked together.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railweave.llm.store import Scratch

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
TERM_SQL = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of the filter of query terms, so that it has 512 KiB whatever the queries.
FILTER_BITS = 1 << 22
#: Documents and bytes of text of one block of the index, at least one document.
BLOCK_DOCS, BLOCK_BYTES = 4096, 8 << 20
#: Documents and terms of a shard on average, and items of a block of queries.
SHARD_DOCS, SHARD_TERMS, QUERY_BLOCK = 1 << 14, 1 << 22, 1 << 12


def query_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, term): the distinct terms of each item; rows of one id are one item."""
    text = F.translate(F.col(text_col), CAPITALS, SMALL)
    return items.select(F.col(item_col).alias("item"), F.explode(F.regexp_extract_all(text, F.lit(TERM_SQL), F.lit(0))).alias("term")).distinct()


def term_filter(terms: DataFrame) -> np.ndarray:
    """A bitmap with a bit set for each term; at most 129 rows of 4 KiB come to the driver."""
    bit = F.crc32(F.col("term").cast("binary")) % FILTER_BITS + 1
    rows = terms.select(bit.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
    out = np.zeros((FILTER_BITS // 32768 + 2, 4096), np.uint8)
    for row in rows.collect():
        out[row["n"]] = np.frombuffer(row["bits"], np.uint8)
    return out


def index_blocks(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, term, a, b): of each block and term the places of documents and counts.

    One row of a block without a term has all its document ids and their numbers of
    terms. Only terms that pass the filter of query terms are kept.
    """
    bits = docs.sparkSession.sparkContext.broadcast(term_filter(terms))
    schema = pa.schema([("block", pa.int64()), ("term", pa.string()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int32()))])

    def run(batches):
        known: dict[bytes, bool] = {}

        def wanted(term: bytes) -> bool:
            have = known.get(term)
            if have is None:
                bucket, at = divmod(zlib.crc32(term) % FILTER_BITS, 32768)  # numbered from 1
                have = bool(bits.value[bucket + 1, at >> 3] >> (at & 7) & 1)
                if len(known) > 1 << 18:
                    known.clear()
                known[term] = have
            return have

        block, ids, sizes, lists, room = TaskContext.get().partitionId() << 33, [], [], {}, BLOCK_BYTES

        def full():
            names = list(lists)
            rows = [ids, *([p for p, _ in lists[t]] for t in names)], [sizes, *([c for _, c in lists[t]] for t in names)]
            return pa.RecordBatch.from_arrays([pa.array([block] * (len(names) + 1), pa.int64()), pa.array([None, *(t.decode() for t in names)], pa.string()), pa.array(rows[0], schema.field("a").type), pa.array(rows[1], schema.field("b").type)], schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = (text.as_py() or "").encode().lower()
                counts = Counter(TERM.findall(body))
                for term, n in counts.items():
                    if wanted(term):
                        lists.setdefault(term, []).append((len(ids), n))
                ids.append(doc)
                sizes.append(counts.total())
                room -= len(body)
                if room <= 0 or len(ids) >= BLOCK_DOCS:
                    yield full()
                    block, ids, sizes, lists, room = block + 1, [], [], {}, BLOCK_BYTES
        if ids:
            yield full()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "block long, term string, a array<bigint>, b array<int>")


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and list lengths of a list column."""
    one = column.combine_chunks()
    return one.flatten().to_numpy(zero_copy_only=False), np.diff(one.offsets.to_numpy())


class Shard:
    """The index of one shard: document ids, and for each term its documents and their term scores."""

    def __init__(self, rows: pa.Table, n_docs: int, n_terms: int):
        named = rows.column("term").is_valid().to_numpy()
        block, wide = rows.column("block").to_numpy(), np.flatnonzero(~named)
        docs = rows.take(pa.array(wide))
        sizes, counts = _lists(docs.column("b"))
        self.ids = docs.column("a").combine_chunks().flatten()
        m = 10 + (90 * sizes.astype(np.int64) * n_docs) // max(1, n_terms)
        begin = dict(zip(block[wide].tolist(), (np.cumsum(counts) - counts).tolist(), strict=True))
        lists = rows.take(pa.array(np.flatnonzero(named)))
        codes = lists.column("term").combine_chunks().dictionary_encode()
        place, length = _lists(lists.column("a"))
        tf = _lists(lists.column("b"))[0].astype(np.int64)
        shift = np.array([begin[b] for b in lists.column("block").to_pylist()], np.int64)
        place = place.astype(np.int64) + np.repeat(shift, length)
        score = (1000000000 * tf) // (1000 * tf + 8 * m[place])
        code = np.repeat(codes.indices.to_numpy(), length)
        order = np.argsort(code, kind="stable")
        self.place, self.score = place[order], score[order]
        ends = np.cumsum(np.bincount(code, minlength=len(codes.dictionary)))
        self.terms = {t: (lo, hi) for t, lo, hi in zip(codes.dictionary.to_pylist(), np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)}
        self.acc = np.zeros(len(self.ids), np.int64)
        null = self.ids.is_null().to_numpy(zero_copy_only=False)
        self.order = np.lexsort((self.ids.fill_null(0).to_numpy(), ~null))
        self.nth = np.empty(len(self.order), np.int64)
        self.nth[self.order] = np.arange(len(self.order))

    def best(self, terms: list[tuple[int, str, int]], k: int) -> list[tuple[int, int]]:
        """(place, score) of the k best documents, for terms (documents, term, weight) rarest first."""
        acc = self.acc
        held = [(w, *self.terms[t]) for _, t, w in terms if w > 0 and t in self.terms]
        most = np.array([w * int(self.score[lo:hi].max()) for w, lo, hi in held], np.int64)
        rest = np.append(np.cumsum(most[::-1])[::-1], 0)
        opened, alive, high = [], None, 0
        for i, (w, lo, hi) in enumerate(held):
            place, add = self.place[lo:hi], self.score[lo:hi] * w
            if alive is None:
                acc[place] += add
                opened.append(place)
                high = max(high, int(acc[place].max()))
                left = rest[i + 1]
                if left >= high:
                    continue
                made = np.unique(np.concatenate(opened))
                if len(made) < k:
                    continue
                least = np.partition(acc[made], len(made) - k)[len(made) - k]
                if left < least:
                    alive = np.zeros(len(acc), bool)
                    alive[made[acc[made] + left >= least]] = True
            else:
                on = alive[place]
                acc[place[on]] += add[on]
        made = np.unique(np.concatenate(opened)) if opened else np.zeros(0, np.int64)
        pick = made if alive is None else made[alive[made]]
        if len(pick) > k:
            least = np.partition(acc[pick], len(pick) - k)[len(pick) - k]
            pick = pick[acc[pick] >= least]
        pick = pick[np.lexsort((self.nth[pick], -acc[pick]))][:k]
        out = list(zip(pick.tolist(), acc[pick].tolist(), strict=True))
        acc[made] = 0
        return [x for x in out if x[1] > 0]


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """The ``k`` best documents of each query: (item_col, rank, doc_id, score), scores above 0 only.

    Rows of ``items`` with one id are one query with the terms of all their texts.
    Null and empty texts, as queries or documents, have no terms and no results.
    Equal scores go by ascending doc_id, null first; rows that repeat a document
    are results of their own. Texts are read whole; empty tables give an empty result.
    Other columns are ignored, so their names can't clash. A shard holds a bounded
    number of blocks on average, whatever a term's number of documents.
    """
    scratch = Scratch()
    queries = scratch.keep(query_terms(items, item_col, query_col), "query-terms")
    index = scratch.keep(index_blocks(docs, queries, id_col, text_col), "index")
    wide = index.where("term IS NULL")
    total = wide.agg(F.sum(F.size("a")).alias("rows"), F.sum(F.size(F.filter("b", lambda n: n > 0))).alias("docs"), F.sum(F.aggregate("b", F.lit(0).cast("long"), lambda s, n: s + n)).alias("terms")).first()
    rows, n_docs, n_terms = total["rows"] or 0, total["docs"] or 0, total["terms"] or 0
    shards = max(1, -(-rows // SHARD_DOCS), -(-n_terms // SHARD_TERMS))
    held = index.where("term IS NOT NULL").groupBy("term").agg(F.sum(F.size("a")).alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double")))
    told = queries.join(held, "term").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("df", "term", weight.cast("long").alias("w")))).alias("terms"))
    told = scratch.keep(told, "queries")
    query_blocks = max(1, -(-told.count() // QUERY_BLOCK))
    own = lambda c: F.pmod(F.xxhash64(c), F.lit(shards)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("shard", own("block")).withColumn("qb", every(query_blocks))
    right = told.withColumn("qb", F.pmod(F.xxhash64("item"), F.lit(query_blocks)).cast("int")).withColumn("shard", every(shards))
    kind = items.schema[item_col].dataType
    schema = pa.schema([("item", told.select("item").limit(0).toArrow().schema.field("item").type), ("doc_id", pa.int64()), ("score", pa.int64())])

    def search(_, blocks: pa.Table, asked: pa.Table) -> pa.Table:
        if not blocks.num_rows or not asked.num_rows:
            return schema.empty_table()
        shard = Shard(blocks, n_docs, n_terms)
        item, place, score = [], [], []
        for at, terms in enumerate(asked.column("terms")):
            found = shard.best([(x["df"], x["term"], x["w"]) for x in terms.as_py()], k)
            item += [at] * len(found)
            place += [p for p, _ in found]
            score += [s for _, s in found]
        named = asked.column("item").take(pa.array(item, pa.int64()))
        return pa.table([named, shard.ids.take(pa.array(place, pa.int64())), pa.array(score, pa.int64())], schema=schema)

    found = left.groupBy("shard", "qb").cogroup(right.groupBy("shard", "qb")).applyInArrow(search, f"item {kind.simpleString()}, doc_id long, score long")
    nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    best = found.withColumn("rank", nth).where(F.col("rank") <= k)
    return scratch.result(best.select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked")
