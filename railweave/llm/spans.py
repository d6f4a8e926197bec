"""Operator 3, exact substring removal by words (difference-cover anchors).

Words at positions whose remainder by ``period`` lies in ``cover`` start an
anchor of ``width - period + 1`` words. Every remainder difference occurs in the
cover, so two equal windows of ``width`` words, wherever they start, share an
anchor at one and the same distance from their starts. Anchors seen once are
dropped; the windows around the others are extended to the full width, whole
phrases of them at once, and compared in order. With period 13, four of 13
positions are hashed.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railweave.llm import repeats as R
from railweave.llm.rolling import joined_words, prefix, regions, span, within, word_hashes
from railweave.llm.store import Scratch

#: Perfect difference cover: each difference modulo 13 occurs exactly once.
PERIOD, COVER = 13, (0, 1, 3, 9)


def anchors(texts: DataFrame, width: int, period: int, cover: tuple[int, ...], bits: int) -> DataFrame:
    """(kid, th, p, h): hashes of the anchors, cut to ``bits`` bits."""
    size = width - period + 1
    drop = np.uint64(64 - bits)
    covers = np.isin(np.arange(period), cover)

    def hashed(batches):
        for batch in batches:
            kid, th, bodies = batch.column("kid").to_numpy(), batch.column("th").to_numpy(), batch.column("body").to_pylist()
            for low, high in R.chunks([len(x) for x in bodies], 1 << 20):
                # Short texts together, a long one on its own, piece by piece.
                if high - low == 1:
                    words = word_hashes(bodies[low])
                    counts = np.array([len(words)])
                else:
                    words, counts = joined_words(bodies[low:high])
                own, place = np.repeat(np.arange(low, high), counts), within(counts)
                of = np.repeat(counts, counts)
                at = np.flatnonzero((of >= width) & (place <= of - size) & covers[place % period])
                if len(at):
                    h = span(prefix(words), at, size) >> drop
                    yield pa.RecordBatch.from_arrays([pa.array(kid[own[at]]), pa.array(th[own[at]]), pa.array(place[at].astype(np.int32)), pa.array(h.view(np.int64))], ["kid", "th", "p", "h"])

    return texts.mapInArrow(R.gathered(hashed), "kid long, th long, p int, h long")


def remove_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """Cut words that lie in a window of ``width`` words seen earlier.

    Returns (id_col, n_words, n_removed, kept_text), one row per input row.
    Earlier means a smaller id (null before all), then an earlier start. Windows
    are judged on the input. Null and empty texts have no words. Rows that repeat
    both id and text count as one occurrence and get equal results; other columns
    of ``docs`` are ignored, so their names can't clash. Texts of any length are
    read whole; an empty table gives an empty result.
    """
    scratch = Scratch()
    texts = R.keyed(docs, id_col, text_col)
    packed = R.squeezed(texts)
    # Enough hash bits that chance meetings stay near 1 % of the anchors; they only add candidates.
    volume = texts.agg(F.sum(F.length("body"))).first()[0] or 0
    bits = min(63, max(24, int(np.ceil(np.log2(volume + 2))) + 3))
    marks = anchors(texts, width, period, cover, bits)
    again = marks.groupBy("h").agg(F.count("*").alias("seen")).where("seen >= 2").select("h")
    # The keys seen again are distinct, so a hash table of them is small in each task and the marks need no sort.
    lists = marks.join(again.hint("shuffle_hash"), "h").groupBy(*R.KEY).agg(F.collect_list("p").alias("items"))

    def around(batches):
        for batch in batches:
            for kid, th, body, items in zip(batch.column("kid").to_pylist(), batch.column("th").to_pylist(), batch.column("body").to_pylist(), batch.column("items"), strict=True):
                words = word_hashes(R.unsqueeze(body))
                step = np.zeros(len(words) + 1, np.int32)
                p = items.values.to_numpy()
                np.add.at(step, np.maximum(p - period + 1, 0), 1)
                np.add.at(step, p + 1, -1)
                starts = np.flatnonzero(np.cumsum(step[: max(0, len(words) - width + 1)]) > 0)
                a, n, k, e = regions(words, starts, width, reach=16, gram=5)
                if len(a):
                    yield R.region_batch(np.full(len(a), kid), np.full(len(a), th), a, n, k, e)

    found = scratch.keep(R.with_text(lists, packed).mapInArrow(R.gathered(around), R.REGION), "found")
    runs = scratch.result(R.covered(found, texts, word_hashes, lambda words: words, width, True, scratch), "runs")

    def cut(batches):
        for batch in batches:
            ids, counts, removed, kept = batch.column("id"), [], [], []
            for body, items in zip(batch.column("body").to_pylist(), batch.column("items"), strict=True):
                # bytes.split() parts at space and the control characters 9 to 13.
                words = R.unsqueeze(body).split()
                out = R.gone(items.values, len(words), width) if items.is_valid else None
                counts.append(len(words))
                removed.append(0 if out is None else int(out.sum()))
                kept.append(b" ".join(words if out is None else compress(words, (~out).tolist())).decode())
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.large_string()).cast(pa.string())], [id_col, "n_words", "n_removed", "kept_text"])

    return R.with_text(runs, packed, "left").select("id", "body", "items").mapInArrow(cut, f"`{id_col}` long, n_words long, n_removed long, kept_text string")


def digest(kept: str) -> str:
    return hashlib.sha256(kept.encode()).hexdigest()
