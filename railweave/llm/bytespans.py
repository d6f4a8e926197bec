"""Operator 5, exact substring removal by bytes (prefix-free parsing).

Triggers of a rolling hash cut texts into phrases; a place is a trigger if its
gram hash is the smallest among ``reach`` places, so a phrase is never longer
than that and the cuts depend on the text around them alone. As in prefix-free
parsing each phrase runs on past its end, here by the window width, so that a
phrase tells all windows starting in it. Phrases whose trigger context occurs
once hold no repeat and leave at once. Of the others

* the dictionary has each distinct phrase once, and its suffix array is made, in
  buckets of trigger contexts: all suffixes that start in the phrase proper,
  ordered by context and then by their bytes to the depth of a window;
* the parse is ordered by phrase, which gives each its number of uses. As phrases
  overlap by a whole window, no tie is left that the phrases after one would have
  to break, so the order of the parse needs no deeper than its first phrase.

Together they are the order of the corpus to the depth of a window: a string
repeats if its phrase is used twice or a neighbour in the suffix array is equal.
Very common contexts are counted by hash instead (see ``repeats``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from railweave.llm import repeats as R
from railweave.llm.rolling import BYTE_SYMBOL, byte_symbols, regions
from railweave.llm.store import Scratch

REACH, GRAM = 64, 16


def parse(texts: DataFrame, width: int, piece: int = 1 << 20, bits: int = 63) -> DataFrame:
    """Phrases of all texts as regions, contexts cut to ``bits`` bits; texts beyond ``piece`` bytes go piece by piece."""

    def cut(batches):
        for batch in batches:
            kid, th, bodies = batch.column("kid").to_numpy(), batch.column("th").to_numpy(), batch.column("body").to_pylist()
            jobs = [(i, at, bodies[i][at : at + piece + width - 1]) for i in range(len(bodies)) for at in range(0, max(1, len(bodies[i]) - width + 1), piece)]
            for low, high in R.chunks([len(x[2]) for x in jobs], piece):
                part = jobs[low:high]
                sizes = np.array([len(x[2]) for x in part])
                ends = np.cumsum(sizes)
                good = np.zeros(ends[-1], bool)
                for end, size in zip(ends, sizes, strict=True):
                    if size >= width:
                        good[end - size : end - width + 1] = True
                a, n, k, e = regions(byte_symbols(b"".join(x[2] for x in part)), np.flatnonzero(good), width, REACH, GRAM)
                if len(a):
                    own = np.searchsorted(ends, a, side="right")
                    row = np.array([x[0] for x in part])[own]
                    yield R.region_batch(kid[row], th[row], a - (ends - sizes)[own] + np.array([x[1] for x in part])[own], n, k >> np.uint64(64 - bits), e)

    return texts.mapInArrow(cut, R.REGION)


def raw_bytes(body: bytes) -> np.ndarray:
    return np.frombuffer(body, np.uint8)


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200) -> DataFrame:
    """Cut every byte covered by a ``width``-byte string that also starts elsewhere.

    Returns (id_col, n_bytes, n_removed, n_spans, kept binary), one row per input
    row. All copies go, the first too; matches stay within a document; strings are
    judged on the input. Null texts are empty. Rows that repeat id and text are
    copies of each other. Other columns of ``docs`` are ignored, so their names
    can't clash. Texts of any length are read whole; an empty table gives an
    empty result.
    """
    scratch = Scratch()
    texts = R.keyed(docs, id_col, text_col)
    packed = R.squeezed(texts)
    bits = min(63, 22 + docs.count().bit_length())  # contexts that meet by chance stay rare; they are told apart later
    runs = scratch.result(R.covered(parse(texts, width, bits=bits), texts, raw_bytes, lambda raw: BYTE_SYMBOL[raw], width, False, scratch), "runs")

    def cut(batches):
        for batch in batches:
            ids, size, removed, spans, kept = batch.column("id"), [], [], [], []
            for body, items in zip(batch.column("body").to_pylist(), batch.column("items"), strict=True):
                data = np.frombuffer(R.unsqueeze(body), np.uint8)
                out = R.gone(items.values if items.is_valid else None, len(data), width)
                size.append(len(data))
                removed.append(int(out.sum()))
                spans.append(int(out[:1].sum() + (out[1:] & ~out[:-1]).sum()))
                kept.append(data[~out].tobytes())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (size, removed, spans)), pa.array(kept, pa.binary())], [id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    return R.with_text(runs, packed, "left").select("id", "body", "items").mapInArrow(cut, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept binary")
