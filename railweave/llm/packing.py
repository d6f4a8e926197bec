"""Operator 2, packing token sequences by Karmarkar-Karp multiway differencing.

Each task packs the documents it reads, bin load by bin load, so nothing is
shuffled and no task sees more than its input split. A document's whole windows
are sequences of their own. What is left is cut into pieces of at most ``piece``
tokens, or by halves for every second document, as sums level out only if there
are pieces of every scale. As soon as ``load`` windows' worth has come together the pieces are
partitioned: partial partitions start with one piece each, the two with the
largest imbalance are merged largest sum to smallest, and the last one left holds
near-equal windows. If a window exceeds the capacity, one more is opened.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], ways: int) -> list[list[int]]:
    """Partition pieces into ``ways`` sets of near-equal sums; sets of piece numbers."""
    heap, made = [], 0
    for i, size in enumerate(sizes):
        heap.append((-size if ways > 1 else 0, made, [(size, (i,))]))
        made += 1
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, one = heapq.heappop(heap)
        _, _, two = heapq.heappop(heap)
        spare = len(one) + len(two) - ways
        if spare <= 0:
            merged = one + two
        else:
            # Sums fall; the smallest of one side meet the largest of the other.
            one.sort(key=lambda x: -x[0])
            two.sort(key=lambda x: -x[0])
            tail = one[len(one) - spare :]
            head = two[:spare][::-1]
            met = [(a[0] + b[0], (a[1], b[1])) for a, b in zip(tail, head, strict=True)]
            merged = one[: len(one) - spare] + met + two[spare:]
        sums = [x[0] for x in merged]
        low = min(sums) if len(merged) == ways else 0
        heapq.heappush(heap, (low - max(sums), made, merged))
        made += 1
    out = []
    for _, tree in heap[0][2] if heap else []:
        flat, todo = [], [tree]
        while todo:
            x = todo.pop()
            if len(x) == 1:
                flat.append(x[0])
            else:
                todo += x
        out.append(sorted(flat))
    return out


def cuts(rest: int, piece: int, least: int = 8) -> list[int]:
    """Piece sizes of a remainder: equal ones, or with ``piece`` 0 halves down to ``least``."""
    if piece:
        parts = -(-rest // piece)
        edge = [rest * i // parts for i in range(parts + 1)] if parts else []
        return [b - a for a, b in zip(edge, edge[1:], strict=False)]
    out = []
    while rest >= 2 * least:
        out.append(rest - rest // 2)
        rest //= 2
    return [*out, rest] if rest else out


def fill(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of piece numbers, none above ``capacity``; as few as differencing manages."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = difference(sizes, ways)
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return windows
        ways += 1


_encoders: dict[tuple, object] = {}


def token_ids(texts: list[str], name: str = "byte_bpe_50k", folder: str | None = None) -> list[np.ndarray]:
    """Ids of the named public vocabulary, no special tokens added.

    ``tiktoken`` reads the same vocabulary as ``tokenizers`` and gives the same
    ids several times faster; a text that spells a special token, which the
    tokenizer file maps to one id, goes to ``tokenizers`` itself.
    """
    import base64
    import os

    import public_tokenizers as public

    where = (lambda x: os.path.join(folder, x)) if folder else public.path
    if (name, folder) not in _encoders:
        import tiktoken

        with open(where(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[name, folder] = tiktoken.Encoding(name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    fast, out = _encoders[name, folder], []
    for text in texts:
        if "<|endoftext|>" in text:
            if (name, folder, "whole") not in _encoders:
                from tokenizers import Tokenizer

                _encoders[name, folder, "whole"] = Tokenizer.from_file(where(f"{name}.json"))
            out.append(np.array(_encoders[name, folder, "whole"].encode(text, add_special_tokens=False).ids, np.uint32))
        else:
            out.append(np.array(fast.encode_ordinary(text), np.uint32))
    return out


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, piece: int = 512, load: int = 256, end_id: int = 1, vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """Cut and pack all documents into sequences of at most ``capacity`` tokens.

    Returns one row per piece (SCHEMA): its place in the document and in its
    sequence, and the CRC-32 of its ids. Every document ends in ``end_id``; null
    and empty texts are that id alone. Repeated rows are packed each time; a null
    id stays null. Other columns are ignored, so their names can't clash. An empty
    table gives no rows. A task's last load may be part-filled, which costs less
    than one window of padding a task. sequence_id is the task's partition number
    times 2**33 plus a count, so a retried task gives the same rows.
    """

    def pack(batches):
        base = TaskContext.get().partitionId() << 33
        made = seen = 0
        held: list[tuple] = []
        weight = 0
        done: list[tuple] = []

        def close():
            nonlocal made, held, weight
            for window in fill([x[2] for x in held], capacity):
                at = 0
                for i in window:
                    done.append((*held[i], base + made, at))
                    at += held[i][2]
                made += 1
            held, weight = [], 0

        def out():
            nonlocal done
            columns = list(zip(*done, strict=True))
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names)
            done = []
            return batch

        for batch in batches:
            for own, text in zip(batch.column(0), batch.column(1), strict=True):
                own, text = own.as_py(), text.as_py() or ""
                ids = np.append(token_ids([text], vocabulary, folder)[0], np.uint32(end_id)).astype("<u4")
                size = len(ids)
                whole = size // capacity * capacity
                for at in range(0, whole, capacity):
                    done.append((own, at, capacity, zlib.crc32(ids[at : at + capacity].tobytes()), size, base + made, 0))
                    made += 1
                rest = size - whole
                seen += 1
                for step in cuts(rest, piece * (seen % 2)):
                    held.append((own, whole, step, zlib.crc32(ids[whole : whole + step].tobytes()), size))
                    whole += step
                weight += rest
                if weight >= load * capacity:
                    close()
                if len(done) >= 10_000:
                    yield out()
        if held:
            close()
        if done:
            yield out()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pack, SCHEMA)
