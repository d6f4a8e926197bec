"""Operator 8, media columns of interleaved documents.

HTML is parsed into an ordered sequence of structs, texts and media references
in the place they stand, with the caption that belongs to each reference. Media
are kept apart, one for each digest, and a join on the digest brings what is
wanted of them back to the references; positions and captions stay aligned, as
each reference carries its own. Payloads are stored as 8-bit grey PNG images of
64 samples a row.

Whatever is computed from a medium is computed where the medium is, once for each
copy read, and only that small result is joined; the payload itself travels only
if it is asked for.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
ITEM = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
#: Tags that end a text, and tags whose content is no text.
BLOCK = frozenset("p div br li ul ol tr td th table h1 h2 h3 h4 h5 h6 article section nav header footer aside main blockquote pre figure figcaption body html title".split())
SILENT = frozenset(["script", "style", "template", "noscript"])


class _Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.silent = 0
        self.caption: list[str] | None = None
        self.open: list[int] = []

    def flush(self):
        text = "".join(self.words).strip()
        self.words = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
        elif tag == "figure":
            self.flush()
            self.open = []
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in ("img", "video", "audio", "source"):
            named = dict(attrs)
            if named.get("src"):
                self.flush()
                self.open.append(len(self.items))
                self.items.append({"kind": "media", "text": None, "digest": named["src"], "caption": named.get("alt") or None})
        elif tag in BLOCK:
            self.flush()

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            text, self.caption = " ".join("".join(self.caption).split()), None
            for i in self.open[-1:]:
                self.items[i]["caption"] = text or self.items[i]["caption"]
        elif tag in BLOCK:
            self.flush()

    def handle_data(self, data):
        if not self.silent:
            (self.words if self.caption is None else self.caption).append(data)


def parse_sequence(html: str) -> list[dict]:
    parser = _Sequence()
    parser.feed(html)
    parser.close()
    parser.flush()
    return [{"position": i, **x} for i, x in enumerate(parser.items)]


def interleave(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id_col, items): the ordered texts and media references of each page.

    One row per input row. Null and empty pages have no items; broken markup gives
    what the parser makes of it. Other columns are ignored.
    """
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([parse_sequence(x or "") for x in part.column(1).to_pylist()], kind)], [id_col, "items"])

    return pages.select(F.col(id_col).cast("long").alias(id_col), F.col(html_col).alias("html")).mapInArrow(run, f"`{id_col}` long, items {ITEM}")


def media_references(sequences: DataFrame, id_col: str) -> DataFrame:
    """(id_col, position, digest, caption), a row for each media reference."""
    return sequences.select(id_col, F.explode("items").alias("x")).where("x.kind = 'media'").select(id_col, "x.position", "x.digest", "x.caption")


def pad(data: bytes, unit: int = ROW) -> bytes:
    """Zero bytes appended up to a positive multiple of ``unit``."""
    return data + bytes((-len(data)) % unit or (0 if data else unit))


def encode_png(payload: bytes) -> bytes:
    """An 8-bit grey PNG with ``ROW`` samples a row and no row filter."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    raw = np.zeros((len(rows), ROW + 1), np.uint8)
    raw[:, 1:] = rows

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + chunk(b"IEND", b"")


def decode_png(media: bytes) -> np.ndarray:
    """Samples of an image made by :func:`encode_png`; checks every chunk."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, body, size = 8, b"", (0, 0)
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        name, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(name + data):
            raise ValueError("damaged chunk")
        if name == b"IHDR":
            size = struct.unpack_from(">II", data)
        elif name == b"IDAT":
            body += data
        at += 12 + n
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(size[1], size[0] + 1)[:, 1:]


def describe(samples: np.ndarray) -> str:
    """Size, mean, deviation and entropy of the samples."""
    flat = samples.reshape(-1)
    share = np.bincount(flat, minlength=256) / len(flat)
    some = share[share > 0]
    return f"{samples.shape[1]}x{samples.shape[0]} mean={flat.mean():.4f} std={flat.std():.4f} entropy={-(some * np.log2(some)).sum():.4f}"


def store_media(rows: DataFrame, body_col: str = "body") -> DataFrame:
    """(digest, n_bytes, media): each row's bytes padded and stored as an image.

    The digest is the SHA-256 of the unpadded bytes. Null bytes are empty.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                bodies = [x or b"" for x in batch.column(0).slice(at, 200).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(x).hexdigest() for x in bodies]), pa.array([len(x) for x in bodies], pa.int64()), pa.array([encode_png(pad(x)) for x in bodies], pa.binary())], ["digest", "n_bytes", "media"])

    return rows.select(F.col(body_col)).mapInArrow(run, "digest string, n_bytes long, media binary")


READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_media(media: DataFrame) -> DataFrame:
    """Read stored images back: (digest, n_bytes, READ), one row per stored image."""

    def run(batches):
        for batch in batches:
            out = []
            for body in batch.column("media").to_pylist():
                samples = decode_png(body)
                payload = samples.tobytes()
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(body), hashlib.sha256(body).hexdigest(), describe(samples)))
            names = [x.split()[0] for x in READ.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("n_bytes"), *map(pa.array, zip(*out, strict=True))] if out else [batch.column("digest"), batch.column("n_bytes"), *(pa.nulls(0, pa.int64() if "long" in x else pa.string()) for x in READ.split(", "))], ["digest", "n_bytes", *names])

    return media.mapInArrow(run, f"digest string, n_bytes long, {READ}")


def resolve(references: DataFrame, media: DataFrame, columns: list[str]) -> DataFrame:
    """References with ``columns`` of their media, joined on the digest.

    Copies of one digest are reduced before the join, by partial aggregates of
    ``columns``. A reference without a medium keeps nulls. Media of the same
    digest are equal, so any of them may stand for all.
    """
    one = media.groupBy("digest").agg(*[F.min(c).alias(c) for c in columns])
    return references.join(one, "digest", "left")
