"""Vectorised polynomial hashing of bytes and words, used inside tasks.

A range hash is ``sum(symbol[i] * BASE**(i - start))`` modulo 2**64 followed by
a bit mixer, so any range of a buffer is hashed from one prefix sum. Modulo a
power of two such a sum takes certain texts of 1,024 symbols and more for each
other (a Thue-Morse text and its mirror, whatever the base), so longer ranges are
folded from mixed hashes of ``STRIDE`` symbols each.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)
#: Bytes that separate words: space and the control characters 9 to 13.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Symbols up to which a range is one sum.
STRIDE = 64
#: One odd 64-bit number for each byte value.
BYTE_SYMBOL = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=U) | U(1)

_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        size = max(n, 1 << 20)
        step = np.full(size, BASE if kind == "up" else BACK, U)
        step[0] = 1
        have = _powers[kind] = np.cumprod(step)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def prefix(symbols: np.ndarray) -> np.ndarray:
    out = np.zeros(len(symbols) + 1, U)
    np.cumsum(symbols * _power("up", len(symbols)), out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, length) -> np.ndarray:
    """Hashes of symbols[start : start + length]; length is a number or an array."""
    down = _power("down", len(sums))
    size = np.asarray(length, dtype=np.int64)
    return mix((sums[start + size] - sums[start]) * down[start] + size.astype(U) * U(0xD6E8FEB86659FD93))


def long_span(sums: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of ranges of any length, folded stride by stride."""
    h = span(sums, start, np.minimum(length, STRIDE))
    done, live = STRIDE, np.flatnonzero(length > STRIDE)
    while len(live):
        h[live] = mix(h[live] * U(0xFF51AFD7ED558CCD) + span(sums, start[live] + done, np.minimum(length[live] - done, STRIDE)))
        done += STRIDE
        live = live[length[live] > done]
    return h


def byte_symbols(data: bytes) -> np.ndarray:
    return BYTE_SYMBOL[np.frombuffer(data, np.uint8)]


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-space bytes."""
    inside = np.concatenate(([False], ~IS_SPACE[np.frombuffer(data, np.uint8)], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[0::2], edge[1::2]


def word_hashes(data: bytes, piece: int = 1 << 20) -> np.ndarray:
    """One 64-bit hash for each word; long texts go piece by piece, cut at separators."""
    if len(data) <= piece:
        start, end = word_bounds(data)
        return long_span(prefix(byte_symbols(data)), start, end - start) if len(start) else np.zeros(0, U)
    found, at = [], 0
    while at < len(data):
        to = min(len(data), at + piece)
        while to < len(data):
            cut = np.flatnonzero(IS_SPACE[np.frombuffer(data, np.uint8, count=min(piece, len(data) - to), offset=to)])
            if len(cut):
                to += int(cut[0])
                break
            to = min(len(data), to + piece)
        part = data[at:to]
        start, end = word_bounds(part)
        if len(start):
            found.append(long_span(prefix(byte_symbols(part)), start, end - start))
        at = to
    return np.concatenate(found) if found else np.zeros(0, U)


def window_hashes(symbols: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` symbols; empty if there are fewer."""
    n = len(symbols) - width + 1
    return span(prefix(symbols), np.arange(n), width) if n > 0 else np.zeros(0, U)


def regions(symbols: np.ndarray, starts: np.ndarray, width: int, reach: int, gram: int):
    """Cut window starts into content-defined regions.

    ``starts`` are ascending window starts whose ``width`` symbols exist and
    belong to one document. Each window picks the leftmost smallest gram hash
    among its first ``reach`` positions (``reach - 1 + gram <= width``), which
    depends on the window's own symbols only: equal windows pick the same place.
    A region is a run of consecutive starts with one pick. Returns first starts,
    sizes, the hash of what all windows of a region share from the pick on, and
    the hash of all symbols that the region's windows cover.
    """
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(U), none.astype(U)
    sums = prefix(symbols)
    last = len(symbols) - gram + 1
    low = U(0xFFFFFFFF)
    best = (span(sums, np.arange(last), gram) & ~low) | np.arange(last, dtype=U)
    done = 1
    while done < reach:
        step = min(done, reach - done)
        best = np.minimum(best[:-step], best[step:])
        done += step
    pick = (best[starts] & low).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] != starts[:-1] + 1) | (pick[1:] != pick[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(starts)))
    first = starts[at]
    return first, size, span(sums, pick[at], width - reach + 1), long_span(sums, first, size + width - 1)


def joined_words(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of many short texts at once, and how many each text has."""
    data = b"\n".join(bodies)
    size = np.fromiter(map(len, bodies), np.int64, len(bodies))
    start, end = word_bounds(data)
    if not len(start):
        return np.zeros(0, U), np.zeros(len(bodies), np.int64)
    own = np.searchsorted(np.cumsum(size + 1), start, side="right")
    return long_span(prefix(byte_symbols(data)), start, end - start), np.bincount(own, minlength=len(bodies))


def within(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. inside each of consecutive groups of the given sizes."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
