"""Operator 4, embedding near-duplicates by an inverted multi-index.

Vectors are brought to unit length and split in halves; each half has its own
codebook, and the product of the two is a grid of cells. Every vector is indexed
in its own cell. A vector's partners are sought in the cells nearest to it,
visited in the order of the sum of the two halves' distances (multi-sequence
traversal). How many cells are visited is set when the codebooks are trained: so
many that, of random vectors at exactly the threshold from sample vectors, the
share ``recall`` lies in a visited cell; anything nearer is found more often.
Candidates are then compared in double precision.

Equal vectors are one entry with a count. Large cells are cut into blocks of
``block`` entries on either side, so no task holds a whole cell; a block pair
returns counts and a spanning forest of its links, never the links themselves.
The codebooks come from at most ``sample`` vectors; all vectors are indexed. A
pair found from one side only counts for both.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute is used inside tasks
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railweave.llm.store import Scratch, components

#: Vectors of a length of which there are fewer than this share one cell, as a codebook would have one centre.
FEW = 450


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((centers**2).sum(1) - 2 * x @ centers.T, axis=1)
        count = np.bincount(near, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, near, x)
        centers = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centers)
    return centers


def traverse(first: np.ndarray, second: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Cells (i, j) in the order of first[i] + second[j], the nearest ``most`` of them."""
    one, two = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, out, seen = [(first[one[0]] + second[two[0]], 0, 0)], [], {(0, 0)}
    while heap and len(out) < most:
        _, a, b = heapq.heappop(heap)
        out.append((int(one[a]), int(two[b])))
        for x, y in ((a + 1, b), (a, b + 1)):
            if x < len(one) and y < len(two) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[one[x]] + second[two[y]], x, y))
    return out


class Grid:
    """Codebooks of the halves and the number of cells to visit."""

    def __init__(self, sample: np.ndarray, total: int, threshold: float, recall: float, seed: int = 5):
        self.half = sample.shape[1] // 2 if len(sample) else 0
        k = int(max(1, min(4096, len(sample) // 4, round(np.sqrt(total / 200)))))
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True) if len(sample) else sample
        self.one = kmeans(unit[:, : self.half], k, seed=seed) if len(unit) else unit
        self.two = kmeans(unit[:, self.half :], k, seed=seed + 1) if len(unit) else unit
        self.visits = self._visits(unit, threshold, recall, np.random.default_rng(seed))

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple((x**2).sum(1)[:, None] + (c**2).sum(1) - 2 * x @ c.T for x, c in ((unit[:, : self.half], self.one), (unit[:, self.half :], self.two)))

    def _visits(self, unit, threshold, recall, rng):
        if not len(unit):
            return 1
        x = unit[rng.integers(0, len(unit), 4000)]
        noise = rng.normal(size=x.shape)
        noise -= (noise * x).sum(1, keepdims=True) * x
        noise /= np.linalg.norm(noise, axis=1, keepdims=True)
        y = threshold * x + np.sqrt(1 - threshold**2) * noise
        (a, b), (c, d) = self.distances(x), self.distances(y)
        row = np.arange(len(x))
        goal = a[row, c.argmin(1)] + b[row, d.argmin(1)]
        b.sort(axis=1)
        rank = np.array([np.searchsorted(b[i], goal[i] - a[i], side="right").sum() for i in row])
        return int(max(1, np.quantile(rank, recall)))


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, recall: float = 0.97, sample: int = 20_000, block: int = 1024) -> DataFrame:
    """Near-duplicate links of all vectors, labels ignored.

    Returns (id_col, n_links, component_id, kept), one row per input row: links
    are other rows with cosine >= ``threshold`` that were found, component_id the
    smallest id reachable, kept whether it is the own id. Vectors that are null,
    empty, zero or hold null, NaN or infinite components link with nothing; so
    do rows with a null id, which are returned unlinked. Vectors of different
    length never link. Rows that repeat id and vector count as vectors of their
    own. Other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch()
    kind = "<f4" if "float" in dict(vectors.dtypes)[vector_col] else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("id").isNotNull() & F.coalesce((F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    good = rows.where(usable)
    # A node is a distinct vector, named by its hash, as ids can repeat.
    distinct = good.groupBy("v").agg(F.count("*").alias("copies"), F.min("id").alias("first")).select(F.xxhash64("v").alias("node"), F.size("v").alias("width"), "v", "copies", "first")
    distinct = scratch.keep(distinct, "vectors")
    many = {r[0]: r[1] for r in distinct.groupBy("width").agg(F.count("*").alias("n")).where(F.col("n") >= FEW).toLocalIterator()}
    found = _links(distinct.where(~F.col("width").isin(*many)) if many else distinct, None, threshold, block, kind)
    for width, total in sorted(many.items()):
        part = distinct.where(F.col("width") == width)
        some = part.orderBy("node").limit(sample).select("v").toLocalIterator()
        found = found.union(_links(part, Grid(np.array([r[0] for r in some]), total, threshold, recall), threshold, block, kind))
    found = scratch.keep(found, "links")
    roots = scratch.add(components(found.where("node <> other"), "node", "other"))
    low = roots.join(distinct.select("node", "first"), "node").groupBy("root").agg(F.min("first").alias("low"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    told = distinct.join(counts, "node", "left").join(roots.join(low, "root").select("node", "low"), "node", "left")
    told = told.select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("low", "first").alias("component_id"))
    linked = good.join(told, "v").select("id", "n_links", "component_id")
    rest = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    every = linked.unionByName(rest).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
    return scratch.result(every, "components")


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _links(distinct: DataFrame, grid: Grid | None, threshold: float, block: int, kind: str) -> DataFrame:
    """Rows (node, other, links): counts of links, and forest edges with links 0.

    Components travel as given, in 4 bytes each if the column holds floats, and
    are brought to unit length in double precision where they are compared. Without
    a grid all vectors of one length share a cell.
    """
    shared = distinct.sparkSession.sparkContext.broadcast(grid)

    def place(batches):
        g = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                cut = batch.slice(at, 1000)
                rows: list[tuple] = []
                vectors = [np.array(v, np.float64) for v in cut.column("v").to_pylist()]
                a, b = g.distances(_unit(np.stack(vectors))) if g else (None, None)
                for i, (node, copies) in enumerate(zip(cut.column("node").to_pylist(), cut.column("copies").to_pylist(), strict=True)):
                    body = vectors[i].astype(kind).tobytes()
                    visits = np.array([x * 65536 + y for x, y in traverse(a[i], b[i], g.visits)] if g else [len(vectors[i])], np.int64)
                    home = int(visits[0])
                    rows.append((home, False, node, copies, body, home, visits.tobytes()))
                    rows += [(x, True, node, copies, body, home, None) for x in visits.tolist()]
                cells, probes, nodes, counts, bodies, homes, seen = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(probes), pa.array(nodes, pa.int64()), pa.array(counts, pa.int64()), pa.array(bodies, pa.binary()), pa.array(homes, pa.int64()), pa.array(seen, pa.binary())], ["cell", "probe", "node", "copies", "v", "home", "visits"])

    placed = distinct.select("node", "copies", "v").mapInArrow(place, "cell long, probe boolean, node long, copies long, v binary, home long, visits binary")
    size = placed.groupBy("cell").agg(F.count_if("probe").alias("probes"), F.count_if(~F.col("probe")).alias("held")).where("held > 0")
    size = size.select("cell", F.ceil(F.col("probes") / block).cast("int").alias("np"), F.ceil(F.col("held") / block).cast("int").alias("nh"))
    sized = placed.join(size, "cell")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("probe"), F.col("np")).otherwise(F.col("nh"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("probe"), F.col("nh")).otherwise(F.col("np")) - 1))
    dealt = sized.withColumn("own", own).withColumn("other", other).withColumn("p", F.when(F.col("probe"), F.col("own")).otherwise(F.col("other"))).withColumn("h", F.when(F.col("probe"), F.col("other")).otherwise(F.col("own")))

    def compare(key, table):
        held = table.filter(pa.compute.invert(table["probe"]))
        seek = table.filter(table["probe"])
        none = pa.table({x: pa.array([], pa.int64()) for x in ("node", "other", "links")})
        if not held.num_rows or not seek.num_rows:
            return none
        x, y = (_unit(np.stack([np.frombuffer(b, kind) for b in t["v"].to_pylist()]).astype(np.float64)) for t in (seek, held))
        nx, ny, copies = seek["node"].to_numpy(), held["node"].to_numpy(), held["copies"].to_numpy()
        hit = (x @ y.T >= threshold) & (nx[:, None] != ny)
        links = hit @ copies
        # What a held vector would not find from its side, as it doesn't visit the other's cell, counts for it here.
        back, mine = np.zeros(len(ny), np.int64), seek["copies"].to_numpy()
        homes, visits = seek["home"].to_numpy(), np.stack([np.frombuffer(b, np.int64) for b in held["visits"].to_pylist()])
        for home in np.unique(homes[links > 0]):
            from_there, unseen = homes == home, ~(visits == home).any(1)
            back[unseen] += mine[from_there] @ hit[np.ix_(from_there, unseen)]
        edges = forest(nx, ny, hit)
        some, more = np.flatnonzero(links), np.flatnonzero(back)
        return pa.table({"node": np.concatenate((nx[some], ny[more], edges[:, 0])), "other": np.concatenate((nx[some], ny[more], edges[:, 1])), "links": np.concatenate((links[some], back[more], np.zeros(len(edges), np.int64)))})

    return dealt.select("cell", "p", "h", "probe", "node", "copies", "v", "home", "visits").groupBy("cell", "p", "h").applyInArrow(compare, "node long, other long, links long")


def forest(nx: np.ndarray, ny: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Edges (node, other) with the same components as the links of a block pair."""
    out, left = [], np.ones(len(nx), bool)
    left &= hit.any(1)
    while left.any():
        first = int(np.flatnonzero(left)[0])
        rows = np.zeros(len(nx), bool)
        rows[first] = True
        cols = np.zeros(len(ny), bool)
        while True:
            more = hit[rows].any(0)
            rows2 = hit[:, more].any(1)
            if (more == cols).all() and (rows2 == rows).all():
                break
            cols, rows = more, rows2
        out += [(int(nx[first]), int(v)) for v in np.concatenate((nx[rows], ny[cols])) if v != nx[first]]
        left &= ~rows
    return np.array(out, np.int64).reshape(-1, 2)
