"""Embedding near-dedup with an inverted multi-index.

Two codebooks, one for each half of the unit vectors, span a grid of cells; a vector is stored in the cell of its nearest centroids. A query visits
cells in the order of a multi-sequence traversal: by the sum of both halves' squared lower bounds (the distance to the border of
a centroid's region), until a radius at which, for the sample the codebooks come from, partners of exactly the threshold similarity in random
directions lie inside with the target probability. Either vector of a pair may find the other. Every candidate is verified in double precision on
the whole vectors, so no link is below the threshold.

Equal vectors are folded first. A cell's vectors are dealt into blocks and its visitors into lots, so a task compares one block with one lot
however many vectors a cell holds. From a task come sums per vector and a spanning forest of the links, never all pairs.

Defined cases: vectors that are null, zero or hold null or non-finite components link with nothing and stand for themselves; vectors of different lengths
are never compared; a null id likewise, with component null and kept false; rows that repeat an id count as vectors of their own; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import partial
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolltally.llm.components import components
from rolltally.llm.store import store
from rolltally.llm.vectors import lists, matrix, sizes, usable

SIMILARITY = 0.95
TARGET_RECALL = 0.998
#: Vectors (on average) that codebooks and radius are fitted on.
SAMPLE = 4096
BLOCK, LOT = 1024, 4096


class Grid:
    """Codebooks of both halves and the radius of the traversal."""

    def __init__(self, sample: np.ndarray, centroids: int, similarity: float, target: float, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.cut = sample.shape[1] // 2
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.books = [_centroids(half, centroids, rng) for half in self.halves(unit)]
        other = rng.normal(size=unit.shape)
        other -= (other * unit).sum(axis=1, keepdims=True) * unit
        length = np.linalg.norm(other, axis=1, keepdims=True)
        partner = similarity * unit + np.sqrt(1 - similarity**2) * other / np.where(length > 0, length, 1)
        bounds, _ = self.bounds(unit)
        _, cell = self.bounds(partner)
        needed = sum(b[np.arange(len(unit)), c] for b, c in zip(bounds, cell, strict=True))
        self.radius = float(np.quantile(needed, target)) if len(unit) else 0.0

    def halves(self, unit: np.ndarray) -> list[np.ndarray]:
        """Two parts of the components; of single ones the second is zero."""
        return [unit[:, : self.cut], unit[:, self.cut :]] if self.cut else [unit, np.zeros_like(unit)]

    def bounds(self, unit: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per half: squared distance from each vector to the border of each centroid's region, and the nearest centroid."""
        out, nearest = [], []
        for half, book in zip(self.halves(unit), self.books, strict=True):
            far = (half**2).sum(axis=1)[:, None] - 2 * half @ book.T + (book**2).sum(axis=1)[None, :]
            near = far.argmin(axis=1)
            apart = np.sqrt(np.maximum(((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2), 1e-30))
            gap = np.maximum(far - far[np.arange(len(half)), near][:, None], 0) / (2 * apart[near])
            gap[np.arange(len(half)), near] = 0
            out.append(gap**2)
            nearest.append(near)
        return out, nearest

    def visits(self, unit: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each vector's cell, and the cells it visits in the order of the traversal (its own first)."""
        (one, two), (a, b) = self.bounds(unit)
        width = len(self.books[1])
        rows = np.arange(len(unit))
        orders = []
        for bounds, own in ((one, a), (two, b)):
            first = bounds.copy()
            first[rows, own] = -1.0
            orders.append(np.argsort(first, axis=1, kind="stable"))
        cells = [
            np.array(traversal(one[i, orders[0][i]].tolist(), two[i, orders[1][i]].tolist(), self.radius), dtype=np.int64).reshape(-1, 2) for i in range(len(unit))
        ]
        return a * width + b, [orders[0][i][c[:, 0]] * width + orders[1][i][c[:, 1]] for i, c in enumerate(cells)]


def traversal(one: list[float], two: list[float], radius: float) -> list[tuple[int, int]]:
    """Multi-sequence traversal of two ascending lists: places (i, j) by growing ``one[i] + two[j]`` while it is at most ``radius``.

    A place enters the heap when both its predecessors have left it, so only the border of what was visited is kept, however many cells there are.
    """
    heap, out, reached = [(one[0] + two[0], 0, 0)], [], [0] * (len(one) + 1)
    while heap:
        total, i, j = heappop(heap)
        if total > radius and out:
            break
        out.append((i, j))
        reached[i] = j + 1  # columns of row i that were visited
        if i + 1 < len(one) and reached[i + 1] == j:
            heappush(heap, (one[i + 1] + two[j], i + 1, j))
        if j + 1 < len(two) and (i == 0 or reached[i - 1] > j + 1):
            heappush(heap, (one[i] + two[j + 1], i, j + 1))
    return out


def _centroids(points: np.ndarray, count: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    book = np.unique(points[rng.permutation(len(points))[:count]], axis=0)
    for _ in range(rounds):
        near = ((book**2).sum(axis=1)[None, :] - 2 * points @ book.T).argmin(axis=1)
        size = np.bincount(near, minlength=len(book))
        sums = np.zeros_like(book)
        np.add.at(sums, near, points)
        book = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], book)
    return book


def _assigned(batches, grid: Grid, size: int):
    for batch in batches:
        for lo in range(0, batch.num_rows, 2048):
            part = batch.slice(lo, 2048)
            vectors = matrix(part.column(2), size)
            unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
            cell, visited = grid.visits(unit)
            ends = np.concatenate([[0], np.cumsum([len(v) for v in visited])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), lists(unit), pa.array(cell.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(visited).astype(np.int32)))],
                names=["id", "n", "unit", "cell", "visited"],
            )


def _forest(linked: np.ndarray, stored: np.ndarray, visiting: np.ndarray) -> list[tuple[int, int]]:
    """Star edges (smallest id, member) of the components of a stored x visiting link matrix."""
    edges: list[tuple[int, int]] = []
    left = linked.any(axis=0)
    while left.any():
        p = np.zeros(len(visiting), dtype=bool)
        p[int(left.argmax())] = True
        s = np.zeros(len(stored), dtype=bool)
        while True:
            new_s = linked[:, p].any(axis=1)
            new_p = linked[new_s].any(axis=0)
            if new_p.sum() == p.sum() and new_s.sum() == s.sum():
                break
            s, p = new_s, new_p | p
        left &= ~p
        members = np.unique(np.concatenate([stored[s], visiting[p]]))
        edges += [(int(members[0]), int(m)) for m in members[1:]]
    return edges


def _compared(table: pa.Table, similarity: float, size: int) -> pa.Table:
    """One block against one lot of visitors: sums of linked vectors per id, and edges."""
    role = table.column("stored").to_numpy(zero_copy_only=False).astype(bool)
    ids, counts, cell = (table.column(c).to_numpy() for c in ("id", "n", "cell"))
    unit = matrix(table.column("unit"), size)
    s, p = np.flatnonzero(role), np.flatnonzero(~role)
    out: tuple[list, list, list] = ([], [], [])
    if len(s) and len(p):
        linked = (unit[s] @ unit[p].T >= similarity) & (ids[s][:, None] != ids[p][None, :])
        some = linked.any(axis=1)
        if some.any():
            s, linked = s[some], linked[some]
            visited = table.column("visited").combine_chunks()
            # A pair that both vectors find is counted where the smaller id is the visitor.
            back = np.stack([np.isin(cell[p], visited[int(i)].values.to_numpy()) for i in s])
            counted = linked & ~(back & (ids[s][:, None] < ids[p][None, :]))
            for of, with_, m in ((s, p, counted), (p, s, counted.T)):
                sums = m @ counts[with_]
                hit = np.flatnonzero(sums)
                out[0].append(ids[of][hit])
                out[1].append(sums[hit])
                out[2].append(np.full(len(hit), -1))
            edges = _forest(linked, ids[s], ids[p])
            if edges:
                a, b = np.array(edges).T
                out[0].append(a)
                out[1].append(np.zeros(len(a), np.int64))
                out[2].append(b)
    flat = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in out]
    return pa.table({"id": flat[0], "links": flat[1], "other": flat[2]})


def near_duplicates(
    table: DataFrame, similarity: float = SIMILARITY, target: float = TARGET_RECALL, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``table``. Vectors of each length are compared among themselves."""
    rows = table.select(table[vec_id].cast("long").alias("vec_id"), table[vector].alias("vector"))
    taken = usable(F.col("vector")) & F.col("vec_id").isNotNull()
    out = rows.where(~taken).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    for size in sizes(rows.where(taken)):
        out = out.unionByName(_of_one_size(rows.where(taken & (F.size("vector") == size)), size, similarity, target))
    return out


def _of_one_size(rows: DataFrame, size: int, similarity: float, target: float) -> DataFrame:
    classes = store(rows.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "vector-classes")
    count = classes.count()
    chance = F.pmod(F.xxhash64("rep", F.lit("codebook")), F.lit(1 << 40)) / float(1 << 40)
    sample = classes.where(chance * count < SAMPLE).select("vector").collect() or classes.select("vector").limit(1).collect()
    grid = Grid(np.array([r[0] for r in sample], dtype=np.float64), max(2, round(count**0.25)), similarity, target)

    kept = "id long, n long, unit array<double>, cell int, visited array<int>"
    points = classes.select(F.col("rep").alias("id"), "n", F.col("vector").cast("array<double>").alias("vector"))
    assigned = store(points.mapInArrow(partial(_assigned, grid=grid, size=size), kept), "vector-cells")
    visits = assigned.select("id", "n", "unit", "cell", F.explode("visited").alias("at"))
    stored_in = assigned.groupBy(F.col("cell").alias("at")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    visited_by = visits.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / LOT).cast("int").alias("lots"))
    cells = store(stored_in.join(visited_by, "at"), "vector-blocks")  # one row per cell: centroids ** 2 at most
    deal = lambda by, name: F.pmod(F.xxhash64("id", F.lit(name)), F.col(by)).cast("int")
    none = F.lit(None).cast("array<int>")
    blocks = assigned.withColumnRenamed("cell", "at").join(cells, "at").select(
        "at", deal("blocks", "block").alias("block"), F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"),
        F.lit(True).alias("stored"), "id", "n", F.col("at").alias("cell"), "unit", "visited",
    )
    lots = visits.join(cells, "at").select(
        "at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), deal("lots", "lot").alias("lot"),
        F.lit(False).alias("stored"), "id", "n", "cell", "unit", none.alias("visited"),
    )
    found = store(
        blocks.unionByName(lots).groupBy("at", "block", "lot").applyInArrow(lambda t: _compared(t, similarity, size), "id long, links long, other long"),
        "vector-links",
    )
    label = components(found.where("other >= 0 or other < -1").select(F.col("id").alias("a"), F.col("other").alias("b")))
    links = found.where("other = -1").groupBy("id").agg(F.sum("links").alias("links"))
    result = classes.join(links.withColumnRenamed("id", "rep"), "rep", "left").join(label.withColumnRenamed("id", "rep"), "rep", "left").select(
        F.col("vector").alias("v"), F.col("rep"), (F.coalesce("links", F.lit(0).cast("long")) + F.col("n") - 1).alias("links"), F.coalesce("label", "rep").alias("label")
    )
    return rows.join(result, F.col("vector") == F.col("v")).select(
        "vec_id", F.col("links").alias("n_links"), F.col("label").alias("component_id"), (F.col("vec_id") == F.col("label")).alias("kept")
    )


def op5_embedding_dedup(table: DataFrame) -> DataFrame:
    return near_duplicates(table)


ORACLE_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), n AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
), r AS (
  SELECT vec_id AS id, vec_id AS label FROM embeddings
  UNION
  SELECT l.b, r.label FROM r JOIN l ON l.a = r.id WHERE r.label < l.b
), c AS (
  SELECT id, min(label) AS label FROM r GROUP BY id
)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.label AS component_id, vec_id = c.label AS kept
FROM embeddings JOIN c ON c.id = vec_id LEFT JOIN n ON n.a = vec_id
"""
