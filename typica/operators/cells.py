"""A metric index for folds over pairs: far pairs are skipped by the triangle inequality, whole cells at a time.

Pivots are far points of a bounded sample. A bank is written by Voronoi cells with each row's distance from its pivot, and a
cell is summed up by its rows, its ring (smallest and largest distance), its smallest distances and its largest limit. A row
of the bank matters to a query up to the larger of their limits: a query's is its radius, or how far its last neighbour can
be at most by the summaries. Queries of near cells form blocks; a cell of the bank that can matter to no query of a block is
not sent there, nor is any row too far from all of the block's cells. Of a cell that lies wholly within a ball only the
count is used. All is exact: what is skipped could not change a result, whatever the pivots.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typica.operators import blocks
from typica.operators.blocks import Fold, distances, folded, matrix, spread
from typica.operators.passes import sample
from typica.storage import discard, numbered, write_out

#: Pivots at most, rows that they are chosen from, rows of the bank that a task lets pass.
PIVOTS, FIT_ROWS, SHARE_ROWS = 1024, 16_384, 2_000_000
#: Cells of the nearest pivots that bound how far a neighbour can be; sums of distances that a worker holds for this: 8 MB.
NEAR_CELLS, REACH_CELLS = 32, 1_000_000
#: Rows whose distances from all pivots a worker holds: 4 MB.
SLICE_ROWS = 512
#: Distances are floats: what is skipped must be this far beyond its limit, in proportion.
SLACK = 1e-6


@dataclass
class Space:
    """Vectors in which nearness by a metric is distance: for cosine those of length one, for dot with one more coordinate,
    which makes all of the bank equally long."""

    metric: str
    longest: float = 0.0

    def of(self, v: np.ndarray, bank: bool) -> np.ndarray:
        if self.metric == "cosine":
            length = np.linalg.norm(v, axis=1)
            return v / np.where(length > 0, length, 1.0)[:, None]
        if self.metric == "dot":
            more = np.sqrt(np.maximum(0, self.longest - (v * v).sum(1))) if bank else np.zeros(len(v))
            return np.concatenate([v, more[:, None]], 1)
        return v

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return distances(a, b, "manhattan" if self.metric == "manhattan" else "euclidean")


@dataclass
class Pairs:
    """What is decided about each block of queries and each cell of the bank: a row for each block."""

    compare: np.ndarray  # rows of the cell are compared
    inside: np.ndarray  # all of the cell lies in the balls of all of the block's queries
    holds: np.ndarray  # all of the block's queries lie in the balls of all of the cell's rows
    skipped: int  # pairs of a query cell and a cell of the bank that need no comparison


def far_points(x: np.ndarray, n: int, space: Space) -> np.ndarray:
    """n rows, each the farthest from those before it."""
    long, at, near = np.einsum("ij,ij->i", x, x), [0], np.full(len(x), np.inf)
    while len(at) < min(n, len(x)):
        p = x[at[-1]]
        apart = space.apart(p[None], x)[0] if space.metric == "manhattan" else long - 2 * (x @ p) + p @ p  # squares name the same row
        near = np.minimum(near, apart)
        at.append(int(near.argmax()))
    return x[at]


def reaches(r: np.ndarray, near: np.ndarray, k: int, cells: int = 0) -> np.ndarray:
    """How far the k-th nearest row of the bank can be at most, for rows at distances r from the pivots.

    near: per pivot the distances of its k nearest rows, infinite where there are fewer. The cells of the NEAR_CELLS nearest
    pivots give a bound; all cells are read only for rows for which these hold fewer than k. Few rows go at once.
    """
    cells = min(cells or NEAR_CELLS, r.shape[1])
    out, size = np.full(len(r), np.inf), max(1, REACH_CELLS // (cells * near.shape[1]))
    if cells * near.shape[1] < k:
        return out if cells == r.shape[1] else reaches(r, near, k, r.shape[1])
    for lo in range(0, len(r), size):
        part = r[lo : lo + size]
        at = np.argpartition(part, cells - 1, axis=1)[:, :cells]
        far = (np.take_along_axis(part, at, 1)[:, :, None] + near[at]).reshape(len(part), -1)
        out[lo : lo + size] = np.partition(far, k - 1, axis=1)[:, k - 1]
    left = np.flatnonzero(np.isinf(out))
    if len(left) and cells < r.shape[1]:
        out[left] = reaches(r[left], near, k, r.shape[1])
    return out


def placed(rows: DataFrame, pivots: np.ndarray, space: Space, bank: bool, near: np.ndarray | None = None, k: int = 0) -> DataFrame:
    """rows (id, v, ...) with cell and r; with near (per pivot the distances of its nearest rows of the bank) also how far the
    k-th neighbour can be."""
    names = [*rows.columns, "cell", "r", *(["reach"] if near is not None else [])]
    sent = rows.sparkSession.sparkContext.broadcast((pivots, near))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, theirs = sent.value
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE_ROWS):
                b = whole.slice(lo, SLICE_ROWS)
                r = space.apart(space.of(matrix(b.column(1)), bank), at)
                cell = r.argmin(1)
                more = [] if theirs is None else [pa.array(reaches(r, theirs, k))]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(r[np.arange(len(r)), cell]), *more], names)

    schema = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "cell int", "r double", *(["reach double"] if near is not None else [])]
    return spread(rows).mapInArrow(run, ", ".join(schema))


def blocks_of(n: np.ndarray, pivots: np.ndarray, most: int, space: Space) -> tuple[np.ndarray, np.ndarray]:
    """For each query cell its first block and how many it has: near cells share one of about most rows, larger ones have several."""
    parts, first, left, k = np.maximum(1, -(-n // most)), np.full(len(n), -1), set(np.flatnonzero(n).tolist()), 0
    while left:
        at = max(left, key=lambda c: (n[c], -c))
        members = np.array([at])
        if parts[at] == 1:
            members = np.array(sorted(left))
            members = members[np.argsort(space.apart(pivots[at][None], pivots[members])[0], kind="stable")]
            members = members[: max(1, int(np.searchsorted(np.cumsum(n[members]), most, "right")))]
        first[members], k = k, k + int(parts[at])
        left -= set(members.tolist())
    return first, parts


def decided(between: np.ndarray, asked: dict[str, np.ndarray], bank: dict[str, np.ndarray], block: np.ndarray, counting: bool) -> Pairs:
    """between: distances of query cells' pivots to those of the bank's cells. asked: radius, least and most limit of query
    cells; bank: n, low and high end of the ring, least and most limit; block: of each query cell, from 0."""
    slack = SLACK * (1 + between)
    near = np.maximum(0, np.maximum(between - asked["radius"][:, None] - bank["high"], bank["low"] - between - asked["radius"][:, None])) - slack
    far = between + asked["radius"][:, None] + bank["high"] + slack
    cut = lambda m: np.logical_and.reduceat(m, np.flatnonzero(np.diff(block, prepend=-1)), axis=0)
    outside_q, outside_b = near > asked["most"][:, None], near > bank["most"][None, :]
    inside, holds = counting & (far < asked["least"][:, None]), counting & (far < bank["least"][None, :])
    decided_q, decided_b = cut(outside_q) | cut(inside), cut(outside_b) | cut(holds)
    return Pairs(~(decided_q & decided_b), cut(inside), cut(holds), int(((outside_q | inside) & (outside_b | holds)).sum()))


def fold_near(queries: DataFrame, bank: DataFrame, fold: Fold, metric: str = "euclidean", *, k: int | None = None, limits: tuple[Column, Column] | None = None, whole: tuple[str, str] | None = None) -> DataFrame:
    """What fold_pairs gives, without the pairs that can't matter. The first columns of both are id and v.

    k: a query matters to its k nearest rows. limits: columns of queries and bank; a pair farther apart than both does not
    matter. whole: names of fold.out that count the bank rows within the query's limit and those within whose limit the
    query is (both strictly); cells that lie in a ball as a whole are added to these without a comparison.
    """
    spark, names, theirs = queries.sparkSession, queries.columns, bank.columns
    space = Space(metric)
    if metric == "dot":
        space.longest = float(bank.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0] or 0.0)
    n_bank = bank.count()
    pivots = far_points(space.of(sample(bank, FIT_ROWS), True), int(min(PIVOTS, max(4, 2 * n_bank**0.5))), space)
    none = F.lit(0.0)
    other = write_out(placed(bank, pivots, space, True).withColumn("lim", (limits[1] if limits else none).cast("double")), "cells")
    sums = other.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("low"), F.max("r").alias("high"), F.min("lim").alias("least"), F.max("lim").alias("most")).toPandas().sort_values("cell")
    near = None
    if k is not None:
        few = other.withColumn("at", F.row_number().over(Window.partitionBy("cell").orderBy("r"))).where(F.col("at") <= k).select("cell", "r").toPandas()  # PIVOTS * k rows at most
        few = few.sort_values(["cell", "r"])
        near = np.full((len(pivots), min(k, int(sums["n"].max()) if len(sums) else 1)), np.inf)
        near[few["cell"], few.groupby("cell").cumcount()] = few["r"]
    given = placed(queries, pivots, space, False, near, k or 0)
    asking = numbered(given.withColumn("lim", F.col("reach") if k is not None else limits[0].cast("double")), "row")
    cells = asking.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("radius"), F.min("lim").alias("least"), F.max("lim").alias("most")).toPandas()
    n = np.zeros(len(pivots), np.int64)
    n[cells["cell"]] = cells["n"]
    first, parts = blocks_of(n, pivots, blocks.BANK_ROWS, space)
    cells = cells.assign(first=first[cells["cell"]], parts=parts[cells["cell"]]).sort_values(["first", "cell"])
    at = {c: cells[c].to_numpy() for c in cells}
    own = {c: sums[c].to_numpy() for c in sums}
    group = np.unique(at["first"], return_inverse=True)[1]
    pairs = decided(space.apart(pivots[at["cell"]], pivots[own["cell"]]) if len(cells) else np.zeros((0, len(sums))), at, own, group, whole is not None) if len(cells) else Pairs(*(np.zeros((0, len(sums)), bool),) * 3, 0)

    # of a group of cells: its first block, how many it has, and the tasks that each of these is cut into
    heads = np.flatnonzero(np.diff(group, prepend=-1))
    sent_rows = (pairs.compare * own["n"][None, :]).sum(1)
    least = -(-2 * spark.sparkContext.defaultParallelism // max(1, int(at["parts"][heads].sum())))
    shares = np.maximum(least, -(-sent_rows // SHARE_ROWS)).astype(np.int64)
    tasks = np.concatenate([[0], np.cumsum(at["parts"][heads] * shares)]).astype(np.int64)
    base = [((pairs.__dict__[f] & ~pairs.compare) * own["n"][None, :]).sum(1) for f in ("inside", "holds")]
    plan = [(int(c), int(tasks[g]), int(p), int(shares[g]), int(base[0][g]), int(base[1][g])) for c, g, p in zip(at["cell"], group, at["parts"], strict=True)]
    told = F.broadcast(spark.createDataFrame(plan, "cell int, task0 long, parts long, shares int, base_q long, base_b long"))  # PIVOTS rows at most
    block = (F.col("task0") + F.pmod("row", "parts") * F.col("shares")).cast("int")
    extra = ["base_q", "base_b"] if whole else []
    mine = asking.join(told, "cell").select(F.explode(F.sequence(block, block + F.col("shares") - 1)).alias("task"), "row", F.struct(*(F.col(f"`{c}`") for c in names), *extra).alias("q"))
    sent = _sent(numbered(other, "row"), theirs, pivots[at["cell"]], space, at, heads, pairs.compare, sums["cell"].to_numpy(), tasks, shares)
    out = folded(mine, sent, fold, max(1, int(tasks[-1])), once=bool((shares == 1).all()))
    discard(other)
    if whole:
        out = out.withColumns({w: F.col(w) + F.col(b) for w, b in zip(whole, extra, strict=True)}).drop(*extra)
    return out


def _sent(bank: DataFrame, names: list[str], pivots: np.ndarray, space: Space, at: dict, heads: np.ndarray, compare: np.ndarray, numbers: np.ndarray, tasks: np.ndarray, shares: np.ndarray) -> DataFrame:
    """(task, b): rows of the bank for the tasks that need them."""
    where = np.full(int(numbers.max(initial=-1)) + 1, -1)
    where[numbers] = np.arange(len(numbers))
    sent = bank.sparkSession.sparkContext.broadcast((pivots, at["radius"], at["most"], heads, compare, where, tasks, shares, at["parts"][heads]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, radius, most, starts, wanted, place, first, cut, parts = sent.value
        for whole in batches if len(starts) else ():
            for lo in range(0, whole.num_rows, SLICE_ROWS):
                b = whole.slice(lo, SLICE_ROWS)
                cell, lim, row = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                r = space.apart(space.of(matrix(b.column(3).field(1)), True), own)
                near = r - radius[None, :] - SLACK * (1 + r) <= np.maximum(most[None, :], lim[:, None])
                hit = np.logical_or.reduceat(near, starts, axis=1) & wanted[:, place[cell]].T
                i, g = np.nonzero(hit)
                n = parts[g]
                each = np.repeat(np.arange(len(i)), n)
                part = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                i, g = i[each], g[each]
                task = first[g] + part * cut[g] + row[i] % cut[g]
                yield pa.RecordBatch.from_arrays([pa.array(task.astype(np.int32)), b.column(3).take(pa.array(i))], ["task", "b"])

    kept = bank.select("cell", "lim", "row", F.struct(*(F.col(f"`{c}`") for c in names)).alias("b"))
    return kept.mapInArrow(run, f"task int, b {kept.schema['b'].dataType.simpleString()}")
