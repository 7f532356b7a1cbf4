"""Exact search for the candidates with the largest inner products, as a k-nearest-neighbour join over Voronoi cells.

With one more coordinate, sqrt(M - |c|^2) for a candidate c and 0 for a query, M being the largest |c|^2, the largest inner
products become the smallest distances, for which the triangle inequality holds. Candidates and queries go to the cells of
the same pivots. Each cell of candidates is summed up by its smallest distances from the pivot; from these follows how far a
query's last neighbour can be at most, and from that, for each group of query cells, which candidates it needs. Only those
are copied to the group, in shares of bounded size that are solved on their own and merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typica.llm.common import discard, numbered, some_rows, write_out
from typica.llm.integers import rounded, usable, whole_matrix
from typica.llm.quality_rules import joined_by

#: Pivots at most, vectors at most that they are fitted on, queries of a group and candidates of a share.
PIVOTS, FIT_ROWS, GROUP, SHARE = 1024, 16_384, 4096, 100_000
#: Scores that a task works out at once.
CELLS = 2_000_000
#: Distances are floats; what they rule out must be this far beyond the bound, in proportion.
SLACK = 1e-6


def extended(v: np.ndarray, largest: int | None) -> np.ndarray:
    """v with the further coordinate of candidates, or of queries where largest is None."""
    more = np.zeros(len(v)) if largest is None else np.sqrt(np.maximum(0, largest - (v * v).sum(1)).astype(np.float64))
    return np.concatenate([v.astype(np.float64), more[:, None]], 1)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows of a to rows of b."""
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T))


def fit_pivots(sample: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """n pivots: far rows of the sample one after the other, then means of what is nearest to them."""
    first, near = [0], np.full(len(sample), np.inf)
    while len(first) < min(n, len(sample)):
        near = np.minimum(near, ((sample - sample[first[-1]]) ** 2).sum(1))
        first.append(int(near.argmax()))
    pivots = sample[first].copy()
    for _ in range(rounds):
        own = apart(sample, pivots).argmin(1)
        n_own = np.bincount(own, minlength=len(pivots))
        total = np.zeros_like(pivots)
        np.add.at(total, own, sample)
        pivots[n_own > 0] = total[n_own > 0] / n_own[n_own > 0, None]
    return pivots


def grouped_cells(queries_in: np.ndarray, pivots: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell its first group and how many groups it has: near cells share one until they have about most queries,
    a cell of more has several of its own."""
    parts = np.maximum(1, -(-queries_in // most))
    first, left, k = np.full(len(pivots), -1), set(np.flatnonzero(queries_in).tolist()), 0
    while left:
        at = max(left, key=lambda c: (queries_in[c], -c))
        members = np.array([at])
        if parts[at] == 1:
            members = np.array(sorted(left))
            members = members[np.argsort(((pivots[members] - pivots[at]) ** 2).sum(1), kind="stable")]
            members = members[: max(1, int(np.searchsorted(np.cumsum(queries_in[members]), most, "right")))]
        first[members] = k
        left -= set(members.tolist())
        k += int(parts[at])
    return first, parts


def best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of entries (row, score, id) the k best of each of n rows, by score, then smaller id; -2^63 marks what is missing."""
    order = np.lexsort((ids, -scores, rows))
    rows, scores, ids = rows[order], scores[order], ids[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    top_s, top_i = np.full((n, k), NONE), np.full((n, k), LAST)
    use = place < k
    top_s[rows[use], place[use]], top_i[rows[use], place[use]] = scores[use], ids[use]
    return top_s, top_i


NONE, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products, exact: in floats where they stay below 2^53."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * q.shape[1]
    return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64) if most < 2**53 else q @ c.T


def solve(q: np.ndarray, state: tuple[np.ndarray, np.ndarray], c: np.ndarray, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The state after candidates c, of which each stands for the rows with the ids at ids[0][k]:ids[0][k + 1] of ids[1]."""
    cuts, flat = ids
    k, step = state[0].shape[1], max(1, CELLS // max(1, len(q)))
    for lo in range(0, len(c), step):
        s = products(q, c[lo : lo + step])
        bound = state[0][:, -1]
        if s.shape[1] > k:
            bound = np.maximum(bound, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
        row, col = np.nonzero(s >= bound[:, None])
        n = cuts[lo + col + 1] - cuts[lo + col]
        each = np.repeat(np.arange(len(col)), n)
        own = flat[np.repeat(cuts[lo + col], n) + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)]
        kept_row, kept = np.nonzero(state[0] > NONE)
        state = best(np.concatenate([state[0][kept_row, kept], s[row, col][each]]), np.concatenate([state[1][kept_row, kept], own]), np.concatenate([kept_row, row[each]]), len(q), k)
    return state


def summed_up(candidates: DataFrame, k: int) -> list:
    """The k smallest distances from the pivot in each cell, copies counted: (cell, r, n)."""
    w = Window.partitionBy("cell").orderBy("r", "row")
    few = candidates.select("cell", "r", "row", F.size("ids").alias("n")).withColumn("at", F.row_number().over(w)).where(F.col("at") <= k)
    return few.select("cell", "r", "n").collect()


def furthest_neighbour(r: np.ndarray, summary: list[tuple[int, float, int]], k: int) -> np.ndarray:
    """For queries at distances r from the pivots, within what distance k candidates must be, by the cells' summaries."""
    if not summary:
        return np.full(len(r), np.inf)
    cell, own, n = (np.array(x) for x in zip(*summary, strict=True))
    reach = r[:, cell] + own[None, :]
    order = np.argsort(reach, 1, kind="stable")
    enough = np.cumsum(n[order], 1) >= k
    at = np.where(enough.any(1), enough.argmax(1), 0)
    return np.where(enough.any(1), np.take_along_axis(reach, np.take_along_axis(order, at[:, None], 1), 1)[:, 0], np.inf)


def nearest_pivots(rows: DataFrame, d: int, pivots: np.ndarray, largest: int | None, summary: list | None = None, k: int = 0) -> DataFrame:
    """rows, whose last column is v, with cell and r, the distance from its pivot; with a summary also reach."""
    sent = rows.sparkSession.sparkContext.broadcast((pivots, summary))
    names = [*rows.columns, "cell", "r", *(["reach"] if summary is not None else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, told = sent.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                r = apart(extended(whole_matrix(b.column(b.num_columns - 1), d), largest), at)
                cell = r.argmin(1)
                more = [] if told is None else [pa.array(furthest_neighbour(r, told, k))]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(r[np.arange(len(r)), cell]), *more], names)

    schema = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "cell int", "r double", *(["reach double"] if summary is not None else [])]
    return rows.mapInArrow(run, ", ".join(schema))


def needed(candidates: DataFrame, d: int, pivots: np.ndarray, largest: int, cells: dict[int, tuple[int, int, float, float]]) -> DataFrame:
    """candidates with groups: those that need the row. cells: of a query cell its first group, how many it has, its radius
    and its reach.

    A query of a cell is at least r(c, pivot) - radius from candidate c, r being c's distance from that cell's pivot.
    """
    use, names = np.array(sorted(cells, key=lambda c: (cells[c][0], c))), [*candidates.columns, "groups"]
    first, parts, radius, reach = (np.array([cells[c][j] for c in use]) for j in range(4))
    starts = np.unique(first, return_index=True)[1]  # cells of a group stand together
    sent = candidates.sparkSession.sparkContext.broadcast((pivots[use], starts, first[starts], parts[starts], radius + reach))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, starts, own, several, bound = sent.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                r = apart(extended(whole_matrix(b.column(b.num_columns - 1), d), largest), at)
                row, at_group = np.nonzero(np.logical_or.reduceat(r <= bound[None, :] + SLACK * (1 + r), starts, axis=1))
                n = several[at_group]
                groups = np.repeat(own[at_group], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                ends = np.cumsum(np.bincount(row, n, b.num_rows).astype(np.int64))
                lists = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(groups.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], names)

    return candidates.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema), "groups array<int>"]))


def solved(queries: DataFrame, candidates: DataFrame, d: int, k: int, shares: dict[int, int]) -> DataFrame:
    """(row, score, id): the k best of each query within each share of its group.

    queries: grp, row, v; candidates: groups, row, ids, v. A task holds the queries of one group, about GROUP, while a
    share of the candidates that the group needs streams past.
    """
    ends = np.cumsum([shares[g] for g in sorted(shares)])
    plan = queries.sparkSession.createDataFrame([(g, int(e) - shares[g], shares[g]) for g, e in zip(sorted(shares), ends, strict=True)], "grp int, first int, n int")
    plan = F.broadcast(plan)  # a row for each group, so one for about GROUP queries
    ask = queries.join(plan, "grp").select(F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("task"), F.lit(0).alias("side"), "row", F.lit(None).cast("array<bigint>").alias("ids"), "v")
    give = candidates.select(F.explode("groups").alias("grp"), "row", "ids", "v").join(plan, "grp")
    both = ask.unionByName(give.select((F.col("first") + F.pmod(F.xxhash64("row"), "n").cast("int")).alias("task"), F.lit(1).alias("side"), "row", "ids", "v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, asked, q, state = None, [], None, None

        def done() -> Iterator[pa.RecordBatch]:
            if state is not None:
                row, col = np.nonzero(state[0] > NONE)
                at = np.concatenate([np.asarray(b.column(2)) for b in asked])
                yield pa.RecordBatch.from_arrays([pa.array(at[row]), pa.array(state[0][row, col]), pa.array(state[1][row, col])], ["row", "score", "id"])

        for whole in batches:
            key = np.stack([np.asarray(whole.column(0)), np.asarray(whole.column(1))], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), whole.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                b = whole.slice(lo, hi - lo)
                if key[lo, 0] != task:
                    yield from done()
                    task, asked, q, state = key[lo, 0], [], None, None
                if key[lo, 1] == 0:
                    asked.append(b)
                elif asked:
                    if q is None:
                        q = np.concatenate([whole_matrix(x.column(4), d) for x in asked])
                        state = np.full((len(q), k), NONE), np.full((len(q), k), LAST)
                    lists = b.column(3)
                    at = np.asarray(lists.offsets)
                    state = solve(q, state, whole_matrix(b.column(4), d), [at - at[0], np.asarray(lists.flatten())])
        yield from done()

    tasks = sum(shares.values())
    return both.repartitionByRange(tasks, "task").sortWithinPartitions("task", "side").mapInArrow(run, "row bigint, score bigint, id bigint")


def top_products(vectors: DataFrame, asked: Column, *, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int | None = None) -> DataFrame:
    """query_id, rank (from 1), id, score: for each row where asked holds, the k other rows of largest inner product.

    Vectors become whole numbers floor(scale * x); ties go to the smaller id. Null and empty vectors, those with null or
    non-finite components and those of another length than most take no part. A query's own row alone is no candidate of
    it: other rows with its id or its vector are. Null ids come last among ties and ask nothing. With fewer than k other
    rows all are returned; an empty table gives an empty table. Components beyond about 2^27 after scaling are an error.
    Further columns, whatever their names, are only read by asked.

    Equal vectors tie with each other whatever is asked, so of a group of copies the k + 1 smallest ids stand for all, and
    one search serves all queries of one vector. pivots: by default twice the root of the vectors, at most PIVOTS; they
    are fitted on at most FIT_ROWS vectors. Neither changes the result.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(int(LAST))).alias("id"), (F.coalesce(asked, F.lit(False)) & F.col(f"`{id_col}`").isNotNull()).alias("asks"), rounded(F.col(f"`{vec_col}`"), scale).alias("v"))
    written = write_out(given.where("v is not null"), "whole-vectors")
    rows, d = usable(written, "v")
    # the k + 1 smallest ids of each vector, by a window that tasks cut before they send; then one row for each vector
    few = rows.withColumn("h", F.xxhash64("v")).withColumn("at", F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))).where(F.col("at") <= k + 1)
    each = numbered(few.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("ids", "v"), "row")
    once = numbered(rows.where("asks").groupBy("v").agg(F.count(F.lit(1)).alias("n")).select("n", "v"), "row")
    candidates, queries = each.select("row", "ids", "v"), once.select("row", "n", "v")
    square = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    largest, n = candidates.agg(F.max(square), F.count(F.lit(1))).first()
    n_asked = queries.count()
    none = spark.createDataFrame([], "query_id bigint, rank int, id bigint, score bigint")
    if not n or not n_asked:
        return none
    m = pivots or int(min(PIVOTS, max(4, 2 * n**0.5)))
    sample = some_rows(candidates.select("row", "v"), F.col("row"), min(FIT_ROWS, 16 * m), n).toArrow()
    at = fit_pivots(extended(whole_matrix(sample.column("v").combine_chunks(), d), largest), m)

    placed = write_out(nearest_pivots(candidates, d, at, largest), "cells")
    summary = [(r["cell"], r["r"], r["n"]) for r in summed_up(placed, k + 1)]
    asking = write_out(nearest_pivots(queries, d, at, None, summary, k + 1), "query-cells")
    per_cell = {r["cell"]: r for r in asking.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("radius"), F.max("reach").alias("reach")).collect()}
    counts = np.zeros(len(at), np.int64)
    for c, r in per_cell.items():
        counts[c] = r["n"]
    first, parts = grouped_cells(counts, at, GROUP)
    cells = {c: (int(first[c]), int(parts[c]), r["radius"], r["reach"]) for c, r in per_cell.items()}
    wanted = write_out(needed(placed.select("row", "ids", "v"), d, at, largest, cells), "needed")
    copies = {r["grp"]: r["n"] for r in wanted.select(F.explode("groups").alias("grp")).groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}
    least = -(-spark.sparkContext.defaultParallelism // max(1, len(copies)))
    shares = {int(g): int(max(-(-c // SHARE), min(least, -(-c // 1024)))) for g, c in sorted(copies.items())}
    groups = F.broadcast(spark.createDataFrame([(c, x[0], x[1]) for c, x in cells.items()], "cell int, first int, parts int"))
    own = asking.join(groups, "cell").select((F.col("first") + F.pmod("row", "parts").cast("int")).alias("grp"), "row", "v")
    found = solved(own, wanted, d, k + 1, shares)
    cut = found.withColumn("at", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "id"))).where(F.col("at") <= k + 1)
    lists = write_out(cut.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "score", "id"))), lambda e: F.struct(e["score"].alias("score"), e["id"].alias("id"))).alias("top")), "top")
    tops = write_out(queries.join(lists, "row").select("v", "n", "top"), "tops")
    mine = joined_by(rows.where("asks").select("id", "v"), tops, ["v"], "n")
    mine = mine.withColumn("at", F.array_position("top", F.struct(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x).alias("score"), F.col("id").alias("id"))))
    others = F.slice(F.filter("top", lambda e, i: i != F.col("at") - 1), 1, k)
    out = mine.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "e"))
    result = out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.when(F.col("e.id") != int(LAST), F.col("e.id")).alias("id"), F.col("e.score").alias("score"))
    discard(each, once, placed, asking, wanted, lists)
    return result
