"""Exact nearest neighbours: query rows against a bank, in folds over pairs that are never written. Rows are (id, v).

Every query row has its own result, also where ids repeat or are null.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typica.operators import blocks
from typica.operators.blocks import CELLS, Fold, distances, fold_pairs, small
from typica.operators.cells import fold_near
from typica.operators.screen import TILE_B, TILE_Q, Screen, fits, hits, measured


def nearest(k: int, metric: str, with_ids: bool) -> Fold:
    """d, and ids, of the k nearest bank rows, ascending; ties in order of the bank's ids."""

    def start(n: int) -> dict:
        return {"d": np.empty((n, 0)), "ids": np.empty((n, 0), np.int64)}

    def step(state: dict, q: list, b: list) -> dict:
        v, (own, bank) = q[1], b[:2]
        if not fits(v, bank, metric):
            return dense(state, v, own, bank)
        screen, d_out, i_out = Screen(v, bank, metric), [], []
        for lo in range(0, len(v), TILE_Q):
            d, ids = state["d"][lo : lo + TILE_Q], state["ids"][lo : lo + TILE_Q]
            for at in range(0, len(bank), TILE_B):
                scores = screen.scores(lo, at)
                if d.shape[1] == k and np.isfinite(d[:, -1]).all():
                    near = scores >= screen.least(lo, d[:, -1])[:, None]
                else:
                    near = np.ones(scores.shape, bool)
                if scores.shape[1] > k and np.count_nonzero(near) > 2 * k * len(near):  # the tile's own k nearest are a closer bound
                    near &= scores >= screen.best(lo, scores, k)[:, None]
                i, j = hits(near)
                if len(i):
                    d, ids = merged(d, ids, i, measured(v[lo:], bank[at:], i, j, metric), own[at:][j], min(k, d.shape[1] + scores.shape[1]))
            d_out.append(d)
            i_out.append(ids)
        return {"d": np.concatenate(d_out), "ids": np.concatenate(i_out)}

    def merged(d: np.ndarray, ids: np.ndarray, i: np.ndarray, x: np.ndarray, named: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The n smallest of each row of d and of the x that its place in i names."""
        rows, place, many = np.unique(i, return_inverse=True, return_counts=True)
        if n > d.shape[1]:  # every row has further ones
            rows, place, many = np.arange(len(d)), i, np.bincount(i, minlength=len(d))
        column = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)  # i ascends
        both = np.full((len(rows), d.shape[1] + int(many.max())), np.inf)
        both[:, : d.shape[1]] = d[rows]
        both[place, d.shape[1] + column] = x
        if not with_ids:
            best, named = np.sort(np.partition(both, n - 1, axis=1)[:, :n], axis=1), np.empty((len(rows), 0), np.int64)
        else:
            whose = np.full(both.shape, np.iinfo(np.int64).max)
            whose[:, : d.shape[1]] = ids[rows]
            whose[place, d.shape[1] + column] = named
            order = np.lexsort((whose, both), axis=1)[:, :n]
            best, named = np.take_along_axis(both, order, 1), np.take_along_axis(whose, order, 1)
        if len(rows) == len(d):
            return best, named
        d[rows], ids[rows] = best, named
        return d, ids

    def dense(state: dict, v: np.ndarray, own: np.ndarray, bank: np.ndarray) -> dict:
        """All distances, for vectors that no screen takes."""
        d_out, i_out, size = [], [], max(1, CELLS // max(1, len(bank)))
        for lo in range(0, len(v), size):
            d = np.concatenate((state["d"][lo : lo + size], distances(v[lo : lo + size], bank, metric)), axis=1)
            ids = np.concatenate((state["ids"][lo : lo + size], np.broadcast_to(own, (len(d), len(own)))), axis=1) if with_ids else None
            n = min(k, d.shape[1])
            if with_ids:
                at = np.lexsort((ids, d), axis=1)[:, :n] if n < d.shape[1] and _tied(d, n) else np.argpartition(d, n - 1, axis=1)[:, :n]
                part, named = np.take_along_axis(d, at, 1), np.take_along_axis(ids, at, 1)
                order = np.lexsort((named, part), axis=1)
                d_out.append(np.take_along_axis(part, order, 1))
                i_out.append(np.take_along_axis(named, order, 1))
            else:
                d_out.append(np.sort(np.partition(d, n - 1, axis=1)[:, :n], axis=1))
        return {"d": np.concatenate(d_out), "ids": np.concatenate(i_out) if with_ids else np.empty((len(v), 0), np.int64)}

    def finish(state: dict) -> dict:
        return {"d": list(state["d"]), "ids": list(state["ids"])}

    def merge() -> dict[str, Column]:
        if not with_ids:
            return {"d": F.slice(F.sort_array(F.flatten(F.collect_list("d"))), 1, k)}
        best = F.slice(F.sort_array(F.flatten(F.collect_list(F.arrays_zip("d", "ids")))), 1, k)
        return {"d": F.transform(best, lambda x: x["d"]), "ids": F.transform(best, lambda x: x["ids"])}

    return Fold(start, step, finish, [("d", "array<double>")] + [("ids", "array<bigint>")] * with_ids, merge)


def _tied(d: np.ndarray, n: int) -> bool:
    """Whether some row has equal values on both sides of its n-th place."""
    two = np.partition(d, (n - 1, n), axis=1)[:, n - 1 : n + 1]
    return bool((two[:, 0] == two[:, 1]).any())


def k_smallest(queries: DataFrame, bank: DataFrame, k: int, metric: str = "euclidean", *, with_ids: bool = False) -> DataFrame:
    """(id, d[, ids]), one row per query row: the distances to the k nearest bank rows, ascending; fewer if the bank is smaller."""
    return _near(queries.select("id", "v"), bank.select("id", "v"), k, metric, with_ids).select("id", "d", *(["ids"] if with_ids else []))


def _near(queries: DataFrame, bank: DataFrame, k: int, metric: str, with_ids: bool) -> DataFrame:
    """All pairs with a bank that is broadcast; with a larger one only those that its cells leave."""
    fold = nearest(k, metric, with_ids)
    held = small(bank, blocks.BANK_ROWS)
    return fold_near(queries, bank, fold, metric, k=k) if held is None else fold_pairs(queries, bank, fold, held=held)


def mean_distance(queries: DataFrame, bank: DataFrame, k: int = 1, metric: str = "euclidean") -> DataFrame:
    """(id, score): minus the mean of the k smallest distances."""
    near = k_smallest(queries, bank, k, metric)
    return near.select("id", (-_mean(F.col("d"))).alias("score"))


def kth_distance(queries: DataFrame, bank: DataFrame, k: int = 5, metric: str = "cosine") -> DataFrame:
    """(id, score): minus the k-th smallest distance, or the largest if there are fewer."""
    return k_smallest(queries, bank, k, metric).select("id", (-F.element_at("d", -1)).alias("score"))


def top_similarity(queries: DataFrame, bank: DataFrame, k: int = 100) -> DataFrame:
    """(id, mean_sim, min_sim) of the k largest inner products; all of them if the bank is smaller."""
    near = k_smallest(queries, bank, k, "dot")
    return near.select("id", (-_mean(F.col("d"))).alias("mean_sim"), (-F.element_at("d", -1)).alias("min_sim"))


def with_radii(rows: DataFrame, k: int) -> DataFrame:
    """(id, v, radius), one row per row: the distance to the k-th nearest other row; to the farthest if there are fewer.

    A row meets itself at distance zero, which is one of the k + 1 smallest.
    """
    near = _near(rows.select("id", "v"), rows.select("id", "v"), k + 1, "euclidean", False)
    return near.select("id", "v", F.element_at("d", -1).alias("radius"))


def radii(rows: DataFrame, k: int) -> DataFrame:
    return with_radii(rows, k).select("id", "radius")


def similar_pairs(left: DataFrame, right: DataFrame, top: int) -> DataFrame:
    """(id, other, rank, sim): for each left row the top right rows by cosine."""
    near = k_smallest(left, right, top, "cosine", with_ids=True)
    each = near.select("id", F.posexplode(F.arrays_zip("d", "ids")).alias("at", "x"))
    return each.select("id", F.col("x.ids").alias("other"), (F.col("at") + 1).cast("long").alias("rank"), (1 - F.col("x.d")).alias("sim"))


def _mean(d: Column) -> Column:
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.size(d)
