"""Neighbourhood topology of a batch against a reference: recall, density, precision, coverage.

Radii of queries come from their own batch, so a row's features depend on its batch mates. Pairs are never written: counts
are folded per query row over the reference.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typica.operators import blocks
from typica.operators.blocks import Fold, distances, fold_pairs
from typica.operators.cells import fold_near
from typica.operators.neighbours import with_radii
from typica.operators.screen import DENSE, TILE_B, TILE_Q, Screen, fits, hits, measured, tiles
from typica.storage import write_out


def _counts() -> Fold:
    """How many reference rows lie within the query's radius, and within how many of their own radii it lies."""

    def start(n: int) -> dict:
        return {"in_query": np.zeros(n, np.int64), "in_ref": np.zeros(n, np.int64)}

    def step(state: dict, q: list, b: list) -> dict:
        (v, radius), (_, bank, theirs) = q[1:3], b[:3]
        usable = fits(v, bank, "euclidean") and np.isfinite(radius).all() and np.isfinite(theirs).all()
        screen = Screen(v, bank, "euclidean") if usable else None
        for lo, first in tiles(len(v), len(bank)):
            at, near = slice(lo, lo + TILE_Q), slice(first, first + TILE_B)
            if screen is None:
                d = distances(v[at], bank[near], "euclidean")
                state["in_query"][at] += (d < radius[at, None]).sum(1)
                state["in_ref"][at] += (d < theirs[None, near]).sum(1)
                continue
            scores, limit = screen.scores(lo, first), radius[at]
            least, most = screen.between(lo, limit)
            may = scores >= least[:, None]
            if np.count_nonzero(may) > DENSE * may.size:
                sure = scores > most[:, None]
                state["in_query"][at] += sure.sum(1)
                may &= ~sure
            i, j = hits(may)
            state["in_query"][at] += np.bincount(i[measured(v[at], bank[near], i, j, "euclidean") < limit[i]], minlength=len(limit))
            scores += (0.5 * np.square(theirs[near])).astype(np.float32)
            least, most = screen.between(lo, np.zeros(len(limit)), float(np.square(theirs[near]).max()))
            may = scores >= least[:, None]
            if np.count_nonzero(may) > DENSE * may.size:
                sure = scores > most[:, None]
                state["in_ref"][at] += sure.sum(1)
                may &= ~sure
            i, j = hits(may)
            state["in_ref"][at] += np.bincount(i[measured(v[at], bank[near], i, j, "euclidean") < theirs[near][j]], minlength=len(limit))
        return state

    return Fold(start, step, lambda s: s, [("in_query", "bigint"), ("in_ref", "bigint")], lambda: {"in_query": F.sum("in_query"), "in_ref": F.sum("in_ref")})


def range_counts(queries: DataFrame, reference: DataFrame, n_reference: int) -> DataFrame:
    """queries (id, v, radius) with in_query and in_ref, over reference (id, v, radius). All comparisons are strict.

    A reference that is too large to be broadcast is counted by cells: those outside all balls are skipped, those wholly
    inside are added as a whole, and only rows of the others are compared.
    """
    if n_reference <= blocks.BANK_ROWS:
        return fold_pairs(queries, reference, _counts())
    reference = write_out(reference, "radii")  # read several times
    return fold_near(queries, reference, _counts(), limits=(F.col("radius"), F.col("radius")), whole=("in_query", "in_ref"))


def topology(queries: DataFrame, reference: DataFrame, k: int = 5) -> DataFrame:
    """(id, recall, density, precision, coverage), one row per query row; both inputs are (id, v). All comparisons are strict.

    The nearest reference row lies within the query's radius exactly if any does, so coverage needs no distance of its own.
    """
    n = reference.count()
    if not n:
        return queries.select("id", *(F.raise_error(F.lit("empty reference")).cast("double").alias(c) for c in ("recall", "density", "precision", "coverage")))
    found = range_counts(with_radii(queries, k), with_radii(reference, k), n)
    one = lambda c: (c > 0).cast("double")
    return found.select("id", (F.col("in_query") / n).alias("recall"), (F.col("in_ref") / float(k)).alias("density"), one(F.col("in_ref")).alias("precision"), one(F.col("in_query")).alias("coverage"))


def model_features(queries: dict[str, DataFrame], reference: dict[str, DataFrame], k: int = 5) -> DataFrame:
    """(id, f): the four features of every model in order of the models' names, as one array. With several models ids join
    their features, so they must be unique."""
    out = None
    for m in sorted(queries):
        t = topology(queries[m], reference[m], k).select("id", F.array("recall", "density", "precision", "coverage").alias(m))
        out = t if out is None else out.join(t, "id")
    return out.select("id", F.concat(*(F.col(m) for m in sorted(queries))).alias("f"))
