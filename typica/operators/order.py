"""Places of rows in an order and order statistics, without ordering all rows in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that one task orders; more are cut into ranges of about so many.
RANGE_ROWS = 1_000_000
#: Ranges at most, as coarse ranges of fine ones of the root of it each.
MOST_RANGES = 4096


def ranges_for(n: int) -> int:
    return max(1, min(MOST_RANGES, -(-n // RANGE_ROWS)))


def ranged(rows: DataFrame, column: str, ranges: int) -> Column:
    """The number of the range of a numeric column that a row falls into, ranges holding about equally many rows. Nulls are
    in the first one, where they also come first in order."""
    edges = sorted(set(rows.stat.approxQuantile(column, [k / ranges for k in range(1, ranges)], 0.1 / ranges))) if ranges > 1 else []
    value = F.col(column)
    below = lambda e: F.size(F.filter(e, lambda x: x <= value))
    listed = lambda e: F.array(*(F.lit(x) for x in e)).cast("array<double>")
    step = math.isqrt(len(edges)) + 1
    if len(edges) <= 64:
        return below(listed(edges))
    fine = F.array(*(listed(edges[i : i + step]) for i in range(0, len(edges), step)))
    coarse = below(listed(edges[step::step]))
    return coarse * step + below(F.get(fine, coarse))


def places(rows: DataFrame, *order: str, ranges: int | None = None) -> DataFrame:
    """place from 1 in the order of the columns, of which the first is numeric, nulls first: ranked within ranges of it, plus
    the rows before. By default there are as many ranges as the rows need."""
    ranges = ranges_for(rows.count()) if ranges is None else ranges
    cut = rows.withColumn("__part", ranged(rows, order[0], ranges))
    above = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    before = cut.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(above), F.lit(0)).alias("__before"))
    w = Window.partitionBy("__part").orderBy(*order)
    return cut.join(F.broadcast(before), "__part").withColumn("place", F.row_number().over(w) + F.col("__before")).drop("__part", "__before")


def at_places(rows: DataFrame, column: str, wanted: list[int], n: int) -> dict[int, float]:
    """The values at these places (from 0) among the n rows, which have no nulls in the column."""
    if n <= RANGE_ROWS:
        held = rows.groupBy(column).count().orderBy(column).collect()  # RANGE_ROWS at most
        out, before, left = {}, 0, sorted(set(wanted))
        for r in held:
            before += r["count"]
            while left and left[0] < before:
                out[left.pop(0)] = float(r[column])
        return out
    cut = rows.select(column, ranged(rows, column, min(MOST_RANGES, max(64, 4 * ranges_for(n)))).alias("part"))
    parts = sorted(cut.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect(), key=lambda r: r["part"])
    out, before = {}, 0
    if len(parts) == 1 and parts[0]["lo"] < parts[0]["hi"]:  # nearly all are one value, which no edge cuts off
        low = float(parts[0]["lo"])
        rest = rows.where(F.col(column) > low)
        n_low = n - rest.count()
        found = at_places(rest, column, [w - n_low for w in wanted if w >= n_low], n - n_low)
        return {w: low if w < n_low else found[w - n_low] for w in wanted}
    for r in parts:
        mine = [w - before for w in wanted if before <= w < before + r["n"]]
        if mine and r["lo"] == r["hi"]:
            out |= {w + before: float(r["lo"]) for w in mine}
        elif mine:
            found = at_places(rows.where(F.col(column).between(r["lo"], r["hi"])), column, mine, r["n"])
            out |= {w + before: v for w, v in found.items()}
        before += r["n"]
    return out


def percentiles(rows: DataFrame, shares: list[float], column: str = "score") -> list[float | None]:
    """Linear interpolation between order statistics; nulls are left out."""
    known = rows.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias(column))
    n = known.count()
    if n == 0:
        return [None] * len(shares)
    if n <= RANGE_ROWS:
        return list(known.select(F.percentile(column, F.array(*(F.lit(float(s)) for s in shares)))).first()[0])
    at = [s * (n - 1) for s in shares]
    found = at_places(known, column, sorted({f(x) for x in at for f in (math.floor, math.ceil)}), n)
    return [found[math.floor(x)] + (x - math.floor(x)) * (found[math.ceil(x)] - found[math.floor(x)]) for x in at]
