"""Vectors as whole numbers, for operators whose results must not depend on the order of sums."""

from __future__ import annotations

import pyarrow as pa
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def rounded(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null if the vector is null, empty or holds null or non-finite components."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound & (F.size(vector) > 0), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def usable(rows: DataFrame, column: str) -> tuple[DataFrame, int]:
    """The rows whose whole-number vectors have the most frequent length (of ties the largest), and that length.

    Vectors of other lengths can't be compared with them and take no part, like null ones. Components whose squared
    distances could pass 63 bits (beyond about 2^27 for 64 components) are an error.
    """
    of = F.col(column)
    lengths = rows.where(of.isNotNull()).groupBy(F.size(of).alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(of)).alias("most"), F.min(F.array_min(of)).alias("least"))
    top = lengths.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = top[0]["d"] if top else 0
    if top and 4 * d * max(top[0]["most"], -top[0]["least"]) ** 2 >= 2**63:
        raise ValueError(f"components of {column} from {top[0]['least']} to {top[0]['most']} are too large for 64 bits")
    return rows.where(of.isNotNull() & (F.size(of) == d)), d


def whole_matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column of whole numbers as a matrix with d columns."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), d)
