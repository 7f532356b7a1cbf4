"""Connected components by alternating large and small stars, with every round in a written table; few links in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typica.llm.common import discard, write_out


#: Links up to which one task finds the components: 16 bytes each, some 100 MB with what it works out.
FEW = 1_000_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the smallest one that it reaches."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b, label = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (label[a], label[b], a, b):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = list(batches)
    if parts:
        node, root = forest(*(np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in parts]) for i in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])


def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node with an edge but the roots; root is the smallest node that it reaches.

    edges: (u, v) of one comparable type; nulls, loops and repeats are ignored. A node with many neighbours is a key of
    the join with its own minimum only, which adaptive execution splits; no group is gathered. At most FEW links of long
    nodes are one bounded task instead, with the same result.
    """
    now = write_out(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    if dict(now.dtypes)["u"] == "bigint" and now.count() <= FEW:
        return now.coalesce(1).mapInArrow(_in_one_task, "node bigint, root bigint")
    before = None
    for _ in range(most_rounds):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = write_out(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        after = write_out(small, "small-star")
        discard(large)
        discard(now)
        now = after
    else:
        raise RuntimeError(f"no components after {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
