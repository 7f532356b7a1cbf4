"""Numeric blocks: vectors between Arrow and numpy, scans with a broadcast block, and folds over all pairs of two tables.

A bank of at most BANK_ROWS rows is broadcast. A larger one never passes through the driver: both sides are dealt into blocks
on the executors, and a task holds one block of queries while a share of the bank streams past it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typica.storage import numbered

#: Rows of a bank that are broadcast, and of queries that a task holds: 50 000 vectors of 64 doubles are 25 MB.
BANK_ROWS = 50_000
#: Rows of a broadcast bank from which queries are dealt out anew.
DEAR_ROWS = 2_000
#: Queries times bank rows of a distance matrix in a worker: 32 MB.
CELLS = 4_000_000
#: Rows of either side that a fold takes at once, so that what it works out about them stays small beside a block.
STEP_ROWS = 8_192


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as a matrix of doubles; all vectors have one length."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def distances(q: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """(len(q), len(b)). dot is the negative inner product, so that smaller is nearer for all."""
    if metric == "manhattan":
        out, across = np.zeros((len(q), len(b))), np.ascontiguousarray(b.T)
        for lo in range(0, len(q), 16):  # some rows at a time stay in the processor's cache
            part = out[lo : lo + 16]
            apart = np.empty_like(part)
            for j in range(q.shape[1]):
                np.subtract(q[lo : lo + 16, j, None], across[j], out=apart)
                part += np.abs(apart, out=apart)
        return out
    inner = q @ b.T
    if metric == "dot":
        return -inner
    if metric == "cosine":
        return 1 - inner / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :])
    if metric != "euclidean":
        raise ValueError(f"metric {metric!r}")
    d2 = (q * q).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * inner
    i, j = np.nonzero(d2 < 1e-9 * (1 + (q * q).sum(1).max(initial=0)))  # where the difference form alone is exact
    d2[i, j] = ((q[i] - b[j]) ** 2).sum(1)
    return np.sqrt(d2)


@dataclass
class Fold:
    """What is worked out about a query row over all bank rows.

    start(n): state columns for n queries, each an array of n rows; step(state, query columns, bank columns): the state after
    these bank rows; finish(state): output columns by name; out: their names and types; merge: by name how Spark puts the
    outputs of several shares of the bank together.
    """

    start: Callable[[int], dict]
    step: Callable[[dict, list, list], dict]
    finish: Callable[[dict], dict]
    out: list[tuple[str, str]]
    merge: Callable[[], dict]


def stepped(fold: Fold, state: dict, q: list, b: list) -> dict:
    """The state of all queries after these bank rows, a few of both at a time; it is written in place where its shape stays."""
    for at in range(0, len(b[0]), STEP_ROWS):
        bank, out = [c[at : at + STEP_ROWS] for c in b], {}
        for lo in range(0, len(q[0]), STEP_ROWS):
            rows = slice(lo, lo + STEP_ROWS)
            for n, x in fold.step({n: x[rows] for n, x in state.items()}, [c[rows] for c in q], bank).items():
                if n not in out:
                    out[n] = state[n] if state[n].shape[1:] == x.shape[1:] else np.empty((len(q[0]), *x.shape[1:]), x.dtype)
                out[n][rows] = x
        state = out or state
    return state


def small(rows: DataFrame, most: int) -> pa.Table | None:
    """rows, if they are at most so many."""
    held = rows.limit(most + 1).toArrow()
    return held if held.num_rows <= most else None


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt out for work per row that is much dearer than moving it, however few files or row groups they come from."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def columns_of(t: pa.Table | pa.RecordBatch) -> list:
    """Columns as numpy: vectors as a matrix."""
    flat = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return [matrix(flat(c)) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) if isinstance(c, pa.Array) else c.to_numpy() for c in t.columns]


def fold_pairs(queries: DataFrame, bank: DataFrame, fold: Fold, sizes: tuple[int, int] | None = None, held: pa.Table | None = None) -> DataFrame:
    """queries' columns and fold.out, one row per row of queries, whatever their ids. The first columns are id and v.

    A bank of at most BANK_ROWS rows is broadcast, and queries pass it without a shuffle. Else queries and bank are dealt by
    row: a task has one of the blocks of queries and one of the shares of the bank, and the shares' outputs are merged by
    the number of the query's row, which is written. Where far rows change nothing, cells.fold_near compares fewer.
    sizes: rows of both, where they are dear to work out and known from elsewhere; held: the bank, where the caller has it.
    """
    names, schema = queries.columns, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema), *(f"`{n}` {t}" for n, t in fold.out)])
    if held is None and (sizes is None or sizes[1] <= BANK_ROWS):
        held = small(bank, BANK_ROWS)
    if held is not None:
        sent = queries.sparkSession.sparkContext.broadcast(columns_of(held))

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    state = fold.start(b.num_rows)
                    done = fold.finish(stepped(fold, state, columns_of(b), sent.value))
                    yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(done[n], type=KINDS[t]) for n, t in fold.out)], [*names, *(n for n, _ in fold.out)])

        return (spread(queries) if held.num_rows > DEAR_ROWS else queries).mapInArrow(one, schema)

    given, theirs = numbered(queries, "row"), bank.columns
    blocks = max(1, -(-(given.count() if sizes is None else sizes[0]) // BANK_ROWS))
    shares = max(1, -(-2 * queries.sparkSession.sparkContext.defaultParallelism // blocks))
    mine = given.select(F.pmod("row", F.lit(blocks)).cast("int").alias("block"), "row", F.struct(*(F.col(f"`{n}`") for n in names)).alias("q"))
    mine = mine.select(F.explode(F.sequence(F.col("block") * shares, F.col("block") * shares + shares - 1)).alias("task"), "row", "q")
    own = numbered(bank, "row").select(F.struct(*(F.col(f"`{n}`") for n in theirs)).alias("b"), F.pmod("row", F.lit(shares)).cast("int").alias("share"))
    other = own.select(F.explode(F.sequence("share", F.col("share") + shares * (blocks - 1), F.lit(shares))).alias("task"), "b")
    return folded(mine, other, fold, blocks * shares, once=shares == 1)


def folded(mine: DataFrame, other: DataFrame, fold: Fold, tasks: int, once: bool = False) -> DataFrame:
    """The queries' columns and fold.out. mine: (task, row, q), row a number that is fixed; other: (task, b); q and b are
    structs. A task has the queries that name it in memory while its bank rows stream past; a query in several tasks gets
    its outputs merged, unless each is in one (once)."""
    names, theirs = mine.schema["q"].dataType.names, other.schema["b"].dataType.names
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in mine.schema["q"].dataType.fields), *(f"`{n}` {t}" for n, t in fold.out)])
    both = mine.select("task", F.lit(0).alias("side"), "row", "q", F.lit(None).cast(other.schema["b"].dataType).alias("b"))
    both = both.unionByName(other.select("task", F.lit(1).alias("side"), F.lit(None).cast("long").alias("row"), F.lit(None).cast(mine.schema["q"].dataType).alias("q"), "b"))

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, asked, ready, cols, state = None, [], None, None, None

        def gathered() -> tuple[pa.RecordBatch, list, dict]:
            """The queries, held once: numpy reads them where they are."""
            whole = pa.Table.from_batches(asked).combine_chunks().to_batches()[0]
            asked.clear()
            return whole, columns_of(pa.RecordBatch.from_arrays(whole.columns[1:], names)), fold.start(whole.num_rows)

        def done() -> Iterator[pa.RecordBatch]:
            held, _, found = gathered() if asked else (ready, cols, state)
            if held is not None:
                out = fold.finish(found)
                yield pa.RecordBatch.from_arrays([*held.columns, *(pa.array(out[n], type=KINDS[t]) for n, t in fold.out)], ["row", *names, *(n for n, _ in fold.out)])

        for whole in batches:
            key = np.stack([whole.column(i).to_numpy(zero_copy_only=False) for i in range(2)], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), whole.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                b = whole.slice(lo, hi - lo)
                if key[lo, 0] != own:
                    yield from done()
                    own, ready, cols, state = key[lo, 0], None, None, None
                if key[lo, 1] == 0:
                    asked.append(pa.RecordBatch.from_arrays([b.column(2), *b.column(3).flatten()], ["row", *names]))
                    continue
                if asked:
                    ready, cols, state = gathered()
                if ready is not None:
                    state = stepped(fold, state, cols, columns_of(pa.RecordBatch.from_arrays(b.column(4).flatten(), theirs)))
        yield from done()

    parts = both.repartitionByRange(tasks, "task").sortWithinPartitions("task", "side").mapInArrow(many, f"row bigint, {schema}")
    if once:
        return parts.drop("row")
    merged = parts.groupBy("row").agg(F.first(F.struct(*(F.col(f"`{n}`") for n in names))).alias("q"), *(c.alias(n) for n, c in fold.merge().items()))
    return merged.select(*(F.col(f"q.`{n}`").alias(n) for n in names), *(n for n, _ in fold.out))


def scan(queries: DataFrame, block: object, work: Callable, out: list[tuple[str, str]]) -> DataFrame:
    """work(block, ids, vectors, further columns) over every batch of queries (id, v, ...): a dict of columns of out."""
    sent = queries.sparkSession.sparkContext.broadcast(block)
    kind = queries.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = work(sent.value, b.column(0), matrix(b.column(1)), b.columns[2:])
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(found[n], type=KINDS[t]) for n, t in out)], ["id", *(n for n, _ in out)])

    return queries.mapInArrow(run, ", ".join([f"id {kind}", *(f"{n} {t}" for n, t in out)]))


KINDS = {"double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "array<double>": pa.list_(pa.float64()), "array<bigint>": pa.list_(pa.int64())}
