"""SimHash fingerprints and near-duplicate groups, with candidates pruned by the pigeonring principle.

A fingerprint's 64 bits are a ring of 8 segments. If two fingerprints differ in at most 3 bits, then from some segment on
every chain of n segments differs in at most 3 * n / 8 bits: two equal segments, then at most one bit over the next three,
two over the next two, three over all. So a candidate pair shares the first two segments of a chain and two of the next
three: 8 starts times 3 choices make 24 keys of 32 bits. Pairs of a key must keep the chain's budgets before all bits are
compared. Equal fingerprints are one node; a key that many of them share is dealt out as pairs of bounded blocks; each
task reduces the links it finds to a spanning forest, so nothing grows with the square of a group in what is written.

Cases: null, blank and wordless texts have fingerprint zero and link like any other; fewer than three words are one
shingle; repeated rows and ties are separate rows of one group; a null doc_id gets its group's smallest id, null if it has
none; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typica.llm.common import bounded_batches, free_prefix, numbered, write_out
from typica.llm.components import components, forest

SEED, SEGMENTS, WIDTH, MOST = 42, 8, 8, 3
#: Distinct fingerprints of a key that one task compares; more are dealt out as pairs of blocks of about this size.
BLOCK = 1024
#: Up to so many hot keys (16 bytes each) are broadcast.
BROADCAST_KEYS = 100_000


def majority(hashes: list[np.ndarray]) -> int:
    """The 64 bits that are set in over half of the hashes (arrays of uint64)."""
    ones = np.zeros(64, np.int64)
    for h in hashes:
        ones += np.add.reduce(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > sum(map(len, hashes)), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The SimHash of UTF-8 text: A-Z lower-cased, words between ASCII white space, repeated shingles counted."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined, xxh = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return xxh(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    return majority([np.fromiter((xxh(joined[a:b], SEED) for a, b in zip(starts[lo:hi].tolist(), ends[lo + shingle - 1 : hi + shingle - 1].tolist(), strict=True)), np.uint64, hi - lo) for lo in range(0, n, 16384) for hi in (min(n, lo + 16384),)])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): one row per row of docs; fp is the fingerprint as a signed long."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary")).mapInArrow(run, f"id {kind}, fp bigint")


def _mask(start: int, segments: list[int]) -> int:
    """The bits of the segments so many places after start, as a signed long."""
    bits = sum(0xFF << WIDTH * ((start + s) % SEGMENTS) for s in segments)
    return bits - (1 << 64) if bits >= 1 << 63 else bits


#: Per key kind: the bits that must be equal.
KEY_MASKS = [_mask(i, [0, 1, *(s for s in (2, 3, 4) if s != free)]) for i in range(SEGMENTS) for free in (2, 3, 4)]
#: Per chain start: the chain's bits after five and after seven segments, with one and two differences allowed.
CHAINS = [[(_mask(i, list(range(n))) & (1 << 64) - 1, n * MOST // SEGMENTS) for n in (5, 7)] for i in range(SEGMENTS)]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal (kind, key, i, j) of the sorted rows; a run is bounded by the dealing of blocks."""
    rest: list[np.ndarray] | None = None

    def found(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        kind, fp = cols[0], cols[4].view(np.uint64)
        change = np.zeros(len(fp), bool)
        change[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:4]])
        run = np.cumsum(change)
        chain = np.array([[m for m, _ in c] for c in CHAINS], np.uint64)
        at, us, vs, held, lag = np.arange(len(fp)), [], [], 0, 0
        while len(at):
            lag += 1
            at = at[at + lag < len(fp)]
            at = at[run[at + lag] == run[at]]
            x, start = fp[at] ^ fp[at + lag], kind[at] // 3
            ok = np.ones(len(at), bool)
            for n in range(2):
                ok &= np.bitwise_count(x & chain[start, n]) <= CHAINS[0][n][1]
            ok[ok] = np.bitwise_count(x[ok]) <= MOST
            if ok.any():
                us.append(fp[at[ok]].view(np.int64))
                vs.append(fp[at[ok] + lag].view(np.int64))
                held += int(ok.sum())
                if held > 500_000:
                    u, v = forest(np.concatenate(us), np.concatenate(vs))
                    us, vs, held = [u], [v], 0
        if us:
            u, v = forest(np.concatenate(us), np.concatenate(vs))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for b in batches:
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        if not len(cols[0]):
            continue
        last = np.logical_and.reduce([c == c[-1] for c in cols[:4]])
        cut = int(np.argmin(last[::-1])) if not last.all() else len(last)
        if cut < len(last):
            yield from found([c[: len(last) - cut] for c in cols])
        rest = [c[len(last) - cut :] for c in cols]
    if rest is not None:
        yield from found(rest)


def links(distinct: DataFrame) -> DataFrame:
    """(u, v): a spanning forest, per task, of all pairs of distinct fingerprints (column fp) within 3 bits."""
    masks = F.array(*(F.struct(F.lit(k).cast("int").alias("kind"), F.lit(m).alias("mask")) for k, m in enumerate(KEY_MASKS)))
    keyed = distinct.select("fp", F.explode(masks).alias("m")).select("fp", "m.kind", F.col("fp").bitwiseAND(F.col("m.mask")).alias("key"))
    hot = write_out(keyed.groupBy("kind", "key").count().where(F.col("count") > BLOCK).select("kind", "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "hot-keys")
    if hot.count() == 0:
        dealt = keyed.select("kind", "key", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp")
    else:
        dealt = keyed.join(F.broadcast(hot) if hot.count() <= BROADCAST_KEYS else hot, ["kind", "key"], "left")
        own = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int")
        others = F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)
        dealt = dealt.withColumn("own", own).select("kind", "key", "fp", "own", F.explode(others).alias("other"))
        dealt = dealt.select("kind", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    near = dealt.repartition("kind", "key", "i", "j").sortWithinPartitions("kind", "key", "i", "j")
    return near.mapInArrow(_links, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp, component): per row of docs its fingerprint and the smallest id of its group."""
    prints = write_out(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    distinct = write_out(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    found = components(links(distinct.select("fp")))
    roots = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    group = roots.groupBy("root").agg(F.min("least").alias("component"))
    return prints.join(roots.join(group, "root").select("fp", "component"), "fp").select("id", "fp", "component")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per group: the one with the smallest id, null last; of several such rows the first by the text's hash, of
    equal texts any one. A row is named by a written number, so the same id on different texts or none at all costs no row."""
    row = free_prefix(docs.columns, "row")
    rows = numbered(docs, row)
    name = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(row).alias("row"))
    near = near_duplicates(rows.select(name.alias("name"), F.col(text_col).alias("text")), id_col="name", shingle=shingle)
    first = near.where(F.col("id.row") == F.col("component.row")).select(F.col("id.row").alias(f"{row}2"))
    return rows.join(first, F.col(row) == F.col(f"{row}2"), "left_semi").drop(row)
