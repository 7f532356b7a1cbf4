"""Compression of vectors to a few bytes: each part of a vector becomes the index of its codebook's nearest entry.

Codebooks are fitted by rounds over all vectors in whole numbers, so results don't depend on how rows are dealt. The nearest
entry is found as in a vector approximation file: the coordinates of entries are quantised to few bits, a table for each
part of a vector holds how near and how far each cell can be, sums over coordinates bound every entry's distance, and only
entries whose bounds overlap the best are measured.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typica.llm.common import discard, free_prefix, write_out
from typica.llm.integers import rounded, usable, whole_matrix
from typica.llm.quality_rules import joined_by

#: Bits of a cell's number, for each coordinate.
BITS = 4


class Cells:
    """The entries of a part's codebook, with each coordinate's cell and that cell's ends."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        low = entries.min(0)
        width = (entries.max(0) - low) // (1 << bits) + 1
        self.cell = (entries - low) // width  # (entries, coordinates)
        at = np.arange(1 << bits)
        self.low = low[:, None] + at * width[:, None]  # (coordinates, cells)
        self.high = self.low + width[:, None] - 1

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest squared distance that the cells allow, of each row of x to each entry."""
        least = np.zeros((len(x), len(self.entries)), np.int64)
        most = np.zeros_like(least)
        for j in range(x.shape[1]):
            below, above = self.low[j] - x[:, j, None], x[:, j, None] - self.high[j]
            near, far = np.maximum(np.maximum(below, above), 0), np.maximum(-below, -above)
            far = np.maximum(far, near + (self.high[j] - self.low[j]))
            least += (near * near)[:, self.cell[:, j]]
            most += (far * far)[:, self.cell[:, j]]
        return least, most

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, int]:
        """Of each row of x the nearest entry, ties to the lower index, and how many distances were measured."""
        least, most = self.bounds(x)
        open_ = least <= most.min(1)[:, None]
        out = open_.argmax(1)
        several = np.flatnonzero(open_.sum(1) > 1)
        row, entry = np.nonzero(open_[several])
        d = x[several[row]] - self.entries[entry]
        measured = np.full((len(several), len(self.entries)), np.iinfo(np.int64).max)
        measured[row, entry] = (d * d).sum(1)
        out[several] = measured.argmin(1)
        return out, len(row)


def _books(entries: np.ndarray, parts: int) -> list[Cells]:
    """entries: (entries, length of a vector)."""
    return [Cells(np.ascontiguousarray(e)) for e in np.split(entries, parts, axis=1)]


def fit(vectors: DataFrame, *, parts: int = 8, entries: int = 16, rounds: int = 6, id_col: str = "id", vec_col: str = "v") -> np.ndarray:
    """The codebooks (entries, length of a vector) of whole-number vectors of one length, after so many rounds.

    They start as the vectors of the smallest ids (null ids last, repeated ids by vector); fewer vectors are fewer entries.
    A round is one pass over all vectors: tasks add up counts and sums, Spark adds those, and the driver gets one number
    for each entry and coordinate.
    """
    first = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    book = np.array([r["v"] for r in first] or np.zeros((0, parts)), np.int64)
    k, d = book.shape
    if not k:
        return book
    spark, w = vectors.sparkSession, d // parts
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(_books(book, parts))

        def add(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros((parts, k), np.int64), np.zeros((k, d), np.int64)
            for b in batches:
                x = whole_matrix(b.column(0), d)
                for p, cells in enumerate(sent.value):
                    own = x[:, p * w : (p + 1) * w]
                    chosen = cells.nearest(own)[0]
                    n[p] += np.bincount(chosen, minlength=k)
                    for e in np.unique(chosen):
                        total[e, p * w : (p + 1) * w] += own[chosen == e].sum(0)
            e, j = np.nonzero(np.repeat(n.T, w, axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(e), pa.array(j), pa.array(n[j // w, e]), pa.array(total[e, j])], ["e", "j", "n", "total"])

        sums = vectors.select(vec_col).mapInArrow(add, "e bigint, j bigint, n bigint, total bigint").groupBy("e", "j").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        for e, j, n, total in sums.collect():
            book[e, j] = total // n
        sent.unpersist()
    return book


def encode(vectors: DataFrame, book: np.ndarray, *, parts: int = 8, vec_col: str = "v", code_col: str = "code", error_col: str = "error") -> DataFrame:
    """vectors with code (two hex digits for each part, in order) and error (squared distance to what the code stands for)
    in place of the vector."""
    kept = [c for c in vectors.columns if c != vec_col]
    rows, (_, d) = vectors.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{vec_col}`")), book.shape
    sent, w = vectors.sparkSession.sparkContext.broadcast(_books(book, parts) if len(book) else []), d // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, code, error = whole_matrix(b.column(b.num_columns - 1), d), np.zeros((b.num_rows, parts), np.uint8), np.zeros(b.num_rows, np.int64)
            for p, cells in enumerate(sent.value):
                own = x[:, p * w : (p + 1) * w]
                chosen = cells.nearest(own)[0]
                code[:, p] = chosen
                error += ((own - cells.entries[chosen]) ** 2).sum(1)
            text = code.tobytes().hex()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string()), pa.array(error)], [*kept, code_col, error_col])

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), f"`{code_col}` string", f"`{error_col}` bigint"])
    return rows.mapInArrow(run, schema)


def decode(code: bytes | str, book: np.ndarray, parts: int = 8) -> np.ndarray:
    """The vector that a code stands for."""
    own = bytes.fromhex(code) if isinstance(code, str) else code
    return np.concatenate([b[e] for b, e in zip(np.split(book, parts, axis=1), own, strict=True)])


def compress(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label", scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """id, code, error, label_error (the error summed over rows of equal labels, nulls together) and codebooks_sha256, a row
    for each vector that takes part.

    Vectors become whole numbers floor(scale * x). Null and empty vectors, those with null or non-finite components, those
    of another length than most, and all where the length is no multiple of parts take no part; an empty table gives an
    empty table. Null ids are coded like others, repeated rows fare alike, of equally near entries the lower is taken. A
    component beyond about 2^27 after scaling is an error. Further columns, whatever their names, are not read.
    """
    if entries > 256:
        raise ValueError("an entry's number is one byte")
    label = F.lit(0) if label_col is None else F.col(f"`{label_col}`")
    given = vectors.select(F.col(f"`{id_col}`").alias("id"), label.alias("label"), rounded(F.col(f"`{vec_col}`"), scale).alias("v"))
    written = write_out(given.where("v is not null"), "whole-vectors")
    rows, d = usable(written, "v")
    if d % parts:
        rows = rows.where(F.lit(False))
    book = fit(rows, parts=parts, entries=entries, rounds=rounds)
    digest = hashlib.sha256(",".join(str(x) for part in np.split(book, parts, axis=1) for x in part.ravel()).encode() if book.size else b"").hexdigest()
    codes = write_out(encode(rows, book, parts=parts), "codes")
    discard(written)
    sums = write_out(codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    out = joined_by(codes, sums, ["label"], "n")
    name = id_col if id_col not in ("code", "error", "label_error", "codebooks_sha256") else free_prefix(["code", "error", "label_error", "codebooks_sha256"], id_col)
    return out.select(F.col("id").alias(name), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
