"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``window`` consecutive words of each item (an item of fewer words is one window). Patterns of
one length form a set: a table gives for each block of up to three words how far the search may move on (the distance of
the block's last place in any pattern from the end, or the longest safe step if no pattern has it); at distance zero the
block's bucket of suffix-hashed patterns is compared with the text directly. Pairs of a window and an item are searched in
sets of about ``MOST_WINDOWS``, each broadcast for one pass over the documents, so what is broadcast is bounded for any
benchmark, also where very many items share a window. Further passes write what they found, not the documents.

Cases: null or wordless documents have no words, hits or items; null or wordless items are no pattern; equal windows of
several items count for each of these items; repeated documents are judged alike; an empty benchmark marks nothing; an
empty table gives no rows; null ids of items are left out of the list; further columns stay, but those with the name of an
added one are replaced (``prefix`` is a parameter); ``clean_documents`` returns all columns as they came.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typica.llm.common import bounded_batches, discard, free_prefix, numbered, unclashed, write_out

BLOCK, WINDOW = 3, 13
#: Windows per broadcast. Their tables take some 120 MB in a Python worker (measured on random words).
MOST_WINDOWS = 100_000
#: Rows of hits up to which they are broadcast to the documents: a few hundred bytes each.
BROADCAST_HITS = 50_000
#: Bytes of UTF-8 to spaces and lower-cased letters: words are digits, letters and all bytes from 0x80.
BYTES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(BYTES).split() if text else []


class Patterns:
    """Shift tables and suffix buckets, per pattern length."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[str | None]]):
        self.sets: list[tuple[int, int, int, dict, dict]] = []
        lengths = defaultdict(list)
        for w in windows:
            lengths[len(w)].append(w)
        for m, group in sorted(lengths.items()):
            size = min(BLOCK, m)
            far = m - size + 1
            shift: dict[tuple[bytes, ...], int] = {}
            bucket = defaultdict(list)
            for w in group:
                for end in range(size, m + 1):
                    block = w[end - size : end]
                    shift[block] = min(shift.get(block, far), m - end)
                bucket[hash(w[m - size :])].append((w, windows[w]))
            self.sets.append((m, size, far, shift, dict(bucket)))

    def search(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Where patterns stand, as [from, to) of words in order of their ends, and the items they come from."""
        spans, items, n = [], set(), len(text)
        for m, size, far, shift, bucket in self.sets:
            at, step = m, shift.get
            while at <= n:
                block = tuple(text[at - size : at])
                move = step(block, far)
                if move:
                    at += move
                    continue
                here = tuple(text[at - m : at])
                for w, owners in bucket[hash(block)]:
                    if w == here:
                        spans.append((at - m, at))
                        items.update(o for o in owners if o is not None)
                at += 1
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of the spans, as disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, words): a row per window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list] = ([], [])
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words(text)
                for i in range(max(1, len(w) - window + 1) if w else 0):
                    out[0].append(item)
                    out[1].append(b" ".join(w[i : i + window]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary())], ["item", "words"])

    return benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string"), F.col(text_col).cast("binary")).mapInArrow(run, "item string, words binary")


#: The tables that a worker built last, by the broadcast that they come from: the tasks of a worker share them.
_BUILT: dict[str, Patterns] = {}


def built(windows) -> Patterns:
    name, held = windows.value
    if name not in _BUILT:
        _BUILT.clear()
        same: dict[bytes, bytes] = {}
        _BUILT[name] = Patterns({tuple(same.setdefault(x, x) for x in w.split(b" ")): items for w, items in held.items()})
    return _BUILT[name]


def search_all(rows: DataFrame, windows, text_col: str, names: tuple[str, ...], *, hits_only: bool = False) -> DataFrame:
    """rows with columns of these four names: words, hit words, their spans (from, to, from, to, ...) and item ids.

    hits_only: only the other columns than the text, of rows with a hit.
    """
    at, kept = rows.columns.index(text_col), [c for c in rows.columns if not hits_only or c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = built(windows)
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [])
            for text in b.column(at).cast(pa.binary()).to_pylist():
                w = words(text)
                spans, items = patterns.search(w)
                spans = merged(spans)
                for c, x in zip(cols, (len(w), sum(b - a for a, b in spans), [x for s in spans for x in s], sorted(items)), strict=True):
                    c.append(x)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()))
            own = [b.column(i) for i, c in enumerate(b.schema.names) if not hits_only or i != at]
            out = pa.RecordBatch.from_arrays([*own, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [*kept, *names])
            yield out.filter(pa.array([n > 0 for n in cols[1]], pa.bool_())) if hits_only else out

    types = dict(zip(names, ("bigint", "bigint", "array<bigint>", "array<string>"), strict=True))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept]
    return rows.mapInArrow(run, ", ".join([*schema, *(f"`{n}` {t}" for n, t in types.items())]))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")).cast("bigint")


def _together(passes: list[DataFrame], row: str) -> DataFrame:
    """(row, hit, spans, found) over several passes' hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_spans = [merged([s for own in parts for s in zip(own[::2], own[1::2], strict=True)]) for parts in b.column(1).to_pylist()]
            found = [sorted({x for part in parts for x in part}) for parts in b.column(2).to_pylist()]
            cols = (pa.array([sum(y - x for x, y in s) for s in all_spans], pa.int64()), pa.array([[x for pair in s for x in pair] for s in all_spans], pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], [row, "hit", "spans", "found"])

    every = reduce(DataFrame.unionByName, passes).groupBy(row).agg(F.collect_list("spans").alias("s"), F.collect_list("found").alias("f"))
    return every.mapInArrow(run, f"`{row}` bigint, hit bigint, spans array<bigint>, found array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, share: int = 20, prefix: str = "dc_", most_windows: int | None = None) -> DataFrame:
    """docs' columns with {prefix}n_words, n_hit, spans (hit words as from, to, from, to, ...), found (item ids), n_items,
    items_sha256 and contaminated (some word is hit and share * n_hit >= n_words).

    One set of windows is one pass without a shuffle. For several, the documents are written once with row numbers, each
    pass writes its hits, and these are joined with the documents; one set at a time is in memory.
    """
    spark, p = docs.sparkSession, prefix
    bounded_batches(spark)
    docs = unclashed(docs, *(f"{p}{x}" for x in ("n_words", "n_hit", "spans", "found", "n_items", "items_sha256", "contaminated")))
    pairs = write_out(item_windows(benchmark, item_col, item_text_col, window).distinct(), "windows")
    parts = max(1, -(-pairs.count() // (most_windows or MOST_WINDOWS)))

    def sent(k: int):
        windows: dict[bytes, list[str]] = defaultdict(list)
        for item, text in pairs.where(F.pmod(F.xxhash64("words", "item"), F.lit(parts)) == k).collect():  # about most_windows
            windows[bytes(text)].append(item)
        return spark.sparkContext.broadcast((uuid.uuid4().hex, dict(windows)))

    names = tuple(f"{p}{x}" for x in ("n_words", "n_hit", "spans", "found"))
    if parts == 1:
        out = search_all(docs, sent(0), text_col, names)
        discard(pairs)
    else:
        row = free_prefix(docs.columns, "dc_row")
        rows = numbered(docs, row)
        hits = [write_out(search_all(rows.select(row, text_col), sent(k), text_col, ("n", "hit", "spans", "found"), hits_only=True), "hits") for k in range(parts)]
        found = write_out(_together(hits, row), "all-hits")
        discard(pairs, *hits)
        found = F.broadcast(found) if found.count() <= BROADCAST_HITS else found
        own = found.select(F.col(row).alias(f"{row}2"), F.struct("hit", "spans", "found").alias(f"{row}3"))
        joined = rows.join(own, F.col(row) == F.col(f"{row}2"), "left")
        empty = (F.lit(0).cast("bigint"), F.array().cast("array<bigint>"), F.array().cast("array<string>"))
        given = [F.coalesce(F.col(f"{row}3.{c}"), e).alias(n) for c, e, n in zip(("hit", "spans", "found"), empty, names[1:], strict=True)]
        out = joined.select(*(F.col(f"`{c}`") for c in docs.columns), n_words(F.col(text_col)).alias(names[0]), *given)
    listed = F.array_join(F.array_sort(names[3]), ",")
    bad = (F.col(names[1]) > 0) & (share * F.col(names[1]) >= F.col(names[0]))
    return out.withColumns({f"{p}n_items": F.size(names[3]).cast("long"), f"{p}items_sha256": F.sha2(listed, 256), f"{p}contaminated": bad})


def clean_documents(docs: DataFrame, benchmark: DataFrame, **rule) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    p = free_prefix(docs.columns, "dc_")
    judged = decontaminate(docs, benchmark, prefix=p, **rule)
    return judged.where(~F.col(f"{p}contaminated")).select(*(F.col(f"`{c}`") for c in docs.columns))
