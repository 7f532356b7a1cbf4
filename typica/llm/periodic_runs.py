"""Periodic runs of words: stretches in which some words repeat over and over, found on a harmonic grid.

A run of period p and length L has L - p places whose word stands again p words later. That stretch is at least
max(least, exponent * p) - p words long, so it covers a point of the grid with that step. All pairs (period, grid point) of
all texts of a batch are handled at once: n words have about n ln(n) / (exponent - 1) of them. Those whose words agree are
extended to both sides by binary search over prefix hashes; the words then decide. Texts never meet, so nothing is shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typica.llm.common import bounded_batches, free_prefix, unclashed

#: Words of texts that are handled together, and pairs of a period and a grid point that are held at once.
WORDS, PAIRS = 300_000, 250_000
#: Of the prefix hashes; odd, so that no power of it vanishes modulo 2^64.
BASE = 0x9E3779B97F4A7C15
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers spread over 64 bits."""
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Prefixes:
    """Hashes of all prefixes of a sequence, for comparing stretches in constant time each."""

    def __init__(self, ids: np.ndarray, spread=mixed):
        self.power = np.full(len(ids) + 1, BASE, np.uint64)
        self.power[0] = 1
        self.power = np.cumprod(self.power)
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(spread(ids) * self.power[:-1], out=self.sums[1:])

    def same(self, a: np.ndarray, shift: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether n values from a on seem to equal those shift further on; equal ones always do."""
        b = a + shift
        return (self.sums[a + n] - self.sums[a]) * self.power[shift] == self.sums[b + n] - self.sums[b]


def furthest(holds, most: np.ndarray) -> np.ndarray:
    """For each row the largest n up to most for which holds(rows, n), which holds up to some n and from there on doesn't."""
    low, high = np.zeros(len(most), np.int64), most.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        mid = (low[open_] + high[open_] + 1) >> 1
        ok = holds(open_, mid)
        low[open_[ok]] = mid[ok]
        high[open_[~ok]] = mid[~ok] - 1
        open_ = open_[low[open_] < high[open_]]
    return low


def grid_pairs(starts: np.ndarray, least: int, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, place) of all grid points of all periods of texts that lie at starts[k] to starts[k + 1]."""
    sizes = np.diff(starts)
    periods = np.where(sizes >= least, sizes // exponent, 0)
    text = np.repeat(np.arange(len(sizes)), periods)
    p = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum(least, exponent * p) - p
    points = -(-(sizes[text] - p) // step)
    ends = np.cumsum(points)
    lo = 0
    while lo < len(p):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
        n = points[lo:hi]
        each = np.repeat(np.arange(lo, hi), n)
        k = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        yield text[each], p[each], starts[text[each]] + k * step[each]
        lo = hi


def runs_of(ids: np.ndarray, starts: np.ndarray, least: int = 6, exponent: int = 4, spread=mixed) -> np.ndarray:
    """Rows (text, start, length, period) of the runs, by text, start and period; starts count from 0 in each text.

    ids: the words of all texts as numbers, texts at starts[k] to starts[k + 1].
    """
    hashes = Prefixes(ids, spread)
    inside = np.full(len(ids), -1)  # of each word, one of the runs found so far that it lies in
    known = np.zeros((0, 4), np.int64)
    for text, p, i in grid_pairs(starts, least, exponent):
        near = ids[i] == ids[i + p]
        text, p, i = text[near], p[near], i[near]
        if len(known):
            # a run of period q that is p + q long and has both words is also the run of a multiple p of q through them
            _, s, n, q = known[inside[i]].T
            new = (inside[i] < 0) | (p % q != 0) | (i + p >= s + n) | (n < p + q)
            text, p, i = text[new], p[new], i[new]
        ahead = furthest(lambda r, n, p=p, i=i: hashes.same(i[r], p[r], n), starts[text + 1] - i - p)
        back = furthest(lambda r, n, p=p, i=i: hashes.same(i[r] - n, p[r], n), i - starts[text])
        long = ahead + back + p >= np.maximum(least, exponent * p)
        exact = _verified(ids, np.stack([text, p, i, ahead, back], 1)[long], least, exponent)
        for k, (_, s, n, _) in enumerate(exact, len(known)):
            part = inside[s : s + n]
            part[part < 0] = k
        known = np.concatenate([known, exact]) if len(exact) else known
    out = _smallest(known)[0]
    out[:, 1] -= starts[out[:, 0]]
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _smallest(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows (text, start, length, period) with the smallest period of their stretch, and which row has that of each row."""
    order = np.lexsort(runs.T[::-1])
    rows = runs[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
    head = np.empty(len(rows), np.int64)
    head[order] = order[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(rows) else 0
    return rows[first], head


def _verified(ids: np.ndarray, pairs: np.ndarray, least: int, exponent: int) -> np.ndarray:
    """The runs (text, start, length, period) of pairs (text, period, place, words ahead, words back) after a look at the words."""
    while True:
        text, p, i, ahead, back = pairs.T
        runs = np.stack([text, i - back, ahead + back + p, p], 1)
        small, head = _smallest(runs)
        # a multiple of a period that holds for the stretch holds too; anything else is checked on its own
        asked = np.concatenate([small, runs[p % p[head] != 0]])
        wrong = {tuple(r) for r in np.unique(asked, axis=0).tolist() if not np.array_equal(ids[r[1] : r[1] + r[2] - r[3]], ids[r[1] + r[3] : r[1] + r[2]])}
        if not wrong:
            return small if (p % p[head] == 0).all() else np.unique(runs, axis=0)
        # hashes that agreed although words differ: extensions are too long, never too short; let the words say how far they go
        for k, (run, first) in enumerate(zip(runs.tolist(), runs[head].tolist(), strict=True)):
            if tuple(run) in wrong or tuple(first) in wrong:
                _, q, at, a, b = pairs[k]
                differs = ids[at : at + a] != ids[at + q : at + q + a]
                pairs[k, 3] = differs.argmax() if differs.any() else a
                differs = (ids[at - b : at] != ids[at + q - b : at + q])[::-1]
                pairs[k, 4] = differs.argmax() if differs.any() else b
        pairs = pairs[pairs[:, 3] + pairs[:, 4] + pairs[:, 1] >= np.maximum(least, exponent * pairs[:, 1])]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run has after its first period, with one space between."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 1] + runs[:, 3], 1)
    np.add.at(edge, runs[:, 1] + runs[:, 2], -1)
    return b" ".join(compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))


def _together(texts: list[list[bytes]], least: int, exponent: int) -> tuple[list[np.ndarray], list[bytes]]:
    """Runs and collapsed text of each list of words."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    starts = np.cumsum([0, *map(len, texts)])
    ids = np.fromiter((number[w] for words in texts for w in words), np.int64, starts[-1])
    rows = runs_of(ids, starts, least, exponent)
    cuts = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
    own = [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    return own, [collapsed(w, r) for w, r in zip(texts, own, strict=True)]


def periodic_runs(docs: DataFrame, *, text_col: str = "text", least: int = 6, exponent: int = 4, prefix: str = "pr_") -> DataFrame:
    """docs with {prefix}n_words, {prefix}runs (start, length, period, by start and period) and {prefix}collapsed.

    Words stand between ASCII white space and count from 0. A run is a stretch with smallest period q and a length of at
    least max(least, exponent * q), exponent 2 or more, that can't be made longer. The collapsed text has the words that no
    run contains after its first q words, with one space between. Null, empty and blank texts have no words, no runs and
    an empty collapsed text; long texts are searched whole; repeated rows fare alike; an empty table gives an empty table.
    Columns of docs that have the names of added ones are replaced.
    """
    if exponent < 2 or least < 2:
        raise ValueError("a run repeats at least once: exponent and least are 2 or more")
    bounded_batches(docs.sparkSession)
    docs = unclashed(docs, *(f"{prefix}{n}" for n in ("n_words", "runs", "collapsed")))
    t = free_prefix(docs.columns, "pr_text")
    given = docs.select(*(F.col(f"`{c}`") for c in docs.columns), F.col(f"`{text_col}`").cast("binary").alias(t))
    fields = [*docs.columns, f"{prefix}n_words", f"{prefix}runs", f"{prefix}collapsed"]
    kinds = [f.dataType.simpleString() for f in docs.schema] + ["bigint", RUNS, "string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lo, n = [], 0, 0
            for hi, text in enumerate(b.column(b.num_columns - 1), 1):
                texts.append((text.as_py() or b"").split())  # bytes split at ASCII white space alone
                n += len(texts[-1])
                if n >= WORDS or hi == b.num_rows:
                    own, short = _together(texts, least, exponent)
                    rows = np.concatenate([np.zeros((0, 4), np.int64), *own])
                    struct = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]), pa.int32()), struct)
                    done = [pa.array(list(map(len, texts)), pa.int64()), lists, pa.array(short, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns[:-1], *done], fields)
                    texts, lo, n = [], hi, 0

    return given.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in zip(fields, kinds, strict=True)))
