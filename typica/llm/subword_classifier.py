"""Supervised subword embeddings: hashed vectors of words and character n-grams, averaged per document, into a softmax.

Training runs in numpy on at most ``rows_per_class`` labelled documents of each class (those of the smallest id hashes) of
at most ``most_chars`` characters each, so what the driver collects is bounded; one document is a step; the classes' true shares among all labelled training rows then shift the output. Since the output is
linear in the average, scoring adds one number per word from a table of the hashed features' projections.

Words are those between ASCII white space, case kept; ``\\n`` ends a line and counts as a word, as does one mark for a word
that repeats the one before it. Nothing but the text enters a score.

Cases: null and empty texts have no features and score the output's bias; rows without label, with a null label or of the
held-out fold train nothing, nor do texts longer than ``most_chars`` (they are scored whole); repeated labels of an id vote;
an id on several texts trains on the one with the smallest hash; with fewer than two classes the score is the share of label
1 (0.5 without labels); repeated rows score alike; an empty table gives no rows; further columns are kept, but one with the
name of the added one (``prefix``) is replaced; ``good_documents`` returns all columns.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typica.llm.common import bounded_batches, free_prefix, some_rows, unclashed

BUCKETS, DIM, GRAMS = 1 << 16, 16, (3, 4)
LINE, AGAIN = "\n", "\r"
#: Words whose sums a worker keeps; beyond that it starts anew.
CACHE = 200_000


SPLIT = re.compile(r"[^ \t\n\r\x0b\x0c]+|\n").findall


def tokens(text: str | None) -> list[str]:
    """Words, line ends and marks of repetition."""
    found = SPLIT(text) if text else []
    if any(map(eq, found, islice(found, 1, None))):
        found = [x for a, b in zip(["", *found], found, strict=False) for x in ((AGAIN, b) if a == b != LINE else (b,))]
    return found


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, place of its word) for every word and each of its character n-grams with < and > at the ends.

    n-grams are hashed by a polynomial of their code points, all words of the list at once; marks have no n-grams.
    """
    n = len(words)
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(n), np.fromiter(map(len, words), np.int64, n) + 2)
    plain = np.fromiter((w not in (LINE, AGAIN) for w in words), bool, n)
    buckets = [np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint32, n) % BUCKETS]
    owners = [np.arange(n)]
    for g in GRAMS:
        last = len(codes) - g + 1
        if last <= 0:
            continue
        h = np.full(last, g, np.uint32)
        for j in range(g):
            h = h * np.uint32(0x01000193) + codes[j : last + j]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        ok = (owner[:last] == owner[g - 1 :]) & plain[owner[:last]]
        buckets.append(h[ok] % BUCKETS)
        owners.append(owner[:last][ok])
    return np.concatenate(buckets).astype(np.int32), np.concatenate(owners)


@dataclass
class Model:
    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def projections(self) -> tuple[np.ndarray, float]:
        """Per bucket what it adds to the log odds of class 1, and the bias."""
        return (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float64), float(self.bias[1] - self.bias[0])


def train(texts: list[str], labels: list[int], *, steps: int = 16_000, rate: float = 0.5, seed: int = 7) -> Model:
    """At least steps steps, in whole rounds over the rows, at a rate that falls to zero."""
    rng = np.random.default_rng(seed)
    model = Model(rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32), np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32))
    rows = []
    for t in texts:
        times = Counter(tokens(t))
        at, owner = features(list(times)) if times else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        share = np.bincount(at, np.fromiter(times.values(), np.float64, len(times))[owner], BUCKETS) if times else np.zeros(BUCKETS)
        at = np.flatnonzero(share).astype(np.int32)
        rows.append((at, (share[at] / max(1.0, share.sum())).astype(np.float32)))
    rounds = -(-steps // len(rows))
    step, steps = 0, rounds * len(rows)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            lr = np.float32(rate * (1 - step / steps))
            step += 1
            at, share = rows[i]
            h = share @ model.vectors[at]
            z = h @ model.output + model.bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = model.output @ p
            model.output -= lr * np.outer(h, p)
            model.bias -= lr * p
            model.vectors[at] -= np.outer(lr * share, back)
    return model


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id is empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: Column, rows_per_class: int = 1500, most_chars: int = 200_000) -> tuple[np.ndarray, float]:
    """(projections, bias) learned from docs joined with labels where train_rows holds (a column over the id alone)."""
    voted = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col), F.col(label_col).cast("double").alias("y")).where(train_rows).groupBy(id_col).agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    share = {r["y"]: r["count"] for r in voted.groupBy("y").count().collect()}
    if len(share) < 2:
        only = 0.5 if not share else float(next(iter(share)))
        return np.zeros(BUCKETS), {0.5: 0.0, 1.0: 20.0, 0.0: -20.0}[only]
    some = [some_rows(voted.where(F.col("y") == y), F.col(id_col), rows_per_class, share[y]) for y in (0, 1)]
    chosen = some[0].unionByName(some[1]).select(F.col(id_col).alias("__id"), "y")  # at most 2 * rows_per_class rows
    own, text = F.broadcast(chosen), F.coalesce(F.col(text_col), F.lit(""))
    usable = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(own, F.col("id") == F.col("__id")).where(F.length("text") <= most_chars).select("id", "text", "y", F.xxhash64("text").alias("h"))
    least = usable.groupBy("id").agg(F.min("h").alias("least")).withColumnRenamed("id", "own")  # an id's rows may be many, its text is one
    rows = usable.join(F.broadcast(least), (F.col("id") == F.col("own")) & (F.col("h") == F.col("least"))).groupBy("id").agg(F.first("text").alias("text"), F.first("y").alias("y")).collect()
    rows = sorted(rows, key=lambda r: (r["id"], r["text"]))
    if not rows:
        return np.zeros(BUCKETS), float(np.log(share[1] / share[0]))
    model = train([r["text"] for r in rows], [r["y"] for r in rows])
    seen = sum(r["y"] for r in rows)
    weights, bias = model.projections()
    prior = np.log(share[1] / share[0]) - np.log(max(1, seen) / max(1, len(rows) - seen))
    return weights, bias + float(prior)


def score(docs: DataFrame, model: tuple[np.ndarray, float], *, text_col: str = "text", prefix: str = "qc_") -> DataFrame:
    """docs with {prefix}score, the probability of class 1. One pass, no shuffle."""
    docs = unclashed(docs, f"{prefix}score")
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        place: dict[str, int] = {}
        total, size = np.zeros(0), np.zeros(0)
        for b in batches:
            if len(place) > CACHE:
                place, total, size = {}, np.zeros(0), np.zeros(0)
            texts = [tokens(t) for t in b.column(at).to_pylist()]
            new = list({w for t in texts for w in t if w not in place})
            for lo in range(0, len(new), 20_000):
                some = new[lo : lo + 20_000]
                ids, owner = features(some)
                place.update(zip(some, range(len(place), len(place) + len(some)), strict=True))
                total = np.append(total, np.bincount(owner, weights[ids], len(some)))
                size = np.append(size, np.bincount(owner, minlength=len(some)))
            out = []
            for t in texts:
                mine = np.fromiter(map(place.__getitem__, t), np.int64, len(t))
                z = bias + (total[mine].sum() / size[mine].sum() if len(t) else 0.0)
                out.append(1 / (1 + np.exp(-max(-700.0, min(700.0, z)))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*b.schema.names, f"{prefix}score"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{own}, `{prefix}score` double")


def good_documents(docs: DataFrame, labels: DataFrame, *, bound: float = 0.7, folds: int = 4, held: int = 2) -> DataFrame:
    """The documents that score at least bound, with their own columns."""
    model = fit(docs, labels, train_rows=fold("doc_id", folds) != held)
    p = free_prefix(docs.columns, "qc_")
    return score(docs, model, prefix=p).where(F.col(f"{p}score") >= bound).select(*(F.col(f"`{c}`") for c in docs.columns))
