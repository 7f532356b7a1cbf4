"""Log-bilinear language model trained by noise-contrastive estimation, and the unigram base that it is held against.

Word counts are taken over all training documents. Words are predicted as units: each of the most frequent words, at most
``HEAD``, is one, and the rarer words are dealt by their endings into ``CLASSES`` units more, inside which a word has its
add-one share, so every counted word has a probability of its own and what is gathered grows with the corpus. Contexts are
the ``TOP`` most frequent words and, for all others, the classes of their endings: q(h) = U1[context of the previous word] +
U2[that of the one before], score(unit | h) = q(h) . R[unit] + b[unit].

Training documents are dealt by a hash of id and text into shards of about ``SHARD`` tokens (at most ``SHARDS`` shards), and
a shard is read in order of that hash; so the shards, and the scores, depend on the documents and not on how the cluster
holds them. Each shard runs minibatches of NCE over all of its tokens from the same start (noise: the unigram model, shared
within a minibatch); then a row of parameters becomes the mean over the shards that moved it, weighed by their tokens.

Scores are normalised exactly: the normalisers of all pairs of contexts are sums of matrix products over blocks of units,
exp(U1 R') times exp(U2 R' + b)'.

Counts of the most frequent tokens, at most ``HEAD``, are broadcast; rarer words of documents are joined with the
count table.

Cases: null text is empty and has the end token only; null ids are trained on as the text ''; words that the training
documents lack have count zero; without training documents all counts are zero; repeated rows are scored row by row; an
empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typica.llm.common import bounded_batches, write_out

#: The end of a text as a token; no word contains it.
END = "\n"
HEAD, DIM = 200_000, 16
#: Contexts: frequent words, classes of endings, and the start of a text; the normalisers are a table of their pairs.
TOP, CLASSES = 704, 319
#: Training tokens of a shard, and most shards: what a row of parameters is averaged over.
SHARD, SHARDS = 8_000_000, 4096
#: Tokens that are learned from, or units that normalisers are summed over, at once.
CHUNK, UNITS = 1 << 16, 2048
#: Words of a partition that are counted before they are passed on.
FLUSH = 200_000


def words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, count), the end token included: counted per task, then added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "count"])

        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(words(text))
            seen[END.encode()] += b.num_rows
            if len(seen) > FLUSH:
                yield out()
                seen.clear()
        yield out()

    return docs.select(F.col(text_col).cast("binary")).mapInArrow(run, "word string, count bigint").where("count > 0").groupBy("word").agg(F.sum("count").alias("count"))


def frequent_from(counts: DataFrame) -> int:
    """The least count from which on there are at most HEAD words: exact up to 1000, then by steps of one per cent."""
    step = F.when(F.col("count") < 1000, F.col("count")).otherwise(F.floor(F.ln(F.col("count") / 1000) / 0.01) + 1000)
    steps = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("count").alias("least")).collect()  # some thousand rows
    total, least = 0, 1 << 62
    for r in sorted(steps, key=lambda r: -r["step"]):
        total += r["n"]
        if total > HEAD:
            break
        least = r["least"]
    return least


def class_of(word: str) -> int:
    """By the last three characters."""
    return zlib.crc32(word[-3:].encode()) % CLASSES


def class_column(word: Column) -> Column:
    return (F.crc32(F.right(word, F.lit(3)).cast("binary")) % CLASSES).cast("int")


@dataclass
class Parameters:
    """U1, U2: (contexts, DIM); R: (units, DIM); b: (units)."""

    u1: np.ndarray
    u2: np.ndarray
    r: np.ndarray
    b: np.ndarray

    def normalisers(self) -> np.ndarray:
        """ln Z for every pair (context of the previous word, of the one before)."""
        out = np.zeros((len(self.u1), len(self.u2)))
        for lo in range(0, len(self.r), UNITS):
            r, b = self.r[lo : lo + UNITS], self.b[lo : lo + UNITS]
            out += np.exp(self.u1 @ r.T) @ np.exp(self.u2 @ r.T + b).T
        return np.log(out).astype(np.float32)


def start(counts: np.ndarray, contexts: int | None = None, seed: int = 11) -> Parameters:
    rng = np.random.default_rng(seed)
    n = len(counts)
    vectors = [rng.normal(0, 0.1, (n + 1 if contexts is None else contexts, DIM)).astype(np.float32) for _ in range(2)]
    return Parameters(*vectors, np.zeros((n, DIM), np.float32), np.log(counts / counts.sum()).astype(np.float32))


@dataclass
class Vocabulary:
    """names: the frequent words in order; own: how many of them are units of their own; counts: per unit; unit, context:
    the unit of each frequent word, and the context of each unit; share: per unit minus log10 of what a rare word's count
    plus one is divided by, zero for a unit of one word."""

    names: list[bytes]
    own: int
    counts: np.ndarray
    unit: np.ndarray
    context: np.ndarray
    share: np.ndarray

    @classmethod
    def of(cls, head: list[tuple[str, int]], rare: dict[int, tuple[int, int]], own: int) -> Vocabulary:
        """rare: per class the tokens and the number of the words outside head."""
        n = min(own, len(head))
        classes = np.array([class_of(w) for w, _ in head], np.int64)
        held = np.array([c for _, c in head], np.float64)
        tokens = np.bincount(classes[n:], held[n:], CLASSES) + np.array([rare.get(k, (0, 0))[0] for k in range(CLASSES)])
        words = np.bincount(classes[n:], minlength=CLASSES) + np.array([rare.get(k, (0, 0))[1] for k in range(CLASSES)])
        unit = np.where(np.arange(len(head)) < n, np.arange(len(head)), n + classes).astype(np.int32)
        top = np.where(np.arange(n) < TOP, np.arange(n), TOP + classes[:n])
        context = np.concatenate((top, TOP + np.arange(CLASSES))).astype(np.int32)
        share = np.concatenate((np.zeros(n), -np.log10(tokens + words + 1)))
        return cls([w.encode() for w, _ in head], n, np.concatenate((held[:n], np.maximum(1, tokens))), unit, context, share)

    @property
    def contexts(self) -> int:
        return TOP + CLASSES + 1


class Reader:
    """Texts as places in the list of frequent words (-1: rarer) and as units."""

    def __init__(self, v: Vocabulary):
        self.v, self.index = v, {w: i for i, w in enumerate(v.names)}
        self.unit = np.append(v.unit, np.int32(-1))

    def read(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray, Counter]:
        """(places, units, rarer words); the end token last."""
        w = words(text)
        places = np.fromiter(map(self.index.get, w, repeat(-1)), np.int32, len(w))
        places = np.append(places, np.int32(self.index.get(END.encode(), -1)))
        units, rarer = self.unit[places], Counter()
        gone = np.flatnonzero(places < 0).tolist()
        if gone:
            w.append(END.encode())
            rare = [w[i].decode("utf-8", "replace") for i in gone]
            units[gone] = [self.v.own + class_of(x) for x in rare]
            rarer.update(rare)
        return places, units, rarer


START_SEEN = np.float32(1e-6)


class Trainer:
    """Minibatch NCE with a step size per row and shared noise."""

    def __init__(self, p: Parameters, counts: np.ndarray, *, batch: int = 1024, noise: int = 64, rate: float = 0.1, seed: int | tuple[int, ...] = 5):
        self.p, self.batch, self.noise, self.rate = p, batch, noise, rate
        self.share = counts / counts.sum()
        self.ln_kq = np.log(noise * self.share).astype(np.float32)
        self.edges, self.rng = np.cumsum(self.share), np.random.default_rng(seed)
        self.seen = {k: np.full(len(getattr(p, k)), START_SEEN, np.float32) for k in ("u1", "u2", "r", "b")}

    def _step(self, at: np.ndarray, grads: dict[str, np.ndarray]) -> None:
        """Add gradients of equal rows, then move those rows."""
        names = list(grads)
        at = at.astype(np.uint16 if len(getattr(self.p, names[0])) <= 1 << 16 else np.int32)  # short keys sort by counting
        order = np.argsort(at, kind="stable")
        placed = at[order]
        first = np.flatnonzero(np.concatenate(([True], placed[1:] != placed[:-1])))
        rows = placed[first]
        for name in names:
            g, table, seen = np.add.reduceat(grads[name][order], first, axis=0), getattr(self.p, name), self.seen[name]
            now = seen[rows] + (np.einsum("ij,ij->i", g, g) / g.shape[1] if g.ndim > 1 else g * g)
            seen[rows] = now
            scale = self.rate / np.sqrt(now)
            table[rows] += g * (scale[:, None] if g.ndim > 1 else scale)

    def learn(self, h1: np.ndarray, h2: np.ndarray, target: np.ndarray) -> None:
        for lo in range(0, len(target), self.batch):
            a, b, t = h1[lo : lo + self.batch], h2[lo : lo + self.batch], target[lo : lo + self.batch]
            p = self.p
            q = p.u1[a] + p.u2[b]
            drawn = np.minimum(np.searchsorted(self.edges, self.rng.random(self.noise)), len(self.edges) - 1)
            rt, rn = p.r[t], p.r[drawn]
            with np.errstate(over="ignore"):
                true = 1 - 1 / (1 + np.exp(self.ln_kq[t] - np.einsum("ij,ij->i", q, rt) - p.b[t]))
                false = -1 / (1 + np.exp((self.ln_kq[drawn] - p.b[drawn]) - q @ rn.T))
            dq = true[:, None] * rt + false @ rn
            self._step(a, {"u1": dq})
            self._step(b, {"u2": dq})
            self._step(np.concatenate((t, drawn)), {"r": np.concatenate((true[:, None] * q, false.T @ q)), "b": np.concatenate((true, false.sum(axis=0)))})


def _contexts(units: np.ndarray, stops: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts (previous, the one before) of each unit; units holds texts one after the other, each up to its place in stops."""
    of, first = context[units], TOP + CLASSES
    h1, h2 = np.empty_like(of), np.empty_like(of)
    h1[1:], h2[2:] = of[:-1], of[:-2]
    starts = np.concatenate(([0], stops[:-1]))
    h1[starts] = h2[starts] = first
    h2[np.minimum(starts + 1, stops - 1)] = first
    return h1, h2


#: The reader that a worker built last, by its name: the tasks of a worker share one.
_BUILT: dict[str, Reader] = {}


def reader(name: str, v: Vocabulary) -> Reader:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Reader(v)
    return _BUILT[name]


def read_all(docs: DataFrame, name: str, v: Vocabulary, base: np.ndarray, inside: np.ndarray, learned: Column, *, id_col: str, text_col: str) -> DataFrame:
    """A written row per row of docs: row (its number), id, h (hash of id and text), learned, units, the counts and the parts
    of both scores that need no model, and its rarer words with their numbers. base, inside: per frequent word."""
    sent = docs.sparkSession.sparkContext.broadcast((name, v, np.append(base, 0.0), np.append(inside, 0.0)))  # place -1: rarer words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, v, base, inside = sent.value
        r = reader(name, v)
        for b in batches:
            if not b.num_rows:
                continue
            read = [r.read(t) for t in b.column(3).to_pylist()]
            sizes = [len(x[0]) for x in read]
            stops = np.cumsum(sizes)
            starts, places, units = np.concatenate(([0], stops[:-1])), np.concatenate([x[0] for x in read]), np.concatenate([x[1] for x in read])
            sums = [np.add.reduceat(x, starts) for x in ((places >= 0).astype(np.int64), base[places], inside[places] + v.share[units])]
            lists = [pa.array([list(x[2]) for x in read], pa.list_(pa.string())), pa.array([list(x[2].values()) for x in read], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sizes, pa.int64()), *map(pa.array, sums), *lists, pa.ListArray.from_arrays(pa.array(np.append(0, stops), pa.int32()), pa.array(units))], ["id", "h", "learned", "n_tokens", "n_known", "base", "fixed", "rare", "times", "units"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col), F.lit(3)).alias("h"), F.coalesce(learned, F.lit(False)).alias("learned"), F.col(text_col).cast("binary").alias("t"))
    read = rows.mapInArrow(run, f"id {kind}, h bigint, learned boolean, n_tokens bigint, n_known bigint, base double, fixed double, rare array<string>, times array<bigint>, units array<int>")
    return write_out(read.withColumn("row", F.monotonically_increasing_id()), "read")


def train(read: DataFrame, v: Vocabulary, *, rounds: int = 1) -> Parameters:
    """One or more passes over the learned rows of read_all; after each the shards' parameters are averaged."""
    spark = read.sparkSession
    p = start(v.counts, v.contexts)
    shards = int(min(SHARDS, max(1, -(-v.counts.sum() // SHARD))))
    dealt = read.where("learned").select(F.pmod("h", F.lit(shards)).cast("int").alias("shard"), "h", "units").repartition(shards, "shard").sortWithinPartitions("shard", "h")
    for k in range(rounds):
        sent = spark.sparkContext.broadcast((p, v.counts, v.context))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, k=k) -> Iterator[pa.RecordBatch]:
            given, counts, context = sent.value
            trainer, own, seen, held, n_held = None, None, 0, [], 0

            def learn() -> None:
                nonlocal held, n_held, seen
                if held:
                    units = np.concatenate(held)
                    trainer.learn(*_contexts(units, np.cumsum([len(x) for x in held]), context), units)
                    seen += len(units)
                held, n_held = [], 0

            def moved() -> Iterator[pa.RecordBatch]:
                for part in ("u1", "u2", "r", "b"):
                    at = np.flatnonzero(trainer.seen[part] > START_SEEN)
                    x = getattr(trainer.p, part)[at].astype(np.float64).reshape(len(at), 1 if part == "b" else DIM) * seen
                    flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array([part] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(np.full(len(at), float(seen))), flat], ["part", "at", "n", "x"])

            for b in batches:
                flat, cuts = b.column(2).flatten().to_numpy(zero_copy_only=False), b.column(2).offsets.to_numpy()
                for i, shard in enumerate(b.column(0).to_pylist()):
                    if shard != own:
                        if trainer:
                            learn()
                            yield from moved()
                        trainer = Trainer(Parameters(*(x.copy() for x in (given.u1, given.u2, given.r, given.b))), counts, seed=(5, k, shard))
                        own, seen = shard, 0
                    held.append(flat[cuts[i] - cuts[0] : cuts[i + 1] - cuts[0]])
                    n_held += len(held[-1])
                    if n_held >= CHUNK:  # by documents in order, whatever the batches are
                        learn()
            if trainer:
                learn()
                yield from moved()

        parts = dealt.mapInArrow(run, "part string, at int, n double, x array<double>")
        mean = [(F.sum(F.get("x", F.lit(d))) / F.sum("n")).cast("float").alias(f"x{d}") for d in range(DIM)]
        found = parts.groupBy("part", "at").agg(*mean).toArrow()  # at most as many rows as parameters
        new = {part: getattr(p, part).copy() for part in ("u1", "u2", "r", "b")}
        names, at = found.column("part").to_numpy(), found.column("at").to_numpy()
        x = np.stack([found.column(f"x{d}").to_numpy() for d in range(DIM)], axis=1) if found.num_rows else np.empty((0, DIM))
        for part, table in new.items():
            mine = names == part
            table[at[mine]] = x[mine, 0] if part == "b" else x[mine]
        p = Parameters(**new)
    return p


def score(docs: DataFrame, train_rows: Column, *, id_col: str = "doc_id", text_col: str = "text", model_words: int = HEAD, rounds: int = 1) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score): log10 probabilities of every row's whole text.

    model_words: how many frequent words, at most HEAD, are units of their own.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    learn = docs.where(train_rows)
    counts = write_out(token_counts(learn, text_col), "token-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
    least = frequent_from(counts)
    frequent = counts.where(F.col("count") >= least).select("word", "count").toArrow()  # at most HEAD
    head = sorted(zip(frequent.column(0).to_pylist(), frequent.column(1).to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    tail = counts.where(F.col("count") < least)
    classes = {r["k"]: (r["tokens"], r["words"]) for r in tail.groupBy(class_column(F.col("word")).alias("k")).agg(F.sum("count").alias("tokens"), F.count(F.lit(1)).alias("words")).collect()}  # a row per class
    v = Vocabulary.of(head, classes, model_words)
    held = np.array([c for _, c in head], np.float64)
    base, inside = np.log10((held + 1) / (total + distinct + 1)), np.where(np.arange(len(head)) < v.own, 0.0, np.log10(held + 1))
    read = read_all(docs, uuid.uuid4().hex, v, base, inside, train_rows, id_col=id_col, text_col=text_col)
    p = train(read, v, rounds=rounds)
    sent = spark.sparkContext.broadcast((v.context, p, p.normalisers()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, p, ln_z = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            units, offsets = b.column(1).flatten().to_numpy(zero_copy_only=False), b.column(1).offsets.to_numpy()
            stops = offsets[1:] - offsets[0]
            h1, h2 = _contexts(units, stops, context)
            own = np.empty(len(units))
            for lo in range(0, len(units), CHUNK):
                x, y, z = h1[lo : lo + CHUNK], h2[lo : lo + CHUNK], units[lo : lo + CHUNK]
                own[lo : lo + CHUNK] = np.einsum("ij,ij->i", p.u1[x] + p.u2[y], p.r[z]) + p.b[z] - ln_z[x, y]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.add.reduceat(own, np.append(0, stops[:-1])) / np.log(10))], ["row2", "own"])

    modelled = read.select("row", "units").mapInArrow(run, "row2 bigint, own double")
    rare = read.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    found = rare.join(tail, "word", "left").select("row", "times", F.coalesce("count", F.lit(0)).alias("count"))
    sums = found.groupBy("row").agg(
        F.sum(F.when(F.col("count") > 0, F.col("times")).otherwise(0)).alias("known2"),
        F.sum(F.col("times") * F.log10((F.col("count") + 1) / F.lit(float(total + distinct + 1)))).alias("base2"),
        F.sum(F.col("times") * F.log10(F.col("count") + 1)).alias("own2"),
    )
    plain = read.select("row", "id", "n_tokens", "n_known", "base", "fixed")
    out = plain.join(modelled, F.col("row") == F.col("row2")).join(sums, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select("id", "n_tokens", (F.col("n_known") + zero("known2")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + zero("base2")).alias("base_score"), (F.col("own") + F.col("fixed") + zero("own2")).alias("score"))
