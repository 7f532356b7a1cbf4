"""Mixing to target weights: rake token weights to several marginals, then sample documents by calibrated probabilities.

Documents fall into cells of source, language and topic; a value without a target is pooled as ``(other)``, so there are
at most as many cells as the targets allow, whatever the corpus holds. Iterative proportional fitting scales the cells'
expected tokens until every marginal has its target share of the budget, holding each cell to the tokens that it has
(probability 1). A document stays when a hash of its id and text falls below its cell's probability.

Targets of one dimension are relative among the listed values that occur; ``(other)`` keeps the share it has, unless it is
listed itself. Where the tokens can't meet all targets within the budget, the fit is the closest that the rounds reach;
``residuals`` and ``report`` tell what is missed.

Topics are the caller's (``topic``, any column); by default a short list of words and patterns marks what sources and
languages don't tell: tables, contact data, legal lines, numbers, prose.

Cases: null values are ``(other)``; null or blank text has no tokens, and its cell's probability; cells without tokens
have probability 1; repeated rows share their fate; an empty table gives no rows; further columns stay, but those with the
name of an added one are replaced (added ones start with ``prefix``).
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typica.llm.common import free_prefix, let, lower_ascii, unclashed, write_out

OTHER = "(other)"
#: Topics by the first line that fits a text: one of the words occurs and, if given, the pattern too; the
#: rest is prose. Words are looked for byte by byte, so patterns are tried on few texts; words with letters, given in lower
#: case, are found in any ASCII case.
TOPICS = [
    ("table", [" | "], None),
    ("contact", ["@"], r"[A-Za-z0-9._]@[A-Za-z0-9.]"),
    ("legal", ["licen", "copyright", "lizenz"], None),
    ("numbers", [], r"[0-9]{3}"),
]
#: The mix asked for; every source alike.
TARGETS = {
    "source": {f"src{i}": 1.0 for i in range(20)},
    "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15},
    "topic": {"prose": 0.85, "legal": 0.05, "contact": 0.03, "numbers": 0.05, "table": 0.02},
}


def _any_of(words: list[str], c: Column) -> Column:
    return reduce(or_, (F.contains(c, F.lit(w)) for w in words))


def topic_of(text: Column, topics: list[tuple[str, list[str], str | None]] | None = None, rest: str = "prose") -> Column:
    t, out = F.coalesce(text, F.lit("")), F.lit(rest)
    for name, words, pattern in reversed(TOPICS if topics is None else topics):
        low = any(w.upper() != w for w in words)
        fits = (let(lower_ascii(t), lambda c: _any_of(words, c)) if low else _any_of(words, t)) if words else F.lit(True)  # noqa: B023
        out = F.when(fits & t.rlike(pattern) if pattern else fits, name).otherwise(out)
    return out


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def scaled(expected: np.ndarray, most: np.ndarray, goal: float) -> np.ndarray:
    """expected times the factor at which its sum, with each entry held to most, is goal; most if that is out of reach."""
    if goal >= most.sum():
        return most.copy()
    free = np.ones(len(expected), bool)
    while True:
        rest = goal - most[~free].sum()
        total = expected[free].sum()
        if total <= 0:
            return np.where(free, 0.0, most)
        over = free & (expected * rest / total > most)
        if not over.any():
            return np.where(free, expected * rest / total, most)
        free &= ~over


def rake(cells: list[tuple], tokens: np.ndarray, targets: list[dict[str, float]], budget: float, *, rounds: int = 500, tolerance: float = 1e-9) -> np.ndarray:
    """Expected tokens per cell. cells: values per dimension; targets: share per value, of one dimension each."""
    at = [np.array([sorted(t).index(c[d]) for c in cells]) for d, t in enumerate(targets)]
    goals = [np.array([t[k] for k in sorted(t)]) * budget for t in targets]
    out = tokens * (budget / max(tokens.sum(), 1e-300))
    for _ in range(rounds):
        before = out.copy()
        for where, goal in zip(at, goals, strict=True):
            for k, g in enumerate(goal):
                mine = where == k
                out[mine] = scaled(out[mine], tokens[mine], g)
        if np.abs(out - before).max() <= tolerance * budget:
            break
    return out


def residuals(cells: list[tuple], fit: np.ndarray, targets: list[dict[str, float]], budget: float) -> list[float]:
    """Per dimension the largest miss of a value's share of the budget; about zero where the targets are met."""
    out = []
    for d, t in enumerate(targets):
        got = {k: 0.0 for k in t}
        for c, x in zip(cells, fit, strict=True):
            got[c[d]] += float(x)
        out.append(max((abs(got[k] / budget - t[k]) for k in t), default=0.0) if budget else 0.0)
    return out


def shares(target: Mapping[str, float], observed: dict[str, float]) -> dict[str, float]:
    """The share of each observed value: listed ones by their weights, the pooled rest what it has."""
    total = sum(observed.values())
    rest = 0.0 if OTHER in target else observed.get(OTHER, 0.0) / total
    weight = sum(w for k, w in target.items() if observed.get(k, 0.0) > 0)
    out = {k: target[k] / weight * (1 - rest) if k in target and weight else observed[k] / total for k in observed}
    scale = sum(out.values())
    return {k: x / scale for k, x in out.items()}


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]], *, id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None, tokens: Column | None = None, budget: float = 0.5, seed: int = 17, columns: list[str] | None = None, prefix: str = "mx_") -> DataFrame:
    """docs, or these columns of it, with {prefix}topic, n_tokens, probability and kept. budget: share of the tokens to keep.

    targets: weights by value for columns of docs and, as "topic", for topic. Texts are read once: the rows are written
    with their topic, tokens and draw, and what meets in one place is one row per cell.
    """
    docs = unclashed(docs, *(f"{prefix}{x}" for x in ("topic", "n_tokens", "probability", "kept")))
    p, carried = free_prefix(docs.columns, "mx_"), docs.columns if columns is None else columns
    carried = [f"`{c}`" for c in carried]
    topic = topic_of(F.col(text_col)) if topic is None else topic
    tokens = n_words(F.col(text_col)) if tokens is None else tokens
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"), F.col(text_col)).cast("binary")), 1, 12), 16, 10).cast("double") / float(16**12)
    dims = sorted(targets)
    keys = [f"{p}d{i}" for i in range(len(dims))]
    value = {d: topic if d == "topic" else F.col(d).cast("string") for d in dims}
    pooled = lambda d: lambda v: F.struct(v.alias("v"), F.when(v.isin(*targets[d]), v).otherwise(OTHER).alias("pooled"))
    rows = docs.select(*carried, tokens.alias(f"{p}n_tokens"), draw.alias(f"{p}draw"), *([] if "topic" in dims else [topic.alias(f"{p}topic")]), *(let(value[d], pooled(d)).alias(k) for d, k in zip(dims, keys, strict=True)))
    named = F.col(f"{keys[dims.index('topic')]}.v") if "topic" in dims else F.col(f"{p}topic")
    rows = write_out(rows.select(*carried, f"{p}n_tokens", f"{p}draw", named.alias(f"{p}topic"), *(F.col(f"{k}.pooled").alias(k) for k in keys)), "mixing")

    found = rows.groupBy(*keys).agg(F.sum(f"{p}n_tokens").alias("n")).where("n > 0").collect()  # a row per cell, as many as the targets allow
    cells, n = [tuple(r[k] for k in keys) for r in found], np.array([float(r["n"]) for r in found])
    goals = []
    for i, d in enumerate(dims):
        seen: dict[str, float] = {}
        for c, x in zip(cells, n, strict=True):
            seen[c[i]] = seen.get(c[i], 0.0) + x
        goals.append(shares(targets[d], seen) if seen else {})
    fit = rake(cells, n, goals, budget * n.sum()) if cells else n
    chance = docs.sparkSession.createDataFrame([(*c, float(a / b)) for c, a, b in zip(cells, fit, n, strict=True)], ", ".join(f"{k} string" for k in keys) + f", {p}q double")
    q = F.coalesce(f"{p}q", F.lit(1.0))
    added = {"topic": F.col(f"{p}topic"), "n_tokens": F.col(f"{p}n_tokens"), "probability": q, "kept": F.col(f"{p}draw") < q}
    return rows.join(F.broadcast(chance), keys, "left").select(*carried, *(c.alias(f"{prefix}{n}") for n, c in added.items()))


def report(mixed: DataFrame, targets: Mapping[str, Mapping[str, float]], prefix: str = "mx_") -> DataFrame:
    """(dimension, value, share_before, share_expected, share_kept) of tokens."""
    n, keep = F.col(f"{prefix}n_tokens"), F.col(f"{prefix}kept")
    parts = []
    for d in sorted(targets):
        v = F.col(f"{prefix}topic" if d == "topic" else d).cast("string")
        parts.append(mixed.groupBy(F.lit(d).alias("dimension"), F.when(v.isin(*targets[d]), v).otherwise(OTHER).alias("value")).agg(F.sum(n).alias("a"), F.sum(n * F.col(f"{prefix}probability")).alias("b"), F.sum(F.when(keep, n).otherwise(0)).alias("c")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    total = out.groupBy("dimension").agg(*(F.sum(c).alias(f"t{c}") for c in "abc"))
    return out.join(total, "dimension").select("dimension", "value", *(F.try_divide(c, f"t{c}").alias(n) for c, n in (("a", "share_before"), ("b", "share_expected"), ("c", "share_kept"))))
