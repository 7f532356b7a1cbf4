"""Safety scores from what moderation models write: higher is safer. Null output counts as an error of the guard."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from typica.functions.text import strip
from typica.functions.vectors import let

#: The marker words of the guards' outputs.
RESULT_MARK, REASONING_MARK = "[RESULT]", "[REASONING]"
#: Scores by what a guard says.
FIRST_WORD = {"safe": 0.9, "unsafe": 0.1, "unsafe with a category": 0.05, "anything else": 0.2, "nothing": 0.1}
JUDGED = {"the word safe": 0.7, "the word unsafe": 0.2, "neither": 0.1}
REQUEST = {"yes": 0.1, "no": 0.9, "neither": 0.2}
#: Fixed value: the reasoning of an output without one.
NO_REASONING = "No reasoning provided"


def first_word_guard(raw: Column) -> Column:
    """By the first word, and whether a category's digit follows."""
    t, v = F.lower(strip(raw)), FIRST_WORD
    return F.when(raw.isNull(), v["nothing"]).when(t.startswith("safe"), v["safe"]).when(t.startswith("unsafe") & t.rlike("[0-9]"), v["unsafe with a category"]).when(t.startswith("unsafe"), v["unsafe"]).otherwise(v["anything else"])


def after_mark(text: Column, mark: str) -> Column:
    """The pieces of text after each place of the mark, which is found in any case."""
    pieces = F.split(text, "(?i)" + mark.replace("[", r"\[").replace("]", r"\]"))
    return F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))


def judged_guard(raw: Column) -> Column:
    """After a result mark and a colon the word safe or unsafe, and further on in that line a digit from 1 to 5, which moves
    the score by .2 (safe) or .05 (unsafe) a step; without them by the words that occur anywhere."""
    lines = F.transform(after_mark(F.lower(raw), RESULT_MARK + ":"), lambda x: F.split_part(F.regexp_replace(x, r"^\s+", ""), F.lit("\n"), F.lit(1)))
    digit = lambda x: F.regexp_extract(x, "[0-9]", 0)
    line = F.get(F.filter(lines, lambda x: (x.startswith("safe") | x.startswith("unsafe")) & (digit(x) != "")), F.lit(0))
    up = F.upper(F.coalesce(raw, F.lit("")))
    said = lambda w: F.contains(up, F.lit(w))

    def verdict(line: Column) -> Column:
        level = F.when(line.isNotNull(), digit(line).cast("int"))
        return (
            F.when(line.startswith("safe"), F.greatest(F.lit(0.1), 1.0 - (level - 1) * 0.2))
            .when(line.startswith("unsafe"), F.greatest(F.lit(0.05), 0.3 - (level - 3) * 0.05))
            .when(said("SAFE") & ~said("UNSAFE"), JUDGED["the word safe"])
            .when(said("UNSAFE"), JUDGED["the word unsafe"])
            .otherwise(JUDGED["neither"])
        )

    return let(line, verdict)


def reasoning(raw: Column) -> Column:
    """What stands between the reasoning mark and the next result mark or the end."""
    first = F.get(after_mark(raw, REASONING_MARK + ":"), F.lit(0))
    return F.when(first.isNotNull(), strip(F.get(F.split(first, r"(?i)\[RESULT\]"), F.lit(0)))).otherwise(NO_REASONING)


def request_guard(raw: Column) -> Column:
    """By yes or no in the first line that speaks of a harmful request."""
    lines = F.filter(F.split(F.lower(strip(raw)), "\n"), lambda x: F.contains(x, F.lit("harmful request")))
    line = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    return F.when(F.contains(line, F.lit("yes")), REQUEST["yes"]).when(F.contains(line, F.lit("no")), REQUEST["no"]).otherwise(REQUEST["neither"])


def policy_guard(raw: Column) -> Column:
    """Harmful: .3 less .05 per policy name S1 to S14 that occurs (S1 within S10 too), refusal .5, else 1."""
    text = F.coalesce(raw, F.lit(""))
    low = F.lower(text)
    has = lambda *w: _any(low, w)
    agreed, bad = has("yes", "true"), has("harmful", "unsafe")
    prompt = has("prompt") & bad & agreed
    prompt = F.when(has("harmful: no", "harmfulness: no"), False).when(has("harmful: yes", "harmfulness: yes"), True).otherwise(prompt)
    response = has("response") & bad & agreed
    hits = F.size(F.filter(F.array(*(F.lit(f"S{i}") for i in range(1, 15))), lambda s: F.contains(text, s)))
    return F.when(prompt | response, F.greatest(F.lit(0.0), 0.3 - 0.05 * hits)).when(has("refusal") & agreed, 0.5).otherwise(1.0)


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(text, F.lit(w))
    return out


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def worst_of(probabilities: Column, failed: Column | None = None, on_failure: float = 1.0) -> Column:
    """1 less the largest probability of an array; no probability at all is 1. failed rows get on_failure."""
    score = 1 - F.coalesce(F.array_max(probabilities), F.lit(0.0))
    return score if failed is None else F.when(failed, on_failure).otherwise(score)


def category_detail(logits: Column, names: list[str], threshold: float = 0.5) -> Column:
    """struct(overall_unsafe, max_probability, safety_score, categories: name -> (probability, predicted, index))."""
    probability = F.transform(logits, sigmoid)
    entries = F.transform(probability, lambda p, i: F.struct(p.alias("probability"), (p > threshold).alias("predicted"), i.cast("int").alias("index")))
    top = F.array_max(probability)
    return F.struct((top > threshold).alias("overall_unsafe"), top.alias("max_probability"), (1 - top).alias("safety_score"), F.map_from_arrays(F.array(*(F.lit(n) for n in names)), entries).alias("categories"))


def attribute_scores(response: Column, attributes: list[str]) -> Column:
    """The summary values of a JSON response {attributeScores: {NAME: {summaryScore: {value}}}}, absent ones null."""
    return F.array(*(F.get_json_object(response, f"$.attributeScores.{a}.summaryScore.value").cast("double") for a in attributes))


def attribute_guard(text: Column, response: Column, attributes: list[str]) -> Column:
    """1 less the largest attribute; blank text 1, no response 0."""
    return F.when(strip(text) == "", 1.0).when(response.isNull(), 0.0).otherwise(1 - F.coalesce(F.array_max(attribute_scores(response, attributes)), F.lit(0.0)))


def scanner_score(risks: Column, valid: Column, how: str = "max") -> Column:
    """Clamped 1 less the max or mean risk; without risks 1 if all scanners passed, else .1; null risks .1."""
    if how not in ("max", "mean"):
        raise ValueError(f"aggregation {how!r}")
    mean = F.aggregate(risks, F.lit(0.0), lambda s, x: s + x) / F.size(risks)
    risk = F.array_max(risks) if how == "max" else mean
    all_valid = F.forall(valid, lambda v: v)
    return F.when(risks.isNull(), 0.1).when(F.size(risks) == 0, F.when(all_valid, 1.0).otherwise(0.1)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - risk)))


def decision_confidence(tokens: Column, *, logits: bool) -> Column:
    """P(safe) at the first position with a generated safe or unsafe token.

    tokens: array<struct<pos, token, value, generated>>. logits: values are logits (softmax over the finite ones), else log
    probabilities. Both words finite: their two-way share; one: the generated token's probability, or 1 less it for unsafe.
    No such position or no finite value: .8 for a response that starts with safe, else .2 (logits); null (log probabilities).
    """
    word = lambda t: F.lower(strip(t["token"]))
    is_decision = lambda t: word(t).isin("safe", "unsafe")
    made = F.filter(tokens, lambda t: t["generated"] & is_decision(t))
    at = F.array_min(F.transform(made, lambda t: t["pos"]))
    here = F.filter(tokens, lambda t: (t["pos"] == at) & t["value"].isNotNull() & ~F.isnan(t["value"]) & (F.abs(t["value"]) < float("inf")))
    value = lambda w: F.get(F.transform(F.filter(here, lambda t: word(t) == w), lambda t: t["value"]), F.lit(0))
    safe, unsafe = value("safe"), value("unsafe")
    generated = F.get(F.filter(here, lambda t: t["generated"]), F.lit(0))
    total = F.aggregate(F.transform(here, lambda t: F.exp(t["value"] - generated["value"])), F.lit(0.0), lambda s, x: s + x)
    p = 1 / total if logits else F.exp(generated["value"])
    said = F.get(F.transform(F.filter(tokens, lambda t: t["generated"] & (t["pos"] == F.array_min(F.transform(tokens, lambda u: u["pos"])))), word), F.lit(0))
    fallback = F.when(said.startswith("safe"), 0.8).otherwise(0.2) if logits else F.lit(None).cast("double")
    one = F.when(word(generated) == "safe", p).otherwise(1 - p)
    return F.when(at.isNull(), fallback).when(safe.isNotNull() & unsafe.isNotNull(), 1 / (1 + F.exp(unsafe - safe))).when(generated.isNull() | (safe.isNull() & unsafe.isNull()), fallback).otherwise(one)


def repaired(score: Column, value: float = 0.5) -> Column:
    return F.when(F.isnan(score) | (F.abs(score) == float("inf")), value).otherwise(score)
