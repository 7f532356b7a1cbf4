"""Text functions of the loaders. strip is Unicode white space at both ends, as Python's; lengths are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: Unicode white space, as str.strip takes it.
SPACE = r"[\s\x1c-\x1f\x85   -     　]"

#: The same as characters.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))


def long_enough(text: Column, more_than: int = 20) -> Column:
    return F.length(strip(text)) > more_than


def joined(first: Column, second: Column, separator: str = "\n") -> Column:
    """first, and second after the separator where it isn't empty."""
    second = F.coalesce(second, F.lit(""))
    return F.when(F.length(second) > 0, F.concat(F.coalesce(first, F.lit("")), F.lit(separator), second)).otherwise(F.coalesce(first, F.lit("")))


def first_non_empty(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def first_human_turn(conversation: Column) -> Column:
    """Between the first ``Human:`` and the next ``Assistant:``, stripped; null without the former."""
    after = F.split_part(conversation, F.lit("Human:"), F.lit(2))
    return F.when(F.contains(conversation, F.lit("Human:")), strip(F.split_part(after, F.lit("Assistant:"), F.lit(1))))


def last_turn(conversation: Column, kind: str = "Human") -> Column:
    """After the last ``kind:`` up to the other speaker, stripped; the first 500 characters without it."""
    other = "Assistant:" if kind == "Human" else "Human:"
    turn = F.split_part(F.split_part(conversation, F.lit(f"{kind}:"), F.lit(-1)), F.lit(other), F.lit(1))
    return F.when(F.contains(conversation, F.lit(f"{kind}:")), strip(turn)).otherwise(strip(F.substring(conversation, 1, 500)))


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != ""))


def token_estimate(text: Column, by: str = "words") -> Column:
    """At least 1: words, or a quarter of the characters."""
    n = n_words(text) if by == "words" else F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)
    return F.greatest(F.lit(1), n).cast("long")


def cut(text: Column, most: int, mark: str = "...") -> Column:
    """A text longer than most characters is its first most and the mark."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(mark))).otherwise(text)


def fitted(text: Column, context: int, *, prompt: int = 1500, answer: int = 0, margin: int = 200, per_token: int = 4) -> Column:
    """Cut to what a model's context (in tokens) leaves beside its prompt, its answer and a margin, at per_token characters."""
    return cut(text, max(0, context - prompt - answer - margin) * per_token)


def first_tokens(text: Column, most: int) -> Column:
    """The first most words and what stands before and between them; for encoders that read so many tokens.

    The text is split once, into the words wanted and the rest, whose length tells where to cut: linear in the text, however
    long it is.
    """
    if most < 1:
        return F.when(text.isNotNull(), F.lit(""))
    lead = F.when(F.left(text, F.lit(1)).isin(list(SPACES)), 1).otherwise(0)
    parts = F.split(text, f"{SPACE}+", lead + most + 1)  # white space at the start makes an empty first part
    rest = F.get(parts, lead + most)
    return F.when(F.coalesce(rest, F.lit("")) == "", text).otherwise(F.rtrim(F.left(text, F.length(text) - F.length(rest)), F.lit(SPACES)))


def content_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def batch_key(texts: Column, salt: str, settings: str = "") -> Column:
    """Twelve digits that name a batch, an array of texts in order, under a salt and the settings of what judges it."""
    each = F.array_join(F.transform(texts, lambda t: F.concat(F.coalesce(t, F.lit("None")), F.lit("\n"))), "")
    return F.left(F.sha1(F.concat(each, F.lit(salt + settings))), F.lit(12))


def rendered(template: str, **columns: Column) -> Column:
    """template with each {name} replaced by its column; nulls are empty."""
    parts, rest = [], template
    while rest:
        at = min(((rest.find("{" + k + "}"), k) for k in columns if "{" + k + "}" in rest), default=None)
        if at is None:
            parts.append(F.lit(rest))
            break
        parts += [F.lit(rest[: at[0]]), F.coalesce(columns[at[1]], F.lit(""))]
        rest = rest[at[0] + len(at[1]) + 2 :]
    return F.concat(*parts)


MATH = "Problem: {problem}\nSolution: {solution}"
CONTEXT = "[SYSTEM] {system}\n[USER] {user}"
PAIR = "Input: {input}\nResponse: {response}"
