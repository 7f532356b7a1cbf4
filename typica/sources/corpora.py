"""Corpus loaders: declarative specifications over tables, with explicit order columns.

A specification names the text, the rows that count, and which side they are on; one plan serves all. Order is a column,
never the order of files.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from typica.functions import text as T
from typica.operators.order import places


@dataclass(frozen=True)
class Corpus:
    """texts: candidates in order, each with its own predicate; one_per_row keeps the first that holds."""

    name: str
    is_id: bool
    texts: Callable[[], list[tuple[Column, Column]]]
    one_per_row: bool = False
    more_than: int = 20
    cut: int | None = None
    languages: dict[str, str] = field(default_factory=dict)


def _col(name: str, default: str = "") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(default))


#: Corpora by exact name. Texts are tested for length stripped, and returned stripped.
CORPORA: dict[str, Corpus] = {
    c.name: c
    for c in [
        Corpus("alpaca", True, lambda: [(T.joined(_col("instruction"), _col("input")), F.lit(True))]),
        Corpus("dolly", True, lambda: [(T.joined(_col("instruction"), _col("context"), "\nContext: "), F.lit(True))]),
        Corpus("helpful_base", True, lambda: [(T.first_human_turn(_col("chosen")), F.contains(_col("chosen"), F.lit("Human:")))]),
        Corpus("openassistant", True, lambda: [(_col("text"), F.col("role") == "prompter")]),
        Corpus("rtp_lx", False, lambda: [(_col("Prompt"), F.col("PromptAnnotations.Toxicity") >= 3), (F.substring(_col("Completion"), 1, 500), F.col("CompletionAnnotations.Toxicity") >= 3)]),
        Corpus("realtoxicity", False, lambda: [(F.col("prompt.text"), F.col("prompt.toxicity") > 0.6), (F.col("continuation.text"), F.col("continuation.toxicity") > 0.6)], one_per_row=True),
        Corpus("civil_comments", False, lambda: [(_col("text"), F.col("toxicity") > 0.7)]),
        Corpus("hateval", False, lambda: [(_col("text"), F.col("HS") == 1)]),
        Corpus("davidson", False, lambda: [(_col("tweet"), F.col("class").isin(0, 1))]),
        Corpus("hasoc", False, lambda: [(_col("text"), F.col("label") == 1)]),
        Corpus("offenseval", False, lambda: [(_col("text"), F.col("label") == 1)]),
        Corpus("xsafety", False, lambda: [(_col("text"), F.lit(True))]),
        Corpus("polyguard", False, lambda: [(F.substring(T.first_non_empty(_col("instance"), _col("prompt")), 1, 1000), F.lit(True)), (F.substring(_col("response"), 1, 500), F.lit(True))], more_than=10),
        Corpus("polyguardprompts", False, lambda: [(_col("prompt"), _harmful("prompt_harm_label") | _harmful("prompt_label") | _harmful("subcategory"))]),
        Corpus("advbench", False, lambda: [(F.get("content", F.lit(0)), F.lit(True))]),
        Corpus("harmbench", False, lambda: [(_col("prompt"), F.lit(True))]),
        Corpus("jailbreakbench", False, lambda: [(T.first_non_empty(_col("behavior"), _col("prompt"), _col("goal")), F.lit(True))]),
        Corpus("maliciousinstruct", False, lambda: [(T.first_non_empty(_col("instruction"), _col("prompt")), F.lit(True))]),
        Corpus("xstest", False, lambda: [(_col("prompt"), F.col("final_label") == "2_full_refusal")]),
        Corpus("beavertails", False, lambda: [(_col("prompt"), ~F.coalesce(F.col("is_safe"), F.lit(True)))]),
        Corpus("sorrybench", False, lambda: [(F.get("turns", F.lit(0)), F.lit(True))]),
        Corpus("wildguardmix", False, lambda: [(_col("prompt"), (F.col("prompt_harm_label") == "harmful") | F.coalesce(F.col("adversarial"), F.lit(False)))]),
        Corpus("orbench", True, lambda: [(_col("prompt"), F.lit(True))], more_than=19),
        Corpus("orbench_toxic", False, lambda: [(_col("prompt"), F.lit(True))], more_than=19),
        Corpus("hhrlhf_chosen", True, lambda: [(T.last_turn(_col("chosen")), F.lit(True))]),
        Corpus("hhrlhf_rejected", False, lambda: [(T.last_turn(_col("rejected")), F.lit(True))]),
        Corpus("math", True, lambda: [(T.rendered(T.MATH, problem=_col("problem"), solution=_col("solution")), F.lit(True))]),
        Corpus("gsm8k", True, lambda: [(T.rendered(T.MATH, problem=_col("question"), solution=_col("answer")), F.lit(True))]),
        Corpus("injection", False, lambda: [(_col("user_input"), T.strip(_col("user_input")) != "")], more_than=0),
        Corpus("injection_context", False, lambda: [(T.rendered(T.CONTEXT, system=_col("test_case_prompt"), user=_col("user_input")), T.strip(_col("user_input")) != "")], more_than=0),
    ]
}


def _harmful(name: str) -> Column:
    value = F.lower(F.coalesce(F.col(name), F.lit("")))
    return ~value.isin("", "benign", "unharmful", "safe")


#: The parts of one corpus, and what it is without a known one.
PARTS = ["social_media", "education", "hr", "finance_input", "finance_output", "law_input", "law_output", "regulation_input", "regulation_output", "code", "cyber"]


def routed(name: str) -> tuple[str, str | None]:
    """(corpus, part or language) of a data set's name in any case: polyguard_<part> with a known part, else the first one;
    rtp_lx_<language> and xsafety_<language>; other names are corpora themselves. Unknown ones raise."""
    low = name.strip().lower().replace("-", "_")
    if low == "polyguard" or low.startswith("polyguard_"):
        part = low.removeprefix("polyguard").strip("_")
        part = part if part in PARTS else part.split("_")[0]
        return "polyguard", part if part in PARTS else PARTS[0]
    for corpus in ("rtp_lx", "xsafety"):
        if low == corpus or low.startswith(f"{corpus}_"):
            return corpus, low.removeprefix(corpus).strip("_") or None
    if low not in CORPORA:
        raise ValueError(f"corpus {name!r}")
    return low, None


def load(rows: DataFrame, corpus: Corpus | str, order: str, *, most: int | None = None) -> DataFrame:
    """(ord, sub, dataset, is_id, text): the corpus' texts in order; a row may give several, sub counts them."""
    c = CORPORA[corpus] if isinstance(corpus, str) else corpus
    found = [F.when(F.coalesce(ok & T.long_enough(t, c.more_than), F.lit(False)), T.strip(t)) for t, ok in c.texts()]
    if c.one_per_row:
        found = [F.coalesce(*found)]
    each = rows.select(F.col(order).alias("ord"), F.posexplode(F.array(*found)).alias("sub", "text")).where("text is not null")
    out = each.select("ord", "sub", F.lit(c.name).alias("dataset"), F.lit(c.is_id).alias("is_id"), "text")
    return out if most is None else first_n(out, most, "ord", "sub")


def first_n(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n in order, with place from 1."""
    top = rows.orderBy(*order).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def split_first(rows: DataFrame, n_train: int, n_test: int, *order: str) -> DataFrame:
    """The first n_train rows as train, the next n_test as test."""
    return first_n(rows, n_train + n_test, *order).withColumn("split", F.when(F.col("place") <= n_train, "train").otherwise("test"))


def split_share(rows: DataFrame, share: float, *order: str) -> DataFrame:
    """The first int(n * share) rows as train, in place order; counts per range of the first key, so no task orders all."""
    n = rows.count()
    placed = places(rows, *order)
    return placed.withColumn("split", F.when(F.col("place") <= int(n * share), "train").otherwise("test"))


def mix(parts: list[DataFrame], n: int, seed: int = 42) -> DataFrame:
    """The first n / len(parts) of each, in an order drawn by the hash of dataset, place and seed."""
    share = n // len(parts)
    out = None
    for p in parts:
        rows = first_n(p, share, "ord", "sub")
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("draw", F.xxhash64("dataset", "ord", "sub", F.lit(seed)))


def topped_up(first: DataFrame, second: DataFrame, most: int, *order: str) -> DataFrame:
    """The first most rows of first and, where they are fewer, as many of second as are missing; place counts within each."""
    top = first_n(first, most, *order)
    return top.unionByName(first_n(second, max(0, most - top.count()), *order))


def or_literal(rows: DataFrame, prompts: list[str], n: int, dataset: str) -> DataFrame:
    """rows (ord, sub, dataset, is_id, text), or n literal prompts where there are none."""
    return rows if rows.limit(1).count() else literal_corpus(rows.sparkSession, prompts, n, dataset)


def by_category(rows: DataFrame, id_categories: list[str], ood_categories: list[str], most: int, order: str, *, more_than: int = 50) -> DataFrame:
    """(ord, category, is_id, text): the first most rows of each category, of which those with long enough texts; texts as they are."""
    wanted = rows.where(F.col("category").isin(*id_categories, *ood_categories))
    rank = F.row_number().over(Window.partitionBy("category").orderBy(order))  # only the first most of each category pass the shuffle
    top = wanted.withColumn("__rank", rank).where(F.col("__rank") <= most).where(T.long_enough(F.col("text"), more_than))
    return top.select(F.col(order).alias("ord"), "category", F.col("category").isin(*id_categories).alias("is_id"), "text")


def statistics(rows: DataFrame, *keys: str) -> DataFrame:
    """Texts per key: their number, and the mean, least and largest length."""
    n = F.length("text")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(n).alias("mean_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"))


def tiled(rows: DataFrame, times: int) -> DataFrame:
    """Every row so many times, numbered in tile."""
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("tile"))


def language_counts(rows: DataFrame, language: str | None, names: dict[str, str]) -> DataFrame:
    """Rows per language code and name; a known language restricts them, an unknown one does not."""
    wanted = [k for k, v in names.items() if language in (k, v)]
    kept = rows.where(F.col("lang").isin(*wanted)) if wanted else rows
    name = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select("lang", F.coalesce(F.try_element_at(name, F.col("lang")), F.lit("Unknown")).alias("name"), "n")


def top_categories(rows: DataFrame, column: str, n: int = 5) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(n)


def target_scores(rows: DataFrame, order: str) -> DataFrame:
    """Rows of (input, target_scores map): a text per response, is_id where its score is 1; at least two responses needed."""
    each = rows.where(F.size("target_scores") >= 2).select(F.col(order).alias("ord"), "input", F.explode(F.map_entries("target_scores")).alias("t"))
    return each.select("ord", (F.col("t.value") == 1).alias("is_id"), T.rendered(T.PAIR, input=F.col("input"), response=F.col("t.key")).alias("text"))


def literal_corpus(spark: SparkSession, prompts: list[str], n: int, dataset: str) -> DataFrame:
    """n rows that repeat the prompts in turn."""
    at = F.get(F.array(*(F.lit(p) for p in prompts)), (F.col("id") % len(prompts)).cast("int"))
    return spark.range(n).select(F.col("id").alias("ord"), F.lit(0).alias("sub"), F.lit(dataset).alias("dataset"), F.lit(False).alias("is_id"), at.alias("text"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An array of objects, or one object per line; malformed lines are dropped."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    whole = bool(first) and first[0].value.lstrip().startswith("[")
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", whole).json(path)
