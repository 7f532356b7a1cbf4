"""URL rules and a character language-model ratio, in DataFrame expressions only.

Accepted and rejected example URLs each train a variable-order Markov model over characters (contexts of up to three,
Witten-Bell smoothing down to the uniform model). A URL's score is the mean over its characters of
ln P_rejected - ln P_accepted. URLs fall into two folds by a hash of their text, and each fold is scored by the models of
the other one, so no URL is judged by a model that has seen it. The bound is calibrated on these held-out scores of the
examples: the middle of the bins where the share of rejected examples above it less the share of accepted ones is largest;
``UrlModel.held_out`` tells how many examples it gets wrong.

All counts come from one aggregation of 4-grams over a fixed alphabet, so the models' one table has at most
ALPHABET ** 4 rows for any corpus (3.1 million, some 250 MB) and is broadcast; characters are never shuffled by gram.

Examples are lists of URLs (``accepted``, ``rejected``), or else the pages' own URLs that no rule decides, those with a
seed word standing alone in the host as rejected ones.

Cases: a null URL, or one without ``://``, has empty host and path and no rule, and scores as the text it has (none: no
score, allowed); unless both folds have examples of both kinds everything without a rule is allowed; repeated URLs score
alike and every row is returned; a URL listed as both kinds counts as both; an empty table gives no rows; further columns
stay, but those with the name of an added one are replaced (added ones start with ``prefix``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from typica.llm.common import LOWER, UPPER, discard, free_prefix, unclashed, write_out

#: Rules as (verdict, host, path).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Words that, standing alone in a host between dots and dashes, make a URL a rejected example.
SEED_WORDS = ["ads", "adult", "bet", "bets", "casino", "loan", "loans", "pills", "poker", "porn", "sex", "spam", "viagra", "xxx"]
#: Letters, a digit, punctuation; * stands for the rest, ^ and $ for the ends.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0.-/_?=&#%~+:*^$"
ORDER = 4


def after_scheme(url: Column, otherwise: Column) -> Column:
    full = F.coalesce(url, F.lit(""))
    return F.when(F.locate("://", full) > 0, full.substr(F.locate("://", full) + 3, F.length(full))).otherwise(otherwise)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url, F.lit("")), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none; equally long ones in the order given."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def model_text(url: Column) -> Column:
    """What the models see of a URL: all after the scheme, in the alphabet, with its ends."""
    after = after_scheme(url, F.coalesce(url, F.lit("")))
    plain = F.regexp_replace(F.translate(after, UPPER + "123456789", LOWER + "000000000"), r"[^a-z0.\-/_?=&#%~+:]", "*")
    return F.when(plain == "", F.lit(None)).otherwise(F.concat(F.lit("^^^"), plain, F.lit("$")))


def grams_of(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text) - ORDER + 1), lambda i: text.substr(i, F.lit(ORDER)))


def fold_of(text: Column) -> Column:
    """0 or 1, by a hash of the text."""
    return F.when(F.right(F.md5(text.cast("binary")), F.lit(1)).isin(*"01234567"), 0).otherwise(1)


#: Columns of counts: of accepted and rejected examples in the folds 0 and 1.
KINDS = [f"{x}{f}" for f in (0, 1) for x in ("acc", "rej")]


def log_ratios(counts: DataFrame) -> DataFrame:
    """(gram, ratio0, ratio1) for each gram of counts (gram and KINDS): ln P_rej - ln P_acc of its last character after the
    rest; ratio0 comes from the examples of fold 1 and is for URLs of fold 0, and the other way round."""
    below = None
    for k in range(1, ORDER + 1):
        own = counts.groupBy(F.right("gram", F.lit(k)).alias("g")).agg(*(F.sum(x).alias(x) for x in KINDS))
        ctx = own.groupBy(F.left("g", F.lit(k - 1)).alias("c")).agg(*(f(x).alias(f"{x}_{n}") for x in KINDS for n, f in (("n", F.sum), ("t", lambda x: F.count_if(F.col(x) > 0)))))
        own = own.join(ctx, F.left("g", F.lit(k - 1)) == F.col("c"))
        if below is not None:
            own = own.join(below, F.right("g", F.lit(k - 1)) == F.col("lower"))
        under = {x: F.col(f"{x}_low") if k > 1 else F.lit(1.0 / len(ALPHABET)) for x in KINDS}
        p = {x: F.when(F.col(f"{x}_n") + F.col(f"{x}_t") > 0, (F.col(x) + F.col(f"{x}_t") * under[x]) / (F.col(f"{x}_n") + F.col(f"{x}_t"))).otherwise(under[x]) for x in KINDS}
        below = own.select(F.col("g").alias("lower"), *(p[x].alias(f"{x}_low") for x in p))
    ratio = lambda f: F.ln(f"rej{f}_low") - F.ln(f"acc{f}_low")
    return below.select(F.col("lower").alias("gram"), ratio(1).alias("ratio0"), ratio(0).alias("ratio1"))


def calibrated_bound(scores: DataFrame) -> DataFrame:
    """One row (bound) from scores (fold, example, score, n): null unless both folds have examples of both kinds."""
    known = scores.where("example is not null and score is not null")
    at = F.floor(F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.col("score"))) * 100)
    bins = known.groupBy(at.alias("bin")).agg(*(F.sum(F.when(F.col("example") == x, F.col("n")).otherwise(0)).alias(x) for x in ("rej", "acc")))
    w = Window.orderBy(F.desc("bin"))  # at most 2001 rows
    total = Window.partitionBy()
    up = bins.select("bin", F.try_divide(F.sum("rej").over(w), F.sum("rej").over(total)).alias("tpr"), F.try_divide(F.sum("acc").over(w), F.sum("acc").over(total)).alias("fpr"), F.coalesce(F.lead("bin").over(w), F.col("bin") - 1).alias("under"))
    gain = up.select("bin", "under", F.round(F.col("tpr") - F.col("fpr"), 9).alias("gain"))
    best = gain.select("bin", "under", "gain", F.max("gain").over(total).alias("best")).where("gain = best")
    kinds = known.agg(F.count_distinct("fold", "example").alias("kinds"))
    return best.agg(((F.max("bin") + F.max_by("under", "bin") + 1) / 200.0).alias("b")).join(F.broadcast(kinds)).select(F.when(F.col("kinds") == 4, F.col("b")).alias("bound"))


@dataclass
class UrlModel:
    """counts: gram and KINDS. bound: None without examples of both kinds in both folds. held_out: numbers of examples, and
    how many of them the held-out scores put on the wrong side of the bound."""

    counts: DataFrame
    bound: float | None
    held_out: dict[str, int]


def scored(texts: DataFrame, ratios: DataFrame) -> DataFrame:
    """texts (text, example, fold, n) with score, of those with a text."""
    each = texts.select("text", "example", "fold", "n", F.explode(grams_of(F.col("text"))).alias("gram"))
    own = F.when(F.col("fold") == 0, F.col("ratio0")).otherwise(F.col("ratio1"))
    return each.join(F.broadcast(ratios), "gram").groupBy("text", "example", "fold").agg(F.avg(own).alias("score"), F.first("n").alias("n"))


def _with_scores(texts: DataFrame) -> tuple[UrlModel, DataFrame]:
    """The model of texts (text, example, n), example acc, rej or null, and the texts' scores."""
    texts = write_out(texts.withColumn("fold", fold_of(F.col("text"))), "url-texts")
    each = texts.select("example", "fold", "n", F.explode(grams_of(F.col("text"))).alias("gram"))
    of = lambda kind: F.when((F.col("example") == kind[:3]) & (F.col("fold") == int(kind[3])), F.col("n")).otherwise(0)
    counts = write_out(each.groupBy("gram").agg(*(F.sum(of(x)).alias(x) for x in KINDS)), "url-grams")
    ratios = write_out(log_ratios(counts), "url-ratios")
    scores = write_out(scored(texts, ratios), "url-scores")
    discard(texts, ratios)
    bound = calibrated_bound(scores).first()["bound"]  # one number
    above = F.col("score") > F.lit(bound)
    wrong = F.sum(F.when(F.when(F.col("example") == "rej", ~above).otherwise(above), F.col("n")).otherwise(0))
    table = {r["example"]: r for r in scores.where("example is not null").groupBy("example").agg(F.sum("n").alias("n"), wrong.alias("wrong")).collect()}
    number = lambda kind, c: int(table[kind][c]) if kind in table else 0
    return UrlModel(counts, bound, {"accepted": number("acc", "n"), "accepted_above": number("acc", "wrong"), "rejected": number("rej", "n"), "rejected_below": number("rej", "wrong")}), scores


def fit(accepted: DataFrame, rejected: DataFrame, *, url_col: str = "url") -> UrlModel:
    """The model of two lists of URLs."""
    listed = [d.select(model_text(F.col(url_col)).alias("text"), F.lit(x).alias("example")) for d, x in ((accepted, "acc"), (rejected, "rej"))]
    return _with_scores(_counted(listed[0].unionByName(listed[1])))[0]


def _counted(texts: DataFrame) -> DataFrame:
    return texts.where("text is not null").groupBy("text", "example").agg(F.count(F.lit(1)).alias("n"))


def url_filter(pages: DataFrame, *, url_col: str = "url", rules: list[tuple[str, str, str]] | None = None, seed_words: list[str] | None = None, model: UrlModel | None = None, prefix: str = "uf_") -> DataFrame:
    """pages with {prefix}host, path, rule, score (mean log ratio), bound and verdict.

    model: one of fit; by default one of the pages themselves. URLs that a rule decides are no examples, since rules are
    policy; of the others, those with one of seed_words in the host are rejected examples, the rest accepted ones.
    """
    rules, seed_words, p = RULES if rules is None else rules, SEED_WORDS if seed_words is None else seed_words, prefix
    pages = unclashed(pages, *(f"{p}{x}" for x in ("host", "path", "rule", "score", "bound", "verdict")))
    url = F.col(url_col)
    host, path = host_of(url), path_of(url)
    if model is None:
        named = host.rlike(rf"(^|[.\-])({'|'.join(seed_words)})([.\-:]|$)") if seed_words else F.lit(False)
        example = F.when(longest_rule(host, path, rules).isNotNull(), F.lit(None)).otherwise(F.when(named, "rej").otherwise("acc"))
        model, scores = _with_scores(_counted(pages.select(model_text(url).alias("text"), example.alias("example"))))
    else:
        own = _counted(pages.select(model_text(url).alias("text"), F.lit(None).cast("string").alias("example")))
        new = own.select(F.explode(grams_of(F.col("text"))).alias("gram")).distinct().select("gram", *(F.lit(0).alias(x) for x in KINDS))
        counts = model.counts.unionByName(new).groupBy("gram").agg(*(F.sum(x).alias(x) for x in KINDS))  # grams that no example has fall back on shorter ones
        scores = write_out(scored(own.withColumn("fold", fold_of(F.col("text"))), write_out(log_ratios(counts), "url-ratios")), "url-scores")
    q = free_prefix(pages.columns, "uf_")
    by_text = scores.groupBy(F.col("text").alias(f"{q}text")).agg(F.max("score").alias(f"{q}score"))  # equal for all rows of a text
    out = pages.withColumn(f"{q}key", model_text(url)).join(by_text, F.col(f"{q}key") == F.col(f"{q}text"), "left").withColumn(f"{q}found", longest_rule(host, path, rules))
    bound = F.lit(model.bound).cast("double")
    own = F.when(F.col(f"{q}score") > bound, "block").otherwise("allow")
    added = {"host": host, "path": path, "rule": F.col(f"{q}found.rule"), "score": F.col(f"{q}score"), "bound": bound, "verdict": F.coalesce(F.col(f"{q}found.verdict"), own)}
    return out.select(*(F.col(f"`{c}`") for c in pages.columns), *(v.alias(f"{p}{k}") for k, v in added.items()))
