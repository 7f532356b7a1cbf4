"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typica.llm import decontaminate, mixing, neural_lm, oracles, periodic_runs, quality_rules, reply_trees, simhash, subword_classifier, token_offsets, url_filter, vector_codes, voronoi_join, warc
from typica.llm.common import let, table, words_of, write_out


RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "words_left")


def op1_offset_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines with their tokens; a token across a line's end goes to the line with most of it."""
    found = token_offsets.section_tokens(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "section", "start", "stop", F.col("n_tokens").cast("long").alias("n_tokens"), "doc_tokens")


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts, base verdict and verdict after frequent lines are gone. Empty table: no rows."""
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *(F.col(f"qr_{c}").alias(c) for c in RULES))


def op3_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one of control strings, as a reply tree: formatted, then read back from the formatted text."""
    odd = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    nodes = write_out(reply_trees.chains(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)), "reply-nodes")
    out = reply_trees.format_paths(reply_trees.tree_paths(nodes), nodes)
    turns = reply_trees.read_back(F.col("formatted"))
    out = out.select("tree", "formatted", turns.alias("turns"), reply_trees.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def planted_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2 where every host has lines in many documents: in every second one, and pages of nothing else."""
    docs = table(spark, sf_dir, "documents")
    line = F.when(F.col("doc_id") % 2 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("\n" + quality_rules.BOILERPLATE[0]))).otherwise(F.col("text"))
    page = F.concat(F.lit("".join(x + "\n" for x in quality_rules.BOILERPLATE)), "lang", F.lit(" "), "source")
    judged = quality_rules.quality_rules(docs.select("doc_id", line.alias("text"), "source").unionByName(docs.select((-1 - F.col("doc_id")).alias("doc_id"), page.alias("text"), "source")))
    return judged.select("doc_id", *(F.col(f"qr_{c}").alias(c) for c in RULES))


def branching_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best branches of every conversation, whose turn k (from 1) is taken as a reply to turn k / 2."""
    nodes = reply_trees.chains(table(spark, sf_dir, "conversations")).withColumn("parent", F.when(F.col("node") > 1, F.floor(F.col("node") / 2)))
    nodes = write_out(nodes, "reply-nodes")
    out = reply_trees.format_paths(reply_trees.tree_paths(nodes, top=2), nodes).withColumn("turns", reply_trees.read_back(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(F.col("tree").alias("conv_id"), "leaf", F.col("rank").cast("long").alias("rank"), F.size("turns").cast("long").alias("n_turns"), F.round("path_score", 6).alias("path_score"), F.sha2(said, 256).alias("turns_sha256"))


def op4_url_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, longest rule and verdict, by the rule or by the character models."""
    judged = url_filter.url_filter(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", *(F.col(f"uf_{c}").alias(c) for c in ("host", "path", "rule", "verdict")), F.round("uf_score", 6).alias("score"))


def op5_zstd_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, as read back from the WARC archives that it was written to."""
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"), spark)


def op6_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, learned from the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = subword_classifier.fold("doc_id", 4)
    model = subword_classifier.fit(docs, table(spark, sf_dir, "labels"), train_rows=fold != 2)
    scored = subword_classifier.score(docs, model)
    return scored.select("doc_id", (fold == 2).alias("held_out"), F.col("qc_score").alias("score"), (F.col("qc_score") >= 0.7).cast("int").alias("predicted"))


def op7_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability by the unigram base and by the log-bilinear model."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = subword_classifier.fold("doc_id", 7) == 2
    scored = neural_lm.score(docs, ~held)
    return scored.withColumnRenamed("id", "doc_id").select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside benchmark windows and the items that they come from."""
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", *(F.col(f"dc_{c}").alias(c) for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")))


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest doc_id that it reaches over links of at most 3 bits."""
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op10_raked_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability after raking to the targets, and whether it is drawn."""
    out = mixing.mix(table(spark, sf_dir, "documents"), mixing.TARGETS, columns=["doc_id", "source", "lang"])
    return out.select("doc_id", "source", "lang", *(F.col(f"mx_{c}").alias(c) for c in ("topic", "n_tokens", "probability", "kept")))


def op11_harmonic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's periodic runs, where every tenth document (by its id's hash) first gets a periodic end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def planted(w: Column, n: Column) -> Column:
        g = F.floor(h / 10)
        a, p = g % n, F.lit(1) + F.floor((n - g % n) / (F.lit(3) + g % 8))
        again = F.flatten(F.array_repeat(F.slice(w, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
        return F.concat(F.slice(w, F.lit(1), a.cast("int")), F.slice(again, F.lit(1), (n - a).cast("int")))

    text = let(words_of(F.col("text")), lambda w: F.when(F.size(w) > 0, F.array_join(planted(w, F.size(w)), " ")).otherwise(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(h % 10 == 0, text).otherwise(F.col("text")).alias("text"))
    found = periodic_runs.periodic_runs(docs).withColumn("best", F.array_max(F.transform("pr_runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("down")))))
    lines = F.array_join(F.transform("pr_runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("pr_runs").cast("long").alias("n_runs"),
        (-F.col("best.back")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.down")).alias("period"),
        F.expr("1000 * best.length div -best.down").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("pr_collapsed", 256).alias("collapsed_sha256"),
    )


def op12_code_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector's code, its error and its label's; and the codebooks' digest."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest inner products of every vector whose id is divisible by 50, with all other vectors."""
    found = voronoi_join.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_offset_tokens, op2_line_frequency, planted_boilerplate, op3_reply_trees, branching_trees, op4_url_ratio, op5_zstd_warc, op6_subword_quality, op7_log_bilinear, op8_wu_manber, op9_simhash_groups, op10_raked_mix, op11_harmonic_runs, op12_code_cells, op13_voronoi_topk)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
