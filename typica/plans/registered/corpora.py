"""Queries of the loaders: documents, labels, conversations and benchmark stand in for prompt corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typica.functions import text as T
from typica.plans.registered import query
from typica.sources import cache, corpora, hub
from typica.session import table
from typica.storage import scratch_path

#: Language names by code.
LANGUAGES = {"en": "English", "de": "German", "fr": "French"}


def strip_sql(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


TEXT = strip_sql("text")


def halves(text: str = "text") -> tuple[Column, Column]:
    """Both halves of a whole text, for loaders that take two fields."""
    n = F.floor(F.length(text) / 2).cast("int")
    return F.col(text).substr(F.lit(1), n), F.col(text).substr(n + 1, F.length(text))


#: The same in SQL.
A, B = "substr(text, 1, length(text) // 2)", "substr(text, length(text) // 2 + 1)"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def texts(df: DataFrame) -> DataFrame:
    return df.select("ord", F.col("sub").cast("long").alias("sub"), "dataset", "is_id", "text")


@query(f"SELECT doc_id, length({TEXT})::BIGINT AS n FROM documents WHERE length({TEXT}) > 20")
def load_min_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).where(T.long_enough(F.col("text"))).select("doc_id", F.length(T.strip(F.col("text"))).cast("long").alias("n"))


LONG = f"d AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS k FROM documents WHERE length({TEXT}) > 20)"


@query(f"WITH {LONG} SELECT doc_id, CASE WHEN k <= 200 THEN 'train' ELSE 'test' END AS split FROM d WHERE k <= 300")
def load_first_n_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.split_first(docs(spark, sf_dir).where(T.long_enough(F.col("text"))).select("doc_id"), 200, 100, "doc_id").select("doc_id", "split")


@query(f"WITH {LONG} SELECT doc_id, k AS place, CASE WHEN k <= floor((SELECT count(*) FROM d) * 0.7) THEN 'train' ELSE 'test' END AS split FROM d")
def load_share_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).where(T.long_enough(F.col("text"))).select("doc_id")
    return corpora.split_share(rows, 0.7, "doc_id").select("doc_id", "place", "split")


@query(f"""WITH x AS (SELECT doc_id AS ord, CASE WHEN doc_id % 2 = 0 THEN text || chr(10) || lang ELSE text END AS text FROM documents)
SELECT ord, 0::BIGINT AS sub, 'alpaca' AS dataset, true AS is_id, {TEXT} AS text FROM x WHERE length({TEXT}) > 20""")
def load_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", F.col("text").alias("instruction"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("input"))
    return texts(corpora.load(rows, "alpaca", "doc_id"))


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text per conversation, each turn after its speaker's mark."""
    turn = F.concat(F.when(F.col("role") == "user", "\n\nHuman: ").when(F.col("role") == "assistant", "\n\nAssistant: ").otherwise("\n\nSystem: "), F.coalesce("text", F.lit("")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", turn.alias("t")))).alias("x"))
    return rows.select("conv_id", F.array_join(F.transform("x", lambda x: x["t"]), "").alias("dialogue"))


DIALOGUE = "g AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN e'\\n\\nHuman: ' WHEN 'assistant' THEN e'\\n\\nAssistant: ' ELSE e'\\n\\nSystem: ' END || coalesce(text, ''), '' ORDER BY turn) AS c FROM conversations GROUP BY conv_id)"


@query(f"WITH {DIALOGUE}, x AS (SELECT conv_id, split_part(split_part(c, 'Human:', 2), 'Assistant:', 1) AS text FROM g WHERE contains(c, 'Human:')) SELECT conv_id AS ord, 0::BIGINT AS sub, 'helpful_base' AS dataset, true AS is_id, {TEXT} AS text FROM x WHERE length({TEXT}) > 20")
def load_first_human_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(corpora.load(dialogues(spark, sf_dir).withColumnRenamed("dialogue", "chosen"), "helpful_base", "conv_id"))


@query(f"WITH {DIALOGUE}, x AS (SELECT conv_id, CASE WHEN contains(c, 'Human:') THEN split_part(split_part(c, 'Human:', -1), 'Assistant:', 1) ELSE substr(c, 1, 500) END AS text FROM g) SELECT conv_id AS ord, 0::BIGINT AS sub, 'hhrlhf_chosen' AS dataset, true AS is_id, {TEXT} AS text FROM x WHERE length({TEXT}) > 20")
def load_last_human_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(corpora.load(dialogues(spark, sf_dir).withColumnRenamed("dialogue", "chosen"), "hhrlhf_chosen", "conv_id"))


@query(f"WITH {DIALOGUE}, x AS (SELECT conv_id, CASE WHEN contains(c, 'Assistant:') THEN split_part(split_part(c, 'Assistant:', -1), 'Human:', 1) ELSE substr(c, 1, 500) END AS text FROM g) SELECT conv_id, {TEXT} AS text FROM x")
def load_last_assistant_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogues(spark, sf_dir).select("conv_id", T.last_turn(F.col("dialogue"), "Assistant").alias("text"))


@query(f"SELECT conv_id * 100 + turn AS ord, 0::BIGINT AS sub, 'openassistant' AS dataset, true AS is_id, {TEXT} AS text FROM conversations WHERE role = 'user' AND length({TEXT}) > 20")
def load_role_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("ord"), F.when(F.col("role") == "user", "prompter").otherwise(F.col("role")).alias("role"), "text")
    return texts(corpora.load(rows, "openassistant", "ord"))


@query(f"SELECT doc_id AS ord, 0::BIGINT AS sub, 'civil_comments' AS dataset, false AS is_id, {TEXT} AS text FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND length({TEXT}) > 20")
def load_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").withColumn("toxicity", F.col("toxic").cast("double"))
    return texts(corpora.load(rows, "civil_comments", "doc_id"))


@query(f"SELECT lang, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' ELSE 'Unknown' END AS name, count(*) AS n FROM documents WHERE length({TEXT}) > 20 GROUP BY lang")
def load_language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.language_counts(docs(spark, sf_dir).where(T.long_enough(F.col("text"))), "Klingon", LANGUAGES)


@query(f"SELECT lang, 'German' AS name, count(*) AS n FROM documents WHERE lang = 'de' AND length({TEXT}) > 20 GROUP BY lang")
def load_language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.language_counts(docs(spark, sf_dir).where(T.long_enough(F.col("text"))), "German", LANGUAGES)


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    a, b = F.col("toxic").cast("double"), 1 - F.col("quality").cast("double")
    return rows.select("doc_id", *(c.alias(n) for c, n in zip(halves(), "pc", strict=True)), a.alias("a"), b.alias("b"))


ANNOTATED = f"x AS (SELECT doc_id, {A} AS p, {B} AS c, toxic::DOUBLE AS a, 1 - quality::DOUBLE AS b FROM documents JOIN labels USING (doc_id))"


@query(f"""WITH {ANNOTATED}, y AS (SELECT doc_id AS ord, 0::BIGINT AS sub, p AS text FROM x WHERE a * 4 >= 3 UNION ALL SELECT doc_id, 1, substr(c, 1, 500) FROM x WHERE b * 3 >= 3)
SELECT ord, sub, 'rtp_lx' AS dataset, false AS is_id, {TEXT} AS text FROM y WHERE length({TEXT}) > 20""")
def load_truncate_multi_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _annotated(spark, sf_dir).select("doc_id", F.col("p").alias("Prompt"), F.col("c").alias("Completion"), F.struct((F.col("a") * 4).alias("Toxicity")).alias("PromptAnnotations"), F.struct((F.col("b") * 3).alias("Toxicity")).alias("CompletionAnnotations"))
    return texts(corpora.load(rows, "rtp_lx", "doc_id"))


@query(f"""WITH {ANNOTATED}, y AS (SELECT doc_id AS ord, CASE WHEN a > 0.6 AND length({strip_sql('p')}) > 20 THEN p WHEN b > 0.6 AND length({strip_sql('c')}) > 20 THEN c END AS text FROM x)
SELECT ord, 0::BIGINT AS sub, 'realtoxicity' AS dataset, false AS is_id, {TEXT} AS text FROM y WHERE text IS NOT NULL""")
def load_prompt_else_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _annotated(spark, sf_dir).select("doc_id", F.struct(F.col("p").alias("text"), F.col("a").alias("toxicity")).alias("prompt"), F.struct(F.col("c").alias("text"), F.col("b").alias("toxicity")).alias("continuation"))
    return texts(corpora.load(rows, "realtoxicity", "doc_id"))


@query(f"""WITH x AS (SELECT doc_id AS ord, coalesce(CASE WHEN doc_id % 3 = 0 THEN nullif({A}, '') END, CASE WHEN doc_id % 3 <> 1 THEN nullif({B}, '') END, nullif(text, '')) AS text FROM documents)
SELECT ord, 0::BIGINT AS sub, 'jailbreakbench' AS dataset, false AS is_id, {TEXT} AS text FROM x WHERE length({TEXT}) > 20""")
def load_first_non_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    rows = docs(spark, sf_dir).select("doc_id", F.when(k == 0, halves()[0]).alias("behavior"), F.when(k != 1, halves()[1]).otherwise("").alias("prompt"), F.col("text").alias("goal"))
    return texts(corpora.load(rows, "jailbreakbench", "doc_id"))


@query(f"""WITH x AS (SELECT conv_id AS ord, list(text ORDER BY turn)[1] AS text FROM conversations GROUP BY conv_id) SELECT ord, 0::BIGINT AS sub, 'sorrybench' AS dataset, false AS is_id, {TEXT} AS text FROM x WHERE length({TEXT}) > 20""")
def load_array_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("turns"))
    return texts(corpora.load(rows, "sorrybench", "conv_id"))


@query(f"SELECT doc_id AS ord, 0::BIGINT AS sub, 'wildguardmix' AS dataset, false AS is_id, {TEXT} AS text FROM documents JOIN labels USING (doc_id) WHERE (toxic = 1 OR quality = 0) AND length({TEXT}) > 20")
def load_boolean_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.col("text").alias("prompt"), F.when(F.col("toxic") == 1, "harmful").otherwise("unharmful").alias("prompt_harm_label"), (F.col("quality") == 0).alias("adversarial"))
    return texts(corpora.load(rows, "wildguardmix", "doc_id"))


@query(f"""WITH x AS (SELECT item_id, {A} AS a, {B} AS b FROM benchmark) SELECT item_id AS ord, is_id, 'Input: ' || a || chr(10) || 'Response: ' || r AS text FROM (SELECT item_id, a, true AS is_id, 'yes ' || b AS r FROM x UNION ALL SELECT item_id, a, false, 'no ' || b FROM x) WHERE item_id % 5 <> 0""")
def load_map_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = halves()
    scores = F.when(F.col("item_id") % 5 == 0, F.create_map(F.concat(F.lit("yes "), b), F.lit(1))).otherwise(F.create_map(F.concat(F.lit("yes "), b), F.lit(1), F.concat(F.lit("no "), b), F.lit(0)))
    return corpora.target_scores(table(spark, sf_dir, "benchmark").select("item_id", a.alias("input"), scores.alias("target_scores")), "item_id")


@query(f"""WITH x AS (SELECT item_id, 'Problem: ' || {A} || chr(10) || 'Solution: ' || {B} AS text FROM benchmark) SELECT item_id AS ord, 0::BIGINT AS sub, 'math' AS dataset, true AS is_id, {TEXT} AS text FROM x WHERE length({TEXT}) > 20""")
def load_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", halves()[0].alias("problem"), halves()[1].alias("solution"))
    return texts(corpora.load(rows, "math", "item_id"))


@query(f"""WITH x AS (SELECT item_id, '[SYSTEM] ' || {A} || chr(10) || '[USER] ' || {B} AS text FROM benchmark WHERE item_id % 4 <> 0) SELECT item_id AS ord, 0::BIGINT AS sub, 'injection_context' AS dataset, false AS is_id, {TEXT} AS text FROM x""")
def load_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", halves()[0].alias("test_case_prompt"), F.when(F.col("item_id") % 4 != 0, halves()[1]).otherwise("  ").alias("user_input"))
    return texts(corpora.load(rows, "injection_context", "item_id"))


@query(f"""WITH a AS (SELECT 'alpaca' AS dataset, doc_id AS ord, row_number() OVER (ORDER BY doc_id) AS place FROM documents WHERE length({TEXT}) > 20),
b AS (SELECT 'openassistant' AS dataset, conv_id * 100 + turn AS ord, row_number() OVER (ORDER BY conv_id, turn) AS place FROM conversations WHERE role = 'user' AND length({TEXT}) > 20)
SELECT dataset, ord, place FROM a WHERE place <= 50 UNION ALL SELECT dataset, ord, place FROM b WHERE place <= 50""")
def load_id_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = corpora.load(docs(spark, sf_dir).select("doc_id", F.col("text").alias("instruction"), F.lit("").alias("input")), "alpaca", "doc_id")
    conv = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("ord"), F.when(F.col("role") == "user", "prompter").alias("role"), "text")
    return corpora.mix([a, corpora.load(conv, "openassistant", "ord")], 100).select("dataset", "ord", F.col("place").cast("long").alias("place"))


@query("SELECT vec_id, tile::BIGINT AS tile FROM embeddings, range(50) t(tile) WHERE label = 9")
def tile_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.tiled(table(spark, sf_dir, "embeddings").where("label = 9").select("vec_id"), 50).select("vec_id", F.col("tile").cast("long").alias("tile"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM documents WHERE lang = 'en') WHERE k % 2 = 1")
def every_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.places(docs(spark, sf_dir).where("lang = 'en'").select("doc_id"), "doc_id").where("place % 2 = 1").select("doc_id")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5")
def top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.top_categories(docs(spark, sf_dir), "source")


@query("WITH t AS (SELECT row_number() OVER () - 1 AS i FROM documents) SELECT i AS ord, ['Explain the categorical imperative.', 'What is a sonnet?', 'Describe photosynthesis.'][i % 3 + 1] AS text FROM t")
def load_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal prompts in turn, as many as there are documents to set them against."""
    return corpora.literal_corpus(spark, ["Explain the categorical imperative.", "What is a sonnet?", "Describe photosynthesis."], docs(spark, sf_dir).count(), "literal").select("ord", "text")


def _cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of every third document's text, every ninth without success."""
    d = docs(spark, sf_dir).where("doc_id % 3 = 0")
    return d.select(F.lit("m1").alias("model_id"), T.content_key(F.col("text")).alias("key"), F.concat(F.lit("out"), F.length("text").cast("string")).alias("output"), F.timestamp_seconds("doc_id").alias("timestamp_utc"), F.lit(0.1).alias("duration_seconds"), (F.col("doc_id") % 9 != 0).alias("success"))


CACHE = "cache AS (SELECT sha256(text) AS key, any_value('out' || length(text)) AS output FROM documents WHERE doc_id % 3 = 0 AND doc_id % 9 <> 0 GROUP BY 1)"


@query(f"WITH {CACHE} SELECT doc_id, output FROM documents JOIN cache ON sha256(text) = key")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.hits(docs(spark, sf_dir), _cached(spark, sf_dir), "m1").select("doc_id", "output")


@query(f"WITH {CACHE} SELECT DISTINCT sha256(text) AS key FROM documents WHERE sha256(text) NOT IN (SELECT key FROM cache)")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.misses(docs(spark, sf_dir), _cached(spark, sf_dir), "m1").select("key")


@query(f"""WITH a AS (SELECT doc_id, 'benign' AS part, row_number() OVER (ORDER BY doc_id) AS place FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND length({TEXT}) > 20),
b AS (SELECT doc_id, 'top-up' AS part, row_number() OVER (ORDER BY doc_id) AS place FROM documents JOIN labels USING (doc_id) WHERE toxic = 0 AND length({TEXT}) > 20)
SELECT doc_id, part FROM a WHERE place <= 120 UNION ALL SELECT doc_id, part FROM b WHERE place <= greatest(0, 120 - (SELECT count(*) FROM a))""")
def load_top_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").where(T.long_enough(F.col("text")))
    part = lambda toxic, name: rows.where(F.col("toxic") == toxic).select("doc_id", F.lit(name).alias("part"))
    return corpora.topped_up(part(1, "benign"), part(0, "top-up"), 120, "doc_id").select("doc_id", "part")


@query(f"""SELECT doc_id AS ord, source AS category, source IN ('src1', 'src2') AS is_id, text FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE source IN ('src1', 'src2', 'src3', 'src4')) WHERE k <= 30 AND length({TEXT}) > 50""")
def load_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.by_category(docs(spark, sf_dir).withColumnRenamed("source", "category"), ["src1", "src2"], ["src3", "src4"], 30, "doc_id")


@query("SELECT lang, count(*) AS n, round(avg(length(text)), 6) AS mean_length, min(length(text))::BIGINT AS min_length, max(length(text))::BIGINT AS max_length FROM documents GROUP BY lang")
def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = corpora.statistics(docs(spark, sf_dir), "lang")
    return s.select("lang", "n", (F.round("mean_length", 6) + 0.0).alias("mean_length"), F.col("min_length").cast("long").alias("min_length"), F.col("max_length").cast("long").alias("max_length"))


@query("SELECT i AS ord, ['What is a haiku?', 'Name a river.'][i % 2 + 1] AS text FROM range(4) t(i)")
def load_literal_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus without rows is replaced by literal prompts."""
    none = corpora.load(docs(spark, sf_dir).where("lang = 'xx'").withColumnRenamed("text", "prompt"), "orbench", "doc_id")
    return corpora.or_literal(none, ["What is a haiku?", "Name a river."], 4, "literal").select("ord", "text")


@query("SELECT conv_id, left(sha1(string_agg(coalesce(text, 'None') || chr(10), '' ORDER BY turn, text) || 'test' || 'mean|False'), 12) AS key, count(*) AS n FROM conversations GROUP BY conv_id")
def batch_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of each conversation's turns as a batch."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("conv_id", T.batch_key(F.col("t.text"), "test", "mean|False").alias("key"), F.size("t").cast("long").alias("n"))


@query("SELECT doc_id, text, lang FROM documents WHERE lang IN ('de', 'fr')")
def load_hub_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as shards of JSON lines in folders by language, of which two are read."""
    root = scratch_path(spark, "shards")
    docs(spark, sf_dir).select("doc_id", "text", "lang").write.partitionBy("lang").option("compression", "gzip").json(f"{root}/train")
    return hub.scan(spark, root).where(F.col("lang").isin("de", "fr")).select("doc_id", "text", "lang")


@query("SELECT doc_id, array_to_string(string_split_regex(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[ \\t\\n\\x0B\\f\\r]+')[1:64], ' ') AS first FROM documents")
def first_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 64 words of every document, found in the whole text; white space between them as one blank."""
    cut = F.regexp_replace(T.first_tokens(T.strip(F.col("text")), 64), r"\s+", " ")
    return docs(spark, sf_dir).select("doc_id", cut.alias("first"))
