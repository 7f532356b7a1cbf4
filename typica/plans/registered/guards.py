"""Queries of the guard-output parsers, the streaming guard's batch twin, and the rate windows.

Guard outputs are made from document ids, as no guard runs here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typica.functions import guards as G
from typica.functions import prompts
from typica.functions import text as T
from typica.plans.registered import query
from typica.session import table
from typica.storage import scratch_path
from typica.streaming import guard, rates, stateful


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def pick(values: list[str | None]) -> Column:
    at = (F.col("doc_id") % len(values)).cast("int")
    return F.get(F.array(*(F.lit(v).cast("string") for v in values)), at)


def pick_sql(values: list[str | None]) -> str:
    q = [("NULL" if v is None else "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'") for v in values]
    return f"([{', '.join(q)}])[doc_id % {len(values)} + 1]"


def scores(spark: SparkSession, sf_dir: str, score: Column) -> DataFrame:
    s = F.round(score, 6) + 0.0
    return docs(spark, sf_dir).select("doc_id", s.alias("score"), F.when(score > 0.5, 1).otherwise(-1).alias("pred"))


def scored_sql(values: list[str | None], case: str) -> str:
    return f"SELECT doc_id, round(s, 6) AS score, CASE WHEN s > 0.5 THEN 1 ELSE -1 END AS pred FROM (SELECT doc_id, ({case})::DOUBLE AS s FROM (SELECT doc_id, {pick_sql(values)} AS raw FROM documents))"


FIRST = ["safe", "unsafe\nS1", "unsafe", " UNSAFE", "", "S10", "Safe ok", None]


@query(scored_sql(FIRST, r"CASE WHEN raw IS NULL THEN 0.1 WHEN regexp_matches(lower(raw), '^\s*safe') THEN 0.9 WHEN regexp_matches(lower(raw), '^\s*unsafe') AND regexp_matches(raw, '[0-9]') THEN 0.05 WHEN regexp_matches(lower(raw), '^\s*unsafe') THEN 0.1 ELSE 0.2 END"))
def guard_llama(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir, G.first_word_guard(pick(FIRST)))


JUDGED = ["[REASONING]: fine [RESULT]: safe, 3", "[RESULT]: unsafe 5", "[result]: SAFE\n1", "it is safe", "UNSAFE!", "no idea", "[RESULT]: unsafe, score 1", "[RESULT]: safe - 5", ""]


@query(scored_sql(JUDGED, r"CASE WHEN regexp_extract(lower(raw), '\[result\]:\s*(safe|unsafe).*?(\d)', 1) = 'safe' THEN greatest(0.1, 1.0 - (regexp_extract(lower(raw), '\[result\]:\s*(safe|unsafe).*?(\d)', 2)::INT - 1) * 0.2) WHEN regexp_extract(lower(raw), '\[result\]:\s*(safe|unsafe).*?(\d)', 1) = 'unsafe' THEN greatest(0.05, 0.3 - (regexp_extract(lower(raw), '\[result\]:\s*(safe|unsafe).*?(\d)', 2)::INT - 3) * 0.05) WHEN contains(upper(raw), 'SAFE') AND NOT contains(upper(raw), 'UNSAFE') THEN 0.7 WHEN contains(upper(raw), 'UNSAFE') THEN 0.2 ELSE 0.1 END"))
def guard_mdjudge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir, G.judged_guard(pick(JUDGED)))


@query(rf"""SELECT doc_id, CASE WHEN regexp_matches(raw, '(?i)\[reasoning\]:') THEN regexp_replace(regexp_extract(raw, '(?is)\[reasoning\]:(.*?)(\[result\]|$)', 1), '^\s+|\s+$', '', 'g') ELSE '{G.NO_REASONING}' END AS reasoning FROM (SELECT doc_id, {pick_sql(JUDGED)} AS raw FROM documents)""")
def guard_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", G.reasoning(pick(JUDGED)).alias("reasoning"))


REQUEST = ["Harmful request: yes\nResponse refusal: no", "harmful request: no", "Harmful request: maybe", "nothing", "x\nHARMFUL REQUEST: NO\nharmful request: yes", ""]


LINE = "coalesce(list_filter(string_split(lower(raw), chr(10)), lambda x: contains(x, 'harmful request'))[1], '')"


@query(scored_sql(REQUEST, f"CASE WHEN contains({LINE}, 'yes') THEN 0.1 WHEN contains({LINE}, 'no') THEN 0.9 ELSE 0.2 END"))
def guard_wildguard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir, G.request_guard(pick(REQUEST)))


POLICY = ["Prompt harmful: yes S1, S10", "Prompt harmful: no", "Response refusal: yes", "response unsafe: true S2 S14", "prompt ok", "harmfulness: yes", "S3 only", "prompt harmful: no; response harmful yes S4"]


def _has(*words: str) -> str:
    return "(" + " OR ".join(f"contains(lower(raw), '{w}')" for w in words) + ")"


BAD_PROMPT = f"CASE WHEN {_has('harmful: no', 'harmfulness: no')} THEN false WHEN {_has('harmful: yes', 'harmfulness: yes')} THEN true ELSE {_has('prompt')} AND {_has('harmful', 'unsafe')} AND {_has('yes', 'true')} END"
BAD_RESPONSE = f"{_has('response')} AND {_has('harmful', 'unsafe')} AND {_has('yes', 'true')}"
NAMED = "len(list_filter(range(1, 15), lambda i: contains(raw, 'S' || i::VARCHAR)))"


@query(scored_sql(POLICY, f"CASE WHEN ({BAD_PROMPT}) OR ({BAD_RESPONSE}) THEN greatest(0.0, 0.3 - 0.05 * {NAMED}) WHEN {_has('refusal')} AND {_has('yes', 'true')} THEN 0.5 ELSE 1.0 END"))
def guard_polyguard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir, G.policy_guard(pick(POLICY)))


@query("""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN []::DOUBLE[] ELSE [(doc_id % 10) / 10.0::DOUBLE, (doc_id % 13) / 8.0::DOUBLE] END AS r, doc_id % 2 = 0 AS ok FROM documents)
SELECT doc_id, round(CASE WHEN r IS NULL THEN 0.1 WHEN len(r) = 0 THEN CASE WHEN ok THEN 1.0 ELSE 0.1 END ELSE greatest(0, least(1, 1 - list_max(r))) END::DOUBLE, 6) AS max_score, round(CASE WHEN r IS NULL THEN 0.1 WHEN len(r) = 0 THEN CASE WHEN ok THEN 1.0 ELSE 0.1 END ELSE greatest(0, least(1, 1 - list_sum(r) / 2)) END::DOUBLE, 6) AS mean_score FROM x""")
def guard_scanner_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    risks = F.when(d % 7 == 0, F.lit(None)).when(d % 7 == 1, F.array().cast("array<double>")).otherwise(F.array((d % 10) / 10.0, (d % 13) / 8.0))
    valid = F.array(F.lit(True), d % 2 == 0)
    rounded = lambda c: F.round(c, 6) + 0.0
    return docs(spark, sf_dir).select("doc_id", rounded(G.scanner_score(risks, valid)).alias("max_score"), rounded(G.scanner_score(risks, valid, "mean")).alias("mean_score"))


@query("SELECT doc_id, round(CASE WHEN doc_id % 11 = 0 THEN 1.0 ELSE 1 - greatest((doc_id % 10) / 10.0, (doc_id % 7) / 7.0) END::DOUBLE, 6) AS score, doc_id % 11 = 0 AS failed FROM documents")
def moderation_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest category probability of a map; a failed response is an empty map and scores 1, so failed is shown."""
    d = F.col("doc_id")
    m = F.when(d % 11 == 0, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))).otherwise(F.create_map(F.lit("hate"), (d % 10) / 10.0, F.lit("violence"), (d % 7) / 7.0))
    return docs(spark, sf_dir).select("doc_id", (F.round(G.worst_of(F.map_values(m)), 6) + 0.0).alias("score"), (F.size(m) == 0).alias("failed"))


DETAIL = "WITH x AS (SELECT doc_id, [1 / (1 + exp(-((doc_id % 9) - 4))), 1 / (1 + exp(-((doc_id % 5) - 3)))] AS p FROM documents)"


@query(f"{DETAIL} SELECT doc_id, list_max(p) > 0.5 AS overall_unsafe, round(list_max(p), 6) AS max_probability, round(1 - list_max(p), 6) AS safety_score, round(p[1], 6) AS violent_p, p[2] > 0.5 AS sexual_predicted FROM x")
def moderation_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    x = G.category_detail(F.array((d % 9 - 4).cast("double"), (d % 5 - 3).cast("double")), ["violent", "sexual"])
    out = docs(spark, sf_dir).select("doc_id", x.alias("x"))
    r = lambda c: F.round(c, 6) + 0.0
    return out.select("doc_id", "x.overall_unsafe", r("x.max_probability").alias("max_probability"), r("x.safety_score").alias("safety_score"), r(F.col("x.categories")["violent"]["probability"]).alias("violent_p"), F.col("x.categories")["sexual"]["predicted"].alias("sexual_predicted"))


@query(f"{DETAIL} SELECT count(*) AS total, count(*) FILTER (list_max(p) > 0.5) AS unsafe, count(*) FILTER (list_max(p) <= 0.5) AS safe FROM x")
def moderation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = moderation_detail(spark, sf_dir)
    return d.agg(F.count(F.lit(1)).alias("total"), F.count_if("overall_unsafe").alias("unsafe"), F.count_if(~F.col("overall_unsafe")).alias("safe"))


@query("SELECT doc_id, round(CASE WHEN doc_id % 6 = 0 THEN 1.0 WHEN doc_id % 6 = 1 THEN 0.0 WHEN doc_id % 6 = 2 THEN 1 - (doc_id % 100) / 100.0 ELSE 1 - greatest((doc_id % 100) / 100.0, 0.25) END::DOUBLE, 6) AS score FROM documents")
def moderation_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from JSON responses: blank text is safe, no response is not, absent attributes are skipped."""
    d, v = F.col("doc_id"), ((F.col("doc_id") % 100) / 100.0).cast("string")
    one = F.concat(F.lit('{"attributeScores":{"TOXICITY":{"summaryScore":{"value":'), v, F.lit("}}"))
    response = F.when(d % 6 == 1, F.lit(None)).when(d % 6 == 2, F.concat(one, F.lit("}}"))).otherwise(F.concat(one, F.lit(',"INSULT":{"summaryScore":{"value":0.25}}}}')))
    text = F.when(d % 6 == 0, F.lit(" \n")).otherwise("text")
    return docs(spark, sf_dir).select("doc_id", (F.round(G.attribute_guard(text, response, ["TOXICITY", "INSULT", "THREAT"]), 6) + 0.0).alias("score"))


def _tokens() -> Column:
    """Position 0 is a blank, position 1 decides; which values are finite depends on the id."""
    d = F.col("doc_id")
    inf = F.lit(float("-inf"))
    said_safe = d % 2 == 0
    t = lambda pos, token, value, made: F.struct(F.lit(pos).alias("pos"), F.lit(token).alias("token"), value.alias("value"), made.alias("generated"))
    a, b = -(d % 10) / 10.0, -(d % 7) / 7.0 - 0.5
    lone = d % 3 == 1
    return F.when(d % 5 == 0, F.array(t(0, "hello", F.lit(-0.1), F.lit(True)))).otherwise(
        F.array(t(0, "\n", F.lit(-0.1), F.lit(True)), t(1, "safe", F.when(lone & ~said_safe, inf).otherwise(a), said_safe), t(1, "unsafe", F.when(lone & said_safe, inf).otherwise(b), ~said_safe), t(1, "other", F.lit(-2.0), F.lit(False)))
    )


@query("""WITH x AS (SELECT doc_id, -(doc_id % 10) / 10.0::DOUBLE AS a, -(doc_id % 7) / 7.0::DOUBLE - 0.5 AS b, doc_id % 2 = 0 AS s, doc_id % 3 = 1 AS lone FROM documents)
SELECT doc_id, round(CASE WHEN doc_id % 5 = 0 THEN 0.2 WHEN NOT lone THEN exp(a) / (exp(a) + exp(b)) WHEN s THEN exp(a) / (exp(a) + exp(-2.0::DOUBLE)) ELSE 1 - exp(b) / (exp(b) + exp(-2.0::DOUBLE)) END, 6) AS by_logits,
round(CASE WHEN doc_id % 5 = 0 THEN NULL WHEN NOT lone THEN exp(a) / (exp(a) + exp(b)) WHEN s THEN exp(a) ELSE 1 - exp(b) END, 6) AS by_logprobs FROM x""")
def logprob_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c: F.round(c, 6) + 0.0
    d = docs(spark, sf_dir).select("doc_id", _tokens().alias("t"))
    return d.select("doc_id", r(G.decision_confidence(F.col("t"), logits=True)).alias("by_logits"), r(G.decision_confidence(F.col("t"), logits=False)).alias("by_logprobs"))


@query("SELECT doc_id, round(CASE WHEN doc_id % 4 IN (0, 1) THEN 0.5 ELSE (doc_id % 10) / 10.0 END::DOUBLE, 6) AS score FROM documents")
def nonfinite_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    raw = F.when(d % 4 == 0, F.lit(float("nan"))).when(d % 4 == 1, F.lit(float("inf"))).otherwise((d % 10) / 10.0)
    return docs(spark, sf_dir).select("doc_id", (F.round(G.repaired(raw), 6) + 0.0).alias("score"))


WORDS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))"


@query(f"SELECT doc_id, greatest(1, {WORDS})::BIGINT AS by_words, greatest(1, length(text) // 4)::BIGINT AS by_chars FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.token_estimate(F.col("text")).alias("by_words"), T.token_estimate(F.col("text"), "chars").alias("by_chars"))


@query("""WITH r AS (SELECT event_id, event_type AS model, epoch_us(ts) AS ts_us, event_id % 50 + 1 AS tokens FROM events)
SELECT event_id, model, count(*) OVER w AS n_requests, (sum(tokens) OVER w)::BIGINT AS n_tokens FROM r WINDOW w AS (PARTITION BY model ORDER BY ts_us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)""")
def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("model"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), (F.col("event_id") % 50 + 1).alias("tokens"))
    return rates.rate_window(r).select("event_id", "model", "n_requests", "n_tokens")


@query(f"""WITH RECURSIVE d AS (SELECT source AS model, doc_id AS ord, greatest(1, {WORDS})::BIGINT AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
g AS (SELECT model, ord, k, tokens, tokens AS used, 0::BIGINT AS batch FROM d WHERE k = 1 UNION ALL
SELECT d.model, d.ord, d.k, d.tokens, CASE WHEN g.used + d.tokens > 4000 THEN d.tokens ELSE g.used + d.tokens END, CASE WHEN g.used + d.tokens > 4000 THEN g.batch + 1 ELSE g.batch END FROM g JOIN d ON d.model = g.model AND d.k = g.k + 1)
SELECT model, ord, tokens, batch FROM g""")
def greedy_token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select(F.col("source").alias("model"), F.col("doc_id").alias("ord"), T.token_estimate(F.col("text")).alias("tokens"))
    return rates.token_batches(rows, 5000)


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A guard's state from documents: every third is finished, half came in this step."""
    d = F.col("doc_id")
    return docs(spark, sf_dir).select(d.alias("req_id"), "text", T.n_words(F.col("text")).alias("word_count"), F.least(T.n_words(F.col("text")), (d % 97).cast("int")).alias("last_predicted_at"), F.when(d % 3 == 0, "stop").alias("finish_reason"), (-d).alias("first_seen"), (d % 2 == 0).alias("here"))


STATE = f"st AS (SELECT doc_id, {WORDS} AS wc, doc_id % 3 = 0 AS done, doc_id % 2 = 0 AS here FROM documents), si AS (SELECT *, wc - least(wc, doc_id % 97) AS since FROM st), ti AS (SELECT *, CASE WHEN here AND (since >= 20 OR done) THEN 1 WHEN NOT done AND since >= 12 THEN 2 WHEN done THEN 3 END AS tier FROM si)"


@query(f"WITH {STATE} SELECT doc_id AS req_id, wc::BIGINT AS word_count, coalesce(tier, 0) AS tier FROM ti")
def guard_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.candidates(_state(spark, sf_dir)).select("req_id", F.col("word_count").cast("long").alias("word_count"), F.coalesce("tier", F.lit(0)).alias("tier"))


@query(f"""WITH {STATE}, n AS (SELECT count(*) AS n FROM ti WHERE tier = 1), f AS (SELECT *, row_number() OVER (ORDER BY tier, -doc_id, doc_id) AS k FROM ti WHERE tier > 1), ok AS (SELECT n > 0 AND (SELECT count(*) FROM ti WHERE tier IS NOT NULL) >= 700 AS ok FROM n)
SELECT doc_id AS req_id, tier FROM ti, ok WHERE tier = 1 AND ok UNION ALL SELECT doc_id, tier FROM f, n, ok WHERE k <= greatest(0, 700 - n) AND ok""")
def guard_batch_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step over all requests, filled up to a minimum batch of 700; nothing where that can't be met."""
    return guard.batch(_state(spark, sf_dir), least=700).select("req_id", "tier")


@query(f"""WITH c AS (SELECT conv_id AS req_id, text, CASE WHEN turn >= 3 THEN 'stop' END AS done, conv_id * 100 + turn AS seq FROM conversations),
st AS (SELECT req_id, arg_max(coalesce(text, ''), seq) AS text, max_by(coalesce(done, ''), seq) <> '' AS done, min(seq) AS seen FROM c GROUP BY req_id), w AS (SELECT *, {WORDS} AS wc FROM st),
ti AS (SELECT *, CASE WHEN wc >= 20 OR done THEN 1 WHEN wc >= 12 THEN 2 END AS tier FROM w), n AS (SELECT count(*) FILTER (tier = 1) AS n, count(*) FILTER (tier IS NOT NULL) AS most FROM ti),
f AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY seen, req_id) AS k FROM ti), x AS (SELECT f.* FROM f, n WHERE n.n > 0 AND n.most >= 10 AND (tier = 1 OR tier = 2 AND k <= 10 - n.n)),
p AS (SELECT req_id, CASE WHEN length(text) % 7 = 0 THEN -1 ELSE 1 END AS pred FROM x) SELECT req_id, pred, CASE WHEN pred < 1 THEN 'stop' ELSE 'go' END AS action FROM p""")
def guard_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step of the guard over conversations as requests, scored by length: actions of the requests in it."""
    came = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("req_id"), "text", F.when(F.col("turn") >= 3, "stop").alias("finish_reason"), (F.col("conv_id") * 100 + F.col("turn")).alias("seq"))
    state = spark.createDataFrame([], guard.STATE)
    _, actions = guard.step(state, came, lambda d: d.select("req_id", F.when(F.length("text") % 7 == 0, -1).otherwise(1).alias("pred")))
    return actions.select("req_id", "pred", "action")


@query(f"""WITH RECURSIVE c AS (SELECT conv_id AS req_id, CASE WHEN turn <= 1 THEN 0 WHEN turn <= 3 THEN 1 ELSE 2 END AS part, max({{'s': turn, 't': coalesce(text, '')}}) AS m FROM conversations GROUP BY ALL),
x AS (SELECT req_id, part, m.s >= 3 AS done, m.t AS text FROM c), p AS (SELECT *, {WORDS} AS wc FROM x),
r AS (SELECT DISTINCT req_id, -1 AS part, 0::BIGINT AS last, false AS due, '' AS text FROM p UNION ALL
SELECT r.req_id, r.part + 1, CASE WHEN p.wc - r.last >= 20 OR p.done THEN p.wc ELSE r.last END, coalesce(p.wc - r.last >= 20 OR p.done, false), p.text FROM r LEFT JOIN p ON p.req_id = r.req_id AND p.part = r.part + 1 WHERE r.part < 2),
a AS (SELECT req_id, CASE WHEN length(text) % 7 = 0 THEN -1 ELSE 1 END AS pred FROM r WHERE due) SELECT req_id, pred, CASE WHEN pred < 1 THEN 'stop' ELSE 'go' END AS action FROM a""")
def guard_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guard on the state store: conversations come as a stream in three parts, by turn; all actions."""
    c = table(spark, sf_dir, "conversations")
    came = c.select(F.col("conv_id").alias("req_id"), F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("turn") >= 3, "stop").alias("finish_reason"), F.col("turn").cast("long").alias("seq"))
    folder = scratch_path(spark, "guard")
    parts = [came.where(w) for w in ("seq <= 1", "seq > 1 AND seq <= 3", "seq > 3")]
    parts[0].write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(came.schema).parquet(f"{folder}/in")
    q = stateful.run(stream, lambda d: d.select("req_id", F.when(F.length("text") % 7 == 0, -1).otherwise(1).alias("pred")), f"{folder}/guard", least=1)
    try:
        q.processAllAvailable()
        for part in parts[1:]:
            part.write.mode("append").parquet(f"{folder}/in")
            q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.schema("req_id bigint, pred int, action string").parquet(f"{folder}/guard/actions").select("req_id", "pred", "action")


@query("""SELECT doc_id, sha256(CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '...' ELSE text END) AS fitted_sha256, length(text)::BIGINT AS n FROM documents""")
def fitted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut to a guard's context of 1800 tokens, 1500 of which are its prompt and 200 a margin: the feature's own cut."""
    return docs(spark, sf_dir).select("doc_id", F.sha2(T.fitted(F.col("text"), 1800), 256).alias("fitted_sha256"), F.length("text").cast("long").alias("n"))


def _template_sql() -> str:
    parts = []
    for name, template in sorted(prompts.TEMPLATES.items()):
        body = template.replace("'", "''").replace("\n", "' || chr(10) || '").replace("{text}", "' || coalesce(text, '') || '").replace("{response}", f"' || '{prompts.NO_RESPONSE}' || '")
        parts.append(f"SELECT doc_id, '{name}' AS guard, sha256('{body}') AS prompt_sha256 FROM documents")
    return " UNION ALL ".join(parts)


@query(_template_sql())
def guard_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every guard's prompt for every document, without a response to judge."""
    d = docs(spark, sf_dir)
    each = F.explode(F.map_from_entries(F.array(*(F.struct(F.lit(n), F.sha2(prompts.rendered(n, F.col("text")), 256)) for n in sorted(prompts.TEMPLATES))))).alias("guard", "prompt_sha256")
    return d.select("doc_id", each)


TEMPLATE = "Classify the text.\n<text>{text}</text>\nAnswer for {lang}:"


@query("SELECT doc_id, 'Classify the text.' || chr(10) || '<text>' || text || '</text>' || chr(10) || 'Answer for ' || lang || ':' AS prompt FROM documents")
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.rendered(TEMPLATE, text=F.col("text"), lang=F.col("lang")).alias("prompt"))
