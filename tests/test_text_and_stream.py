"""Text functions, loaders, guard parsers, cache and the streaming guard on the edge cases."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from typica.functions import guards as G
from typica.functions import text as T
from typica.sources import cache, corpora
from typica.streaming import guard, rates


def evaluate(spark, column, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_strip_and_length(spark):
    values = ["\n\t a b \xa0 ", "x" * 20, "x" * 21, " " + "x" * 20 + "　", "", None, "\x1c\x85y "]
    assert evaluate(spark, T.strip, values) == [(v or "").strip() for v in values]
    assert evaluate(spark, T.long_enough, values) == [len((v or "").strip()) > 20 for v in values]
    assert evaluate(spark, T.n_words, [*values, " a  b\n\nc "]) == [len((v or "").split()) for v in [*values, " a  b\n\nc "]]


DIALOGUES = ["", "no marks", "Human: one", "Human: a Assistant: b Human: c Assistant: d Human: e", "Assistant: x Human: y", "x" * 600, None]


def test_turns(spark):
    def first(c):
        return c.split("Human:")[1].split("Assistant:")[0].strip() if c and "Human:" in c else None

    def last(c, kind="Human", other="Assistant"):
        return None if c is None else (c.split(f"{kind}:")[-1].split(f"{other}:")[0].strip() if f"{kind}:" in c else c[:500].strip())

    assert evaluate(spark, T.first_human_turn, DIALOGUES) == [first(c) for c in DIALOGUES]
    assert evaluate(spark, T.last_turn, DIALOGUES)[:-1] == [last(c) for c in DIALOGUES[:-1]]
    assert evaluate(spark, lambda c: T.last_turn(c, "Assistant"), DIALOGUES)[:-1] == [last(c, "Assistant", "Human") for c in DIALOGUES[:-1]]


def test_templates(spark):
    got = evaluate(spark, lambda c: T.rendered("a {x} b {x}{y}", x=c, y=F.lit("{x}")), ["1", None])
    assert got == ["a 1 b 1{x}", "a  b {x}"]


CASES = [
    (G.first_word_guard, ["safe", "unsafe\nS1", "unsafe", "UNSAFE", "", None], [0.9, 0.05, 0.1, 0.1, 0.2, 0.1]),
    (G.judged_guard, ["[RESULT]: safe, 3", "[RESULT]: unsafe 5", "[RESULT]: safe\n5", "SAFE", "unsafe", "?", None, "[RESULT]: unsafe 9"], [0.6, 0.2, 0.7, 0.7, 0.2, 0.1, 0.1, 0.05]),
    (G.request_guard, ["Harmful request: yes", "harmful request: no", "harmful request: eh\nharmful request: no", "", None], [0.1, 0.9, 0.2, 0.2, 0.2]),
    (G.policy_guard, ["prompt harmful: yes S10", "S10 only", "refusal: true", "prompt unsafe", "response harmful: no", None], [0.2, 1.0, 0.5, 1.0, 1.0, 1.0]),
]


@pytest.mark.parametrize(("parser", "values", "want"), CASES)
def test_guard_parsers(spark, parser, values, want):
    assert evaluate(spark, parser, values) == pytest.approx(want)


def test_scores_of_arrays(spark):
    df = spark.createDataFrame([(1, [0.2, 0.7]), (2, []), (3, None)], "i int, p array<double>")
    assert [r[0] for r in df.orderBy("i").select(G.worst_of(F.col("p"))).collect()] == pytest.approx([0.3, 1.0, 1.0])
    assert [r[0] for r in df.orderBy("i").select(G.scanner_score(F.col("p"), F.array(F.lit(False)))).collect()] == pytest.approx([0.3, 0.1, 0.1])
    with pytest.raises(ValueError):
        G.scanner_score(F.col("p"), F.col("p"), "weighted")


def test_decision_confidence(spark):
    kind = "array<struct<pos:int,token:string,value:double,generated:boolean>>"
    inf = float("-inf")
    rows = [
        [(0, "\n", 0.0, True), (1, "safe", -0.1, True), (1, "unsafe", -2.0, False)],
        [(0, "unsafe", -0.2, True), (0, "safe", inf, False), (0, "S1", -3.0, False)],
        [(0, "hello", -0.2, True)],
        [(0, "safe", inf, True)],
        [],
        None,
    ]
    logits = evaluate(spark, lambda c: G.decision_confidence(c, logits=True), rows, kind)
    logprobs = evaluate(spark, lambda c: G.decision_confidence(c, logits=False), rows, kind)
    two = 1 / (1 + math.exp(-1.9))
    assert logits == pytest.approx([two, 1 - 1 / (1 + math.exp(-2.8)), 0.2, 0.8, 0.2, 0.2])
    assert logprobs[:2] == pytest.approx([two, 1 - math.exp(-0.2)]) and logprobs[2:] == [None] * 4


def test_attributes_and_repair(spark):
    ok = '{"attributeScores":{"TOXICITY":{"summaryScore":{"value":0.25}}}}'
    df = spark.createDataFrame([(1, "t", ok), (2, " ", None), (3, "t", None), (4, "t", "{}")], "i int, t string, r string")
    assert [r[0] for r in df.orderBy("i").select(G.attribute_guard(F.col("t"), F.col("r"), ["TOXICITY"])).collect()] == [0.75, 1.0, 0.0, 1.0]
    assert evaluate(spark, G.repaired, [float("nan"), float("inf"), 0.2], "double") == [0.5, 0.5, 0.2]


def test_loaders(spark):
    long = "a text that is long enough to count"
    rtp = spark.createDataFrame([(1, long, long * 30, (4.0,), (3.0,)), (2, long, long, (1.0,), (5.0,)), (3, long, None, None, None), (4, "short", long, (9.0,), (0.0,))], "i int, Prompt string, Completion string, PromptAnnotations struct<Toxicity:double>, CompletionAnnotations struct<Toxicity:double>")
    got = [(r.ord, r.sub, len(r.text), r.is_id) for r in corpora.load(rtp, "rtp_lx", "i").orderBy("ord", "sub").collect()]
    assert got == [(1, 0, len(long), False), (1, 1, 500, False), (2, 1, len(long), False)]
    one = spark.createDataFrame([(1, (long, 0.7), (long, 0.9)), (2, ("short", 0.9), (long + "!", 0.9)), (3, None, (long, 0.1))], "i int, prompt struct<text:string,toxicity:double>, continuation struct<text:string,toxicity:double>")
    assert [(r.ord, r.text) for r in corpora.load(one, "realtoxicity", "i").orderBy("ord").collect()] == [(1, long), (2, long + "!")]
    tails = spark.createDataFrame([(1, long, "cat", "benign", ""), (2, long, "", None, "harmful")], "i int, prompt string, subcategory string, prompt_label string, prompt_harm_label string")
    assert corpora.load(tails, "polyguardprompts", "i").count() == 2
    beaver = spark.createDataFrame([(1, long, False), (2, long, True), (3, long, None)], "i int, prompt string, is_safe boolean")
    assert [r.ord for r in corpora.load(beaver, "beavertails", "i").collect()] == [1]
    assert len(corpora.load(beaver.union(beaver), "harmbench", "i", most=3).collect()) == 3


def test_places_and_splits(spark):
    rows = spark.createDataFrame([((i * 37) % 101, i) for i in range(101)], "k long, x long").repartition(5)
    got = corpora.places(rows, "k", ranges=6).orderBy("k").collect()
    assert [r.place for r in got] == list(range(1, 102))
    split = corpora.split_share(rows, 0.7, "k").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in split} == {"train": 70, "test": 31}


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"user_input": "one"}, {"user_input": "two"}]')
    (tmp_path / "b.jsonl").write_text('{"user_input": "one"}\n{broken\n{"user_input": "three"}\n')
    read = lambda n: sorted(r.user_input for r in corpora.read_json(spark, str(tmp_path / n), "user_input string").collect() if r.user_input)
    assert read("a.json") == ["one", "two"] and read("b.jsonl") == ["one", "three"]


def test_cache(spark, tmp_path):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id long, text string")
    path = f"{tmp_path}/cache"
    spark.createDataFrame([], cache.SCHEMA).write.parquet(path)
    calls = []

    def call(df):
        rows = df.collect()
        calls.append(sorted(r.text or "" for r in rows))
        return spark.createDataFrame([(r.key, f"out-{r.text}", 0.1, r.text != "b") for r in rows], "key string, output string, duration_seconds double, success boolean")

    read = lambda: spark.read.schema(cache.SCHEMA).parquet(path)
    got = cache.filled(texts, read(), "m", call, path).collect()
    assert {r.id for r in got} == {1, 3, 4}
    assert cache.misses(texts, read(), "m").select("text").collect()[0].text == "b" and cache.misses(texts, read(), "other").count() == 3
    cache.filled(texts, read(), "m", call, path)
    assert calls == [["", "a", "b"], ["b"]]


def test_encoder_table(spark, tmp_path):
    from typica.sources import encoders

    path = f"{tmp_path}/vectors"
    spark.createDataFrame([], encoders.SCHEMA).write.partitionBy("model").parquet(path)
    (tmp_path / "vectors").mkdir(exist_ok=True)
    texts = spark.createDataFrame([(1, "ab"), (2, "c"), (3, "ab"), (4, None)], "id long, text string")
    size = lambda t: [[float(len(x)), 1.0] for x in t]
    got = encoders.per_model(texts, {"m": size}, path, "id")["m"].collect()
    assert {r.id: r.v for r in got} == {1: [2.0, 1.0], 2: [1.0, 1.0], 3: [2.0, 1.0], 4: [0.0, 1.0]}

    def refuse(t):
        raise AssertionError(t)

    assert encoders.embedded(texts, "m", refuse, path).count() == 4
    assert spark.read.parquet(path).count() == 3


def words(n):
    return " ".join(["w"] * n)


def came(spark, rows):
    return spark.createDataFrame(rows, "req_id long, text string, finish_reason string, seq long")


def state(spark, rows=()):
    return spark.createDataFrame(list(rows), guard.STATE)


def score(df):
    return df.select("req_id", F.when(F.col("req_id") % 5 == 0, -1).otherwise(1).alias("pred"))


def test_guard_waits_for_its_minimum(spark):
    rows = [(i, words(25), None, i) for i in range(1, 4)] + [(9, words(5), None, 9)]
    new, actions = guard.step(state(spark), came(spark, rows), score)
    assert actions.count() == 0 and {r.last_predicted_at for r in new.collect()} == {0}


def test_guard_fills_and_stops(spark):
    old = [(i, words(13), 13, 0, None, i) for i in range(20, 26)] + [(40 + i, words(3), 3, 3, "done", i) for i in range(4)]
    rows = [(i, words(25), None, i) for i in (5, 6)] + [(7, words(2), "stop", 7), (5, words(21), None, 1)]
    new, actions = guard.step(state(spark, old), came(spark, rows), score)
    got = {r.req_id: r.action for r in actions.collect()}
    assert set(got) == {5, 6, 7, 20, 21, 22, 23, 24, 25, 40}
    assert got[5] == "stop" and got[20] == "go" and got[25] == "go" and got[40] == "go"
    at = {r.req_id: (r.word_count, r.last_predicted_at) for r in new.collect()}
    assert at[5] == (25, 25) and at[20] == (13, 13) and at[41] == (3, 3) and len(at) == 13


@pytest.mark.parametrize(("options", "stay"), [({"history": 0}, 0), ({}, 2)])
def test_guard_as_a_stream(spark, tmp_path, options, stay):
    """Without a history finished requests leave the state; by default the last ones stay to fill batches."""
    source = tmp_path / "in"
    source.mkdir()
    kind = "req_id long, text string, finish_reason string, seq long"
    q = guard.run(spark.readStream.schema(kind).parquet(str(source)), score, str(tmp_path / "out"), least=2, **options)
    for n in (1, 2):
        came(spark, [(i, words(20 * n), "stop" if n == 2 else None, n) for i in (4, 5)]).coalesce(1).write.mode("append").parquet(str(source))
        q.processAllAvailable()
    q.stop()
    actions = spark.read.parquet(str(tmp_path / "out" / "actions"))
    assert {(r.req_id, r.action) for r in actions.collect()} == {(4, "go"), (5, "stop")} and actions.count() == 4
    last = max(int(p.name) for p in (tmp_path / "out" / "state").iterdir())
    assert spark.read.schema(guard.STATE).parquet(str(tmp_path / "out" / "state" / str(last))).count() == stay


def test_rate_windows_and_batches(spark):
    r = spark.createDataFrame([("m", t * 1_000_000, 1 + t) for t in (0, 30, 59, 60, 130)], "model string, ts_us long, tokens long")
    assert [(x.n_requests, x.n_tokens) for x in rates.rate_window(r).orderBy("ts_us").collect()] == [(1, 1), (2, 32), (3, 92), (3, 152), (1, 131)]
    t = spark.createDataFrame([("m", i, n) for i, n in enumerate((50, 40, 20, 200, 10))] + [("k", 0, 5)], "model string, ord long, tokens long")
    assert [x.batch for x in rates.token_batches(t, 125).where("model = 'm'").orderBy("ord").collect()] == [0, 0, 1, 2, 3]


def test_first_tokens_of_long_and_odd_texts(spark):
    space = "[" + "".join(c for c in map(chr, range(0x3001)) if c.isspace()) + "]"
    rng = random.Random(2)
    texts = [None, "", "  ", " a", "a b ", "\n a\u3000b  c", "".join(rng.choice("ab \t\n\xa0") for _ in range(200)), "w " * 40_000, "\x85" + "word\n\n" * 40_000 + "end"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, t string")
    for most in (0, 1, 2, 8192):
        for k, got in df.select("id", T.first_tokens(F.col("t"), most)).collect():
            t, ends = texts[k], [] if texts[k] is None else [m.end() for m in re.finditer(f"[^{space[1:]}+", texts[k])]
            assert got == (None if t is None else "" if most == 0 else t if len(ends) <= most else t[: ends[most - 1]])
