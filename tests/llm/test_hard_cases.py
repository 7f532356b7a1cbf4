"""Repeated rows, clashing names, hot keys beyond what is broadcast, and scores by plain loops."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from typica.llm import decontaminate, neural_lm, quality_rules, reply_trees, simhash, token_offsets, url_filter, warc

RNG = random.Random(21)


def words(n, rng=RNG, size=900):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def test_one_row_per_group_where_ids_repeat(spark):
    a, b, c = words(50), words(50), words(50)
    rows = spark.createDataFrame([(5, a), (5, b), (6, a), (None, c), (None, c), (None, a)], "doc_id long, text string")
    assert Counter((r.doc_id, r.text) for r in simhash.one_of_each(rows).collect()) == Counter([(5, a), (5, b), (None, c)])


@pytest.mark.parametrize("kind", ["string", "long"])
def test_trees_with_repeated_nodes_and_any_ids(spark, kind):
    name = (lambda x: x) if kind == "string" else (lambda x: None if x is None else "abcde".index(x))
    rows = [("t", name(n), name(p), s, r, x) for n, p, s, r, x in (("a", None, 1.0, "user", "hi"), ("b", "a", 2.0, "assistant", "yo"), ("c", "a", 2.0, "assistant", "zz"), ("d", "c", 2.0, "user", "on"), (None, "a", 9.0, "x", "y"))]
    nodes = spark.createDataFrame(rows * 2, f"tree string, node {kind}, parent {kind}, score double, role string, text string")
    best = reply_trees.tree_paths(nodes)
    assert [(r.leaf, r.node, r.depth) for r in best.orderBy("depth").collect()] == [(name("d"), name(n), k) for k, n in enumerate("acd")]
    told = reply_trees.format_paths(best, nodes).select(reply_trees.read_back(F.col("formatted")).alias("t")).first().t
    assert [(x.role, x.text) for x in told] == [("user", "hi"), ("assistant", "zz"), ("user", "on")]
    assert {(r.leaf, r.rank) for r in reply_trees.tree_paths(nodes, top=None).collect()} == {(name("d"), 1), (name("b"), 2)}
    tied = reply_trees.tree_paths(nodes.where("node <> 'd'" if kind == "string" else "node <> 3"))
    assert {r.leaf for r in tied.collect()} == {name("b")}


def test_random_trees_by_brute_force(spark):
    rng, rows = random.Random(5), []
    for t in range(12):
        for n in range(rng.randrange(1, 40)):
            rows.append((t, n, rng.randrange(n) if n else None, float(rng.randrange(5))))
    rows += [(99, 0, 1, 1.0), (99, 1, 0, 1.0), (99, 2, 0, 1.0), (98, 0, 7, 1.0)]
    want = {}
    for t in {r[0] for r in rows}:
        own = {n: (p, s) for tt, n, p, s in rows if tt == t}
        paths = []
        for leaf in own.keys() - {p for p, _ in own.values()}:
            path = [leaf]
            while own[path[-1]][0] in own and len(path) <= len(own):
                path.append(own[path[-1]][0])
            if len(path) <= len(own):
                paths.append((-sum(own[n][1] for n in path) / len(path), leaf, path[::-1]))
        for k, (_, leaf, path) in enumerate(sorted(paths)[:3]):
            want |= {(t, leaf, k + 1, d): n for d, n in enumerate(path)}
    got = reply_trees.tree_paths(spark.createDataFrame(rows, "tree long, node long, parent long, score double"), top=3)
    assert {(r.tree, r.leaf, r["rank"], r.depth): r.node for r in got.collect()} == want


@pytest.mark.parametrize("most", [100_000, 3])
def test_decontamination_with_clashing_columns_and_shared_windows(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MOST_WINDOWS", most)
    shared = " ".join(f"b{i}" for i in range(14))
    docs = spark.createDataFrame([(1, f"x {shared} y", "a", 0), (2, "nothing here", "b", 1), (1, f"x {shared} y", "a", 0), (3, None, "c", 2)], "doc_id long, text string, DC_found string, dc_n_words long")
    bench = spark.createDataFrame([(i, shared) for i in range(20)] + [(50, "here")], "item_id long, text string")
    out = decontaminate.decontaminate(docs, bench)
    assert out.columns == ["doc_id", "text", "dc_n_words", "dc_n_hit", "dc_spans", "dc_found", "dc_n_items", "dc_items_sha256", "dc_contaminated"]
    got = Counter((r.doc_id, r.dc_n_words, r.dc_n_hit, r.dc_n_items, tuple(r.dc_spans)) for r in out.collect())
    assert got == Counter({(1, 16, 14, 20, (1, 15)): 2, (2, 2, 1, 1, (1, 2)): 1, (3, 0, 0, 0, ()): 1})
    kept = decontaminate.clean_documents(docs, bench)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(3, None, "c", 2)]
    both = decontaminate.decontaminate(docs, bench, prefix="own_")
    assert both.columns[:4] == docs.columns and both.where("own_contaminated").count() == 3


def brute_lines(rows, max_docs, keep_first, copies_once):
    holders, key = defaultdict(list), lambda x: re.sub("[1-9]", "0", x.lower()).strip()
    for i, t, host in rows:
        for line in {key(x) for x in (t or "").split("\n")} - {""}:
            holders[host, line].append((i, t))
    out = []
    for i, t, host in rows:
        def gone(line, i=i, host=host):
            h = holders[host, key(line)] if line.strip() else []
            n = len({t for _, t in h}) if copies_once else len(h)
            return n > max_docs and not (keep_first and i == min((x for x, _ in h if x is not None), default=None))
        out.append((i, "\n".join(x for x in (t or "").split("\n") if not gone(x)) if t is not None else None))
    return Counter(out)


@pytest.mark.parametrize("broadcast", [200_000, 1])
@pytest.mark.parametrize("options", [{}, {"keep_first": True}, {"copies_once": True}])
def test_frequent_lines_by_brute_force(spark, monkeypatch, broadcast, options):
    """Lines at both ends and in runs, copies that outnumber the limit, a null host, ids that repeat."""
    monkeypatch.setattr(quality_rules, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(quality_rules, "BROADCAST_ENTRIES", broadcast)
    rng = random.Random(6)
    lines = [words(4, rng, 50) for _ in range(6)]
    rows = [(i, "\n".join(rng.choices([*lines, words(5, rng), "", " "], k=rng.randrange(1, 9))), rng.choice(["a", "b", None])) for i in range(60)]
    rows += [(200 + i, "same text\nof a copy", "a") for i in range(9)] + [rows[3], rows[3], (None, lines[0], "a"), (7, lines[1] + "\n" + lines[0], "a"), (300, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = quality_rules.quality_rules(docs, max_docs=5, **options)
    assert Counter((r.doc_id, r.qr_clean_text) for r in got.collect()) == brute_lines(rows, 5, options.get("keep_first", False), options.get("copies_once", False))


def test_share_of_a_host(spark):
    rows = [(i, f"line\n{words(5)}", "small" if i < 30 else "large") for i in range(400)]
    got = quality_rules.quality_rules(spark.createDataFrame([(i, t if i < 60 else words(6), h) for i, t, h in rows], "doc_id long, text string, source string"), max_share=0.5)
    assert {r.source for r in got.where("qr_n_removed_lines > 0").collect()} == {"small"}


def test_urls_that_no_list_names(spark):
    """The models judge by characters: a host that looks like the rejected ones goes, also without a seed word of its own."""
    rng = random.Random(2)
    good = [f"https://{a}.example.com/{rng.choice(['en', 'de'])}/{rng.randrange(9999)}" for a in ("news", "garden", "history", "weather") for _ in range(60)]
    bad = [f"http://{a}.example.com/win/{rng.randrange(9999)}" for a in ("casino-win", "free-bets", "poker-bet", "best-casino") for _ in range(30)]
    pages = spark.createDataFrame([(u,) for u in good + bad + ["http://mycasinos.example.com/win/12", "https://gardens.example.com/en/17"]] + [(None,)], "url string")
    judged = {r.url: r for r in url_filter.url_filter(pages, rules=[]).collect()}
    assert judged["http://mycasinos.example.com/win/12"].uf_verdict == "block" and judged["https://gardens.example.com/en/17"].uf_verdict == "allow"
    assert judged[None].uf_verdict == "allow" and judged[None].uf_score is None
    frame = lambda us: spark.createDataFrame([(u,) for u in us], "url string")
    model = url_filter.fit(frame(good), frame(bad))
    assert model.held_out["accepted"] == 240 and model.held_out["rejected"] == 120
    assert model.held_out["accepted_above"] <= 5 and model.held_out["rejected_below"] <= 5
    other = frame(["https://best-poker.example.net/win/3", "https://museum.example.com/en/5", "https://ПРИМЕР.example/"]).withColumn("UF_rule", F.lit(1))
    got = url_filter.url_filter(other, rules=[("block", "example", "/")], model=model)
    assert got.columns == ["url", "uf_host", "uf_path", "uf_rule", "uf_score", "uf_bound", "uf_verdict"]
    assert [r.uf_verdict for r in got.orderBy("url").collect()] == ["block", "allow", "block"]
    assert url_filter.url_filter(pages.limit(0)).count() == 0


def test_held_out_scores_by_plain_counts(spark):
    """Each URL's score from the counts of the other fold's examples, order by order."""
    rng = random.Random(3)
    urls = [f"http://{rng.choice(['ads', 'news', 'web', 'adult'])}{rng.choice('-.')}{rng.choice('abc')}.com/{rng.randrange(30)}" for _ in range(80)]
    pages = spark.createDataFrame([(u,) for u in urls], "url string").withColumn("text", url_filter.model_text(F.col("url"))).withColumn("fold", url_filter.fold_of(F.col("text")))
    rows = {r.url: r for r in pages.collect()}
    bad = lambda u: u.startswith(("http://ads", "http://adult"))
    size = len(url_filter.ALPHABET)

    def chance(gram, counts):
        p = 1 / size
        for k in range(1, 5):
            own, ctx = gram[4 - k :], gram[4 - k : -1]
            n = sum(c for g, c in counts[k].items() if g[:-1] == ctx)
            t = sum(1 for g in counts[k] if g[:-1] == ctx)
            p = (counts[k][own] + t * p) / (n + t) if n + t else p
        return p

    counts = {}
    for f in (0, 1):
        for kind in (True, False):
            counts[f, kind] = [Counter() for _ in range(5)]
            for u in urls:
                if rows[u].fold == f and bad(u) == kind:
                    for i in range(len(rows[u].text) - 3):
                        for k in range(1, 5):
                            counts[f, kind][k][rows[u].text[i + 4 - k : i + 4]] += 1
    for r in url_filter.url_filter(pages, rules=[]).collect():
        grams, other = [r.text[i : i + 4] for i in range(len(r.text) - 3)], 1 - r.fold
        want = sum(math.log(chance(g, counts[other, True])) - math.log(chance(g, counts[other, False])) for g in grams) / len(grams)
        assert r.uf_score == pytest.approx(want, abs=1e-9)


def test_language_model_by_plain_loops(spark, monkeypatch):
    """Scores from the trained parameters by a full softmax per token; other partitions, same scores."""
    monkeypatch.setattr(neural_lm, "HEAD", 60)
    monkeypatch.setattr(neural_lm, "SHARD", 700)
    docs = spark.createDataFrame([(i, words(RNG.randrange(0, 60), RNG, 120)) for i in range(60)] + [(100, None), (101, ""), (102, "never seen before"), (None, words(9)), (5, "w1 w1")], "doc_id long, text string")
    held, train = {}, neural_lm.train

    def spied(read, v, **options):
        held["p"], held["v"] = train(read, v, **options), v
        return held["p"]

    monkeypatch.setattr(neural_lm, "train", spied)
    learned = F.coalesce(F.col("doc_id") % 5 != 0, F.lit(True))
    got = sorted(((r.id is None, r.id or 0, r.n_tokens, r.score) for r in neural_lm.score(docs, learned, model_words=40).collect()))
    p, v = held["p"], held["v"]
    tokens = lambda t: [*(t or "").lower().split(), "\n"]
    seen = Counter(w for r in docs.where(learned).collect() for w in tokens(r.text))
    units = {w.decode(): i for i, w in enumerate(v.names[:40])}
    unit = lambda w: units.get(w, 40 + neural_lm.class_of(w))
    tail = defaultdict(lambda: [0, 0])
    for w, n in seen.items():
        if w not in units:
            tail[neural_lm.class_of(w)][0] += n
            tail[neural_lm.class_of(w)][1] += 1
    start = neural_lm.TOP + neural_lm.CLASSES
    context = lambda u: u if u < 40 else neural_lm.TOP + u - 40
    want = []
    for r in docs.collect():
        total, before = 0.0, [start, start]
        for w in tokens(r.text):
            logits = ((p.u1[before[0]].astype(float) + p.u2[before[1]]) @ p.r.T.astype(float)) + p.b
            total += (logits[unit(w)] - np.log(np.exp(logits - logits.max()).sum()) - logits.max()) / math.log(10)
            if w not in units:
                n, k = tail[neural_lm.class_of(w)]
                total += math.log10((seen[w] + 1) / (n + k + 1))
            before = [context(unit(w)), before[0]]
        want.append((r.doc_id is None, r.doc_id or 0, len(tokens(r.text)), total))
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=1e-3)
    other = sorted(((r.id is None, r.id or 0, r.n_tokens, r.score) for r in neural_lm.score(docs.repartition(7), learned, model_words=40).collect()))
    assert all(a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=1e-6) for a, b in zip(got, other, strict=True))


@pytest.mark.parametrize("few", [50_000, 1, 3])
def test_many_equal_payloads(spark, monkeypatch, few):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", few)
    rows = [(i, f"http://x/{i}", None if i % 3 == 0 else f"page {i % 7} " * 30) for i in range(60)] + [(8, "u", "page 1 " * 30), (None, "v", "w")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), spark).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = max(first.get(h or "", i), i)
    want = Counter((i, len(h or ""), *(("response", None) if i is None or i == first[h or ""] else ("revisit", first[h or ""]))) for i, _, h in rows)
    assert Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got) == want


def test_lines_of_long_texts():
    text = "".join(RNG.choice(["a", "ü", "漢", "🙂", "\n", " word"]) for _ in range(200_000))
    spans, _ = token_offsets.lines(text)
    assert [text[a:b] for a, b in spans.tolist()] == [x + "\n" for x in text.split("\n")[:-1]] + ([text.split("\n")[-1]] if text.split("\n")[-1] else [])
    starts, stops = token_offsets.Spans(token_offsets.ranks_of(token_offsets.VOCABULARY)).of(text)
    n, none = token_offsets.attribute(starts, stops, spans, "largest")
    assert none == 0 and n.sum() == len(starts) and stops[-1] == len(text)
