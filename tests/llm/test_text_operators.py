"""Operators on documents: against brute force on small fixtures with nulls, empty and long texts, ties and repeats."""

import hashlib
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from typica.llm import components, decontaminate, mixing, neural_lm, oracles, quality_rules, simhash, subword_classifier, token_offsets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(3)
VOCAB = [f"w{i}" for i in range(400)]


def sentence(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, long and repeated texts, near copies, and columns with names that operators use."""
    long = sentence(30_000)
    base = sentence(120)
    near = [" ".join(w if i != k else "changed" for i, w in enumerate(base.split())) for k in range(5)]
    texts = [None, "", " \t\n", "one", "one two", "A b\nC d\nA b", long, long, base, base, *near, "Ünï cødé " * 40, "x" * 5000, sentence(60) + "\n" + sentence(60)]
    rows = documents(spark, texts)
    rows = rows.unionByName(rows.where("doc_id = 8")).unionByName(spark.createDataFrame([(None, base, None, None, None)], DOCS))
    return rows.withColumns({"host": F.lit(1), "fp": F.lit("x"), "id": F.lit(2), "score": F.lit(None).cast("string"), "key": F.lit(0)})


def brute_fingerprint(text):
    w = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(ids, prints):
    n, parent = len(ids), list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    return [min((ids[j] for j in range(n) if root(j) == root(i) and ids[j] is not None), default=None) for i in range(n)]


def test_fingerprints_and_groups(spark, odd):
    rows = odd.select("doc_id", "text").collect()
    want = Counter(zip([r.doc_id for r in rows], [brute_fingerprint(r.text) for r in rows], brute_groups([r.doc_id for r in rows], [brute_fingerprint(r.text) for r in rows]), strict=True))
    got = Counter((r.id, r.fp % 2**64, r.component) for r in simhash.near_duplicates(odd).collect())
    assert got == want


def test_links_lose_nothing_in_dense_groups(spark, monkeypatch):
    """Random fingerprints around a few centres, with blocks so small that hot keys are dealt out."""
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 4)
    prints = {int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for c in centres for _ in range(150)} | {int(x) for x in rng.integers(0, 2**63, 200)}
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    monkeypatch.setattr(simhash, "BLOCK", 16)
    links = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    found = {r.node: r.root for r in components.components(links).collect()}
    want = dict(zip(signed, brute_groups(signed, [p % 2**64 for p in signed]), strict=True))
    assert {p: found.get(p, p) for p in signed} == want


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_components_of_chains_and_stars(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(5, 5), (None, 3), (41, 200), (200, 40)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 42)}, 200: 0, **{i: 100 for i in range(101, 140)}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_of_each_keeps_whole_rows(spark, odd):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    groups = {(r.component) for r in simhash.near_duplicates(odd).where("id is not null").collect()}
    assert Counter(r.doc_id for r in kept.where("doc_id is not null").collect()) == Counter(groups)
    assert kept.where("doc_id is null").count() == 0  # its text is a copy of one that has an id


BENCH = ["Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron", "short item", "", None, "!!!", "short item"]


def brute_words(text):
    out, now = [], ""
    for c in (text or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if "0" <= c <= "9" or "a" <= c <= "z" or ord(c) >= 128:
            now += c
        elif now:
            out.append(now)
            now = ""
    return out


def brute_contamination(text, items):
    w, hit, found = brute_words(text), set(), set()
    for i, item in enumerate(items):
        v = brute_words(item)
        m = min(13, len(v))
        for a in range(len(v) - m + 1 if v else 0):
            for b in range(len(w) - m + 1):
                if w[b : b + m] == v[a : a + m]:
                    hit |= set(range(b, b + m))
                    found.add(str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("most", [200_000, 2])
def test_decontamination(spark, odd, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MOST_WINDOWS", most)
    texts = [sentence(40) + " " + BENCH[0].upper().replace(" ", ", ") + " " + sentence(5), "a SHORT-item b", "alpha beta gamma", "short short item item short item " + sentence(200), BENCH[0][:-9]]
    docs = odd.drop("key").unionByName(spark.createDataFrame([(100 + i, t, "en", "s", 0, 1, "x", 2, None) for i, t in enumerate(texts)], odd.drop("key").schema))
    bench = spark.createDataFrame(list(enumerate(BENCH)), "item_id long, text string")
    got = decontaminate.decontaminate(docs, bench).collect()
    assert Counter((r.doc_id, r.dc_n_words, r.dc_n_hit, r.dc_n_items, r.dc_items_sha256, r.dc_contaminated) for r in got) == Counter((r.doc_id, *brute_contamination(r.text, BENCH)) for r in docs.collect())
    assert decontaminate.clean_documents(docs, bench).columns == docs.columns
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("dc_contaminated").count() == 0


def test_quality_rules_by_sql(spark):
    """A frequent line on one host, its first document, exact copies, and documents that are left with little."""
    line, rng = "Same LINE 7 on every page of this host", random.Random(5)
    rows = [(i, "\n".join([line if i % 2 else line.lower().replace("7", " 9 "), sentence(55, rng), sentence(55, rng)]), "en", "a", 0) for i in range(25)]
    rows += [(100 + i, "\n".join([line] * 30 + [sentence(3, rng)]), "en", "a", 0) for i in range(3)]
    rows += [(200 + i, "exact copy " * 5 + "\n" + sentence(0, rng) + "copies " * 60, "en", "b", 0) for i in range(40)]
    rows += [(300, None, None, None, None), (301, "", "en", None, 0), (302, "a b c a b c x y z", "en", "b", 0), (303, "\n \n#$\n#$", "en", "b", 0), (None, sentence(70, rng), "en", "b", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = quality_rules.quality_rules(docs)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "words_left")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = Counter(con.execute(f"SELECT doc_id, {', '.join(names)} FROM ({oracles.LINE_FREQUENCY})").fetchall())
    assert Counter(tuple(r) for r in got.select("doc_id", *(f"qr_{n}" for n in names)).collect()) == want
    by = {r.doc_id: r for r in got.collect()}
    assert by[0].qr_n_removed_lines == 1 and by[1].qr_n_removed_lines == 1 and line not in by[1].qr_clean_text
    assert not by[101].qr_kept and by[101].qr_n_removed_lines == 30 and by[200].qr_n_removed_lines == 2 and not by[200].qr_kept  # copies count
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= set(range(25))
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_quality_rules_odd_rows(odd):
    got = quality_rules.quality_rules(odd)
    assert got.count() == odd.count() and got.columns[: len(odd.columns)] == odd.columns
    for r in got.collect():
        w = (r.text or "").split()
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
        assert (r.qr_n_words, r.qr_n_repeat_words) == (len(w), len(again))


def test_classifier_learns_and_handles_odd_rows(spark, odd):
    rng = random.Random(2)
    good = [sentence(60, rng) for _ in range(80)]
    bad = [" ".join(w + "***" for w in sentence(60, rng).split()) for _ in range(40)]
    docs = documents(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 80)) for i in range(120)] + [(None, 1), (3, None), (5, 1), (5, 1)], "doc_id long, quality int")
    fold = subword_classifier.fold("doc_id", 4)
    model = subword_classifier.fit(docs, labels, train_rows=fold != 2)
    scored = subword_classifier.score(docs, model).withColumn("held", fold == 2).collect()
    held = [r for r in scored if r.held]
    assert len(held) > 10 and all((r.qc_score >= 0.7) == (r.doc_id < 80) for r in held)
    more = subword_classifier.score(odd, model).collect()
    assert len(more) == odd.count() and all(0 <= r.qc_score <= 1 for r in more)
    assert len({r.qc_score for r in more if not (r.text or "")}) == 1
    for some, want in ((labels.limit(0), 0.5), (labels.where("quality = 1"), 1.0), (labels.where("quality = 0"), 0.0)):
        one = subword_classifier.fit(docs, some, train_rows=F.lit(True))
        assert subword_classifier.score(docs.limit(1), one).first().qc_score == pytest.approx(want, abs=1e-6)
    assert subword_classifier.score(docs.limit(0), model).count() == 0


def test_subword_features():
    assert subword_classifier.tokens("a a\nb\n") == ["a", "\r", "a", "\n", "b", "\n"]
    assert subword_classifier.tokens(None) == [] and subword_classifier.tokens("") == []
    at, owner = subword_classifier.features(["abc", "\n", "abc", "é漢"])
    assert Counter(owner.tolist()) == {0: 1 + 3 + 2, 1: 1, 2: 6, 3: 1 + 2 + 1}
    assert at[owner == 0].tolist() == at[owner == 2].tolist() and at.max() < subword_classifier.BUCKETS


def test_language_model(spark, odd, monkeypatch):
    """Base scores by brute force; known counts; the model's distribution sums to one; it beats the base on structure."""
    rng = random.Random(8)
    texts = [" ".join(f"k{(i + j) % 7}" if j % 2 else f"m{(i + j) % 7}" for j in range(rng.randrange(20, 60))) for i in range(300)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")).repartition(3)
    held = subword_classifier.fold("doc_id", 7) == 2
    monkeypatch.setattr(neural_lm, "HEAD", 300)
    got = neural_lm.score(docs, ~held, model_words=40, rounds=2).collect()
    rows = docs.withColumn("held", held).collect()
    tokens = lambda t: [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in (t or "").split()] + ["\n"]
    counts = Counter(w for r in rows if not r.held for w in tokens(r.text))
    n, v = sum(counts.values()), len(counts)

    def base(t):
        own = tokens(t)
        return len(own), sum(counts[w] > 0 for w in own), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), 4)

    assert Counter((r.id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == Counter((r.doc_id, *base(r.text)) for r in rows)
    new = [r for r in got if r.id and r.id >= 1000]
    assert sum(r.score for r in new) > sum(r.base_score for r in new)
    assert neural_lm.score(docs.limit(0), F.lit(True)).count() == 0


def test_normalisers_are_exact():
    p = neural_lm.start(np.array([5.0, 3, 2, 1]))
    rng = np.random.default_rng(0)
    p.r += rng.normal(size=p.r.shape).astype(np.float32)
    scores = (p.u1[1] + p.u2[3]) @ p.r.T + p.b
    assert np.exp(scores - p.normalisers()[1, 3]).sum() == pytest.approx(1, abs=1e-5)


def brute_sections(text, rule):
    spans = token_offsets.Spans(token_offsets.ranks_of(token_offsets.VOCABULARY))
    ids = spans.encoding.encode_ordinary(text)
    raw, at, out = text.encode(), 0, Counter()
    line, lines = 0, []
    for c in text:
        lines.append(line)
        line += c == "\n"
    starts = [i for i, b in enumerate(raw) if b & 0xC0 != 0x80]
    owner = {}
    for k, s in enumerate(starts):
        for b in range(s, starts[k + 1] if k + 1 < len(starts) else len(raw)):
            owner[b] = k
    for i in ids:
        n = len(spans.encoding.decode_single_token_bytes(i))
        chars = sorted({owner[b] for b in range(at, at + n)})
        at += n
        own = Counter(lines[c] for c in chars)
        if rule == "largest":
            out[min(own, key=lambda s: (-own[s], s))] += 1
        elif rule == "start":
            out[lines[chars[0]]] += 1
        else:
            for s, k in own.items():
                out[s] += k / len(chars)
    return out, len(ids)


@pytest.mark.parametrize("rule", ["largest", "start", "split"])
def test_token_offsets(spark, odd, rule):
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(50, "a\n\n\n\nb  \n\n  c\nÜber 漢字\n\n🙂x\n"), (51, "\n"), (52, "\n\n\n")], "doc_id long, text string"))
    rows = token_offsets.section_tokens(docs, rule=rule).collect()
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append(r)
    for d in docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect():
        want, n = brute_sections(d.text or "", rule)
        copies = docs.where(F.col("doc_id") == d.doc_id).count()
        got = by[d.doc_id][: len(by[d.doc_id]) // copies]
        assert all(r.doc_tokens == n for r in got)
        assert {r.section: pytest.approx(r.n_tokens) for r in got if r.n_tokens} == {k: v for k, v in want.items() if v}
        assert "".join((d.text or "")[r.start : r.stop] for r in got) == (d.text or "")
    assert token_offsets.section_tokens(docs.limit(0)).count() == 0


def test_long_blanks_are_cut_where_the_pattern_cuts():
    spans, rng = token_offsets.Spans(token_offsets.ranks_of(token_offsets.VOCABULARY)), random.Random(6)
    for _ in range(400):
        text = "".join(rng.choice([" ", "\n", "\t", "\xa0", "\u3000", "\x1c", "a", "Z", "9", "'s", "!", "\u6f22"]) * rng.randrange(1, 9) for _ in range(rng.randrange(12)))
        assert spans.tokens(text, rng.randrange(1, 6)) == spans.encoding.encode_ordinary(text)


def test_very_long_texts_of_one_kind(spark):
    size = 5_000_000
    texts = [" " * size, "\n" * size, "ab" * (size // 2), "x" + " \t" * (size // 2) + "y", "\u6f22\n" * 300_000, "w " * 600_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = token_offsets.section_tokens(rows).groupBy("id").agg(F.sum("n_tokens").alias("n"), F.max("doc_tokens").alias("of"), F.count(F.lit(1)).alias("sections"), F.max("stop").alias("stop")).collect()
    assert all(r.n == r.of > 0 and r.stop == len(texts[r.id]) for r in got) and len(got) == len(texts)
    assert {r.id: r.sections for r in got} == {0: 1, 1: size, 2: 1, 3: 1, 4: 300_000, 5: 1}


def test_field_tokens_share_one_encoding(spark):
    rows = spark.createDataFrame([(1, "Title here", "body text of it"), (2, None, "x"), (3, None, None)], "doc_id long, title string, body string")
    got = token_offsets.field_tokens(rows, ["title", "body"]).collect()
    for i in (1, 2, 3):
        own = [r for r in got if r.id == i]
        assert sum(r.n_tokens for r in own) == own[0].doc_tokens
        assert [r.name for r in own if r.section >= 0] == ["title", "body"]


def test_mixing_meets_targets(spark, odd):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, sentence(rng.randrange(5, 50), rng), rng.choice(["en", "en", "en", "de"]), rng.choice(["a", "a", "a", "b", "c"]), 0) for i in range(3000)] + [(9000, None, None, None, None), (9001, "", "en", "a", 0)], DOCS)
    targets = {"source": {"a": 1.0, "b": 1.0}, "lang": {"en": 0.6, "de": 0.4}}
    out = mixing.mix(docs, targets, budget=0.3).cache()
    assert out.count() == docs.count()
    shares = {(r.dimension, r.value): r for r in mixing.report(out, targets).collect()}
    other = shares["source", mixing.OTHER].share_before
    assert shares["source", "a"].share_expected == pytest.approx((1 - other) / 2, abs=1e-6)
    assert shares["lang", "de"].share_expected == pytest.approx(0.4, abs=1e-6)
    assert all(abs(r.share_kept - r.share_expected) < 0.06 for r in shares.values())
    for r in out.collect():
        key = ":".join(x for x in ("17", str(r.doc_id), r.text) if x is not None)
        draw = int(hashlib.md5(key.encode()).hexdigest()[:12], 16) / 16**12
        assert r.mx_kept == (draw < r.mx_probability) and r.mx_n_tokens == len((r.text or "").split())
    assert mixing.mix(odd, targets).count() == odd.count()
    assert mixing.mix(docs.limit(0), targets).count() == 0


def test_raking_by_brute_force():
    """Plain proportional fitting where no cell is at its limit; cells at their limit stay whole."""
    cells = [(a, b) for a in "xy" for b in "uvw"]
    tokens = np.array([50.0, 10, 20, 5, 40, 30])
    targets = [{"x": 0.3, "y": 0.7}, {"u": 0.2, "v": 0.5, "w": 0.3}]
    got = mixing.rake(cells, tokens, targets, 20.0)
    want = tokens.copy()
    for _ in range(2000):
        for d, t in enumerate(targets):
            for k, share in t.items():
                m = np.array([c[d] == k for c in cells])
                want[m] *= share * 20 / want[m].sum()
    assert got == pytest.approx(want, rel=1e-6)
    full = mixing.rake(cells, tokens, [{"x": 0.1, "y": 0.9}, {"u": 0.3, "v": 0.4, "w": 0.3}], 80.0)
    assert (full <= tokens + 1e-9).all()
