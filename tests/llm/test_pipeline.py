"""Every stage of the pipeline against plain Python over its own input, on a table with odd rows."""

import hashlib
import random
import zlib
from collections import Counter

import corpus_pipeline
import pytest
from test_near_copies import brute_roots
from test_pipeline_stages import brute_regular
from test_text_operators import brute_contamination

from typica.llm import mixing, subword_classifier
from typica.llm.common import write_out

DOCS = "doc_id long, text string, lang string, source string, n_chars long, dc_n_hit long, qr_v string, mx_kept string, topic string, row long"
BENCH = [" ".join(f"q{i}z{k}" for i in range(30)) for k in range(4)] + ["short item here", None, ""]


def words(n, rng):
    return " ".join(f"w{rng.randrange(4000)}" for _ in range(n))


def rows():
    rng = random.Random(12)
    texts = [words(rng.randrange(60, 140), rng) for _ in range(60)]
    texts += [t.replace("w1", "w2", 2) for t in texts[:8]] + texts[:6]
    texts += [words(60, rng) + " " + BENCH[k % 4] for k in range(6)] + [words(900, rng) + " " + BENCH[0]]
    texts += [words(80, rng) + "\nREAD more of this on page " + str(k % 9 + 1) for k in range(25)]
    texts += [" ".join(w + "***" for w in words(70, rng).split()) for _ in range(30)]
    texts += [None, "", " \n", "few words", "a b c " * 40, words(20_000, rng)]
    table = [(i, t, ["en", "de", None][i % 3], "src1" if "READ more" in (t or "") else f"src{i % 4}" if i % 11 else None, len(t or "")) for i, t in enumerate(texts)]
    table += [table[3], table[70], (3, table[5][1], "en", "src1", 0), (None, table[9][1], "en", "src1", None), (None, words(90, rng), None, None, None)]
    return [(*r, 7, "x", "y", "mine", 3) for r in table]


def brute_quality(text, weights, bias):
    """The score by loops over words and their n-grams."""
    total, n = 0.0, 0
    for w in subword_classifier.tokens(text):
        grams = [zlib.crc32(w.encode()) % subword_classifier.BUCKETS]
        if w not in (subword_classifier.LINE, subword_classifier.AGAIN):
            padded = f"<{w}>"
            for g in subword_classifier.GRAMS:
                for i in range(len(padded) - g + 1):
                    h = g
                    for c in padded[i : i + g]:
                        h = (h * 0x01000193 + ord(c)) % 2**32
                    h ^= h >> 15
                    h = h * 0x2C1B3C6D % 2**32
                    grams.append((h ^ h >> 13) % subword_classifier.BUCKETS)
        total, n = total + sum(weights[g] for g in grams), n + len(grams)
    return 1 / (1 + 2.718281828459045 ** -(bias + (total / n if n else 0.0)))


def brute_mix(docs):
    """(row, probability) drawn: cells filled up in turn until every margin has its share, then a hash."""
    token = {i: len((r.text or "").split()) for i, r in enumerate(docs)}
    topic = [mixing_topic(r.text or "") for r in docs]
    dims = [("lang", [r.lang for r in docs]), ("source", [r.source for r in docs]), ("topic", topic)]
    pooled = [[v if v in mixing.TARGETS[d] else mixing.OTHER for v in vs] for d, vs in dims]
    cells = {}
    for i in token:
        key = tuple(p[i] for p in pooled)
        cells[key] = cells.get(key, 0) + token[i]
    cells = {k: n for k, n in cells.items() if n}
    total = sum(cells.values())
    goals = []
    for d, (name, _) in enumerate(dims):
        seen = Counter()
        for k, n in cells.items():
            seen[k[d]] += n / total
        target, rest = mixing.TARGETS[name], seen.get(mixing.OTHER, 0.0)
        known = sum(target[v] for v in seen if v in target)
        goals.append({v: (target[v] / known * (1 - rest) if v in target and known else seen[v]) for v in seen})
    fit = {k: n / 2 for k, n in cells.items()}
    for _ in range(500):
        for d, goal in enumerate(goals):
            for v, share in goal.items():
                mine, want = [k for k in fit if k[d] == v], share * total / 2
                full = set()
                while True:
                    free = [k for k in mine if k not in full]
                    left = want - sum(cells[k] for k in full)
                    held = sum(fit[k] for k in free)
                    over = [k for k in free if fit[k] * left / held > cells[k]] if held else []
                    if not over:
                        break
                    full |= set(over)
                for k in mine:
                    fit[k] = cells[k] if k in full or want >= sum(cells[x] for x in mine) else fit[k] * left / held
    out = []
    for i, r in enumerate(docs):
        key = tuple(p[i] for p in pooled)
        q = fit[key] / cells[key] if key in cells else 1.0
        named = ":".join(x for x in ("17", None if r.doc_id is None else str(r.doc_id), r.text) if x is not None)
        if int(hashlib.md5(named.encode()).hexdigest()[:12], 16) / 16**12 < q:
            out.append((r.doc_id, r.text, topic[i], token[i], round(q, 5)))
    return Counter(out)


def mixing_topic(text):
    low = "".join(c.lower() if c.isascii() else c for c in text)
    if " | " in text:
        return "table"
    if "licen" in low or "copyright" in low or "lizenz" in low:
        return "legal"
    return "numbers" if any(text[i : i + 3].isdigit() and text[i : i + 3].isascii() for i in range(len(text) - 2)) else "prose"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    table = rows()
    spark.createDataFrame(table, DOCS).coalesce(3).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], int("***" not in (r[1] or ""))) for r in table if r[0] is not None and r[0] % 2 == 0] + [(None, 1), (5, None)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(BENCH)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = write_out(stage(spark, docs, tables), f"test-stage{k}")
        before, after = docs.collect(), out.collect()
        seen.append(len(after))
        if k < 4:
            assert out.columns == columns
            assert {r.row for r in after} == {3} and {r.mx_kept for r in after} == {"y"}
        got = Counter((r.doc_id, r.text) for r in after)
        if k == 0:
            model = subword_classifier.fit(docs, spark.read.parquet(f"{tables}/labels.parquet"), train_rows=subword_classifier.fold("doc_id", 4) != 2)
            assert got == Counter((r.doc_id, r.text) for r in before if brute_quality(r.text, *model) >= 0.7)
            assert all("***" not in (r.text or "") for r in after) and sum("***" not in (r.text or "") for r in before) - len(after) <= 5
        elif k == 1:
            assert got == brute_regular([(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in before])
            assert sum("page" in r.text for r in after) < sum("page" in (r.text or "") for r in before)
        elif k == 2:
            groups = {}
            for root, r in zip(brute_roots([r.text for r in before]), before, strict=True):
                groups.setdefault(root, []).append(r)
            firsts = [min((r.doc_id for r in g if r.doc_id is not None), default=None) for g in groups.values()]
            assert Counter(r.doc_id for r in after) == Counter(firsts) and len(after) < len(before)
            assert got <= Counter((r.doc_id, r.text) for r in before)
        elif k == 3:
            assert got == Counter((r.doc_id, r.text) for r in before if not brute_contamination(r.text, BENCH)[4])
            assert 0 < len(before) - len(after) < 12
        else:
            assert Counter((r.doc_id, r.text, r.topic, r.n_tokens, round(r.probability, 5)) for r in after) == brute_mix(before)
        docs = out
    assert seen == sorted(seen, reverse=True)
    assert Counter(corpus_pipeline.run(spark, tables).collect()) == Counter(docs.collect())


def test_stages_of_an_empty_table(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables).count() == 0


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
