"""The pipeline's stages on small fixtures against plain Python."""

import random
import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from typica.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, rng):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def brute_regular(rows):
    """(id, text) kept, and the text left, by counts of documents per host and line."""
    key = lambda line: re.sub("[1-9]", "0", re.sub(r"[ \t]+", " ", line.lower())).strip(" ")
    holders = {}
    for i, t, _, host, _ in rows:
        for k in {key(x) for x in (t or "").split("\n")} - {""}:
            holders.setdefault((host, k), []).append(i)
    out = []
    for i, t, _, host, _ in rows:
        w = (t or "").split()
        grams = Counter(tuple(w[a : a + 3]) for a in range(len(w) - 2))
        again = {p for a in range(len(w) - 2) if grams[tuple(w[a : a + 3])] > 1 for p in (a, a + 1, a + 2)}
        gone = lambda line: len(h := holders.get((host, key(line)), [])) > 20 and min(x for x in h if x is not None) != i  # noqa: E731, B023
        left = "\n".join(x for x in (t or "").split("\n") if not gone(x))
        if len(w) >= 50 and 2 * len(again) <= len(w) and len(left.split()) >= 0.2 * len(w):
            out.append((i, left))
    return Counter(out)


def test_frequent_lines_on_a_large_host(spark):
    """A line in 30 of 400 texts of a host is below a tenth of them; copies count as documents."""
    rng, line = random.Random(3), "Read MORE of  this on page 7"
    rows = [(i, "\n".join([words(60, rng), *([line.replace("7", str(i % 9 + 1))] if i < 30 else [])]), "en", "a", 0) for i in range(400)]
    rows += [(500 + i, "\n".join([line, words(60, rng)]), "en", "b", 0) for i in range(20)]
    rows += [(600 + i, words(70, random.Random(1)), "en", None, 0) for i in range(25)] + [(None, words(60, rng) + "\n" + line, "en", "a", 0), (700, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = corpus_pipeline.regular(spark, docs, "")
    assert Counter((r.doc_id, r.text) for r in got.collect()) == brute_regular(rows)
    assert got.where(F.col("text").contains("page")).count() == 21 and got.where("source is null").count() == 1


@pytest.mark.parametrize("text, topic", [("All CopyRight kept", "legal"), ("a LiCense", "legal"), ("LiZENz", "legal"), ("lisence", "prose"), ("a | LICENCE", "table"), (None, "prose")])
def test_legal_words_in_any_case(spark, text, topic):
    assert spark.createDataFrame([(text,)], "t string").select(mixing.topic_of(F.col("t"))).first()[0] == topic
