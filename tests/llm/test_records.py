"""Reply trees, URL filters, WARC archives: exact round trips, SQL and brute force."""

import hashlib
import io
import struct

import duckdb
import pytest
import zstandard
from pyspark.sql import functions as F

from typica.llm import oracles, reply_trees, url_filter, warc
from typica.llm.common import scratch_path

NASTY = ["", "\\", "\\\\", "<|im_start|>", "<\\|im_start|>", "a\\:b\n", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\n", "é漢🙂\\", "\\<", "<<SYS>>\\\\n", None]


def by_sql(name, df, sql):
    con = duckdb.connect()
    con.register(name, df.toArrow())
    return con.execute(sql).fetchall()


def test_escaping_is_reversible(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(NASTY)], "i int, t string")
    got = rows.select("t", reply_trees.escape(F.col("t")).alias("e"), reply_trees.escape_role(F.col("t")).alias("r"))
    got = got.select("*", reply_trees.unescape(F.col("e")).alias("t2"), reply_trees.unescape_role(F.col("r")).alias("r2")).collect()
    for r in got:
        assert r.t2 == (r.t or "") == r.r2 and "\n" not in r.r
        assert not any(c in r.e for c in reply_trees.CONTROLS)


def conversations(spark):
    rows = [(k, t, "user" if t % 2 == 0 else "assistant", NASTY[(k + t) % len(NASTY)]) for k in range(12) for t in range(k)]
    rows += [(20, 0, None, "x"), (20, 1, "assistant", None), (21, 5, "user", "gap"), (21, 9, "assistant", "later"), (22, 0, "user", "tie"), (22, 0, "assistant", "tie"), (23, 0, "a\nb", "odd role")]
    rows += [(30, t, "assistant", f"long {t}") for t in range(70)] + [(31, 0, "user", "z" * 100_000)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def formatted(conv):
    nodes = reply_trees.chains(conv)
    return reply_trees.format_paths(reply_trees.tree_paths(nodes), nodes)


def test_conversations_round_trip_and_sql(spark):
    conv = conversations(spark)
    out = formatted(conv)
    got = out.select("tree", "formatted", reply_trees.read_back(F.col("formatted")).alias("turns"), reply_trees.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    want = {}
    for r in sorted(conv.collect(), key=lambda r: (r.conv_id, r.turn, r.role or "", r.text or "")):
        want.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    assert {r.tree: [tuple(t) for t in r.turns] for r in got} == want
    assert {r.tree: r.loss for r in got} == {k: "".join(t for role, t in v if role == "assistant") for k, v in want.items()}
    sql = {r[0]: r for r in by_sql("conversations", conv, oracles.REPLY_TREES)}
    for r in got:
        said = "".join(f"{a}\n{b}\n" for a, b in want[r.tree])
        assert sql[r.tree][1:] == (len(want[r.tree]), hashlib.sha256(said.encode()).hexdigest(), len(r.loss), hashlib.sha256(r.loss.encode()).hexdigest(), len(r.formatted))
    assert formatted(conv.limit(0)).count() == 0


def test_trees_rank_branches(spark):
    #      0 -> 1 -> 3 ; 1 -> 4 ; 0 -> 2 ; an orphan 9 ; a cycle 20 <-> 21 ; equal scores in tree 2
    nodes = [(1, 0, None, 1.0), (1, 1, 0, 2.0), (1, 3, 1, 9.0), (1, 4, 1, None), (1, 2, 0, 4.0), (1, 9, 77, 3.9), (1, 20, 21, 50.0), (1, 21, 20, 50.0), (2, 0, None, 1.0), (2, 1, 0, 1.0), (2, 2, 0, 1.0)]
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, score double")
    every = reply_trees.tree_paths(df, top=None)
    paths = {}
    for r in every.orderBy("depth").collect():
        paths.setdefault((r.tree, r.rank, r.leaf), []).append(r.node)
    assert paths == {(1, 1, 3): [0, 1, 3], (1, 2, 9): [9], (1, 3, 2): [0, 2], (1, 4, 4): [0, 1, 4], (2, 1, 1): [0, 1], (2, 2, 2): [0, 2]}
    best = reply_trees.tree_paths(df).collect()
    assert {(r.tree, r.leaf) for r in best} == {(1, 3), (2, 1)}
    assert {r.leaf for r in reply_trees.tree_paths(df, by="sum").collect()} == {3, 1}


URLS = [
    (1, "https://Shop.Example.com/en/7/x?q=1#t"), (2, "http://a.com/en/"), (3, "http://com/en/x"), (4, "http://notcom/en/x"), (5, "http://x.example.net/de/8"), (6, "http://x.example.net/de/9"),
    (7, "no scheme"), (8, None), (9, ""), (10, "ftp://h#frag"), (11, "http://cheap-pills.example.org/fr/1"), (12, "http://a://b/c"), (13, "http://spam.net/de/1"), (14, "http://a.org/es/" + "y" * 20_000),
]


def test_url_filter_by_sql(spark):
    name = lambda i: "".join(chr(97 + i * k % 26) for k in (1, 3, 7))
    many = [(100 + i, f"http://site{i % 9}.example.org/fr/{name(i)}") for i in range(60)] + [(200 + i, f"http://{w}.example.org/fr/{name(i)}") for i, w in enumerate(["casino-win", "free-bets", "casino-win", "adult-x"] * 6)]
    df = spark.createDataFrame([*URLS, *many, *many[:2]], "page_id long, url string").withColumn("score", F.lit(1)).withColumn("text", F.lit("t"))
    got = url_filter.url_filter(df)
    assert got.columns[:4] == df.columns and got.count() == df.count()
    want = sorted(by_sql("pages", df, f"SELECT page_id, host, path, rule, verdict, score FROM ({oracles.url_ratio()})"), key=str)
    rows = sorted(((r.page_id, r.uf_host, r.uf_path, r.uf_rule, r.uf_verdict, None if r.uf_score is None else round(r.uf_score, 6)) for r in got.collect()), key=str)
    assert [x[:5] for x in rows] == [x[:5] for x in want]
    assert all(a[5] == b[5] or abs(a[5] - b[5]) < 2e-6 for a, b in zip(rows, want, strict=True))
    by = {x[0]: x for x in rows}
    assert by[1][1:5] == ("shop.example.com", "/en/7/x", "example.com/en/7", "allow") and by[4][3] is None
    assert by[8][1:5] == ("", "", None, "allow") and by[12][1:3] == ("a:", "//b/c") and by[5][3] == "example.net/de/8"
    # no URL is judged by a model that has seen it: a few of either kind may be wrong
    assert sum(x[4] == "block" for k, x in by.items() if 200 <= k < 224) >= 20 and sum(x[4] == "allow" for k, x in by.items() if 100 <= k < 160) >= 55


def test_url_filter_without_examples(spark):
    df = spark.createDataFrame([(1, "http://x.example.org/fr/1")], "page_id long, url string")
    assert url_filter.url_filter(df).first().uf_verdict == "allow"
    assert url_filter.url_filter(df.limit(0)).count() == 0


def pages(spark):
    body = "<p>" + "words of a page " * 40
    rows = [(i, f"http://h/{i}", f"{body}{i % 50}</p>") for i in range(120)] + [(500, None, None), (501, "u", ""), (502, "bad\r\nurl", "é漢🙂" * 9), (None, "u", "no id"), (503, "u", "big" * 400_000), (502, "again", "é漢🙂" * 9)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(0))


@pytest.mark.parametrize("roll", [2_000, 64 << 20])
def test_archives_round_trip(spark, roll):
    df, folder = pages(spark), scratch_path(spark, "test-warc")
    manifest = warc.write_archives(df, folder, roll=roll)
    back = warc.read_archives(manifest, folder).collect()
    assert len(back) == df.count() and all(r.error is None for r in back)
    texts, largest = {}, {}
    for r in df.collect():
        h = (r.html or "").encode()
        texts.setdefault(r.page_id, h)
        if r.page_id is not None:
            largest[h] = max(largest.get(h, r.page_id), r.page_id)
    for r in back:
        own = r.record_id.removeprefix("urn:page:")
        h = texts[int(own) if own else None]
        assert (r.payload_bytes, r.payload_digest) == (len(h), warc.digest(h))
        if r.record_type == "response":
            assert bytes(r.payload) == h and r.refers_to is None and (not own or int(own) == largest[h])
        else:
            assert r.payload is None and r.refers_to == f"urn:page:{largest[h]}" and int(own) < largest[h]
    first = (folder.removeprefix("file://")) + "/" + manifest.first().archive
    with open(first, "rb") as f:
        assert struct.unpack("<I", f.read(4))[0] == warc.SKIPPABLE
    assert warc.write_archives(df.limit(0), folder).count() == 0


def archive(*records, dictionary=b""):
    out = b""
    kw = {}
    if dictionary:
        out += struct.pack("<II", warc.SKIPPABLE, len(dictionary)) + dictionary
        kw["dict_data"] = zstandard.ZstdCompressionDict(dictionary)
    pack = zstandard.ZstdCompressor(write_checksum=True, **kw)
    return out + b"".join(pack.compress(r) for r in records)


def test_reader_validates():
    good = warc.record("response", "urn:1", "http://x", b"body", warc.digest(b"body"), None)
    read = lambda data: [x for _, x in warc.read_archive(io.BytesIO(data))]
    assert read(archive(good))[0]["payload"] == b"body"
    assert "block of" in read(archive(good.replace(b"Content-Length: 4", b"Content-Length: 5")))[0]["error"]
    assert "digest" in read(archive(good.replace(b"body\r\n\r\n", b"bodY\r\n\r\n")))[0]["error"]
    assert "version" in read(archive(good.replace(b"WARC/1.1", b"HTTP/1.1")))[0]["error"]
    assert "without" in read(archive(good.replace(b"WARC-Date", b"X-Date")))[0]["error"]
    assert "block of" in read(archive(good + good))[0]["error"]  # two records in a frame
    assert [("error" in x) for x in read(archive(good, b"junk", good))] == [False, True, False]
    assert "cut off" in read(archive(good)[:-3])[0]["error"]
    assert "magic" in read(archive(good) + b"garbage!")[1]["error"]
    broken = bytearray(archive(good))
    broken[-6] ^= 0xFF
    assert "error" in read(bytes(broken))[0]
    raw = zstandard.train_dictionary(2048, [good + bytes([i % 250]) * 50 + str(i).encode() * 20 for i in range(300)]).as_bytes()
    assert read(archive(good, dictionary=raw))[0]["payload"] == b"body"
    stream = zstandard.ZstdCompressor().compressobj()
    assert read(stream.compress(good) + stream.flush())[0]["payload"] == b"body"  # a frame without its content size
