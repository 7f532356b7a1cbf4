"""Cross-document line frequency and per-document quality rules, in DataFrame expressions only.

A line is normalised (lower-cased, digits to 0, white space collapsed) and hashed to 128 bits. For each host the documents
with the line are counted, each once; a line in more than ``max_docs`` of them is frequent and removed from all documents of
the host, and a document of which less than ``min_left`` of the words remain is depleted. Options, off by default: exact
copies of a text count once (``copies_once``), the document with the smallest id keeps its lines (``keep_first``), and lines
must be in more than a share of the host's documents as well (``max_share``).

Lines are counted and looked up as (host, text hashes, place, line hash), never with texts. What comes back to a document is
the list of its own frequent lines' places: by the text's hashes if the lists are few enough to be broadcast, else by row
number, so a host or a text with very many rows is no key that texts meet on.

Cases: null or blank text has no words and fails the base rule; a null host is a host of its own; repeated rows are
documents like any other, judged alike, and each is returned; with ``keep_first`` ties for the smallest id all keep their
lines; an empty table gives no rows; further columns stay, but those with the name of an added one are replaced (added ones
start with ``prefix``); ``kept_documents`` returns all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typica.llm.common import SPACES, discard, free_prefix, let, unclashed, words_of, write_out

SYMBOLS = "#*$%&|<>"
#: Rows, and entries of lists, up to which tables are broadcast: some 50 bytes each.
BROADCAST_ROWS = 100_000
#: Lists of places, and places in them, up to which they are broadcast: some 50 bytes a list and 16 a place.
BROADCAST_ENTRIES = 1_000_000


def repeated_words(words: Column) -> Column:
    """How many words stand in a 3-word window that the text has twice or more."""

    def windows(w: Column) -> Column:
        ends = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
        return F.transform(ends, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(at: Column) -> Column:
        """Union of [p, p + 3) over the sorted positions."""
        steps = F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

    def in_runs(s: Column) -> Column:
        """Positions of the sorted (hash, position) pairs whose neighbour has the same hash."""
        same = F.filter(s, lambda e, i: (e["h"] == F.get(s, i - 1)["h"]) | (e["h"] == F.get(s, i + 1)["h"]))
        return F.sort_array(F.transform(same, lambda e: e["p"]))

    def positions(h: Column) -> Column:
        """Where the windows stand that occur again: by a look into the repeated hashes if they are few, else by a sort of all."""
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        again = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1))))
        look = lambda d: F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(d, x), i)), lambda i: i.isNotNull())
        return let(again, lambda d: F.when(F.size(d) <= 12, look(d)).otherwise(let(pairs, in_runs)))

    def slow(h: Column) -> Column:
        return let(positions(h), covered)

    return let(let(words, windows), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(slow(h)))


def base_columns(text: Column) -> dict[str, Column]:
    """The counts of a text besides its words."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return {
        "n_symbols": F.when(t.rlike("[#*$%&|<>]"), F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).otherwise(0).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def line_key(line: Column) -> Column:
    """128 bits of a normalised line; null for one without words."""
    return let(F.btrim(line), lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(1)).alias("b"))))


def line_keys(text: Column) -> Column:
    """Per line of the text, in order: its key."""
    one = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\x0B\f\r]{2,}|[\t\x0B\f\r]", " ")
    return F.transform(F.split(F.regexp_replace(one, "[1-9]", "0"), "\n"), line_key)


KEY = ("host", "t1", "t2")
#: Lines of eight invented words each, none twice, to plant as boilerplate.
BOILERPLATE = [" ".join(f"{chr(97 + k)}{chr(97 + j)}x" for j in range(8)) for k in range(8)]


def text_key(text_col: str, host_col: str) -> list[Column]:
    """host, t1, t2: what a text's list of frequent lines is found by."""
    whole = F.coalesce(F.col(text_col), F.lit(""))
    return [F.col(host_col).alias("host"), F.xxhash64(whole).alias("t1"), F.xxhash64(whole, F.lit(1)).alias("t2")]


def joined_by(left: DataFrame, right: DataFrame, on: list[str], weight: str) -> DataFrame:
    """left and right's rows of equal keys (nulls too); a key is one row of right and has about weight rows of left.

    A small right side is broadcast. Of a large one only the keys with most rows of left are, at most BROADCAST_ROWS; the
    others have few rows each and meet in a shuffle.
    """
    other = [c for c in right.columns if c not in on]
    total, n = right.agg(F.coalesce(F.sum(weight), F.lit(0)), F.count(F.lit(1))).first()
    keys = lambda r: r.select(*(F.col(c).alias(f"r_{c}") for c in on), *other)
    same = lambda: [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in on]
    out = lambda d: d.select(*left.columns, *other)
    if n <= BROADCAST_ROWS:
        return out(left.join(F.broadcast(keys(right)), same()))
    heavy = F.col(weight) > total / BROADCAST_ROWS  # of these there are fewer than BROADCAST_ROWS
    hot = F.broadcast(keys(right.where(heavy)))
    return out(left.join(hot, same())).unionByName(out(left.join(hot, same(), "left_anti").join(keys(right.where(~heavy)), same())))


def frequent_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = 20, max_share: float | None = None, copies_once: bool = False) -> tuple[DataFrame, DataFrame]:
    """(lines, frequent). lines: host, t1, t2, place, a, b for each line with words of each text of a host, with n, the rows
    of the text. frequent: host, a, b, n_docs, first_id, n_texts of the lines above the limits."""
    each = docs.select(*text_key(text_col, host_col), F.col(id_col).alias("id"), F.posexplode(line_keys(F.col(text_col))).alias("place", "k")).where("k is not null")
    lines = write_out(each.groupBy(*KEY, "place", F.col("k.a").alias("a"), F.col("k.b").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")), "lines")
    once = lines.groupBy(*KEY, "a", "b").agg(F.first("n").alias("n"), F.min("id").alias("id"))  # a line that a text repeats counts once
    counts = once.groupBy("host", "a", "b").agg((F.count(F.lit(1)) if copies_once else F.sum("n")).alias("n_docs"), F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_texts")).where(F.col("n_docs") > max_docs)
    if max_share is not None:
        sizes = docs.groupBy(F.col(host_col).alias("own")).agg((F.count_distinct(F.coalesce(F.col(text_col), F.lit(""))) if copies_once else F.count(F.lit(1))).alias("size"))
        counts = counts.join(sizes, F.col("host").eqNullSafe(F.col("own"))).where(F.col("n_docs") > max_share * F.col("size")).drop("own", "size")
    return lines, write_out(counts, "frequent-lines")


def _with_places(docs: DataFrame, id_col: str, text_col: str, host_col: str, p: str, keep_first: bool, **limits) -> DataFrame:
    """docs with {p}f: the places of the row's frequent lines in order, null if it has none."""
    lines, frequent = frequent_lines(docs, id_col=id_col, text_col=text_col, host_col=host_col, **limits)
    found = joined_by(lines, frequent, ["host", "a", "b"], "n_texts")
    lists = write_out(found.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("place", "first_id"))).alias("f"), F.first("n").alias("n")), "texts-with-frequent-lines")
    discard(lines, frequent)
    n, entries, total = lists.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("f")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    listed = lambda d, q: d.select(*(F.col(c).alias(f"{q}{c}") for c in KEY), F.col("f").alias(f"{q}f"))
    key = text_key(text_col, host_col)
    same = lambda k, q: [a.eqNullSafe(F.col(f"{q}{c}")) for a, c in zip(k, KEY, strict=True)]
    if max(n, entries) <= BROADCAST_ENTRIES:
        out = docs.join(F.broadcast(listed(lists, p)), same(key, p), "left")
    else:
        # texts that many rows have are broadcast with their lists; their rows go anywhere in the shuffle of the others
        heavy = F.col("n") > total / BROADCAST_ROWS
        own = docs.join(F.broadcast(listed(lists.where(heavy), f"{p}h_")), same(key, f"{p}h_"), "left")
        t1 = F.when(F.col(f"{p}h_f").isNull(), key[1]).otherwise(F.xxhash64(F.col(id_col), key[2]))
        rest = listed(lists.where(~heavy), f"{p}r_")
        out = own.join(rest, [F.col(f"{p}h_f").isNull(), *same([key[0], t1, key[2]], f"{p}r_")], "left").withColumn(f"{p}f", F.coalesce(f"{p}h_f", f"{p}r_f"))
    mine = F.filter(f"{p}f", lambda f: ~f["first_id"].eqNullSafe(F.col(id_col))) if keep_first else F.col(f"{p}f")
    places = F.transform(mine, lambda f: f["place"])
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), F.when(F.size(places) > 0, places).alias(f"{p}f"))


def without_lines(text: Column, places: Column) -> Column:
    """text without the lines at these places, which are in order: the stretches between them, joined."""

    def cut(lines: Column) -> Column:
        stretch = lambda stop, j: F.slice(lines, F.coalesce(F.get(places, j - 1), F.lit(-1)) + 2, stop - F.coalesce(F.get(places, j - 1), F.lit(-1)) - 1)
        return F.array_join(F.flatten(F.transform(F.concat(places, F.array(F.size(lines))), stretch)), "\n")

    return let(F.split(text, "\n"), cut)


def _judged(docs: DataFrame, id_col: str, text_col: str, host_col: str, p: str, min_left: float, min_words: int, **limits) -> DataFrame:
    """docs with {p}v, all verdicts of a row as one struct, and {p}at, which keeps filters from being worked out below it."""
    text, places = F.col(text_col), F.col(f"{p}f")

    def verdict(clean: Column, n: Column, repeated: Column, chars: Column) -> Column:
        failed = (n < min_words) | (100 * repeated > 50 * n)
        rest = F.when(clean["lines"] > 0, F.size(words_of(clean["text"]))).otherwise(n)
        fields = {"n_words": n.cast("long"), "word_chars": chars.cast("long"), **base_columns(text), "n_repeat_words": repeated.cast("long"), "base_failed": failed, "n_removed_lines": clean["lines"].cast("long"), "words_left": rest.cast("long"), "clean_text": clean["text"]}
        return let(F.struct(*(c.alias(k) for k, c in fields.items())), lambda s: F.struct(*(s[k].alias(k) for k in fields), (~s["base_failed"] & (s["words_left"] >= min_left * s["n_words"])).alias("kept")))

    by_words = lambda clean: let(words_of(text), lambda w: let(repeated_words(w), lambda r: verdict(clean, F.size(w), r, F.length(F.array_join(w, "")))))
    clean = F.when(places.isNull(), F.struct(text.alias("text"), F.lit(0).alias("lines"))).otherwise(F.struct(without_lines(text, places).alias("text"), F.size(places).alias("lines")))
    rows = _with_places(docs, id_col, text_col, host_col, p, **limits)
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns), let(clean, by_words).alias(f"{p}v"), F.monotonically_increasing_id().alias(f"{p}at"))


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", prefix: str = "qr_", max_docs: int = 20, max_share: float | None = None, copies_once: bool = False, keep_first: bool = False, min_left: float = 0.2, min_words: int = 50) -> DataFrame:
    """docs with columns {prefix}n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_lines, words_left, clean_text, kept."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_lines", "words_left", "clean_text", "kept")
    docs = unclashed(docs, *(f"{prefix}{n}" for n in names))
    p = free_prefix(docs.columns, "qr_")
    v = _judged(docs, id_col, text_col, host_col, p, min_left, min_words, keep_first=keep_first, max_docs=max_docs, max_share=max_share, copies_once=copies_once)
    return v.select(*(F.col(f"`{c}`") for c in docs.columns), *(F.col(f"{p}v.{n}").alias(f"{prefix}{n}") for n in names))


def kept_documents(docs: DataFrame, *, max_docs: int = 20, keep_first: bool = True, min_left: float = 0.2, min_words: int = 50) -> DataFrame:
    """The documents that pass, without their frequent lines; text and n_chars follow, other columns stay. The first
    document of a line keeps it, so that no text is lost with all of its copies."""
    p = free_prefix(docs.columns, "qr_")
    v = _judged(docs, "doc_id", "text", "source", p, min_left, min_words, keep_first=keep_first, max_docs=max_docs).where(F.col(f"{p}v.kept") & (F.col(f"{p}at") >= 0))
    now = {"text": F.col(f"{p}v.clean_text")}
    if "n_chars" in docs.columns:
        now["n_chars"] = F.when(F.col(f"{p}v.n_removed_lines") == 0, F.col("n_chars")).otherwise(F.length(f"{p}v.clean_text").cast(docs.schema["n_chars"].dataType))
    return v.select(*(now[c].alias(c) if c in now else F.col(f"`{c}`") for c in docs.columns))
