"""Token counts per section or field: whole documents are encoded once, and tokens are attributed by their offsets.

Tokens of a byte-level vocabulary spell the text's bytes, so the running sum of their lengths gives byte spans, and a
count of character starts turns these into character spans. The spans are joined with the sections' intervals by binary
search. A token that crosses a boundary goes, by ``rule``, to the section with most of its characters, ties to the earlier
(``largest``); to the section of its first character (``start``); or to all that it touches in proportion to the
characters (``split``, fractional counts). A token of which no section has a character counts for section -1.

Cases: null and empty texts have one empty section without tokens; very long texts and runs of one character are encoded whole; empty sections have zero; repeated rows are counted row
by row; a null id is returned as null; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typica.llm.common import bounded_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: what that pattern takes for white space.
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space from so many characters on is cut out before the pattern, which would recurse once a character.
LONG_BLANK = 10_000
OUT = "section int, name string, start bigint, stop bigint, n_tokens double, doc_tokens bigint"


#: The vocabulary that a worker decoded last, by the broadcast that it comes from: the tasks of a worker share one.
_BUILT: dict[str, Spans] = {}


def spans_of(sent) -> Spans:
    name, ranks = sent.value
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Spans(ranks)
    return _BUILT[name]


class Spans:
    """Encodes texts into token spans of characters."""

    def __init__(self, ranks: bytes):
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
        self.sizes = np.zeros(max(merges.values()) + 1, np.int64)
        for token, i in merges.items():
            self.sizes[i] = len(token)

    def tokens(self, text: str, long_blank: int = LONG_BLANK) -> list[int]:
        """The text's tokens. White space before other text is split before its last character, at a text's end not at all,
        so a long stretch of it is one piece that needs no pattern."""
        out, done = [], 0
        for m in re.finditer(f"[{BLANK}]{{{long_blank},}}", text):
            stop = m.end() - (m.end() < len(text))
            out += self.encoding.encode_ordinary(text[done : m.start()])
            if stop > m.start():
                out += self.encoding._encode_single_piece(text[m.start() : stop])
            done = stop
        return out + self.encoding.encode_ordinary(text[done:])

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Start and stop of each token; a token inside a character has that character's span."""
        stops = np.cumsum(self.sizes[np.asarray(self.tokens(text), np.int64)])
        starts = np.concatenate((np.zeros(1, np.int64), stops[:-1])) if len(stops) else stops
        raw = text.encode()
        if len(raw) != len(text):
            char = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
            starts, stops = char[starts], char[stops - 1] + 1
        return starts, stops


def attribute(starts: np.ndarray, stops: np.ndarray, sections: np.ndarray, rule: str = "largest") -> tuple[np.ndarray, float]:
    """Tokens per section, and those of none. sections: (n, 2) disjoint [start, stop), sorted; empty ones get nothing."""
    out, none = np.zeros(len(sections)), 0.0
    full = np.flatnonzero(sections[:, 1] > sections[:, 0])
    if not len(full) or not len(starts):
        return out, float(len(starts))
    lo, hi = sections[full, 0], sections[full, 1]
    first = np.searchsorted(hi, starts, "right")
    last = np.searchsorted(lo, stops, "left") - 1
    inside = (first == last) & (first < len(full))
    inside &= (lo[np.minimum(first, len(full) - 1)] <= starts) & (hi[np.minimum(first, len(full) - 1)] >= stops)
    np.add.at(out, full[first[inside]], 1.0)
    for t in np.flatnonzero(~inside):
        a, b, touched = int(starts[t]), int(stops[t]), np.arange(first[t], last[t] + 1)
        if rule == "start":
            touched = touched[(lo[touched] <= a) & (a < hi[touched])]
        if not len(touched):
            none += 1
            continue
        part = np.minimum(hi[touched], b) - np.maximum(lo[touched], a)
        if rule == "split":
            out[full[touched]] += part / (b - a)
            none += 1 - part.sum() / (b - a)
        else:
            out[full[touched[np.argmax(part)]]] += 1.0
    return out, none


def lines(text: str) -> tuple[np.ndarray, None]:
    """The lines of a text, each with its line feed, as intervals."""
    raw = np.frombuffer(text.encode(), np.uint8)
    cuts = np.flatnonzero(raw == 10) + 1
    if len(raw) != len(text):  # bytes before a cut that go on with a character are no characters of their own
        further = np.flatnonzero((raw & 0xC0) == 0x80)
        cuts = cuts - np.searchsorted(further, cuts)
    edges = np.unique(np.concatenate(([0], cuts, [len(text)])))
    edges = edges if len(edges) > 1 else np.array([0, 0])
    return np.stack((edges[:-1], edges[1:]), axis=1), None


def ranks_of(path: str) -> bytes:
    with open(path, "rb") as f:  # of the installation, on the driver; sent to the executors
        return f.read()


def section_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sections: Callable = lines, rule: str = "largest", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, section, name, start, stop, n_tokens, doc_tokens): a row per section of each document."""
    return _spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), lambda row: (row[0] or "", sections(row[0] or "")), rule, vocabulary)


def field_tokens(docs: DataFrame, fields: list[str], *, id_col: str = "doc_id", separator: str = "\n\n", rule: str = "largest", vocabulary: str = VOCABULARY) -> DataFrame:
    """The same for fields that are joined into one text by separator and encoded together; null fields are empty."""

    def joined(row):
        at, spans = 0, []
        for x in row:
            spans.append((at, at + len(x or "")))
            at += len(x or "") + len(separator)
        return separator.join(x or "" for x in row), (np.array(spans).reshape(-1, 2), fields)

    return _spread(docs.select(F.col(id_col).alias("id"), *(F.col(f).cast("string") for f in fields)), joined, rule, vocabulary)


def _spread(rows: DataFrame, text_of: Callable, rule: str, vocabulary: str) -> DataFrame:
    if rule not in ("largest", "start", "split"):
        raise ValueError(f"rule {rule!r}")
    spark = rows.sparkSession
    bounded_batches(spark, 500)
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, ranks_of(vocabulary)))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = spans_of(sent)
        for b in batches:
            at, cols = [], ([], [], [], [], [], [])
            for i, row in enumerate(zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)):
                text, (own, names) = text_of(row)
                starts, stops = spans.of(text)
                n, none = attribute(starts, stops, own, rule)
                number, name = np.arange(len(own)), list(names) if names else [None] * len(own)
                if none > 1e-9:
                    own, n, number, name = np.concatenate((own, [[-1, -1]])), np.append(n, none), np.append(number, -1), [*name, None]
                at.append(np.full(len(own), i))
                for c, x in zip(cols, (number, name, own[:, 0], own[:, 1], n, np.full(len(own), len(starts))), strict=True):
                    c.append(x)
            if at:
                ids = b.column(0).take(pa.array(np.concatenate(at)))
                number, name, start, stop, n, total = cols
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(number), pa.int32()), pa.array([x for c in name for x in c], pa.string()), *(pa.array(np.concatenate(x), k) for x, k in ((start, pa.int64()), (stop, pa.int64()), (n, pa.float64()), (total, pa.int64())))], ["id", "section", "name", "start", "stop", "n_tokens", "doc_tokens"])

    return rows.mapInArrow(run, f"id {kind}, {OUT}")
