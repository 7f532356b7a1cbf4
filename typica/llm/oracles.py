"""SQL for those training-data queries that SQL expresses, built from the operators' own parameters."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import reduce

from typica.llm.quality_rules import BOILERPLATE
from typica.llm.reply_trees import CONTROLS, END, START
from typica.llm.url_filter import ALPHABET, RULES, SEED_WORDS

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"
HAS_WORD = r"regexp_matches({}, '[^ \t\n\x0B\f\r]')"

def line_frequency(documents: str = "documents") -> str:
    """Lines in more than 20 documents of a host, counted once a document, are removed from all of them."""
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, {WORDS} AS w, string_split(coalesce(text, ''), chr(10)) AS raw,
  string_split(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[ \t\x0B\f\r]{{2,}}|[\t\x0B\f\r]', ' ', 'g'), '[1-9]', '0', 'g'), chr(10)) AS ls FROM {documents}),
win AS (SELECT rid, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
again AS (SELECT rid, g FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT win.rid, unnest([i, i + 1, i + 2]) AS p FROM win JOIN again USING (rid, g)) GROUP BY rid),
dup AS (SELECT rid, len(x) - len(list_distinct(x)) AS n FROM (SELECT rid, list_filter(raw, lambda l: {HAS_WORD.format('l')}) AS x FROM d)),
lines AS (SELECT rid, doc_id, source, text, i, trim(ls[i]) AS l, raw[i] AS r FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM d)),
hot AS (SELECT source, l FROM lines WHERE l <> '' GROUP BY ALL HAVING count(DISTINCT rid) > 20),
gone AS (SELECT rid, count(*) AS n, sum(len(list_filter(string_split_regex(r, '[ \t\n\x0B\f\r]+'), lambda w: w <> ''))) AS words FROM lines JOIN hot ON lines.source IS NOT DISTINCT FROM hot.source AND lines.l = hot.l GROUP BY rid),
b AS (SELECT d.rid, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, dup.n::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_lines, (len(w) - coalesce(gone.words, 0))::BIGINT AS words_left
  FROM d JOIN dup ON d.rid = dup.rid LEFT JOIN rep ON d.rid = rep.rid LEFT JOIN gone ON d.rid = gone.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND words_left >= 0.2 * n_words AS kept, n_removed_lines, words_left FROM b"""


LINE_FREQUENCY = line_frequency()
_EVEN = f"CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') || chr(10) || '{BOILERPLATE[0]}' ELSE text END"
_PAGE = " || ".join(f"'{x}' || chr(10)" for x in BOILERPLATE) + " || lang || ' ' || source"
#: Every second document with a line of boilerplate at its end, and as many pages of nothing but boilerplate as documents.
PLANTED = f"(SELECT doc_id, {_EVEN} AS text, source FROM documents UNION ALL SELECT -1 - doc_id, {_PAGE}, source FROM documents)"


def _escaped(c: str) -> str:
    doubled = f"replace({c}, '\\', '\\\\')"
    return reduce(lambda t, x: f"replace({t}, '{x}', '{x[0]}\\{x[1:]}')", CONTROLS, doubled)


REPLY_TREES = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) x(i, r))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum({len(START)} + length(replace({_escaped('role')}, chr(10), '\\:')) + 1 + length({_escaped('text')}) + {len(END) + 1})::BIGINT AS formatted_chars FROM t GROUP BY conv_id"""


#: The same turns as trees with branches: the reply to turn k (from 1) is said to be to turn k / 2, and scores are lengths.
BRANCHING_TREES = f"""WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
up AS (SELECT conv_id, k AS leaf, k, length(text) AS s FROM t l WHERE NOT EXISTS (FROM t c WHERE c.conv_id = l.conv_id AND c.k // 2 = l.k) UNION ALL SELECT up.conv_id, leaf, t.k, length(t.text) FROM up JOIN t ON t.conv_id = up.conv_id AND t.k = up.k // 2),
p AS (SELECT conv_id, leaf, avg(s) AS score, count(*) AS n FROM up GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, leaf) AS rank FROM p)
SELECT r.conv_id, r.leaf, r.rank, r.n AS n_turns, round(r.score, 6) AS path_score, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY t.k)) AS turns_sha256
FROM r JOIN up USING (conv_id, leaf) JOIN t ON t.conv_id = up.conv_id AND t.k = up.k WHERE rank <= 2 GROUP BY ALL"""


def _url_rule() -> tuple[str, str]:
    rule, verdict = "NULL", "NULL"
    for v, h, p in sorted(RULES, key=lambda r: len(r[1]) + len(r[2])):
        fits = f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
        rule, verdict = f"CASE WHEN {fits} THEN '{h}{p}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{v}' ELSE {verdict} END"
    return rule, verdict


def _url_orders() -> str:
    """The smoothed models of accepted (a) and rejected (r) examples of the folds 0 and 1, order by order."""
    out, kinds = [], ("a0", "r0", "a1", "r1")
    each = lambda f: ", ".join(f(x) for x in kinds)
    for k in range(1, 5):
        low = {x: f"below{k - 1}.p{x}" if k > 1 else f"(1.0::DOUBLE / {len(ALPHABET)})" for x in kinds}
        join = f"JOIN below{k - 1} ON right(own{k}.g, {k - 1}) = below{k - 1}.g" if k > 1 else ""
        p = lambda x: f"CASE WHEN n{x} + t{x} > 0 THEN ({x} + t{x} * {low[x]}) / (n{x} + t{x})::DOUBLE ELSE {low[x]} END AS p{x}"  # noqa: E731, B023
        out += [
            f"own{k} AS (SELECT right(g, {k}) AS g, {each(lambda x: f'sum({x}) AS {x}')} FROM grams GROUP BY 1)",
            f"ctx{k} AS (SELECT left(g, {k - 1}) AS c, {each(lambda x: f'sum({x}) AS n{x}, count(*) FILTER ({x} > 0) AS t{x}')} FROM own{k} GROUP BY 1)",
            f"below{k} AS (SELECT own{k}.g, {each(p)} FROM own{k} JOIN ctx{k} ON left(own{k}.g, {k - 1}) = ctx{k}.c {join})",
        ]
    return ",\n".join(out)


def url_ratio() -> str:
    rule, verdict = _url_rule()
    after = "CASE WHEN position('://' IN u) > 0 THEN substr(u, position('://' IN u) + 3) ELSE {} END"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    count = lambda x, f: f"coalesce(sum(n) FILTER (example = '{x}' AND fold = {f}), 0) AS {x[0]}{f}"
    return rf"""WITH p0 AS (SELECT page_id, coalesce(url, '') AS u FROM pages), p1 AS (SELECT page_id, {after.format("''")} AS a, {after.format('u')} AS f FROM p0),
p2 AS (SELECT page_id, translate(regexp_extract(a, '^([^/?#]*)', 1), '{upper}', '{lower}') AS host, regexp_extract(a, '^[^/?#]*([^?#]*)', 1) AS path, regexp_replace(translate(f, '{upper}123456789', '{lower}000000000'), '[^a-z0.\-/_?=&#%~+:]', '*', 'g') AS plain FROM p1),
p3 AS (SELECT page_id, host, path, {rule} AS rule, {verdict} AS said, CASE WHEN plain <> '' THEN '^^^' || plain || '$' END AS t FROM p2),
p4 AS (SELECT *, CASE WHEN said IS NULL THEN CASE WHEN regexp_matches(host, '(^|[.\-])({'|'.join(SEED_WORDS)})([.\-:]|$)') THEN 'rej' ELSE 'acc' END END AS example FROM p3),
texts AS (SELECT t, example, CASE WHEN right(md5(t), 1) < '8' THEN 0 ELSE 1 END AS fold, count(*) AS n FROM p4 WHERE t IS NOT NULL GROUP BY ALL), each AS (SELECT t, example, fold, n, substr(t, i, 4) AS g FROM (SELECT *, unnest(range(1, length(t) - 2)) AS i FROM texts)),
grams AS (SELECT g, {count('acc', 0)}, {count('rej', 0)}, {count('acc', 1)}, {count('rej', 1)} FROM each GROUP BY g),
{_url_orders()},
scores AS (SELECT t, example, fold, any_value(n) AS n, avg(CASE WHEN fold = 0 THEN ln(pr1) - ln(pa1) ELSE ln(pr0) - ln(pa0) END) AS score FROM each JOIN below4 USING (g) GROUP BY t, example, fold),
bins AS (SELECT floor(greatest(-10, least(10, score)) * 100)::BIGINT AS bin, coalesce(sum(n) FILTER (example = 'rej'), 0) AS r, coalesce(sum(n) FILTER (example = 'acc'), 0) AS a FROM scores WHERE example IS NOT NULL GROUP BY 1),
up AS (SELECT bin, round(sum(r) OVER w / sum(r) OVER ()::DOUBLE - sum(a) OVER w / sum(a) OVER ()::DOUBLE, 9) AS gain, coalesce(lead(bin) OVER w, bin - 1) AS under FROM bins WINDOW w AS (ORDER BY bin DESC)),
bound AS (SELECT CASE WHEN (SELECT count(*) FROM (SELECT DISTINCT fold, example FROM scores WHERE example IS NOT NULL)) = 4 THEN (max(bin) + arg_max(under, bin) + 1) / 200.0::DOUBLE END AS bound FROM up WHERE gain = (SELECT max(gain) FROM up)),
best AS (SELECT t, max(score) AS score FROM scores GROUP BY t)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN score > bound THEN 'block' ELSE 'allow' END) AS verdict, round(score, 6) AS score FROM p4 LEFT JOIN best USING (t), bound"""


ZSTD_WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s, max(page_id) OVER (PARTITION BY sha1(h)) AS first FROM p),
b AS (SELECT *, unhex(s)::BIT::VARCHAR AS bits FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT) + 1, 1)), '') AS payload_digest,
CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < first THEN first END AS refers_to FROM b"""

BENCH_WORDS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"

WU_MANBER = f"""WITH iw AS (SELECT item_id, {BENCH_WORDS.format('text')} AS w FROM benchmark), win AS (SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM iw WHERE len(w) > 0)),
dw AS (SELECT row_number() OVER () AS rid, doc_id, {BENCH_WORDS.format('text')} AS w FROM documents),
occ AS (SELECT rid, m, i, array_to_string(w[i : i + m - 1], ' ') AS g FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)),
found AS (SELECT rid, i, occ.m, item_id FROM occ JOIN win ON occ.m = win.m AND occ.g = win.g),
hits AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM found) GROUP BY rid),
items AS (SELECT rid, count(*) AS n, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM found) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hits.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AND 20 * coalesce(hits.n, 0) >= len(w) AS contaminated FROM dw LEFT JOIN hits ON dw.rid = hits.rid LEFT JOIN items ON dw.rid = items.rid"""


#: The primes of XXH64.
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
WRAP = f"{2**64}::UHUGEINT"


def _let(value: str, body: Callable[[str], str], names: Iterator[int] = itertools.count()) -> str:  # noqa: B008
    name = f"x{next(names)}"
    return f"list_transform([{value}], lambda {name}: {body(name)})[1]"


def _add(a: str, b: str) -> str:
    return f"((({a})::UHUGEINT + ({b})::UHUGEINT) % {WRAP})::UBIGINT"


def _times(a: str, prime: int) -> str:
    return f"(({a})::UHUGEINT * {PRIMES[prime - 1]}::UHUGEINT % {WRAP})::UBIGINT"


def _turned(a: str, bits: int) -> str:
    return _let(a, lambda v: f"((({v})::UHUGEINT * {2**bits}::UHUGEINT % {WRAP}) + ({v})::UHUGEINT // {2 ** (64 - bits)}::UHUGEINT)::UBIGINT")


def _round(a: str, b: str) -> str:
    return _times(_turned(_add(a, _times(b, 2)), 31), 1)


def _number(text: str, at: str, size: int) -> str:
    """The little-endian number of size bytes at a place of a text of hexadecimal digits."""
    return "('0x' || " + " || ".join(f"substr({text}, 2 * ({at} + {size - 1 - i}) + 1, 2)" for i in range(size)) + ")::UBIGINT"


def _over(first: str, parts: str, step: str) -> str:
    return f"list_reduce(list_prepend({first}, {parts}), lambda a, b: {step})"


def xxh64(h: str, seed: int = 42) -> str:
    """XXH64 of the bytes that h spells in hexadecimal digits, as its definition goes: stripes of 32 bytes, words of 8 and of
    4, bytes, and the final mixing."""
    size = f"(length({h}) // 2)"
    whole, rest = f"({size} // 32 * 32)", f"({size} % 32)"
    p1, p2, p3, p4, p5 = PRIMES
    lanes = [_over(f"{v % 2**64}::UBIGINT", f"list_transform(range({size} // 32), lambda j: {_number(h, f'(32 * j + {8 * k})', 8)})", _round("a", "b")) for k, v in enumerate((seed + p1 + p2, seed + p2, seed, seed - p1))]

    def joined(v: str) -> str:
        start = _add(_add(_turned(f"{v}[1]", 1), _turned(f"{v}[2]", 7)), _add(_turned(f"{v}[3]", 12), _turned(f"{v}[4]", 18)))
        return _over(start, v, _add(_times(f"xor(a, {_round('0::UBIGINT', 'b')})", 1), f"{p4}::UBIGINT"))

    out = _add(f"CASE WHEN {size} >= 32 THEN {_let('[' + ', '.join(lanes) + ']', joined)} ELSE {(seed + p5) % 2**64}::UBIGINT END", f"{size}::UBIGINT")
    out = _over(out, f"list_transform(range({rest} // 8), lambda j: {_number(h, f'({whole} + 8 * j)', 8)})", _add(_times(_turned(f"xor(a, {_round('0::UBIGINT', 'b')})", 27), 1), f"{p4}::UBIGINT"))
    out = _over(out, f"list_transform(range({rest} % 8 // 4), lambda j: {_number(h, f'({whole} + {rest} // 8 * 8)', 4)})", _add(_times(_turned(f"xor(a, {_times('b', 1)})", 23), 2), f"{p3}::UBIGINT"))
    out = _over(out, f"list_transform(range({rest} % 4), lambda j: {_number(h, f'({whole} + {rest} // 4 * 4 + j)', 1)})", _times(_turned(f"xor(a, {_times('b', 5)})", 11), 1))
    for shift, prime in ((33, 2), (29, 3)):
        out = _let(out, lambda v, shift=shift, prime=prime: _times(f"xor({v}, {v} >> {shift})", prime))
    return _let(out, lambda v: f"xor({v}, {v} >> 32)")


def simhash_groups() -> str:
    """Fingerprints bit by bit, links from all pairs of different fingerprints, groups by what they reach."""
    words = WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    bits = " + ".join(f"CASE WHEN 2 * sum(((x >> {b}) & 1)::BIGINT) > count(*) THEN {2**b}::UHUGEINT ELSE 0::UHUGEINT END" for b in range(64))
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
sh AS (SELECT rid, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT rid, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM d WHERE len(w) > 0)),
u AS (SELECT s, {xxh64('h')} AS x FROM (SELECT s, hex(encode(s)) AS h FROM (SELECT DISTINCT s FROM sh))), f AS (SELECT rid, ({bits})::UBIGINT AS fp FROM sh JOIN u USING (s) GROUP BY rid),
p AS (SELECT doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM d LEFT JOIN f USING (rid)), n AS (SELECT fp, min(doc_id) AS least FROM p GROUP BY fp),
e AS (SELECT a.fp AS a, b.fp AS b FROM n a, n b WHERE bit_count(xor(a.fp, b.fp)::HUGEINT) <= 3), r AS (SELECT fp, fp AS other FROM n UNION SELECT r.fp, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT r.fp, min(least) AS component_id FROM r JOIN n ON n.fp = r.other GROUP BY r.fp) SELECT doc_id, format('{{:016x}}', fp) AS fingerprint, component_id FROM p JOIN c USING (fp)"""


def harmonic_runs() -> str:
    """Runs as islands among all pairs of equal words of a text, by the words between them."""
    crc = "list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda k: k::UBIGINT)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384)))"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w, xor({crc}, 4294967295::UBIGINT)::BIGINT AS h FROM documents),
g AS (SELECT *, len(w) AS n, h // 10 AS g FROM d), a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM g),
v AS (SELECT rid, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w FROM a),
x AS (SELECT rid, n, unnest(range(n)) AS i, unnest(w) AS word FROM v),
m AS (SELECT l.rid, r.i - l.i AS p, l.i FROM x l JOIN x r ON l.rid = r.rid AND l.word = r.word AND r.i > l.i AND r.i - l.i <= l.n // 4),
s AS (SELECT rid, p, min(i) AS s, count(*) + p AS len FROM (SELECT rid, p, i, i - row_number() OVER (PARTITION BY rid, p ORDER BY i) AS island FROM m) GROUP BY rid, p, island HAVING count(*) + p >= greatest(6, 4 * p)),
r AS (SELECT rid, s, len, min(p) AS p FROM s GROUP BY ALL),
f AS (SELECT rid, count(*) AS n_runs, arg_min({{'s': s, 'len': len, 'p': p}}, {{'a': -len, 'b': s, 'c': p}}) AS b, string_agg(s || ',' || len || ',' || p || chr(10), '' ORDER BY s, p) AS runs FROM r GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(s + p, s + len)) AS i FROM r),
c AS (SELECT x.rid, string_agg(word, ' ' ORDER BY x.i) AS kept FROM x LEFT JOIN gone ON gone.rid = x.rid AND gone.i = x.i WHERE gone.i IS NULL GROUP BY x.rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.len AS length, b.p AS period, 1000 * b.len // b.p AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM v LEFT JOIN f USING (rid) LEFT JOIN c USING (rid)"""


def _whole(scale: int) -> str:
    """The usable vectors as whole numbers."""
    sound = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    return f"SELECT row_number() OVER () AS rid, *, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {sound}"


def code_cells(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """All distances to all entries, round by round."""
    nearest = lambda k: f"a{k} AS MATERIALIZED (SELECT rid, part, arg_min(entry, d * 1000 + entry) AS entry, min(d) AS d FROM (SELECT x.rid, x.part, e.entry, sum((x.x - e.x) * (x.x - e.x))::BIGINT AS d FROM x JOIN e{k} e ON e.part = x.part AND e.pos = x.pos GROUP BY ALL) GROUP BY ALL)"
    steps = [nearest(0)]
    for k in range(1, rounds + 1):
        steps += [f"m{k} AS (SELECT x.part, entry, pos, sum(x.x)::BIGINT AS s, count(*) AS n FROM x JOIN a{k - 1} USING (rid, part) GROUP BY ALL)", f"e{k} AS MATERIALIZED (SELECT e.part, e.entry, e.pos, coalesce((s - ((s % n) + n) % n) // n, e.x) AS x FROM e{k - 1} e LEFT JOIN m{k} USING (part, entry, pos))", nearest(k)]
    return f"""WITH w AS (SELECT *, row_number() OVER (ORDER BY vec_id, v) - 1 AS place, len(v) // {parts} AS width FROM ({_whole(4096)})),
x AS MATERIALIZED (SELECT rid, place, (j // width) AS part, j % width AS pos, x FROM (SELECT rid, place, width, unnest(range(len(v))) AS j, unnest(v) AS x FROM w)),
e0 AS MATERIALIZED (SELECT part, place AS entry, pos, x FROM x WHERE place < {entries}), {', '.join(steps)},
c AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) FROM e{rounds}) AS codebooks_sha256 FROM w JOIN c USING (rid)"""


#: All pairs; inner products of whole numbers stay exact in doubles.
VORONOI_TOPK = f"""WITH w AS ({_whole(256)}), s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score FROM w q JOIN w c ON q.rid <> c.rid WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_frequency": LINE_FREQUENCY,
        "planted_boilerplate": line_frequency(PLANTED),
        "branching_trees": BRANCHING_TREES,
        "op3_reply_trees": REPLY_TREES,
        "op4_url_ratio": url_ratio(),
        "op5_zstd_warc": ZSTD_WARC,
        "op8_wu_manber": WU_MANBER,
        "op9_simhash_groups": simhash_groups(),
        "op11_harmonic_runs": harmonic_runs(),
        "op12_code_cells": code_cells(),
        "op13_voronoi_topk": VORONOI_TOPK,
    }
