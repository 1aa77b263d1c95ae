"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

SP = r"\x20\x09-\x0D"



def quality(min_docs: int = 5, growth: float = 1.0, keep_share: float = 0.5) -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, 'none|') AS host FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(t, '[{SP}]+'), lambda x: x <> '') AS w FROM d),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + o) AS n FROM dup CROSS JOIN (VALUES (0), (1), (2)) AS v(o) GROUP BY rid),
ls AS (SELECT rid, host, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SP}]')) AS l FROM d),
ln AS (SELECT rid, host, trim(regexp_replace(lower(x), '[{SP}]+', ' ', 'g')) AS line FROM (SELECT rid, host, unnest(l) AS x FROM ls)),
seen AS (SELECT host, line, count(DISTINCT rid) AS n FROM ln GROUP BY host, line),
common AS (SELECT s.host, s.line FROM seen s JOIN (SELECT host, count(*) AS n FROM d GROUP BY host) h ON s.host = h.host WHERE s.n > {min_docs} AND s.n > {growth} * sqrt(h.n)),
lost AS (SELECT rid, sum(length(line) - length(replace(line, ' ', '')) + 1) AS n FROM ln JOIN common USING (host, line) GROUP BY rid),
c AS (SELECT d.rid, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
      len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed_words
      FROM d JOIN w USING (rid) JOIN ls USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN lost USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= {keep_share} * n_words AS kept FROM c
"""

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS c FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.c = l.a),
m AS (SELECT a, min(c) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, m.component_id, v.vec_id = m.component_id AS kept FROM v JOIN m ON v.vec_id = m.a LEFT JOIN n ON v.vec_id = n.a
"""

#: Pages whose article is one element with paragraphs, headings, bold text and breaks.
PAGES = r"""
SELECT page_id, url, t AS text, length(t) AS n_chars FROM (
  SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '<article>(.*?)</article>', 1, 's'),
    '</?b>', '', 'g'), '</?(p|h1|br)>', ' ', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS t FROM pages)
"""


def _covered(n: int) -> str:
    """CTE r<n>: maximal runs a to b of bytes that a string of ``n`` bytes covers which starts twice or more."""
    window = f"substr(x, CAST(2 * i + 1 AS INTEGER), {2 * n})"
    return f"""h{n} AS (SELECT rid, o + i AS i, hash({window}) AS ha, hash('x' || {window}) AS hb FROM (SELECT rid, o, x, unnest(range(least(512, n_bytes - {n} + 1 - o))) AS i FROM b WHERE n_bytes - o >= {n})),
s{n} AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY ha, hb) AS c FROM h{n}) WHERE c > 1),
e{n} AS (SELECT rid, i, i - coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -1000000) > {n} AS fresh FROM s{n}),
r{n} AS (SELECT rid, min(i) AS a, max(i) + {n} AS b FROM (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY rid ORDER BY i) AS g FROM e{n}) GROUP BY rid, g)"""


def repeats(length: int = 400, passage: int = 208) -> str:
    """Every window of every text, as hexadecimal digits of its bytes; texts are cut into blocks of 512 windows."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents),
b AS (SELECT rid, n_bytes, o, substr(x, CAST(2 * o + 1 AS INTEGER), {2 * (512 + length)}) AS x FROM (SELECT rid, n_bytes, x, unnest(range(0, n_bytes, 512)) AS o FROM d)),
{_covered(length)}, {_covered(passage)},
k AS (SELECT rid, a, b, lead(a) OVER (PARTITION BY rid ORDER BY a) AS next, row_number() OVER (PARTITION BY rid ORDER BY a) AS nr FROM r{length}),
t AS (SELECT k.rid, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(CASE WHEN nr = 1 THEN substr(x, 1, CAST(2 * a AS INTEGER)) ELSE '' END || substr(x, CAST(2 * b + 1 AS INTEGER), CAST(2 * (coalesce(next, n_bytes) - b) AS INTEGER)), '' ORDER BY a) AS rest FROM k JOIN d USING (rid) GROUP BY k.rid)
SELECT doc_id, n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, x))) AS kept_sha256, CAST(coalesce(p, 0) AS BIGINT) AS n_repeated
FROM d LEFT JOIN t USING (rid) LEFT JOIN (SELECT rid, sum(b - a) AS p FROM r{passage} GROUP BY rid) USING (rid)
"""


# ---- XXH64 and SimHash ---------------------------------------------------------------------------------------------

# The five primes of XXH64.
PRIMES = [0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5]


def _u(x: int) -> str:
    return f"{x % (1 << 64)}::UHUGEINT"


ONES = _u(-1)


def _times(a: str, prime: int) -> str:
    return f"(({a}) * {_u(prime)} & {ONES})"


def _turned(x: str, n: int) -> str:
    return f"(((({x}) << {n}) | (({x}) >> {64 - n})) & {ONES})"


def _mixed(acc: str, lane: str) -> str:
    return _times(_turned(f"(({acc}) + {_times(lane, PRIMES[1])}) & {ONES}", 31), PRIMES[0])


def xxh64(source: str, seed: int) -> str:
    """CTEs that end in hashed (s, h): XXH64 of the UTF-8 bytes of every text s of ``source``, in 128-bit integers. Bytes are
    read from their hexadecimal digits, lanes with the lowest byte first."""
    p1, p2, p3, p4, p5 = PRIMES
    lane = lambda digits: f"('0x' || array_to_string(list_reverse(regexp_extract_all({digits}, '..')), ''))::UHUGEINT"
    column = lambda i, init: f"list_reduce(list_transform(range(k), lambda j: lanes[4 * j + {i}]), lambda acc, x: {_mixed('acc', 'x')}, {_u(init)}) AS v{i}"
    four = ", ".join(column(i, init) for i, init in enumerate((seed + p1 + p2, seed + p2, seed, seed - p1), 1))
    merged = f"list_reduce([v1, v2, v3, v4], lambda h, v: ({_times('xor(h, ' + _mixed('0::UHUGEINT', 'v') + ')', p1)} + {_u(p4)}) & {ONES}, ({_turned('v1', 1)} + {_turned('v2', 7)} + {_turned('v3', 12)} + {_turned('v4', 18)}) & {ONES})"
    eight = f"({_times(_turned('xor(h, ' + _mixed('0::UHUGEINT', 'x') + ')', 27), p1)} + {_u(p4)}) & {ONES}"
    half = f"({_times(_turned('xor(h1, ' + _times(lane('substr(hx, CAST(2 * d8 + 1 AS INTEGER), 8)'), p1) + ')', 23), p2)} + {_u(p3)}) & {ONES}"
    byte = _times(_turned("xor(h, " + _times("x", p5) + ")", 11), p1)
    return f"""x0 AS (SELECT s, hex(encode(s)) AS hx, octet_length(encode(s)) AS n FROM (SELECT DISTINCT s FROM {source})),
x1 AS (SELECT *, n // 32 AS k, list_transform(regexp_extract_all(hx, '.{{16}}'), lambda y: {lane("y")}) AS lanes FROM x0),
x2 AS (SELECT *, {four} FROM x1),
x3 AS (SELECT *, CASE WHEN k = 0 THEN {_u(seed + p5)} ELSE {merged} END AS h0 FROM x2),
x4 AS (SELECT *, list_reduce(lanes[4 * k + 1 :], lambda h, x: {eight}, (h0 + n::UHUGEINT) & {ONES}) AS h1, n // 8 * 8 AS d8 FROM x3),
x5 AS (SELECT *, CASE WHEN n - d8 >= 4 THEN {half} ELSE h1 END AS h2, CASE WHEN n - d8 >= 4 THEN d8 + 4 ELSE d8 END AS d4 FROM x4),
x6 AS (SELECT *, list_reduce(list_transform(range(d4, n), lambda j: ('0x' || substr(hx, CAST(2 * j + 1 AS INTEGER), 2))::UHUGEINT), lambda h, x: {byte}, h2) AS h3 FROM x5),
x7 AS (SELECT *, {_times("xor(h3, h3 >> 33)", p2)} AS h4 FROM x6),
x8 AS (SELECT *, {_times("xor(h4, h4 >> 29)", p3)} AS h5 FROM x7),
hashed AS (SELECT s, xor(h5, h5 >> 32) AS h FROM x8)"""


def simhash(shingle: int = 4, radius: int = 4, seed: int = 42) -> str:
    upper = "".join(map(chr, range(65, 91)))
    joined = " || ' ' || ".join(f"w[i + {k}]" for k in range(shingle))
    votes = ", ".join(f"sum(CAST((h >> {b}) & 1::UHUGEINT AS INTEGER)) AS c{b}" for b in range(64))
    bits = " + ".join(f"CASE WHEN 2 * c{b} > m THEN {1 << b}::UHUGEINT ELSE 0::UHUGEINT END" for b in range(64))
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[{SP}]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT rid, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {shingle} THEN [array_to_string(w, ' ')] ELSE [{joined} FOR i IN range(1, len(w) - {shingle} + 2)] END) AS s FROM d),
{xxh64("sh", seed)},
voted AS (SELECT rid, count(*) AS m, {votes} FROM sh JOIN hashed USING (s) GROUP BY rid),
f AS (SELECT d.rid, doc_id, CAST(coalesce({bits}, 0::UHUGEINT) AS UBIGINT) AS fp FROM d LEFT JOIN voted USING (rid)),
v AS (SELECT fp, min(doc_id) AS least FROM f GROUP BY fp),
l AS (SELECT a.fp AS a, b.fp AS b FROM v a JOIN v b ON a.fp <> b.fp AND bit_count(xor(a.fp::HUGEINT, b.fp::HUGEINT)) <= {radius}),
r AS (SELECT fp AS a, fp AS c FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.c = l.a),
g AS (SELECT r.a AS fp, min(least) AS component_id FROM r JOIN v ON r.c = v.fp GROUP BY r.a)
SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id FROM f JOIN g USING (fp)
"""


# ---- sharding ------------------------------------------------------------------------------------------------------


def _crc_table() -> str:
    """The table of CRC-32 for one byte, from its polynomial."""
    out = []
    for b in range(256):
        for _ in range(8):
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        out.append(b)
    return "[" + ", ".join(f"{x}::UBIGINT" for x in out) + "]"


def shards(n: int = 40) -> str:
    """Smallest capacity by binary search over greedy filling, in order of the text's hash; for tables in which no stretch
    of the line holds more than 512 rows."""
    one = 1 << 40  # the accumulator holds the number of shards above the load of the last one
    fill = f"list_reduce(sizes, lambda a, x: CASE WHEN a % {one} + x > middle THEN (a // {one} + 1) * {one} + x ELSE a + x END, {one}::BIGINT) // {one}"
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS s FROM documents),
{xxh64("d", 42)},
tb AS (SELECT {_crc_table()} AS tab),
crc AS (SELECT s, xor(list_reduce(list_transform(regexp_extract_all(hx, '..'), lambda y: ('0x' || y)::UBIGINT), lambda c, b: xor(c >> 8, tab[CAST((xor(c, b) & 255::UBIGINT) AS BIGINT) + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT) AS crc FROM x0, tb),
e AS (SELECT rid, doc_id, CAST(n + 16 AS BIGINT) AS size, CAST(crc AS BIGINT) AS crc, h, h >> 48 AS atom FROM d JOIN hashed USING (s) JOIN crc USING (s) JOIN x0 USING (s)),
atoms AS (SELECT atom, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY atom) AS i FROM e GROUP BY atom),
line AS (SELECT list(size ORDER BY i) AS sizes, greatest(max(size), ceil(sum(size) / {n})::BIGINT) AS lo, ceil(sum(size) / {n})::BIGINT + max(size) AS hi FROM atoms),
halves AS (SELECT lo, hi FROM line UNION ALL SELECT CASE WHEN fits THEN lo ELSE middle + 1 END, CASE WHEN fits THEN middle ELSE hi END FROM (SELECT lo, hi, middle, {fill} <= {n} AS fits FROM (SELECT h.lo, h.hi, (h.lo + h.hi) // 2 AS middle, sizes FROM halves h, line WHERE h.lo < h.hi))),
cap AS (SELECT min(hi) AS c FROM halves),
filled AS (SELECT 1::BIGINT AS i, 0 AS shard, size AS used FROM atoms WHERE i = 1 UNION ALL SELECT a.i, CASE WHEN used + a.size > c THEN shard + 1 ELSE shard END, CASE WHEN used + a.size > c THEN a.size ELSE used + a.size END FROM filled f JOIN atoms a ON a.i = f.i + 1, cap)
SELECT doc_id, e.size, crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM e JOIN atoms USING (atom) JOIN filled USING (i)
"""
