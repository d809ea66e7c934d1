"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

from chatframe.llm import secrets

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP1 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM d GROUP BY source),
priced AS (
  SELECT *, source_size * 2 AS cap, source_size * 2 / weight::DOUBLE AS ratio
  FROM (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM ranked)),
levels AS (
  SELECT *, (1.5e0 * sum(source_size) OVER () - coalesce(sum(cap) OVER earlier, 0)::DOUBLE)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0))::DOUBLE AS level
  FROM priced
  WINDOW earlier AS (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (
  SELECT source, source_size, 1.5e0 - 0.5e0 * (rank % 3) AS a,
         CASE WHEN level >= ratio THEN cap::DOUBLE ELSE weight * max(level) OVER () END AS target
  FROM levels),
placed AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.a, 2e0 - g.a AS b,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins
  FROM d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source),
taking AS (
  SELECT *, coalesce(least(greatest(ceil((target - begins - size / 2e0) / nullif(source_size, 0)), 0), 2), 0)::BIGINT AS copies,
         (a + b) / 2 * 0.9e0 AS area, begins / nullif(target, 0) * ((a + b) / 2 * 0.9e0 + (b + b) / 2 * (1e0 - 0.9e0)) AS need
  FROM placed)
SELECT doc_id, size, source_size, target, size * copies AS taken,
       CASE WHEN copies > 0 THEN round(
         CASE WHEN need < area
              THEN need * 2 / (a + sqrt(greatest(a * a + need * 2 * (b - a) / 0.9e0, 0)))
              ELSE 0.9e0 + (need - area) * 2 / (b + b) END, 9) END AS position
FROM taking
"""

OP2 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM p),
r AS (SELECT *, payload_bytes >= 100 AND first IS NOT NULL AND coalesce(page_id <> first, true) AS again FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first END AS refers_to
FROM r
"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item, array_to_string(ws[a:a + 9], ' ') AS gram, least(len(ws), 10) AS n
  FROM i, unnest(range(1, greatest(1, len(ws) - 9) + 1)) t(a) WHERE len(ws) > 0),
found AS (
  SELECT doc_id, a, win.n, item
  FROM (SELECT doc_id, a, n, array_to_string(ws[a:a + n - 1], ' ') AS gram
        FROM d, (SELECT DISTINCT n FROM win) s, unnest(range(1, greatest(0, len(ws) - n + 1) + 1)) t(a)) g
  JOIN win ON g.gram = win.gram AND g.n = win.n),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(a, a + n)) t(p) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _matches(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, source, lang, {rank} AS rank, '{kind}' AS kind, v[i] AS value,
         (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start,
         length(m[i]) AS size
  FROM (SELECT doc_id, source, lang, regexp_extract_all(coalesce(text, ''), '{p}') AS m,
               regexp_extract_all(coalesce(text, ''), '{p}', {group}) AS v, string_split_regex(coalesce(text, ''), '{p}') AS p
        FROM documents), unnest(range(1, len(m) + 1)) t(i)
  WHERE length(v[i]) >= {least}"""


_BASE = " UNION ALL ".join(_matches(r, *k) for r, k in enumerate(secrets.KINDS))
OP6 = f"""
WITH base AS ({_BASE}),
bare AS ({_matches(3, "known", secrets.BARE, 0, 16)}),
owned AS (SELECT value, count(DISTINCT coalesce(source, '')) AS owners FROM base GROUP BY value),
spans AS (
  SELECT doc_id, rank, kind, start, size, owners <= 1 AS live FROM base JOIN owned USING (value)
  UNION ALL
  SELECT doc_id, rank, kind, start, size, true FROM bare b JOIN owned USING (value)
  WHERE owners <= 1 AND NOT EXISTS (
    SELECT 1 FROM base x WHERE x.doc_id = b.doc_id AND x.start < b.start + b.size AND b.start < x.start + x.size)),
listed AS (
  SELECT doc_id, concat(kind, ':', start, ':', start + size) AS span, * EXCLUDE (doc_id) FROM spans),
docs AS (
  SELECT doc_id, count_if(kind = 'assign') AS n_assign, count_if(kind = 'access') AS n_access, count_if(kind = 'hex') AS n_hex,
         string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans,
         count_if(rank < 3 AND live) AS n_live, count_if(rank < 3 AND NOT live) AS n_copied
  FROM listed GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_copied, 0)::BIGINT AS n_copied
FROM documents d LEFT JOIN docs USING (doc_id)
"""

_UNSEEN = r"(?is)<script.*?(?:</script[^>]*(?:>|\z)|\z)|<style.*?(?:</style[^>]*(?:>|\z)|\z)|<!--.*?(?:-->|\z)"
_TAGS = (
    "address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|li|main|nav|"
    "ol|option|p|pre|section|table|td|th|title|tr|ul"
)
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]*)"
_SEEN = f"regexp_replace(coalesce(html, ''), '{_UNSEEN}', ' ', 'g')"
_BLOCKS = (
    rf"regexp_replace(regexp_replace({_SEEN}, '[\x20\x09-\x0D]+', ' ', 'g'), "
    rf"'(?i)</?(?:{_TAGS})(?:[\x20\x09-\x0D/][^>]*(?:>|\z)|>)', chr(10), 'g')"
)
_PLAIN = rf"regexp_replace(regexp_replace({_BLOCKS}, '<[^>]*(?:>|\z)', '', 'g'), ' *\n *| {{2,}}', chr(10), 'g')"
OP10 = f"""
WITH p AS (
  SELECT page_id, lower(coalesce(regexp_extract(url, '{_HOST}', 1), '')) AS host,
         list_filter(list_transform(string_split({_PLAIN}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS ls
  FROM pages),
sites AS (SELECT host, count(*) AS host_pages FROM p WHERE host <> '' GROUP BY host),
common AS (
  SELECT host, list(line) AS drops
  FROM (SELECT host, line, count(*) AS n FROM p, unnest(list_distinct(ls)) t(line) WHERE host <> '' GROUP BY host, line)
  JOIN sites USING (host) WHERE n >= 3 AND n > host_pages * 0.2e0 GROUP BY host),
kept AS (
  SELECT page_id, p.host, ls, list_filter(ls, lambda x: NOT list_contains(coalesce(drops, []), x)) AS ks
  FROM p LEFT JOIN common ON p.host = common.host)
SELECT page_id, host, len(ls)::BIGINT AS n_lines, (len(ls) - len(ks))::BIGINT AS n_dropped,
       sha256(array_to_string(ks, chr(10))) AS kept_sha256
FROM kept
"""

# A checksum has no function there: eight steps a byte over the digits, as on paper.
_CRC32 = """xor(list_reduce(
    list_concat([4294967295::BIGINT], flatten(list_transform(string_split({0}, ''),
        lambda c: [unicode(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc // 2, 3988292384 * (crc % 2)) END), 4294967295)"""
OP11 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
d AS (SELECT *, sha256(len(role)::VARCHAR || ':' || role || text) AS digest FROM t),
own AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, digest) AS turns FROM d GROUP BY conv_id),
h AS (SELECT *, ({_CRC32.format("conv_id::VARCHAR")} % 6)::BIGINT AS h FROM own),
c AS (SELECT h.conv_id, list_concat(coalesce(b.turns, [])[1 : h.h], h.turns[h.h + 1 :]) AS turns
      FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 100),
m AS (SELECT conv_id, len(turns)::BIGINT AS size, depth, turns[1 : depth] AS prefix
      FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS depth FROM c)),
n AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*)::BIGINT AS n_convs,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256
      FROM m GROUP BY depth, prefix),
k AS (SELECT prefix[1 : depth - 1] AS prefix, count(*)::BIGINT AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.depth > 0 THEN (n_convs - 1) * len(n.prefix[n.depth].text) ELSE 0 END AS saved
      FROM n LEFT JOIN k ON k.prefix = n.prefix),
s AS (SELECT prefix[1 : above] AS prefix, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
      FROM (SELECT *, unnest(range(0, depth + 1)) AS above FROM v) GROUP BY ALL)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, v.ends_sha256
FROM v JOIN s ON s.prefix = v.prefix LEFT JOIN n p ON v.depth > 0 AND p.prefix = v.prefix[1 : v.depth - 1]
"""

OP13 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
      FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase
      FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, range(1, 5) AS r(k))),
f AS (SELECT lang, k, phrase, count(*)::BIGINT AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
w AS (SELECT *, string_split(phrase, ' ') AS ws FROM f),
c AS (SELECT w.*, unnest(range(1, k)) AS cut FROM w WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.a, c.cut, l.a AS l, r.a AS r, ((2000000 * c.a::HUGEINT) // (l.a::HUGEINT + r.a))::BIGINT AS score
      FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1 : cut], ' ')
             JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[cut + 1 : c.k], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT lang, array_to_string(ws[i : i + j - 1], ' ') AS phrase, max(a) AS longer
           FROM (SELECT w.*, j, unnest(range(1, k - j + 2)) AS i FROM w, range(2, 4) AS r(j) WHERE j < k) GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN inside USING (lang, phrase)
         WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase))::BIGINT AS rank, phrase, a, l, r, n, score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op1_mixing": OP1,
    "op2_warc": OP2,
    "op5_decontamination": OP5,
    "op6_secrets": OP6,
    "op10_lines": OP10,
    "op11_conversations": OP11,
    "op13_collocations": OP13,
}
