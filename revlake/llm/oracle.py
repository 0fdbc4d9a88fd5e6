"""SQL twins of those queries that SQL can express."""

from __future__ import annotations

from .licenses import COPYRIGHT_LINE, NOTICES, SPELLINGS

_RULES = "(VALUES ('org','/','allow'), ('example.org','/es/','block'), ('example.org','/en/1','block'), ('com','/fr/','allow'), ('com','/de/','block')) AS r(h, p, v)"

URL_FILTERS = f"""
WITH rest AS (
  SELECT row_number() OVER () AS n, page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM rest
), hits AS (
  SELECT n, max({{'c': length(h || p), 'hc': length(h), 'v': v, 'rule': h || p}}) AS best
  FROM parts JOIN {_RULES} ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY n
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.v, 'allow') AS verdict
FROM parts LEFT JOIN hits USING (n)
"""


def _canonical(line: str) -> str:
    low = f"translate({line}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    text = f"(' ' || trim(regexp_replace({low}, '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g')) || ' ')"
    for old, new in SPELLINGS:
        text = f"replace({text}, ' {old}', ' {new}')"
    drop = f"regexp_matches({low}, '{COPYRIGHT_LINE}')"
    return f"CASE WHEN {drop} THEN '' ELSE trim({text}) END"


_KNOWN = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in NOTICES)

LICENSE_SCANS = f"""
WITH given(license_id, text) AS (VALUES {_KNOWN}),
listed AS (
  SELECT array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_canonical('x')}), lambda x: x <> ''), ' ') AS whole, license_id
  FROM given
), known AS (
  SELECT whole, min(license_id) AS license_id, string_split(whole, ' ')[1] AS first, len(string_split(whole, ' ')) AS words FROM listed GROUP BY whole
), docs AS (
  SELECT DISTINCT doc_id, text FROM documents
), lines AS (
  SELECT doc_id, md5(coalesce(text, '')) AS raw,
         list_filter(list_transform(string_split(text, chr(10)), lambda x: {_canonical('x')}), lambda x: x <> '') AS ls FROM docs
), places AS (
  SELECT doc_id, raw, ls, unnest(range(1, len(ls) + 1)) AS i FROM lines
), tails AS (
  SELECT doc_id, raw, array_to_string(ls[i:], chr(10)) AS tail, string_split(ls[i], ' ')[1] AS first FROM places
), runs AS (
  SELECT doc_id, raw, license_id, whole, tail, array_to_string(string_split(replace(tail, chr(10), ' '), ' ')[1:words], ' ') AS run FROM tails JOIN known USING (first)
), parts AS (
  SELECT doc_id, raw, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS line_licenses FROM runs
  WHERE run = whole AND (length(run) = length(tail) OR substr(tail, length(run) + 1, 1) = chr(10)) GROUP BY doc_id, raw
), wholes AS (
  SELECT doc_id, raw, nullif(array_to_string(ls, ' '), '') AS whole FROM lines
)
SELECT w.doc_id, CASE WHEN w.whole IS NOT NULL THEN sha256(w.whole) END AS text_sha256, k.license_id, p.line_licenses
FROM wholes w LEFT JOIN known k ON w.whole = k.whole LEFT JOIN parts p ON p.doc_id = w.doc_id AND p.raw = w.raw
"""

_WORDS = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')".format(
    "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)


def _shingles(words: str, size: int) -> str:
    """Distinct runs of words; a shorter text is one run of all its words."""
    runs = f"list_transform(range(1, len({words}) - {size - 2}), lambda i: array_to_string({words}[i:i + {size - 1}], ' '))"
    return f"list_distinct(CASE WHEN len({words}) >= {size} THEN {runs} WHEN len({words}) > 0 THEN [array_to_string({words}, ' ')] ELSE [] END)"


NEAR_DUPLICATES = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sets AS (SELECT doc_id, {_shingles('w', 2)} AS s FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.x = b.x
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) ON doc_id = a
"""

DECONTAMINATION = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents), items AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark),
probes AS (SELECT item_id, len(s) AS n, unnest(s) AS x FROM (SELECT item_id, {_shingles('w', 5)} AS s FROM items)),
own AS (SELECT doc_id, unnest({_shingles('w', 5)}) AS x FROM docs)
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_found
FROM own JOIN probes USING (x) GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 80 * n
"""

LINE_DEDUP = r"""
WITH docs AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
split AS (SELECT doc_id, text, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(
  trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g')) AS ls FROM docs),
every AS (SELECT doc_id, text, ls, unnest(range(1, len(ls) + 1)) AS pos FROM split),
lines AS (
  SELECT doc_id, text, pos, ls[pos] AS m, string_split(ls[pos], ' ') AS toks, len(string_split(ls[pos], ' ')) AS size,
         row_number() OVER w AS rank, sum(len(string_split(ls[pos], ' '))) OVER (PARTITION BY doc_id, text) AS total
  FROM every WHERE ls[pos] <> '' WINDOW w AS (PARTITION BY doc_id, text ORDER BY pos)
), leafed AS (SELECT *, size || chr(2) || array_to_string(toks[1:3], ' ') AS leaf FROM lines),
kinds AS (SELECT leaf, m, any_value(toks) AS toks, count(*) AS n FROM leafed GROUP BY leaf, m),
leaves AS (SELECT leaf, sum(n) AS total, max(len(toks)) AS places FROM kinds GROUP BY leaf HAVING count(*) > 1 AND sum(n) >= 10),
each AS (SELECT leaf, m, n, unnest(range(1, len(toks) + 1)) AS place, unnest(toks) AS token FROM kinds WHERE leaf IN (SELECT leaf FROM leaves)),
fixed AS (SELECT leaf, place, token FROM each JOIN leaves USING (leaf) GROUP BY leaf, place, token, total HAVING 2 * sum(n) > total),
valid AS (SELECT leaf, count(*) AS fixed FROM fixed JOIN leaves USING (leaf) GROUP BY leaf, places HAVING count(*) * 100 >= places * 60),
fits AS (SELECT e.leaf, e.m FROM each e JOIN fixed f ON e.leaf = f.leaf AND e.place = f.place AND e.token = f.token
  JOIN valid v ON e.leaf = v.leaf GROUP BY e.leaf, e.m, v.fixed HAVING count(*) = v.fixed),
found AS (SELECT c.*, CASE WHEN f.m IS NOT NULL THEN chr(3) || c.leaf ELSE c.m END AS template
  FROM leafed c LEFT JOIN fits f ON c.leaf = f.leaf AND c.m = f.m),
often AS (SELECT template, min(md5(m)) AS mark FROM found GROUP BY template HAVING count(DISTINCT text) >= 10),
places AS (SELECT DISTINCT text, rank, m, size, total, mark FROM found JOIN often USING (template)),
numbered AS (SELECT *, rank - row_number() OVER (PARTITION BY text ORDER BY rank) AS run FROM places),
runs AS (SELECT text, run, sum(size) AS size, max(total) AS total, min(mark) AS mark FROM numbered GROUP BY text, run),
alike AS (
  SELECT text, min(mark) AS copy FROM runs GROUP BY text
  HAVING 100 * sum(greatest(size - 4, 0)) >= 80 * (2 * greatest(max(total) - 4, 1) - sum(greatest(size - 4, 0)))
), own AS (
  SELECT DISTINCT copy, text, unnest(toks) AS word FROM leafed l JOIN alike USING (text)
  WHERE NOT EXISTS (SELECT 1 FROM places p WHERE p.text = l.text AND p.rank = l.rank)
), frequent AS (
  SELECT copy, word FROM own JOIN (SELECT copy, count(*) AS texts FROM alike GROUP BY copy) USING (copy)
  GROUP BY copy, word, texts HAVING 2 * count(*) >= texts
), common AS (
  SELECT copy, word FROM frequent UNION SELECT copy, unnest(string_split(m, ' ')) FROM (SELECT DISTINCT copy, m FROM places JOIN alike USING (text))
), other AS (
  SELECT text FROM own LEFT JOIN common USING (copy, word) GROUP BY text HAVING 2 * count(common.word) <= count(*)
), copies AS (SELECT text, copy FROM alike WHERE text NOT IN (SELECT text FROM other)),
again AS (
  SELECT template, coalesce(chr(1) || copy, chr(2) || f.text) AS kind, doc_id
  FROM found f JOIN often USING (template) LEFT JOIN copies c ON f.text = c.text
), dropped AS (SELECT template, min(doc_id) AS first FROM again GROUP BY template HAVING count(DISTINCT kind) >= 10),
gone AS (SELECT doc_id, text, list(pos) AS gone FROM found JOIN dropped USING (template) WHERE doc_id <> first GROUP BY doc_id, text),
cut AS (
  SELECT d.doc_id, d.text, CASE WHEN gone IS NULL THEN d.text ELSE array_to_string(list_filter(
    string_split(d.text, chr(10)), lambda x, i: NOT list_contains(gone, i)), chr(10)) END AS rest
  FROM documents d LEFT JOIN gone g ON d.doc_id = g.doc_id AND d.text = g.text
)
SELECT doc_id, length(text) AS n_chars, length(rest) AS n_left, sha256(rest) AS text_sha256 FROM cut
"""

HARD_NEGATIVES = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole a JOIN whole b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 10
"""

_UNIT = "(CAST('0x' || substr(md5({}), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE"
_SCORES = f"list_transform(range(0, {{}}), lambda k: {{{{'s': -1.0::DOUBLE / ln({_UNIT.format('coalesce(doc_id::VARCHAR, '') || chr(58) || k')}), 'k': -k}}}})"

SHARDING = f"""
WITH RECURSIVE crc(i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
placed AS (
  SELECT doc_id, coalesce(text, '') AS text, list_max({_SCORES.format(40)}) AS own, list_max({_SCORES.format(41)}) AS grown
  FROM documents
), sized AS (
  SELECT doc_id, hex(encode(text)) AS bytes, CAST(-own.k AS INTEGER) AS shard, CAST(-grown.k AS INTEGER) AS grown_shard, {_UNIT.format("coalesce(doc_id::VARCHAR, '')")} AS mixed FROM placed
), summed AS (
  SELECT doc_id, shard, grown_shard, mixed, CAST(length(bytes) // 2 + 16 AS BIGINT) AS size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(bytes), 2), lambda i: CAST('0x' || substr(bytes, i, 2) AS BIGINT))),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM sized, crc_table
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY mixed, doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM summed
"""

ORACLE: dict[str, str] = {
    "op6_near_duplicates": NEAR_DUPLICATES, "op7_decontamination": DECONTAMINATION, "op9_line_dedup": LINE_DEDUP,
    "op8_license_scans": LICENSE_SCANS, "op10_url_filters": URL_FILTERS,
    "op11_sharding": SHARDING, "op12_hard_negatives": HARD_NEGATIVES,
}
