"""The same results as plain SQL over the benchmark tables, for the correctness check."""

from __future__ import annotations

from ..operators.keywords import DAMPING, ROUNDS, SPAN
from ..sources.landing import FIRST_PAGE
from .tables import LEXICON, STOPWORDS


def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


REVIEWS = """reviews AS (
  SELECT CASE WHEN doc_id % 2 = 0 THEN 'jd' ELSE 'tmall' END AS platform,
         source AS product_id, CAST(doc_id AS VARCHAR) AS review_id,
         CASE WHEN doc_id % 2 = 0 THEN CAST(1 + (doc_id % 10) / 2 AS INTEGER) END AS rating,
         text, lang, doc_id, n_chars
  FROM documents)"""

PATTERN = r"[\p{L}\p{N}]+|[^\s]"


def _md5(expr: str, name: str) -> str:
    return f"md5({expr}) AS {name}_md5, CAST(length({expr}) AS INTEGER) AS {name}_chars"


def _hits(text: str) -> str:
    def count(term: str) -> str:
        return f"(length({text}) - length(replace({text}, '{term}', ''))) // {len(term)}"

    plus = " + ".join(count(t) for t in LEXICON.positive)
    minus = " - ".join(count(t) for t in LEXICON.negative)
    return f"({plus} - {minus})"


def _negated(text: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in LEXICON.negation) + ")"


def _scored(source: str = "reviews", text: str = "text") -> str:
    return f"""hits AS (
  SELECT *, {_hits(text)} * CASE WHEN {_negated(text)} THEN 0.5 ELSE 1.0 END
            / greatest(length({text}) / 20.0, 1.0) AS lexical FROM {source}),
scored AS (
  SELECT *, CASE WHEN score > 0.15 THEN 'positive' WHEN score < -0.15 THEN 'negative'
                 ELSE 'neutral' END AS sentiment_label
  FROM (SELECT *, greatest(-1.0, least(1.0, CAST(
          CASE WHEN rating IS NULL THEN lexical
               ELSE lexical * 0.5 + (CAST(rating AS DOUBLE) - 3) / 2 * 0.5 END AS DOUBLE))) AS score
        FROM hits))"""


SCORED = f"{REVIEWS}, {_scored()}"
LABELS = "platform, review_id, sentiment_label, round(score, 6) AS sentiment_score"
ANALYZED = """platform, product_id, review_id, rating, sentiment_label,
       round(score, 6) AS sentiment_score, md5(text) AS clean_md5"""


def _tokens(source: str = "reviews", key: str = "review_id", text: str = "text", pattern: str = PATTERN) -> str:
    """``words(key..., pos, term)`` with all tokens."""
    return f"""lists AS (SELECT *, regexp_extract_all({text}, '{pattern}') AS list FROM {source}),
words AS (SELECT * EXCLUDE (list), unnest(list) AS term, generate_subscripts(list, 1) AS pos FROM lists)"""


KEPT = f"kept AS (SELECT * FROM words WHERE term NOT IN ({_in(STOPWORDS)}))"

PAGES = """paged AS (
  SELECT *, CAST(doc_id // 20 // 10 + CASE WHEN platform = 'jd' THEN 0 ELSE 1 END AS INTEGER) AS page
  FROM reviews)"""

_SECOND = "TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id)"
_MINUTE = "date_trunc('minute', TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id))"


def _shown(at: str) -> str:
    return f"CASE WHEN doc_id % 7 <> 0 THEN strftime({at}, '%Y-%m-%d %H:%M:%S') END AS created_at"


SIZES = """sizes AS (
  SELECT platform, product_id,
         CAST(doc_id // 20 // 2 + CASE WHEN platform = 'jd' THEN 0 ELSE 1 END AS INTEGER) AS page,
         count(*) FILTER (n_chars > 700) AS n_items
  FROM reviews GROUP BY ALL)"""

STRIP = r"regexp_replace(regexp_replace({0}, '(?s)<!--.*?(?:-->|\z)', ' ', 'g'), '(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)', ' ', 'g')"


def _unescape(expr: str) -> str:
    # these old entity names also count without the semicolon
    for entity, char in (
        ("&middot", "·"), ("&copy", "©"), ("&quot", '"'), ("&lt", "<"), ("&gt", ">"), ("&amp", "&"),
    ):
        expr = f"regexp_replace({expr}, '{entity};?', '{char}', 'g')"
    return expr


SHOWN = _unescape(_unescape(
    f"regexp_replace({STRIP.format('html')}, '(?s)</?[A-Za-z][^>]*>|<[!?][^>]*>', ' ', 'g')"
))


def _squeeze(expr: str) -> str:
    for mark in "!?。！？":
        literal = f"\\{mark}" if mark == "?" else mark
        expr = f"regexp_replace({expr}, '{literal}{{3,}}', '{mark}{mark}', 'g')"
    return expr


def _tidy(expr: str) -> str:
    return rf"trim(regexp_replace({expr}, '\s+', ' ', 'g'))"


def _clean(expr: str) -> str:
    return _tidy(_squeeze(rf"regexp_replace({expr}, 'https?://\S+', '', 'g')"))


def _textrank(source: str = "reviews", key: str = "review_id", **tokens: str) -> str:
    """CTEs ending in ``textrank(key, rank, term, score)`` over all words of ``source``."""
    ctes = [
        _tokens(source, key, **tokens),
        f"""cands AS (SELECT {key}, pos, term FROM words
              WHERE length(term) >= 2 AND term NOT IN ({_in(STOPWORDS)}))""",
        f"""near AS (SELECT a.{key}, a.term AS x, b.term AS y FROM cands a JOIN cands b
              ON a.{key} = b.{key} AND b.pos > a.pos AND b.pos < a.pos + {SPAN})""",
        f"""edges AS (SELECT {key}, x, y, count(*) AS w FROM
              (SELECT {key}, x, y FROM near UNION ALL SELECT {key}, y, x FROM near) GROUP BY ALL)""",
        f"nodes AS (SELECT {key}, x AS term, sum(w) AS total FROM edges GROUP BY ALL)",
        f"links AS (SELECT e.{key}, e.x, e.y, e.w / n.total AS share FROM edges e JOIN nodes n ON n.{key} = e.{key} AND n.term = e.y)",
        f"r0 AS (SELECT {key}, term, 1.0 / count(*) OVER (PARTITION BY {key}) AS ws FROM nodes)",
    ]
    for i in range(ROUNDS):
        ctes.append(
            f"""r{i + 1} AS (SELECT l.{key}, l.x AS term, {1 - DAMPING!r} + {DAMPING} * sum(l.share * r.ws) AS ws
              FROM links l JOIN r{i} r ON r.{key} = l.{key} AND r.term = l.y GROUP BY ALL)"""
        )
    ctes.append(
        f"""textrank AS (SELECT {key}, term, score, CAST(row_number() OVER
              (PARTITION BY {key} ORDER BY score DESC, term) AS INTEGER) AS rank
            FROM (SELECT {key}, term, round(ws, 6) AS score FROM r{ROUNDS}))"""
    )
    return ",\n".join(ctes)


_DOC_FREQUENCY = f"""WITH {REVIEWS}, {_tokens()}, {KEPT},
n AS (SELECT count(*) AS n_docs FROM reviews)
SELECT term, df, n_docs FROM (SELECT term, count(DISTINCT review_id) AS df FROM kept GROUP BY ALL) CROSS JOIN n
WHERE df <= 0.95 * n_docs"""


def _tfidf(by: str, top_n: int) -> str:
    group = f"{by}, " if by else ""
    over = f"PARTITION BY {by}" if by else ""
    sizes = f"SELECT {group}count(*) AS n FROM reviews" + (f" GROUP BY {by}" if by else "")
    using = f"JOIN sizes USING ({by})" if by else "CROSS JOIN sizes"
    return f"""WITH {REVIEWS}, {_tokens()}, {KEPT},
tf AS (SELECT {group}review_id, term, count(*) AS tf FROM kept GROUP BY ALL),
sizes AS ({sizes}),
vocab AS (SELECT {group}term, ln((1 + n) / (1 + df)) + 1 AS idf
          FROM (SELECT {group}term, count(*) AS df FROM tf GROUP BY ALL) {using}
          WHERE df <= 0.95 * n),
weights AS (SELECT tf.*, tf.tf * idf AS w FROM tf JOIN vocab USING ({group}term)),
unit AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY {group}review_id)) AS u FROM weights),
ranked AS (SELECT *, CAST(row_number() OVER ({over} ORDER BY score DESC, term) AS INTEGER) AS rank
           FROM (SELECT {group}term, round(sum(u), 6) AS score FROM unit GROUP BY ALL))
SELECT {group}rank, term, score FROM ranked WHERE rank <= {top_n}"""


def _topics(k: int = 5, rounds: int = 10, top_n: int = 8) -> str:
    """Topic shares of every (document, term), round after round."""
    prior, even, each = 1.0 / k, 0.1 / k, range(k)
    ctes = [
        REVIEWS, _tokens(), KEPT,
        "tf AS (SELECT review_id, term, CAST(count(*) AS DOUBLE) AS tf FROM kept GROUP BY ALL)",
        "vocab AS (SELECT term FROM tf GROUP BY term HAVING count(*) <= 0.95 * (SELECT count(*) FROM reviews))",
        "v AS (SELECT count(*) AS v FROM vocab)",
        f"""s0 AS MATERIALIZED (SELECT review_id, term, tf, {', '.join(f'CASE WHEN own = {j} THEN {0.9 + even!r}::DOUBLE ELSE {even!r}::DOUBLE END AS p{j}' for j in each)}
  FROM (SELECT *, CAST('0x' || substr(md5(review_id || '|' || term), 1, 8) AS BIGINT) % {k} AS own FROM tf SEMI JOIN vocab USING (term)))""",
    ]
    for i in range(rounds):
        sums = lambda over, name: ", ".join(f"sum(tf * p{j}) OVER ({over}) AS {name}{j}" for j in each)
        up = ", ".join(f"(d{j} - p{j} + {prior!r}::DOUBLE) * (w{j} - p{j} + {prior!r}::DOUBLE) / (t{j} - p{j} + v * {prior!r}::DOUBLE) AS u{j}" for j in each)
        whole = " + ".join(f"u{j}" for j in each)
        ctes.append(
            f"""s{i + 1} AS MATERIALIZED (SELECT review_id, term, tf, {', '.join(f'u{j} / ({whole}) AS p{j}' for j in each)} FROM (
  SELECT review_id, term, tf, {up} FROM (SELECT *, {sums('PARTITION BY review_id', 'd')}, {sums('PARTITION BY term', 'w')}, {sums('', 't')} FROM s{i}) CROSS JOIN v))"""
        )
    parts = " UNION ALL ".join(
        f"SELECT {j} AS topic, term, round((sum(tf * p{j}) + {prior!r}::DOUBLE) / ((SELECT sum(tf * p{j}) FROM s{rounds}) + any_value(v) * {prior!r}::DOUBLE), 6) AS weight FROM s{rounds} CROSS JOIN v GROUP BY term"
        for j in each
    )
    return f"""WITH {', '.join(ctes)}, weights AS ({parts})
SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS INTEGER) AS rank, term, weight FROM weights
QUALIFY rank <= {top_n}"""


def _lists(by: str, source: str, where: str = "TRUE") -> str:
    """Strengths, complaints and top terms from ``source(by..., sentiment_label, term)``."""
    return f"""poles AS (SELECT {by}, term, count(*) FILTER (sentiment_label = 'positive') AS pos,
                 count(*) FILTER (sentiment_label = 'negative') AS neg
          FROM {source} WHERE sentiment_label <> 'neutral' AND {where} GROUP BY ALL),
entries AS (SELECT {by}, term, 'strengths' AS list, pos - neg AS signal FROM poles
  UNION ALL SELECT {by}, term, 'complaints', neg - pos FROM poles
  UNION ALL SELECT {by}, term, 'top_positive_terms', pos FROM poles
  UNION ALL SELECT {by}, term, 'top_negative_terms', neg FROM poles),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY {by}, list ORDER BY signal DESC, term)
           AS INTEGER) AS rank FROM entries WHERE signal > 0)
SELECT {by}, list, rank, term, signal FROM ranked WHERE rank <= 10"""


def _rolling(group: str) -> str:
    over = f"PARTITION BY {group} ORDER BY ts, event_id" if group else "ORDER BY ts, event_id"
    total = f"count(*) OVER (PARTITION BY {group})" if group else "count(*) OVER ()"
    return f"""WITH sized AS (SELECT *, greatest(5, {total} // 20) AS w FROM events WHERE ts IS NOT NULL),
numbered AS (SELECT *, row_number() OVER ({over}) AS rn, sum(CAST(value AS DECIMAL(18, 6)))
             OVER ({over} ROWS UNBOUNDED PRECEDING) AS cs FROM sized)
SELECT a.event_id, a.rn, round(CAST(a.cs - coalesce(b.cs, 0) AS DOUBLE) / least(a.rn, a.w), 6) AS rolling_sentiment
FROM numbered a LEFT JOIN numbered b ON b.rn = a.rn - a.w {f'AND b.{group} = a.{group}' if group else ''}"""


STORED = f"""WITH {REVIEWS}, again AS (SELECT doc_id FROM reviews SEMI JOIN labels USING (doc_id)),
store AS (
  SELECT platform, review_id, product_id, rating, text, n_chars, 'day1' AS user_level, doc_id
  FROM reviews WHERE doc_id NOT IN (SELECT doc_id FROM again)
  UNION ALL
  SELECT platform, review_id, 'moved', NULL, text || ' (edited)', n_chars, 'day2', doc_id
  FROM reviews WHERE doc_id IN (SELECT doc_id FROM again))"""

# What the landed pages hold after parsing: keys differ from the plain reviews.
LANDED = f"""WITH {REVIEWS}, {PAGES}, landed AS (
  SELECT platform, product_id, rating, text,
         CASE WHEN platform = 'jd' THEN CASE WHEN doc_id = 0 THEN 'g-0' ELSE review_id END
              WHEN doc_id % 3 = 0 THEN 'r-' || review_id ELSE 't-' || review_id END AS review_id
  FROM (SELECT * REPLACE (regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text) FROM paged))"""

DAMAGED = f"""WITH {REVIEWS}, paged AS (
  SELECT *, CAST(doc_id // 20 // 3 + CASE WHEN platform = 'jd' THEN 0 ELSE 1 END AS INTEGER) AS page FROM reviews),
placed AS (SELECT * REPLACE (regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text), CAST(row_number() OVER (
    PARTITION BY platform, product_id, page ORDER BY CASE WHEN platform = 'jd' THEN doc_id ELSE 0 END,
    CASE WHEN doc_id % 3 = 0 THEN '' ELSE 't-' || review_id END, 'r-' || review_id) - 1 AS INTEGER) AS seq FROM paged),
damaged AS (
  SELECT platform, product_id, rating, text, page, seq,
         CASE WHEN platform = 'jd' THEN CASE WHEN doc_id = 0 THEN 'g-0' ELSE review_id END
              WHEN doc_id % 3 = 0 THEN 'r-' || review_id ELSE 't-' || review_id END AS review_id
  FROM placed)"""

LANDED_SCORED = f"""{LANDED}, cleaned AS (SELECT * REPLACE ({_clean('text')} AS text) FROM landed),
{_scored('cleaned')}"""

TRIGRAMS = r"""padded AS (
  SELECT doc_id, lang, string_split(' ' || trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g')) || ' ', '') AS c
  FROM documents),
grams AS (SELECT doc_id, lang, c[i] || c[i + 1] || c[i + 2] AS gram
          FROM (SELECT *, unnest(range(1, len(c) - 1)) AS i FROM padded)),
trained AS (SELECT lang, gram, count(*) AS c FROM grams GROUP BY ALL),
totals AS (SELECT lang AS tag, ln(sum(c) + (SELECT count(DISTINCT gram) FROM trained)) AS log_total
           FROM trained GROUP BY lang),
counted AS (SELECT doc_id, gram, count(*) AS n FROM grams GROUP BY ALL),
gains AS (SELECT doc_id, t.lang AS tag, sum(n * ln(t.c + 1)) AS gain
          FROM counted JOIN trained t USING (gram) GROUP BY ALL),
sizes AS (SELECT doc_id, sum(n) AS n FROM counted GROUP BY ALL),
likelihood AS (SELECT doc_id, tag, round(coalesce(gain, 0) - n * log_total, 6) AS s
               FROM sizes CROSS JOIN totals LEFT JOIN gains USING (doc_id, tag))"""

DICTIONARY = r"""runs AS (SELECT run, count(*) AS n FROM
           (SELECT unnest(regexp_extract_all(text, '\p{L}+')) AS run FROM documents) GROUP BY ALL),
spots AS (SELECT n, string_split(run, '') AS c, run FROM runs),
starts AS (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM spots),
grams AS (SELECT n, array_to_string(c[i:i + k - 1], '') AS gram, k,
                 CASE WHEN i > 1 THEN c[i - 1] ELSE '' END AS l,
                 CASE WHEN i + k <= len(c) THEN c[i + k] ELSE '' END AS r
          FROM starts CROSS JOIN range(1, 5) AS ks(k) WHERE i + k - 1 <= len(c)),
counts AS (SELECT gram, sum(n) AS n FROM grams GROUP BY ALL),
total AS (SELECT sum(n) AS t FROM counts WHERE length(gram) = 1),
words AS (SELECT * FROM counts WHERE length(gram) > 1 AND n >= 20),
pmi AS (SELECT w.gram, w.n, min(ln(w.n * CAST(t AS DOUBLE) / (h.n * q.n))) AS pmi
        FROM words w CROSS JOIN range(1, 4) AS cuts(cut) CROSS JOIN total
        JOIN counts h ON h.gram = substr(w.gram, 1, cut) JOIN counts q ON q.gram = substr(w.gram, cut + 1)
        WHERE cut < length(w.gram) GROUP BY ALL),
le AS (SELECT gram, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS e
       FROM (SELECT gram, l, sum(n) AS n FROM grams GROUP BY ALL) GROUP BY ALL),
re AS (SELECT gram, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS e
       FROM (SELECT gram, r, sum(n) AS n FROM grams GROUP BY ALL) GROUP BY ALL)"""

LEARNED = f"""{DICTIONARY},
learned AS (SELECT pmi.gram AS term, CAST(pmi.n AS BIGINT) AS n, pmi, le.e AS l, re.e AS r
  FROM pmi JOIN le USING (gram) JOIN re USING (gram) WHERE pmi >= 1.0 AND least(le.e, re.e) >= 0.5)"""


def _price(share: str) -> str:
    return f"CAST(round(-ln({share}) * 1000000) AS BIGINT)"


# The words of every run: cheapest path from its end, then the words from its start.
LATTICE = rf"""{LEARNED},
sums AS (SELECT CAST(sum(n) AS DOUBLE) AS t, {_price('1 / CAST(sum(n) AS DOUBLE)')} AS unknown FROM learned),
costs AS (SELECT term, length(term) AS k, {_price('n / t')} AS cost FROM learned CROSS JOIN sums),
lruns AS (SELECT run, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')) AS run FROM documents) GROUP BY run),
place AS (SELECT run, unnest(range(1, length(run) + 1)) AS i FROM lruns),
hits AS (SELECT a.run, a.i, list({{'k': c.k, 'c': c.cost}}) AS es FROM (SELECT run, i, unnest(range(1, 5)) AS k FROM place) a
  JOIN costs c ON c.k = a.k AND c.term = substr(a.run, a.i, a.k) WHERE a.i + a.k - 1 <= length(a.run) GROUP BY ALL),
steps AS (SELECT a.run, a.i, list_append(coalesce(es, []), {{'k': CAST(1 AS BIGINT), 'c': unknown}}) AS es
  FROM place a CROSS JOIN sums LEFT JOIN hits h ON h.run = a.run AND h.i = a.i),
route(run, i, costs, lens) AS (
  SELECT run, length(run) + 1, [CAST(0 AS BIGINT)], CAST([] AS BIGINT[]) FROM lruns
  UNION ALL
  SELECT run, i - 1, list_prepend(best.c, costs), list_prepend(-best.k, lens) FROM (
    SELECT r.run, r.i, r.costs, r.lens, list_min(list_transform(s.es, lambda e: {{'c': e.c + r.costs[e.k], 'k': -e.k}})) AS best
    FROM route r JOIN steps s ON s.run = r.run AND s.i = r.i - 1)),
walk(run, lens, i, words) AS (
  SELECT run, lens, CAST(1 AS BIGINT), CAST([] AS VARCHAR[]) FROM route WHERE i = 1
  UNION ALL
  SELECT run, lens, i + lens[i], list_append(words, substr(run, i, lens[i])) FROM walk WHERE i <= length(run)),
cut AS (SELECT run, words FROM walk WHERE i > length(run))"""

# Stretches of single characters, cut by the cheapest tags.
UNKNOWN = rf"""{LATTICE},
segs AS (SELECT run, n, array_to_string(list_transform(words, lambda w: CASE WHEN length(w) = 1 THEN 'S'
  ELSE 'B' || repeat('M', length(w) - 2) || 'E' END), '') AS tags FROM cut JOIN lruns USING (run)),
tagged AS (SELECT substr(tags, i, 1) AS tag, CASE WHEN i > 1 THEN substr(tags, i - 1, 1) ELSE '' END AS before, substr(run, i, 1) AS char, n
  FROM segs JOIN place USING (run)),
kinds AS (SELECT count(DISTINCT char) AS kinds FROM tagged),
tags(tag, j) AS (VALUES ('B', 1), ('M', 2), ('E', 3), ('S', 4)),
sizes AS (SELECT tag, j, coalesce(sum(n), 0) AS size FROM tags LEFT JOIN tagged USING (tag) GROUP BY ALL),
met AS (SELECT tag, char, sum(n) AS n FROM tagged GROUP BY ALL),
chars AS (SELECT char, list({_price('(coalesce(n, 0) + 1) / CAST(size + kinds + 1 AS DOUBLE)')} ORDER BY j) AS es
  FROM (SELECT DISTINCT char FROM met) CROSS JOIN sizes CROSS JOIN kinds LEFT JOIN met USING (tag, char) GROUP BY char),
allowed(before, tag, j) AS (VALUES ('', 'B', 1), ('', 'S', 4), ('B', 'M', 2), ('B', 'E', 3), ('M', 'M', 2), ('M', 'E', 3),
  ('E', 'B', 1), ('E', 'S', 4), ('S', 'B', 1), ('S', 'S', 4)),
moves AS (SELECT before, tag, j, coalesce(sum(n), 0) AS n FROM allowed LEFT JOIN tagged USING (before, tag) GROUP BY ALL),
priced AS (SELECT before, j, {_price('(n + 1) / CAST(sum(n) OVER (PARTITION BY before) + 2 AS DOUBLE)')} AS c FROM moves),
grid AS (SELECT b.tag AS before, b.i, t.j, coalesce(c, 1125899906842624) AS c
  FROM (SELECT '' AS tag, 0 AS i UNION ALL SELECT tag, j FROM tags) b CROSS JOIN tags t LEFT JOIN priced p ON p.before = b.tag AND p.j = t.j),
model AS (SELECT list(c ORDER BY i, j) AS a FROM grid),
items AS (SELECT run, word, pos, length(word) = 1 AS single FROM (SELECT run, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM cut)),
isles AS (SELECT run, min(pos) AS pos, string_agg(word, '' ORDER BY pos) AS s, single FROM (SELECT *, CASE WHEN single
  THEN pos - row_number() OVER (PARTITION BY run, single ORDER BY pos) ELSE -pos END AS isle FROM items) GROUP BY run, single, isle),
asked AS (SELECT DISTINCT s FROM isles WHERE single AND length(s) > 1),
vit(s, i, c, p) AS (
  SELECT s, CAST(1 AS BIGINT), list_transform(range(1, 5), lambda j: a[j] + es[j]), ['B', 'M', 'E', 'S']
  FROM asked JOIN chars ON char = substr(s, 1, 1) CROSS JOIN model
  UNION ALL
  SELECT s, i + 1, list_transform(range(1, 5), lambda j: best[j].c + es[j]),
    list_transform(range(1, 5), lambda j: p[best[j].i] || substr('BMES', j, 1))
  FROM (SELECT v.s, v.i, v.p, es, list_transform(range(1, 5), lambda j:
      list_min(list_transform(range(1, 5), lambda i: {{'c': v.c[i] + a[4 * i + j], 'i': i}}))) AS best
    FROM vit v JOIN chars ON char = substr(v.s, v.i + 1, 1) CROSS JOIN model WHERE v.i < length(v.s))),
decoded AS (SELECT s, CASE WHEN c[3] <= c[4] THEN p[3] ELSE p[4] END AS tags FROM vit WHERE i = length(s)),
begun AS (SELECT s, list_append(list_filter(range(1, length(s) + 1), lambda i: substr(tags, i, 1) IN ('B', 'S')), length(s) + 1) AS b FROM decoded),
solved AS (SELECT s, list_transform(range(1, len(b)), lambda k: substr(s, b[k], b[k + 1] - b[k])) AS words FROM begun),
final AS (SELECT run, flatten(list(coalesce(words, [s]) ORDER BY pos)) AS words FROM isles LEFT JOIN solved USING (s) GROUP BY run)"""


def _cut_documents(ctes: str, cut: str) -> str:
    return rf"""WITH RECURSIVE {ctes},
pieces AS (SELECT doc_id, unnest(list) AS piece, generate_subscripts(list, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all(text, '{PATTERN}') AS list FROM documents)),
lists AS (SELECT doc_id, flatten(list(coalesce(words, [piece]) ORDER BY pos)) AS list FROM pieces LEFT JOIN {cut} ON run = piece GROUP BY doc_id)
SELECT doc_id, CAST(len(list) AS INTEGER) AS n_tokens, md5(array_to_string(list, ' ')) AS tokens_md5 FROM lists"""


# Terms met on all paths: sums of path shares ahead of and behind each position.
EXPECTED = rf"""{LATTICE},
shares AS (SELECT run, i, list_transform(list_filter(es, lambda e, x: e.k > 1 OR x = len(es)), lambda e: {{'k': e.k, 'w': exp(-e.c / 1000000.0::DOUBLE)}}) AS es FROM steps),
ahead(run, i, f) AS (
  SELECT run, length(run) + 1, [1.0::DOUBLE] FROM lruns
  UNION ALL
  SELECT a.run, a.i - 1, list_prepend(list_sum(list_transform(s.es, lambda e: e.w * a.f[e.k])), a.f)
  FROM ahead a JOIN shares s ON s.run = a.run AND s.i = a.i - 1),
behind(run, i, f) AS (
  SELECT run, CAST(1 AS BIGINT), [1.0::DOUBLE] FROM lruns
  UNION ALL
  SELECT b.run, b.i + 1, list_prepend(list_sum(list_transform(inward.es, lambda e: e.w * b.f[e.k])), b.f)
  FROM behind b JOIN (SELECT run, i + e.k AS i, list({{'k': e.k, 'w': e.w}}) AS es FROM (SELECT run, i, unnest(es) AS e FROM shares) GROUP BY ALL) inward
    ON inward.run = b.run AND inward.i = b.i + 1),
whole AS (SELECT run, f FROM ahead WHERE i = 1),
front AS (SELECT run, list_reverse(f) AS f FROM behind WHERE i = length(run) + 1),
met AS (SELECT substr(run, i, e.k) AS term, n * front.f[i] * e.w * whole.f[i + e.k] / whole.f[1] AS n
  FROM (SELECT run, i, unnest(es) AS e FROM shares) JOIN whole USING (run) JOIN front USING (run) JOIN lruns USING (run))
SELECT term, round(sum(n), 3) AS n FROM met WHERE term IN (SELECT term FROM learned) GROUP BY term"""


def _joined(select: str, key: str = "doc_id") -> str:
    return f"""WITH lists AS (SELECT {key}, {select} AS list FROM documents)
SELECT {key}, CAST(len(list) AS INTEGER) AS n_tokens, md5(array_to_string(list, ' ')) AS tokens_md5 FROM lists"""


ALL_TOKENS = f"regexp_extract_all(text, '{PATTERN}')"
KEPT_LIST = f"list_filter({ALL_TOKENS}, lambda t: t NOT IN ({_in(STOPWORDS)}))"

ORACLE: dict[str, str] = {
    "payload_pages": f"""WITH {REVIEWS}, {PAGES}
SELECT platform, product_id, page, CAST(count(*) AS INTEGER) AS n_items FROM paged GROUP BY ALL""",
    "archived_pages": f"""WITH {REVIEWS}, {PAGES}
SELECT platform, product_id, page, CAST(count(*) AS INTEGER) AS n_items FROM paged GROUP BY ALL""",
    "unwrap_jsonp": f"""WITH bodies AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '  fetchJSON_c1(' || text || ');' || chr(10)
  WHEN 1 THEN text ELSE 'fetchJSON_c2(' || text || ');x' END AS raw FROM documents),
stripped AS (SELECT doc_id, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS b FROM bodies),
opened AS (SELECT doc_id, CASE WHEN starts_with(b, 'fetchJSON') AND contains(b, '(') AND ends_with(b, ');')
  THEN substr(b, instr(b, '(') + 1, length(b) - instr(b, '(') - 2) ELSE b END AS p FROM stripped)
SELECT doc_id, {_md5('p', 'payload')} FROM opened""",
    "ingest_defaults": f"""{DAMAGED} SELECT platform, product_id, review_id, rating, {_md5('text', 'text')} FROM damaged WHERE page % 7 NOT IN (2, 4, 6)""",
    "quarantined_pages": f"{DAMAGED} SELECT DISTINCT platform, product_id, page, 'invalid JSON' AS error FROM damaged WHERE page % 7 = 2",
    "ingest_gaps": f"""{DAMAGED}, pages AS (SELECT DISTINCT platform, product_id, page FROM damaged WHERE page % 7 <> 6),
expected AS (SELECT platform, product_id, CAST(unnest(range(CASE WHEN platform = 'jd' THEN {FIRST_PAGE['jd']}
  ELSE {FIRST_PAGE['tmall']} END, last + 1)) AS INTEGER) AS page
  FROM (SELECT platform, product_id, max(page) AS last FROM pages GROUP BY ALL))
SELECT platform, product_id, page FROM expected ANTI JOIN pages USING (platform, product_id, page)""",
    "idless_reviews": f"SELECT platform, product_id, page, seq, text_md5, text_chars FROM ({DAMAGED} SELECT *, {_md5('text', 'text')} FROM damaged WHERE page % 7 = 4)",
    "parse_jd_reviews": f"""WITH {REVIEWS}, {PAGES},
own AS (SELECT *, regexp_replace('  ' || text || chr(10), '^\\s+|\\s+$', '', 'g') AS t FROM paged WHERE platform = 'jd')
SELECT platform, product_id, CASE WHEN doc_id = 0 THEN 'g-0' ELSE review_id END AS review_id, rating,
  CASE WHEN doc_id % 3 = 0 THEN 'nick' || review_id ELSE 'client ' || lang END AS user_id, lang AS user_level,
  CAST(n_chars AS INTEGER) AS helpful_votes, page, {_md5('t', 'text')}, {_shown(_SECOND)},
  'g-' || review_id AS raw_id FROM own""",
    "parse_tmall_reviews": f"""WITH {REVIEWS}, {PAGES},
own AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM paged WHERE platform = 'tmall')
SELECT platform, product_id, CASE WHEN doc_id % 3 = 0 THEN 'r-' ELSE 't-' END || review_id AS review_id,
  CAST(NULL AS INTEGER) AS rating, 'nick' || review_id AS user_id, lang AS user_level,
  CAST(NULL AS INTEGER) AS helpful_votes, page, {_md5('t', 'text')}, {_shown(_MINUTE)},
  'r-' || review_id AS raw_id FROM own""",
    "contiguous_pages": f"""WITH {REVIEWS}, {SIZES},
ends AS (SELECT platform, product_id, min(page) AS stop FROM sizes WHERE n_items = 0 GROUP BY ALL)
SELECT platform, product_id, page, n_items FROM sizes LEFT JOIN ends USING (platform, product_id)
WHERE stop IS NULL OR page < stop""",
    "page_gaps": f"""WITH {REVIEWS}, {SIZES}, landed AS (SELECT * FROM sizes WHERE n_items > 0),
expected AS (SELECT platform, product_id, CAST(unnest(range(CASE WHEN platform = 'jd' THEN {FIRST_PAGE['jd']}
  ELSE {FIRST_PAGE['tmall']} END, last + 1)) AS INTEGER) AS page
  FROM (SELECT platform, product_id, max(page) AS last FROM landed GROUP BY ALL))
SELECT platform, product_id, page FROM expected ANTI JOIN landed USING (platform, product_id, page)""",
    "route_platform": f"""WITH {REVIEWS} SELECT CASE WHEN lang = 'de' THEN 'other' ELSE platform END AS platform,
  CASE WHEN lang = 'de' THEN 'unsupported platform' WHEN n_chars > 700 THEN 'ok' ELSE 'invalid JSON' END AS status,
  count(*) AS pages FROM reviews GROUP BY ALL""",
    "stopword_list": r"""WITH lines AS (SELECT CASE WHEN lang = 'de' THEN '#' ELSE ' ' END || unnest(string_split(text, chr(10))) AS line
  FROM documents), terms AS (SELECT line, regexp_replace(line, '^\s+|\s+$', '', 'g') AS term FROM lines)
SELECT DISTINCT term FROM terms WHERE term <> '' AND NOT starts_with(line, '#')""",
    "coerce_int": r"""WITH d AS (SELECT event_id, regexp_extract(props, '(\d+)', 1) AS k FROM events)
SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(k AS INTEGER) WHEN 1 THEN CAST(k AS INTEGER)
  WHEN 3 THEN -CAST(k AS INTEGER) END AS parsed FROM d""",
    "parse_times": """SELECT event_id,
  CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS with_seconds,
  CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
                    WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:00') END AS with_minutes FROM events""",
    "review_fields": rf"""WITH f AS (SELECT *, CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN role END AS a,
  CASE WHEN role = 'user' THEN CAST(conv_id AS VARCHAR) END AS b,
  regexp_replace(' ' || chr(9) || chr(10) || text || chr(13) || chr(10) || ' ', '^\s+|\s+$', '', 'g') AS t FROM conversations)
SELECT conv_id, turn, coalesce(nullif(a, ''), nullif(b, ''), '') AS review_id, coalesce(nullif(a, ''), b) AS user_id,
  {_md5('t', 'text')} FROM f""",
    "strip_html": f"WITH s AS (SELECT page_id, {SHOWN} AS t FROM pages) SELECT page_id, {_md5('t', 'shown')} FROM s",
    "nfkc": f"SELECT doc_id, {_md5('nfc_normalize(text)', 'text')} FROM documents",
    "drop_urls": rf"""WITH t AS (SELECT page_id, regexp_replace('see ' || url || ' or' || chr(10) || url || chr(10) || html,
  'https?://\S+', '', 'g') AS t FROM pages) SELECT page_id, {_md5('t', 'text')} FROM t""",
    "squeeze_punct": f"""WITH t AS (SELECT doc_id, {_squeeze("replace(replace(text, '.', '!!!!'), ',', '。。。')")} AS t FROM documents)
SELECT doc_id, {_md5('t', 'text')} FROM t""",
    "squeeze_whitespace": f"WITH t AS (SELECT doc_id, {_tidy('text')} AS t FROM documents) SELECT doc_id, {_md5('t', 'text')} FROM t",
    "clean_review_text": f"WITH t AS (SELECT page_id, {_clean(SHOWN)} AS t FROM pages) SELECT page_id, {_md5('t', 'clean')} FROM t",
    "tokenize": _joined(ALL_TOKENS),
    "remove_stopwords": _joined(KEPT_LIST),
    "tokenize_with_dictionary": rf"""WITH hits AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\p{{L}}+')) AS term FROM documents),
terms AS (SELECT term FROM hits GROUP BY term HAVING count(*) >= 150 AND length(term) > 1),
pattern AS (SELECT string_agg(term, '|' ORDER BY length(term) DESC, term) || '|{PATTERN}' AS p FROM terms),
lists AS (SELECT doc_id, regexp_extract_all(text, p) AS list FROM documents CROSS JOIN pattern)
SELECT doc_id, CAST(len(list) AS INTEGER) AS n_tokens, md5(array_to_string(list, ' ')) AS tokens_md5 FROM lists""",
    "learn_dictionary": f"""WITH {LEARNED}
SELECT term, n, round(pmi, 6) AS pmi, round(l, 6) AS left_entropy, round(r, 6) AS right_entropy FROM learned""",
    "tokenize_lattice": _cut_documents(LATTICE, "cut"),
    "tokenize_unknown": _cut_documents(UNKNOWN, "final"),
    "reestimate_dictionary": f"WITH RECURSIVE {EXPECTED}",
    "detect_language": f"""WITH {TRIGRAMS},
best AS (SELECT doc_id, max((s, tag)) AS b FROM likelihood GROUP BY doc_id)
SELECT doc_id, b[2] AS language, round(b[1], 3) AS log_likelihood FROM best""",
    "language_posterior_folds": r"""WITH padded AS (
  SELECT doc_id, lang, doc_id % 2 AS fold, string_split(' ' || trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g')) || ' ', '') AS c
  FROM documents),
grams AS (SELECT doc_id, lang, fold, (unicode(c[i])::BIGINT * 1000003 + unicode(c[i + 1])::BIGINT * 8191 + unicode(c[i + 2])::BIGINT * 131) % 65536 AS bucket
          FROM (SELECT *, unnest(range(1, len(c) - 1)) AS i FROM padded)),
trained AS (SELECT 1 - fold AS fold, lang, bucket, count(*) AS n FROM grams GROUP BY ALL),
totals AS (SELECT fold, lang, ln(sum(n) + 65536) AS log_total FROM trained GROUP BY ALL),
priors AS (SELECT 1 - fold AS fold, lang, ln(count(*) / sum(count(*)) OVER (PARTITION BY fold)) AS log_prior
           FROM padded WHERE lang IS NOT NULL GROUP BY fold, lang),
counted AS (SELECT doc_id, fold, bucket, count(*) AS n FROM grams GROUP BY ALL),
gains AS (SELECT doc_id, t.lang, sum(g.n * ln(t.n + 1)) AS gain FROM counted g JOIN trained t USING (fold, bucket) GROUP BY ALL),
sizes AS (SELECT doc_id, fold, sum(n) AS n FROM counted GROUP BY ALL),
likelihood AS (SELECT sizes.doc_id, p.lang, round(log_prior + coalesce(gain, 0) - n * log_total, 6) AS s
  FROM sizes JOIN priors p USING (fold) JOIN totals USING (fold, lang) LEFT JOIN gains ON gains.doc_id = sizes.doc_id AND gains.lang = p.lang),
best AS (SELECT doc_id, max(s) AS top FROM likelihood GROUP BY doc_id),
posteriors AS (SELECT doc_id, 1 / sum(exp(s - top)) AS posterior, min(CASE WHEN s = top THEN lang END) AS lang
  FROM likelihood JOIN best USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CASE WHEN posterior >= 0.9 THEN posteriors.lang ELSE 'unknown' END AS language, round(posterior, 3) AS posterior
FROM documents LEFT JOIN posteriors USING (doc_id)""",
    "encode_lists": f"""WITH lists AS (SELECT doc_id, {ALL_TOKENS} AS list FROM documents),
coded AS (SELECT *, CAST(to_json(list) AS VARCHAR) AS j FROM lists)
SELECT doc_id, {_md5('j', 'json')}, CAST(len(list) AS INTEGER) AS n_tokens, md5(array_to_string(list, ' ')) AS tokens_md5 FROM coded""",
    "lexicon_membership": f"""WITH {REVIEWS}, {_tokens()}, {KEPT}
SELECT term, count(*) AS n FROM kept WHERE term IN ({_in(LEXICON.positive + LEXICON.negative + LEXICON.negation)}) GROUP BY ALL""",
    "lexicon_hits": f"""WITH {REVIEWS} SELECT review_id, CAST({_hits('text')} AS BIGINT) AS hits,
  CASE WHEN {_negated('text')} THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS factor,
  round(greatest(length(text) / 20.0, 1.0)::DOUBLE, 6) AS divisor FROM reviews""",
    "rule_sentiment": f"WITH {SCORED} SELECT {LABELS} FROM scored",
    "sentiment_fallback": f"WITH {SCORED} SELECT {LABELS} FROM scored",
    "model_label_mapping": r"""WITH m AS (SELECT doc_id, lower(CASE WHEN lang = 'de' THEN 'LABEL_' || quality
    WHEN lang = 'fr' THEN CAST(quality AS VARCHAR) WHEN quality = 1 THEN 'Positive' ELSE 'NEG' END) AS name,
  0.5::DOUBLE + (doc_id % 50) / 100 AS p, CASE WHEN toxic = 1 THEN ' ' ELSE text END AS t
  FROM labels JOIN documents USING (doc_id)),
k AS (SELECT doc_id, p, CASE WHEN trim(t) = '' THEN 'neutral' WHEN contains(name, 'pos') OR name = '1' THEN 'positive'
  WHEN contains(name, 'neg') OR name = '0' THEN 'negative' ELSE 'neutral' END AS sentiment_label FROM m)
SELECT doc_id, sentiment_label, round(CASE sentiment_label WHEN 'positive' THEN p WHEN 'negative' THEN -p ELSE 0 END, 6)
  AS sentiment_score FROM k""",
    "model_sentiment": f"WITH {REVIEWS} SELECT platform, review_id, TRUE AS sign_fits, TRUE AS bounded FROM reviews",
    "analyze_by_saved_model": f"WITH {REVIEWS} SELECT platform, review_id, TRUE AS sign_fits FROM reviews",
    "custom_backend": f"""WITH {REVIEWS} SELECT platform, review_id, CASE WHEN length(text) > 700 THEN 'positive'
  WHEN length(text) < 300 THEN 'negative' ELSE 'neutral' END AS sentiment_label, round(least(length(text) / 1000, 1.0::DOUBLE), 6) AS sentiment_score FROM reviews""",
    "custom_tokenizer": f"""WITH {REVIEWS}, {_textrank(text="lower(text)", pattern=chr(92) + "p{L}+")}
SELECT review_id, rank, term, score FROM textrank WHERE rank <= 10""",
    "analyze_by_settings": f"""WITH {SCORED}, {_textrank()},
kw AS (SELECT review_id, string_agg(term, ' ' ORDER BY rank) AS keywords FROM textrank WHERE rank <= 3 GROUP BY ALL)
SELECT {LABELS}, coalesce(keywords, '') AS keywords FROM scored LEFT JOIN kw USING (review_id)""",
    "process_with_language_model": f"""WITH {TRIGRAMS}, {REVIEWS}, best AS (SELECT doc_id, max((s, tag)) AS b FROM likelihood GROUP BY doc_id),
c AS (SELECT *, {_clean('text')} AS t FROM reviews),
lists AS (SELECT *, list_filter(regexp_extract_all(t, '{PATTERN}'), lambda x: x NOT IN ({_in(STOPWORDS)})) AS list FROM c)
SELECT platform, review_id, b[2] AS language, CAST(len(list) AS INTEGER) AS n_tokens, md5(array_to_string(list, ' ')) AS tokens_md5
FROM lists JOIN best USING (doc_id)""",
    "lda_topics": _topics(),
    "process_reviews_layer": f"""WITH {REVIEWS}, c AS (SELECT *, {_clean(_unescape("' ' || text || '  &amp; !!!!!'"))} AS t FROM reviews),
lists AS (SELECT *, list_filter(regexp_extract_all(t, '{PATTERN}'), lambda x: x NOT IN ({_in(STOPWORDS)})) AS list FROM c)
SELECT platform, review_id, rating, 'unknown' AS language, {_md5('t', 'clean')},
  CAST(len(list) AS INTEGER) AS n_tokens, md5(array_to_string(list, ' ')) AS tokens_md5 FROM lists""",
    "analyze_reviews_layer": f"""WITH {SCORED}, {_textrank()},
kw AS (SELECT review_id, string_agg(term, ' ' ORDER BY rank) AS keywords FROM textrank WHERE rank <= 5 GROUP BY ALL)
SELECT {LABELS}, coalesce(keywords, '') AS keywords FROM scored LEFT JOIN kw USING (review_id)""",
    "upsert_reviews": f"""{STORED} SELECT platform, review_id, product_id, rating, CAST(n_chars AS INTEGER) AS helpful_votes,
  user_level, {_md5('text', 'text')} FROM store""",
    "existing_review_ids": f"{STORED} SELECT DISTINCT review_id FROM store WHERE platform = 'jd' AND product_id = 'moved'",
    "latest_by_key": """SELECT event_type, user_id, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "fresh_reviews": f"WITH {REVIEWS} SELECT platform, product_id, review_id FROM reviews ANTI JOIN labels USING (doc_id)",
    "run_summary": f"""WITH {REVIEWS} SELECT platform, product_id, count(*) AS fetched,
  count(*) FILTER (quality IS NULL) AS fresh, count(*) FILTER (quality = 1) AS analyzed
FROM reviews LEFT JOIN labels USING (doc_id) GROUP BY ALL""",
    "retain_raw": f"""{STORED} SELECT platform, review_id, user_level FROM store
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""",
    "incremental_ingest": f"{LANDED} SELECT platform, product_id, review_id, rating, {_md5('text', 'text')} FROM landed",
    "analyzed_stream": f"{LANDED_SCORED} SELECT {ANALYZED} FROM scored",
    "load_landed_reviews": f"{LANDED_SCORED} SELECT {ANALYZED} FROM scored",
    "textrank_keywords": f"""WITH {REVIEWS}, {_textrank()}
SELECT review_id, rank, term, score FROM textrank WHERE rank <= 10""",
    "doc_frequency": _DOC_FREQUENCY,
    "doc_frequency_by_batches": _DOC_FREQUENCY,
    "tfidf_keywords": _tfidf("", 20),
    "tfidf_by_product": _tfidf("platform, product_id", 10),
    "tfidf_of_kept_frequencies": _tfidf("platform, product_id", 10),
    "sentiment_distribution": f"WITH {SCORED} SELECT sentiment_label, count(*) AS count FROM scored GROUP BY ALL",
    "sentiment_distribution_by_product": f"""WITH {SCORED}
SELECT platform, product_id, sentiment_label, count(*) AS count FROM scored GROUP BY ALL""",
    "headline_metrics": f"""WITH {SCORED} SELECT platform, count(*) AS total,
  count(*) FILTER (sentiment_label = 'positive') AS positive, count(*) FILTER (sentiment_label = 'negative') AS negative
FROM scored GROUP BY ALL""",
    "rating_vs_sentiment": f"""WITH {SCORED} SELECT platform, review_id, rating, sentiment_label,
  round(score, 6) AS sentiment_score, md5(text) AS clean_md5 FROM scored WHERE rating IS NOT NULL""",
    "rating_correlation": f"""WITH {SCORED} SELECT platform, count(rating) AS rated,
  round(corr(rating, score), 6) AS correlation FROM scored GROUP BY ALL""",
    "sentiment_by_rating": f"""WITH {SCORED} SELECT product_id, rating, count(*) AS reviews,
  round(avg(score), 6) AS mean_score FROM scored WHERE rating IS NOT NULL GROUP BY ALL""",
    "token_frequencies": f"WITH {REVIEWS}, {_tokens()}, {KEPT} SELECT term, count(*) AS n FROM kept GROUP BY ALL",
    "word_cloud_terms": f"""WITH {REVIEWS}, {_tokens()}, {KEPT}
SELECT term, count(*) AS n FROM kept GROUP BY ALL ORDER BY n DESC, term LIMIT 200""",
    "heavy_hitter_terms": f"""WITH {REVIEWS}, {_tokens()}, {KEPT}
SELECT term, count(*) AS n FROM kept GROUP BY ALL ORDER BY n DESC, term LIMIT 200""",
    "top_terms": f"""WITH {SCORED}, {_tokens('scored')}, {KEPT},
counts AS (SELECT platform, product_id, term, count(*) AS n FROM kept WHERE sentiment_label = 'positive' GROUP BY ALL)
SELECT platform, product_id, CAST(rank AS INTEGER) AS rank, term, n FROM (SELECT *, row_number() OVER
  (PARTITION BY platform, product_id ORDER BY n DESC, term) AS rank FROM counts) WHERE rank <= 10""",
    "complaints_and_strengths": f"""WITH {SCORED}, {_textrank()},
kw AS (SELECT s.platform, s.product_id, s.sentiment_label, t.term FROM textrank t JOIN scored s USING (review_id) WHERE rank <= 5),
{_lists('platform, product_id', 'kw')}""",
    "product_insights": f"""WITH {SCORED}, {_tokens('scored')}, {KEPT},
{_lists('platform, product_id', 'kept', "platform = 'jd' AND product_id = 'src0'")}""",
    "rolling_sentiment": _rolling("user_id"),
    "rolling_sentiment_overall": _rolling(""),
    "list_analyzed": f"WITH {SCORED} SELECT {ANALYZED} FROM scored WHERE platform = 'jd'",
    "list_reviews": f"WITH {SCORED} SELECT {ANALYZED} FROM scored WHERE platform = 'tmall' ORDER BY platform, review_id LIMIT 50",
    "review_lines": f"""WITH {SCORED} SELECT printf('[%s/%s/%s] %8s %+.2f | %s', platform, product_id, review_id,
  sentiment_label, score, substr(text, 1, 80)) AS line FROM scored WHERE product_id = 'src4'
ORDER BY platform, review_id LIMIT 20""",
}
