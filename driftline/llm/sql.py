"""DuckDB SQL that gives the rows of some queries."""

from __future__ import annotations

from . import rules

WORDS = r"list_filter(string_split_regex(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, {WORDS.format(f"translate(text, '{UPPER}', '{LOWER}')")} AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
links AS (
  SELECT a.r AS a, b.r AS b FROM s a JOIN s b ON a.s = b.s AND a.r < b.r JOIN n na ON na.r = a.r JOIN n nb ON nb.r = b.r
  GROUP BY a.r, b.r, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
named AS (SELECT reach.a AS r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY reach.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN named USING (r) LEFT JOIN n USING (r)
"""

REPEATED = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format('text')} AS w FROM documents),
windows AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY s) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM again),
each_ AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM each_ ANTI JOIN gone USING (r, i) GROUP BY r),
removed AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN removed USING (r) LEFT JOIN kept USING (r)
"""


def _distance(p: str, q: str) -> str:
    """Of two lists of counts, as rules.distance."""
    n, m = f"list_sum({p})", f"list_sum({q})"
    def part(a, b):
        return f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
    x, y = f"({p}[i]::DOUBLE / {n})", f"({q}[i]::DOUBLE / {m})"
    return (f"CASE WHEN {n} > 0 AND {m} > 0 THEN sqrt(greatest(0.0, list_sum(list_transform(range(1, len({p}) + 1), "
            f"lambda i: {part(x, y)} + {part(y, x)})) / 2)) ELSE 0.0 END")


CAPITAL, DIGIT, MARK, SYMBOL = r"[^\p{Lu}]+", "[^0-9]+", r"[^.,;:!?''\"()\-]+", "[^#*$%&|<>]+"
SPACE = r"[\x20\x09-\x0D]+"


def _left(pattern: str) -> str:
    return f"length(regexp_replace(body, '{pattern}', '', 'g'))"


DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS body, {WORDS.format('text')} AS w FROM documents),
grams AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM grams) WHERE n > 1),
covered AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + 5)) AS i FROM again) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(body, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
f AS (
  SELECT r, doc_id, lang, w, length(body) AS size, len(w) AS n_words, {_left(SPACE)} AS word_chars, {_left(SYMBOL)} AS n_symbols,
         coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, {_left(CAPITAL)} AS capitals, {_left(DIGIT)} AS digits, {_left(MARK)} AS marks
  FROM d LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)),
c AS (SELECT *, [capitals, digits, marks, n_symbols, size - word_chars, word_chars - capitals - digits - marks - n_symbols] AS classes FROM f),
ref AS (SELECT lang, [{", ".join(f"sum(classes[{i}])" for i in range(1, 7))}] AS ref_classes, sum(n_words) AS all_words FROM c GROUP BY lang),
words AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(w) AS word FROM d) GROUP BY ALL),
common AS (SELECT lang, word, n FROM words JOIN ref USING (lang) WHERE n >= {rules.COMMON}::DOUBLE * all_words),
pairs AS (SELECT r, common.lang, word, common.n AS q, coalesce(own.n, 0) AS p
  FROM d JOIN common USING (lang) LEFT JOIN (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(w) AS word FROM d) GROUP BY ALL) own USING (r, word)),
cells AS (SELECT r, list(p ORDER BY word) AS p, list(q ORDER BY word) AS q FROM pairs GROUP BY r),
both_ AS (
  SELECT c.*, ref_classes, list_append(coalesce(p, []), n_words - coalesce(list_sum(p), 0)) AS p, list_append(coalesce(q, []), all_words - coalesce(list_sum(q), 0)) AS q
  FROM c JOIN ref USING (lang) LEFT JOIN cells USING (r)),
j AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         CASE WHEN size >= {rules.CLASS_LEAST} THEN {_distance("classes", "ref_classes")} ELSE 0.0 END AS cd,
         CASE WHEN n_words >= {rules.WORD_LEAST} THEN {_distance("p", "q")} ELSE 0.0 END AS wd FROM both_)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(cd, 6) AS class_distance, round(wd, 6) AS word_distance,
       NOT base_failed AND cd <= {rules.CLASS_LIMIT} AND wd <= {rules.WORD_LIMIT} AS kept FROM j
"""

#: The trie of conversations: prefixes as lists of (role, text); the checksum of a number's decimal text bit by bit.
TRIE = """
WITH own AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce("text", '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce("text", '')) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
crc AS (
  SELECT conv_id, l, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 4 AS h
  FROM own),
built AS (
  SELECT c.conv_id, list_concat(coalesce(b.l[1:c.h], []), coalesce(c.l[c.h + 1:], [])) AS l
  FROM crc c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
p AS (SELECT conv_id, len(l) AS n, d, l[1:d] AS prefix FROM (SELECT conv_id, l, unnest(range(len(l) + 1)) AS d FROM built)),
nodes AS (
  SELECT row_number() OVER () AS id, * FROM (
    SELECT d, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CASE WHEN n = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS ends
    FROM p GROUP BY d, prefix)),
up AS (SELECT id, d AS own_d, k, prefix[1:k] AS prefix FROM (SELECT id, d, prefix, unnest(range(d + 1)) AS k FROM nodes)),
pairs AS (SELECT v.id AS above, up.id AS below, up.own_d - v.d AS steps FROM up JOIN nodes v ON v.d = up.k AND v.prefix = up.prefix),
kids AS (SELECT above AS id, count(CASE WHEN steps = 1 THEN 1 END) AS n_children FROM pairs GROUP BY above),
valued AS (
  SELECT n.*, n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(prefix[d].t, '[^\\x20\\x09-\\x0D]+')) END AS saved
  FROM nodes n JOIN kids USING (id)),
sums AS (
  SELECT above AS id, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(b.saved) AS saved_tokens
  FROM pairs JOIN valued b ON b.id = below GROUP BY above)
SELECT v.conv_id, v.d AS depth, a.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM valued v JOIN sums s USING (id) LEFT JOIN pairs q ON q.below = v.id AND q.steps = 1 LEFT JOIN nodes a ON a.id = q.above
"""
