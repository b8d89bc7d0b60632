"""DuckDB SQL that states the rows of the queries that SQL can express."""

from __future__ import annotations

from vitrine.llm import ngram_join, substring_dedup, suffix_dedup
from vitrine.llm.decontaminate import MIN_SHARE, MIN_TOKENS, WINDOW
from vitrine.llm.secrets import RULES, Rule

# The rule itself, without seeds: equal tokens of an item and a document at one shift, counted in
# every window of the item. A window that starts at an equal token and leaves the item has no more of
# them than the last window, which the first equal token inside it stands for.
_FEWEST = f"ceil({MIN_TOKENS} * {MIN_SHARE})"


def decontamination_ctes(documents: str = "documents", prefix: str = "") -> str:
    """CTEs ending in ``{prefix}overlap(doc_id, item_id, n_match, n_window)``."""
    p = prefix

    def words(table: str, key: str) -> str:
        return (f"SELECT {key}, w, len(w) AS size, UNNEST(range(len(w))) AS pos, UNNEST(w) AS word FROM (SELECT {key}, "
                "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w "
                f"FROM (SELECT DISTINCT {key}, text FROM {table} WHERE {key} IS NOT NULL)) WHERE len(w) >= {MIN_TOKENS}")

    return f"""
{p}d AS ({words(documents, 'doc_id')}),
{p}b AS ({words('benchmark', 'item_id')}),
{p}eq AS (
    SELECT doc_id, item_id, d.w AS dw, b.w AS bw, d.pos - b.pos AS shift, b.pos, least({WINDOW}, b.size) AS size
    FROM {p}d d JOIN {p}b b USING (word)),
{p}near AS (
    SELECT doc_id, item_id, size, count(*) OVER (PARTITION BY doc_id, item_id, hash(dw), hash(bw), shift ORDER BY pos
        RANGE BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS n
    FROM {p}eq QUALIFY count(*) OVER (PARTITION BY doc_id, item_id, hash(dw), hash(bw), shift) >= {_FEWEST}),
{p}overlap AS (
    SELECT doc_id, item_id, CAST(max(n) AS BIGINT) AS n_match, CAST(max(size) AS BIGINT) AS n_window
    FROM {p}near WHERE n >= ceil(size * {MIN_SHARE}) GROUP BY doc_id, item_id)"""


DECONTAMINATION = (f"WITH {decontamination_ctes()}\n"
                   "SELECT doc_id, item_id, n_match, n_window FROM overlap")


# -- secret scans ----------------------------------------------------------------------

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secret_matches(rank: int, rule: Rule) -> str:
    rx = _quoted(rule.pattern)
    return f"""
m{rank} AS (
    SELECT rid, m, g, i, sum(length(b) + length(m)) OVER (PARTITION BY rid ORDER BY i) AS stop
    FROM (SELECT rid, unnest(regexp_extract_all(t, {rx})) AS m,
                 unnest(regexp_extract_all(t, {rx}, {rule.group})) AS g,
                 unnest(string_split_regex(t, {rx})) AS b,
                 unnest(range(1, len(regexp_extract_all(t, {rx})) + 1)) AS i
          FROM texts) WHERE m IS NOT NULL),
s{rank} AS (SELECT rid, {rank} AS rank, {str(rule.base).lower()} AS base,
                   '{rule.kind}:' || CAST(stop - length(m) AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span,
                   stop - length(m) AS start
            FROM m{rank} WHERE length(g) >= {rule.min_length})"""


def _secret_scan() -> str:
    listed = "coalesce(string_agg(span, ',' ORDER BY start, rank)"
    counts = ", ".join(f"CAST(count(*) FILTER (rank = {k}) AS BIGINT) AS n_{rule.kind}"
                       for k, rule in enumerate(RULES) if rule.base)
    return ("WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t "
            "FROM documents)," + ",".join(_secret_matches(k, r) for k, r in enumerate(RULES))
            + ", found AS (" + " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(len(RULES))) + ")\n"
            + f"SELECT doc_id, {counts}, sha256({listed} FILTER (base), '')) AS base_sha256, "
            + f"{listed}, '') AS spans\nFROM texts LEFT JOIN found USING (rid) GROUP BY rid, doc_id")


SECRET_SCAN = _secret_scan()


# -- repeated passages and byte strings ------------------------------------------------

SUBSTRING_DEDUP = f"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
               FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM texts),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + {substring_dedup.WINDOW - 1}], ' ') AS v
            FROM places WHERE i + {substring_dedup.WINDOW - 1} <= len(w)),
earliest AS (SELECT v, min((doc_id, i)) AS place FROM windows GROUP BY v HAVING count(*) > 1),
later AS (SELECT doc_id, i FROM windows JOIN earliest USING (v) WHERE (doc_id, i) <> place),
judged AS (SELECT p.doc_id, p.i, p.w[p.i] AS word,
                  max(CASE WHEN l.i IS NULL THEN 0 ELSE 1 END) OVER (
                      PARTITION BY p.doc_id ORDER BY p.i
                      ROWS BETWEEN {substring_dedup.WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone
           FROM places p LEFT JOIN later l ON l.doc_id = p.doc_id AND l.i = p.i),
kept AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed,
                string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS rest FROM judged GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(rest, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)"""

# Bytes are pairs of hexadecimal digits; texts are cut into overlapping blocks, as substr
# walks from a string's start; strings are compared by a 64-bit hash of their digits.
_STRING, _BLOCK = suffix_dedup.LENGTH, 512
SUFFIX_DEDUP = f"""
WITH texts AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
blocks AS (SELECT doc_id, base, substr(h, 2 * base + 1, {2 * (_BLOCK + _STRING)}) AS s,
                  length(h) // 2 - base AS n
           FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2, {_BLOCK})) AS base FROM texts)),
places AS (SELECT doc_id, base + k AS i, substr(s, 2 * k + 1, 2) AS byte,
                  CASE WHEN n - k >= {_STRING} THEN hash(substr(s, 2 * k + 1, {2 * _STRING})) END AS v
           FROM (SELECT *, unnest(range(0, least(n, {_BLOCK}))) AS k FROM blocks)),
first_doc AS (SELECT v, min(doc_id) AS least FROM places WHERE v IS NOT NULL
              GROUP BY v HAVING min(doc_id) < max(doc_id)),
judged AS (SELECT doc_id, i, byte, max(CASE WHEN least < doc_id THEN 1 ELSE 0 END) OVER (
                      PARTITION BY doc_id ORDER BY i
                      ROWS BETWEEN {_STRING - 1} PRECEDING AND CURRENT ROW) AS gone
           FROM places LEFT JOIN first_doc USING (v)),
runs AS (SELECT *, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM judged),
kept AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed,
                count(*) FILTER (gone = 1 AND before = 0) AS n_spans,
                string_agg(byte, '' ORDER BY i) FILTER (gone = 0) AS rest FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(rest, ''))) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)"""


# -- n-gram Jaccard join ---------------------------------------------------------------

NGRAM_JOIN = f"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + {ngram_join.WORDS - 1}], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {ngram_join.WORDS - 2}))) AS i
          FROM texts WHERE len(w) >= {ngram_join.WORDS})
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM texts WHERE len(w) BETWEEN 1 AND {ngram_join.WORDS - 1}),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
           FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT c.a, c.b, c.n = x.n AND c.n = y.n AS same
          FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b
          WHERE c.n >= {ngram_join.THRESHOLD} * (x.n + y.n - c.n)),
reached(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT doc_id,
       least(doc_id, (SELECT min(b) FROM reached r WHERE r.a = doc_id)) AS class_id,
       least(doc_id, (SELECT min(b) FROM links l WHERE l.a = doc_id AND l.same)) AS copy_of,
       CAST((SELECT count(*) FROM links l WHERE l.a = doc_id) AS BIGINT) AS n_links
FROM texts"""
