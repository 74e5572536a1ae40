"""SQL that the queries of this subpackage must agree with, where SQL can say what they compute."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"'[^\x20\x09-\x0D]+'"


def small(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def words(x: str, pattern: str = WORD) -> str:
    return f"regexp_extract_all({x}, {pattern})"


LINE_DEDUP = rf"""
WITH l AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, {small(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS key FROM l),
f AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, coalesce(k.doc_id <> f.first, false) AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""

WARC = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f"""

# the closure lists every pair of a component: right for components of up to some hundreds of documents
NGRAM_JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {words(small("coalesce(text, '')"))} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g GROUP BY 1, 2),
links AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * o >= 75 * (x.n + y.n - o)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(r.b), d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id"""

SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT doc_id, {words("coalesce(text, '')")} AS w FROM documents),
x AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS first FROM x GROUP BY h),
gone AS (SELECT DISTINCT x.doc_id, unnest(range(i, i + 50)) AS pos FROM x JOIN f USING (h) WHERE first < x.doc_id),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
k AS (
  SELECT t.doc_id, count(g.pos) AS n_removed,
    string_agg(word, ' ' ORDER BY t.pos) FILTER (g.pos IS NULL) AS kept
  FROM t LEFT JOIN gone g ON g.doc_id = t.doc_id AND g.pos = t.pos GROUP BY t.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""

ALPHANUMERIC = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
DECONTAMINATE = rf"""
WITH d AS (SELECT doc_id, {words(small("coalesce(text, '')"), ALPHANUMERIC)} AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, w, least(10, len(w)) AS k
  FROM (SELECT item_id, {words(small("coalesce(text, '')"), ALPHANUMERIC)} AS w FROM benchmark) WHERE len(w) > 0),
p AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
x AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM d, (SELECT DISTINCT k FROM b) WHERE len(w) >= k)),
m AS (SELECT x.doc_id, x.k, i, item FROM x JOIN p ON x.k = p.k AND x.g = p.g),
hit AS (
  SELECT doc_id, count(*) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS pos FROM m) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN found ON found.doc_id = d.doc_id"""

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, {words("coalesce(text, '')")} AS w FROM documents),
l AS (
  SELECT doc_id, list_filter(string_split(x, chr(10)), lambda z: regexp_matches(z, '[^\x20\x09-\x0D]')) AS ls FROM d),
t AS (
  SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
r AS (SELECT doc_id, g FROM t GROUP BY doc_id, g HAVING count(*) >= 2),
c AS (
  SELECT doc_id, count(*) AS n FROM (
    SELECT DISTINCT t.doc_id, unnest(range(i, i + 3)) AS pos FROM t JOIN r ON r.doc_id = t.doc_id AND r.g = t.g)
  GROUP BY doc_id),
n AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(x, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
    len(regexp_extract_all(x, '[A-Z]')) AS capitals, len(regexp_extract_all(x, '[a-z]')) AS small
  FROM d JOIN l ON l.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM n)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR capitals > small
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM b"""


def crc32(x: str) -> str:
    """Unsigned crc32 of an ASCII string: a byte at a time, bit by bit."""
    step = "lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    byte = f"lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), {step})"
    codes = f"list_transform(string_split({x}, ''), lambda z: CAST(ascii(z) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), {byte}), 4294967295)"


def field(x: str) -> str:
    return f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || {x}, '-')"


def merkle(levels: int = 8, top: int = 3) -> str:
    """Trees of eight children, level by level: for up to 8**levels documents of a language, 8**top languages."""
    leaf = lambda text: f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"

    def tree(name, depth):
        """Nodes (k, pos, d, n) of each level, with left and right siblings."""
        run = "PARTITION BY k, pos // 8 ORDER BY pos ROWS BETWEEN"
        for i in range(depth + 1):
            yield f"""{name}{i}s AS (SELECT *, coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{i})"""
            yield f"""{name}{i + 1} AS (
  SELECT k, pos // 8 AS pos, (n + 7) // 8 AS n, CASE WHEN n = 1 THEN d ELSE sha256(d || r) END AS d
  FROM {name}{i}s WHERE pos % 8 = 0)"""

    parts = [
        f"""rows_ AS (
  SELECT doc_id, coalesce('=' || lang, '') AS k, {leaf("text")} AS leaf,
    CASE WHEN {crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")}
      ELSE {leaf("text")} END AS claimed FROM documents)""",
        """a0 AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n, leaf AS d
  FROM rows_)""",
        *tree("a", levels),
        f"""b0 AS (
  SELECT 0 AS k, k AS lang, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n, d FROM a{levels + 1})""",
        *tree("b", top),
        "p0 AS (SELECT doc_id, k, leaf, pos, claimed AS f, '' AS proof FROM a0)",
    ]
    for i in range(levels + top + 1):
        at, level = f"a{i}s" if i < levels else f"b{i - levels}s", i if i < levels else i - levels
        place = f"x.k = p.k AND x.pos = p.pos // {8**level}"
        if i == levels:
            parts.append(
                f"""p{i}t AS (SELECT p.doc_id, p.leaf, p.f, p.proof, b.d AS subroot, b.pos, 0 AS k
  FROM p{i} p JOIN b0 b ON b.lang = p.k)"""
            )
        parts.append(
            f"""p{i + 1} AS (SELECT p.* EXCLUDE (f, proof), CASE WHEN x.n = 1 THEN p.f ELSE sha256(x.l || p.f || x.r) END AS f,
    p.proof || x.l || x.r AS proof
  FROM p{i}{"t" if i == levels else ""} p JOIN {at} x ON {place})"""
        )
    last = f"p{levels + top + 1}"
    return f"""WITH {", ".join(parts)}
SELECT doc_id, leaf, subroot, b.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = b.d AS verified
FROM {last} JOIN b{top + 1} b ON true"""


TRIE = rf"""
WITH t AS (
  SELECT conv_id, turn, length(coalesce(text, '')) AS size,
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list(g ORDER BY turn NULLS FIRST, g) AS gs, list(size ORDER BY turn NULLS FIRST, g) AS sizes,
    {crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM t GROUP BY conv_id),
r AS (
  SELECT c.conv_id, coalesce(b.gs, [])[1:c.h] || c.gs[c.h + 1:] AS gs,
    coalesce(b.sizes, [])[1:c.h] || c.sizes[c.h + 1:] AS sizes
  FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 100),
m AS (
  SELECT conv_id, d, array_to_string(gs[1:d], ',') AS key, CASE WHEN d > 0 THEN array_to_string(gs[1:d - 1], ',') END AS up,
    CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size, d = len(gs) AS ends
  FROM (SELECT *, unnest(range(0, len(gs) + 1)) AS d FROM r)),
n AS (
  SELECT key, up, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS own,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM m GROUP BY key, up, d),
k AS (SELECT up, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
a AS (SELECT m.key AS top, n.own, k.up IS NULL AS leaf FROM n LEFT JOIN k ON k.up = n.key
  JOIN m ON m.conv_id = n.conv_id AND m.d <= n.d),
s AS (SELECT top, count(*) FILTER (leaf) AS n_leaves, CAST(sum(own) AS BIGINT) AS saved_tokens FROM a GROUP BY top)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
  saved_tokens, n.ends_sha256
FROM n JOIN s ON s.top = n.key LEFT JOIN k ON k.up = n.key LEFT JOIN n p ON p.key = n.up"""


ORACLE_SQL = {
    "op1_line_dedup": LINE_DEDUP,
    "op2_warc_bundles": WARC,
    "op4_ngram_jaccard": NGRAM_JACCARD,
    "op5_substring_dedup": SUBSTRING_DEDUP,
    "op6_decontaminate": DECONTAMINATE,
    "op9_quality_rules": QUALITY,
    "op11_merkle_manifest": merkle(),
    "op12_conversation_trie": TRIE,
}
