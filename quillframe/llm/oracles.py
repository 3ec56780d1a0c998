"""DuckDB SQL for the operators that SQL can express; each is a plain version without any index."""

from __future__ import annotations

# windows of words are joined by one space, which no word holds
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(column: str, pattern: str, lower: bool) -> str:
    text = f"coalesce({column}, '')"
    return f"regexp_extract_all({f"translate({text}, '{_UPPER}', '{_LOWER}')" if lower else text}, '{pattern}')"


REPEATED_BYTES = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, s, md5(substring(h, CAST(2 * s + 1 AS BIGINT), 400)) AS d FROM (SELECT doc_id, h, unnest(generate_series(0, length(h) // 2 - 200)) AS s FROM t WHERE length(h) >= 400)),
twice AS (SELECT d FROM w GROUP BY d HAVING count(*) > 1),
hit AS (SELECT doc_id, s, s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 200 IS NOT FALSE AS opens FROM w WHERE d IN (SELECT d FROM twice)),
span AS (SELECT doc_id, min(s) AS a, max(s) + 200 AS b FROM (SELECT doc_id, s, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM hit) GROUP BY doc_id, k),
ends AS (SELECT doc_id, a, b FROM span UNION ALL SELECT doc_id, length(h) // 2, NULL FROM t),
kept AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b NULLS LAST), 0) AS start FROM ends),
text AS (SELECT doc_id, string_agg(substring(h, CAST(2 * start + 1 AS BIGINT), CAST(2 * (a - start) AS BIGINT)), '' ORDER BY a, start) AS rest FROM kept JOIN t USING (doc_id) GROUP BY doc_id)
SELECT t.doc_id, length(h) // 2 AS n_bytes, length(h) // 2 - length(rest) // 2 AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(rest)) AS kept_sha256
FROM t JOIN text ON t.doc_id = text.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM span GROUP BY doc_id) AS c ON t.doc_id = c.doc_id
"""

REPEATED_WORDS = f"""
WITH t AS (SELECT doc_id, {_words("text", _SPACED, False)} AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(list_slice(w, s, s + 19), ' ') AS x FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS s FROM t WHERE len(w) >= 20)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 19)) AS s FROM later),
word AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS s FROM t),
kept AS (SELECT word.doc_id, string_agg(word.word, ' ' ORDER BY word.s) FILTER (gone.s IS NULL) AS rest, count(gone.s) AS n FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.s = gone.s GROUP BY word.doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM t LEFT JOIN kept ON t.doc_id = kept.doc_id
"""

CONTAMINATION = f"""
WITH t AS (SELECT doc_id, {_words("text", _ALNUM, True)} AS w FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_words("text", _ALNUM, True)} AS w, least(13, len({_words("text", _ALNUM, True)})) AS k FROM benchmark),
part AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS x FROM (SELECT item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM item WHERE k > 0)),
place AS (SELECT doc_id, k, s, array_to_string(list_slice(w, s, s + k - 1), ' ') AS x FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM t, (SELECT DISTINCT k FROM part) WHERE len(w) >= k)),
met AS (SELECT doc_id, s, place.k, item_id FROM place JOIN part ON place.k = part.k AND place.x = part.x),
hit AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(generate_series(s, s + k - 1)) AS s FROM met) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM t LEFT JOIN hit ON t.doc_id = hit.doc_id LEFT JOIN found ON t.doc_id = found.doc_id
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE t AS (SELECT doc_id, {_words("text", _SPACED, True)} AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(generate_series(1, len(w) - 4), lambda s: array_to_string(list_slice(w, s, s + 4), ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM t),
member AS (SELECT doc_id, len(x) AS n, unnest(x) AS g FROM sets),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b FROM member AS a JOIN member AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM t UNION SELECT reach.a, pair.b FROM reach JOIN pair ON reach.b = pair.a)
SELECT sets.doc_id, CAST(len(x) AS BIGINT) AS n_shingles, least_id AS component_id FROM sets JOIN (SELECT a, min(b) AS least_id FROM reach GROUP BY a) AS r ON sets.doc_id = r.a
"""

SQL = {"op2_suffix_dedup": REPEATED_BYTES, "op6_block_anchors": REPEATED_WORDS, "op7_winnowing": CONTAMINATION, "op9_prefix_join": NEAR_DUPLICATES}
