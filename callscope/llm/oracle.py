"""The same queries in DuckDB SQL, where SQL can express them.

Token encoding, trained scores, page parsing, CRC-32 and approximate search are beyond
it; those queries are tested against brute force.
"""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
        md5('mix:' || doc_id) AS digest
    FROM documents
),
sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
    FROM sized GROUP BY source
),
levels AS (
    SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER before, 0))
        / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
    FROM sources
    WINDOW before AS (
        ORDER BY 2 * source_size / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
    )
),
targets AS (
    SELECT source, source_size,
        least((2 * source_size)::DOUBLE, max(level) OVER () * weight) AS target,
        ('0x' || substr(md5('mix:offset:' || coalesce(source, '')), 1, 6))::BIGINT AS shift
    FROM levels
),
rates AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size * 16777216)::BIGINT ELSE 0 END AS each
    FROM targets
),
placed AS (
    SELECT s.doc_id, s.size, r.source_size, r.target, r.each,
        r.shift + r.each * row_number() OVER (
            PARTITION BY s.source
            ORDER BY CASE WHEN size < 8 THEN size
                ELSE length(bin(size)) * 8 + ((size >> (length(bin(size)) - 4)) & 7) END,
                substr(digest, 1, 2), size, digest, doc_id
        ) AS upto
    FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target,
    CAST(((upto >> 24) - ((upto - each) >> 24)) * size AS BIGINT) AS taken
FROM placed
"""

_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

OP7 = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
matched AS (
    SELECT doc_id, 0 AS n, 'assign' AS kind, regexp_split_to_array(text, '{_ASSIGN}') AS gaps,
        regexp_extract_all(text, '{_ASSIGN}') AS hits,
        list_transform(regexp_extract_all(text, '{_ASSIGN}', 2), lambda v: length(v) >= 12) AS counts
    FROM texts
    UNION ALL
    SELECT doc_id, 1, 'access', regexp_split_to_array(text, 'AKIA[A-Z0-9]+'),
        regexp_extract_all(text, 'AKIA[A-Z0-9]+'),
        list_transform(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda v: length(v) >= 18)
    FROM texts
    UNION ALL
    SELECT doc_id, 2, 'hex', regexp_split_to_array(text, '[0-9a-f]+'),
        regexp_extract_all(text, '[0-9a-f]+'),
        list_transform(regexp_extract_all(text, '[0-9a-f]+'), lambda v: length(v) >= 16)
    FROM texts
),
singles AS (
    SELECT doc_id, n, kind, i, length(gaps[i]) AS gap, length(hits[i]) AS hit, counts[i] AS counts
    FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM matched)
),
placed AS (
    SELECT *, sum(gap + hit) OVER (PARTITION BY doc_id, n ORDER BY i) AS stop FROM singles
),
listed AS (
    SELECT doc_id, count(*) FILTER (n = 0) AS n_assign, count(*) FILTER (n = 1) AS n_access,
        count(*) FILTER (n = 2) AS n_hex,
        string_agg(kind || ':' || (stop - hit) || ':' || stop, ',' ORDER BY stop - hit, n) AS spans
    FROM placed WHERE counts GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
    coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN listed USING (doc_id)
"""

OP9 = rf"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words
    FROM documents
),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle
    FROM (SELECT *, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM texts WHERE len(words) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id
),
links AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * common.n >= 75 * (x.n + y.n - common.n)
),
steps AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT reached.doc_id, steps.b FROM reached JOIN steps ON reached.other = steps.a
),
roots AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM roots LEFT JOIN sizes USING (doc_id)
"""

OP10 = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v
    FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
),
scored AS (
    SELECT q.vec_id AS query_id, w.vec_id, CAST(list_dot_product(q.v, w.v) AS BIGINT) AS score
    FROM whole q JOIN whole w ON q.vec_id % 100 = 0 AND q.vec_id != w.vec_id
),
ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
        vec_id, score
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

OP13 = r"""
WITH lines AS (
    SELECT doc_id, generate_subscripts(parts, 1) AS n, unnest(parts) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
),
keyed AS (
    SELECT *, translate(trim(line, E' \t\n\x0B\x0C\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
),
recurring AS (
    SELECT key, max(doc_id) AS owner FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3
),
marked AS (
    SELECT doc_id, n, line, owner IS NOT NULL AND owner != doc_id AS gone FROM keyed LEFT JOIN recurring USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

ORACLE = {
    "op1_mix": OP1,
    "op7_secrets": OP7,
    "op9_near_duplicates": OP9,
    "op10_top_lists": OP10,
    "op13_lines": OP13,
}
