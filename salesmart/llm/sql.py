"""The queries that DuckDB's SQL can express over whole small tables."""

_LABELLED = """
WITH RECURSIVE vectors AS (
    SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS length
    FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0
        AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(e, lambda x: x <> 0)) > 0
),
links AS (
    SELECT x.vec_id AS a, y.vec_id AS b
    FROM vectors x JOIN vectors y
        ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id
    WHERE list_dot_product(x.e, y.e) / (x.length * y.length) >= 0.93
),
reach AS (
    SELECT vec_id, vec_id AS other FROM embeddings
    UNION
    SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.other = links.a
)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept
FROM (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
JOIN (SELECT vec_id, count(b) AS n_links FROM embeddings LEFT JOIN links ON vec_id = a
      GROUP BY vec_id) USING (vec_id)
"""

_SHINGLED = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(
        list_transform(string_split_regex(coalesce(text, ''), '[ \t\n\v\f\r]+'),
                       lambda w: regexp_replace(lower(w), '[^\p{L}\p{N}]', '', 'g')),
        lambda w: w <> '') AS w
    FROM documents
),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(
        range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s
    FROM words
),
grams AS (SELECT doc_id, unnest(s) AS gram FROM sets),
shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
    FROM grams x JOIN grams y ON x.gram = y.gram AND x.doc_id <> y.doc_id
    GROUP BY ALL
),
links AS (
    SELECT a, b FROM shared
    JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
    WHERE 9 * n >= 4 * (len(x.s) + len(y.s))  -- n / (x + y - n) >= 0.8
),
reach AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION
    SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a
),
classes AS (
    SELECT doc_id, CASE WHEN len(s) = 0 THEN doc_id
        ELSE min(doc_id) OVER (PARTITION BY s) END AS class_id
    FROM sets
)
SELECT doc_id, class_id, n_links, component_id, doc_id = component_id AS kept
FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
JOIN (SELECT doc_id, count(b) AS n_links FROM documents LEFT JOIN links ON doc_id = a
      GROUP BY doc_id) USING (doc_id)
JOIN classes USING (doc_id)
"""

# For the markup that the given pages have: one article of headings and paragraphs.
_ARTICLES = r"""
WITH parts AS (
    SELECT page_id, url, string_split_regex(
        regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1),
                       '</?b>', '', 'g'),
        '</?(?:p|h1)>|<br>') AS p
    FROM pages
),
decoded AS (
    SELECT page_id, url, list_filter(list_transform(p, lambda x: trim(regexp_replace(
        replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
            '&#39;', ''''), '&amp;', '&'),
        '\s+', ' ', 'g'))), lambda x: x <> '') AS p
    FROM parts
)
SELECT page_id, url, array_to_string(p, chr(10) || chr(10)) AS text,
    CAST(length(array_to_string(p, chr(10) || chr(10))) AS BIGINT) AS n_chars
FROM decoded
"""

_WHOLE = """
WITH whole AS (
    SELECT vec_id, label, list_transform(e, lambda x: floor(256 * x)) AS e
    FROM (SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS e
          FROM embeddings)
    WHERE vec_id IS NOT NULL AND e IS NOT NULL
        AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
"""

_NEGATIVES = (
    _WHOLE
    + """
rows AS (
    SELECT vec_id, e, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
    FROM whole WHERE label IS NOT NULL
),
scores AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
        CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
    FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
positives AS (
    SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (
        PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
    other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
)

_HIGHEST = (
    _WHOLE
    + """
scores AS (
    SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
    FROM whole a JOIN whole b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(row_number() OVER (
    PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scores
QUALIFY rank <= 5
"""
)

ORACLES = {
    "op1_embedding_near_dedup": _LABELLED.strip(),
    "op2_ngram_jaccard_join": _SHINGLED.strip(),
    "op9_html_extraction": _ARTICLES.strip(),
    "op12_hard_negatives": _NEGATIVES.strip(),
    "op13_top_search": _HIGHEST.strip(),
}
