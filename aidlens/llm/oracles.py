"""DuckDB statements of the training-data queries that SQL can say."""

ORACLES: dict[str, str] = {}

ORACLES["op11_middle"] = """
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
        sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS hex
    FROM documents),
cut AS (
    SELECT doc_id, t, n,
        ('0x' || substr(hex, 1, 8))::BIGINT % (n + 1) AS one, ('0x' || substr(hex, 9, 8))::BIGINT % (n + 1) AS two,
        CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                OR ('0x' || substr(hex, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
            WHEN ('0x' || substr(hex, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn),
parts AS (
    SELECT doc_id, t, n, form, least(one, two) AS a, greatest(one, two) AS b,
        substr(t, 1, least(one, two)) AS prefix, substr(t, least(one, two) + 1, greatest(one, two) - least(one, two)) AS middle,
        substr(t, greatest(one, two) + 1) AS suffix
    FROM cut)
SELECT doc_id, n::BIGINT AS n, form,
    CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars,
    CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM parts
"""

ORACLES["op12_ranked_search"] = r"""
WITH words AS (
    SELECT row_number() OVER () AS row, doc_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents WHERE text IS NOT NULL),
docs AS (SELECT row, doc_id, terms, len(terms)::BIGINT AS n FROM words WHERE len(terms) > 0),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS all_terms FROM docs),
held AS (
    SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(terms) AS term FROM docs) GROUP BY row, term),
weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM held, whole GROUP BY term),
items AS (
    SELECT row_number() OVER () AS item, item_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM benchmark),
asked AS (
    SELECT item, item_id, term, count(*)::BIGINT AS times
    FROM (SELECT item, item_id, unnest(terms) AS term FROM items) GROUP BY ALL),
scored AS (
    SELECT item, item_id, row, doc_id,
        sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // all_terms))))::BIGINT AS score
    FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN docs USING (row), whole
    GROUP BY item, item_id, row, doc_id),
ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank, doc_id, score
    FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
