"""DuckDB SQL for the operators whose rows SQL can say."""

from __future__ import annotations

OP11 = r"""
WITH occurrences AS (
    SELECT
        row_number() OVER () AS doc,
        coalesce(lang, '') AS lang,
        coalesce(source, '') AS source,
        regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'
        ) AS terms
    FROM documents
),
groups AS (SELECT DISTINCT lang, source FROM occurrences),
tokens AS (SELECT doc, lang, source, unnest(terms) AS term FROM occurrences),
kept AS (SELECT lang, term FROM tokens GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
vocabulary AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counted AS (
    SELECT t.lang, t.source, t.term, count(*) AS n
    FROM tokens t JOIN kept k ON k.lang = t.lang AND k.term = t.term
    GROUP BY t.lang, t.source, t.term
),
totals AS (
    SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total
    FROM groups g LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source
    GROUP BY g.lang, g.source
),
shares AS (
    SELECT
        t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
        (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (t.total + 2 * v.v)::HUGEINT) AS p
    FROM totals t
    JOIN kept k ON k.lang = t.lang
    JOIN vocabulary v ON v.lang = t.lang
    LEFT JOIN counted c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
),
lang_counts AS (SELECT lang, term, sum(n) AS n FROM counted GROUP BY lang, term),
lang_totals AS (SELECT lang, sum(n) AS total FROM lang_counts GROUP BY lang),
lang_shares AS (
    SELECT
        c.lang, c.term,
        (1 + (1000000000::HUGEINT * (c.n + 2)) // (t.total + 2 * v.v)::HUGEINT) AS q
    FROM lang_counts c JOIN lang_totals t ON t.lang = c.lang JOIN vocabulary v ON v.lang = c.lang
),
pair_values AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source
    GROUP BY a.lang, a.source, b.source
),
found AS (
    SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(p.value, 0)::BIGINT AS value
    FROM groups g
    JOIN groups o ON o.lang = g.lang AND o.source <> g.source
    LEFT JOIN pair_values p ON p.lang = g.lang AND p.source = g.source AND p.item = o.source
    UNION ALL
    SELECT s.lang, s.source, 'term', s.term, ((s.p - l.q) * (s.p - l.q) // (s.p + l.q))::BIGINT
    FROM shares s JOIN lang_shares l ON l.lang = s.lang AND l.term = s.term
    WHERE s.n > 0 AND s.p > l.q
)
SELECT
    lang, source, part, item, value,
    CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
FROM found
QUALIFY part = 'pair' OR rank <= 10
"""

OP13 = r"""
WITH told AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels GROUP BY doc_id
),
whole AS (
    SELECT
        d.doc_id, coalesce(d.lang, '') AS part, coalesce(d.text, '') AS text,
        regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+') AS words,
        coalesce(t.good, 0) AS good, coalesce(t.toxic, 0) AS toxic
    FROM documents d LEFT JOIN told t ON t.doc_id = d.doc_id
),
marked AS (
    SELECT
        part, good, toxic,
        len(words) < 200 AS a,
        100 * len(list_distinct(words)) < 50 * len(words) AS b,
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c,
        regexp_matches(text, '[#$%&*|]') AS d,
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e
    FROM whole
),
cells AS (
    SELECT
        part,
        a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask,
        count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
    FROM marked GROUP BY ALL
),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
    SELECT p.letter || q.letter || r.letter || s.letter || t.letter AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
    FROM letters p, letters q, letters r, letters s, letters t
    WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND p.bit | q.bit | r.bit | s.bit | t.bit = 31
),
steps AS (
    SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step - 1])::INT AS applied
    FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
),
audited AS (
    SELECT
        part, filter_order, step, bit,
        sum(CASE WHEN mask & (coalesce(applied, 0) | bit) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & bit > 0 AND mask & coalesce(applied, 0) = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & bit > 0 AND mask & coalesce(applied, 0) > 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & bit > 0 AND mask & coalesce(applied, 0) = 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & bit > 0 AND mask & coalesce(applied, 0) = 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM steps, cells
    GROUP BY ALL
)
SELECT
    part, filter_order, CAST(step AS INTEGER) AS step,
    CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
    CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM audited
"""


def oracle_texts() -> dict[str, str]:
    return {"op11_source_divergence": OP11, "op13_filter_interactions": OP13}
