"""The collocations as SQL; products in HUGEINT."""

SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?' || chr(11) || chr(12) || chr(13) || chr(9),
        'abcdefghijklmnopqrstuvwxyz' || repeat(chr(10), 9) || ' '), chr(10))) AS piece
    FROM documents
),
numbered AS (SELECT lang, row_number() OVER () AS p, list_filter(string_split(piece, ' '), lambda x: x != '') AS w FROM pieces),
lines AS (SELECT lang, p, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM numbered),
runs AS (SELECT lang, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM lines WINDOW o AS (PARTITION BY p ORDER BY i)),
grams AS MATERIALIZED (
    SELECT lang, k, CASE k WHEN 1 THEN x WHEN 2 THEN x || ' ' || y ELSE x || ' ' || y || ' ' || z END AS phrase, count(*) AS f
    FROM runs, (VALUES (1), (2), (3)) AS sizes(k) WHERE k = 1 OR k = 2 AND y IS NOT NULL OR k = 3 AND z IS NOT NULL GROUP BY ALL
),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE k > 1 AND f >= 10),
parts AS (
    SELECT c.lang, c.phrase, c.k, c.f, cut,
           array_to_string(list_slice(w, 1, cut), ' ') AS head, array_to_string(list_slice(w, cut + 1, c.k), ' ') AS rest
    FROM candidates c, (VALUES (1), (2)) AS cuts(cut) WHERE cut < c.k
),
keyed AS (SELECT lang || chr(10) || phrase AS key, f FROM grams),
scored AS (
    SELECT p.*, h.f AS l, r.f AS r,
           CAST(CAST(1000000 AS HUGEINT) * p.f * p.f // (CAST(h.f AS HUGEINT) * r.f) AS BIGINT) AS score
    FROM parts p JOIN keyed h ON h.key = p.lang || chr(10) || p.head JOIN keyed r ON r.key = p.lang || chr(10) || p.rest
),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
absorbed AS (
    SELECT DISTINCT s.lang, s.phrase FROM candidates s JOIN (
        SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS inside FROM candidates WHERE k = 3
    ) t ON t.lang = s.lang AND t.inside = s.phrase WHERE 100 * t.f >= 50 * s.f
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, encode(phrase)) AS rank
    FROM lowest ANTI JOIN absorbed USING (lang, phrase)
)
SELECT lang, rank, phrase, f AS a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
