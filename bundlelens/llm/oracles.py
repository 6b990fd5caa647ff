"""SQL for a second engine, for the queries whose result it can express; the texts are whole and nothing is left out."""

#: Windows are compared by a 256-bit hash of their words, which hold no blanks themselves.
SUBSTRING = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, i, sha256(array_to_string(w[i:i + 34], ' ')) AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
repeated AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM windows SEMI JOIN repeated USING (k)),
remaining AS (SELECT r, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n
              FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d) ANTI JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN remaining USING (r)
"""

#: Equal sets are one class; classes that share a shingle are compared in full, then followed link by link.
NEAR_DUPLICATES = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
named AS (SELECT doc_id, len(g)::BIGINT AS n, g, CASE WHEN len(g) > 0 THEN sha256(array_to_string(list_sort(g), chr(10))) END AS c FROM s),
classes AS (SELECT c, any_value(g) AS g, any_value(n) AS n, min(doc_id) AS least FROM named WHERE c IS NOT NULL GROUP BY c),
element AS (SELECT c, n, unnest(g) AS x FROM classes),
pairs AS (SELECT a.c AS a, b.c AS b FROM element a JOIN element b ON a.x = b.x AND a.c < b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
          GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT c, c AS o FROM classes UNION SELECT reach.c, links.b FROM reach JOIN links ON reach.o = links.a),
smallest AS (SELECT reach.c, min(k.least) AS least FROM reach JOIN classes k ON k.c = reach.o GROUP BY reach.c)
SELECT doc_id, n AS n_shingles, coalesce(least, doc_id) AS component_id, doc_id = coalesce(least, doc_id) AS kept FROM named LEFT JOIN smallest USING (c)
"""

#: Targets by the order in which sources reach their limits; draws from the same hash of id, text and number among equal rows.
MIXING = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, t, source) AS k FROM d),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
placed AS (SELECT source, source_size, 3 * source_size AS most, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight FROM sources),
line AS (SELECT *, coalesce(sum(most) OVER earlier, 0)::BIGINT AS most_before, coalesce(sum(weight) OVER earlier, 0)::BIGINT AS weight_before,
                sum(source_size) OVER ()::BIGINT AS words, sum(weight) OVER ()::BIGINT AS weights FROM placed
         WINDOW earlier AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (words - most_before)::DOUBLE / (weights - weight_before) AS level FROM line),
goal AS (SELECT source, source_size, least(coalesce((SELECT min_by(level, most / weight) FROM levels WHERE most >= weight * level) * weight, most), most)::DOUBLE AS target FROM levels),
rated AS (SELECT n.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0::DOUBLE END AS rate,
                 ('0x' || substring(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || t || '|' || k), 1, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE AS u
          FROM numbered n JOIN goal g ON n.source IS NOT DISTINCT FROM g.source),
copied AS (SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM rated)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, source, copies FROM copied
"""

#: Products of small whole numbers are exact in doubles.
HARD_NEGATIVES = r"""
WITH r AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (SELECT a.row AS anchor, a.vec_id AS anchor_id, b.row, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
           FROM r a, r b WHERE a.vec_id % 50 = 0 AND a.row <> b.row),
positives AS (SELECT anchor, anchor_id, row, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER best)::INTEGER AS rank, n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor = n.anchor AND NOT n.same AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
WINDOW best AS (PARTITION BY p.anchor, p.row ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER best <= 3
"""

#: Lines are compared without case, digits' values and spacing; documents of a host are counted by their words.
QUALITY_RULES = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, i, array_to_string(w[i:i + 2], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
again AS (SELECT r, k FROM windows GROUP BY r, k HAVING count(*) > 1),
repeats AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM windows SEMI JOIN again USING (r, k)) GROUP BY r),
lines AS (SELECT r, source, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[^\x20\x09-\x0D]+') AS words
          FROM (SELECT r, source, unnest(string_split(t, chr(10))) AS line FROM d)),
solid AS (SELECT r, source, line, array_to_string(words, ' ') AS k, len(words) AS n FROM lines WHERE len(words) > 0),
twice AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM solid GROUP BY r),
whole AS (SELECT r, source, md5(array_to_string(w, ' ')) AS x FROM d),
hosts AS (SELECT source, count(DISTINCT x) AS n_docs FROM whole GROUP BY source),
kept_lines AS (SELECT r, source, k, sum(n) AS n FROM solid GROUP BY r, source, k),
often AS (SELECT l.source, l.k FROM kept_lines l JOIN whole USING (r) JOIN hosts h ON h.source IS NOT DISTINCT FROM l.source
          GROUP BY l.source, l.k, h.n_docs HAVING count(DISTINCT x) > 20 AND (count(DISTINCT x) > 0.05::DOUBLE * h.n_docs OR count(DISTINCT x) > 10000)),
lost AS (SELECT r, sum(l.n) AS n FROM kept_lines l JOIN often o ON l.k = o.k AND l.source IS NOT DISTINCT FROM o.source GROUP BY r),
counted AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                   coalesce(twice.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_line_words
            FROM d LEFT JOIN twice USING (r) LEFT JOIN repeats USING (r) LEFT JOIN lost USING (r)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT *, NOT base_failed AND 100 * (n_words - n_line_words) >= 30 * n_words AS kept FROM judged
"""

SQL = {"op3_quality_rules": QUALITY_RULES, "op11_mixing": MIXING, "op12_hard_negatives": HARD_NEGATIVES, "op2_substring": SUBSTRING, "op6_superminhash": NEAR_DUPLICATES}
