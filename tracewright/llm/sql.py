"""DuckDB SQL for comparison."""

GAP = r"[\x20\x09-\x0D]"
NOT_GAP = r"[^\x20\x09-\x0D]"

QUALITY = rf"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{NOT_GAP}+') AS w
  FROM documents
), each_word AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d
), windows AS (
  SELECT doc_id, i, [word,
         lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o] AS five,
         lead(word, 4) OVER o IS NOT NULL AS full_window
  FROM each_word WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), repeated AS (
  SELECT doc_id, i, full_window AND count(*) OVER (PARTITION BY doc_id, five) > 1 AS again FROM windows
), inside AS (
  SELECT doc_id, max(again::int) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hit
  FROM repeated
), repeat_words AS (
  SELECT doc_id, sum(hit)::bigint AS n FROM inside GROUP BY doc_id
), lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d
), dup_lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '{NOT_GAP}') GROUP BY doc_id
), m AS (
  SELECT d.doc_id, lang, len(w)::bigint AS n_words,
         length(array_to_string(w, ''))::bigint AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint AS n_symbols,
         coalesce(l.n, 0)::bigint AS n_dup_lines,
         coalesce(r.n, 0)::bigint AS n_repeat_words,
         length(text)::bigint AS chars, strlen(text)::bigint AS bytes,
         (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::bigint AS upper_n,
         (length(text) - length(regexp_replace(text, '[0-9]', '', 'g')))::bigint AS digit_n,
         (length(text) - length(regexp_replace(text, '[.,;:?!''"()-]', '', 'g')))::bigint AS mark_n,
         [x FOR x IN regexp_extract_all(lower(text), '{NOT_GAP}+') IF length(x) <= 6] AS short
  FROM d LEFT JOIN dup_lines l ON l.doc_id = d.doc_id LEFT JOIN repeat_words r ON r.doc_id = d.doc_id
), classes AS (
  SELECT *, chars - word_chars AS white_n, bytes - chars AS beyond_n,
         bytes - (upper_n + digit_n + (chars - word_chars) + n_symbols + mark_n + (bytes - chars)) AS other_n FROM m
), refs AS (
  SELECT lang, sum(bytes) AS bytes, sum(n_words) AS all_words, sum(upper_n) AS u, sum(digit_n) AS g, sum(white_n) AS s,
         sum(n_symbols) AS y, sum(mark_n) AS k, sum(beyond_n) AS b, sum(other_n) AS o
  FROM classes WHERE lang IS NOT NULL GROUP BY lang HAVING sum(bytes) > 0
), counted AS (
  SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(short) AS word FROM classes WHERE lang IS NOT NULL) GROUP BY lang, word
), top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place FROM counted) WHERE place <= 24
), shares AS (
  SELECT t.lang, t.word, t.n / r.all_words::double AS share FROM top t JOIN refs r ON r.lang = t.lang
), char_parts AS (
  SELECT c.doc_id, unnest([upper_n, digit_n, white_n, n_symbols, mark_n, beyond_n, other_n]) / c.bytes::double AS p,
         unnest([u, g, s, y, k, b, o]) / r.bytes::double AS q
  FROM classes c JOIN refs r ON r.lang = c.lang
  WHERE chars >= 200
), own_counts AS (
  SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(short) AS word FROM classes) GROUP BY doc_id, word
), word_hits AS (
  SELECT c.doc_id, coalesce(w.n, 0) / c.n_words::double AS p, s.share AS q
  FROM classes c JOIN shares s ON s.lang = c.lang
  LEFT JOIN own_counts w ON w.doc_id = c.doc_id AND w.word = s.word
  WHERE c.n_words >= 50
), word_parts AS (
  SELECT * FROM word_hits
  UNION ALL
  SELECT doc_id, 1 - sum(p), 1 - sum(q) FROM word_hits GROUP BY doc_id
), distances AS (
  SELECT doc_id, kind, sqrt(greatest(0, -sum(
      CASE WHEN p + q > 0 THEN (p + q) / 2 * log2((p + q) / 2) ELSE 0 END
      - (CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q) ELSE 0 END) / 2))) AS x
  FROM (SELECT 'char' AS kind, * FROM char_parts UNION ALL SELECT 'word', * FROM word_parts) GROUP BY doc_id, kind
), judged AS (
  SELECT m.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         coalesce(a.x, 0) <= 0.3 AND coalesce(b.x, 0) <= 0.45 AS usual
  FROM m LEFT JOIN distances a ON a.doc_id = m.doc_id AND a.kind = 'char'
  LEFT JOIN distances b ON b.doc_id = m.doc_id AND b.kind = 'word'
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND usual AS kept
FROM judged
"""

SUBSTRINGS = rf"""
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{NOT_GAP}+')) AS word,
         generate_subscripts(regexp_extract_all(coalesce(text, ''), '{NOT_GAP}+'), 1) AS i
  FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(list(word) OVER o, ' ')) AS hashed, count(*) OVER o AS n
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)
), firsts AS (
  SELECT hashed, min(doc_id) AS first FROM windows WHERE n = 50 GROUP BY hashed
), hits AS (
  SELECT x.doc_id, x.i, coalesce(x.doc_id > f.first, false)::int AS hit
  FROM windows x LEFT JOIN firsts f ON f.hashed = x.hashed AND x.n = 50
), covered AS (
  SELECT doc_id, i, max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM hits
), summed AS (
  SELECT w.doc_id, count(*) AS n_words, sum(gone)::bigint AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY w.i) FILTER (WHERE gone = 0), '') AS kept
  FROM w JOIN covered c ON c.doc_id = w.doc_id AND c.i = w.i GROUP BY w.doc_id
)
SELECT d.doc_id, coalesce(n_words, 0)::bigint AS n_words, coalesce(n_removed, 0)::bigint AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN summed s ON s.doc_id = d.doc_id
"""

CAPITALS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

COLLOCATIONS = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), {CAPITALS}), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), spoken AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase
  FROM spoken, (VALUES (1), (2), (3), (4)) AS widths(k)
), f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::bigint AS n FROM f WHERE k = 1 GROUP BY lang
), candidates AS MATERIALIZED (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k >= 2 AND f >= 30
), places AS MATERIALIZED (
  SELECT *, array_to_string(w[1:j], ' ') AS left_part, array_to_string(w[j + 1:], ' ') AS right_part
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates)
), cuts AS (
  SELECT c.lang, c.k, c.phrase, c.w, c.a, j, l.f AS l, r.f AS r, (2000000::hugeint * c.a) // (l.f::hugeint + r.f) AS score
  FROM places c JOIN f l ON l.lang = c.lang AND l.phrase = c.left_part JOIN f r ON r.lang = c.lang AND r.phrase = c.right_part
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), inside AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, a, unnest(flatten([[array_to_string(w[i:i + m - 1], ' ') FOR i IN range(1, k - m + 2)] FOR m IN range(2, k)])) AS phrase
    FROM candidates
  ) GROUP BY lang, phrase
), kept AS (
  SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE i.most IS NULL OR 100::hugeint * i.most < 80::hugeint * b.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score::bigint AS score
FROM kept JOIN totals USING (lang)
QUALIFY rank <= 2000
"""

BARE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

LEAKS = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {CAPITALS}), '{BARE}') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {CAPITALS}), '{BARE}') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size,
         unnest([array_to_string(w[i:i + least(10, len(w)) - 1], ' ') FOR i IN range(1, len(w) - least(10, len(w)) + 2)]) AS text
  FROM items WHERE len(w) > 0
), sizes AS (
  SELECT DISTINCT size FROM windows
), places AS (
  SELECT r, size, unnest(range(1, len(w) - size + 2)) AS i,
         unnest([array_to_string(w[i:i + size - 1], ' ') FOR i IN range(1, len(w) - size + 2)]) AS text
  FROM d, sizes
), found AS (
  SELECT p.r, p.i, p.size, x.item_id FROM places p JOIN windows x ON x.text = p.text AND x.size = p.size
), hit AS (
  SELECT r, count(DISTINCT place) AS n_hit
  FROM (SELECT r, unnest(range(i, i + size)) AS place FROM (SELECT DISTINCT r, i, size FROM found)) GROUP BY r
), listed AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item_id::varchar AS item FROM found WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN listed USING (r)
"""

SQL = {"op2_quality": QUALITY, "op10_substrings": SUBSTRINGS, "op11_collocations": COLLOCATIONS, "op12_leaks": LEAKS}
