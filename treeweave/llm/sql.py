"""The SQL that checks the queries, for the engine of the checks. It shares no code with the operators."""

SOURCE_MIX = r"""
WITH sized AS (
  SELECT doc_id, coalesce('0' || source, '1') AS key, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents),
sources AS (
  SELECT key, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY key),
weighted AS (
  SELECT *, CAST(2 * source_size AS DOUBLE) AS most,
    CASE (row_number() OVER (ORDER BY encode(key)) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM sources),
filled AS (
  SELECT *, sum(most) OVER f - most AS before, sum(weight) OVER f AS upto, row_number() OVER f AS turn
  FROM weighted WINDOW f AS (ORDER BY most / weight, encode(key) ROWS UNBOUNDED PRECEDING)),
levels AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM sources) - before) / ((SELECT sum(weight) FROM weighted) - upto + weight) AS level
  FROM filled),
reach AS (SELECT coalesce(arg_min(level, turn) FILTER (WHERE most > weight * level), 'infinity'::DOUBLE) AS reach FROM levels),
targets AS (SELECT key, source_size, least(most, weight * reach) AS target FROM weighted, reach),
placed AS (
  SELECT doc_id, size, source_size, target,
    row_number() OVER (PARTITION BY key ORDER BY size DESC, doc_id) AS position,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS each,
    CAST(CAST('0x' || substr(md5('mix' || key), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS start
  FROM sized JOIN targets USING (key))
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS INTEGER) AS copies
FROM (SELECT *, floor(position * each + start) - floor((position - 1) * each + start) AS copies FROM placed) t
"""

JUMP_SHARDS = r"""
WITH RECURSIVE walk AS (
  SELECT n, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j, state, doc_id, text
  FROM (SELECT row_number() OVER () AS n, doc_id, text,
    CAST(CAST('0x' || substr(md5(coalesce('k' || CAST(doc_id AS VARCHAR), 'null')), 1, 16) AS UBIGINT) AS HUGEINT) AS state FROM documents) t
  UNION ALL
  SELECT n, j, CAST(floor(CAST(j + 1 AS DOUBLE) * (2147483648.0::DOUBLE / (CAST(state // 8589934592 AS DOUBLE) + 1.0::DOUBLE))) AS BIGINT), state, doc_id, text
  FROM (SELECT n, j, doc_id, text, (state * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS state FROM walk WHERE j < 40) t),
ended AS (SELECT doc_id, text, b, j FROM walk WHERE j >= 40),
crc_step AS (
  SELECT list(list_reduce([CAST(n AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY n) AS steps FROM range(256) r(n))
SELECT doc_id, CAST(coalesce(strlen(text), 0) + 16 AS BIGINT) AS size,
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT))),
    lambda c, h: xor(c // 256, steps[xor(c % 256, h) + 1]))) AS text_crc32, 'key' AS law,
  CAST(b AS INTEGER) AS shard, row_number() OVER (PARTITION BY b ORDER BY doc_id NULLS FIRST, strlen(text)) - 1 AS slot,
  CAST(CASE WHEN j = 40 THEN 40 ELSE b END AS INTEGER) AS grown_shard
FROM ended, crc_step
"""

BENCHMARK_HITS = r"""
WITH worded AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM documents),
item_words AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS length, words[s:s + least(10, len(words)) - 1] AS win
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS s FROM item_words WHERE len(words) > 0) t),
lengths AS (SELECT DISTINCT length FROM windows),
starts AS (
  SELECT doc_id, length, s, words[s:s + length - 1] AS win
  FROM (SELECT doc_id, words, length, unnest(range(1, len(words) - length + 2)) AS s FROM worded, lengths WHERE len(words) >= length) t),
found AS (SELECT doc_id, s, w.length, item_id FROM starts JOIN windows w USING (win)),
hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + length)) AS pos FROM found) t GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY encode(item)) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) t GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM worded LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, hash(words[s:s + 4]) AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS s FROM worded WHERE len(words) > 0) t),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * s.n >= 85 * (x.n + y.n - s.n)),
reach AS (
  SELECT doc_id AS id, doc_id AS other FROM documents
  UNION
  SELECT r.id, l.b AS other FROM reach r JOIN links l ON l.a = r.other)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id)
JOIN (SELECT id AS doc_id, min(other) AS component_id FROM reach GROUP BY id) c USING (doc_id)
"""

REPEATED_PASSAGES = r"""
WITH worded AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
wins AS (
  SELECT n, doc_id, s, hash(words[s:s + 49]) AS win
  FROM (SELECT n, doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM worded WHERE len(words) >= 50) t),
firsts AS (SELECT win, min(doc_id) AS first FROM wins GROUP BY win),
gone AS (
  SELECT DISTINCT n, unnest(range(s, s + 50)) AS pos FROM wins JOIN firsts USING (win) WHERE first < doc_id),
each AS (
  SELECT n, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM worded),
kept AS (
  SELECT n, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n_kept FROM each ANTI JOIN gone USING (n, pos) GROUP BY n)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM worded LEFT JOIN kept USING (n)
"""

CHAT_FORMAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
placed AS (
  SELECT *, row_number() OVER t AS place, coalesce(lag(role) OVER t, '') AS before
  FROM rows WINDOW t AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), encode(text))),
marked AS (
  SELECT *,
    len(text) + len(regexp_extract_all(text, '\\')) + len(regexp_extract_all(text, '</s>|\[/?(SYS|INST|TEXT)\]|\[(OUT|ROLE)\]')) AS chars,
    len(role) + len(regexp_extract_all(role, '\\')) + len(regexp_extract_all(role, '</s>|\[/?(SYS|INST|TEXT)\]|\[(OUT|ROLE)\]')) AS name_chars,
    NOT CASE role WHEN 'system' THEN place = 1
      WHEN 'user' THEN place = 1 OR before IN ('assistant', 'system')
      WHEN 'assistant' THEN before = 'user' ELSE false END AS wrong
  FROM placed),
grouped AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY place) AS turns,
    coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '') AS learned,
    sum(chars + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 ELSE name_chars + 19 END) AS formatted_chars,
    min(place) FILTER (WHERE wrong) AS bad_turn, arg_max(role, place) AS last_role
  FROM marked GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(len(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars, bad_turn IS NULL AS valid, bad_turn IS NULL AND last_role = 'assistant' AS complete, bad_turn
FROM grouped
"""

PERIODIC_RUNS = r"""
WITH crc_step AS (
  SELECT list(list_reduce([CAST(n AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY n) AS steps FROM range(256) r(n)),
worded AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
      lambda c, h: xor(c // 256, steps[xor(c % 256, h) + 1]))) AS h
  FROM documents, crc_step),
cut AS (
  SELECT *, len(words) AS size, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN (h // 10) % len(words) ELSE len(words) END AS a FROM worded),
stepped AS (SELECT *, 1 + (size - a) // (3 + (h // 10) % 8) AS p FROM cut),
each AS (
  SELECT n, size, i, words[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1] AS word
  FROM (SELECT *, unnest(range(size)) AS i FROM stepped) t),
equal AS (
  SELECT x.n, x.i, y.i - x.i AS q FROM each x JOIN each y ON x.n = y.n AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.size),
islands AS (
  SELECT n, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY n, q ORDER BY i) AS island FROM equal) t
  GROUP BY n, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS (
  SELECT * FROM islands x WHERE NOT EXISTS (
    SELECT 1 FROM islands y WHERE y.n = x.n AND y.q < x.q AND x.q % y.q = 0 AND y.start <= x.start AND y.start + y.length >= x.start + x.length)),
told AS (
  SELECT n, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS listed FROM runs GROUP BY n),
best AS (
  SELECT x.* FROM runs x WHERE NOT EXISTS (
    SELECT 1 FROM runs y WHERE y.n = x.n AND (y.length * x.q > x.length * y.q
      OR y.length * x.q = x.length * y.q AND (y.start < x.start OR y.start = x.start AND y.q < x.q)))),
gone AS (SELECT DISTINCT n, unnest(range(start + q, start + length)) AS i FROM runs),
kept AS (SELECT n, string_agg(word, ' ' ORDER BY i) AS text FROM each ANTI JOIN gone USING (n, i) GROUP BY n)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, q AS period, CAST(1000 * length // q AS BIGINT) AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM worded LEFT JOIN told USING (n) LEFT JOIN best USING (n) LEFT JOIN kept USING (n)
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, words FROM (
    SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words
    FROM documents) t),
grams AS (
  SELECT lang, array_to_string(words[s:s + size - 1], ' ') AS phrase, size, count(*) AS f
  FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS s FROM pieces, range(1, 5) r(size)) t GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE size = 1 GROUP BY lang),
often AS (SELECT *, string_split(phrase, ' ') AS words FROM grams WHERE f >= 30),
cuts AS (
  SELECT lang, phrase, size, f AS a, words, k, array_to_string(words[:k], ' ') AS head, array_to_string(words[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM often WHERE size > 1) t),
scored AS (
  SELECT c.*, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * a // (x.f + y.f) AS BIGINT) AS score
  FROM cuts c JOIN often x ON x.lang = c.lang AND x.phrase = head JOIN often y ON y.lang = c.lang AND y.phrase = tail),
lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(words[s:s + part - 1], ' ') AS phrase, max(f) AS around
  FROM (SELECT *, unnest(range(1, size - part + 2)) AS s FROM often, range(2, 4) r(part) WHERE size > part) t GROUP BY ALL),
ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
  FROM lowest b LEFT JOIN inside USING (lang, phrase) WHERE around IS NULL OR 100 * around < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score, CAST(k AS INTEGER) AS k FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
