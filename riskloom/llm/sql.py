"""DuckDB SQL that gives the rows of the corpus queries."""

EXACT_DEDUP_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""

MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM d GROUP BY source
), w AS (
  SELECT *, [5.0, 2.0, 1.0][(n % 3 + 1)::INT]::DOUBLE AS w, (2 * source_size)::DOUBLE AS top, (SELECT 1.5 * sum(source_size) FROM s)::DOUBLE AS goal FROM s
), l AS (
  SELECT *, (goal - coalesce(sum(top) OVER before, 0)) / sum(w) OVER rest AS level FROM w
  WINDOW before AS (ORDER BY top / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         rest AS (ORDER BY top / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), t AS (
  SELECT source, source_size, least(top, w * (SELECT level FROM l WHERE top / w >= level ORDER BY top / w, n LIMIT 1)) AS target,
         ('0x' || substr(md5('17:' || coalesce('s' || source, 'n')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) - 1 AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       ((floor((place + 1) * rate + u) - floor(place * rate + u)) * size)::BIGINT AS taken
FROM p
"""

CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(role, '[~<\[|]', '', 'g')) + 2 * (length(role) - length(regexp_replace(role, '[~<\[|]', '', 'g')))
          + length(regexp_replace(text, '[~<\[|]', '', 'g')) + 2 * (length(text) - length(regexp_replace(text, '[~<\[|]', '', 'g'))) + 13 AS long
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(long)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

TOPK_SQL = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS neighbor_id,
         list_sum(list_transform(list_zip(q.b, c.b), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END))::INT AS distance
  FROM c AS q JOIN c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INT AS rank FROM p)
SELECT * FROM r WHERE rank <= 10
"""

NEAR_DEDUP_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS set
  FROM d
), x AS (SELECT doc_id, unnest(set) AS shingle FROM s),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM x AS a JOIN x AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT u, v FROM p JOIN s AS a ON a.doc_id = u JOIN s AS b ON b.doc_id = v WHERE 100 * shared >= 80 * (len(a.set) + len(b.set) - shared)
), r AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.node)
SELECT s.doc_id, len(s.set)::BIGINT AS n_shingles, min(r.root) AS component_id, s.doc_id = min(r.root) AS kept
FROM s JOIN r ON r.node = s.doc_id GROUP BY s.doc_id, s.set
"""

HARD_NEGATIVES_SQL = """
WITH c AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same,
         list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM c AS a JOIN c ON c.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0
), pos AS (
  SELECT anchor_id, id, score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT pos.anchor_id, pos.id AS positive_id,
       row_number() OVER (PARTITION BY pos.anchor_id, pos.id ORDER BY p.score DESC, p.id)::INT AS rank,
       p.id AS negative_id, pos.score AS positive_score, p.score AS negative_score
FROM pos JOIN p ON p.anchor_id = pos.anchor_id AND NOT p.same AND 80 * pos.score <= 100 * p.score AND p.score <= pos.score
QUALIFY rank <= 5
"""

IMPORTANCE_SQL = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, b::BIGINT)) AS t
), texts AS (
  SELECT true AS is_doc, doc_id, row_number() OVER () AS n, text FROM documents
  UNION ALL SELECT false, NULL, row_number() OVER (), text FROM benchmark
), w AS (
  SELECT is_doc, doc_id, n, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts
), g AS (
  SELECT is_doc, n, unnest(flatten(list_transform([1, 2, 3], lambda k: list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))))) AS gram
  FROM w
), grams AS (
  SELECT is_doc, n, gram, count(*) AS c FROM g GROUP BY ALL
), hashed AS (
  SELECT gram, xor(4294967295::BIGINT, list_reduce(
           list_transform(range(octet_length(encode(gram))), lambda i: ('0x' || substr(hex(encode(gram)), 2 * i + 1, 2))::BIGINT),
           lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT)) % 10000 AS bucket
  FROM (SELECT DISTINCT gram FROM grams), crc_table
), counts AS (
  SELECT is_doc, n, bucket, c FROM grams JOIN hashed USING (gram)
), totals AS (
  SELECT sum(c) FILTER (is_doc) AS s_all, coalesce(sum(c) FILTER (NOT is_doc), 0) AS t_all FROM counts
), gains AS (
  SELECT bucket, floor(1000 * ln(((coalesce(sum(c) FILTER (NOT is_doc), 0) + 1) * (any_value(s_all) + 10000))::DOUBLE
                                 / ((coalesce(sum(c) FILTER (is_doc), 0) + 1) * (any_value(t_all) + 10000))::DOUBLE))::BIGINT AS gain
  FROM counts, totals GROUP BY bucket
), weights AS (
  SELECT n, sum(c)::BIGINT AS n_features, sum(c * gain)::BIGINT AS weight FROM counts JOIN gains USING (bucket) WHERE is_doc GROUP BY n
), scored AS (
  SELECT doc_id, len(w) >= 20 AS long, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM w LEFT JOIN weights USING (n) WHERE is_doc
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY long ORDER BY score DESC, doc_id) AS place, 5 * (count(*) FILTER (long) OVER ()) // 100 AS drawn FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN long AND place <= drawn THEN place END AS rank FROM placed
"""
