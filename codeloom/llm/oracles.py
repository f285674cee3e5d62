"""DuckDB SQL for the queries that SQL can express: the plain definitions, without signatures, anchors or codes."""

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_REACH = """reach AS (SELECT id AS a, id AS b FROM ids UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
 classes AS (SELECT a AS id, min(b) AS least FROM reach GROUP BY a)"""

OP1_SUBSTRING_DEDUP = f"""WITH docs AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
 hashed AS (SELECT doc_id, list_transform(generate_series(1, len(w) - 49), lambda i: md5(array_to_string(list_slice(w, i, i + 49), ' '))) AS h FROM docs WHERE len(w) >= 50),
 windows AS (SELECT doc_id, unnest(h) AS h, generate_subscripts(h, 1) AS i FROM hashed),
 firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
 gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM windows JOIN firsts USING (h) WHERE first < doc_id),
 words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
 kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
 counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
 FROM docs LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)"""

OP3_NEAR_DEDUP = f"""WITH RECURSIVE docs AS (SELECT doc_id AS id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
 sets AS (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS s FROM docs),
 each AS (SELECT id, len(s) AS n, unnest(s) AS shingle FROM sets),
 shared AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM each a JOIN each b ON a.shingle = b.shingle AND a.id <> b.id GROUP BY a.id, b.id),
 links AS (SELECT a, b FROM shared WHERE 100 * c >= 75 * (n + m - c)),
 ids AS (SELECT id FROM sets), {_REACH}
 SELECT id AS doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least AS component_id, least = id AS kept FROM sets JOIN classes USING (id)"""

OP6_EMBEDDING_DEDUP = f"""WITH RECURSIVE vectors AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
 fine AS (SELECT * FROM vectors WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
 links AS (SELECT x.id AS a, y.id AS b FROM fine x JOIN fine y ON x.id <> y.id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.9),
 ids AS (SELECT id FROM vectors), {_REACH}
 SELECT id AS vec_id, CAST((SELECT count(*) FROM links WHERE a = c.id) AS BIGINT) AS n_links, least AS component_id, least = id AS kept FROM classes c"""
