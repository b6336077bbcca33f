"""The registry's queries in DuckDB's SQL."""

from __future__ import annotations


def _norm(x: str = "text") -> str:
    s = f"trim(regexp_replace(regexp_replace(replace({x}, chr(65533), ' '), '\\p{{C}}', ' ', 'g'), '[ \\t\\x0B\\f\\r]+', ' ', 'g'))"
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


PUNCT = r""".,;:!?"''()\[\]{}\-–—/\\@&%#+=*<>|"""
ALPHA = r"CASE WHEN length(t) = 0 THEN 0.0 ELSE length(regexp_replace(t, '[^\p{L}]', '', 'g')) / length(t) END"
SYMBOLS = rf"CASE WHEN length(t) = 0 THEN 1.0 ELSE length(regexp_replace(t, '[\p{{L}}\p{{Nd}}\s{PUNCT}]', '', 'g')) / length(t) END"
JUNK = rf"(length(t) < 80 OR ({ALPHA}) < 0.45 OR ({SYMBOLS}) > 0.55 OR regexp_matches(t, '^[\W_]*\d{{1,4}}[\W_]*$'))"
DOCS = f"d AS (SELECT doc_id, text, lang, source, 'doc://' || doc_id AS uri, {_norm()} AS t FROM documents)"
LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents)"
FIXED = f"""{DOCS},
f AS (SELECT doc_id, uri, t, unnest(range(CAST(greatest(ceil((length(t) - 900) / 792.0), 0) AS BIGINT) + 1)) AS ix FROM d WHERE length(t) > 0),
c AS (SELECT doc_id, ix, ix * 792 AS chunk_start, least(ix * 792 + 900, length(t)) AS chunk_end,
  sha256(concat_ws(':', sha256(uri), ix * 792, least(ix * 792 + 900, length(t)), sha256(t))) AS chunk_id, '/p=' || ix AS section FROM f)"""
TITLE = r"substring(CASE WHEN length(trim(regexp_extract(text, '(?m)^[ \t]*(\S[^\r\n]*)', 1))) > 0 THEN trim(regexp_extract(text, '(?m)^[ \t]*(\S[^\r\n]*)', 1)) ELSE regexp_replace(regexp_extract(uri, '([^/]*)/*$', 1), '\.[^.]*$', '') END, 1, 200)"
NOW = "now AS (SELECT 'doc://' || doc_id AS uri, CAST(length(text) AS BIGINT) AS length, CAST(0 AS BIGINT) AS mtime, sha256(text) AS sha256 FROM documents)"
BEFORE = """before AS (SELECT 'doc://' || doc_id AS uri, CAST(length(text) + (lang = 'de')::INT AS BIGINT) AS length, CAST((lang = 'fr')::INT AS BIGINT) AS mtime,
  CASE WHEN lang = 'de' THEN sha256(text || 'x') ELSE sha256(text) END AS sha256 FROM documents WHERE source <> 'src3')"""
SUSPECT = "suspect AS (SELECT n.* FROM now n LEFT JOIN before b USING (uri) WHERE b.uri IS NULL OR n.length <> b.length OR n.mtime <> b.mtime)"
V = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)"
SCORED = f"{V}, s AS (SELECT v.vec_id, round(list_cosine_similarity(v.e, q.e), 6) AS score FROM v, (SELECT e FROM v WHERE vec_id = 0) q)"
KNN = f"""{V}, p AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, q.label AS own, list_cosine_similarity(q.e, v.e) AS raw FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, vec_id) AS rank FROM p), k AS (SELECT * FROM r WHERE rank <= 5)"""
REFS = r"""(s LIKE 'references%' OR s LIKE 'acknowledg%' OR s LIKE '%in proceedings%' OR s LIKE '%acm press%' OR s LIKE '%conference on%'
  OR (len(regexp_extract_all(s, '\[[0-9]{1,3}\]')) >= 3 AND len(regexp_extract_all(s, '(19|20)\d{2}')) >= 2 AND len(regexp_extract_all(s, ',')) >= 6))"""
HITS = f"{SCORED}, h AS (SELECT d.doc_id, d.text, d.lang, d.source, s.score FROM documents d JOIN s ON s.vec_id = d.doc_id)"
SETS = r"""w AS (SELECT doc_id, string_split_regex(lower(text), '\W+') AS a FROM documents),
x AS (SELECT doc_id, list_distinct(CASE WHEN len(a) > 1 AND a[-1] = '' THEN a[1:len(a) - 1] ELSE a END) AS w FROM w)"""

# Re-ranking: the 30 best hits of each question, in the order in which the greedy rules take them.
ASKED = f"""{HITS}, a AS (SELECT source AS question, lang AS source, CAST(doc_id AS INTEGER) AS chunk_id, score, text FROM h QUALIFY row_number() OVER (PARTITION BY h.source ORDER BY score DESC, doc_id) <= 30),
o AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, source, chunk_id) AS place FROM a)"""
WORDS = r"x AS (SELECT question, place, score, list_distinct(string_split_regex(lower(text), '[^a-zA-Z0-9_]+')) AS w FROM o)"
# Each step takes the hit with the best score less likeness to those taken before.
TAKEN = "t1 AS (SELECT question, place, 0 AS pos FROM x QUALIFY row_number() OVER (PARTITION BY question ORDER BY CAST(0.7 AS DOUBLE) * score DESC, place) = 1)" + "".join(
    f""",
t{n + 1} AS (SELECT * FROM t{n} UNION ALL SELECT question, place, {n} FROM (
  SELECT x.question, x.place, any_value(x.score) AS score, max(len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w)))) AS same
  FROM x JOIN t{n} t ON t.question = x.question JOIN x y ON y.question = t.question AND y.place = t.place
  WHERE (x.question, x.place) NOT IN (SELECT (question, place) FROM t{n}) GROUP BY x.question, x.place)
  QUALIFY row_number() OVER (PARTITION BY question ORDER BY CAST(0.7 AS DOUBLE) * score - (CAST(1 AS DOUBLE) - CAST(0.7 AS DOUBLE)) * same DESC, place) = 1)"""
    for n in range(1, 5)
)

SQL = {
    "normalize_hash": f"WITH {DOCS} SELECT doc_id, length(t) AS norm_chars, sha256(t) AS content_hash, sha256(uri) AS doc_key FROM d",
    "text_quality": f"WITH {DOCS} SELECT doc_id, round({ALPHA}, 6) AS alpha, round({SYMBOLS}, 6) AS symbols, {JUNK} AS junk FROM d",
    "junk_archived": rf"""WITH {LINES}, n AS (SELECT doc_id, line_no, trim(regexp_replace(line, '\s+', ' ', 'g')) AS t FROM l),
  w AS (SELECT *, string_split_regex(t, '\s+') AS w FROM n)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, (length(t) < 40 OR regexp_matches(t, '^[\W_]*\d{{1,4}}[\W_]*$') OR len(list_filter(w, lambda x: regexp_matches(x, '^\p{{Nd}}*$'))) >= len(w) * 0.6) AS junk FROM w""",
    "lang_detect": rf"WITH {DOCS} SELECT doc_id, CASE WHEN length(t) = 0 OR length(regexp_replace(t, '[^\x00-\x7F]', '', 'g')) / length(t) > 0.95 THEN 'en' ELSE 'unk' END AS language FROM d",
    "doc_title": f"WITH {DOCS} SELECT doc_id, {TITLE} AS title FROM d",
    "relative_uri": "SELECT page_id, CASE WHEN url LIKE 'https://%' THEN substring(url, 9) ELSE url END AS rel FROM pages",
    "chunk_count": f"WITH {DOCS} SELECT doc_id, CAST(CASE WHEN length(t) <= 0 THEN 0 WHEN length(t) <= 900 THEN 1 ELSE ceil((length(t) - 900) / 792.0) + 1 END AS BIGINT) AS n_chunks FROM d",
    "chunk_fixed": f"WITH {FIXED} SELECT * FROM c",
    "chunk_sentence": rf"""WITH RECURSIVE {DOCS},
w AS (
  SELECT doc_id, t, CAST(0 AS BIGINT) AS s, CAST(CASE WHEN length(regexp_extract(t[1:900], '(?s)^(.*\.)', 1)) >= 541 THEN length(regexp_extract(t[1:900], '(?s)^(.*\.)', 1)) ELSE length(t[1:900]) END AS BIGINT) AS e FROM d WHERE length(t) > 0
  UNION ALL
  SELECT doc_id, t, n AS s, n + CASE WHEN length(regexp_extract(t[n + 1:n + 900], '(?s)^(.*\.)', 1)) >= 541 THEN length(regexp_extract(t[n + 1:n + 900], '(?s)^(.*\.)', 1)) ELSE length(t[n + 1:n + 900]) END AS e
  FROM (SELECT *, greatest(s + 1, e - 108) AS n FROM w WHERE e < length(t))),
p AS (SELECT doc_id, s + length(t[s + 1:e]) - length(ltrim(t[s + 1:e])) AS chunk_start, trim(t[s + 1:e]) AS t FROM w),
k AS (SELECT doc_id, chunk_start, t FROM p WHERE NOT {JUNK})
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_start) - 1 AS ix, chunk_start, chunk_start + length(t) AS chunk_end, sha256(t) AS sha FROM k""",
    "vocabulary": rf"""WITH w AS (SELECT unnest(string_split_regex(trim(regexp_replace(lower({_norm()}), '[^\p{{L}}]+', ' ', 'g')), '\s+')) AS term FROM documents),
c AS (SELECT term, count(*) AS total_tf FROM w WHERE length(term) >= 2 AND regexp_matches(term, '[aeiouy]') GROUP BY term)
SELECT term, row_number() OVER (ORDER BY total_tf DESC, term) - 1 AS token_id, total_tf FROM c""",
    "distinct_terms": rf"""WITH w AS (SELECT unnest(string_split_regex(trim(regexp_replace(lower({_norm()}), '[^\p{{L}}]+', ' ', 'g')), '\s+')) AS term FROM documents)
SELECT count(DISTINCT term) AS n_terms, count(*) AS n_words FROM w WHERE length(term) >= 2 AND regexp_matches(term, '[aeiouy]')""",
    "delta_candidates": f"WITH {NOW}, {BEFORE}, {SUSPECT} SELECT uri, length, mtime FROM suspect",
    "delta_changed": f"WITH {NOW}, {BEFORE}, {SUSPECT} SELECT s.uri, s.sha256 FROM suspect s LEFT JOIN before b USING (uri) WHERE b.uri IS NULL OR s.sha256 <> b.sha256",
    "manifest_next": f"WITH {NOW}, {BEFORE}, {SUSPECT} SELECT n.uri, n.length, n.mtime, coalesce(s.sha256, b.sha256, '') AS sha256 FROM now n LEFT JOIN before b USING (uri) LEFT JOIN suspect s USING (uri)",
    "anti_new_docs": f"""WITH {DOCS}, k AS (SELECT doc_id, lang, sha256(uri) AS docId, sha256(t) AS contentHash FROM d)
SELECT doc_id, docId, contentHash FROM k WHERE (docId, contentHash) NOT IN (SELECT (docId, contentHash) FROM k WHERE lang = 'en')""",
    "anti_missing_vectors": f"WITH {FIXED} SELECT doc_id, chunk_id FROM c ANTI JOIN (SELECT vec_id AS doc_id FROM embeddings WHERE label < 5) h USING (doc_id)",
    "latest_version": f"""WITH {DOCS}, u AS (SELECT doc_id, sha256(t) AS hash, 1 AS version FROM d UNION ALL SELECT doc_id, sha256(t || '2'), 2 FROM d WHERE lang = 'de' UNION ALL SELECT doc_id, sha256(t || '3'), 1 FROM d WHERE lang = 'fr')
SELECT doc_id, hash, version FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY version DESC, hash DESC) = 1""",
    "index_join": f"""WITH {FIXED} SELECT c.doc_id, sha256(d.t) AS contentHash, c.ix, c.chunk_id, CAST(len(e.embedding) AS BIGINT) AS dim
FROM c JOIN d USING (doc_id) JOIN embeddings e ON e.vec_id = c.doc_id""",
    "distinct_keys": f"WITH {DOCS} SELECT count(DISTINCT sha256(t)) AS n_versions FROM d",
    "union_dedupe": f"WITH {DOCS}, k AS (SELECT sha256(uri) AS docId, sha256(t) AS contentHash, lang FROM d) SELECT docId, contentHash FROM k UNION SELECT docId, contentHash FROM k WHERE lang = 'en'",
    "metrics_window": """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS runAt, epoch_ms(CAST(CAST(ts AS DATE) AS TIMESTAMP)) AS runAtMs, count(*) AS rows, round(sum(value), 3) AS total
FROM events GROUP BY CAST(ts AS DATE) ORDER BY CAST(ts AS DATE) DESC LIMIT 2""",
    "skip_reasons": f"""WITH {DOCS} SELECT CASE WHEN length(t) = 0 THEN 'empty' WHEN length(t) < 80 THEN 'short' WHEN ({ALPHA}) < 0.45 THEN 'not_text' WHEN ({SYMBOLS}) > 0.55 THEN 'symbols' ELSE 'kept' END AS reason, count(*) AS n FROM d GROUP BY 1""",
    "l2_normalize": f"""WITH {V}, n AS (SELECT vec_id, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n, e FROM v)
SELECT vec_id, round(n, 5) AS norm, CAST(CASE WHEN n = 0 THEN 0 ELSE 1 END AS DOUBLE) AS unit, round(CASE WHEN n = 0 THEN 0.0 ELSE e[1] / n END, 5) AS first FROM n""",
    "cosine_topk": f"WITH {SCORED} SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 5",
    "scaled_topk": f"WITH {V} SELECT v.vec_id, round((1 + list_cosine_similarity(v.e, q.e)) / 2, 6) AS score FROM v, (SELECT e FROM v WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 5",
    "dot_topk": f"WITH {V} SELECT v.vec_id, round(list_inner_product(v.e, q.e), 6) AS score FROM v, (SELECT e FROM v WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 5",
    "knn_all_pairs": f"WITH {KNN} SELECT query_id, vec_id, round(raw, 6) AS score, rank FROM k",
    "topk_sharded": f"WITH {SCORED}, b AS (SELECT vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id % 8 ORDER BY score DESC, vec_id) <= 5), m AS (SELECT * FROM b ORDER BY score DESC, vec_id DESC LIMIT 5) SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM m",
    "topk_merge_ties": "WITH m AS (SELECT round(value) AS score, user_id, event_id FROM events ORDER BY score DESC, user_id DESC, event_id DESC LIMIT 10) SELECT score, user_id, event_id, row_number() OVER (ORDER BY score DESC, user_id, event_id) AS rank FROM m",
    "analogy_topk": f"""WITH {V}, q AS (SELECT list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] - b.e[i] + c.e[i]) AS e FROM v a, v b, v c WHERE a.vec_id = 0 AND b.vec_id = 1 AND c.vec_id = 2)
SELECT v.vec_id, round(list_cosine_similarity(v.e, q.e), 6) AS score FROM v, q WHERE v.vec_id NOT IN (0, 1, 2) ORDER BY score DESC, vec_id LIMIT 5""",
    "accuracy_at_k": f"WITH {KNN}, j AS (SELECT query_id, max((label = own)::INT) AS hit FROM k GROUP BY query_id) SELECT count(*) AS n, round(avg(hit), 6) AS accuracy FROM j",
    "vector_validity": "SELECT vec_id, (label NOT IN (1, 2, 3)) AS valid FROM embeddings",
    "pair_similarity": f"""WITH {V} SELECT a.vec_id, round(list_inner_product(a.e, b.e), 6) AS dot, round(list_cosine_similarity(a.e, b.e), 6) AS cosine,
round(sqrt(list_inner_product(a.e, a.e)), 5) AS norm_a, round(sqrt(list_inner_product(b.e, b.e)), 5) AS norm_b FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""",
    "snippets": r"SELECT doc_id, sha256(substring(regexp_replace(text, '\s+', ' ', 'g'), 1, 600)) AS snippet, CASE WHEN length(text) > 2000 THEN 2003 ELSE length(text) END AS clipped FROM documents",
    "context_blocks": rf"""WITH {HITS}, k AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS pos FROM h QUALIFY pos < 5)
SELECT string_agg(printf('[%d] %s — %s (docId=%s, score=%.4f)', pos, source, '/p=0', CAST(doc_id AS VARCHAR), round(score, 4)) || chr(10) || substring(regexp_replace(text, '\s+', ' ', 'g'), 1, 600), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos) AS context FROM k""",
    "hit_blocks": f"""WITH {HITS} SELECT source, string_agg(printf('[%s #%d | score=%.4f]', lang, doc_id, round(score, 4)) || chr(10) || source, chr(10) || chr(10) ORDER BY score DESC, doc_id) AS context FROM h GROUP BY source""",
    "prompts": rf"""WITH {DOCS} SELECT doc_id, sha256('Question: ' || substring({TITLE}, 1, 300) || chr(10) || chr(10) || 'Use ONLY this context (truncated):' || chr(10) || substring(t, 1, 2048)) AS prompt FROM d""",
    "refs_filter": f"""WITH {LINES}, c AS (SELECT doc_id, line_no, trim(lower((CASE WHEN doc_id = line_no THEN 'References ' ELSE '' END) || line || (CASE WHEN length(line) > 100 THEN ' [1], [2], [30], 1999, 2004, a, b' ELSE '' END))) AS s FROM l)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, {REFS} AS refs FROM c""",
    "prefix_dedupe": f"WITH {LINES} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no FROM l WHERE length(line) > 0 QUALIFY row_number() OVER (PARTITION BY substring(line, 1, 160) ORDER BY doc_id, line_no) = 1",
    "jaccard": f"""WITH {SETS} SELECT a.doc_id, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS jaccard FROM x a JOIN x b ON b.doc_id = a.doc_id + 1""",
    "section_boost": "SELECT doc_id, CAST(round(0.5 + CASE lang WHEN 'en' THEN 0.08 WHEN 'fr' THEN 0.05 WHEN 'de' THEN 0.03 ELSE 0 END, 6) AS DOUBLE) AS score FROM documents",
    "parse_hits": "SELECT event_type, count(*) AS n, count(k) AS good, CAST(sum(k) AS BIGINT) AS total FROM (SELECT event_type, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(props->>'k' AS INTEGER) END AS k FROM events) GROUP BY event_type",
    "json_roundtrip": "SELECT doc_id, true AS same FROM documents",
    "cap_per_doc": f"""WITH {ASKED}, p AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY question, source, chunk_id // 1000 ORDER BY place) = 1),
k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY question, source ORDER BY place) <= 2)
SELECT question, source, chunk_id, score, CAST(row_number() OVER (PARTITION BY question ORDER BY place) - 1 AS INTEGER) AS pos FROM k""",
    "mmr": f"WITH {ASKED}, {WORDS}, {TAKEN} SELECT question, source, chunk_id, score, CAST(pos AS INTEGER) AS pos FROM t5 JOIN o USING (question, place)",
    "budget_pack": f"""WITH RECURSIVE {ASKED}, z AS (SELECT question, place, length(text) + 2 AS size FROM o),
g AS (SELECT question, place, size <= 6000 AS taken, CASE WHEN size <= 6000 THEN size ELSE 0 END AS used FROM z WHERE place = 1
  UNION ALL SELECT z.question, z.place, used + size <= 6000, CASE WHEN used + size <= 6000 THEN used + size ELSE used END FROM g JOIN z ON z.question = g.question AND z.place = g.place + 1)
SELECT question, source, chunk_id, score, CAST(row_number() OVER (PARTITION BY question ORDER BY place) - 1 AS INTEGER) AS pos FROM o JOIN g USING (question, place) WHERE taken""",
    "context_from_hits": rf"""WITH {HITS}, b AS (SELECT source AS run, score, 'doc://' || doc_id AS uri, trim(replace(regexp_replace(printf('[%s #%d | score=%.4f]', lang, doc_id, round(score, 4)) || chr(10) || text, '\s+', ' ', 'g'), ' ? ', '? ')) AS block
  FROM h WHERE length(text) > 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) <= 10),
f AS (SELECT *, trim(lower(block)) AS s FROM b QUALIFY row_number() OVER (PARTITION BY run, substring(block, 1, 160) ORDER BY score DESC, uri) = 1),
j AS (SELECT b.run, string_agg(block, chr(10) || chr(10) ORDER BY score DESC, uri) FILTER (length(block) >= 40 AND NOT {REFS}) AS c FROM f AS b GROUP BY b.run)
SELECT run, CASE WHEN length(c) > 2048 THEN substring(c, 1, 2048) || '…' ELSE coalesce(c, '') END AS context FROM j""",
    "embed_hashing": rf"""WITH {DOCS}, w AS (SELECT doc_id, unnest(string_split_regex(lower(t), '\s+')) AS w FROM d), k AS (SELECT doc_id, sha256(w) AS k FROM w WHERE length(w) > 0),
b AS (SELECT doc_id, CAST('0x' || k[7:8] AS INTEGER) % 64 AS bucket, sum(CASE WHEN CAST('0x' || k[10:10] AS INTEGER) % 2 = 1 THEN 1 ELSE -1 END) AS v FROM k GROUP BY ALL)
SELECT doc_id, CASE WHEN count(*) FILTER (v <> 0) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm, 64 AS dim, CAST(count(*) FILTER (v > 0) AS INTEGER) AS positive, CAST(count(*) FILTER (v < 0) AS INTEGER) AS negative
FROM d LEFT JOIN b USING (doc_id) GROUP BY doc_id""",
    "chunk_compat": rf"""WITH RECURSIVE {DOCS}, n AS MATERIALIZED (SELECT doc_id, t FROM d WHERE length(t) > 0),
w AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS s, CASE WHEN length(regexp_extract(t[1:900], '(?s)^(.*\.)', 1)) >= 541 THEN regexp_extract(t[1:900], '(?s)^(.*\.)', 1) ELSE t[1:900] END AS p FROM n
  UNION ALL
  SELECT doc_id, a, CASE WHEN length(regexp_extract(piece, '(?s)^(.*\.)', 1)) >= 541 THEN regexp_extract(piece, '(?s)^(.*\.)', 1) ELSE piece END
  FROM (SELECT doc_id, s + greatest(1, length(trim(p)) - 108) AS a, t[s + greatest(1, length(trim(p)) - 108) + 1:s + greatest(1, length(trim(p)) - 108) + 900] AS piece, t FROM w JOIN n USING (doc_id))
  WHERE a < length(t)),
q AS (SELECT doc_id, s, trim(p) AS t FROM w),
k AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS ix, t AS piece FROM q WHERE NOT {JUNK}),
m AS (
  SELECT doc_id, CAST(-1 AS BIGINT) AS ix, '' AS piece, CAST(0 AS BIGINT) AS place, CAST(0 AS BIGINT) AS stop FROM n
  UNION ALL
  SELECT k.doc_id, k.ix, k.piece, strpos(t[stop + 1:], k.piece), CASE WHEN strpos(t[stop + 1:], k.piece) > 0 THEN stop + strpos(t[stop + 1:], k.piece) - 1 + length(k.piece) ELSE stop END
  FROM m JOIN k ON k.doc_id = m.doc_id AND k.ix = m.ix + 1 JOIN n ON n.doc_id = m.doc_id)
SELECT doc_id, CAST(ix AS INTEGER) AS ix, CAST(stop - length(piece) AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end", sha256(piece) AS sha FROM m WHERE ix >= 0 AND place > 0""",
}
