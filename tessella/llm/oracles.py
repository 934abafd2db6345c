"""DuckDB SQL for the queries that SQL can express. The others are tested against brute force in tests/llm."""

WORDS = r"[x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> '']"

SQL: dict[str, str] = {
    "op3_tool_call_linking": """
WITH users AS (SELECT *, length(coalesce(text, '')) AS n FROM conversations WHERE role = 'user' AND length(coalesce(text, '')) % 19 <> 0),
calls AS (
  SELECT conv_id || ':' || turn AS call_id, conv_id, turn, n,
    CASE WHEN n % 17 = 0 THEN 'resume' WHEN turn < 2 THEN 'open' WHEN turn = 4 THEN 'compare' ELSE 'continue' END AS name,
    CASE WHEN n % 31 = 0 THEN '[1]' ELSE
      '{"meta":{"chars":' || n || ',"role":"' || CASE WHEN n % 23 = 0 THEN 'guest' ELSE 'user' END || '"}' || CASE WHEN n % 29 = 0 THEN ',"mood":"odd"' ELSE '' END
      || CASE WHEN turn = 4 THEN ',"previous":[2,0]' WHEN turn >= 2 THEN ',"previous":' || (turn - 2) ELSE '' END || CASE WHEN n % 11 <> 0 THEN ',"text":' || to_json(coalesce(text, ''))::VARCHAR ELSE '' END
      || ',"turn":' || CASE WHEN n % 13 = 0 THEN '"' || turn || '"' ELSE turn::VARCHAR END || '}' END AS arguments,
    CASE WHEN n % 17 = 0 THEN ['no such tool'] WHEN n % 31 = 0 THEN ['not a JSON object'] ELSE [x for x in [
      CASE WHEN n % 11 = 0 THEN 'missing text' END, CASE WHEN n % 13 = 0 THEN 'type of turn' END, CASE WHEN n % 23 = 0 THEN 'value of meta.role' END,
      CASE WHEN n % 11 <> 0 AND n NOT BETWEEN 1 AND 300 THEN 'length of text' END, CASE WHEN n % 29 = 0 THEN 'unknown mood' END] if x IS NOT NULL] END AS errors
  FROM users),
results AS (SELECT conv_id || ':' || (turn - 1) AS call_id, coalesce(text, '') AS content FROM conversations WHERE role = 'assistant'),
edges AS (
  SELECT c.call_id, a.call_id AS after FROM calls c JOIN calls a ON a.conv_id = c.conv_id AND (a.turn = c.turn - 2 OR (c.turn = 4 AND a.turn = 0))),
chain AS (
  WITH RECURSIVE c AS (
    SELECT call_id, 0::BIGINT AS depth FROM calls WHERE call_id NOT IN (SELECT call_id FROM edges)
    UNION SELECT edges.call_id, depth + 1 FROM edges JOIN c ON edges.after = c.call_id)
  SELECT call_id, max(depth) AS depth FROM c GROUP BY 1),
linked AS (
  SELECT coalesce(calls.call_id, results.call_id) AS call_id, name, depth, arguments, content, errors, (calls.call_id IS NOT NULL)::BIGINT AS n_calls, (results.call_id IS NOT NULL)::BIGINT AS n_results,
    CASE WHEN calls.call_id IS NULL THEN 'orphan' WHEN results.call_id IS NULL THEN 'unanswered' ELSE 'answered' END AS status
  FROM calls JOIN chain USING (call_id) FULL JOIN results ON calls.call_id = results.call_id),
written AS (
  SELECT *, '{' || CASE WHEN arguments IS NULL THEN '' ELSE '"arguments":' || arguments || ',' END || '"call":"' || call_id || '"' || CASE WHEN depth IS NULL THEN '' ELSE ',"depth":' || depth END
  || CASE WHEN name IS NULL THEN '' ELSE ',"name":"' || name || '"' END || CASE WHEN content IS NULL THEN '' ELSE ',"result":' || to_json(content)::VARCHAR END || ',"status":"' || status || '"}' AS json
  FROM linked)
SELECT call_id, name, depth, status, n_calls, n_results, array_to_string(list_sort(coalesce(errors, [])), ';') AS errors, length(json)::BIGINT AS json_chars, md5(json) AS json_md5 FROM written""",
    "op4_benchmark_decontamination": f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
grams AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, grams.n, item_id FROM grams JOIN windows ON grams.n = windows.n AND grams.phrase = windows.phrase),
covered AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY 1),
terms AS (SELECT term, count(*) AS n FROM (SELECT unnest(w) AS term FROM d) GROUP BY 1),
phrases AS (SELECT DISTINCT phrase, n AS len, str_split(phrase, ' ') AS words FROM windows),
ranked AS (
  SELECT phrase, len, term, row_number() OVER (PARTITION BY phrase ORDER BY terms.n, term, spot) AS r, count(*) OVER (PARTITION BY phrase) AS found
  FROM (SELECT phrase, len, unnest(words) AS term, generate_subscripts(words, 1) AS spot FROM phrases) JOIN terms USING (term)),
pairs AS (SELECT DISTINCT a.term AS term_a, b.term AS term_b FROM ranked a JOIN ranked b ON a.phrase = b.phrase AND a.r = 1 AND b.r = 2 WHERE a.found = a.len),
places AS (SELECT * FROM (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS spot FROM d) WHERE term IN (SELECT term_a FROM pairs UNION SELECT term_b FROM pairs)),
near AS (
  SELECT a.doc_id, count(*) AS n_near FROM pairs JOIN places a ON a.term = term_a JOIN places b ON b.doc_id = a.doc_id AND b.term = term_b
  WHERE abs(a.spot - b.spot) <= 10 AND (term_a <> term_b OR a.spot < b.spot) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)""",
}
