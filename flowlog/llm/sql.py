"""Expected results in DuckDB SQL."""

MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT source, source_size, CAST(2 * source_size AS DOUBLE) AS cap,
         CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS w
  FROM totals),
running AS (
  SELECT *, coalesce(sum(cap) OVER b, 0) AS cap_before, coalesce(sum(w) OVER b, 0) AS w_before,
         sum(w) OVER () AS w_all, (SELECT sum(source_size) FROM totals) * 1.5 AS budget
  FROM weighted WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stopped AS (
  SELECT *, w * CAST((budget - cap_before) AS DOUBLE) / (w_all - w_before) >= cap AS is_stopped FROM running),
targets AS (
  SELECT source, source_size,
         CASE WHEN is_stopped THEN cap
              ELSE w * CAST(budget - coalesce((SELECT sum(cap) FROM stopped WHERE is_stopped), 0) AS DOUBLE)
                   / (w_all - coalesce((SELECT sum(w) FROM stopped WHERE is_stopped), 0)) END AS target
  FROM stopped),
quotas AS (
  SELECT *, CAST(round(target) AS BIGINT) // greatest(source_size, 1) AS copies,
         CAST(round(target) AS BIGINT) % greatest(source_size, 1) AS rest
  FROM targets),
tied AS (SELECT source, h, CAST(sum(size) AS BIGINT) AS tokens FROM sized GROUP BY source, h),
summed AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY source ORDER BY h) AS BIGINT) - tokens AS before FROM tied)
SELECT d.doc_id, d.size, q.source_size, q.target,
       CAST(q.copies * d.size + CASE WHEN s.before + s.tokens <= q.rest THEN d.size
            WHEN s.before < q.rest THEN CAST(d.size AS HUGEINT) * (q.rest - s.before) // s.tokens ELSE 0 END AS BIGINT) AS taken
FROM sized d JOIN quotas q ON d.source IS NOT DISTINCT FROM q.source
JOIN summed s ON d.source IS NOT DISTINCT FROM s.source AND d.h = s.h
"""

DIVERGENCE_SQL = r"""
WITH docs AS (
    SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
        regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents),
uses AS (SELECT lang, source, doc, unnest(terms) AS item FROM docs),
kept AS (SELECT lang, item FROM uses GROUP BY lang, item HAVING count(DISTINCT doc) >= 10),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, item, count(*) AS n FROM uses JOIN kept USING (lang, item) GROUP BY lang, source, item),
sums AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
lang_counts AS (SELECT lang, item, sum(n) AS n FROM counts GROUP BY lang, item),
lang_sums AS (SELECT lang, sum(n) AS total FROM lang_counts GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
cells AS (
    SELECT g.lang, g.source, k.item, coalesce(c.n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.total, 0) + 2 * z.v) AS p
    FROM groups g JOIN kept k ON g.lang = k.lang JOIN sizes z ON g.lang = z.lang
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.item = k.item
    LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source),
lang_cells AS (
    SELECT c.lang, c.item, 1 + (1000000000::HUGEINT * (c.n + 2)) // (s.total + 2 * z.v) AS q
    FROM lang_counts c JOIN lang_sums s ON s.lang = c.lang JOIN sizes z ON z.lang = c.lang),
gaps AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM cells a JOIN cells b ON a.lang = b.lang AND a.item = b.item AND a.source <> b.source
    GROUP BY a.lang, a.source, b.source),
pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(g.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN gaps g ON g.lang = a.lang AND g.source = a.source AND g.item = b.source),
overused AS (
    SELECT c.lang, c.source, 'term' AS part, c.item, (c.p - q.q) * (c.p - q.q) // (c.p + q.q) AS value
    FROM cells c JOIN lang_cells q ON q.lang = c.lang AND q.item = c.item WHERE c.n > 0 AND c.p > q.q),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS place
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM overused))
SELECT lang, source, part, item, value::BIGINT AS value, place::INTEGER AS rank
FROM ranked WHERE part = 'pair' OR place <= 10
"""

REPAIR_SQL = r"""
WITH RECURSIVE named AS (
    SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        list_transform(
            range(1, 1 + length(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))),
            lambda i: ascii(substr(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), i, 1))::UBIGINT) AS name
    FROM conversations),
hashed AS (
    SELECT conv, turn, role, text, xor(4294967295::UBIGINT, list_reduce(
        list_concat([4294967295::UBIGINT], name),
        lambda c, b: list_reduce(
            [xor(c, b), 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT],
            lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1))))) % 20 AS way
    FROM named),
damaged AS (
    SELECT conv, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role,
        CASE way WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE way WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM hashed),
stripped AS (SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM damaged),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text)) AS place,
        left(role, 1) AS initial
    FROM stripped),
marked AS (
    SELECT *, body = '' AS blank,
        body <> '' AND row_number() OVER (PARTITION BY conv, role, text ORDER BY place) > 1 AS duplicate,
        lag(initial) OVER (PARTITION BY conv ORDER BY place) AS before,
        count(*) OVER (PARTITION BY conv) AS size
    FROM placed),
elements AS (
    SELECT *, NOT blank AND NOT duplicate AND right(body, 1) NOT IN ('.', '!', '?') AS truncated FROM marked),
convs AS (SELECT DISTINCT conv_id AS conv FROM conversations),
sums AS (
    SELECT c.conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
        count(*) FILTER (blank)::BIGINT AS blank, count(*) FILTER (duplicate)::BIGINT AS duplicate,
        count(*) FILTER (truncated)::BIGINT AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal
    FROM convs c LEFT JOIN elements e ON e.conv IS NOT DISTINCT FROM c.conv AND e.place IS NOT NULL GROUP BY c.conv),
-- costs of the rest before each row, from each state: start, after system, after user, after assistant
costs AS (
    SELECT c.conv, coalesce(max(e.size), 0) AS place, 0 AS q0, 4 AS q1, 2 AS q2, 0 AS q3
    FROM convs c LEFT JOIN elements e ON e.conv IS NOT DISTINCT FROM c.conv GROUP BY c.conv
    UNION ALL
    SELECT conv, place, least(x0, 2 + least(x2, 2 + x3)), least(x1, 2 + least(x2, 2 + x3)), least(x2, 2 + x3), least(x3, 2 + x2)
    FROM (
        SELECT k.conv, k.place - 1 AS place,
            CASE WHEN gone THEN 3 + q0
                ELSE least(3 + q0, t + q2 + CASE WHEN initial = 'u' THEN 0 ELSE 2 END, CASE WHEN initial = 's' THEN t + q1 END) END AS x0,
            CASE WHEN gone THEN 3 + q1 ELSE least(3 + q1, t + q2 + CASE WHEN initial = 'u' THEN 0 ELSE 2 END) END AS x1,
            CASE WHEN gone THEN 3 + q2 ELSE least(3 + q2, t + q3 + CASE WHEN initial = 'a' THEN 0 ELSE 2 END) END AS x2,
            CASE WHEN gone THEN 3 + q3 ELSE least(3 + q3, t + q2 + CASE WHEN initial = 'u' THEN 0 ELSE 2 END) END AS x3
        FROM costs k JOIN (
            SELECT conv, place, blank OR duplicate AS gone, truncated::INTEGER AS t, initial FROM elements
        ) e ON e.conv IS NOT DISTINCT FROM k.conv AND e.place = k.place)),
vectors AS (SELECT conv, place, [q0, q1, q2, q3] AS q FROM costs),
-- one edit at a time: D, I, K, R in this order where it keeps the cost; place is the number of rows done
walk AS (
    SELECT conv, 0::BIGINT AS place, 1 AS state, '' AS audit, NULL::VARCHAR AS text FROM convs
    UNION ALL
    SELECT conv, CASE edit WHEN 'I' THEN place ELSE place + 1 END, CASE edit WHEN 'D' THEN state WHEN 'S' THEN 2 ELSE following END,
        audit || CASE edit WHEN 'S' THEN 'K' ELSE edit END,
        CASE WHEN edit = 'D' THEN text ELSE coalesce(text || chr(10), '') || CASE
            WHEN edit IN ('K', 'S') THEN role || ':' || body
            WHEN edit = 'R' THEN new_role || ':' || body ELSE new_role || ':' END END
    FROM (
        SELECT *, CASE WHEN after IS NULL THEN CASE WHEN now[state] > 0 THEN 'I' END
            WHEN 3 + after[state] = now[state] THEN 'D'
            WHEN 2 + now[following] = now[state] THEN 'I'
            WHEN gone THEN 'D'
            WHEN initial = 's' AND state = 1 AND t + after[2] = now[state] THEN 'S'
            WHEN initial = left(new_role, 1) AND t + after[following] = now[state] THEN 'K'
            ELSE 'R' END AS edit
        FROM (
            SELECT w.*, CASE w.state WHEN 3 THEN 4 ELSE 3 END AS following,
                CASE w.state WHEN 3 THEN 'assistant' ELSE 'user' END AS new_role,
                v.q AS now, n.q AS after, e.blank OR e.duplicate AS gone, e.truncated::INTEGER AS t, e.initial, e.role, e.text AS body
            FROM walk w JOIN vectors v ON v.conv IS NOT DISTINCT FROM w.conv AND v.place = w.place
            LEFT JOIN vectors n ON n.conv IS NOT DISTINCT FROM w.conv AND n.place = w.place + 1
            LEFT JOIN elements e ON e.conv IS NOT DISTINCT FROM w.conv AND e.place = w.place + 1))
    WHERE edit IS NOT NULL),
ends AS (
    SELECT conv, arg_max(audit, length(audit)) AS audit, arg_max(coalesce(text, ''), length(audit)) AS text FROM walk GROUP BY conv)
SELECT s.conv AS conv_id, gaps, blank, duplicate, truncated, illegal, v.q[1]::BIGINT AS cost, e.audit,
    sha256(e.text) AS repaired_sha256
FROM sums s JOIN vectors v ON v.conv IS NOT DISTINCT FROM s.conv AND v.place = 0
JOIN ends e ON e.conv IS NOT DISTINCT FROM s.conv
"""
