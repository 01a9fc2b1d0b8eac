"""ANSI SQL with the expected result of each registered query."""

from __future__ import annotations

LOGS = """
logs AS (
  SELECT *, concat(protocol, ' ', action, ' from ', coalesce(src_ip, 'None'), ':',
      cast(src_port AS varchar), ' to ', coalesce(dst_ip, 'None'), ':',
      coalesce(cast(dst_port AS varchar), 'None'), ', bytes=',
      coalesce(cast(bytes AS varchar), 'None')) AS message
  FROM (
    SELECT event_id AS id,
      concat('capture_', cast(event_id % 4 AS varchar), '.csv') AS source_file,
      strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp,
      ts AS event_ts,
      CASE WHEN event_id % 97 = 0 THEN NULL
           ELSE concat('10.0.', cast(user_id // 50 AS varchar), '.',
                       cast(user_id % 50 AS varchar)) END AS src_ip,
      CASE WHEN k % 10 = 0 THEN concat('10.0.0.', cast(k // 10 AS varchar))
           ELSE concat('192.168.1.', cast(k AS varchar)) END AS dst_ip,
      cast(1024 + event_id % 64000 AS int) AS src_port,
      cast(CASE WHEN event_id % 89 = 0 THEN NULL
                WHEN event_id % 3 = 0 THEN 1000 + k
                WHEN user_id % 4 = 0 THEN 443
                ELSE CASE k % 8 WHEN 0 THEN 22 WHEN 1 THEN 23 WHEN 2 THEN 80 WHEN 3 THEN 443
                                WHEN 4 THEN 3306 WHEN 5 THEN 3389 WHEN 6 THEN 8080 ELSE 53 END
           END AS int) AS dst_port,
      CASE event_id % 5 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' WHEN 2 THEN 'ICMP'
                        WHEN 3 THEN 'HOPOPT' ELSE 'UNKNOWN' END AS protocol,
      CASE WHEN event_type = 'click' AND user_id % 5 <> 0 THEN 'SYN'
           WHEN event_type = 'purchase' AND user_id % 3 = 0 THEN 'PSH'
           WHEN event_type = 'signup' THEN 'FIN'
           WHEN event_type = 'error' THEN 'RST'
           ELSE 'ACK' END AS action,
      CASE WHEN event_id % 83 = 0 THEN NULL ELSE cast(floor(value * 100) AS bigint) END AS bytes
    FROM (SELECT *, cast(json_extract_string(props, '$.k') AS int) AS k FROM events)
  )
)"""

RECORD = (
    "id, source_file, timestamp, src_ip, dst_ip, src_port, dst_port, protocol, bytes, action, message"
)

FILES = """
old_files AS (
  SELECT concat(src_ip, '.csv') AS filename, min(event_ts) AS uploaded_at, count(*) AS rows,
         count(*) % 2 = 0 AS indexed
  FROM logs WHERE event_ts < TIMESTAMP '2024-01-16 00:00:00' AND src_ip IS NOT NULL
  GROUP BY src_ip
),
new_files AS (
  SELECT concat(dst_ip, '.csv') AS filename, min(event_ts) AS uploaded_at, count(*) AS rows
  FROM logs WHERE event_ts >= TIMESTAMP '2024-01-16 00:00:00' AND dst_ip IS NOT NULL
  GROUP BY dst_ip
),
merged AS (
  SELECT coalesce(o.filename, n.filename) AS filename,
         coalesce(o.uploaded_at, n.uploaded_at) AS uploaded_at,
         coalesce(n.rows, o.rows) AS rows,
         coalesce(o.indexed, false) AS indexed
  FROM old_files o FULL JOIN new_files n ON o.filename = n.filename
),
inventory AS (
  SELECT filename, uploaded_at, rows,
         indexed OR filename IN (SELECT concat(src_ip, '.csv') FROM logs
                                 WHERE action = 'PSH' AND src_ip IS NOT NULL) AS indexed
  FROM merged
)"""

FILE_ROW = "filename, strftime(uploaded_at, '%Y-%m-%d %H:%M:%S.%f') AS uploaded_at, rows, indexed"

RAW_REPORTS = """
raw AS (
  SELECT id, event_ts, action, cast(id % 6 AS int) AS evidence_count,
    CASE id % 7
      WHEN 0 THEN concat('{"risk_level": "HIGH", "summary": "', message, '", "key_indicators": ["',
          action, '", "', protocol, '"], "recommended_actions": ["check ', dst_ip,
          '"], "evidence_highlights": [{"id": "', cast(id AS varchar), '", "reason": "', action, '"}]}')
      WHEN 1 THEN concat('```json', chr(10), '{"risk_level": "LOW", "summary": "', message,
          '", "key_indicators": ["', protocol, '"]}', chr(10), '```')
      WHEN 2 THEN concat('```', chr(10), '{"risk_level": "MEDIUM", "recommended_actions": ["', action, '"]}')
      WHEN 3 THEN concat('no report for ', message)
      WHEN 4 THEN concat('{''risk_level'': ''', action, '''}')
      WHEN 5 THEN concat('{"risk_level": "LOW", "key_indicators": "', action, '"}')
      ELSE concat('  {"risk_level": "', action, '"}  ')
    END AS text
  FROM logs
),
bodies AS (
  SELECT *, CASE WHEN starts_with(text, '```')
      THEN trim(regexp_replace(split_part(text, '```', 2), '^json', ''), concat(' ', chr(10)))
      ELSE trim(text) END AS body
  FROM raw
),
parsed AS (
  SELECT *, CASE WHEN json_valid(body) THEN body END AS j FROM bodies
)"""


def _list(path: str) -> str:
    return (
        f"coalesce(CASE WHEN json_type(j, '{path}') = 'ARRAY' "
        f"THEN array_to_string(cast(json_extract(j, '{path}') AS varchar[]), '|') END, '')"
    )


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes} {body}"


def _logs(body: str) -> str:
    return _with(LOGS, body)


def _dist(column: str) -> str:
    return _logs(
        f"SELECT {column}, count(*) AS count, cast(floor(count(*) / max(count(*)) OVER () * 100 + 0.5)"
        f" AS bigint) AS pct FROM logs GROUP BY {column}"
    )


_SERVICE = """CASE dst_port WHEN 22 THEN 'SSH' WHEN 23 THEN 'Telnet' WHEN 80 THEN 'HTTP'
  WHEN 443 THEN 'HTTPS' WHEN 3306 THEN 'MySQL' WHEN 3389 THEN 'RDP' WHEN 8080 THEN 'HTTP-alt'
  ELSE '' END AS service"""


def _top(column: str, extra: str = "") -> str:
    return _logs(
        f"""SELECT {column}, count, cast(floor(count / max(count) OVER () * 100 + 0.5) AS bigint) AS pct
        {extra} FROM (SELECT {column}, count(*) AS count FROM logs WHERE {column} IS NOT NULL
        GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 10)"""
    )


def _ip_top(column: str, extra: str = "") -> str:
    return _logs(
        f"""SELECT ip, {column}, count, rank,
        cast(floor(count / max(count) OVER (PARTITION BY ip) * 100 + 0.5) AS bigint) AS pct {extra}
        FROM (SELECT src_ip AS ip, {column}, count(*) AS count, cast(row_number() OVER
              (PARTITION BY src_ip ORDER BY count(*) DESC, {column}) AS int) AS rank
              FROM logs WHERE src_ip IS NOT NULL AND {column} IS NOT NULL GROUP BY src_ip, {column})
        WHERE rank <= 10"""
    )


def _search(where: str, limit: int) -> str:
    return _logs(f"SELECT {RECORD} FROM logs WHERE {where} ORDER BY event_ts DESC, id DESC LIMIT {limit}")


def _anywhere(pattern: str) -> str:
    fields = ("message", "src_ip", "dst_ip", "action", "protocol")
    return "(" + " OR ".join(f"coalesce({f}, '') ILIKE {pattern}" for f in fields) + ")"


_KEYWORD_QUERIES = """
queries AS (SELECT DISTINCT concat(lower(protocol), ' ', action) AS query_id,
                   lower(protocol) AS t1, action AS t2 FROM logs)"""

_VECTORS = """
turned AS (
  SELECT l.*, cast(e.embedding AS double[]) AS e,
         cast((l.id // (SELECT count(*) FROM embeddings)) % len(e.embedding) AS int) AS turn
  FROM logs l JOIN embeddings e ON e.vec_id = l.id % (SELECT count(*) FROM embeddings)
),
vectors AS (
  SELECT id, list_concat(e[turn + 1:], e[1:turn]) AS v, message AS document, source_file, action, protocol,
         coalesce(src_ip, '') AS src_ip, coalesce(bytes, 0) AS bytes
  FROM turned
)"""

_ASKED = """
queries AS (
  SELECT a.vec_id AS query_id,
         list_transform(list_zip(a.embedding, b.embedding),
                        lambda p: cast(p[1] AS double) * 0.75 + cast(p[2] AS double) * 0.25) AS q
  FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM embeddings)
)"""


def _nearest(queries: str, k: int) -> str:
    """Ranked neighbours of every row of ``queries (query_id, q)``."""
    return f"""
nearest AS (
  SELECT * FROM (
    SELECT query_id, id, d, cast(row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS int) AS rank
    FROM (SELECT query_id, id, pow(list_distance(q, v), 2) AS d FROM {queries} CROSS JOIN vectors))
  WHERE rank <= {k}
)"""


_KNN = (
    _with(
        f"{LOGS}, {_VECTORS}, {_ASKED}, {_nearest('queries', 5)}",
        """SELECT query_id, rank, id, round(d, 6) AS distance,
        cast(greatest(0, floor((1 - d / 2) * 100 + 0.5)) AS bigint) AS similarity, document, src_ip, bytes
        FROM nearest JOIN vectors USING (id)""",
    )
)

_PAIRED = """
paired AS (
  SELECT query AS query_id, query, v AS q, lower(protocol) AS t1, action AS t2 FROM (
    SELECT *, row_number() OVER (PARTITION BY query ORDER BY id) AS r
    FROM (SELECT *, concat(lower(protocol), ' ', action) AS query FROM vectors))
  WHERE r = 1
)"""


def _batch(queries: str, k: int) -> str:
    terms = [_anywhere(f"concat('%', {t}, '%')") for t in ("t1", "t2")]
    return f"""
hits AS (
  SELECT * FROM (
    SELECT query_id, logs.*, cast(row_number() OVER
        (PARTITION BY query_id ORDER BY event_ts DESC, id DESC) AS int) AS rank
    FROM {queries} JOIN logs ON {terms[0]} AND {terms[1]})
  WHERE rank <= {k}
)"""


_BYTES_TEXT = """CASE WHEN total_bytes = 0 THEN '0 B' WHEN total_bytes < 1024 THEN concat(total_bytes, ' B')
  WHEN total_bytes < 1048576 THEN concat(cast(cast(round(total_bytes / 1024, 1) AS decimal(20,1)) AS varchar), ' KB')
  ELSE concat(cast(cast(round(total_bytes / 1048576, 1) AS decimal(20,1)) AS varchar), ' MB') END AS bytes_text"""

_CUBE = """SELECT 'protocol' AS dimension, protocol AS value, count(*) AS count FROM logs GROUP BY protocol
        UNION ALL SELECT 'action', action, count(*) FROM logs GROUP BY action
        UNION ALL SELECT 'total', NULL, count(*) FROM logs
        UNION ALL (SELECT 'src_ip', src_ip, count(*) FROM logs WHERE src_ip IS NOT NULL
                   GROUP BY src_ip ORDER BY count(*) DESC, src_ip LIMIT 10)
        UNION ALL (SELECT 'dst_port', cast(dst_port AS varchar), count(*) FROM logs
                   WHERE dst_port IS NOT NULL GROUP BY dst_port ORDER BY count(*) DESC, dst_port LIMIT 10)"""

_HEADERS = [
    "Source IP|Source Port|Destination IP|Destination Port|Protocol|Timestamp"
    "|Total Length of Fwd Packets|Label",
    "timestamp|src_ip|dst_ip|src_port|dst_port|protocol|bytes|action",
    "time|src|dst|sport|dport|proto|len|flag",
    "action|bytes|protocol|dst_port|src_port|dst_ip|src_ip|timestamp",
]

ORACLE: dict[str, str] = {
    "read_log_csv": _logs(
        "SELECT CASE id % 4 "
        + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(_HEADERS))
        + " END AS header, count(*) AS rows, count(src_ip) AS with_source FROM logs GROUP BY id % 4"
    ),
    "read_quoted_csv": _logs(
        """SELECT id, row_number() OVER (ORDER BY id) - 1 AS row_index,
        CASE id % 9
            WHEN 0 THEN concat(action, chr(10), id, ',"x"', chr(10))
            WHEN 1 THEN concat('"', action, '"')
            WHEN 2 THEN concat(action, ', "', id)
            WHEN 3 THEN concat(chr(10), chr(10), action, chr(10), '"', chr(10), ',')
            WHEN 4 THEN repeat(concat(action, ',', chr(10)), 20)
            ELSE action END AS note,
        coalesce(src_ip, '') AS src_ip, bytes, false AS corrupt FROM logs"""
    ),
    "normalize_csv": _logs(
        """SELECT timestamp AS event_ts, src_ip, dst_ip, src_port, dst_port, protocol, bytes, action,
        message, CASE WHEN bytes IS NOT NULL THEN CASE id % 4 WHEN 0 THEN 'Total Length of Fwd Packets'
        WHEN 2 THEN 'len' ELSE 'bytes' END END AS bytes_source, 'network|log' AS tags FROM logs"""
    ),
    "upload_preview": _logs(
        """SELECT source_file, max(n) AS rows, 12 AS n_columns,
        string_agg(message, '|' ORDER BY id) AS first_messages
        FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY id) AS r,
                     count(*) OVER (PARTITION BY source_file) AS n FROM logs)
        WHERE r <= 5 GROUP BY source_file"""
    ),
    "replace_source": _logs(
        f"""SELECT id, source_file, timestamp, src_ip, dst_ip, src_port, dst_port, protocol,
        CASE WHEN source_file IN ('capture_1.csv', 'capture_2.csv') THEN bytes + 1 ELSE bytes END AS bytes,
        action, message FROM logs
        WHERE source_file NOT IN ('capture_1.csv', 'capture_2.csv') OR action = 'SYN'"""
    ),
    "upsert_files": _with(f"{LOGS}, {FILES}", f"SELECT {FILE_ROW} FROM merged"),
    "file_inventory": _with(f"{LOGS}, {FILES}", f"SELECT {FILE_ROW} FROM inventory"),
    "recent_files": _with(
        f"{LOGS}, {FILES}",
        f"SELECT {FILE_ROW} FROM (SELECT * FROM inventory ORDER BY uploaded_at DESC, filename LIMIT 5)",
    ),
    "upsert_vectors": """
        SELECT vec_id AS id, label, round(cast(embedding[1] AS double), 6) AS first
        FROM embeddings WHERE label >= 5
        UNION ALL SELECT vec_id, label, round(cast(embedding[-1] AS double), 6) FROM embeddings WHERE label < 5
        UNION ALL SELECT -vec_id - 1, label, round(cast(embedding[-1] AS double), 6)
        FROM embeddings WHERE label >= 5""",
    "append_history": _with(
        f"{LOGS}, {RAW_REPORTS}",
        """SELECT concat('what is ', action) AS query, json_extract_string(j, '$.risk_level') AS risk_level,
        CASE WHEN json_type(j, '$.key_indicators') = 'ARRAY'
             THEN replace(cast(json_extract(j, '$.key_indicators') AS varchar), ' ', '') ELSE '[]' END
          AS key_indicators,
        CASE WHEN json_type(j, '$.recommended_actions') = 'ARRAY'
             THEN cast(json_extract(j, '$.recommended_actions') AS varchar) ELSE '[]' END
          AS recommended_actions,
        count(*) AS count, cast(sum(evidence_count) AS bigint) AS evidence
        FROM parsed GROUP BY ALL""",
    ),
    "query_history": _logs(
        """SELECT id, timestamp AS queried_at, concat('what is ', action) AS query,
        cast(id % 10 + 1 AS int) AS top_k,
        CASE action WHEN 'PSH' THEN 'HIGH' WHEN 'SYN' THEN 'MEDIUM' WHEN 'ACK' THEN 'LOW' END AS risk_level,
        CASE action WHEN 'PSH' THEN 'high' WHEN 'SYN' THEN 'medium' WHEN 'ACK' THEN 'low' ELSE '' END
          AS risk_class,
        message AS summary, CASE WHEN id % 7 <> 0 THEN concat(action, '|', protocol) ELSE '' END
          AS key_indicators,
        0 AS n_actions, cast(id % 6 AS int) AS evidence_count
        FROM logs ORDER BY event_ts DESC, id DESC LIMIT 50"""
    ),
    "sample_cap": _logs(
        """SELECT source_file, least(1000, count(*)) AS sampled, least(1000, count(*)) AS distinct_ids
        FROM logs GROUP BY source_file"""
    ),
    "vector_records": _logs(
        """SELECT concat(source_file, ':', row_number() OVER (PARTITION BY source_file ORDER BY id) - 1) AS id,
        message AS document, timestamp, coalesce(src_ip, '') AS src_ip, coalesce(dst_ip, '') AS dst_ip,
        src_port, coalesce(dst_port, 0) AS dst_port, protocol, action, coalesce(bytes, 0) AS bytes,
        source_file AS source FROM logs"""
    ),
    "filter_logs": _search(
        """src_ip LIKE '%10.0.%' AND dst_ip LIKE '%168.1.%' AND protocol = 'TCP' AND action = 'ACK'
        AND event_ts >= TIMESTAMP '2024-01-21 00:00:00'""",
        500,
    ),
    "filter_logs_by_file": _search("src_ip LIKE '%0_0.%.1%' AND source_file = 'capture_3.csv'", 500),
    "keyword_search": _search(f"{_anywhere(chr(39) + '%syn%' + chr(39))} AND "
                              f"{_anywhere(chr(39) + '%192.168.1.7%' + chr(39))}", 10),
    "keyword_search_wildcard": _search(f"{_anywhere(chr(39) + '%t_p%' + chr(39))} AND "
                                       f"{_anywhere(chr(39) + '%p%h%' + chr(39))}", 50),
    "keyword_search_documents": """
        SELECT doc_id AS id, lang, source, n_chars FROM documents
        WHERE (text ILIKE '%THE%' OR lang ILIKE '%THE%' OR source ILIKE '%THE%')
          AND (text ILIKE '%src_%' OR lang ILIKE '%src_%' OR source ILIKE '%src_%')
        ORDER BY doc_id DESC LIMIT 25""",
    "keyword_search_batch": _with(
        f"{LOGS}, {_KEYWORD_QUERIES}, {_batch('queries', 10)}",
        f"SELECT query_id, rank, {RECORD} FROM hits",
    ),
    "keyword_search_many": _with(
        f"""{LOGS}, queries AS (SELECT DISTINCT concat(action, ' ', dst_ip) AS query_id, action AS t1, dst_ip AS t2
        FROM logs WHERE dst_ip IS NOT NULL), {_batch('queries', 3)}""",
        f"SELECT query_id, rank, {RECORD} FROM hits",
    ),
    "ingest_search": _logs(
        """SELECT min(message) AS query, cast(0 AS double) AS distance, cast(100 AS bigint) AS similarity,
        (SELECT count(*) FROM logs) AS stored_rows, '2024-02-01T08:00:00' AS uploaded_at
        FROM logs GROUP BY protocol, action"""
    ),
    "dashboard_totals": _with(
        f"{LOGS}, {FILES}",
        """SELECT count(*) AS total_records, (SELECT count(*) FROM inventory) AS total_files,
        (SELECT count(*) FROM inventory WHERE indexed) AS indexed_files, count(*) AS total_queries,
        count(*) FILTER (WHERE action = 'PSH') AS psh_count FROM logs""",
    ),
    "protocol_dist": _dist("protocol"),
    "action_dist": _dist("action"),
    "top_src_ips": _top("src_ip"),
    "top_dst_ports": _top("dst_port", f", {_SERVICE}"),
    "dashboard_cube": _logs(_CUBE),
    "frequent_sources": _logs(
        """SELECT src_ip, count(*) AS count FROM logs WHERE src_ip IS NOT NULL GROUP BY src_ip
        ORDER BY count DESC, src_ip LIMIT 10"""
    ),
    "frequent_contacts": _logs(
        """SELECT concat(src_ip, ' > ', dst_ip, coalesce(concat(' > ', cast(dst_port AS varchar)), '')) AS contact, count(*) AS count
        FROM logs WHERE src_ip IS NOT NULL AND dst_ip IS NOT NULL GROUP BY contact ORDER BY count DESC, contact LIMIT 20"""
    ),
    "dashboard_partials": _with(
        f"""{LOGS.replace("logs AS (", "whole AS (", 1)}, logs AS (
        SELECT * FROM whole WHERE source_file <> 'capture_1.csv' OR action = 'SYN')""",
        _CUBE,
    ),
    "filter_newest": _search("protocol = 'UDP' AND action = 'ACK'", 300),
    "risk_windows": _logs(
        """, slots AS (SELECT *, unnest([0, 1]) AS slot FROM logs WHERE src_ip IS NOT NULL AND event_ts IS NOT NULL),
        placed AS (SELECT *, make_timestamp(cast(floor(epoch(event_ts) / 21600) - slot AS bigint) * 21600000000) AS w FROM slots),
        ports AS (SELECT w, src_ip, dst_port, row_number() OVER
            (PARTITION BY w, src_ip ORDER BY count(*) DESC, dst_port) AS rank
          FROM placed WHERE dst_port IS NOT NULL GROUP BY w, src_ip, dst_port),
        top AS (SELECT w, src_ip, bool_or(dst_port = 22) AS ssh, bool_or(dst_port = 3389) AS rdp, count(*) AS n
          FROM ports WHERE rank <= 10 GROUP BY w, src_ip),
        flags AS (SELECT p.w, p.src_ip AS ip, bool_or(action = 'PSH') AS has_psh, coalesce(bool_or(ssh), false) AS targets_ssh,
          coalesce(bool_or(rdp), false) AS targets_rdp,
          bool_or(action = 'SYN') AND coalesce(max(n), 0) >= 3 AS many_syn_ports
          FROM placed p LEFT JOIN top t ON t.w = p.w AND t.src_ip = p.src_ip GROUP BY p.w, p.src_ip)
        SELECT strftime(w, '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(w + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS "end",
          ip, has_psh, targets_ssh, targets_rdp, many_syn_ports,
          NOT (has_psh OR targets_ssh OR targets_rdp OR many_syn_ports) AS clean FROM flags"""
    ),
    "list_ips": _logs("SELECT src_ip AS ip, count(*) AS count FROM logs WHERE src_ip IS NOT NULL GROUP BY src_ip"),
    "ip_profile": _logs(
        f"""SELECT *, {_BYTES_TEXT} FROM (
        SELECT coalesce(s.ip, d.ip) AS ip, coalesce(as_source, 0) AS as_source,
               coalesce(as_destination, 0) AS as_destination,
               cast(coalesce(sent, 0) AS bigint) AS total_bytes
        FROM (SELECT src_ip AS ip, count(*) AS as_source, sum(bytes) AS sent FROM logs
              WHERE src_ip IS NOT NULL GROUP BY src_ip) s
        FULL JOIN (SELECT dst_ip AS ip, count(*) AS as_destination FROM logs
              WHERE dst_ip IS NOT NULL GROUP BY dst_ip) d ON s.ip = d.ip)"""
    ),
    "ip_actions": _logs(
        """SELECT src_ip AS ip, action, count(*) AS count, cast(floor(count(*) /
        max(count(*)) OVER (PARTITION BY src_ip) * 100 + 0.5) AS bigint) AS pct
        FROM logs WHERE src_ip IS NOT NULL GROUP BY src_ip, action"""
    ),
    "ip_dst_ports": _ip_top("dst_port", f", {_SERVICE}"),
    "ip_src_ports": _ip_top("src_port"),
    "ip_contacts": _ip_top("dst_ip"),
    "ip_risk": _logs(
        """, ports AS (SELECT src_ip AS ip, dst_port, row_number() OVER
            (PARTITION BY src_ip ORDER BY count(*) DESC, dst_port) AS rank
          FROM logs WHERE src_ip IS NOT NULL AND dst_port IS NOT NULL GROUP BY src_ip, dst_port),
        top AS (SELECT * FROM ports WHERE rank <= 10),
        flags AS (SELECT src_ip AS ip, bool_or(action = 'PSH') AS has_psh,
          src_ip IN (SELECT ip FROM top WHERE dst_port = 22) AS targets_ssh,
          src_ip IN (SELECT ip FROM top WHERE dst_port = 3389) AS targets_rdp,
          bool_or(action = 'SYN') AND src_ip IN (SELECT ip FROM top GROUP BY ip HAVING count(*) >= 3)
            AS many_syn_ports
          FROM logs WHERE src_ip IS NOT NULL GROUP BY src_ip)
        SELECT *, NOT (has_psh OR targets_ssh OR targets_rdp OR many_syn_ports) AS clean FROM flags"""
    ),
    "ip_records": _logs(
        f"""SELECT ip, rank, {RECORD} FROM (
        SELECT *, cast(row_number() OVER (PARTITION BY ip ORDER BY event_ts DESC, id DESC) AS int) AS rank
        FROM (SELECT src_ip AS ip, * FROM logs WHERE src_ip IS NOT NULL
              UNION ALL SELECT dst_ip AS ip, * FROM logs
              WHERE dst_ip IS NOT NULL AND dst_ip IS DISTINCT FROM src_ip))
        WHERE rank <= 100"""
    ),
    "row_severity": _logs(
        """SELECT CASE WHEN action = 'PSH' THEN 'warn' WHEN dst_port IN (22, 23) THEN 'danger' ELSE '' END
          AS row_severity,
        CASE action WHEN 'PSH' THEN 'warn' WHEN 'SYN' THEN 'info' WHEN 'ACK' THEN 'ok' ELSE '' END
          AS action_class, count(*) AS count FROM logs GROUP BY ALL"""
    ),
    "compare_search": _with(
        f"{LOGS}, {_VECTORS}, {_PAIRED}, {_batch('paired', 5)}, {_nearest('paired', 5)}",
        """, kw AS (SELECT query_id, count(*) AS n FROM hits GROUP BY query_id),
        sem AS (SELECT query_id, count(*) AS n FROM nearest GROUP BY query_id),
        both_found AS (SELECT h.query_id, count(DISTINCT h.message) AS n FROM hits h
          JOIN nearest n ON n.query_id = h.query_id JOIN vectors v ON v.id = n.id AND v.document = h.message
          GROUP BY h.query_id),
        t AS (SELECT p.query_id, coalesce(kw.n, 0) AS keyword_count, coalesce(sem.n, 0) AS semantic_count,
                coalesce(b.n, 0) AS overlap
          FROM paired p LEFT JOIN kw USING (query_id) LEFT JOIN sem USING (query_id)
          LEFT JOIN both_found b USING (query_id))
        SELECT *, semantic_count - overlap AS extra,
          CASE WHEN overlap = semantic_count AND overlap = keyword_count THEN 'identical'
               WHEN semantic_count > overlap THEN 'semantic_extra'
               WHEN semantic_count < keyword_count THEN 'keyword_more' ELSE 'similar' END AS verdict,
          CASE WHEN semantic_count > keyword_count THEN 'more' WHEN semantic_count < keyword_count
               THEN 'less' ELSE 'same' END AS direction FROM t""",
    ),
    "embed_messages": _logs(
        """SELECT 256 AS size, cast(1.0 AS double) AS norm, cast(1 AS bigint) AS vectors, count(*) AS count
        FROM logs GROUP BY message"""
    ),
    "embed_latent": _logs(
        """SELECT 32 AS size, cast(1.0 AS double) AS norm, cast(1 AS bigint) AS vectors, count(*) AS count
        FROM logs GROUP BY message"""
    ),
    "knn_search": _KNN,
    "knn_search_cells": _KNN,
    "knn_lsh": _logs(
        """SELECT count(*) AS queries, cast(5 * count(*) AS bigint) AS hits, cast(0 AS bigint) AS wrong,
        true AS nine_in_ten FROM embeddings"""
    ),
    "knn_codes": _logs(
        """SELECT count(*) AS queries, cast(5 * count(*) AS bigint) AS hits, cast(0 AS bigint) AS wrong,
        true AS nine_in_ten FROM embeddings"""
    ),
    "evidence_payload": _with(
        f"{LOGS}, {_VECTORS}, {_PAIRED}, {_nearest('paired', 5)}",
        """SELECT query_id, query_id AS query, cast(count(*) AS int) AS evidence_count,
        string_agg(cast(id AS varchar), '|' ORDER BY rank) AS evidence_ids, query_id AS payload_query,
        max(CASE WHEN rank = 1 THEN source_file END) AS first_source
        FROM nearest JOIN vectors USING (id) GROUP BY query_id""",
    ),
    "auto_evidence": _with(
        f"""{LOGS}, {_VECTORS},
        per_file AS (SELECT source_file AS query_id, min_by(v, id) AS q,
          least(10, count(*) FILTER (WHERE action = 'PSH')) AS own_k FROM vectors GROUP BY source_file),
        {_nearest('per_file', 10)}""",
        """SELECT per_file.query_id, concat('Analiziraj sigurnosne prijetnje u fajlu ', per_file.query_id) AS query,
        cast(count(id) AS int) AS evidence_count,
        coalesce(string_agg(cast(id AS varchar), '|' ORDER BY rank), '') AS evidence_ids
        FROM per_file LEFT JOIN nearest n ON n.query_id = per_file.query_id AND n.rank <= own_k
        GROUP BY per_file.query_id""",
    ),
    "parse_reports": _with(
        f"{LOGS}, {RAW_REPORTS}",
        f"""SELECT id, CASE WHEN j IS NULL THEN 'error' WHEN json_type(j, '$.key_indicators') = 'VARCHAR'
          THEN 'partial' ELSE 'ok' END AS status,
        json_extract_string(j, '$.risk_level') AS risk_level, json_extract_string(j, '$.summary') AS summary,
        {_list('$.key_indicators')} AS key_indicators,
        {_list('$.recommended_actions')} AS recommended_actions,
        coalesce(json_extract_string(j, '$.evidence_highlights[0].id'), '') AS highlight_ids,
        coalesce(json_extract_string(j, '$.evidence_highlights[0].reason'), '') AS highlight_reasons,
        CASE WHEN j IS NULL THEN body END AS raw FROM parsed""",
    ),
}
