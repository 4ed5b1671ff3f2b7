"""DuckDB SQL for the query catalogue."""

from __future__ import annotations

_LOG = """log AS (
  SELECT event_id AS seq, 'u' || lpad(CAST(user_id AS VARCHAR), 6, '0') || ':' || CAST(event_id % 7 AS VARCHAR) AS k,
    CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op, CASE WHEN event_type = 'error' THEN '' ELSE props END AS v
  FROM events
)"""
_STATE = _LOG + """, state AS (
  SELECT k, max(seq) AS seq, arg_max({'op': op, 'v': v}, seq).op AS op, arg_max({'op': op, 'v': v}, seq).v AS v FROM log GROUP BY k
)"""
_PROBE = "probe AS (SELECT 'u' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || ':' || CAST(c_custkey % 7 AS VARCHAR) AS k FROM customer)"
_SEG = _LOG + """, bounds AS (SELECT min(seq) AS low, greatest(1, (max(seq) - min(seq) + 1 + 3) // 4) AS each FROM log),
segmented AS (SELECT log.*, CAST((seq - low) // each AS INTEGER) AS seg_id FROM log, bounds),
seg AS (SELECT seg_id, k, arg_max({'op': op, 'v': v}, seq).op AS op, arg_max({'op': op, 'v': v}, seq).v AS v FROM segmented GROUP BY seg_id, k)"""
_NEWEST = """newest AS (
  SELECT k, max(seg_id) AS seg_id, arg_max({'op': op, 'v': v}, seg_id).op AS op, arg_max({'op': op, 'v': v}, seg_id).v AS v FROM seg GROUP BY k
)"""
_STATUS = "CASE WHEN op IS NULL THEN 'ABSENT' WHEN op = 2 THEN 'TOMBSTONE' ELSE 'VALUE' END"
_BYTES = "(strlen(k) + CASE WHEN op = 2 THEN 0 ELSE strlen(v) END)"
_OFF = _SEG + f""", placed AS (
  SELECT *, row_number() OVER w - 1 AS pos,
    16 + coalesce(sum({_BYTES} + 13) OVER (PARTITION BY seg_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM seg WINDOW w AS (PARTITION BY seg_id ORDER BY k)
)"""
_LAYOUT = _OFF + f""", sums AS (
  SELECT seg_id, count(*) AS n, sum({_BYTES} + 13) AS data_size, 8 + sum(CASE WHEN pos % 16 = 0 THEN 12 + strlen(k) ELSE 0 END) AS index_size
  FROM placed GROUP BY seg_id
), layout AS (
  SELECT seg_id, n AS record_count, CAST(16 AS BIGINT) AS data_off, CAST(data_size AS BIGINT) AS data_size, CAST(16 + data_size AS BIGINT) AS index_off,
    CAST(index_size AS BIGINT) AS index_size, CAST(16 + data_size + index_size AS BIGINT) AS bloom_off, CAST(12 + (greatest(n * 10, 64) + 7) // 8 AS BIGINT) AS bloom_size,
    CAST(16 + data_size + index_size + 12 + (greatest(n * 10, 64) + 7) // 8 + 64 AS BIGINT) AS file_size
  FROM sums
)"""
_DOC = "doc AS (SELECT 'doc_' || lpad(CAST(doc_id AS VARCHAR), 6, '0') AS k, doc_id FROM documents)"
_KEY_BYTES = "list_transform(range(1, strlen(k) + 1), lambda i: ('0x' || substr(hex(encode(k)), 2 * i - 1, 2))::BIGINT)"


def _hashed(keys: str, name: str) -> str:
    """CTEs that add h1 and h2 to the keys of a CTE."""
    return f"""{name}_b AS (SELECT k, {_KEY_BYTES} AS b FROM (SELECT DISTINCT k FROM {keys})),
{name}_f AS (
  SELECT k, list_reduce([2166136261::BIGINT] || b, lambda h, x: (xor(h, x) * 16777619) & 4294967295) AS h1,
    list_reduce([0::BIGINT] || b, lambda h, x: xor(((h + x) * 1025) & 4294967295, (((h + x) * 1025) & 4294967295) >> 6)) AS a FROM {name}_b
), {name}_g AS (SELECT k, h1, (a * 9) & 4294967295 AS a FROM {name}_f),
{name}_h AS (SELECT k, h1, (xor(a, a >> 11) * 32769) & 4294967295 AS a FROM {name}_g),
{name} AS (SELECT k, h1, CASE WHEN a = 0 THEN 1 ELSE a END AS h2 FROM {name}_h)"""


def _flushes(threshold: int) -> str:
    return _LOG + f""", sized AS (SELECT seq, k, strlen(k) + CASE WHEN op = 2 THEN 0 ELSE strlen(v) END + 72 AS bytes FROM log),
flush(s0, n) AS (
  SELECT CAST(0 AS BIGINT), 0
  UNION ALL
  SELECT (
    SELECT min(seq) + 1 FROM (
      SELECT seq, sum(change) OVER (ORDER BY seq) AS total FROM (
        SELECT seq, bytes - coalesce(lag(bytes) OVER (PARTITION BY k ORDER BY seq), 0) AS change FROM sized WHERE seq >= flush.s0
      )
    ) WHERE total >= {threshold}
  ), n + 1 FROM flush WHERE s0 IS NOT NULL
), bound AS (SELECT a.n AS seg_id, a.s0 AS first_seq, b.s0 - 1 AS last_seq FROM flush a JOIN flush b ON b.n = a.n + 1 WHERE b.s0 IS NOT NULL)"""


def _sweep(kib: int) -> str:
    return f"""SELECT CAST({kib} AS INTEGER) AS threshold_kib, count(DISTINCT seg_id) AS n_segments, count(DISTINCT CAST(seg_id AS VARCHAR) || '/' || k) AS n_records
FROM (WITH RECURSIVE {_flushes(kib << 10)} SELECT b.seg_id, l.k FROM log l JOIN bound b ON l.seq BETWEEN b.first_seq AND b.last_seq)"""


_LINE = """line AS (
  SELECT event_id AS line_no, trim(CASE event_id % 6 WHEN 0 THEN '  put u' || user_id || '   ' || props || ' ' || chr(9) WHEN 1 THEN 'Get u' || user_id
    WHEN 2 THEN 'DELETE u' || user_id || ' x' WHEN 3 THEN 'put onlykey' WHEN 4 THEN event_type ELSE ' stats ' END, ' ' || chr(9) || chr(13) || chr(10)) AS line
  FROM events
), split AS (
  SELECT line_no, upper(regexp_extract(line, '^([^ \\t\\r\\n]*)', 1)) AS command, trim(regexp_extract(line, '^[^ \\t\\r\\n]*((?s:.*))$', 1), ' ' || chr(9) || chr(13) || chr(10)) AS rest FROM line
), word AS (
  SELECT line_no, command, regexp_extract(rest, '^([^ \\t\\r\\n]*)', 1) AS k, trim(regexp_extract(rest, '^[^ \\t\\r\\n]*((?s:.*))$', 1), ' ' || chr(9) || chr(13) || chr(10)) AS v FROM split
)"""

_CRC = f"""WITH RECURSIVE step AS (
  SELECT n, n AS c, 0 AS i FROM range(256) r(n) UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM step WHERE i < 8
), tab AS (SELECT list(c ORDER BY n) AS tab FROM step WHERE i = 8), {_LOG}, record AS (
  SELECT seq, hex(encode(k)) AS k, CASE WHEN op = 2 THEN '' ELSE hex(encode(v)) END AS v, op FROM log
), bytes AS (
  SELECT seq, [op::BIGINT] || list_transform(range(4), lambda i: (len(k) // 2 >> (8 * i)) & 255) || list_transform(range(4), lambda i: (len(v) // 2 >> (8 * i)) & 255)
    || list_transform(range(1, len(k || v), 2), lambda i: ('0x' || substr(k || v, i, 2))::BIGINT) AS b FROM record
)
SELECT seq, xor(list_reduce([4294967295] || b, lambda c, x: xor(c >> 8, tab[xor(c & 255, x) + 1])), 4294967295) AS crc FROM bytes, tab"""

ORACLES = {
    "wal_crc": _CRC,
    "snapshot": f"WITH {_STATE} SELECT k, v FROM state WHERE op = 1",
    "snapshot_window": f"WITH {_LOG} SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r FROM log) WHERE r = 1 AND op = 1",
    "snapshot_as_of": f"""WITH {_LOG}, cut AS (SELECT * FROM log WHERE seq <= (SELECT max(seq) // 2 FROM log)),
        newest AS (SELECT k, max(seq) AS seq, arg_max({{'op': op, 'v': v}}, seq) AS n FROM cut GROUP BY k) SELECT k, n.v AS v, seq FROM newest WHERE n.op = 1""",
    "multi_get": f"WITH {_STATE}, {_PROBE} SELECT probe.k, {_STATUS} AS status, CASE WHEN op = 1 THEN v END AS v FROM probe LEFT JOIN state ON probe.k = state.k",
    "get_point": f"WITH {_STATE} SELECT k, {_STATUS} AS status, v FROM state WHERE k = 'u000012:3'",
    "contains_keys": f"WITH {_LOG}, {_PROBE} SELECT k FROM probe WHERE k IN (SELECT k FROM log)",
    "missing_keys": f"WITH {_LOG}, {_PROBE} SELECT k FROM probe WHERE k NOT IN (SELECT k FROM log)",
    "tombstones": f"WITH {_STATE} SELECT k, seq FROM state WHERE op = 2",
    "resurrected_keys": f"WITH {_LOG} SELECT k, seq, v FROM (SELECT *, lag(op) OVER (PARTITION BY k ORDER BY seq) AS b FROM log) WHERE op = 1 AND b = 2",
    "version_history": f"""WITH {_LOG} SELECT k, seq, op, v, row_number() OVER (PARTITION BY k ORDER BY seq) AS version,
        lead(seq) OVER (PARTITION BY k ORDER BY seq) AS superseded_by FROM log""",
    "range_scan": f"WITH {_STATE} SELECT k, v FROM state WHERE op = 1 AND k >= 'u000010' AND k < 'u000020'",
    "sorted_scan": f"WITH {_OFF} SELECT seg_id, pos, k, {_STATUS} AS status FROM placed",
    "segment_contents": f"WITH {_SEG} SELECT seg_id, k, op, v FROM seg",
    "compact_all": f"WITH {_SEG}, {_NEWEST} SELECT k, v FROM newest WHERE op = 1",
    "compaction_stats": f"""WITH {_STATE} SELECT (SELECT count(*) FROM log) AS records_in, (SELECT count(*) FROM log) - count(*) AS superseded,
        count(*) FILTER (op = 2) AS tombstones_purged, count(*) FILTER (op = 1) AS records_out FROM state""",
    "read_trace": f"""WITH {_SEG}, {_NEWEST}, {_PROBE}, n AS (SELECT max(seg_id) + 1 AS n FROM seg)
        SELECT probe.k, seg_id AS found_in, {_STATUS} AS status, CAST(coalesce(n - seg_id, n) AS INTEGER) AS segments_probed FROM probe LEFT JOIN newest ON probe.k = newest.k, n""",
    "memtable_tail": f"""WITH {_LOG}, tail AS (SELECT k, arg_max({{'op': op, 'v': v}}, seq).op AS op, arg_max({{'op': op, 'v': v}}, seq).v AS v
        FROM log WHERE seq >= (SELECT max(seq) // 2 + 1 FROM log) GROUP BY k) SELECT k, op, CAST({_BYTES} + 72 AS BIGINT) AS bytes FROM tail""",
    "memtable_stats": f"""WITH {_LOG}, tail AS (SELECT k, arg_max({{'op': op, 'v': v}}, seq).op AS op, arg_max({{'op': op, 'v': v}}, seq).v AS v
        FROM log WHERE seq >= (SELECT max(seq) // 2 + 1 FROM log) GROUP BY k)
        SELECT count(*) AS entries, CAST(sum({_BYTES} + 72) AS BIGINT) AS bytes, count(*) = 0 AS is_empty, sum({_BYTES} + 72) >= 65536 AS is_full FROM tail""",
    "running_size": f"""WITH {_LOG}, sized AS (SELECT *, {_BYTES} + 72 AS bytes FROM log), moved AS (
        SELECT seq, k, bytes - coalesce(lag(bytes) OVER (PARTITION BY k ORDER BY seq), 0) AS change FROM sized)
        SELECT seq, k, CAST(change AS BIGINT) AS change, CAST(sum(change) OVER (ORDER BY seq) AS BIGINT) AS total FROM moved""",
    "flush_segments": f"""WITH RECURSIVE {_flushes(65536)} SELECT b.seg_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS mutations, count(DISTINCT k) AS records
        FROM log l JOIN bound b ON l.seq BETWEEN b.first_seq AND b.last_seq GROUP BY b.seg_id""",
    "flush_sweep": " UNION ALL ".join(_sweep(kib) for kib in (64, 128, 256)),
    "wal_encode_size": f"""WITH {_LOG} SELECT seq, CAST({_BYTES} + 13 AS BIGINT) AS bytes, CAST(sum({_BYTES} + 13) OVER (ORDER BY seq) AS BIGINT) AS end_off FROM log""",
    "wal_valid_prefix": f"""WITH {_LOG}, marked AS (SELECT *, CASE WHEN seq >= (SELECT max(seq) FROM log) * 9 // 10 AND seq % 97 = 0 THEN 1 ELSE 0 END AS bad FROM log)
        SELECT seq, k, op FROM (SELECT *, sum(bad) OVER (ORDER BY seq) AS n_bad FROM marked) WHERE n_bad = 0""",
    "sparse_index": f"WITH {_OFF} SELECT seg_id, k, CAST(off AS BIGINT) AS off FROM placed WHERE pos % 16 = 0",
    "index_seek": f"""WITH {_OFF}, {_PROBE}, ends AS (SELECT seg_id, 16 + sum({_BYTES} + 13) AS data_end FROM seg GROUP BY seg_id),
        idx AS (SELECT p.seg_id, k, off, coalesce(lead(off) OVER (PARTITION BY p.seg_id ORDER BY k), data_end) AS end_off FROM placed p JOIN ends USING (seg_id) WHERE pos % 16 = 0),
        ask AS (SELECT DISTINCT probe.k, seg_id FROM probe, ends)
        SELECT ask.k, ask.seg_id, CAST(coalesce(idx.off, 16) AS BIGINT) AS start_off, CAST(coalesce(idx.end_off, 16) AS BIGINT) AS end_off
        FROM ask ASOF LEFT JOIN idx ON ask.seg_id = idx.seg_id AND ask.k >= idx.k""",
    "segment_layout": f"WITH {_LAYOUT} SELECT * FROM layout",
    "storage_overhead": f"""WITH {_LAYOUT}, l AS (SELECT CAST(sum(strlen(k) + strlen(v)) AS BIGINT) AS logical_bytes FROM seg), p AS (SELECT CAST(sum(file_size) AS BIGINT) AS physical_bytes FROM layout)
        SELECT logical_bytes, physical_bytes, round(physical_bytes / logical_bytes, 6) AS overhead FROM l, p""",
    "bloom_hashes": f"WITH {_DOC}, {_hashed('doc', 'hashed')} SELECT doc.k, h1, h2 FROM doc JOIN hashed ON doc.k = hashed.k",
    "bloom_bits": f"""WITH {_DOC}, {_hashed('doc', 'hashed')}, size AS (SELECT (greatest(64, count(*) * 10) + 7) // 8 * 8 AS m FROM doc)
        SELECT DISTINCT (h1 + i * h2) % m AS bit FROM hashed, size, range(7) r(i)""",
    "bloom_probe": f"""WITH {_DOC}, even AS (SELECT k FROM doc WHERE doc_id % 2 = 0), {_hashed('doc', 'hashed')}, size AS (SELECT (greatest(64, count(*) * 10) + 7) // 8 * 8 AS m FROM even),
        bits AS (SELECT DISTINCT (h1 + i * h2) % m AS bit FROM hashed SEMI JOIN even USING (k), size, range(7) r(i)),
        ask AS (SELECT DISTINCT k, (h1 + i * h2) % m AS bit FROM hashed, size, range(7) r(i))
        SELECT ask.k, count(*) = count(bits.bit) AS maybe FROM ask LEFT JOIN bits ON ask.bit = bits.bit GROUP BY ask.k""",
    "bloom_segment_fill": f"""WITH {_SEG}, {_hashed('seg', 'hashed')}, size AS (SELECT seg_id, CAST((greatest(count(*) * 10, 64) + 7) // 8 * 8 AS BIGINT) AS n_bits FROM seg GROUP BY seg_id)
        SELECT seg_id, n_bits, count(DISTINCT (h1 + i * h2) % n_bits) AS n_set FROM seg JOIN hashed USING (k) JOIN size USING (seg_id), range(7) r(i) GROUP BY seg_id, n_bits""",
    "latency_percentiles": """WITH ranked AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
        SELECT event_type, n, round(avg(value), 6) AS mean, min(value) FILTER (r = least(floor(n * 0.5::DOUBLE), n - 1)) AS p50,
          min(value) FILTER (r = least(floor(n * 0.95::DOUBLE), n - 1)) AS p95, min(value) FILTER (r = least(floor(n * 0.99::DOUBLE), n - 1)) AS p99 FROM ranked GROUP BY event_type, n""",
    "cli_script": f"""WITH {_LINE} SELECT line_no, command, CASE WHEN command IN ('PUT', 'GET', 'DELETE') THEN k ELSE '' END AS k, CASE WHEN command = 'PUT' THEN v ELSE '' END AS v,
        CASE WHEN command = '' THEN 'EMPTY' WHEN command NOT IN ('PUT', 'GET', 'DELETE', 'FLUSH', 'COMPACT', 'STATS', 'HELP', 'EXIT', 'QUIT') THEN 'UNKNOWN'
          WHEN (command IN ('PUT', 'GET', 'DELETE') AND k = '') OR (command = 'PUT' AND v = '') THEN 'USAGE' ELSE 'OK' END AS status FROM word""",
}
