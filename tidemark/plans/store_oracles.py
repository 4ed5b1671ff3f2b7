"""DuckDB SQL for the queries that work through a store or the byte formats."""

from __future__ import annotations

from tidemark.plans.oracles import _BYTES, _LOG, _PROBE, _SEG, ORACLES

_CHUNKS = _LOG + f", sized AS (SELECT *, seq // 1000 AS chunk, {_BYTES} AS kv FROM log)"

STORE_ORACLES = {
    "store_reopened": ORACLES["snapshot"],
    "store_scan": ORACLES["range_scan"],
    "store_multi_get": f"""WITH {_SEG}, {_PROBE}, state AS (SELECT k, max(seq) AS seq, max(seg_id) AS seg_id, arg_max({{'op': op, 'v': v}}, seq) AS n FROM segmented GROUP BY k)
        SELECT probe.k, CASE WHEN n IS NULL OR (n.op = 2 AND seg_id < 2) THEN 'ABSENT' WHEN n.op = 2 THEN 'TOMBSTONE' ELSE 'VALUE' END AS status, CASE WHEN n.op = 1 THEN n.v END AS v
        FROM probe LEFT JOIN state ON probe.k = state.k""",
    "store_removed": f"""WITH {_LOG}, {_PROBE}, put AS (SELECT k, arg_max(v, seq) AS v FROM log WHERE op = 1 GROUP BY k) SELECT k, v FROM put WHERE k NOT IN (SELECT k FROM probe)""",
    "store_lifecycle": f"""WITH {_SEG}, live AS (SELECT count(*) AS n FROM (SELECT k, arg_max(op, seq) AS op FROM log GROUP BY k) WHERE op = 1),
        part AS (SELECT seg_id AS i, count(*) AS records, sum({_BYTES} + 72) AS bytes FROM seg GROUP BY seg_id),
        whole AS (SELECT part.*, n AS mutations FROM part JOIN (SELECT seg_id AS i, count(*) AS n FROM segmented GROUP BY seg_id) USING (i)),
        before AS (SELECT *, coalesce(sum(records) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS older FROM whole)
        SELECT 0 AS step, 0 AS n_segments, 0::BIGINT AS records, 0::BIGINT AS mutations, 0::BIGINT AS bytes
        UNION ALL SELECT 2 * i + 1, i, older::BIGINT, mutations, bytes::BIGINT FROM before
        UNION ALL SELECT 2 * i + 2, CASE WHEN i = 3 THEN 1 ELSE i + 1 END, CASE WHEN i = 3 THEN live.n ELSE older + before.records END::BIGINT, 0, 0 FROM before, live""",
    "store_statuses": """SELECT * FROM (VALUES ('put', 'OK'), ('get', 'OK'), ('get absent', 'NotFound'), ('remove absent', 'OK'), ('get empty key', 'InvalidArgument'), ('put empty key', 'InvalidArgument'),
        ('put after another writer', 'IOError'), ('get of the winner', 'OK'), ('get when closed', 'IOError'), ('flush when closed', 'IOError'), ('open with missing data', 'Corruption'),
        ('open without a path', 'InvalidArgument'), ('no index interval', 'InvalidArgument')) t("case", status)""",
    "cli_session": """SELECT (row_number() OVER () - 1)::INTEGER AS answer_no, answer FROM (SELECT unnest(['OK', '1', 'OK', 'OK', 'NOT_FOUND', 'OK', 'nothing to flush', 'OK', 'OK', 'OK',
        'fewer than two segments', 'two  words', '3', usage, usage, 'unknown command NONSENSE; try HELP', 'OK', 'path PATH, segments 1, memtable 74 bytes']) AS answer
        FROM (SELECT 'usage: PUT key value | GET key | DELETE key | FLUSH | COMPACT | STATS | HELP | EXIT' AS usage))""",
    "wal_torn_tail": f"""WITH {_CHUNKS} SELECT chunk, count(*) - 1 AS records, (sum(kv) - arg_max(kv, seq))::BIGINT AS kv_bytes, (sum(kv + 13) - arg_max(kv + 13, seq))::BIGINT AS valid_bytes,
        (arg_max(kv, seq) + 12)::BIGINT AS dropped_bytes, true AS truncated, false AS corrupt FROM sized GROUP BY chunk""",
    "segment_files": f"""WITH {_CHUNKS}, newest AS (SELECT chunk, k, arg_max(kv, seq) AS kv FROM sized GROUP BY chunk, k),
        placed AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY k) - 1 AS pos FROM newest),
        sums AS (SELECT chunk, count(*) AS n, sum(kv + 13) AS data_size, count(*) FILTER (pos % 16 = 0) AS entries, coalesce(sum(12 + strlen(k)) FILTER (pos % 16 = 0), 0) AS index_size, (greatest(64, count(*) * 10) + 7) // 8 AS filter FROM placed GROUP BY chunk)
        SELECT chunk, n AS records, data_size::BIGINT AS data_size, entries AS index_entries, filter * 8 AS n_bits, (16 + data_size + 8 + index_size + 12 + filter + 64)::BIGINT AS file_size,
          true AS read_back, n AS found, n AS absent FROM sums""",
}
