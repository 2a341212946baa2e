"""The queries of ``queries.py`` once more, written directly in DuckDB SQL.

The SQL takes the plain way (no panes, buckets, blocks or slices), so that it
checks the operators rather than repeats them.
"""

from __future__ import annotations

HOUR = 3_600_000
DAY = 24 * HOUR
WEEK = 7 * DAY

PACKETS = """
WITH e AS (
  SELECT *, epoch_us(ts) // 1000 AS ts_ms, event_id % 97 = 0 AS arp, event_type = 'signup' AS v6,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    CASE event_type WHEN 'click' THEN 6 WHEN 'view' THEN 17 WHEN 'purchase' THEN 6
      WHEN 'error' THEN 1 ELSE 6 END AS num,
    CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 END AS target
  FROM events),
p AS (
  SELECT event_id, event_id AS seq, ts_ms, user_id, event_type, arp, v6, num, target, k,
    CAST(user_id % 4 AS INTEGER) AS part,
    CASE WHEN arp THEN NULL WHEN v6 THEN 6 ELSE 4 END AS ip_version,
    CASE WHEN arp THEN NULL
      WHEN v6 THEN 'fd00:0:0:0:0:0:' || printf('%x', (user_id // 65536) % 65536) || ':' || printf('%x', user_id % 65536)
      ELSE '10.' || (user_id // 65536) % 256 || '.' || (user_id // 256) % 256 || '.' || user_id % 256 END AS src_ip,
    CASE WHEN arp THEN NULL WHEN v6 THEN 'fd00:0:0:0:0:0:0:5' ELSE '10.1.0.' || target END AS dst_ip,
    CASE WHEN arp THEN NULL WHEN num = 6 THEN 'TCP' WHEN num = 17 THEN 'UDP' ELSE 'ICMPv4' END AS proto,
    CASE WHEN NOT arp AND num <> 1 THEN CAST(1024 + event_id % 50000 AS INTEGER) END AS src_port,
    CASE WHEN NOT arp AND num <> 1 THEN k END AS dst_port,
    CASE WHEN NOT arp THEN CAST(32 + event_id % 32 AS INTEGER) END AS ttl,
    CASE WHEN arp THEN NULL WHEN v6 THEN 60 WHEN num = 6 THEN 40 ELSE 28 END AS total_len
  FROM e),
h AS (SELECT COALESCE(src_ip, 'none') AS flow_key, ts_ms, seq, COALESCE(dst_port, -1) AS dest_port FROM p)
"""

FRAMES = (
    PACKETS
    + """,
f AS (
  SELECT *, 'AABBCCDDEEFF112233445566' ||
    CASE WHEN arp THEN '0806' || '0001080006040001' || repeat('00', 20)
      WHEN v6 THEN '86DD' || '60000000' || '0014' || '06' || printf('%02X', ttl) || 'FD00' || repeat('00', 10)
        || printf('%08X', user_id % 4294967296) || 'FD00' || repeat('00', 13) || '05' || transport
      ELSE '0800' || '4500' || printf('%04X', total_len) || '00010000' || printf('%02X', ttl) || printf('%02X', num)
        || '0000' || '0A' || printf('%06X', user_id % 16777216) || '0A0100' || printf('%02X', target) || transport
    END AS raw_hex
  FROM (SELECT *, CASE num WHEN 6 THEN printf('%04X%04X', src_port, dst_port) || '00000000000000005002000000000000'
      WHEN 17 THEN printf('%04X%04X', src_port, dst_port) || '00080000' ELSE '0800000000000000' END AS transport
    FROM p))
"""
)

DECODABLE = "event_id % 101 <> 0"
ORACLES: dict[str, str] = {}


def _add(name: str, body: str, base: str = PACKETS) -> None:
    ORACLES[name] = base + body


# ------------------------------------------------------------------ bytes

_add(
    "decode_wire",
    f"""SELECT event_id AS "offset", CAST(1 AS INTEGER) AS dlt, ts_ms, raw_hex,
      CAST(length(raw_hex) // 2 AS INTEGER) AS raw_len FROM f WHERE {DECODABLE}""",
    FRAMES,
)
_add(
    "encode_wire",
    """SELECT event_id, src_ip AS key, '00000001' || printf('%016X', ts_ms) || raw_hex AS value_hex FROM f""",
    FRAMES,
)
_add(
    "parse_headers",
    f"""SELECT event_id AS "offset", ts_ms, ip_version, src_ip, dst_ip, proto, src_port, dst_port, ttl, total_len
      FROM p WHERE {DECODABLE}""",
)
_add(
    "key_default",
    f"""SELECT event_id AS "offset", COALESCE(src_ip || '->' || dst_ip, 'Unknown') AS flow_key FROM p WHERE {DECODABLE}""",
)
_add(
    "key_five_tuple",
    f"""SELECT event_id AS "offset", CASE WHEN arp THEN 'unknown' ELSE src_ip || ':' || COALESCE(src_port, 0) || '->'
      || dst_ip || ':' || COALESCE(dst_port, 0) || '|' || proto END AS flow_key FROM p WHERE {DECODABLE}""",
)
_add(
    "key_guide",
    f"""SELECT event_id AS "offset", CASE WHEN arp OR v6 THEN 'unknown'
      WHEN src_port IS NULL THEN src_ip || '-' || dst_ip || '-' || proto
      ELSE src_ip || ':' || src_port || '-' || dst_ip || ':' || dst_port || '-' || proto END AS flow_key
      FROM p WHERE {DECODABLE}""",
)
_add(
    "key_legacy",
    """SELECT event_id, COALESCE(src_ip, 'null') || ':' || COALESCE(src_port, 0) || '->' || COALESCE(dst_ip, 'null') || ':'
      || COALESCE(dst_port, 0) || '(' || COALESCE(proto, 'null') || ')' AS flow_key FROM p""",
)
_add(
    "key_custom",
    f"""SELECT COALESCE(src_ip, 'none') AS flow_key, count(*) AS packets FROM p WHERE {DECODABLE} GROUP BY 1""",
)
_add("feat_dest_port", f"""SELECT event_id AS "offset", COALESCE(dst_port, -1) AS dest_port FROM p WHERE {DECODABLE}""")
_add("feat_ttl_len", f"""SELECT event_id AS "offset", ttl, total_len FROM p WHERE {DECODABLE}""")
_add(
    "feat_timestamp_only",
    """SELECT CASE WHEN arp THEN 'unknown' ELSE src_ip || ':' || COALESCE(src_port, 0) || '->' || dst_ip || ':'
      || COALESCE(dst_port, 0) || '|' || proto END AS flow_key, ts_ms, seq FROM p""",
)
_add(
    "feat_typed_default",
    """SELECT event_id, k AS as_int, 'none' AS as_string, 0.5::DOUBLE AS missing_double FROM p""",
)

# ---------------------------------------------------------------- windows

SUMMARY = "count(*) AS n, min(ts_ms) AS first_ts, max(ts_ms) AS last_ts"


def tumbling(size: int) -> str:
    """``w``: packets with the bounds of their window."""
    return f"""w AS (SELECT *, ts_ms - ts_ms % {size} AS window_start, ts_ms - ts_ms % {size} + {size} AS window_end FROM h)"""


def sliding(size: int, slide: int) -> str:
    return f"""w AS (SELECT h.*, ts_ms - ts_ms % {slide} - o.i * {slide} AS window_start,
      ts_ms - ts_ms % {slide} - o.i * {slide} + {size} AS window_end
      FROM h, (SELECT unnest(range(0, {-(-size // slide)})) AS i) o
      WHERE ts_ms < ts_ms - ts_ms % {slide} - o.i * {slide} + {size})"""


def session(gap: int) -> str:
    return f"""s1 AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY flow_key ORDER BY ts_ms, seq) <= {gap}
        THEN 0 ELSE 1 END AS opens FROM h),
      s2 AS (SELECT *, sum(opens) OVER (PARTITION BY flow_key ORDER BY ts_ms, seq) AS no FROM s1),
      w AS (SELECT flow_key, ts_ms, seq, dest_port, min(ts_ms) OVER (PARTITION BY flow_key, no) AS window_start,
        max(ts_ms) OVER (PARTITION BY flow_key, no) + {gap} AS window_end FROM s2)"""


def counted(size: int, step: int, flush: bool = False) -> str:
    keep = "TRUE" if flush else f"f.i * {step} <= total"
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY flow_key ORDER BY ts_ms, seq) AS rn,
        count(*) OVER (PARTITION BY flow_key) AS total FROM h),
      w AS (SELECT r.*, CAST(f.i AS BIGINT) AS window_no FROM r, LATERAL (
        SELECT unnest(range((rn + {step} - 1) // {step}, (rn + {size} - 1) // {step} + 1)) AS i) f WHERE {keep})"""


TIME = "flow_key, window_start, window_end"
COUNT = "flow_key, window_no"
WINDOWS = {
    "tumbling": (tumbling(WEEK), TIME),
    "sliding": (sliding(3 * DAY, DAY), TIME),
    "sliding_gapped": (sliding(6 * HOUR, DAY), TIME),
    "session": (session(12 * HOUR), TIME),
    "tumbling_count": (counted(20, 20), COUNT),
    "sliding_count": (counted(10, 4), COUNT),
    "partial_flush": (counted(20, 20, flush=True), COUNT),
    "partial_flush_sliding": (counted(10, 10, flush=True), COUNT),
}

for _name, (_with, _group) in WINDOWS.items():
    _add(f"win_{_name}", f""", {_with} SELECT {_group}, {SUMMARY} FROM w GROUP BY {_group}""")
WINDOWS["sliding_blocks"] = (counted(40, 20), COUNT)

_add(
    "win_none_running",
    """, r AS (SELECT flow_key, ts_ms, seq, row_number() OVER (PARTITION BY flow_key ORDER BY ts_ms, seq) AS rn FROM h)
    SELECT flow_key, ts_ms, seq, rn AS "packetCount", rn > 5 AS anomaly FROM r""",
)
_add(
    "win_metadata",
    """, r AS (SELECT COALESCE(src_ip || '->' || dst_ip, 'Unknown') AS flow_id FROM p),
    c AS (SELECT flow_id, count(*) // 20 AS windows FROM r GROUP BY 1)
    SELECT flow_id, 'count_based' AS window_type, 'buffered' AS aggregation_mode, '20' AS packets_in_window
    FROM c, LATERAL (SELECT unnest(range(0, windows)) AS i) x""",
)
_add(
    "accumulate_windows",
    f""", {tumbling(WEEK)}, c AS (SELECT {TIME}, count(*) AS n FROM w GROUP BY {TIME})
    SELECT *, CAST(sum(n) OVER (PARTITION BY flow_key ORDER BY window_start) AS BIGINT) AS n_so_far FROM c""",
)

# -------------------------------------------------------- inter-arrival times


def gaps(with_windows: str, group: str, order: str = "ts_ms, seq") -> str:
    return f"""{with_windows}, g AS (SELECT *,
      ts_ms - lag(ts_ms) OVER (PARTITION BY {group} ORDER BY {order}) AS delta FROM w)"""


def code(delta: str, precision: int) -> str:
    x, scale = f"({delta} / 1000::DOUBLE)", 10**precision
    zeros = f"CASE WHEN {x} >= 0.1::DOUBLE THEN 0 WHEN {x} * 10::DOUBLE >= 0.1::DOUBLE THEN 1 ELSE 2 END"
    scaled = f"""CASE {zeros} WHEN 0 THEN {x} WHEN 1 THEN {x} * 10::DOUBLE ELSE {x} * 10::DOUBLE * 10::DOUBLE END"""
    digits = f"CAST(floor({scaled} * {scale}::DOUBLE + 0.5::DOUBLE) AS BIGINT)"
    left = f"({zeros} - CASE WHEN {digits} >= {scale} THEN 1 ELSE 0 END)"
    return f"""CASE {left} WHEN 2 THEN 'A' WHEN 1 THEN 'X' ELSE '' END
      || CASE WHEN {digits} >= {scale} THEN {digits} // 10 ELSE {digits} END"""


VALID = f"delta > 0 AND delta <= {DAY}"
GAPS = gaps(tumbling(WEEK), TIME)

_add(
    "iat_sorted",
    f""", {GAPS} SELECT {TIME}, seq, delta / 1000::DOUBLE AS iat FROM g WHERE delta IS NOT NULL""",
)
_late = tumbling(WEEK).replace("FROM h)", "FROM late)")
_add(
    "iat_arrival",
    f""", late AS (SELECT flow_key, ts_ms - CASE WHEN seq % 7 = 0 THEN {HOUR} ELSE 0 END AS ts_ms, seq FROM h),
    {gaps(_late, TIME, 'seq')} SELECT {TIME}, seq, delta AS delta_ms FROM g WHERE delta IS NOT NULL""",
)
_add(
    "iat_filter",
    f""", {GAPS} SELECT {TIME}, count(*) AS valid, max(delta) AS longest_ms FROM g WHERE {VALID} GROUP BY {TIME}""",
)
_add(
    "iat_code",
    f"""SELECT event_id, {code('(event_id + 1)', 1)} AS p1, {code('(event_id + 1)', 2)} AS p2,
    {code('(event_id + 1)', 3)} AS p3 FROM e""",
)


def texts(with_windows: str, group: str) -> str:
    return f"""{gaps(with_windows, group)}, c AS (
      SELECT *, CASE WHEN {VALID} THEN {code('delta', 2)} END AS code FROM g),
    t AS (SELECT {group}, count(*) AS packets, count(code) AS codes,
      COALESCE(string_agg(code, '' ORDER BY ts_ms, seq), '') AS text FROM c GROUP BY {group})"""


for _query, _window in (
    ("iat_concat", "tumbling"), ("iat_concat_session", "session"), ("iat_concat_sliding_count", "sliding_count"),
):
    _with, _group = WINDOWS[_window]
    _add(_query, f""", {texts(_with, _group)} SELECT *, CAST(length(text) AS INTEGER) AS text_len FROM t""")

_add(
    "flow_changes",
    f""", x AS (SELECT COALESCE(src_ip, 'none') AS flow_key, ts_ms - ts_ms % {WEEK} AS window_start, ts_ms, seq,
      CASE WHEN arp THEN 'unknown' ELSE src_ip || ':' || COALESCE(src_port, 0) || '->' || dst_ip || ':'
      || COALESCE(dst_port, 0) || '|' || proto END AS five FROM p),
    y AS (SELECT *, first_value(five) OVER (PARTITION BY flow_key, window_start ORDER BY ts_ms, seq) AS first FROM x)
    SELECT flow_key, window_start, count(*) FILTER (WHERE five <> first) AS flow_changes FROM y GROUP BY 1, 2""",
)

# --------------------------------------------------------------- detectors


def compress(window: str, buffered: bool) -> str:
    with_windows, group = WINDOWS[window]
    counts = "packets AS iat_count, packets AS packet_count" if buffered else "codes AS iat_count, 0::BIGINT AS packet_count"
    return f""", {texts(with_windows, group)} SELECT {group}, packets AS packets_in_window,
      CAST(0 AS INTEGER) AS "flowIdChanges", '' AS "executionMode", '' AS "windowType", {counts},
      CAST(2 AS INTEGER) AS precision, {DAY}::DOUBLE AS iat_threshold_ms, 'unknown' AS testlauf,
      md5(text) AS text_md5, true AS score_is_right
      FROM t WHERE codes >= 5"""


_with, _group = WINDOWS["tumbling"]
_add(
    "gzip_score",
    f""", {texts(_with, _group)} SELECT {_group}, codes, CAST(length(text) AS INTEGER) AS text_len, md5(text) AS text_md5,
      true AS score_is_right FROM t WHERE codes >= 5""",
)
_add("det_compress_buffered", compress("sliding_count", True))
_add("det_compress_feature", compress("sliding", False))
_add("det_compress_sliding", compress("sliding", True))
_add("det_compress_blocks", compress("sliding_blocks", True))
for _name in ("det_compress_running", "stream_compress_running"):
    _add(
        _name,
        f""", g AS (SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY flow_key ORDER BY ts_ms, seq) AS delta FROM h),
        c AS (SELECT *, CASE WHEN {VALID} THEN {code('delta', 2)} END AS code FROM g),
        r AS (SELECT flow_key, ts_ms, seq, row_number() OVER o AS iat_count, count(code) OVER o AS codes,
          md5(COALESCE(string_agg(code, '') OVER o, '')) AS md5 FROM c WINDOW o AS (PARTITION BY flow_key ORDER BY ts_ms, seq))
        SELECT flow_key, ts_ms, seq, iat_count, CASE WHEN iat_count & (iat_count - 1) = 0 THEN md5 END AS text_md5,
          CASE WHEN iat_count & (iat_count - 1) = 0 THEN true END AS score_is_right FROM r WHERE codes >= 5""",
    )
_add(
    "port_histogram",
    f"""SELECT COALESCE(src_ip || '->' || dst_ip, 'Unknown') AS flow_key, ts_ms - ts_ms % {WEEK} AS window_start,
    ts_ms - ts_ms % {WEEK} + {WEEK} AS window_end, COALESCE(dst_port, -1) AS dest_port, count(*) AS n
    FROM p GROUP BY ALL""",
)


def port_statistics(group: str) -> str:
    """``d``: packet and port counts of each window and the entropy ``h`` of its ports."""
    return f"""b AS (SELECT {group}, dest_port, count(*) AS n FROM w GROUP BY ALL),
    b2 AS (SELECT *, sum(CASE WHEN dest_port >= 0 THEN n END) OVER (PARTITION BY {group}) AS ports FROM b),
    d AS (SELECT {group}, CAST(sum(n) AS BIGINT) AS packet_count,
      CAST(COALESCE(sum(n) FILTER (WHERE dest_port < 0), 0) AS BIGINT) AS skipped_count,
      count(*) FILTER (WHERE dest_port >= 0) AS unique_ports,
      -sum(CASE WHEN dest_port >= 0 THEN n::DOUBLE / ports::DOUBLE * log2(n::DOUBLE / ports::DOUBLE) END) AS h
      FROM b2 GROUP BY {group})"""


for _query, _window in (("ports_sketched", "sliding"), ("ports_sketched_count", "sliding_count")):
    _with, _group = WINDOWS[_window]
    _add(_query, f""", {_with}, {port_statistics(_group)} SELECT {_group}, packet_count, skipped_count, unique_ports FROM d""")

PORT_COLUMNS = "packet_count, skipped_count, unique_ports, round(h, 6) + 0.0::DOUBLE AS entropy_score"


def entropy(group: str, minimum: int, threshold: float) -> str:
    return f"""{port_statistics(group)}
    SELECT {group}, {PORT_COLUMNS},
      CASE WHEN round(h, 12) >= {threshold}::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_anomaly
    FROM d WHERE packet_count >= {minimum} AND unique_ports > 0"""


for _query, _window, _minimum in (
    ("det_port_entropy", "tumbling", 10), ("det_port_entropy_sliding", "sliding", 5),
    ("det_port_entropy_session", "session", 3), ("det_port_entropy_count", "sliding_count", 4),
):
    _with, _group = WINDOWS[_window]
    _add(_query, f""", {_with}, {entropy(_group, _minimum, 3.0)}""")

_add(
    "det_port_entropy_wire",
    f""", w AS (SELECT COALESCE(src_ip || '->' || dst_ip, 'Unknown') AS flow_key, COALESCE(dst_port, -1) AS dest_port,
      ts_ms - ts_ms % {WEEK} AS window_start, ts_ms - ts_ms % {WEEK} + {WEEK} AS window_end FROM p WHERE {DECODABLE}),
    {entropy(TIME, 3, 1.5)}""",
)


def variation(window: str, minimum: int) -> str:
    with_windows, group = WINDOWS[window]
    return f""", {gaps(with_windows, group)}, d AS (SELECT {group},
      CASE WHEN avg(delta) IS NULL OR avg(delta) = 0 THEN 0.0::DOUBLE ELSE stddev_pop(delta) / avg(delta) END AS cv,
      count(*) AS n FROM g GROUP BY {group})
    SELECT {group}, round(cv, 6) AS cv, n AS "packetCount", cv > 0.9::DOUBLE AS detected FROM d WHERE n >= {minimum}"""


for _query, _window, _minimum in (
    ("det_iat_cv", "tumbling", 10), ("det_iat_cv_sliding", "sliding", 4), ("det_iat_cv_session", "session", 3),
):
    _add(_query, variation(_window, _minimum))

_add(
    "det_iat_cv_running",
    """, g AS (SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY flow_key ORDER BY ts_ms, seq) AS delta FROM h),
    r AS (SELECT flow_key, ts_ms, seq, row_number() OVER o AS n, stddev_pop(delta) OVER o / avg(delta) OVER o AS cv
      FROM g WINDOW o AS (PARTITION BY flow_key ORDER BY ts_ms, seq))
    SELECT flow_key, ts_ms, seq, round(cv, 6) AS cv, n AS "packetCount", cv > 0.9::DOUBLE AS detected
    FROM r WHERE n >= 10""",
)
_add(
    "det_packet_count",
    f""", {sliding(3 * DAY, DAY)} SELECT {TIME}, count(*) AS "packetCount", count(*) > 10 AS anomaly
    FROM w GROUP BY {TIME}""",
)

# ------------------------------------------------------- ingest and results

_add(
    "limit_packets_first",
    """SELECT part AS partition, seq, ts_ms FROM p ORDER BY part, seq LIMIT 500""",
)
_add(
    "limit_packets_many",
    """SELECT part AS partition, seq, ts_ms FROM p ORDER BY part, seq LIMIT 4000""",
)
_add(
    "bad_packet_runs",
    """, o AS (SELECT part, event_id, event_id % 101 <> 0 AND length(raw_hex) // 2 >= 54 AS ok FROM f),
    r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY event_id)
      - row_number() OVER (PARTITION BY part, ok ORDER BY event_id) AS island FROM o)
    SELECT part AS partition, min(event_id) AS first_position, max(event_id) AS last_position, count(*) AS failures
    FROM r WHERE NOT ok GROUP BY part, island""",
    FRAMES,
)
_add(
    "capture_filter",
    f"""SELECT event_id AS "offset", src_ip, dst_ip, dst_port FROM p WHERE {DECODABLE} AND proto = 'TCP'
    AND (src_port = 80 OR dst_port = 80 OR dst_ip = '10.1.0.3') AND src_ip <> '10.0.0.1'""",
)
_add(
    "topic_profile",
    """, t AS (SELECT 'network-flows' AS topic, part AS partition, min(event_id) AS begin_offset,
      max(event_id) + 1 AS end_offset, max(event_id) + 1 - min(event_id) AS messages FROM p GROUP BY part)
    SELECT * FROM t UNION ALL
    SELECT topic, NULL, NULL, NULL, CAST(sum(messages) AS BIGINT) FROM t GROUP BY topic""",
)
_add(
    "ingest_stats",
    f"""SELECT part AS partition, count(*) FILTER (WHERE {DECODABLE}) AS packets_sent,
    count(*) FILTER (WHERE NOT {DECODABLE}) AS packets_failed,
    CAST(COALESCE(sum(length(raw_hex) // 2) FILTER (WHERE {DECODABLE}), 0) AS BIGINT) AS bytes_read,
    count(*) FILTER (WHERE {DECODABLE}) / count(*)::DOUBLE * 100 AS success_rate FROM f GROUP BY part""",
    FRAMES,
)
RESULTS = f""", {tumbling(WEEK)}, c AS (SELECT {TIME}, count(*) AS n FROM w GROUP BY {TIME})"""
_add(
    "result_json",
    RESULTS
    + """ SELECT '{"algorithmName":"PacketCountDetector","flowId":"' || flow_key || '","timestamp":' || window_end
    || ',"analysisDetails":{"packetCount":' || n || ',"anomaly":' || CASE WHEN n > 10 THEN 'true' ELSE 'false' END
    || ',"flink_window_start":"' || window_start || '"}}' AS value FROM c""",
)
_add(
    "result_scan",
    RESULTS
    + """ SELECT 'PacketCountDetector' AS "algorithmName", 'test' AS source, 'node1' AS host,
    'covert-detection' AS pipeline, count(*) AS results, CAST(sum(n) AS BIGINT) AS packets FROM c""",
)
ODD = f""", {tumbling(WEEK)}, d AS (SELECT {TIME}, count(*) AS packets, bool_or(dest_port = 13) AS failed,
    count(*) FILTER (WHERE dest_port >= 0 AND dest_port % 2 = 1) AS odd FROM w GROUP BY {TIME})"""
_add(
    "dlq_rows",
    ODD
    + """ SELECT '{"error":"port \\"13\\" seen","key":"' || flow_key || '","window_start":' || window_start || '}'
    AS value FROM d WHERE failed""",
)
_add(
    "python_detector",
    ODD + f""" SELECT {TIME}, packets AS packets_in_window, odd AS odd_ports FROM d WHERE NOT failed AND odd > 0""",
)

# ---------------------------------------------------------------- streams: all windows, as in a batch

_add(
    "stream_tumbling",
    f""", {tumbling(WEEK)} SELECT {TIME}, count(*) AS packets_in_window FROM w GROUP BY {TIME}""",
)
_add("stream_session", f""", {session(12 * HOUR)} SELECT {TIME}, {SUMMARY} FROM w GROUP BY {TIME}""")
_add("stream_sliding_count", f""", {counted(10, 4)} SELECT {COUNT}, {SUMMARY} FROM w GROUP BY {COUNT}""")
_add(
    "stream_running",
    """SELECT flow_key, ts_ms, seq, row_number() OVER o AS rn, ts_ms - lag(ts_ms) OVER o AS gap_ms
    FROM h WINDOW o AS (PARTITION BY flow_key ORDER BY seq)""",
)
_add(
    "stream_port_entropy",
    f""", {sliding(3 * DAY, DAY)}, {port_statistics(TIME)} SELECT {TIME}, {PORT_COLUMNS} FROM d""",
)
_add("stream_compress", compress("tumbling", True))

for _name in ("python_accumulate", "stream_python_accumulate"):
    _add(
        _name,
        f""", {tumbling(WEEK)}, c AS (SELECT {TIME}, count(*) AS n FROM w GROUP BY {TIME})
        SELECT flow_key, window_start, n AS packets_in_window,
          CAST(sum(n) OVER (PARTITION BY flow_key ORDER BY window_start) AS BIGINT) AS seen FROM c""",
    )
_add(
    "stream_python_running",
    """SELECT flow_key, ts_ms, seq, row_number() OVER (PARTITION BY flow_key ORDER BY seq) AS seen FROM h""",
)
for _name in ("job_batch", "job_replay"):
    _add(
        _name,
        """, k AS (SELECT COALESCE(src_ip || '->' || dst_ip, 'Unknown') AS flow FROM p),
        c AS (SELECT flow, count(*) // 10 AS windows FROM k GROUP BY flow)
        SELECT 'PacketCountDetector' AS "algorithmName", flow AS "flowId", CAST(10 AS BIGINT) AS "packetCount",
          true AS anomaly, '10' AS packets_in_window, 'count_based' AS window_type FROM c, range(c.windows)""",
    )
_add(
    "topic_round_trip",
    """SELECT src_ip, count(*) AS packets, CAST(sum(ts_ms) AS BIGINT) AS times,
      CAST(CASE WHEN src_ip IS NULL THEN 0 ELSE 1 END AS BIGINT) AS partitions, true AS keyed FROM p GROUP BY src_ip""",
)
