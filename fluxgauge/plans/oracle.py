"""The registered queries once more, as DuckDB SQL over the raw tables."""

from __future__ import annotations

# Sites, capacities, traffic types, and the sample protocols with their types.
SITES = ["NYC-DC1", "LON-DC2", "SYD-DC3", "TKY-DC4", "SFO-DC5"]
CAPACITY = [100, 80, 60, 70, 90]
TYPES = ["https", "video", "http", "vpn", "dns", "db"]
SAMPLE_TYPES = [
    "https", "http", "http", "https", "vpn", "video", "video", "video", "vpn", "db", "http", "https",
]
SAMPLE_NAMES = [
    " https ", "HTTP", "HTTP_CONNECT", "TLS_HTTP", "BitTorrent", "TeamSpeak", "WebRTC_x",
    "Live Stream", "gre_tunnel", "MSSQL", "Opera Browser", "NTP",
]


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


def _r(columns: str, digits: int = 9, **special: int) -> str:
    """Rounded doubles without negative zeros."""
    parts = []
    for c in columns.split():
        r = f"round({c}, {special.get(c, digits)})"
        parts.append(f"CASE WHEN {r} = 0 THEN 0.0::DOUBLE ELSE {r} END AS {c}")
    return ", ".join(parts)


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _int(columns: str) -> str:
    return ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in columns.split())


EV = """ev AS (SELECT *, user_id % 5 AS s, date_trunc('hour', ts) AS h,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"""

_KIND = f"{_list(SAMPLE_TYPES)}[(user_id % 12) + 1]"
HT = (
    f"""evk AS (SELECT *, {_KIND} AS kind, value * 1000 + k * 10 AS bytes FROM ev),
ha AS (SELECT s, h, avg(value) AS total_gbps, avg(k) AS latency_ms,
  coalesce(stddev_samp(k), 0) AS jitter_ms,
  avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0 END) AS packet_loss_pct,
  CAST(count(DISTINCT user_id) AS INTEGER) AS active_sessions,
  CAST(count(*) AS INTEGER) AS new_flows_per_sec,
  CAST(count(*) FILTER (event_type = 'error') AS INTEGER) AS link_errors,
  max(value) > 300 AS is_anomaly,
  """
    + ", ".join(f"sum(CASE WHEN kind = '{t}' THEN bytes ELSE 0 END) / sum(bytes) AS {t}" for t in TYPES)
    + f"""
  FROM evk GROUP BY s, h),
ht AS (SELECT h AS timestamp, {_list(SITES)}[s + 1] AS site, total_gbps,
  least(100.0, 100 * total_gbps / {_list(CAPACITY)}[s + 1]) AS utilization_pct,
  CAST({_list(CAPACITY)}[s + 1] AS INTEGER) AS capacity_gbps,
  """
    + ", ".join(f"total_gbps * {t} AS {t}_gbps" for t in TYPES)
    + """, latency_ms, packet_loss_pct, jitter_ms, 0.0::DOUBLE AS retransmit_rate, active_sessions,
  new_flows_per_sec, CAST(CASE WHEN is_anomaly THEN 6 ELSE 8 END AS INTEGER) AS bgp_peers_up,
  link_errors, is_anomaly, CASE WHEN is_anomaly THEN 'ddos' END AS anomaly_type,
  'events' AS data_source FROM ha)"""
)

_CAP = "CASE {c} " + " ".join(f"WHEN '{s}' THEN {c}" for s, c in zip(SITES, CAPACITY)) + " ELSE 75 END"


def _capacity(column: str) -> str:
    cases = " ".join(f"WHEN '{s}' THEN {c}" for s, c in zip(SITES, CAPACITY))
    return f"CAST(CASE {column} {cases} ELSE 75 END AS INTEGER)"


GRID = f"""hours AS (SELECT unnest(generate_series(min(timestamp), max(timestamp), INTERVAL 1 HOUR))
  AS timestamp FROM ht),
spine AS (SELECT site, timestamp FROM (SELECT DISTINCT site FROM ht), hours),
grid AS (SELECT p.site, p.timestamp, coalesce(total_gbps, 0) AS total_gbps,
  utilization_pct, {_capacity('p.site')} AS capacity_gbps,
  latency_ms, jitter_ms, packet_loss_pct, bgp_peers_up, anomaly_type,
  coalesce(new_flows_per_sec, 0) AS new_flows_per_sec, coalesce(is_anomaly, false) AS is_anomaly
  FROM spine p LEFT JOIN ht o ON o.site = p.site AND o.timestamp = p.timestamp)"""

NODE = """nt AS (SELECT ts AS timestamp, event_id, 'node-' || s AS node_id,
  ['AMER', 'EMEA', 'APAC', 'APAC', 'AMER'][s + 1] AS region, value AS throughput_gbps,
  k AS latency_ms, CASE WHEN event_type = 'error' THEN 0.002::DOUBLE ELSE 0.0005 END AS packet_loss_pct,
  value / 100 AS active_flows_m, least(100.0, value) AS utilization_pct,
  0.6 * value AS bytes_in_gbps, 0.4 * value AS bytes_out_gbps,
  CAST(CAST(k AS INTEGER) % 10 AS INTEGER) AS bgp_updates,
  CAST(CAST(k AS INTEGER) * 10 AS INTEGER) AS dns_qps,
  value * k / 100 AS cdn_requests_k, k / 10 AS jitter_ms FROM ev)"""

_BUCKET = "((event_id * 7919) % 10000)"
FLOWS = f"""fl AS (SELECT event_id, date_trunc('second', ts) AS raw_timestamp,
  {_list(SAMPLE_NAMES)}[(user_id % 12) + 1] AS protocol, value * 1000 AS bytes_fwd, k * 10 AS bytes_bwd,
  value * 1000 + k * 10 AS total_bytes, k * 1000 / 1000 AS latency_raw, {_KIND} AS traffic_type,
  CASE WHEN {_BUCKET} < 3000 THEN 'NYC-DC1' WHEN {_BUCKET} < 5500 THEN 'LON-DC2'
    WHEN {_BUCKET} < 7300 THEN 'SYD-DC3' WHEN {_BUCKET} < 8500 THEN 'TKY-DC4' ELSE 'SFO-DC5' END AS site,
  h AS hour FROM ev)"""

FLOW_HOURS = (
    "fh AS (SELECT site, hour, "
    + ", ".join(f"sum(CASE WHEN traffic_type = '{t}' THEN total_bytes ELSE 0 END)::DOUBLE AS {t}" for t in TYPES)
    + ", sum(total_bytes) AS total_bytes_hour, avg(latency_raw) AS avg_latency_ms FROM fl GROUP BY site, hour)"
)

HOURLY = (EV, HT)
DENSE = (EV, HT, GRID)
TICKS = (EV, NODE)
FLOWED = (EV, FLOWS)


def _over(rows: int, key: str = "site", order: str = "timestamp") -> str:
    return (
        f"OVER (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    )


def _prior(rows: int) -> str:
    return f"OVER (PARTITION BY site ORDER BY timestamp ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING)"


W = "OVER (PARTITION BY site ORDER BY timestamp)"
WN = "OVER (PARTITION BY node_id ORDER BY timestamp, event_id)"


def _node(rows: int) -> str:
    return _over(rows, "node_id", "timestamp, event_id")


ORACLE: dict[str, str] = {}

# ---- calendar ---------------------------------------------------------------------------


def _calendar(ts: str) -> str:
    dow = f"(isodow({ts}) - 1)"
    cycles = ", ".join(
        f"{f}(2 * pi() * {v} / {p}) AS {n}_{f}"
        for n, v, p in (("hour", f"hour({ts})", 24), ("dow", dow, 7), ("day", f"dayofyear({ts})", 365))
        for f in ("sin", "cos")
    )
    return f"""hour({ts}) AS hour_of_day, {dow} AS day_of_week, day({ts}) AS day_of_month,
  weekofyear({ts}) AS week_of_year, month({ts}) AS month, quarter({ts}) AS quarter,
  CASE WHEN {dow} >= 5 THEN 1 ELSE 0 END AS is_weekend,
  CASE WHEN hour({ts}) BETWEEN 9 AND 17 AND {dow} < 5 THEN 1 ELSE 0 END AS is_business_hour,
  CASE WHEN day({ts}) >= 28 THEN 1 ELSE 0 END AS is_month_end,
  CASE WHEN day({ts}) >= 28 AND month({ts}) IN (3, 6, 9, 12) THEN 1 ELSE 0 END AS is_quarter_end,
  CASE WHEN hour({ts}) BETWEEN 8 AND 20 THEN 1 ELSE 0 END AS is_peak_hour,
  CASE WHEN CAST({ts} AS DATE) IN (DATE '2024-01-01', DATE '2024-07-04', DATE '2024-11-28',
    DATE '2024-12-25') THEN 1 ELSE 0 END AS is_holiday, {cycles}"""


CAL_INT = (
    "hour_of_day day_of_week day_of_month week_of_year month quarter is_weekend is_business_hour "
    "is_month_end is_quarter_end is_peak_hour is_holiday"
)
CAL_DOUBLE = "hour_sin hour_cos dow_sin dow_cos day_sin day_cos"

ORACLE["temporal_features"] = (
    f"SELECT event_id, {_int(CAL_INT)}, {_r(CAL_DOUBLE)} FROM (SELECT event_id, {_calendar('ts')} FROM events)"
)
ORACLE["temporal_features_sunday0"] = f"""SELECT event_id, {_int('day_of_week is_weekend')}, {_r('dow_sin dow_cos')}
FROM (SELECT event_id, dayofweek(ts) AS day_of_week,
  CASE WHEN dayofweek(ts) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend,
  sin(2 * pi() * dayofweek(ts) / 7) AS dow_sin, cos(2 * pi() * dayofweek(ts) / 7) AS dow_cos FROM events)"""

# ---- lags and rolling -------------------------------------------------------------------

_LAGS = (1, 2, 3, 6, 12, 24, 48, 168)
_LAG_COLS = ", ".join(f"lag(total_gbps, {n}) {W} AS lag_{n}h" for n in _LAGS)
_LAG_NAMES = " ".join(f"lag_{n}h" for n in _LAGS)
ORACLE["lag_features"] = (
    _with(*DENSE, f"l AS (SELECT site, timestamp, total_gbps, {_LAG_COLS} FROM grid)")
    + f"""SELECT site, timestamp, {_r('total_gbps ' + _LAG_NAMES + ' diff_1 diff_24 vs_same_hour_yesterday vs_same_hour_last_week')}
FROM (SELECT *, total_gbps - lag_1h AS diff_1, total_gbps - lag_24h AS diff_24,
  total_gbps / nullif(lag_24h, 0) AS vs_same_hour_yesterday,
  total_gbps / nullif(lag_168h, 0) AS vs_same_hour_last_week FROM l)"""
)
ORACLE["time_true_lag"] = (
    _with(*HOURLY)
    + f"""SELECT site, timestamp, {_r('total_gbps time_lag_1h time_lag_24h time_lag_168h')}
FROM (SELECT a.site, a.timestamp, a.total_gbps, """
    + ", ".join(f"b{n}.total_gbps AS time_lag_{n}h" for n in (1, 24, 168))
    + " FROM ht a "
    + " ".join(
        f"LEFT JOIN ht b{n} ON b{n}.site = a.site AND b{n}.timestamp = a.timestamp - INTERVAL {n} HOUR"
        for n in (1, 24, 168)
    )
    + ")"
)


def _rolling(table: str, week: int) -> str:
    parts = []
    for n in (3, 6, 24):
        parts += [
            f"avg(total_gbps) {_over(n)} AS roll_mean_{n}h",
            f"stddev_samp(total_gbps) {_over(n)} AS roll_std_{n}h",
        ]
    parts += [
        f"max(total_gbps) {_over(24)} AS roll_max_24h",
        f"min(total_gbps) {_over(24)} AS roll_min_24h",
        f"CASE WHEN count(total_gbps) {_over(168)} >= {week} THEN avg(total_gbps) {_over(168)} END AS roll_mean_168h",
    ]
    return f"SELECT *, {', '.join(parts)} FROM {table}"


_ROLL = "roll_mean_3h roll_std_3h roll_mean_6h roll_std_6h roll_mean_24h roll_std_24h roll_max_24h roll_min_24h roll_mean_168h"
ORACLE["rolling_stats"] = (
    _with(*DENSE)
    + f"SELECT site, timestamp, {_r('total_gbps ' + _ROLL)} FROM ({_rolling('grid', 24)})"
)
ORACLE["chunked_rolling"] = (
    _with(*HOURLY)
    + f"SELECT site, timestamp, {_r('total_gbps lag_1h lag_24h lag_168h ' + _ROLL)} FROM (SELECT *, "
    + ", ".join(f"lag(total_gbps, {n}) {W} AS lag_{n}h" for n in (1, 24, 168))
    + f" FROM ({_rolling('ht', 1)}))"
)
ORACLE["rolling_moments"] = (
    _with(
        *TICKS,
        f"""m AS (SELECT *, row_number() {WN} AS rn FROM nt),
d AS (SELECT a.node_id, a.event_id, a.timestamp, a.throughput_gbps, b.throughput_gbps AS x
  FROM m a JOIN m b ON a.node_id = b.node_id AND b.rn BETWEEN a.rn - 11 AND a.rn),
c AS (SELECT *, x - avg(x) OVER (PARTITION BY node_id, event_id) AS e FROM d),
g AS (SELECT node_id, event_id, timestamp, throughput_gbps, avg(e*e) AS m2, avg(e*e*e) AS m3,
  avg(e*e*e*e) AS m4 FROM c GROUP BY ALL)""",
    )
    + f"""SELECT node_id, timestamp, event_id, {_r('throughput_gbps kurtosis_1h skewness_1h', 6)}
FROM (SELECT *, m4 / nullif(m2 * m2, 0) - 3 AS kurtosis_1h, m3 / nullif(sqrt(m2 * m2 * m2), 0) AS skewness_1h FROM g)"""
)
_Q = f"CASE WHEN count(total_gbps) {_over(24)} >= 6 THEN quantile_cont(total_gbps, {{p}}) {_over(24)} END"
ORACLE["rolling_quantiles"] = (
    _with(*DENSE)
    + f"""SELECT site, timestamp, {_r('total_gbps roll_q25_24h roll_q75_24h')} FROM (SELECT *,
  {_Q.format(p=0.25)} AS roll_q25_24h, {_Q.format(p=0.75)} AS roll_q75_24h FROM grid)"""
)
_TERMS = [(0, 0.3), (1, 0.21), (2, 0.147), (3, 0.103), (4, 0.072)]
_EWM = "(" + " + ".join(f"{w} * lag(throughput_gbps, {i}) {WN}" for i, w in _TERMS) + ") / 0.832"
_GEWM = (
    "("
    + " + ".join(f"{0.3 * 0.7**i!r} * coalesce(lag(throughput_gbps, {i}) {WN}, 0)" for i in range(10))
    + ") / ("
    + " + ".join(
        f"CASE WHEN lag(throughput_gbps, {i}) {WN} IS NULL THEN 0 ELSE {0.3 * 0.7**i!r} END" for i in range(10)
    )
    + ")"
)
ORACLE["ewm"] = (
    _with(*TICKS)
    + f"""SELECT node_id, timestamp, event_id, {_r('throughput_gbps ewm_30pct ewm', ewm=6)}
FROM (SELECT *, {_EWM} AS ewm_30pct, {_GEWM} AS ewm FROM nt)"""
)
_SPECTRAL = f"""stddev_samp(throughput_gbps) {_node(24)} / (avg(throughput_gbps) {_node(168)} + 1e-9) AS spectral_entropy,
  pow(avg(throughput_gbps) {_node(24)}, 2) AS periodogram_power,
  pow(avg(throughput_gbps) {_node(168)}, 2) AS periodogram_power_168"""
ORACLE["spectral_proxy"] = (
    _with(*TICKS)
    + f"""SELECT node_id, timestamp, event_id,
  {_r('throughput_gbps spectral_entropy periodogram_power periodogram_power_168', 6)}
FROM (SELECT *, {_SPECTRAL} FROM nt)"""
)



def _peaks(rows: int) -> str:
    """Strongest bin of a written-out Fourier transform of the last ``rows`` values."""
    angle = f"2 * pi() * k * i / {rows}"
    return f"""b{rows} AS (SELECT i, k, cos({angle}) AS c, sin({angle}) AS s
  FROM (SELECT unnest(range({rows})) AS i), (SELECT unnest(range(1, {rows // 2 + 1})) AS k)),
r{rows} AS (SELECT a.event_id, b.rn - a.rn + {rows - 1} AS i, b.x FROM m a
  JOIN m b ON a.node_id = b.node_id AND b.rn BETWEEN a.rn - {rows - 1} AND a.rn WHERE a.rn >= {rows}),
q{rows} AS (SELECT event_id, k, sum(x * c) ** 2 + sum(x * s) ** 2 AS p FROM r{rows} r JOIN b{rows} b ON r.i = b.i GROUP BY ALL),
f{rows} AS (SELECT event_id, arg_max(k, p)::DOUBLE AS fft_peak_{rows} FROM q{rows} GROUP BY event_id)"""


ORACLE["fft_peaks"] = (
    _with(
        *TICKS,
        f"m AS (SELECT node_id, event_id, throughput_gbps AS x, row_number() {WN} AS rn FROM nt)",
        _peaks(24),
        _peaks(168),
    )
    + f"""SELECT nt.node_id, timestamp, nt.event_id, {_r('throughput_gbps fft_peak_24 fft_peak_168')} FROM nt
LEFT JOIN f24 ON f24.event_id = nt.event_id LEFT JOIN f168 ON f168.event_id = nt.event_id"""
)

ORACLE["spectral_joined"] = ORACLE["spectral_proxy"]
ORACLE["fft_dominant_bin_sql"] = (
    _with(
        *TICKS,
        f"m AS (SELECT node_id, event_id, throughput_gbps AS x, row_number() {WN} AS rn FROM nt)",
        _peaks(24),
    )
    + f"""SELECT nt.node_id, nt.event_id, {_r('fft_peak_24')} FROM nt LEFT JOIN f24 ON f24.event_id = nt.event_id"""
)

# ---- KPIs, cross-site, anomalies --------------------------------------------------------

_KPI_SQL = f"""SELECT *, 100 - utilization_pct AS bandwidth_headroom_pct,
  total_gbps / nullif(capacity_gbps, 0) AS traffic_intensity_index,
  CASE WHEN latency_ms IS NOT NULL AND packet_loss_pct IS NOT NULL AND jitter_ms IS NOT NULL THEN
    greatest(0.0, least(100.0, 100 - latency_ms / 5 - packet_loss_pct * 20 - jitter_ms / 2)) END AS quality_score,
  CASE WHEN utilization_pct > 80 THEN 'HIGH' WHEN utilization_pct > 65 THEN 'MEDIUM' ELSE 'LOW' END AS congestion_risk,
  CASE WHEN latency_ms IS NOT NULL THEN total_gbps / greatest(latency_ms, 1.0) END AS efficiency_ratio,
  (total_gbps - lag_24h) / nullif(lag_24h, 0) AS traffic_growth_rate,
  roll_max_24h / nullif(roll_mean_24h, 0) AS peak_to_avg_ratio
  FROM (SELECT *, {_LAG_COLS} FROM ({_rolling('grid', 24)}))"""
_KPI = "bandwidth_headroom_pct traffic_intensity_index quality_score efficiency_ratio traffic_growth_rate peak_to_avg_ratio"
ORACLE["derived_kpis"] = (
    _with(*DENSE) + f"SELECT site, timestamp, congestion_risk, {_r(_KPI)} FROM ({_KPI_SQL})"
)
_CROSS = """CAST(rank() OVER (PARTITION BY timestamp ORDER BY utilization_pct DESC NULLS LAST) AS INTEGER)
    AS site_rank_current_hour,
  utilization_pct / nullif(avg(utilization_pct) OVER (PARTITION BY timestamp), 0) AS site_relative_to_avg,
  stddev_samp(utilization_pct) OVER (PARTITION BY timestamp) AS cross_site_stddev"""
ORACLE["cross_site_signals"] = (
    _with(*DENSE)
    + f"""SELECT site, timestamp, site_rank_current_hour,
  {_r('utilization_pct site_relative_to_avg cross_site_stddev')} FROM (SELECT *, {_CROSS} FROM grid)"""
)
CORRELATION = """o AS (SELECT *, (sum(utilization_pct) OVER (PARTITION BY timestamp) - utilization_pct)
  / nullif(count(utilization_pct) OVER (PARTITION BY timestamp) - 1, 0) AS m,
  row_number() OVER (PARTITION BY site ORDER BY timestamp) AS rn FROM grid),
e AS (SELECT *, CASE WHEN m IS NOT NULL THEN utilization_pct END AS u FROM o),
c AS (SELECT a.site, a.timestamp, CASE WHEN stddev_pop(b.u) > 1e-9 * avg(abs(b.u)) AND stddev_pop(b.m) > 1e-9 * avg(abs(b.m))
  THEN corr(b.u, b.m) END AS cross_site_correlation_index
  FROM e a JOIN e b ON a.site = b.site AND b.rn BETWEEN a.rn - 23 AND a.rn GROUP BY a.site, a.timestamp)"""
ORACLE["cross_site_correlation"] = (
    _with(*DENSE, CORRELATION)
    + f"SELECT site, timestamp, {_r('cross_site_correlation_index', 6)} FROM c"
)


def _indicators(table: str, spike: int, prior: bool, day_rows: int, high_rows: int, floor: float | None) -> str:
    frame = _prior if prior else _over
    day, short = frame(24), frame(spike)
    std = (lambda c: f"greatest({c}, {floor})") if floor else (lambda c: f"nullif({c}, 0)")
    guard = f"greatest(q75 - q25, {floor})" if floor else "(q75 - q25)"
    return f"""SELECT *, CASE WHEN abs(zscore_1h) > 3 THEN 1 ELSE 0 END AS sudden_spike_flag FROM (SELECT *,
  CASE WHEN n24 >= {day_rows} AND s24 IS NOT NULL THEN (total_gbps - m24) / {std('s24')} END AS zscore_24h,
  CASE WHEN s3 IS NOT NULL THEN (total_gbps - m3) / {std('s3')} END AS zscore_1h,
  CASE WHEN n24 >= {day_rows} AND abs(total_gbps - m24) > 1.5 * {guard} THEN 1 ELSE 0 END AS iqr_flag_24h,
  CASE WHEN n24 >= {day_rows} AND n6 >= {high_rows} AND low6 > 1.5 * m24 THEN 1 ELSE 0 END AS sustained_high_flag
  FROM (SELECT *, count(total_gbps) {day} AS n24, avg(total_gbps) {day} AS m24, stddev_samp(total_gbps) {day} AS s24,
    avg(total_gbps) {short} AS m3, stddev_samp(total_gbps) {short} AS s3,
    quantile_cont(total_gbps, 0.25) {day} AS q25, quantile_cont(total_gbps, 0.75) {day} AS q75,
    min(total_gbps) {_over(6)} AS low6, count(total_gbps) {_over(6)} AS n6 FROM {table}))"""


_FLAGS = "iqr_flag_24h sudden_spike_flag sustained_high_flag"
_IND = _indicators("grid", 3, False, 6, 3, None)
ORACLE["anomaly_indicators"] = (
    _with(*DENSE)
    + f"SELECT site, timestamp, {_int(_FLAGS)}, {_r('zscore_24h zscore_1h')} FROM ({_IND})"
)
ORACLE["anomaly_indicators_prior_baseline"] = (
    _with(*HOURLY)
    + f"SELECT site, timestamp, {_int(_FLAGS)}, {_r('zscore_24h zscore_1h', 6)} FROM ({_indicators('ht', 24, True, 1, 1, 0.001)})"
)
_VOTES = "(CASE WHEN abs(zscore_24h) > {t} THEN 1 ELSE 0 END + iqr_flag_24h + sustained_high_flag)"
ORACLE["anomaly_ensemble"] = (
    _with(*DENSE)
    + f"""SELECT site, timestamp, CAST({_VOTES.format(t=2)} AS INTEGER) AS ensemble_votes,
  CAST(CASE WHEN {_VOTES.format(t=2)} >= 2 THEN 1 ELSE 0 END AS INTEGER) AS ensemble_anomaly FROM ({_IND})"""
)
ORACLE["anomaly_types"] = (
    _with(*DENSE)
    + f"""SELECT site, timestamp, anomaly_type, CASE WHEN utilization_pct >= usual + 30 THEN 'ddos'
  WHEN utilization_pct <= 0.2 * usual THEN 'maintenance' WHEN bgp_peers_up < peers THEN 'bgp_flap' END AS detected_type
FROM (SELECT *, avg(utilization_pct) {_prior(24)} AS usual, lag(bgp_peers_up, 1) {W} AS peers FROM grid)"""
)


def _flags(as_of: str, days: int, back: int) -> str:
    return (
        _with(
            *TICKS,
            f"""st AS (SELECT node_id, avg(throughput_gbps) AS mu, stddev_samp(throughput_gbps) AS sigma FROM nt
  WHERE timestamp >= {as_of} - INTERVAL {days} DAY AND timestamp <= {as_of} GROUP BY node_id),
z AS (SELECT timestamp, nt.node_id, throughput_gbps, mu, sigma, abs(throughput_gbps - mu) / (sigma + 1e-9) AS z_score
  FROM nt JOIN st ON st.node_id = nt.node_id WHERE timestamp >= {as_of} - INTERVAL {back} HOUR AND timestamp <= {as_of})""",
        )
        + f"""SELECT timestamp, node_id, {_r('throughput_gbps mu sigma z_score')},
  CASE WHEN z_score > 3.5 THEN 'HIGH' WHEN z_score > 2.5 THEN 'MEDIUM' ELSE 'NORMAL' END AS anomaly_severity FROM z"""
    )


_NOW = "(SELECT max(ts) FROM events)"
ORACLE["anomaly_flags"] = _flags(_NOW, 7, 24)
ORACLE["anomaly_flags_as_of"] = _flags("TIMESTAMP '2024-01-20 12:00:00'", 5, 12)
ORACLE["baseline_stats"] = (
    _with(*TICKS)
    + f"""SELECT node_id, {_r('mu sigma')} FROM (SELECT node_id, avg(throughput_gbps) AS mu,
  stddev_samp(throughput_gbps) AS sigma FROM nt WHERE timestamp >= {_NOW} - INTERVAL 7 DAY GROUP BY node_id)"""
)
_DIFFS = "diff_1 diff_24 vs_same_hour_yesterday vs_same_hour_last_week"
_SIGNALS = "site_relative_to_avg cross_site_stddev cross_site_correlation_index zscore_24h zscore_1h"
_FEATURE_TEXT = "congestion_risk detected_type"
_FEATURE_INT = f"{CAL_INT} site_rank_current_hour {_FLAGS} ensemble_votes"
_FEATURE_DOUBLE = " ".join([CAL_DOUBLE, _LAG_NAMES, _DIFFS, _ROLL, _KPI, _SIGNALS])
FEATURES = f"""fr AS (SELECT f.*, cross_site_correlation_index,
  CASE WHEN utilization_pct >= usual + 30 THEN 'ddos' WHEN utilization_pct <= 0.2 * usual THEN 'maintenance'
    WHEN bgp_peers_up < peers THEN 'bgp_flap' END AS detected_type,
  {_VOTES.format(t=3)} AS ensemble_votes
FROM (SELECT *, {_CROSS}, {_calendar('timestamp')}, total_gbps - lag_1h AS diff_1, total_gbps - lag_24h AS diff_24,
  total_gbps / nullif(lag_24h, 0) AS vs_same_hour_yesterday, total_gbps / nullif(lag_168h, 0) AS vs_same_hour_last_week,
  avg(utilization_pct) {_prior(24)} AS usual, lag(bgp_peers_up, 1) {W} AS peers
  FROM ({_indicators('(' + _KPI_SQL + ')', 3, False, 6, 3, None)})) f
LEFT JOIN c ON c.site = f.site AND c.timestamp = f.timestamp)"""
_FEATURE_OUT = f"""{', '.join(_FEATURE_TEXT.split())}, {_int(_FEATURE_INT)},
  {_r(_FEATURE_DOUBLE, cross_site_correlation_index=6)}"""
ORACLE["hourly_features"] = _with(*DENSE, CORRELATION, FEATURES) + f"SELECT site, timestamp, {_FEATURE_OUT} FROM fr"
_NEWEST = ", ".join(
    f"arg_max({c}, timestamp) FILTER ({c} IS NOT NULL) AS {c}"
    for c in f"{_FEATURE_TEXT} {_FEATURE_INT} {_FEATURE_DOUBLE}".split()
)
ORACLE["current_feature_kpis"] = (
    _with(*DENSE, CORRELATION, FEATURES)
    + f"SELECT site, timestamp, {_FEATURE_OUT} FROM (SELECT site, max(timestamp) AS timestamp, {_NEWEST} FROM fr GROUP BY site)"
)

# ---- flows ------------------------------------------------------------------------------

# Protocol names per traffic type, and the last keywords that can still match.
_EXACT = {
    "https": "https SSL TLS Facebook Instagram Twitter Google Gmail Outlook Whatsapp Telegram Dropbox GitHub LinkedIn Reddit",
    "video": "YouTube Netflix Vimeo Twitch video streaming VideoCall Zoom Teams Skype WebRTC",
    "http": "http HTTP Web Spotify SoundCloud",
    "vpn": "VPN OpenVPN IPSec WireGuard L2TP PPTP Tor",
    "dns": "DNS dns mDNS LLMNR",
    "db": "MySQL PostgreSQL MongoDB Redis Kafka AMQP MQTT NFS SMB FTP SFTP SSH",
}
_WORDS = {"video": "stream", "vpn": "tunnel", "db": "sql|db|mongo", "http": "browser"}
_MAP = (
    "CASE "
    + " ".join(f"WHEN trim(protocol) IN ({', '.join(repr(n) for n in v.split())}) THEN '{t}'" for t, v in _EXACT.items())
    + " "
    + " ".join(
        f"WHEN regexp_matches(lower(protocol), '{'|'.join(v.lower().split())}') THEN '{t}'" for t, v in _EXACT.items()
    )
    + " "
    + " ".join(f"WHEN regexp_matches(lower(protocol), '{v}') THEN '{t}'" for t, v in _WORDS.items())
    + " ELSE 'https' END"
)
ORACLE["protocol_buckets"] = f"""SELECT protocol, count(*) AS n, {_MAP} AS traffic_type FROM (
  SELECT {_list(SAMPLE_NAMES)}[(user_id % 12) + 1] AS protocol FROM events UNION ALL SELECT url FROM pages)
GROUP BY protocol"""
ORACLE["flow_clean"] = (
    _with(*FLOWED)
    + f"""SELECT raw_timestamp, protocol, traffic_type, site, hour,
  {_r('bytes_fwd bytes_bwd total_bytes latency_raw', 4)} FROM fl"""
)
ORACLE["flow_csv_source"] = ORACLE["flow_clean"]
ORACLE["flow_csv_mixed"] = ORACLE["flow_clean"]
ORACLE["flow_csv_rejected"] = """SELECT 6 AS n_columns, count(*) AS n_lines, 8 AS n_fields FROM events WHERE event_id % 30 = 2"""
ORACLE["flow_formats"] = ORACLE["flow_clean"] + " WHERE event_id % 8 <> 7"
ORACLE["flow_format_votes"] = """SELECT 'Seen At' AS "column", family, count(*) AS n,
  count_if(family IN ('year last', 'short year') AND day(ts) > 12) AS day_first, 0 AS month_first
FROM (SELECT ts, ['year last', 'year last', 'year first', 'year first', 'day and month name', 'short year', 'month name and day',
  NULL][event_id % 8 + 1] AS family FROM events) GROUP BY family"""
ORACLE["flow_defaults"] = (
    _with(*FLOWED)
    + """SELECT raw_timestamp, CAST(NULL AS VARCHAR) AS protocol, 'https' AS traffic_type, site, hour,
  1000.0::DOUBLE AS bytes_fwd, 300.0::DOUBLE AS bytes_bwd, 1300.0::DOUBLE AS total_bytes, 10.0::DOUBLE AS latency_raw FROM fl"""
)
ORACLE["synthetic_timestamps"] = """SELECT TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * CAST(i // 3600 AS INTEGER) AS hour,
  count(*) AS n, count(*) AS n_seconds FROM (SELECT row_number() OVER () - 1 AS i FROM events) GROUP BY 1"""
ORACLE["hourly_by_type"] = (
    _with(*FLOWED)
    + f"""SELECT site, hour, traffic_type, {_r('total_bytes', 4)} FROM (SELECT site, hour, traffic_type,
  sum(total_bytes) AS total_bytes FROM fl GROUP BY ALL)"""
)
_FLOW_DOUBLES = " ".join(TYPES) + " total_bytes_hour avg_latency_ms"
ORACLE["hourly_flow_table"] = ORACLE["pivot_types"] = (
    _with(*FLOWED, FLOW_HOURS) + f"SELECT site, hour, {_r(_FLOW_DOUBLES, 4)} FROM fh"
)
ORACLE["hourly_from_flows"] = (
    _with(
        *FLOWED,
        FLOW_HOURS,
        "hours AS (SELECT unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM fh)",
        "d AS (SELECT p.site, p.hour, "
        + ", ".join(f"coalesce({c}, 0) AS {c}" for c in [*TYPES, "total_bytes_hour"])
        + """, avg_latency_ms FROM (SELECT site, hour FROM (SELECT DISTINCT site FROM fh), hours) p
  LEFT JOIN fh o ON o.site = p.site AND o.hour = p.hour)""",
    )
    + f"SELECT site, hour, {_r(_FLOW_DOUBLES, 4)} FROM d"
)
RATIOS = """tr AS (SELECT traffic_type, total_bytes, total_bytes / (SELECT sum(total_bytes_hour) FROM fh) AS ratio FROM (
  """ + " UNION ALL ".join(
    f"SELECT '{t}' AS traffic_type, (SELECT sum({t}) FROM fh) AS total_bytes" for t in TYPES
) + "))"
ORACLE["type_ratios"] = (
    _with(*FLOWED, FLOW_HOURS, RATIOS)
    + f"SELECT traffic_type, {_r('total_bytes ratio', total_bytes=3)} FROM tr"
)
HOD = """hp AS (SELECT CAST(g.hod AS INTEGER) AS hod, coalesce(m, (SELECT avg(total_bytes_hour) FROM fh)) AS mean_value
  FROM (SELECT unnest(range(24)) AS hod) g
  LEFT JOIN (SELECT hour(hour) AS hod, avg(total_bytes_hour) AS m FROM fh GROUP BY 1) s ON s.hod = g.hod),
hn AS (SELECT *, mean_value / (SELECT max(mean_value) FROM hp) AS hod_norm FROM hp)"""
ORACLE["hod_profile"] = (
    _with(*FLOWED, FLOW_HOURS, HOD)
    + f"SELECT hod, {_r('mean_value hod_norm', mean_value=4)} FROM hn"
)
ORACLE["how_profile"] = (
    _with(*HOURLY)
    + f"""SELECT site, {_int('day_of_week hour_of_day')}, {_r('how_mean how_std')}, how_count FROM (
  SELECT site, isodow(timestamp) - 1 AS day_of_week, hour(timestamp) AS hour_of_day, avg(total_gbps) AS how_mean,
  stddev_samp(total_gbps) AS how_std, count(total_gbps) AS how_count FROM ht GROUP BY 1, 2, 3)"""
)
_USUAL = [*TYPES, "total_bytes_hour"]
ORACLE["expected_profile"] = (
    _with(
        *FLOWED,
        FLOW_HOURS,
        "wk AS (SELECT site, isodow(hour) AS d, hour(hour) AS h, count(*) AS observed_hours, "
        + ", ".join(f"avg({c}) AS {c}" for c in _USUAL)
        + " FROM fh GROUP BY 1, 2, 3)",
        "dl AS (SELECT site, hour(hour) AS h, " + ", ".join(f"avg({c}) AS {c}" for c in _USUAL) + " FROM fh GROUP BY 1, 2)",
        """sp AS (SELECT site, hour FROM (SELECT DISTINCT site FROM fh),
  (SELECT unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM fh))""",
        "x AS (SELECT sp.site, sp.hour, coalesce(observed_hours, 0) AS observed_hours, "
        + ", ".join(f"coalesce(wk.{c}, dl.{c}) AS expected_{c}" for c in _USUAL)
        + """ FROM sp LEFT JOIN wk ON wk.site = sp.site AND wk.d = isodow(sp.hour) AND wk.h = hour(sp.hour)
  LEFT JOIN dl ON dl.site = sp.site AND dl.h = hour(sp.hour))""",
    )
    + f"SELECT site, hour, observed_hours, {_r(' '.join('expected_' + c for c in _USUAL), 4)} FROM x"
)
ORACLE["densified_hourly"] = (
    _with(*DENSE)
    + f"""SELECT site, timestamp, capacity_gbps, new_flows_per_sec, is_anomaly,
  {_r('total_gbps utilization_pct latency_ms')} FROM grid"""
)
ORACLE["forward_filled"] = (
    _with(*DENSE)
    + f"""SELECT site, timestamp, {_r('latency_ms')} FROM (SELECT site, timestamp,
  last_value(latency_ms IGNORE NULLS) OVER (PARTITION BY site ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  AS latency_ms FROM grid)"""
)
ORACLE["densified_irregular"] = (
    _with(
        *TICKS,
        """t AS (SELECT node_id, date_trunc('hour', timestamp) AS hour, timestamp, throughput_gbps, packet_loss_pct,
  CASE WHEN event_id % 3 = 0 THEN latency_ms END AS latency_ms FROM nt)""",
        "newest AS (SELECT *, row_number() OVER (PARTITION BY node_id, hour ORDER BY timestamp DESC, latency_ms DESC NULLS LAST) AS rn FROM t)",
        """h AS (SELECT node_id, hour, avg(throughput_gbps) AS throughput_gbps, max(packet_loss_pct) AS packet_loss_pct,
  max(latency_ms) FILTER (WHERE rn = 1) AS latency_ms FROM newest GROUP BY node_id, hour)""",
        "span AS (SELECT unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM h)",
        "p AS (SELECT node_id, hour FROM (SELECT DISTINCT node_id FROM h), span)",
    )
    + f"""SELECT node_id, hour AS timestamp, {_r('throughput_gbps packet_loss_pct latency_ms')} FROM (
  SELECT p.node_id, p.hour, throughput_gbps, packet_loss_pct, last_value(latency_ms IGNORE NULLS) OVER (PARTITION BY p.node_id
  ORDER BY p.hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS latency_ms
  FROM p LEFT JOIN h ON h.node_id = p.node_id AND h.hour = p.hour)"""
)
ORACLE["dedupe_series"] = (
    _with(*TICKS)
    + f"""SELECT node_id, timestamp, event_id, {_r('throughput_gbps latency_ms')} FROM (
  SELECT node_id, date_trunc('hour', timestamp) AS timestamp, throughput_gbps, latency_ms, event_id,
  row_number() OVER (PARTITION BY node_id, date_trunc('hour', timestamp)
    ORDER BY throughput_gbps NULLS FIRST, latency_ms NULLS FIRST, event_id NULLS FIRST) AS rn FROM nt) WHERE rn = 1"""
)

# ---- node table -------------------------------------------------------------------------

EXOG = """ex AS (SELECT node_id, avg(cdn_requests_k) AS cdn_mean, stddev_samp(cdn_requests_k) AS cdn_std,
  avg(dns_qps) AS dns_mean, stddev_samp(dns_qps) AS dns_std FROM nt GROUP BY node_id)"""
ORACLE["exog_stats"] = (
    _with(*TICKS, EXOG) + f"SELECT node_id, {_r('cdn_mean cdn_std dns_mean dns_std')} FROM ex"
)
_NORM = """(cdn_requests_k - cdn_mean) / (cdn_std + 1e-9) AS cdn_req_norm,
  (dns_qps - dns_mean) / (dns_std + 1e-9) AS dns_qps_norm"""
ORACLE["exog_norm"] = (
    _with(*TICKS, EXOG)
    + f"""SELECT node_id, event_id, {_r('cdn_req_norm dns_qps_norm')}
FROM (SELECT nt.node_id, event_id, {_NORM} FROM nt JOIN ex ON ex.node_id = nt.node_id)"""
)
_MOMENTS = f"""mo AS (SELECT *, row_number() {WN} AS rn FROM nt),
md AS (SELECT a.event_id, b.throughput_gbps - avg(b.throughput_gbps) OVER (PARTITION BY a.event_id) AS e
  FROM mo a JOIN mo b ON a.node_id = b.node_id AND b.rn BETWEEN a.rn - 11 AND a.rn),
mg AS (SELECT event_id, avg(e*e*e*e) / nullif(avg(e*e) * avg(e*e), 0) - 3 AS kurtosis_1h,
  avg(e*e*e) / nullif(pow(avg(e*e), 1.5), 0) AS skewness_1h FROM md GROUP BY event_id)"""
_NODE_DOUBLES = (
    "throughput_gbps hour_sin hour_cos rolling_mean_1h rolling_std_1h rolling_mean_6h rolling_max_24h "
    "rolling_min_24h ewm_30pct kurtosis_1h skewness_1h utilization_pct packet_loss_rate avg_latency_ms jitter_ms "
    "active_flows bytes_io_ratio top_talker_share protocol_entropy lag_1h lag_2h lag_24h lag_48h lag_168h "
    "diff_1 diff_24 cdn_req_norm dns_qps_norm ntp_drift_proxy spectral_entropy periodogram_power "
    "fft_peak_24 fft_peak_168"
)
ORACLE["node_features"] = (
    _with(
        *TICKS,
        EXOG,
        _MOMENTS,
        f"m AS (SELECT node_id, event_id, throughput_gbps AS x, row_number() {WN} AS rn FROM nt)",
        _peaks(24),
        _peaks(168),
        f"""nf AS (SELECT nt.*, {_NORM}, hour(timestamp) AS hour_of_day, dayofweek(timestamp) AS day_of_week,
  CASE WHEN isodow(timestamp) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  CASE WHEN hour(timestamp) BETWEEN 8 AND 20 THEN 1 ELSE 0 END AS is_peak_hour, month(timestamp) AS month,
  quarter(timestamp) AS quarter, weekofyear(timestamp) AS week_of_year,
  CASE WHEN CAST(timestamp AS DATE) IN (DATE '2024-01-01', DATE '2024-07-04', DATE '2024-11-28', DATE '2024-12-25')
    THEN 1 ELSE 0 END AS is_holiday,
  sin(2 * pi() * hour(timestamp) / 24) AS hour_sin, cos(2 * pi() * hour(timestamp) / 24) AS hour_cos,
  packet_loss_pct AS packet_loss_rate, latency_ms AS avg_latency_ms, active_flows_m AS active_flows,
  bytes_in_gbps / (bytes_out_gbps + 1e-9) AS bytes_io_ratio, 0 AS geo_event_flag, 0 AS maintenance_flag
  FROM nt JOIN ex ON ex.node_id = nt.node_id),
nw AS (SELECT nf.*, avg(throughput_gbps) {_node(12)} AS rolling_mean_1h, stddev_samp(throughput_gbps) {_node(12)} AS rolling_std_1h,
  avg(throughput_gbps) {_node(6)} AS rolling_mean_6h, max(throughput_gbps) {_node(24)} AS rolling_max_24h,
  min(throughput_gbps) {_node(24)} AS rolling_min_24h, {_EWM} AS ewm_30pct, {_SPECTRAL}, """
        + ", ".join(f"lag(throughput_gbps, {n}) {WN} AS lag_{n}h" for n in (1, 2, 24, 48, 168))
        + """ FROM nf),
nx AS (SELECT nw.*, kurtosis_1h, skewness_1h, throughput_gbps - lag_1h AS diff_1, throughput_gbps - lag_24h AS diff_24,
  throughput_gbps / (rolling_max_24h + 1e-9) AS top_talker_share, rolling_std_1h / (rolling_mean_1h + 1e-9) AS protocol_entropy,
  rolling_std_1h AS ntp_drift_proxy, fft_peak_24, fft_peak_168 FROM nw JOIN mg ON mg.event_id = nw.event_id
  LEFT JOIN f24 ON f24.event_id = nw.event_id LEFT JOIN f168 ON f168.event_id = nw.event_id WHERE lag_168h IS NOT NULL)""",
    )
    + f"""SELECT timestamp, event_id, node_id, region,
  {_int('hour_of_day day_of_week is_weekend is_peak_hour month quarter week_of_year is_holiday bgp_updates geo_event_flag maintenance_flag')},
  {_r(_NODE_DOUBLES, kurtosis_1h=6, skewness_1h=6, periodogram_power=6)} FROM nx"""
)
ORACLE["announced_event_flags"] = (
    _with(
        *TICKS,
        """an AS (SELECT 'node-' || (o_orderkey % 5) AS node_id,
  TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * CAST(o_orderkey * 7 % 42000 AS INTEGER) AS b,
  TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * CAST(o_orderkey * 7 % 42000 + o_orderkey % 48 + 6 AS INTEGER) AS e,
  o_orderkey % 2 AS p FROM orders)""",
    )
    + "SELECT node_id, event_id, "
    + ", ".join(
        f"""CAST(CASE WHEN EXISTS (SELECT 1 FROM an WHERE an.node_id = nt.node_id AND p = {p}
  AND timestamp >= b AND timestamp < e) THEN 1 ELSE 0 END AS INTEGER) AS {n}"""
        for n, p in (("geo_event_flag", 0), ("maintenance_flag", 1))
    )
    + " FROM nt"
)

# ---- KPI snapshots and reports ----------------------------------------------------------

_SNAP = """count(DISTINCT node_id) AS active_nodes, sum(throughput_gbps) AS total_throughput_gbps,
  avg(utilization_pct) AS avg_utilization_pct, avg(latency_ms) AS avg_latency_ms,
  avg(packet_loss_pct) * 100 AS packet_loss_pct, sum(active_flows_m) AS total_flows_m,
  100 - avg(packet_loss_pct) * 100 AS availability_pct"""
_SNAP_DIGITS = {
    "total_throughput_gbps": 2, "avg_utilization_pct": 2, "avg_latency_ms": 2, "packet_loss_pct": 4,
    "total_flows_m": 3, "availability_pct": 4,
}
_HALF_UP = ", ".join(f"floor({c} * {10**d}.0 + 0.500001) / {10**d}.0 AS {c}" for c, d in _SNAP_DIGITS.items())
_MINUTES = f"""(SELECT date_trunc('minute', timestamp) AS minute_ts, {_SNAP},
  count(*) FILTER (utilization_pct > 85) AS high_util_nodes,
  count(*) FILTER (packet_loss_pct > 0.001) AS degraded_nodes FROM nt GROUP BY 1)"""
ORACLE["kpi_snapshot"] = (
    _with(*TICKS)
    + f"""SELECT minute_ts, active_nodes, high_util_nodes, degraded_nodes, {_r(' '.join(_SNAP_DIGITS))}
FROM (SELECT * REPLACE ({_HALF_UP}) FROM {_MINUTES})"""
)
ORACLE["kpi_snapshot_daily"] = (
    _with(*TICKS)
    + f"""SELECT minute_ts, active_nodes, high_util_nodes, degraded_nodes, {_r(' '.join(_SNAP_DIGITS), 6)}
FROM (SELECT date_trunc('day', timestamp) AS minute_ts, {_SNAP},
  count(DISTINCT node_id) FILTER (utilization_pct > 85) AS high_util_nodes,
  count(DISTINCT node_id) FILTER (packet_loss_pct > 0.001) AS degraded_nodes FROM nt GROUP BY 1)"""
)
_H_DOUBLE = (
    "total_gbps utilization_pct https_gbps video_gbps http_gbps vpn_gbps dns_gbps db_gbps latency_ms "
    "packet_loss_pct jitter_ms retransmit_rate"
)
_H_OTHER = "capacity_gbps active_sessions new_flows_per_sec bgp_peers_up link_errors is_anomaly anomaly_type data_source"
CURRENT = "cu AS (SELECT site, max(timestamp) AS timestamp, " + ", ".join(
    f"arg_max({c}, timestamp) FILTER ({c} IS NOT NULL) AS {c}" for c in (_H_DOUBLE + " " + _H_OTHER).split()
) + " FROM ht GROUP BY site)"
ORACLE["node_schema_report"] = """SELECT u.*, CASE u."column" WHEN 'jitter_ms' THEN (SELECT count(*) FROM events) ELSE 0 END AS nulls,
  CASE u."column" WHEN 'latency_ms' THEN (SELECT count(*) FROM events WHERE event_id % 50 = 1)
    WHEN 'timestamp' THEN (SELECT count(*) FROM events WHERE event_id % 40 = 3) ELSE 0 END AS violations
FROM (VALUES """ + ", ".join(
    f"('{c}', {kind}, {'NULL' if c == 'jitter_ms' else repr('string')})"
    for kind, names in {
        "'timestamp_ntz'": ["timestamp"],
        "'string'": ["node_id", "region"],
        "'int'": ["bgp_updates", "dns_qps"],
        "'double'": [
            "throughput_gbps", "latency_ms", "packet_loss_pct", "active_flows_m", "utilization_pct",
            "bytes_in_gbps", "bytes_out_gbps", "cdn_requests_k", "jitter_ms",
        ],
        "NULL": ["event_id"],
    }.items()
    for c in names
) + """) u("column", expected, found)"""
ORACLE["node_layout_days"] = (
    _with(*TICKS)
    + f"""SELECT node_id, event_id, timestamp, CAST(timestamp AS DATE) AS date, {_r('throughput_gbps latency_ms')} FROM nt
WHERE node_id IN ('node-1', 'node-3') AND timestamp >= TIMESTAMP '2024-01-08' AND timestamp < TIMESTAMP '2024-01-13'"""
)
#: The tick table with a week of history, in place of all of it.
WEEK_TICKS = (EV, NODE.replace("nt AS (", "n0 AS (", 1), f"""n1 AS (SELECT *, lag(throughput_gbps, 168) {WN} AS lag_168h,
  throughput_gbps - lag(throughput_gbps, 24) {WN} AS diff_24 FROM n0), nt AS (SELECT * FROM n1 WHERE lag_168h IS NOT NULL)""")
ORACLE["view_network_features"] = (
    _with(*WEEK_TICKS)
    + f"""SELECT node_id, CAST(is_weekend AS INTEGER) AS is_weekend, n, {_r('lag_mean diff_high loss latency_low')} FROM (
  SELECT node_id, CASE WHEN dayofweek(timestamp) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend, count(*) AS n,
  avg(lag_168h) AS lag_mean, max(diff_24) AS diff_high, avg(packet_loss_pct) AS loss, min(latency_ms) AS latency_low FROM nt GROUP BY 1, 2)"""
)
ORACLE["view_kpi_snapshot"] = ORACLE["kpi_snapshot"].replace(_with(*TICKS), _with(*WEEK_TICKS), 1)
ORACLE["view_anomaly_flags"] = ORACLE["anomaly_flags"].replace(NODE, ", ".join(WEEK_TICKS[1:]), 1)
ORACLE["current_kpis"] = (
    _with(*HOURLY, CURRENT)
    + f"SELECT site, timestamp, {', '.join(_H_OTHER.split())}, {_r(_H_DOUBLE)} FROM cu"
)
ORACLE["anomaly_report"] = (
    _with(*HOURLY)
    + f"""SELECT timestamp, site, {_r('total_gbps utilization_pct')}, anomaly_type FROM ht
WHERE is_anomaly AND timestamp >= (SELECT max(timestamp) FROM ht) - INTERVAL 720 HOUR"""
)
ORACLE["anomaly_report_count"] = (
    _with(*HOURLY)
    + """SELECT count(*) AS anomalies, CAST(240 AS INTEGER) AS window_hours FROM ht
WHERE is_anomaly AND timestamp >= (SELECT max(timestamp) FROM ht) - INTERVAL 240 HOUR"""
)
ORACLE["platform_summary"] = (
    _with(*HOURLY, CURRENT)
    + f"""SELECT sites_monitored, {_r('total_traffic_gbps avg_utilization_pct')}, high_utilization_count,
  CAST(55 AS INTEGER) AS features_engineered, data_points, CAST(168 AS INTEGER) AS forecasting_horizon_hours
FROM (SELECT count(*) AS sites_monitored, sum(coalesce(total_gbps, 0)) AS total_traffic_gbps,
  avg(nullif(utilization_pct, 0)) AS avg_utilization_pct,
  count(*) FILTER (utilization_pct > 80) AS high_utilization_count,
  (SELECT count(*) FROM ht) AS data_points FROM cu)"""
)
ORACLE["high_utilization_sites"] = (
    _with(*HOURLY, CURRENT) + f"SELECT site, {_r('utilization_pct')} FROM cu WHERE utilization_pct > 80"
)
ORACLE["site_coverage"] = (
    _with(*HOURLY)
    + """SELECT site, min(timestamp) AS first_hour, max(timestamp) AS last_hour, count(*) AS n_rows,
  (SELECT date_diff('hour', min(timestamp), max(timestamp)) + 1 FROM ht) - count(*) AS missing_hours FROM ht GROUP BY site"""
)
_PROFILED = {
    "temporal": f"{CAL_INT} {CAL_DOUBLE}",
    "lag_features": f"{_LAG_NAMES} {_DIFFS}",
    "rolling_stats": _ROLL,
    "derived_kpis": f"{_KPI} congestion_risk",
    "cross_site": "site_rank_current_hour site_relative_to_avg cross_site_stddev cross_site_correlation_index",
    "anomaly_indicators": f"zscore_24h zscore_1h {_FLAGS}",
}


def _profile(name: str, group: str) -> str:
    value = "CAST(NULL AS DOUBLE)" if name == "congestion_risk" else f"CAST({name} AS DOUBLE)"
    return f"""SELECT '{group}' AS feature_group, '{name}' AS feature, count({name}) AS non_null,
  (count(*) - count({name})) / count(*)::DOUBLE AS null_rate, min({value}) AS min_value,
  avg({value}) AS mean_value, max({value}) AS max_value FROM fr"""


ORACLE["feature_profile"] = (
    _with(*DENSE, CORRELATION, FEATURES)
    + f"""SELECT feature_group, feature, non_null, {_r('null_rate min_value mean_value max_value', 6)}
FROM ({' UNION ALL '.join(_profile(n, g) for g, names in _PROFILED.items() for n in names.split())})"""
)
ORACLE["batch_day_features"] = (
    _with(*DENSE)
    + f"""SELECT site, timestamp, {_r('lag_24h lag_168h roll_mean_24h roll_mean_168h zscore_24h')}, {_int('iqr_flag_24h')},
  site_rank_current_hour, congestion_risk, CAST(timestamp AS DATE) AS date
FROM (SELECT *, {_CROSS} FROM ({_indicators('(' + _KPI_SQL + ')', 3, False, 6, 3, None)})) f
WHERE CAST(timestamp AS DATE) = DATE '2024-01-20'
  AND EXISTS (SELECT 1 FROM ht WHERE ht.site = f.site AND ht.timestamp = f.timestamp)"""
)
ORACLE["anomaly_timeline"] = (
    _with(*HOURLY)
    + """SELECT CAST(timestamp AS DATE) AS date, anomaly_type, count(*) AS anomalies FROM ht
WHERE is_anomaly AND timestamp >= (SELECT max(timestamp) FROM ht) - INTERVAL 720 HOUR GROUP BY 1, 2"""
)
ORACLE["availability_daily"] = (
    _with(*HOURLY)
    + f"""SELECT site, date, {_r('availability_pct')}, measured_hours FROM (SELECT site, CAST(timestamp AS DATE) AS date,
  100 - avg(packet_loss_pct) * 100 AS availability_pct, count(packet_loss_pct) AS measured_hours FROM ht GROUP BY 1, 2)"""
)
ORACLE["run_report_of_features"] = (
    _with(*HOURLY) + "SELECT count(*) AS n_rows, CAST(22 AS INTEGER) AS n_columns FROM ht"
)

# ---- forecasts --------------------------------------------------------------------------


def _training(origin: str, weeks: int) -> str:
    return f"""tw AS (SELECT site, timestamp, total_gbps FROM grid WHERE timestamp >= {origin} - INTERVAL {168 * weeks} HOUR
  AND timestamp < {origin})"""


def _forecast(origin: str, steps: int, point: str, weeks: int = 4, name: str = "fc") -> str:
    return f"""{_training(origin, weeks)},
fr AS (SELECT site, h AS horizon_hours, {origin} + INTERVAL 1 HOUR * CAST(h - 1 AS INTEGER) AS timestamp,
  {_capacity('site')} AS capacity_gbps FROM (SELECT DISTINCT site FROM tw), (SELECT unnest(range(1, {steps + 1})) AS h)),
pr AS (SELECT site, isodow(timestamp) AS d, hour(timestamp) AS o, avg(total_gbps) AS m FROM tw GROUP BY 1, 2, 3),
pt AS (SELECT fr.*, pr.m AS how, n1.total_gbps AS naive_24, n2.total_gbps AS naive_168 FROM fr
  LEFT JOIN pr ON pr.site = fr.site AND d = isodow(timestamp) AND o = hour(timestamp)
  LEFT JOIN tw n1 ON n1.site = fr.site AND n1.timestamp = fr.timestamp - INTERVAL 1 HOUR * CAST(24 * ((horizon_hours + 23) // 24) AS INTEGER)
  LEFT JOIN tw n2 ON n2.site = fr.site AND n2.timestamp = fr.timestamp - INTERVAL 1 HOUR * CAST(168 * ((horizon_hours + 167) // 168) AS INTEGER)),
{name} AS (SELECT site, timestamp, CAST(horizon_hours AS INTEGER) AS horizon_hours, capacity_gbps, u * capacity_gbps AS forecast_gbps,
  u * 100 AS forecast_utilization_pct FROM (SELECT *, CASE WHEN {point} IS NOT NULL THEN
    greatest(0.05, least(0.95, {point} / capacity_gbps)) END AS u FROM pt))"""


_ORIGIN = "(SELECT max(timestamp) + INTERVAL 1 HOUR FROM grid)"
_FC = f"SELECT site, timestamp, horizon_hours, capacity_gbps, {_r('forecast_gbps forecast_utilization_pct')} FROM fc"
ORACLE["training_window"] = (
    _with(*DENSE, _training(_ORIGIN, 4)) + f"SELECT site, timestamp, {_r('total_gbps')} FROM tw"
)
ORACLE["forecast_profile"] = _with(*DENSE, _forecast(_ORIGIN, 168, "how")) + _FC
ORACLE["site_forecast"] = ORACLE["forecast_profile"] + " WHERE site = 'LON-DC2' AND horizon_hours <= 24"
ORACLE["forecast_naive"] = _with(*DENSE, _forecast(_ORIGIN, 72, "naive_24")) + _FC
ORACLE["forecast_blend"] = (
    _with(*DENSE, _forecast(_ORIGIN, 168, "list_avg(list_filter([how, naive_24, naive_168], lambda x: x IS NOT NULL))"))
    + _FC
)


def _backtest(ahead: int) -> str:
    week = -(-ahead // 168) * 168
    lags = ", ".join(f"lag(total_gbps, {week + 168 * i}) {W}" for i in range(4))
    per = " UNION ALL ".join(
        f"""SELECT site, '{m}' AS method, count(*) AS n_obs, sum((total_gbps - {m}) ** 2) AS rss,
  avg(abs(total_gbps - {m}) / nullif(abs(total_gbps), 0)) * 100 AS mape, {p} AS p FROM bu GROUP BY site"""
        for m, p in (("naive_24", 1), ("naive_168", 1), ("hour_of_week", 168))
    )
    return f"""bp AS (SELECT *, lag(total_gbps, {-(-ahead // 24) * 24}) {W} AS naive_24, lag(total_gbps, {week}) {W} AS naive_168,
  list_avg(list_filter([{lags}], lambda x: x IS NOT NULL)) AS hour_of_week FROM grid),
bu AS (SELECT * FROM bp WHERE total_gbps IS NOT NULL AND naive_24 IS NOT NULL AND naive_168 IS NOT NULL AND hour_of_week IS NOT NULL),
bt AS (SELECT *, sqrt(rss / n_obs) AS rmse, n_obs * ln(rss / n_obs) + 2 * p AS aic, n_obs * ln(rss / n_obs) + p * ln(n_obs) AS bic
  FROM ({per}))"""


_BT = f"SELECT site, method, n_obs, {_r('rmse mape rss aic bic', 6)} FROM bt"
ORACLE["backtest"] = _with(*DENSE, _backtest(1)) + _BT
ORACLE["backtest_day_ahead"] = _with(*DENSE, _backtest(30)) + _BT
ORACLE["model_selection"] = (
    _with(*DENSE, _backtest(1))
    + f"""SELECT site, method, n_obs, {_r('training_rmse training_mape_pct aic bic', 6)} FROM (SELECT site, method, n_obs,
  rmse AS training_rmse, mape AS training_mape_pct, aic, bic,
  row_number() OVER (PARTITION BY site ORDER BY aic, method) AS rn FROM bt) WHERE rn = 1"""
)
ORACLE["forecast_interval"] = (
    _with(*DENSE, _backtest(1), _forecast(_ORIGIN, 168, "how"))
    + f"""SELECT site, timestamp, horizon_hours, capacity_gbps, {_r('forecast_gbps forecast_utilization_pct lower_ci upper_ci')}
FROM (SELECT fc.*, greatest(0.0, forecast_gbps - r) AS lower_ci, forecast_gbps + r AS upper_ci FROM (SELECT fc.*,
  1.96 * rmse * (1 + 0.018 * (horizon_hours - 1)) AS r FROM fc JOIN bt ON bt.site = fc.site AND method = 'hour_of_week') fc)"""
)
ORACLE["peak_and_headroom"] = (
    _with(*DENSE, _forecast(_ORIGIN, 168, "how"))
    + f"""SELECT site, peak_hour, {_r('peak_gbps min_headroom_gbps')} FROM (SELECT site, timestamp AS peak_hour,
  forecast_gbps AS peak_gbps, min(capacity_gbps - forecast_gbps) OVER (PARTITION BY site) AS min_headroom_gbps,
  row_number() OVER (PARTITION BY site ORDER BY forecast_gbps DESC, horizon_hours) AS rn FROM fc) WHERE rn = 1"""
)
_PAST = "(SELECT max(timestamp) - INTERVAL 167 HOUR FROM grid)"
ORACLE["residuals"] = (
    _with(*DENSE, _forecast(_PAST, 168, "how", 3))
    + f"""SELECT site, timestamp, {_r('actual fitted residual')} FROM (SELECT grid.site, grid.timestamp, total_gbps AS actual,
  forecast_gbps AS fitted, total_gbps - forecast_gbps AS residual
  FROM grid JOIN fc ON fc.site = grid.site AND fc.timestamp = grid.timestamp)"""
)

# ---- streams, closed at the end of their input ------------------------------------------

ORACLE["kpi_stream"] = (
    _with(*TICKS)
    + f"""SELECT minute_ts, active_nodes, high_util_nodes, degraded_nodes, {_r(' '.join(_SNAP_DIGITS))}
FROM (SELECT * REPLACE ({_HALF_UP}) FROM {_MINUTES})"""
)
ORACLE["telemetry_json_stream"] = (
    _with(*TICKS)
    + f"""SELECT timestamp, node_id, region, {_int('bgp_updates dns_qps')},
  {_r('throughput_gbps latency_ms packet_loss_pct active_flows_m utilization_pct bytes_in_gbps bytes_out_gbps cdn_requests_k jitter_ms')} FROM nt"""
)
ORACLE["hourly_stream"] = (
    _with(*FLOWED, FLOW_HOURS)
    + f"""SELECT site, hour, {_r(' '.join(TYPES) + ' avg_latency_ms', 4)} FROM fh"""
)
ORACLE["anomaly_stream"] = (
    _with(
        *TICKS,
        f"""st AS (SELECT node_id, avg(throughput_gbps) AS mu, stddev_samp(throughput_gbps) AS sigma FROM nt
  WHERE timestamp >= {_NOW} - INTERVAL 7 DAY GROUP BY node_id),
z AS (SELECT timestamp, nt.node_id, throughput_gbps, mu, sigma, abs(throughput_gbps - mu) / (sigma + 1e-9) AS z_score
  FROM nt JOIN st ON st.node_id = nt.node_id)""",
    )
    + f"""SELECT timestamp, node_id, {_r('throughput_gbps mu sigma z_score')},
  CASE WHEN z_score > 3.5 THEN 'HIGH' WHEN z_score > 2.5 THEN 'MEDIUM' ELSE 'NORMAL' END AS anomaly_severity FROM z"""
)
_TICK_LAGS = ", ".join(f"lag(throughput_gbps, {n}) {WN} AS lag_{n}h" for n in (1, 2, 24, 48, 168))
_TICK_SQL = f"""(SELECT *, throughput_gbps - lag_1h AS diff_1, throughput_gbps - lag_24h AS diff_24,
  throughput_gbps / (rolling_max_24h + 1e-9) AS top_talker_share FROM (SELECT *, {_TICK_LAGS},
  avg(throughput_gbps) {_node(6)} AS rolling_mean_6h, max(throughput_gbps) {_node(24)} AS rolling_max_24h,
  min(throughput_gbps) {_node(24)} AS rolling_min_24h, {_EWM} AS ewm_30pct, {_SPECTRAL} FROM nt))"""
ORACLE["features_foreach_batch"] = (
    _with(*TICKS)
    + f"""SELECT node_id, event_id, {_r('lag_1h lag_168h diff_24 rolling_mean_6h rolling_max_24h ewm_30pct top_talker_share periodogram_power', periodogram_power=6)}
FROM {_TICK_SQL}"""
)
ORACLE["features_stream"] = (
    _with(*TICKS)
    + f"""SELECT node_id, timestamp, {_r('throughput_gbps lag_1h lag_2h lag_24h lag_48h lag_168h diff_1 diff_24 rolling_mean_6h rolling_max_24h rolling_min_24h ewm_30pct')}
FROM {_TICK_SQL}"""
)

ORACLE["assigned_sites"] = """
WITH drawn AS (SELECT ('0x' || substr(md5('42|' || event_id), 1, 8))::BIGINT % 10000 AS bucket FROM events)
SELECT CASE WHEN bucket < 3000 THEN 'NYC-DC1' WHEN bucket < 5500 THEN 'LON-DC2' WHEN bucket < 7300 THEN 'SYD-DC3'
            WHEN bucket < 8500 THEN 'TKY-DC4' ELSE 'SFO-DC5' END AS site, count(*) AS n
FROM drawn GROUP BY 1
"""
