"""Fixed table schemas and dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_D, _I, _S, _B, _TS = (
    T.DoubleType(),
    T.IntegerType(),
    T.StringType(),
    T.BooleanType(),
    T.TimestampNTZType(),
)


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


#: One row per (site, hour). ``packet_loss_pct`` is percent-like here.
HOURLY = _struct(
    ("timestamp", _TS),
    ("site", _S),
    ("total_gbps", _D),
    ("utilization_pct", _D),
    ("capacity_gbps", _I),
    ("https_gbps", _D),
    ("video_gbps", _D),
    ("http_gbps", _D),
    ("vpn_gbps", _D),
    ("dns_gbps", _D),
    ("db_gbps", _D),
    ("latency_ms", _D),
    ("packet_loss_pct", _D),
    ("jitter_ms", _D),
    ("retransmit_rate", _D),
    ("active_sessions", _I),
    ("new_flows_per_sec", _I),
    ("bgp_peers_up", _I),
    ("link_errors", _I),
    ("is_anomaly", _B),
    ("anomaly_type", _S),
    ("data_source", _S),
)

#: One row per (node, tick). ``packet_loss_pct`` is a fraction here.
NODE = _struct(
    ("timestamp", _TS),
    ("node_id", _S),
    ("region", _S),
    ("throughput_gbps", _D),
    ("latency_ms", _D),
    ("packet_loss_pct", _D),
    ("active_flows_m", _D),
    ("utilization_pct", _D),
    ("bytes_in_gbps", _D),
    ("bytes_out_gbps", _D),
    ("bgp_updates", _I),
    ("dns_qps", _I),
    ("cdn_requests_k", _D),
    ("jitter_ms", _D),
)

#: A flow record after cleaning.
FLOW = _struct(
    ("raw_timestamp", _TS),
    ("protocol", _S),
    ("bytes_fwd", _D),
    ("bytes_bwd", _D),
    ("total_bytes", _D),
    ("latency_raw", _D),
    ("traffic_type", _S),
    ("site", _S),
    ("hour", _TS),
)

TRAFFIC_TYPES = ("https", "video", "http", "vpn", "dns", "db")

# Site capacities in Gbps, the capacity of any other site, and the share of
# flows (percent) each site receives, in this order.
SITE_CAPACITY = {"NYC-DC1": 100, "LON-DC2": 80, "SYD-DC3": 60, "TKY-DC4": 70, "SFO-DC5": 90}
DEFAULT_CAPACITY = 75
SITE_WEIGHTS = (30, 25, 18, 12, 15)

# The holiday calendar.
HOLIDAYS = ("2024-01-01", "2024-07-04", "2024-11-28", "2024-12-25")


def dimension(spark: SparkSession, rows, columns: str) -> DataFrame:
    """A constant table inlined into the plan; ``columns`` is a DDL string."""
    schema = T._parse_datatype_string(columns)
    fields = ", ".join(
        f"cast({f.name} as {f.dataType.simpleString()}) as {f.name}" for f in schema.fields
    )
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    names = ", ".join(f.name for f in schema.fields)
    return spark.sql(f"SELECT {fields} FROM VALUES {values} AS t({names})")


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def site_dimension(spark: SparkSession) -> DataFrame:
    return dimension(spark, SITE_CAPACITY.items(), "site string, capacity_gbps int")


def holiday_dimension(spark: SparkSession) -> DataFrame:
    return dimension(spark, [(day,) for day in HOLIDAYS], "holiday date")
