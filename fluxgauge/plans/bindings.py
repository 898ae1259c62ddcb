"""Telemetry tables derived from the ``events`` table, for the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgauge.functions.protocol import with_traffic_type
from fluxgauge.operators.joins import with_capacity
from fluxgauge.operators.spine import densify
from fluxgauge.plans.features import HOURLY_FILL
from fluxgauge.schemas import HOURLY, SITE_CAPACITY, TRAFFIC_TYPES
from fluxgauge.session import materialize, prepare

PROTOCOL_SAMPLES = (
    " https ", "HTTP", "HTTP_CONNECT", "TLS_HTTP", "BitTorrent", "TeamSpeak", "WebRTC_x",
    "Live Stream", "gre_tunnel", "MSSQL", "Opera Browser", "NTP",
)
REGIONS = ("AMER", "EMEA", "APAC", "APAC", "AMER")
SITES = tuple(SITE_CAPACITY)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/events.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("double")


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _protocol() -> Column:
    return _pick(PROTOCOL_SAMPLES, F.col("user_id") % len(PROTOCOL_SAMPLES))


def hourly_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``HOURLY``: events per site and hour, one aggregation, hours without events absent."""
    rows = (
        with_traffic_type(events(spark, sf_dir), _protocol(), "kind")
        .withColumn("k", _k())
        .selectExpr(
            "user_id % 5 AS s",
            "CAST(date_trunc('hour', ts) AS timestamp_ntz) AS timestamp",
            "user_id",
            "value",
            "k",
            "kind",
            "event_type = 'error' AS failed",
            "value * 1000 + k * 10 AS bytes",
        )
    )
    shares = [
        f"try_divide(sum(CASE WHEN kind = '{t}' THEN bytes ELSE 0.0D END), sum(bytes)) AS {t}"
        for t in TRAFFIC_TYPES
    ]
    measures = [
        "avg(value) AS total_gbps",
        "avg(k) AS latency_ms",
        "coalesce(stddev_samp(k), 0.0D) AS jitter_ms",
        "avg(CASE WHEN failed THEN 1.0D ELSE 0.0D END) AS packet_loss_pct",
        "count(DISTINCT user_id) AS active_sessions",
        "count(*) AS new_flows_per_sec",
        "count_if(failed) AS link_errors",
        "max(value) > 300 AS is_anomaly",
    ]
    grouped = rows.groupBy("s", "timestamp").agg(*[F.expr(m) for m in (*measures, *shares)])
    named = grouped.withColumns(
        {"site": _pick(SITES, F.col("s")), "capacity_gbps": _pick(SITE_CAPACITY.values(), F.col("s"))}
    )
    derived = {
        "utilization_pct": "least(100.0D, total_gbps * 100 / capacity_gbps)",
        "retransmit_rate": "0.0D",
        "bgp_peers_up": "CASE WHEN is_anomaly THEN 6 ELSE 8 END",
        "anomaly_type": "CASE WHEN is_anomaly THEN 'ddos' END",
        "data_source": "'events'",
        **{f"{t}_gbps": f"total_gbps * {t}" for t in TRAFFIC_TYPES},
    }
    return named.selectExpr(
        *[
            f"CAST({derived.get(f.name, f.name)} AS {f.dataType.simpleString()}) AS {f.name}"
            for f in HOURLY.fields
        ]
    )


def grid_view(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``hourly_view`` (or the given columns of it) without gaps.

    The hourly table is stored first, as its range and sites are read as well as its rows,
    and the events should be scanned only once.
    """
    names = list(columns) or HOURLY.fieldNames()
    kept = list(dict.fromkeys(["site", "timestamp", *(n for n in names if n != "capacity_gbps")]))
    hourly = materialize(hourly_view(spark, sf_dir).select(kept))
    fill = {c: v for c, v in HOURLY_FILL.items() if c in kept}
    grid = densify(hourly, fill=fill)
    return (with_capacity(grid) if "capacity_gbps" in names else grid).select(names)


def node_rows(rows: DataFrame) -> DataFrame:
    """``NODE`` plus ``event_id``; works on a stream of events too."""
    s = F.col("user_id") % 5
    return rows.withColumns({"k": _k(), "region": _pick(REGIONS, s)}).selectExpr(
        "ts AS timestamp",
        "event_id",
        "concat('node-', user_id % 5) AS node_id",
        "region",
        "value AS throughput_gbps",
        "k AS latency_ms",
        "CASE WHEN event_type = 'error' THEN 0.002D ELSE 0.0005D END AS packet_loss_pct",
        "value / 100 AS active_flows_m",
        "least(100.0D, value) AS utilization_pct",
        "value * 0.6D AS bytes_in_gbps",
        "value * 0.4D AS bytes_out_gbps",
        "CAST(k AS int) % 10 AS bgp_updates",
        "CAST(k AS int) * 10 AS dns_qps",
        "value * k / 100 AS cdn_requests_k",
        "k / 10 AS jitter_ms",
    )


def node_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_rows(events(spark, sf_dir))


def flow_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw flows as a CSV would give them: text columns under unnormalised names."""
    return events(spark, sf_dir).select(
        F.date_format("ts", "dd/MM/yyyy HH:mm:ss").alias("Timestamp"),
        (F.col("value") * 1000).cast("string").alias("TotLen Fwd Pkts"),
        (_k() * 10).cast("string").alias(" TotLen.Bwd.Pkts"),
        (_k() * 1000).cast("string").alias("Fwd.IAT.Mean"),
        _protocol().alias("ProtocolName"),
        F.col("event_id").cast("string").alias("Flow ID"),
    )


def flow_bucket() -> Column:
    """The site bucket of a flow, by its number, so that SQL can follow."""
    return F.pmod(F.col("flow_id").cast("bigint") * 7919, F.lit(10_000))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream with zoned event time."""
    schema = events(spark, sf_dir).schema
    stream = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    )
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def node_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_rows(event_stream(spark, sf_dir))
