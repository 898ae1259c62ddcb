"""Streams drained from files equal the batch results; late rows and restarts add nothing."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from fluxgauge.operators.anomaly import severity
from fluxgauge.operators.reports import kpi_snapshot
from fluxgauge.operators.series import NODE_SERIES, RowChunks, WholeSeries
from fluxgauge.sources.readers import read_telemetry_stream
from fluxgauge.streaming import jobs
from fluxgauge.streaming.stateful import features_stream, keyed_state

START = dt.datetime(2024, 1, 1)


def tick(i, minutes=None):
    at = START + dt.timedelta(minutes=i if minutes is None else minutes)
    return {
        "timestamp": at.isoformat(), "node_id": f"node-{i % 3}", "region": "EMEA", "throughput_gbps": float((i * 37) % 101),
        "latency_ms": float(i % 9), "packet_loss_pct": 0.002 if i % 5 == 0 else 0.0005, "active_flows_m": 0.5,
        "utilization_pct": float(i % 100), "bytes_in_gbps": 1.0, "bytes_out_gbps": 2.0, "bgp_updates": 1, "dns_qps": 10,
        "cdn_requests_k": 1.5, "jitter_ms": 0.1,
    }


def write(folder, name, ticks):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(t) + "\n" for t in ticks))


def batch_ticks(spark, folder):
    rows = spark.read.text(str(folder))
    from fluxgauge.sources.readers import parse_telemetry

    return parse_telemetry(rows).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def test_kpi_stream_late_rows_and_restart(spark, tmp_path):
    source, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    parts = [range(0, 100), range(100, 200), range(200, 300)]

    def run():
        stream = read_telemetry_stream(spark, str(source), options={"maxFilesPerTrigger": "1"})
        return jobs.drain(jobs.kpi_stream(stream), out, check)

    for n, part in enumerate(parts):
        write(source, f"{n}.json", [tick(i) for i in part])
        run()
    expected = kpi_snapshot(batch_ticks(spark, source)).filter("minute_ts < '2024-01-01 04:57:00'")
    got = run()
    columns = expected.columns
    assert got.select(columns).exceptAll(expected).count() == 0 and got.count() == expected.count() == 297
    before = got.count()
    write(source, "late.json", [tick(7, minutes=3), tick(8, minutes=4)])
    assert run().count() == before
    assert run().count() == before


def test_bad_json_gives_nulls_not_failure(spark, tmp_path):
    source = tmp_path / "in"
    write(source, "a.json", [tick(1)])
    (source / "b.json").write_text("not json\n")
    stream = read_telemetry_stream(spark, str(source))
    got = jobs.drain(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    assert got.count() == 2 and got.filter("node_id IS NULL").count() == 1


def test_hourly_stream(spark, tmp_path):
    rows = [(s, START + dt.timedelta(minutes=10 * i), k, float(i), 1.0) for i in range(60) for s, k in (("A", "https"), ("B", "dns"))]
    flows = spark.createDataFrame(rows, "site string, raw_timestamp timestamp, traffic_type string, total_bytes double, latency_raw double")
    flows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(flows.schema).parquet(str(tmp_path / "in"))
    got = jobs.drain(jobs.hourly_stream(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    first = got.filter("site = 'A'").orderBy("hour").first()
    assert (first.https, first.dns, first.avg_latency_ms) == (15.0, 0.0, 1.0)
    assert got.count() == 2 * 8


def test_anomaly_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    write(source, "a.json", [tick(i) for i in range(90)])
    baseline = spark.createDataFrame([(f"node-{i}", 10.0 * i, 20.0) for i in range(3)], "node_id string, mu double, sigma double")
    scored = jobs.anomaly_stream(read_telemetry_stream(spark, str(source)), baseline)
    got = jobs.drain(scored, str(tmp_path / "out"), str(tmp_path / "check"))
    batch = severity(batch_ticks(spark, source).join(baseline, "node_id"))
    key = ["node_id", "throughput_gbps", "z_score", "anomaly_severity"]
    assert got.select(key).exceptAll(batch.select(key)).count() == 0 and got.count() == 90
    assert got.filter("anomaly_severity = 'HIGH'").count() > 0


@pytest.mark.parametrize("chunks", [WholeSeries(), RowChunks(rows=200, bucket_seconds=3600)])
def test_foreach_batch_equals_batch_and_restarts(spark, tmp_path, chunks):
    source, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        stream = read_telemetry_stream(spark, str(source))
        jobs.features_foreach_batch(stream, out, check, chunks=chunks, trigger=None).awaitTermination()
        return jobs.read_batches(spark, out)

    for n in range(3):
        write(source, f"{n}.json", [tick(i) for i in range(n * 400, (n + 1) * 400)])
        got = run()
    batch = jobs.tick_windows(batch_ticks(spark, source), NODE_SERIES)
    columns = ["node_id", "throughput_gbps", *[F.round(c, 6).alias(c) for c in ("lag_1h", "lag_168h", "diff_24", "ewm_30pct", "rolling_std_1h", "spectral_entropy", "kurtosis_1h")]]
    assert got.count() == 1200 and got.filter("lag_168h IS NOT NULL").count() == 1200 - 3 * 168
    assert got.select(columns).exceptAll(batch.select(columns)).count() == 0
    assert run().count() == 1200


def test_repeated_batch_overwrites_its_own_output(spark, tmp_path):
    """A batch whose commit was lost is run again under its number."""
    source, out, check = tmp_path / "in", str(tmp_path / "out"), tmp_path / "check"

    def run():
        stream = read_telemetry_stream(spark, str(source))
        jobs.features_foreach_batch(stream, out, str(check), chunks=WholeSeries(), trigger=None).awaitTermination()
        return jobs.read_batches(spark, out)

    for n in range(2):
        write(source, f"{n}.json", [tick(i) for i in range(n * 300, (n + 1) * 300)])
        first = run().select("node_id", "timestamp", "lag_168h").collect()
    for name in ("1", ".1.crc"):
        (check / "commits" / name).unlink(missing_ok=True)
    assert sorted(map(str, run().select("node_id", "timestamp", "lag_168h").collect())) == sorted(map(str, first))


def test_stateful_features_in_event_time_order(spark, tmp_path):
    """Rows out of order within the watermark are put in order; later ones are dropped."""
    source, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        stream = read_telemetry_stream(spark, str(source), options={"maxFilesPerTrigger": "1"})
        with keyed_state(spark):
            return jobs.drain(features_stream(stream, "30 minutes"), out, check)

    order = list(range(600))
    swapped = order[:290] + order[310:320] + order[290:310] + order[320:]
    for n in range(3):
        write(source, f"{n}.json", [tick(i) for i in swapped[n * 200 : (n + 1) * 200]])
        got = run()
    write(source, "late.json", [tick(3)])
    assert run().count() == got.count()
    batch = jobs.tick_windows(batch_ticks(spark, source).filter("timestamp >= '2024-01-01'").dropDuplicates(["node_id", "timestamp"]), NODE_SERIES)
    columns = ["node_id", "timestamp", *[F.round(c, 6).alias(c) for c in ("lag_1h", "lag_168h", "diff_24", "ewm_30pct", "rolling_mean_6h", "rolling_max_24h")]]
    assert got.count() >= 560
    assert got.select(columns).exceptAll(batch.select(columns)).count() == 0


def test_processing_time_trigger(spark, tmp_path):
    source = tmp_path / "in"
    write(source, "a.json", [tick(i) for i in range(10)])
    stream = read_telemetry_stream(spark, str(source))
    q = jobs.start_feature_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
