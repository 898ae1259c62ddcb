"""Streams run to their end, late rows aside, and features corrected by rows that come late."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from fluxgauge.operators.reports import kpi_snapshot
from fluxgauge.operators.series import NODE_SERIES, RowChunks, WholeSeries
from fluxgauge.sources.readers import read_telemetry_stream
from fluxgauge.streaming import closing, history, jobs
from fluxgauge.streaming.stateful import features_stream, keyed_state
from test_streaming import batch_ticks, tick, write

FEATURES = ("lag_1h", "lag_168h", "diff_24", "ewm_30pct", "rolling_mean_6h", "rolling_max_24h")


def source_of(spark, folder, files="1"):
    return read_telemetry_stream(spark, str(folder), options={"maxFilesPerTrigger": files})


def test_a_closed_stream_gives_its_last_windows(spark, tmp_path):
    for n in range(3):
        write(tmp_path / "in", f"{n}.json", [tick(i) for i in range(n * 100, n * 100 + 100)])
    got = jobs.drain_closed(source_of(spark, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), jobs.kpi_stream)
    want = kpi_snapshot(batch_ticks(spark, tmp_path / "in"))
    assert got.count() == want.count() == 300
    assert got.select(want.columns).exceptAll(want).count() == 0
    # Closed for good: later rows are late, and running again adds nothing.
    write(tmp_path / "in", "late.json", [tick(1000)])
    again = jobs.drain_closed(source_of(spark, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), jobs.kpi_stream)
    assert again.count() == 300


def test_a_mark_may_close_a_part(spark, tmp_path):
    write(tmp_path / "in", "a.json", [tick(i) for i in range(60)])
    marks, out, check = str(tmp_path / "marks"), str(tmp_path / "out"), str(tmp_path / "check")
    build = lambda: jobs.kpi_stream(closing.closable(source_of(spark, tmp_path / "in"), marks))
    assert jobs.drain(build(), out, check).count() == 57
    closing.close_stream(spark, marks, at="2024-01-01 01:01:30")
    assert jobs.drain(build(), out, check).count() == 59
    write(tmp_path / "in", "b.json", [tick(i) for i in range(60, 120)])
    assert jobs.drain(build(), out, check).count() == 117


def test_rows_without_a_time_pass_the_marks(spark, tmp_path):
    rows = spark.createDataFrame([(None, "a"), (dt.datetime(2024, 1, 1), "b")], "timestamp timestamp, k string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = closing.closable(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "marks"))
    closing.close_stream(spark, str(tmp_path / "marks"))
    got = jobs.drain(closing.timely(stream, "timestamp", "1 minute"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted(r.k for r in got.collect()) == ["a", "b"] and got.columns == ["timestamp", "k"]


def test_late_rows_are_kept_apart(spark, tmp_path):
    parts = [[tick(i) for i in range(100)], [tick(200), tick(97), tick(98, minutes=98)], [tick(3), tick(199), tick(300)]]
    path = str(tmp_path / "side")

    def run():
        q = closing.late_rows(source_of(spark, tmp_path / "in"), path, str(tmp_path / "check"), "2 minutes", "1 minute", trigger=None)
        q.awaitTermination()
        return sorted(r.timestamp.minute + 60 * r.timestamp.hour for r in spark.read.parquet(f"{path}/late").collect())

    found = []
    for n, part in enumerate(parts):
        write(tmp_path / "in", f"{n}.json", part)
        found.append(run())
    # Newest 99, then 200: windows that ended by 97, then by 198, were closed.
    assert found == [[], [], [3]]
    assert run() == [3]


def test_kept_state_gives_every_row(spark, tmp_path):
    """All rows, out of order within the delay, over many hours and more than a tail of blocks."""
    order = list(range(900))
    order = order[:290] + order[310:320] + order[290:310] + order[320:]
    for n in range(3):
        write(tmp_path / "in", f"{n}.json", [tick(i) for i in order[n * 300 : n * 300 + 300]])
    write(tmp_path / "in", "2b.json", [tick(900, minutes=900), tick(900, minutes=900), tick(903, minutes=900)])
    with keyed_state(spark):
        build = lambda df: features_stream(df, "30 minutes")
        got = jobs.drain_closed(source_of(spark, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), build)
    batch = jobs.tick_windows(batch_ticks(spark, tmp_path / "in"), NODE_SERIES.__class__(keys=("node_id",), value="throughput_gbps", ties=("throughput_gbps",)))
    columns = ["node_id", "timestamp", "throughput_gbps", *[F.round(c, 6).alias(c) for c in FEATURES]]
    assert got.count() == batch.count() == 903
    assert got.select(columns).exceptAll(batch.select(columns)).count() == 0


@pytest.mark.parametrize("unit, chunks", [("hour", WholeSeries()), ("day", RowChunks(rows=200, bucket_seconds=3600))])
def test_late_rows_correct_earlier_features(spark, tmp_path, unit, chunks):
    """Rows of a batch fall among and before those of earlier batches."""
    early, later = [i for i in range(900) if i % 7], [i for i in range(0, 900, 7)]
    parts = [early[:400], later[:40] + early[400:500], early[500:] + later[40:], [tick_at for tick_at in range(900, 1000)]]
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        stream = read_telemetry_stream(spark, str(tmp_path / "in"))
        jobs.features_foreach_batch(stream, out, check, chunks=chunks, trigger=None, unit=unit).awaitTermination()
        return jobs.read_batches(spark, out)

    columns = ["node_id", "timestamp", *[F.round(c, 6).alias(c) for c in FEATURES]]
    for n, part in enumerate(parts):
        write(tmp_path / "in", f"{n}.json", [tick(i) for i in part])
        if n != 1:
            got = run()
    batch = jobs.tick_windows(batch_ticks(spark, tmp_path / "in"), NODE_SERIES)
    assert got.count() == 1000
    got = got.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    assert got.select(columns).exceptAll(batch.select(columns)).count() == 0
    assert not (tmp_path / "out" / "work" / "batch_id=0").exists()


def test_an_unfinished_batch_is_not_read(spark, tmp_path):
    """What a batch wrote before its manifest does not count, and running it again replaces it."""
    schema = batch_schema = spark.createDataFrame([], "node_id string, timestamp timestamp, throughput_gbps double").schema
    rows = lambda lo, hi: spark.createDataFrame(
        [("a", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), float(m)) for m in range(lo, hi)] + [("a", None, -1.0)], batch_schema
    )
    store = history.History(str(tmp_path / "h"), schema, NODE_SERIES, "hour", 10)
    build = lambda df, s: df.withColumn("before", s.lag(10))
    store.update(rows(0, 100), 0, WholeSeries(), build)
    first = history.newest_features(spark, str(tmp_path / "h"))
    assert first.count() == 101
    rows(500, 600).write.mode("overwrite").parquet(str(tmp_path / "h" / "features" / "version=1" / "__period=t2024-01-01-00"))
    assert history.newest_features(spark, str(tmp_path / "h")).filter("throughput_gbps >= 500").count() == 0
    for _ in range(2):
        store.update(rows(100, 130), 1, WholeSeries(), build)
    got = {(r.timestamp, r.throughput_gbps): r.before for r in history.newest_features(spark, str(tmp_path / "h")).collect()}
    assert history.newest_features(spark, str(tmp_path / "h")).count() == 132
    assert got[dt.datetime(2024, 1, 1, 2, 0), 120.0] == 110.0 and got[dt.datetime(2024, 1, 1, 0, 8), 8.0] == -1.0


def test_only_dependent_buckets_change(spark):
    rows = [("a", f"t{k:02d}", 5, k == 3) for k in range(10)] + [("b", f"t{k:02d}", 50, False) for k in range(10)]
    sizes = spark.createDataFrame(rows, "node_id string, __period string, n long, fresh boolean")
    changed = history.changed_buckets(sizes, ["node_id"], 12)
    assert sorted(r[0] for r in changed.collect()) == ["t03", "t04", "t05", "t06"]
    needed = history.needed_buckets(sizes, changed, ["node_id"], 12).collect()
    assert sorted((r.node_id, r["__period"]) for r in needed if not r["__hit"]) == [("a", "t00"), ("a", "t01"), ("a", "t02"), ("b", "t02")]
    assert len(needed) == 4 + 8
