"""Snapshots, reports and forecasts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fluxgauge.operators import forecast, reports
from fluxgauge.operators.anomaly import anomaly_flags, baseline_stats
from fluxgauge.operators.catalogue import catalogue, feature_groups
from fluxgauge.operators.exog import add_exog
from fluxgauge.operators.joins import event_flags, interval_index, merge_intervals, with_capacity
from fluxgauge.operators.series import NODE_SERIES

START = dt.datetime(2024, 1, 1)


def test_minute_kpis(spark):
    rows = [("a", 1.111, 90.0, 0.002), ("a", 2.222, 86.0, 0.0005), ("b", 3.333, 10.0, 0.0015)]
    df = spark.createDataFrame(rows, "node_id string, throughput_gbps double, utilization_pct double, packet_loss_pct double")
    df = df.withColumns({"timestamp": F.lit(START), "latency_ms": F.lit(5.0), "active_flows_m": F.lit(0.5)})
    row = reports.kpi_snapshot(df).first()
    assert (row.active_nodes, row.total_throughput_gbps, row.avg_utilization_pct) == (2, 6.67, 62.0)
    assert (row.packet_loss_pct, row.availability_pct) == (0.1333, 99.8667)
    assert (row.high_util_nodes, row.degraded_nodes, row.total_flows_m) == (2, 2, 1.5)
    by_node = reports.kpi_snapshot(df, distinct=True).first()
    assert (by_node.high_util_nodes, by_node.degraded_nodes) == (1, 2)


def test_snapshot_is_newest_first(spark):
    df = spark.range(5).selectExpr(
        "timestampadd(MINUTE, CAST(id AS int), TIMESTAMP_NTZ'2024-01-01 00:00:00') AS timestamp", "'n' AS node_id",
        "1D AS throughput_gbps", "1D AS utilization_pct", "0D AS packet_loss_pct", "1D AS latency_ms", "1D AS active_flows_m",
    )
    got = [r.minute_ts for r in reports.kpi_snapshot(df).collect()]
    assert got == sorted(got, reverse=True) and len(got) == 5


def test_last_known_value_per_column(spark):
    rows = [("A", START, 5.0, 7.0), ("A", START + dt.timedelta(hours=1), None, 8.0), ("B", START, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "site string, timestamp timestamp_ntz, u double, l double")
    got = {r.site: (r.u, r.l) for r in reports.current_kpis(df).collect()}
    assert got == {"A": (5, 8), "B": (None, 1)}


def test_last_known_text(spark):
    rows = [
        ("A", START, "x", 1, "old"), ("A", START + dt.timedelta(hours=1), None, 2, "new"), ("B", START, None, 3, None),
        (None, START, "y", None, "z"),
    ]
    df = spark.createDataFrame(rows, "site string, timestamp timestamp_ntz, a string, n int, b string")
    got = {r.site: (r.a, r.n, r.b) for r in reports.current_kpis(df).collect()}
    assert got == {"A": ("x", 2, "new"), "B": (None, 3, None), None: ("y", None, "z")}


def hourly(spark, rows):
    return spark.createDataFrame(
        rows, "site string, timestamp timestamp_ntz, total_gbps double, utilization_pct double, is_anomaly boolean, anomaly_type string"
    )


def test_anomaly_report(spark):
    rows = [("A", START + dt.timedelta(hours=i), 1.0, 2.0, i % 10 == 0, "ddos" if i % 10 == 0 else None) for i in range(50)]
    df = hourly(spark, rows)
    report = reports.anomaly_report(df, 24)
    assert [r.timestamp.day for r in report.collect()] == [2, 2] and len(report.columns) == 5
    assert reports.anomaly_count(df, 24).first().anomalies == 2
    assert reports.anomaly_report(df, 5, as_of="2024-01-01 11:00:00").count() == 1
    for bad in (0, 721):
        with pytest.raises(ValueError):
            reports.anomaly_report(df, bad)
    timeline = reports.anomaly_timeline(df).orderBy("date").collect()
    assert [r.anomalies for r in timeline] == [3, 2]


def test_platform_summary(spark):
    df = hourly(spark, [("A", START, 10.0, 90.0, False, None), ("B", START, None, 0.0, False, None), ("C", START, 5.04, None, False, None)])
    row = reports.platform_summary(reports.current_kpis(df), df, features=48).first()
    assert (row.sites_monitored, row.total_traffic_gbps, row.avg_utilization_pct) == (3, 15.0, 90.0)
    assert (row.high_utilization_count, row.data_points, row.features_engineered) == (1, 3, 48)
    assert [r.site for r in reports.high_utilization_sites(df).collect()] == ["A"]


def test_coverage(spark):
    df = hourly(spark, [("A", START + dt.timedelta(hours=h), 1.0, 1.0, False, None) for h in (0, 1, 5)] + [("B", START, 1.0, 1.0, False, None)])
    got = {r.site: (r.n_rows, r.missing_hours) for r in reports.site_coverage(df).collect()}
    assert got == {"A": (3, 3), "B": (1, 5)}


def test_catalogue_comes_from_the_builders(spark):
    groups = feature_groups(spark)
    assert set(groups) == {"temporal", "lag_features", "rolling_stats", "derived_kpis", "cross_site", "anomaly_indicators"}
    assert {"hour_sin", "is_quarter_end"} <= set(groups["temporal"]) and len(groups["rolling_stats"]) == 9
    assert len(groups["derived_kpis"]) == 7 and len(groups["anomaly_indicators"]) == 5
    assert catalogue(spark).count() == sum(map(len, groups.values()))
    sizes = {r.feature_group: r.n_features for r in reports.feature_group_sizes(spark).collect()}
    assert sizes == {g: len(f) for g, f in groups.items()}


def test_baseline_and_flags_as_of(spark):
    rows = [("n", START + dt.timedelta(hours=i), float(i % 2)) for i in range(240)] + [("n", START + dt.timedelta(hours=240), 50.0)]
    df = spark.createDataFrame(rows, "node_id string, timestamp timestamp_ntz, throughput_gbps double")
    assert anomaly_flags(df).first().anomaly_severity == "HIGH"
    early = START + dt.timedelta(hours=239)
    assert baseline_stats(df, as_of=early).first().mu == pytest.approx(0.5, abs=0.01)
    assert {r.anomaly_severity for r in anomaly_flags(df, as_of=early).collect()} == {"NORMAL"}


def test_event_flags(spark):
    rows = [("n1", START + dt.timedelta(minutes=30 * i)) for i in range(12)] + [("n2", START), (None, START)]
    df = spark.createDataFrame(rows, "node_id string, timestamp timestamp_ntz")
    at = lambda h, m=0: START + dt.timedelta(hours=h, minutes=m)
    events = [
        ("n1", at(1), at(2, 15), "maintenance"), ("n1", at(2), at(3), "maintenance"), ("n1", at(1), at(1, 1), "geo"),
        ("n1", at(4), at(4), "geo"), ("n2", at(0), at(0, 1), "other"), ("n2", at(0), at(99), "geo"),
    ]
    ev = spark.createDataFrame(events, "node_id string, start timestamp_ntz, end timestamp_ntz, kind string")
    out = event_flags(df, ev)
    assert out.count() == df.count()
    busy = out.filter("node_id = 'n1' AND maintenance_flag = 1").orderBy("timestamp").collect()
    assert [r.timestamp for r in busy] == [at(1), at(1, 30), at(2), at(2, 30)]
    assert out.filter("geo_event_flag = 1").count() == 2
    assert event_flags(df).agg(F.sum("geo_event_flag") + F.sum("maintenance_flag")).first()[0] == 0
    merged = merge_intervals(ev.filter("kind = 'maintenance'"), ["node_id", "kind"]).collect()
    assert [(r.start, r.end) for r in merged] == [(at(1), at(3))]


def test_capacity_and_exog(spark):
    df = spark.createDataFrame([("TKY-DC4",), ("X",)], "site string")
    assert [r.capacity_gbps for r in with_capacity(df).orderBy("site").collect()] == [70, 75]
    own = spark.createDataFrame([("X", 9)], "site string, capacity_gbps int")
    assert [r.capacity_gbps for r in with_capacity(df, own).orderBy("site").collect()] == [75, 9]
    rows = [("n", 1.0, 10), ("n", 3.0, 10), (None, 1.0, 5)]
    got = add_exog(spark.createDataFrame(rows, "node_id string, cdn_requests_k double, dns_qps int")).collect()
    assert len(got) == 3
    assert sorted(round(r.cdn_req_norm, 6) for r in got if r.node_id) == [-0.707107, 0.707107]


# ---- forecasts --------------------------------------------------------------------------


def weeks(spark, n=5, sites=("A",), noise=0.0):
    rows = [
        (s, START + dt.timedelta(hours=i), 20.0 + i % 24 + (i % 168) / 24 + noise * ((i * 7919) % 13))
        for s in sites
        for i in range(n * 168)
    ]
    return spark.createDataFrame(rows, "site string, timestamp timestamp_ntz, total_gbps double")


@pytest.mark.parametrize("method", ["naive_168", "hour_of_week", "blend"])
def test_weekly_pattern_is_forecast_exactly(spark, method):
    df = weeks(spark)
    fc = forecast.forecast(df, method=method).orderBy("horizon_hours").collect()
    assert len(fc) == 168 and fc[0].timestamp == START + dt.timedelta(hours=5 * 168)
    if method != "blend":
        assert [round(r.forecast_gbps, 6) for r in fc] == [round(20 + i % 24 + i / 24, 6) for i in range(168)]
    assert all(5 <= r.forecast_utilization_pct <= 95 for r in fc)


def test_naive_day_reaches_back_whole_days(spark):
    fc = forecast.forecast(weeks(spark), method="naive_24", steps=50).orderBy("horizon_hours").collect()
    last_day = [20 + i % 24 + (i % 168) / 24 for i in range(5 * 168 - 24, 5 * 168)]
    assert [round(r.forecast_gbps, 6) for r in fc] == [round(last_day[i % 24], 6) for i in range(50)]


def test_capacity_bounds(spark):
    df = weeks(spark).withColumn("total_gbps", F.when(F.hour("timestamp") < 12, 0.0).otherwise(500.0))
    got = {r.forecast_gbps for r in forecast.forecast(df).collect()}
    assert got == {0.05 * 75, 0.95 * 75}


def test_interval(spark):
    fc = spark.createDataFrame(
        [("A", 1, 50.0, 66.666), ("A", 11, 50.0, 1.0), ("B", 1, 1.0, 1.0), ("C", 1, 1.0, 1.0)],
        "site string, horizon_hours int, forecast_gbps double, forecast_utilization_pct double",
    )
    errors = spark.createDataFrame([("A", 2.0), ("B", 2.0)], "site string, rmse double")
    got = {(r.site, r.horizon_hours): r for r in forecast.add_interval(fc, errors).collect()}
    assert (got["A", 1].lower_ci, got["A", 1].upper_ci) == (46.08, 53.92)
    assert got["A", 11].upper_ci == pytest.approx(54.626) and got["A", 1].forecast_utilization_pct == 66.67
    assert got["B", 1].lower_ci == 0 and got["C", 1].lower_ci is None
    wide = forecast.add_interval(fc, errors, confidence=0.90, digits=False).filter("site = 'A' AND horizon_hours = 1").first()
    assert wide.upper_ci == pytest.approx(53.29)
    ordered = forecast.add_interval(fc, errors).filter("lower_ci > forecast_gbps OR upper_ci < forecast_gbps")
    assert ordered.count() == 0


def test_training_window_guards(spark):
    df = weeks(spark, 1).unionByName(weeks(spark, 1, ("B",)).limit(20))
    with pytest.raises(ValueError, match="B"):
        forecast.training_window(df)
    kept = forecast.training_window(df, strict=False)
    assert {r.site for r in kept.select("site").distinct().collect()} == {"A"}
    assert forecast.training_window(weeks(spark, 6)).count() == 4 * 168


def test_backtest_and_selection(spark):
    df = weeks(spark, 6, noise=0.3)
    told = forecast.backtest(df)
    got = {r.method: r for r in told.collect()}
    y = [20.0 + i % 24 + (i % 168) / 24 + 0.3 * ((i * 7919) % 13) for i in range(6 * 168)]
    errors = [y[i] - y[i - 168] for i in range(168, len(y))]
    assert got["naive_168"].n_obs == len(errors)
    assert got["naive_168"].rmse == pytest.approx((sum(e * e for e in errors) / len(errors)) ** 0.5)
    assert got["naive_168"].mape == pytest.approx(100 * sum(abs(e) / y[i + 168] for i, e in enumerate(errors)) / len(errors))
    best = min(got.values(), key=lambda r: r.rmse).method
    assert forecast.select_model(told, "rmse").first().method == best
    row = forecast.model_diagnostics(told, "rmse").first()
    assert row.method == best and row.training_rmse == round(got[best].rmse, 3)
    with pytest.raises(ValueError):
        forecast.select_model(told, "luck")


def test_backtest_uses_only_older_rows(spark):
    df = weeks(spark, 3)
    far = forecast.predictions(df, ahead=30).filter(F.col("timestamp") == START + dt.timedelta(hours=400)).first()
    assert far.naive_24 == pytest.approx(20 + (400 - 48) % 24 + (400 - 48) % 168 / 24)


def test_site_forecast(spark):
    fc = forecast.forecast(weeks(spark))
    assert [r.horizon_hours for r in forecast.site_forecast(fc, "A", 6).collect()] == [1, 2, 3, 4, 5, 6]
    with pytest.raises(ValueError, match="unknown"):
        forecast.site_forecast(fc, "Z")
    with pytest.raises(ValueError):
        forecast.site_forecast(fc, "A", 169)
    with pytest.raises(ValueError):
        forecast.horizon(fc, START, 0)


def test_fourier_model_per_site(spark):
    df = weeks(spark, 4, ("A", "B"))
    fc = forecast.forecast_by_site(df)
    assert fc.groupBy("site").count().collect() and fc.count() == 336
    assert fc.agg(F.max("rmse")).first()[0] < 6
    mine = forecast.forecast_by_site(df, lambda p: p.head(1)[["site"]], "site string")
    assert sorted(r.site for r in mine.collect()) == ["A", "B"]


def test_residuals_and_headroom(spark):
    df = weeks(spark, 5)
    fc = forecast.forecast(df, as_of=START + dt.timedelta(hours=4 * 168))
    res = forecast.residuals(df, fc)
    assert res.count() == 168 and res.agg(F.max(F.abs("residual"))).first()[0] < 1e-9
    row = reports.peak_and_headroom(fc).first()
    assert row.peak_gbps == pytest.approx(20 + 23 + 167 / 24) and row.min_headroom_gbps == pytest.approx(75 - row.peak_gbps)
    assert row.peak_hour == START + dt.timedelta(hours=5 * 168 - 1)


def test_an_event_without_an_end_goes_on(spark):
    from fluxgauge.operators.joins import event_flags

    ticks = spark.sql(
        "SELECT 'n' AS node_id, TIMESTAMP_NTZ'2024-01-01 00:30:00' + make_dt_interval(0, h) AS timestamp FROM range(4) t(h)"
    )
    events = spark.sql(
        "SELECT 'n' AS node_id, TIMESTAMP_NTZ'2024-01-01 01:00:00' AS start, CAST(NULL AS TIMESTAMP_NTZ) AS end, 'geo' AS kind"
    )
    got = {r.timestamp.hour: r.geo_event_flag for r in event_flags(ticks, events).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1}


def test_long_events_cost_a_row_per_day(spark):
    rows = [("n", dt.datetime(2014, 1, 1, 7, 20), dt.datetime(2024, 1, 1, 9, 45)), ("n", dt.datetime(2015, 1, 1), dt.datetime(2016, 1, 1))]
    ev = spark.createDataFrame(rows, "node_id string, start timestamp_ntz, end timestamp_ntz")
    days, pieces = interval_index(ev, ["node_id"])
    assert days.count() == 3651  # 2 January 2014 to 31 December 2023
    assert pieces.count() == 17 + 10  # hours 7 to 23 of the first day, 0 to 9 of the last


def test_event_flags_equal_a_plain_range_check(spark):
    import random

    rnd = random.Random(5)
    minute = lambda n: START + dt.timedelta(minutes=n)
    span = 6 * 1440
    events = []
    for _ in range(60):
        begin = rnd.choice([rnd.randrange(span), 60 * rnd.randrange(144), 1440 * rnd.randrange(6)])
        length = rnd.choice([0, 1, rnd.randrange(90), 60 * rnd.randrange(30), 1440 * rnd.randrange(3), -5])
        events.append((rnd.choice("abc"), minute(begin), minute(begin + length), rnd.choice(["geo", "maintenance"])))
    events += [(None, minute(0), minute(99), "geo"), ("a", None, minute(99), "geo"), ("b", minute(9), minute(99), None)]
    ticks = [(rnd.choice("abcd"), minute(rnd.choice([rnd.randrange(span), 60 * rnd.randrange(144)]))) for _ in range(800)]
    ticks += [(None, minute(5)), ("a", None)]
    df = spark.createDataFrame(ticks, "node_id string, timestamp timestamp_ntz")
    ev = spark.createDataFrame(events, "node_id string, start timestamp_ntz, end timestamp_ntz, kind string")
    got = sorted(
        (str(r.node_id), str(r.timestamp), r.geo_event_flag, r.maintenance_flag) for r in event_flags(df, ev).collect()
    )

    def covered(node, at, kind):
        return int(any(
            node is not None and at is not None and n == node and k == kind and s is not None and s <= at < e
            for n, s, e, k in events
        ))

    assert got == sorted((str(n), str(t), covered(n, t, "geo"), covered(n, t, "maintenance")) for n, t in ticks)


def test_text_is_read_from_the_oldest_mark_on(spark):
    rows = [("a", START + dt.timedelta(hours=h), float(h), "old" if h == 3 else None) for h in range(9)]
    rows += [("b", START + dt.timedelta(hours=h), None, f"b{h}") for h in range(9)] + [("c", START, 1.0, None)]
    df = spark.createDataFrame(rows, "site string, timestamp timestamp_ntz, v double, note string")
    got = {r.site: (r.v, r.note) for r in reports.current_kpis(df).collect()}
    assert got == {"a": (8.0, "old"), "b": (None, "b8"), "c": (1.0, None)}
