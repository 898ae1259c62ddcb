"""Hand-computed values of the feature operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from fluxgauge.operators.anomaly import add_anomaly, classify_anomaly, ensemble, severity
from fluxgauge.operators.cross_site import add_cross_site, add_mean_of_others, add_correlation
from fluxgauge.operators.kpis import add_kpis
from fluxgauge.operators.lags import add_lags, add_time_lags
from fluxgauge.operators.rolling import (
    add_ewm,
    add_general_ewm,
    add_moments,
    add_quantiles,
    add_rolling,
    add_short_rolling,
)
from fluxgauge.operators.series import SITE_SERIES, Series
from fluxgauge.operators.temporal import add_temporal
from tests.conftest import at_last


def near(value):
    return pytest.approx(value, abs=1e-8)


def test_ramp(spark, hours):
    df = add_anomaly(add_rolling(add_lags(hours(spark, [float(i) for i in range(1, 201)]))))
    row = at_last(
        df, "lag_24h", "diff_24", "roll_mean_3h", "roll_std_3h", "zscore_1h", "roll_mean_24h",
        "roll_std_24h", "roll_max_24h", "roll_min_24h", "zscore_24h", "roll_mean_168h", "iqr_flag_24h",
    )
    assert list(row) == [
        176, 24, 199, near(1), near(1), 188.5, near(math.sqrt(50)), 200, 177, near(1.626345597), 116.5, 0,
    ]


def test_ramp_differences_are_constant(spark, hours):
    df = add_lags(hours(spark, [float(i) for i in range(60)]))
    assert {r[0] for r in df.select("diff_24").collect()} == {None, 24.0}


def test_step(spark, hours):
    df = hours(spark, [10.0] * 18 + [100.0] * 6)
    df = add_quantiles(add_anomaly(add_rolling(df)))
    row = at_last(
        df, "roll_mean_24h", "roll_q25_24h", "roll_q75_24h", "iqr_flag_24h", "sustained_high_flag",
        "roll_std_3h", "zscore_1h", "sudden_spike_flag", "zscore_24h",
    )
    assert list(row) == [32.5, 10, 32.5, 1, 1, 0, None, 0, near(1.695582496)]


def test_short_z_is_bounded_with_own_row_and_fires_without(spark, hours):
    values = [10.0 + (i % 3) * 0.1 for i in range(40)] + [500.0]
    own = at_last(add_anomaly(hours(spark, values)), "zscore_1h", "sudden_spike_flag")
    assert own[0] <= 1.1548 and own[1] == 0
    prior = add_anomaly(hours(spark, values), baseline="exclude_current", spike_rows=24)
    assert at_last(prior, "sudden_spike_flag")[0] == 1


def test_history_requirements(spark, hours):
    df = hours(spark, [float(i % 7) for i in range(30)])
    strict = add_rolling(df).orderBy("timestamp").collect()
    assert strict[22].roll_mean_168h is None and strict[23].roll_mean_168h is not None
    assert add_rolling(df, min_rows_week=1).orderBy("timestamp").first().roll_mean_168h == 0.0
    flags = add_anomaly(df).orderBy("timestamp").collect()
    assert flags[4].zscore_24h is None and flags[5].zscore_24h is not None


def test_floor_replaces_zero_divisors(spark, hours):
    df = hours(spark, [5.0] * 10)
    assert at_last(add_anomaly(df), "zscore_24h")[0] is None
    assert at_last(add_anomaly(df, floor=0.001), "zscore_24h")[0] == 0.0


def kpi_row(spark, **given):
    base = dict(
        total_gbps=50.0, lag_24h=40.0, roll_max_24h=60.0, roll_mean_24h=30.0, utilization_pct=50.0,
        capacity_gbps=100, latency_ms=50.0, packet_loss_pct=1.0, jitter_ms=10.0,
    )
    base.update(given)
    schema = ", ".join(f"{k} {'int' if k == 'capacity_gbps' else 'double'}" for k in base)
    return add_kpis(spark.createDataFrame([tuple(base.values())], schema)).first()


def test_kpis(spark):
    row = kpi_row(spark)
    assert row.quality_score == 65 and row.bandwidth_headroom_pct == 50
    assert row.traffic_intensity_index == 0.5 and row.efficiency_ratio == 1.0
    assert row.traffic_growth_rate == 0.25 and row.peak_to_avg_ratio == 2.0
    assert kpi_row(spark, latency_ms=500.0, packet_loss_pct=5.0, jitter_ms=0.0).quality_score == 0
    gone = kpi_row(spark, latency_ms=None, lag_24h=0.0, roll_mean_24h=0.0)
    assert (gone.quality_score, gone.efficiency_ratio, gone.traffic_growth_rate, gone.peak_to_avg_ratio) == (
        None, None, None, None,
    )
    assert kpi_row(spark, latency_ms=0.2).efficiency_ratio == 50.0


@pytest.mark.parametrize("used,risk", [(80.0, "MEDIUM"), (80.01, "HIGH"), (65.0, "LOW"), (None, "LOW")])
def test_congestion_risk(spark, used, risk):
    assert kpi_row(spark, utilization_pct=used).congestion_risk == risk


def test_ewm(spark, hours):
    assert at_last(add_ewm(hours(spark, [1.0, 2, 3, 4, 5]), SITE_SERIES), "ewm_30pct")[0] == near(3.676682692)
    assert at_last(add_ewm(hours(spark, [1.0, 2, 3, 4]), SITE_SERIES), "ewm_30pct")[0] is None
    two = add_general_ewm(hours(spark, [1.0, 2.0]), SITE_SERIES, 0.5, 4)
    assert at_last(two, "ewm")[0] == near((0.5 * 2 + 0.25 * 1) / 0.75)


def test_moments_and_short_frames(spark, hours):
    df = add_short_rolling(add_moments(hours(spark, [1.0, 1, 1, 5]), SITE_SERIES, 4), SITE_SERIES, 1)
    row = at_last(df, "skewness_1h", "kurtosis_1h", "rolling_mean_1h", "rolling_std_1h", "rolling_max_24h")
    assert list(row) == [near(1.154700538), near(-0.666666667), 5, None, 5]


def test_calendar(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-07 10:00:00' AS timestamp")
    row = add_temporal(df, with_holiday_flag=True).first()
    assert (row.day_of_week, row.week_of_year, row.is_weekend, row.is_business_hour) == (6, 1, 1, 0)
    assert (row.is_peak_hour, row.is_month_end, row.is_quarter_end, row.is_holiday) == (1, 0, 0, 0)
    assert row.hour_sin == near(math.sin(2 * math.pi * 10 / 24))
    assert add_temporal(df, dow="sunday0").first().day_of_week == 0
    christmas = spark.sql("SELECT TIMESTAMP_NTZ'2024-12-25 10:00:00' AS timestamp")
    assert add_temporal(christmas, with_holiday_flag=True).first().is_holiday == 1
    own = spark.sql("SELECT DATE'2024-01-07' AS holiday UNION ALL SELECT DATE'2024-01-07'")
    assert [r.is_holiday for r in add_temporal(df, holidays=own).collect()] == [1]
    with pytest.raises(ValueError):
        add_temporal(df, dow="tuesday0")


def hour_of_sites(spark, used, at=dt.datetime(2024, 1, 1, 5)):
    rows = [(f"s{i}", at, u) for i, u in enumerate(used)]
    return spark.createDataFrame(rows, "site string, timestamp timestamp_ntz, utilization_pct double")


@pytest.mark.parametrize("spread", [True, False])
def test_cross_site(spark, spread):
    df = hour_of_sites(spark, [90.0, 80.0, 80.0, 50.0, 20.0])
    rows = add_cross_site(df, spread=spread).orderBy("site").collect()
    assert [r.site_rank_current_hour for r in rows] == [1, 2, 2, 4, 5]
    assert [r.site_relative_to_avg for r in rows] == [1.40625, 1.25, 1.25, 0.78125, 0.3125]
    assert {round(r.cross_site_stddev, 9) for r in rows} == {28.809720582}


def test_spread_ranks_equal_window_ranks(spark):
    used = [None, 0.0, 100.0, 130.0, -4.0, 55.1, 55.2, 55.1, None, 0.3, 100.0, 99.99]
    df = hour_of_sites(spark, used).unionByName(hour_of_sites(spark, used[:5], dt.datetime(2024, 1, 1, 6)))
    columns = ["site", "timestamp", "site_rank_current_hour", F.round("site_relative_to_avg", 9)]
    a, b = (add_cross_site(df, spread=s).select(columns) for s in (True, False))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and a.count() == 17


def test_mean_of_others_and_correlation(spark):
    df = hour_of_sites(spark, [90.0, 30.0, None])
    rows = add_mean_of_others(df).orderBy("site").collect()
    assert [r.mean_of_others for r in rows] == [30.0, 90.0, 60.0]
    times = [dt.datetime(2024, 1, 1, h) for h in range(5)]
    rows = [("A", t, float(i), float(2 * i + 1)) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "site string, timestamp timestamp_ntz, utilization_pct double, mean_of_others double")
    assert at_last(add_correlation(df), "cross_site_correlation_index")[0] == near(1.0)
    flat = df.withColumn("utilization_pct", F.lit(5.0))
    assert at_last(add_correlation(flat), "cross_site_correlation_index")[0] is None


def test_time_lag_crosses_gaps(spark, hours):
    df = hours(spark, [1.0, 2, 3, 4]).filter(F.hour("timestamp") != 2)
    row = at_last(add_time_lags(add_lags(df, lags=(1,), diffs=(), compare=False), hours=(1, 2)), "lag_1h", "time_lag_1h", "time_lag_2h")
    assert list(row) == [2, None, 2]


@pytest.mark.parametrize("x,expected", [(3.6, "HIGH"), (3.5, "MEDIUM"), (2.5, "NORMAL"), (None, "NORMAL")])
def test_severity(spark, x, expected):
    df = spark.createDataFrame([(x, 0.0, 1.0 - 1e-9)], "throughput_gbps double, mu double, sigma double")
    assert severity(df).first().anomaly_severity == expected


def test_ensemble_votes(spark):
    df = spark.createDataFrame([(4.0, 1, 0), (None, 1, 0)], "zscore_24h double, iqr_flag_24h int, sustained_high_flag int")
    assert [tuple(r)[-2:] for r in ensemble(df).collect()] == [(2, 1), (1, 0)]


def test_typed_anomalies(spark):
    used = [40.0] * 24 + [75.0, 5.0, 41.0]
    peers = [8] * 26 + [6]
    start = dt.datetime(2024, 1, 1)
    rows = [("A", start + dt.timedelta(hours=i), u, p) for i, (u, p) in enumerate(zip(used, peers))]
    df = spark.createDataFrame(rows, "site string, timestamp timestamp_ntz, utilization_pct double, bgp_peers_up int")
    kinds = [r.detected_type for r in classify_anomaly(df, Series(value="utilization_pct")).orderBy("timestamp").collect()]
    assert kinds[24:] == ["ddos", "maintenance", "bgp_flap"] and set(kinds[:24]) == {None}


@pytest.mark.parametrize("spread", [True, False])
def test_a_silent_site_leaves_the_mean_alone(spark, spread):
    from fluxgauge.operators.spine import densify
    from fluxgauge.plans.features import HOURLY_FILL

    at = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [("a", at(0), 40.0), ("a", at(1), 40.0), ("b", at(0), 60.0), ("b", at(1), 60.0), ("c", at(0), 50.0)]
    df = spark.createDataFrame(rows, "site string, timestamp timestamp_ntz, utilization_pct double")
    dense = densify(df, fill={c: v for c, v in HOURLY_FILL.items() if c in df.columns})
    got = {(r.site, r.timestamp.hour): r for r in add_cross_site(dense, spread=spread, others=True).collect()}
    assert got["a", 1].site_relative_to_avg == near(0.8) and got["a", 1].mean_of_others == near(60.0)
    silent = got["c", 1]
    assert silent.utilization_pct is None and silent.site_relative_to_avg is None
    assert silent.site_rank_current_hour == 3 and silent.mean_of_others == near(50.0)


def test_rounding_noise_has_no_correlation(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [("a", at(h), float(h), 100.0 if h % 2 else math.nextafter(100.0, 0)) for h in range(8)]
    df = spark.createDataFrame(rows, "site string, timestamp timestamp_ntz, utilization_pct double, mean_of_others double")
    assert {r[0] for r in add_correlation(df).select("cross_site_correlation_index").collect()} == {None}
