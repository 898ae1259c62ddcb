"""Chunked windows equal plain ones; grids, duplicates and spectral runs."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxgauge.functions.spectral import dominant_bin, peak_bins, register_functions
from fluxgauge.operators.anomaly import add_anomaly
from fluxgauge.operators.lags import add_lags
from fluxgauge.operators.rolling import add_ewm, add_rolling
from fluxgauge.operators.series import RowChunks, Series, TimeChunks, WholeSeries, dedupe_series
from fluxgauge.operators.spectral import add_fft_peaks, add_spectral, join_spectral
from fluxgauge.operators.spine import densify

START = dt.datetime(2024, 1, 1)


def build(df, s):
    df = add_anomaly(add_rolling(add_lags(df, s), s, 1), s, 1, 1)
    return add_ewm(df, s)


def rounded(df):
    doubles = [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, 7) for c in doubles})


def same(a, b):
    a, b = rounded(a), rounded(b.select(a.columns))
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def table(spark, rows):
    return spark.createDataFrame(rows, "site string, timestamp timestamp_ntz, total_gbps double")


def waves(n, keep=lambda i: True, site="A", step=1):
    return [
        (site, START + dt.timedelta(hours=i * step), float((i * 37) % 101))
        for i in range(n)
        if keep(i)
    ]


def test_time_chunks_equal_plain_windows(spark):
    df = table(spark, waves(1500) + waves(700, site="B"))
    chunks = TimeChunks(span=336)
    out = chunks.run(df, Series(), build)
    assert same(WholeSeries().run(df, Series(), build), out)
    assert out.count() == 2200


@pytest.mark.parametrize("rows,seconds", [(168, 3600), (200, 86_400), (400, 7 * 86_400), (100_000, 60)])
def test_row_chunks_equal_plain_windows_with_gaps(spark, rows, seconds):
    """Gaps of days, a dense stretch, a short second series and NULL keys and values."""
    sparse = waves(900, lambda i: i % 7 and not 300 < i < 420)
    dense = [("A", START + dt.timedelta(days=60, seconds=i), float(i % 53)) for i in range(1200)]
    odd = [("B", START, None), (None, START, 1.0), (None, START + dt.timedelta(hours=1), 2.0)]
    df = table(spark, sparse + dense + odd)
    out = RowChunks(rows=rows, bucket_seconds=seconds).run(df, Series(), build)
    assert same(WholeSeries().run(df, Series(), build), out)


def test_row_chunks_split_one_key_over_many_groups(spark):
    df = table(spark, waves(3000))
    chunks = RowChunks(rows=300, bucket_seconds=86_400)
    seen = {}

    def spy(d, s):
        sizes = d.groupBy(*s.keys).count().agg(F.count("*"), F.max("count")).first()
        seen["groups"], seen["largest"] = sizes[0], sizes[1]
        return add_lags(d, s, (1,), (), False)

    assert chunks.run(df, Series(), spy).count() == 3000
    assert seen["groups"] >= 9 and seen["largest"] <= 300 + 168 + 2 * 24


def test_chunk_sizes_must_cover_the_lookback(spark):
    df = table(spark, waves(5))
    for chunks in (TimeChunks(span=24), RowChunks(rows=24)):
        with pytest.raises(ValueError):
            chunks.run(df, Series(), build)


def test_dedupe_keeps_the_smallest_row(spark):
    df = table(spark, [("A", START, 3.0), ("A", START, 1.0), ("A", START, 1.0), ("B", START, None), ("B", START, 0.0)])
    assert sorted(dedupe_series(df).collect()) == sorted(
        [("A", START, 1.0), ("B", START, None)]
    )


def test_densify(spark):
    df = table(spark, [("A", START, 1.0), ("A", START + dt.timedelta(hours=3), 4.0), ("B", START + dt.timedelta(hours=1), 2.0)])
    full = densify(df, fill={"total_gbps": 0.0}).orderBy("site", "timestamp").collect()
    assert [r.total_gbps for r in full] == [1, 0, 0, 4, 0, 2, 0, 0]
    carried = densify(df, forward=("total_gbps",)).orderBy("site", "timestamp").collect()
    assert [r.total_gbps for r in carried] == [1, 1, 1, 4, None, 2, 2, 2]
    ranged = densify(df, start="2024-01-01 22:00:00", end="2024-01-03 01:00:00").filter("site = 'A'")
    assert ranged.count() == 27
    assert ranged.agg(F.max("timestamp")).first()[0] == dt.datetime(2024, 1, 3, 0)


def brute(values, n):
    out = []
    for i in range(len(values)):
        run = values[max(0, i - n + 1) : i + 1]
        if len(run) < n or np.isnan(run).any():
            out.append(None)
            continue
        power = np.abs(np.fft.rfft(run - np.mean(run)))[1:] ** 2
        out.append(float(np.argmax(power) + 1))
    return out


def test_fft_peaks_in_chunks_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    t = np.arange(700)
    values = 10 + np.sin(2 * np.pi * t / 6) + rng.normal(0, 0.8, 700)
    values[350] = np.nan
    rows = [("A", START + dt.timedelta(hours=int(i)), None if np.isnan(v) else float(v)) for i, v in enumerate(values)]
    out = RowChunks(rows=200, bucket_seconds=86_400).run(table(spark, rows), Series(), add_fft_peaks)
    got = out.orderBy("timestamp").toPandas()
    for n in (24, 168):
        mine = [None if np.isnan(v) else v for v in got[f"fft_peak_{n}"]]
        assert mine == brute(values, n)


def test_known_periods_and_flat_runs():
    t = np.arange(96)
    assert peak_bins(np.sin(2 * np.pi * t / 24), 96)[-1] == 4
    assert peak_bins(np.full(30, 7.7), 24)[-1] == 1
    assert np.isnan(peak_bins(np.arange(10.0), 24)).all()


def test_fft_from_sql(spark):
    register_functions(spark)
    df = table(spark, waves(200))
    over = "OVER (PARTITION BY site ORDER BY timestamp ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"
    df.createOrReplaceTempView("ticks")
    sql = spark.sql(f"SELECT timestamp, fft_dominant_bin(collect_list(total_gbps) {over}, 24) AS p FROM ticks")
    plain = add_fft_peaks(df, Series(), (24,)).select("timestamp", F.col("fft_peak_24").alias("p"))
    assert sql.exceptAll(plain).count() == 0 and sql.filter("p IS NULL").count() == 23


def test_spectral_proxies(spark):
    row = add_spectral(table(spark, waves(30)), Series()).orderBy(F.desc("timestamp")).first()
    values = [float((i * 37) % 101) for i in range(30)]
    day = np.array(values[-24:])
    assert row.periodogram_power == pytest.approx(day.mean() ** 2)
    assert row.periodogram_power_168 == pytest.approx(np.mean(values) ** 2)
    assert row.spectral_entropy == pytest.approx(day.std(ddof=1) / np.mean(values))


def test_row_chunks_cut_crowded_buckets(spark):
    """A burst of 2,000 rows within two seconds of one hour, and 300 at one instant."""
    calm = waves(400, step=3)
    burst = [("A", START + dt.timedelta(hours=500, milliseconds=i), float(i % 41)) for i in range(2000)]
    instant = [("A", START + dt.timedelta(hours=700), float(i)) for i in range(300)]
    df = table(spark, calm + burst + instant).withColumn("tie", F.col("total_gbps"))
    series = Series(ties=("tie",))
    chunks = RowChunks(rows=250, bucket_seconds=3600)
    largest = []

    def spy(d, s):
        largest.append(d.groupBy(*s.keys).count().agg(F.max("count")).first()[0])
        return build(d, s)

    assert same(WholeSeries().run(df, series, build), chunks.run(df, series, spy))
    assert largest[0] <= 250 + 300 + 2 * 168


def test_joined_spectral_equals_same_pass(spark):
    df = table(spark, waves(60))
    apart = add_spectral(df, Series()).drop("total_gbps")
    assert same(join_spectral(df, apart, Series()), add_spectral(df, Series()))


def test_native_dominant_bin_equals_fft(spark):
    df = table(spark, waves(80) + [("B", START + dt.timedelta(hours=i), 5.5) for i in range(30)])
    w = Series().frame(24)
    native = df.withColumn("runs", F.collect_list("total_gbps").over(w)).select(
        "site", "timestamp", dominant_bin(F.col("runs"), 24).alias("p")
    )
    plain = add_fft_peaks(df, Series(), (24,)).select("site", "timestamp", F.col("fft_peak_24").alias("p"))
    assert native.exceptAll(plain).count() == 0 and native.count() == 110


def test_densify_keeps_stamps_within_the_hour_and_rows_without_a_key(spark):
    rows = [("A", "2024-01-01 03:30:00", 9.0), ("A", "2024-01-01 05:00:00", 1.0), (None, "2024-01-01 04:00:00", 7.0)]
    df = spark.createDataFrame(rows, "site string, timestamp string, total_gbps double")
    df = df.withColumn("timestamp", df.timestamp.cast("timestamp_ntz"))
    got = {(r.site, r.timestamp.hour): r.total_gbps for r in densify(df).collect()}
    assert got == {("A", 3): 9.0, ("A", 4): None, ("A", 5): 1.0, (None, 3): None, (None, 4): 7.0, (None, 5): None}
