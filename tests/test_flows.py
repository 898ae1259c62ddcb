"""Raw flow cleaning, aggregation and the tables derived from it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fluxgauge.functions.numeric import to_nonneg
from fluxgauge.functions.protocol import PROTOCOL_NAMES, map_protocol, with_traffic_type
from fluxgauge.operators import aggregate, flows
from fluxgauge.operators.spine import expected_profile
from fluxgauge.plans.features import expected_from_flows, hourly_from_flows
from fluxgauge.schemas import FLOW, TRAFFIC_TYPES
from fluxgauge.sources.readers import read_flows


@pytest.mark.parametrize(
    "name,kind",
    [
        (" https ", "https"), ("HTTP", "http"), ("HTTP_CONNECT", "http"), ("TLS_HTTP", "https"),
        ("BitTorrent", "vpn"), ("TeamSpeak", "video"), ("WebRTC_x", "video"), ("Live Stream", "video"),
        ("gre_tunnel", "vpn"), ("MSSQL", "db"), ("Opera Browser", "http"), ("NTP", "https"), (None, "https"),
        ("\tDNS\n", "dns"), ("mongo-router", "db"), ("dbx", "db"), ("storage", "vpn"),
    ],
)
def test_protocols(spark, name, kind):
    df = spark.createDataFrame([(name,)], "p string")
    assert df.select(map_protocol(F.col("p"))).first()[0] == kind
    assert with_traffic_type(df, F.col("p")).first().traffic_type == kind


def test_protocol_table_is_complete(spark):
    pairs = [(n, k) for k, names in PROTOCOL_NAMES.items() for n in names]
    assert len(pairs) == 54
    df = spark.createDataFrame(pairs, "p string, k string")
    assert df.filter(map_protocol(F.col("p")) != F.col("k")).count() == 0


def test_normalised_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["`Flow ID `", "Fwd.IAT.Mean", " Label"])
    assert flows.normalize_columns(df).columns == ["`flow_id_`", "fwd_iat_mean", "label"]


def test_timestamp_by_name_and_by_look(spark):
    named = spark.createDataFrame([("x", "y")], ["Proto", "StartTime"])
    assert flows.detect_timestamp(named) == "StartTime"
    rows = [("10.0.0.1", "a", None), ("1-2", "b", "12/31"), ("1:2:3:4:5:6", "c", "26/04/2017 11:11:17")]
    looked = spark.createDataFrame(rows, ["address", "tag", "seen"])
    assert flows.detect_timestamp(looked) == "seen"
    assert flows.detect_timestamp(looked.drop("seen")) is None


def test_timestamps_are_day_first(spark):
    rows = [("03/04/2024 05:06:07",), ("3/4/2024 5:06",), ("2024-04-03 05:06:07",), ("13/13/2024",), (None,), ("soon",)]
    df = flows.parse_timestamp(spark.createDataFrame(rows, ["t"]), "t")
    got = [r.raw_timestamp for r in df.collect()]
    assert got == [dt.datetime(2024, 4, 3, 5, 6, 7), dt.datetime(2024, 4, 3, 5, 6), dt.datetime(2024, 4, 3, 5, 6, 7)]


def test_shapes_let_through_what_the_formats_read():
    import re

    shapes = {f: re.compile(flows.shape_of(f)) for f in flows.DAY_FIRST_FORMATS}
    fits = lambda text: [f for f, s in shapes.items() if s.match(text)]
    assert fits("3/4/2024 5:06") == fits("03/04/2024 05:06:07.25") == ["d/M/yyyy H:m[:s][.SSSSSS]"]
    assert fits("2024-04-03T05:06:07") == ["yyyy-M-d'T'H:m[:s][.SSSSSS]"] and fits("2024-4-3") == ["yyyy-M-d"]
    assert fits("26/04/201711:11:17") == [] == fits("soon")


def test_synthetic_timestamps_are_dense(spark):
    df = spark.range(1000, numPartitions=7).filter(F.col("id") % 3 != 0)
    out = flows.synthesize_timestamp(df).orderBy("id").collect()
    start = dt.datetime(2024, 1, 1)
    assert [r.raw_timestamp for r in out] == [start + dt.timedelta(seconds=i) for i in range(666)]


def test_numbers_and_defaults(spark):
    rows = [("1/1/2024 10:30", "100", "x", "5000"), ("1/1/2024 10:40", "-5", "7", None), ("1/1/2024 11:00", "NaN", "2", "-1")]
    df = spark.createDataFrame(rows, ["Timestamp", "TotLen Fwd Pkts", "TotLen.Bwd.Pkts", "Fwd.IAT.Mean"])
    got = flows.clean_flows(df).orderBy("raw_timestamp").collect()
    assert [(r.bytes_fwd, r.bytes_bwd, r.total_bytes, r.latency_raw) for r in got] == [
        (100, 0, 100, 5), (0, 7, 7, 0), (0, 2, 2, 0),
    ]
    assert {r.traffic_type for r in got} == {"https"} and got[0].hour == dt.datetime(2024, 1, 1, 10)
    bare = flows.clean_flows(df.select("Timestamp")).first()
    assert (bare.bytes_fwd, bare.bytes_bwd, bare.latency_raw) == (1000, 300, 10)
    clean = flows.clean_flows(df)
    assert [(f.name, f.dataType) for f in clean.schema] == [(f.name, f.dataType) for f in FLOW]


@pytest.mark.parametrize(
    "text,value",
    [("12", 12), (" 3.5 ", 3.5), ("1e3", 1000), (".5", 0.5), ("1d", 0), ("2f", 0), ("0x1p3", 0), ("-4", 0), ("", 0), (None, 0), ("nan", 0), ("a1", 0)],
)
def test_lenient_numbers(spark, text, value):
    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(to_nonneg(F.col("v"))).first()[0] == value


def test_typed_numbers_stay_numbers(spark):
    df = spark.createDataFrame([("1/1/2024 10:00", 7, 2.5)], ["timestamp", "totlen_fwd_pkts", "totlen_bwd_pkts"])
    assert flows.clean_flows(df).first().total_bytes == 9.5


def test_site_weights(spark):
    df = spark.range(40_000)
    drawn = flows.assign_site(df)
    assert drawn.exceptAll(flows.assign_site(df.repartition(5))).count() == 0
    share = {r.site: r["count"] / 40_000 for r in drawn.groupBy("site").count().collect()}
    for site, wanted in zip(share.keys() and ["NYC-DC1", "LON-DC2", "SYD-DC3", "TKY-DC4", "SFO-DC5"], (0.3, 0.25, 0.18, 0.12, 0.15)):
        assert share[site] == pytest.approx(wanted, abs=0.01)
    exact = flows.assign_site(spark.range(10_000), bucket=F.col("id")).groupBy("site").count().collect()
    assert {r.site: r["count"] for r in exact}["SYD-DC3"] == 1800
    with pytest.raises(ValueError):
        flows.assign_site(df, sites=("a",), weights=(1, 2))


def flow_rows(spark):
    rows = [
        ("s1", "2024-01-01 00:10:00", "https", 10.0, 1.0), ("s1", "2024-01-01 00:20:00", "https", 20.0, 3.0),
        ("s1", "2024-01-01 02:00:00", "dns", 5.0, 2.0), ("s2", "2024-01-01 01:00:00", "db", 65.0, 4.0),
    ]
    df = spark.createDataFrame(rows, "site string, t string, traffic_type string, total_bytes double, latency_raw double")
    return df.withColumn("hour", F.date_trunc("hour", F.col("t").cast("timestamp_ntz")).cast("timestamp_ntz")).drop("t")


def test_hourly_tables_agree(spark):
    one = aggregate.hourly_table(flow_rows(spark))
    parts = aggregate.hourly_table_by_join(flow_rows(spark)).select(one.columns)
    assert one.exceptAll(parts).count() == 0 and parts.count() == one.count() == 3
    first = one.orderBy("site", "hour").first()
    assert (first.https, first.dns, first.vpn, first.total_bytes_hour, first.avg_latency_ms) == (30, 0, 0, 30, 2)


def test_ratios_and_profiles(spark):
    table = aggregate.hourly_table(flow_rows(spark))
    shares = {r.traffic_type: r.ratio for r in aggregate.type_ratios(table).collect()}
    assert shares["https"] == 0.3 and shares["db"] == 0.65 and sum(shares.values()) == pytest.approx(1)
    none = aggregate.type_ratios(table.filter("1 = 0"))
    assert {round(r.ratio, 9) for r in none.collect()} == {round(1 / 6, 9)}
    profile = {r.hod: r.mean_value for r in aggregate.hod_profile(table).collect()}
    assert len(profile) == 24 and profile[0] == 30 and profile[2] == 5 and profile[5] == pytest.approx(100 / 3)
    norm = aggregate.normalize_profile(aggregate.hod_profile(table)).agg(F.max("hod_norm")).first()[0]
    assert norm == 1
    flat = aggregate.normalize_profile(aggregate.hod_profile(table.withColumn("total_bytes_hour", F.lit(0.0))))
    assert {r.hod_norm for r in flat.collect()} == {0.4}


def test_expected_profile(spark):
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    # Mondays 1 and 8 at 5 o'clock, Tuesday 2 at 5, Monday 8 at 6 with an unknown value; no time, no site.
    rows = [
        ("A", at(1, 5), 10.0), ("A", at(8, 5), 20.0), ("A", at(2, 5), 60.0), ("A", at(8, 6), None),
        ("A", None, 99.0), (None, at(1, 5), 7.0),
    ]
    df = spark.createDataFrame(rows, "site string, hour timestamp_ntz, v double")
    out = expected_profile(df, ("v",)).collect()
    got = {(r.site, r.hour): (r.expected_v, r.observed_hours) for r in out}
    assert len(out) == len(got) == 2 * (7 * 24 + 2)
    assert got["A", at(1, 5)] == got["A", at(8, 5)] == (15.0, 2)
    assert got["A", at(2, 5)] == (60.0, 1)
    assert got["A", at(3, 5)] == (30.0, 0)  # no Wednesday seen: the mean of all days at 5
    assert got["A", at(8, 6)] == got["A", at(1, 6)] == (None, 1) and got["A", at(3, 6)] == (None, 0)
    assert got[None, at(8, 5)] == (7.0, 1)
    ahead = expected_profile(df, ("v",), start="2024-02-05 05:00:00", end="2024-02-05 06:00:00").collect()
    assert {(r.site, r.expected_v) for r in ahead} == {("A", 15.0), (None, 7.0)}
    assert expected_profile(df.limit(0), ("v",)).count() == 0


def test_flows_from_csv_to_expected_traffic(spark, tmp_path):
    lines = ["Timestamp,TotLen Fwd Pkts,Fwd.IAT.Mean,ProtocolName,Flow ID"]
    lines += [f"{1 + i % 3:02d}/01/2024 {i % 24:02d}:15:00,{i},1000,YouTube,{i}" for i in range(200)]
    lines += ["broken,1,2,3,4,5,6,7", "no date,1,1,DNS,7"]
    (tmp_path / "flows.csv").write_text("\n".join(lines) + "\n")
    raw = read_flows(spark, str(tmp_path))
    hourly = hourly_from_flows(raw, bucket=F.pmod(F.col("flow_id").cast("bigint") * 7919, F.lit(10_000)))
    assert hourly.count() == 72 * hourly.select("site").distinct().count()
    total = hourly.agg(F.sum("video"), F.sum("total_bytes_hour")).first()
    assert total[0] == total[1] == pytest.approx(sum(range(200)) * 1.3)
    seen = hourly.filter("total_bytes_hour > 0")
    out = expected_from_flows(seen)
    assert out.count() == 72 * seen.select("site").distinct().count()
    # Every hour of week was seen once at most here, so the usual is what was there.
    both = out.filter("observed_hours > 0").join(seen, ["site", "hour"])
    assert both.count() == seen.count()
    assert both.filter("abs(expected_video - video) > 1e-9 OR observed_hours <> 1").count() == 0
    assert read_flows(spark, str(tmp_path), limit=10).count() == 10


def test_latin1_csv(spark, tmp_path):
    (tmp_path / "f.csv").write_bytes("name,v\ncafé,1\n".encode("latin-1"))
    assert read_flows(spark, str(tmp_path), encoding="ISO-8859-1").first()[0] == "café"
