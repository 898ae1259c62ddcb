"""Times in any shape, CSV files of any layout, and hourly grids over irregular stamps."""

import datetime as dt

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from fluxgauge.operators import flows, timestamps
from fluxgauge.operators.spine import densify, fill_forward
from fluxgauge.sources import flow_files
from fluxgauge.sources.readers import read_flows

AT = dt.datetime

TIMES = [
    ("01/02/2024 10:00:00 PM", AT(2024, 2, 1, 22)),
    ("01/02/2024 12:05 am", AT(2024, 2, 1, 0, 5)),
    ("01/02/2024 12:05 p.m.", AT(2024, 2, 1, 12, 5)),
    ("2024-02-01T10:00:00Z", AT(2024, 2, 1, 10)),
    ("2024-02-01T10:00:00+02:00", AT(2024, 2, 1, 8)),
    ("2024-02-01 10:00:00.25 -0330", AT(2024, 2, 1, 13, 30, 0, 250000)),
    ("2024-02-01 10:00 +5", AT(2024, 2, 1, 5)),
    ("2024-02-01 00:30+05:30", AT(2024, 1, 31, 19)),
    ("2024-02-01T10:00:00.123456789", AT(2024, 2, 1, 10, 0, 0, 123456)),
    ("1 Feb 2024 10:00", AT(2024, 2, 1, 10)),
    ("01-Feb-24", AT(2024, 2, 1)),
    ("Thursday, 1st February 2024 10:00 GMT", AT(2024, 2, 1, 10)),
    ("Feb 1, 2024 10:00 AM", AT(2024, 2, 1, 10)),
    ("01/02/24 10:00", AT(2024, 2, 1, 10)),
    ("31/12/69", AT(1969, 12, 31)),
    ("31/12/68", AT(2068, 12, 31)),
    ("  2024/2/1 ", AT(2024, 2, 1)),
    ("1.2.2024 1:2:3", AT(2024, 2, 1, 1, 2, 3)),
    ("29/02/2024", AT(2024, 2, 29)),
    ("29/02/2023", None),
    ("2024-13-01", None),
    ("01/02/2024 13:00 PM", None),
    ("01/02/2024 0:10 AM", None),
    ("01/02/2024 24:00", None),
    ("01/02-2024", None),
    ("1.2.24", None),
    ("10.0.0.1", None),
    ("12:30:00", None),
    ("2024|1|1", None),
    ("2024\x011\x011\x01\x01\x01\x01\x01\x01\x01-\x01\x01\x01\x01", None),
    ("soon", None),
    ("", None),
    (None, None),
]


def texts(spark, values, name="t"):
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, `{name}` string")


def test_every_shape_is_read(spark):
    df = timestamps.with_time(texts(spark, [t for t, _ in TIMES]), "t", "at")
    assert df.columns == ["k", "t", "at"]
    got = {r.k: r.at for r in df.collect()}
    assert [(TIMES[k][0], got[k]) for k in got] == [(TIMES[k][0], TIMES[k][1]) for k in got]


def test_the_column_tells_day_from_month(spark):
    read = lambda values: [r.at for r in timestamps.with_time(texts(spark, values), "t", "at").orderBy("k").collect()]
    assert read(["01/02/2024", "01/13/2024", "02/25/24"]) == [AT(2024, 1, 2), AT(2024, 1, 13), AT(2024, 2, 25)]
    assert read(["01/02/2024", "13/01/2024"]) == [AT(2024, 2, 1), AT(2024, 1, 13)]
    assert read(["01/02/2024", "13/01/2024", "01/13/2024"]) == [AT(2024, 2, 1), AT(2024, 1, 13), None]
    assert read(["01/13/2024", "01/14/2024", "13/01/2024", "2024-02-01"]) == [AT(2024, 1, 13), AT(2024, 1, 14), None, AT(2024, 2, 1)]


def test_votes_count_all_rows(spark):
    rows = [(str(k), "2024-01-01" if k % 2 else "13/01/2024", " " if k % 3 else None) for k in range(50)]
    df = spark.createDataFrame(rows, "n string, t string, `b.c` string")
    got = {(r.column, r.family): (r.n, r.day_first, r.month_first) for r in timestamps.time_votes(df).collect()}
    assert got == {("n", None): (50, 0, 0), ("t", "year first"): (25, 0, 0), ("t", "year last"): (25, 25, 0)}
    assert timestamps.time_votes(df.select(F.lit(1).alias("x"))).collect() == []


def test_a_late_row_decides_as_much_as_an_early_one(spark):
    """The first values look like nothing; most of the column are times."""
    rows = [("x", "?")] * 6 + [("1/2", "2024-01-01 00:00")] * 30
    df = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    assert flows.detect_timestamp(df) == "b"
    assert flows.detect_timestamp(df.limit(10)) is None
    typed = df.withColumn("c", F.current_timestamp())
    assert flows.detect_timestamp(typed) == "c"


def test_rejects_are_counted_and_a_column_may_be_named(spark):
    rows = [("1/2/2024", "3/4/2024", "5"), ("nope", "x", "5"), (None, "x", "6")]
    df = spark.createDataFrame(rows, ["Timestamp", "Other Time", "TotLen Fwd Pkts"])
    seen = Observation()
    assert flows.clean_flows(df, rejects=seen).count() == 1
    assert seen.get == {"rows": 3, "missing": 1, "unreadable": 1}
    named = flows.clean_flows(df, ts_column="other_time").collect()
    assert [r.raw_timestamp for r in named] == [AT(2024, 4, 3)]


def write(folder, name, text, encoding="utf-8"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(text.encode(encoding))


def test_files_of_different_order_give_the_same_rows(spark, tmp_path):
    lines = [(f"{k:02d}/01/2024 00:00:00", str(k), "YouTube") for k in range(1, 20)]
    names = ("Timestamp", "TotLen Fwd Pkts", "ProtocolName")
    for k, order in enumerate([(0, 1, 2), (2, 0, 1), (1, 2, 0)]):
        text = "\n".join(",".join(row[i] for i in order) for row in [names, *lines]) + "\n"
        write(tmp_path / "in", f"{k}.csv", text)
    rows = read_flows(spark, str(tmp_path / "in"))
    clean = flows.clean_flows(rows, bucket=F.lit(1))
    assert clean.groupBy("raw_timestamp", "bytes_fwd", "traffic_type").count().filter("count = 3").count() == 19
    assert len(flow_files.layouts(spark, str(tmp_path / "in"))) == 3


def test_broken_lines_quotes_and_missing_fields(spark, tmp_path):
    write(tmp_path / "in", "a.csv", 'A b,B.c,C\n1,2,3\n4,5\n6,7,8,9\n"x,y",2,"q""r"\n,,\n1,2,3,\n')
    write(tmp_path / "in", "b.csv", "﻿C,A b,A b\nc1,a1,z\nc2,a2,z,zz,yy\n")
    write(tmp_path / "in", "empty.csv", "")
    write(tmp_path / "in", "head.csv", "A b,B.c,C\n")
    path, seen = str(tmp_path / "in"), Observation()
    df = read_flows(spark, path, rejects=seen)
    got = sorted(map(str, (tuple(r) for r in df.select("a_b", "b_c", "c", "a_b_1").collect())))
    want = [("1", "2", "3", None)] * 2 + [("4", "5", None, None), ("x,y", "2", 'q"r', None), (None,) * 4, ("a1", None, "c1", "z")]
    assert got == sorted(map(str, want))
    assert seen.get == {"lines": 8, "rejected": 2}
    assert df.count() == 6 and df.select("c").count() == 6
    lost = {(r.n_columns, r.line) for r in flow_files.rejected_lines(spark, path).collect()}
    assert lost == {(3, "6,7,8,9"), (3, "c2,a2,z,zz,yy")}


def test_latin1_is_tried_per_file(spark, tmp_path):
    write(tmp_path / "in", "a.csv", "name,v\ncafé,1\n", "latin-1")
    write(tmp_path / "in", "b.csv", "name,v\nthé,2\n")
    write(tmp_path / "in", "c.csv", "größe,name\n3,é\n", "latin-1")
    df = read_flows(spark, str(tmp_path / "in"))
    assert sorted((r.name, r.v, r["größe"]) for r in df.collect()) == [("café", "1", None), ("thé", "2", None), ("é", None, "3")]
    assert [g.encoding for g in flow_files.layouts(spark, str(tmp_path / "in"), "ISO-8859-1")] == ["ISO-8859-1"] * 2


def test_no_files_no_rows(spark, tmp_path):
    write(tmp_path / "in", "empty.csv", "")
    assert read_flows(spark, str(tmp_path / "in")).collect() == []
    assert flow_files.rejected_lines(spark, str(tmp_path / "in")).collect() == []


def test_names_of_a_header():
    assert flow_files.column_names('Flow ID, "a,b" ,Flow.ID,,flow id') == ("flow_id", '"a', 'b"', "flow_id_1", "column_4", "flow_id_2")
    assert flow_files.column_names('"a,b",c') == ("a,b", "c")


def stamped(spark, rows):
    rows = [(s, None if t is None else AT(2024, 1, 1) + dt.timedelta(minutes=t), *v) for s, t, *v in rows]
    return spark.createDataFrame(rows, "site string, timestamp timestamp_ntz, x double, n int, tag string")


def test_stamps_within_an_hour_become_one_row(spark):
    df = stamped(spark, [("a", 190, 1.0, 3, "u"), ("a", 230, 2.0, 4, None), ("a", 230, 3.0, 1, "w"), ("a", 300, 5.0, 5, "z"), ("b", 250, 7.0, 2, "v")])
    got = {(r.site, r.timestamp.hour): (r.x, r.n, r.tag) for r in densify(df).collect()}
    assert got == {
        ("a", 3): (3.0, 1, "w"), ("a", 4): (None,) * 3, ("a", 5): (5.0, 5, "z"),
        ("b", 3): (None,) * 3, ("b", 4): (7.0, 2, "v"), ("b", 5): (None,) * 3,
    }
    ways = {"x": "mean", "n": "sum", "tag": "min"}
    out = densify(df, combine=ways)
    assert out.schema == df.schema
    assert {(r.site, r.timestamp.hour): (r.x, r.n, r.tag) for r in out.collect()}["a", 3] == (2.0, 8, "u")
    mean = densify(df, combine={"n": "mean"}).filter("site = 'a'").orderBy("timestamp").first()
    assert (mean.n, mean.x, mean.tag) == (2, 3.0, "w")
    with pytest.raises(ValueError):
        densify(df, combine={"x": "median"})


def test_keys_alone_and_ranges(spark):
    df = stamped(spark, [("a", 10, 1.0, 1, "x"), ("a", 20, 1.0, 1, "x"), ("a", None, 9.0, 9, "y"), (None, 70, 2.0, 2, "z")])
    keys = densify(df.select("site", "timestamp"))
    assert keys.count() == 4 and keys.filter("site IS NULL").count() == 2
    ranged = densify(df, start="2024-01-01 01:00:00", end="2024-01-01 02:00:00")
    assert [(r.site, r.x) for r in ranged.orderBy("site").collect()] == [(None, 2.0), ("a", None)]
    assert densify(df.limit(0)).collect() == []


@pytest.mark.parametrize("span", [1, 5, 24, 1000])
def test_forward_fill_crosses_chunks(spark, span):
    rows = [(s, 60 * h, float(h) if h % 37 == k else None, h if h > 60 else None, None) for k, s in enumerate(("a", None)) for h in range(150)]
    df = stamped(spark, rows)
    got = fill_forward(df, ("x", "n", "tag"), span=span).collect()
    assert len(got) == 300
    for r in got:
        hour = int((r.timestamp - AT(2024, 1, 1)).total_seconds() // 3600)
        first = 0 if r.site == "a" else 1
        assert r.x == (None if hour < first else float((hour - first) // 37 * 37 + first))
        assert r.n == (hour if hour > 60 else None) and r.tag is None
    plan = fill_forward(df, ("x",), span=span)._jdf.queryExecution().optimizedPlan().toString()
    assert all("__chunk" in line.split("windowspecdefinition(")[1].split("ASC")[0] for line in plan.split("\n") if "windowspecdefinition(" in line)


def test_a_table_against_its_schema(spark):
    from pyspark.sql import types as T

    from fluxgauge.sources.readers import conformance, conformed

    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b.c", T.DateType()), T.StructField("gone", T.DoubleType())])
    df = spark.createDataFrame([("1", "2024-01-01", 1), ("x", "2024-13-01", 2), (None, None, None), ("99999999999", "", 3)], "A string, `b.c` string, more int")
    got = {r["column"]: tuple(r)[1:] for r in conformance(df, schema).collect()}
    assert got == {
        "a": ("int", "string", 1, 2), "b.c": ("date", "string", 1, 2), "gone": ("double", None, 4, 0), "more": (None, "int", 1, 0),
    }
    rows = conformed(df, schema)
    assert rows.schema == schema and sorted(str(r.a) for r in rows.collect()) == ["1", "None", "None", "None"]
    assert {r["column"]: (r.nulls, r.violations) for r in conformance(df.limit(0), schema).collect()}["a"] == (0, 0)


def test_ticks_are_pruned_by_node_and_date(spark, tmp_path):
    from fluxgauge.sources.readers import read_ticks
    from fluxgauge.sources.writers import write_features

    ticks = spark.sql(
        "SELECT concat('node-', h % 3) AS node_id, TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(0, CAST(h AS int)) AS timestamp FROM range(240) t(h)"
    )
    write_features(ticks.selectExpr("*", "to_date(timestamp) AS date"), str(tmp_path / "t"), ("node_id", "date"), report=False)
    got = read_ticks(spark, str(tmp_path / "t"), "2024-01-05 06:00:00", "2024-01-06", ["node-2"], lookback_days=1)
    want = ticks.filter("node_id = 'node-2' AND timestamp >= '2024-01-04 06:00:00' AND timestamp < '2024-01-06 00:00:00'")
    assert got.count() == want.count() == 14
    scan = got._jdf.queryExecution().executedPlan().toString()
    pruned = scan[scan.index("PartitionFilters"):].split("PushedFilters")[0]
    assert "node_id" in pruned and "date" in pruned
