"""Shapes of physical plans, sources, sinks and the batch job."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from fluxgauge.operators.joins import join_sized
from fluxgauge.operators.reports import current_kpis, kpi_snapshot
from fluxgauge.operators.series import NODE_SERIES, SITE_SERIES, RowChunks, Series, TimeChunks, WholeSeries
from fluxgauge.plans import bindings as b
from fluxgauge.plans.features import features, node_features
from fluxgauge.plans.job import main, run
from fluxgauge.schemas import HOURLY, NODE
from fluxgauge.session import materialize, shared_dir, stored
from fluxgauge.sources.readers import read_hourly, read_table, register_stage
from fluxgauge.sources.writers import run_report, write_features

SF = "/root/testdata/sf0.001"
TICKS = Series(keys=("node_id",), value="throughput_gbps", ties=("event_id",))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return re.findall(r"Exchange (hashpartitioning\([^)]*\))", plan(df))


@pytest.fixture(scope="module")
def grid(spark):
    return materialize(b.grid_view(spark, SF))


def by_key(df, key):
    return [s for s in shuffles(df) if key in s]


@pytest.mark.parametrize("chunks", [TimeChunks(), RowChunks(bucket_seconds=86_400), WholeSeries()])
def test_all_hourly_windows_share_one_shuffle_and_sort(grid, chunks):
    df = features(grid, chunks=chunks)
    assert len(by_key(df, "site#")) == 1
    text = plan(df)
    assert len(re.findall(r"- Window \[lag\(", text)) <= 1
    assert not re.search(r"ArrowEval|BatchEval|MapInPandas|CartesianProduct|NestedLoop", text)


def test_cross_site_window_has_no_whole_hour_sort(grid):
    text = plan(features(grid, chunks=TimeChunks()))
    windows = re.findall(r"windowspecdefinition\((__hour[^)]*)", text)
    assert windows and all("__band" in w for w in windows)


def test_node_features_share_one_shuffle_with_the_fft(spark):
    df = node_features(b.node_view(spark, SF), TICKS)
    assert len(by_key(df, "node_id#")) == 1 and "FlatMapGroupsInArrow" in plan(df)
    without = node_features(b.node_view(spark, SF), TICKS, peaks=False)
    assert len(by_key(without, "node_id#")) == 1 and "Arrow" not in plan(without).replace("ArrowPath", "")


def test_node_features_count_and_history(spark):
    node = b.node_view(spark, SF)
    df = node_features(node, TICKS)
    assert df.count() == node.count() - 5 * 168
    # id columns, tie-breaker and value, then the features of the six groups
    assert len(df.columns) == 5 + 43


def test_kpi_snapshot_reads_only_its_columns(spark, tmp_path):
    b.node_view(spark, SF).drop("event_id").write.parquet(str(tmp_path / "node"))
    text = plan(kpi_snapshot(read_table(spark, str(tmp_path / "node"), NODE)))
    columns = re.search(r"FileScan parquet \[([^\]]*)\]", text).group(1)
    assert sorted(c.split("#")[0] for c in columns.split(",")) == [
        "active_flows_m", "latency_ms", "node_id", "packet_loss_pct", "throughput_gbps", "timestamp", "utilization_pct",
    ]


def test_time_filters_reach_the_scan(spark, tmp_path):
    rows = b.hourly_view(spark, SF).withColumn("date", F.to_date("timestamp"))
    rows.write.partitionBy("site", "date").parquet(str(tmp_path / "h"))
    df = read_hourly(spark, str(tmp_path / "h"), "2024-01-20")
    assert re.search(r"PartitionFilters: \[[^\]]*date", plan(df))
    days = [r.date for r in df.select("date").distinct().orderBy("date").collect()]
    assert days[0] == dt.date(2024, 1, 13) and days[-1] == dt.date(2024, 1, 20)


def test_small_tables_are_broadcast_and_large_ones_are_not(spark):
    big = spark.range(1000).withColumn("k", F.col("id") % 7)
    small = big.groupBy("k").agg(F.count("*").alias("n"))
    assert "BroadcastHashJoin" in plan(join_sized(big, small, "k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        joined = join_sized(big, small, "k")
        assert "SortMergeJoin" in plan(joined) and joined.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_feature_variants_agree(grid):
    kept = ["site", "timestamp", "lag_168h", "roll_mean_168h", "zscore_24h", "site_rank_current_hour", "iqr_flag_24h", "detected_type"]

    def rows(**options):
        df = features(grid, **options).select(kept)
        return df.withColumns({c: F.round(c, 7) for c in ("lag_168h", "roll_mean_168h", "zscore_24h")})

    plain = rows(chunks=WholeSeries(), spread=False)
    for other in (rows(chunks=TimeChunks(span=336)), rows()):
        assert plain.exceptAll(other).count() == 0 and other.count() == plain.count()


def test_last_values_need_no_sort_of_the_table(grid):
    text = plan(current_kpis(grid.drop("anomaly_type", "data_source")))
    assert "SortAggregate" not in text and "HashAggregate" in text


def test_named_stages(spark, grid):
    register_stage(grid, "hourly_stage")
    assert spark.sql("SELECT count(*) FROM hourly_stage").first()[0] == grid.count()


def test_stored_tables_go_to_the_shared_folder(spark, grid):
    assert grid.inputFiles()[0].replace("file://", "").startswith(shared_dir(spark))


def test_only_computed_tables_are_stored_again(grid):
    assert stored(grid) is grid
    narrow = grid.filter("total_gbps > 1").select("site", (F.col("total_gbps") * 2).alias("x"))
    assert stored(narrow) is narrow
    for computed in (grid.groupBy("site").count(), grid.union(grid), grid.join(grid.select("site").distinct(), "site")):
        assert stored(computed) is not computed
    drawn = grid.withColumn("r", F.rand())
    assert stored(drawn) is not drawn
    newest = grid.filter(F.col("timestamp") >= grid.select(F.max("timestamp")).scalar())
    assert stored(newest) is not newest


def test_write_replaces_only_its_days(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = lambda day, n: spark.range(n).selectExpr("'A' AS site", f"DATE'2024-01-0{day}' AS date", "id")
    assert write_features(rows(1, 3).unionByName(rows(2, 4)), out) == {"rows": 7, "columns": 3}
    assert write_features(rows(2, 1), out)["rows"] == 1
    got = {str(r.date): r["count"] for r in spark.read.parquet(out).groupBy("date").count().collect()}
    assert got == {"2024-01-01": 3, "2024-01-02": 1}
    assert tuple(run_report(rows(1, 5)).first()) == (5, 3)


def test_batch_job(spark, tmp_path, capsys):
    rows = b.hourly_view(spark, SF).withColumn("date", F.to_date("timestamp"))
    rows.write.partitionBy("site", "date").parquet(str(tmp_path / "in"))
    report = run(spark, str(tmp_path / "in"), str(tmp_path / "out"), "2024-01-20")
    day = rows.filter("date = DATE'2024-01-20'")
    assert report["rows"] == day.count() > 0
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == day.count() and got.select("date").distinct().count() == 1
    # the week ahead is there: lags over seven days are known
    assert got.filter("lag_168h IS NULL").count() == 0
    main(["--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--date", "2024-01-21"])
    assert "columns" in capsys.readouterr().out
    assert spark.read.parquet(str(tmp_path / "out")).select("date").distinct().count() == 2


def test_fixed_schemas():
    assert len(HOURLY.fields) == 22 and len(NODE.fields) == 14
