from datetime import datetime, timedelta, timezone

import pytest
from conftest import positions_frame, rows
from pyspark.sql import functions as F

from headway import schemas
from headway.functions import geo, numbers
from headway.operators import alerts, clean, explore, kpis, model, quality, schedule
from headway.plans import layers
from headway.sinks import lake as sinks
from headway.sources import lake

START = datetime(2024, 1, 1, 8, tzinfo=timezone.utc)


def at(**delta):
    return START + timedelta(**delta)


def test_incomplete_and_impossible_positions_go(spark):
    data = [dict(), dict(vehicle_id=None), dict(vehicle_id=" "), dict(latitude=None), dict(longitude=None),
            dict(latitude=90.0, longitude=-180.0), dict(latitude=90.01), dict(longitude=180.5)]
    kept = clean.plausible(positions_frame(spark, data))
    assert rows(kept.select("entity_id")) == [("e0000",), ("e0005",)]


def test_dedup_keeps_the_newest_of_each_bucket(spark):
    data = [dict(event_ts=at(seconds=0), ingested_at=5), dict(event_ts=at(seconds=29), ingested_at=4),
            dict(event_ts=at(seconds=30), ingested_at=1),
            dict(vehicle_id="V2", ingested_at=9), dict(vehicle_id="V2", ingested_at=9)]
    kept = clean.dedup(positions_frame(spark, data))
    assert rows(kept.select("entity_id")) == [("e0000",), ("e0002",), ("e0004",)]
    two_feeds = [dict(feed="bmtc"), dict(feed="namma_metro")]
    frame = positions_frame(spark, two_feeds)
    assert clean.dedup(frame).count() == 1 and clean.dedup(frame, include_feed=True).count() == 2


def test_dedup_shrinks_copies_before_the_shuffle(spark):
    frame = positions_frame(spark, [dict()] * 50)
    plan = clean.dedup(frame)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan


def test_silver_defaults_and_labels(spark):
    data = [dict(route_id=None, trip_id=None, speed_mps=None),
            dict(vehicle_id="V2", feed="namma_metro", speed_mps=20.0, event_ts=at(hours=-3))]
    first, second = clean.silver(positions_frame(spark, data)).orderBy("entity_id").collect()
    assert (first.route_id, first.trip_id, first.speed_mps) == ("UNKNOWN", "UNKNOWN", 0.0)
    assert (first.speed_category, first.time_bucket, first.is_valid_bbox) == ("STATIONARY", "AM_PEAK", True)
    assert (second.speed_category, second.time_bucket, second.is_peak_hour, second.is_valid_bbox) == (
        "FAST", "EARLY_MORNING", False, False)
    moved = {"namma_metro": geo.Box(12.0, 14.0, 77.0, 78.0)}
    assert clean.silver(positions_frame(spark, data), boxes=moved).where("is_valid_bbox").count() == 1


def day(n):
    return START + timedelta(days=n)


def test_gold_on_a_hand_made_day(spark):
    speeds = [0.0, 2.0, 4.0, 10.0]
    data = [dict(vehicle_id=f"V{i % 2}", speed_mps=s, event_ts=at(minutes=30 * i)) for i, s in enumerate(speeds)]
    data += [dict(route_id="R2", speed_mps=3.0), dict(route_id="R3", speed_mps=0.0),
             dict(route_id="R3", speed_mps=0.0, event_ts=at(hours=1)), dict(route_id=None),
             dict(vehicle_id="far", latitude=20.0)]
    data = [dict(r, vehicle_id=f"{r.get('vehicle_id', 'V')}-{r.get('route_id', 'R1')}") for r in data]
    gold = {r.route_id: r for r in kpis.gold_from_bronze(positions_frame(spark, data)).collect()}
    assert set(gold) == {"R1", "R2", "R3"}
    r1 = gold["R1"]
    assert (r1.unique_vehicles, r1.total_observations) == (2, 4)
    assert (r1.avg_speed_mps, r1.avg_speed_kmh, r1.max_speed_kmh, r1.median_speed_kmh) == (4.0, 14.4, 36.0, 10.8)
    assert (r1.stationary_pct, r1.slow_pct) == (25.0, 50.0)
    assert (r1.avg_speed_am_peak_kmh, r1.avg_speed_pm_peak_kmh, r1.active_hours) == (14.4, None, 1.5)
    assert r1.reliability_score == pytest.approx(max(0, round(100 - 4.3204937989 / 4 * 50, 1)))
    assert gold["R2"].reliability_score == 0.0 and gold["R3"].reliability_score == 0.0
    assert {k: v.speed_rank_today for k, v in gold.items()} == {"R1": 1, "R2": 2, "R3": 3}


def test_rolling_mean_counts_rows_and_ranks_share_ties(spark):
    data = [("R1", "bmtc", f"2024-01-{d:02d}", float(d)) for d in (1, 2, 3, 4, 5, 6, 7, 20)]
    data += [("R2", "bmtc", "2024-01-20", 20.0), ("R3", "bmtc", "2024-01-20", None), ("R4", "bmtc", "2024-01-20", 1.0)]
    daily = spark.createDataFrame(data, "route_id string, feed string, ingestion_date string, avg_speed_kmh double")
    rolled = {r.ingestion_date: r.avg_speed_kmh_7d for r in kpis.with_rolling_speed(daily).collect()
              if r.route_id == "R1"}
    assert rolled["2024-01-01"] == 1.0 and rolled["2024-01-07"] == 4.0
    assert rolled["2024-01-20"] == round((2 + 3 + 4 + 5 + 6 + 7 + 20) / 7, 2)
    last = {r.route_id: r.speed_rank_today for r in kpis.with_speed_rank(daily).collect()
            if r.ingestion_date == "2024-01-20"}
    assert last == {"R1": 1, "R2": 1, "R4": 3, "R3": 4}


def test_presentation_order(spark):
    data = [("R1", "bmtc", "2024-01-01", 1.0), ("R2", "bmtc", "2024-01-02", None), ("R3", "bmtc", "2024-01-02", 2.0),
            ("R4", "bmtc", "2024-01-02", 1.0), ("R5", "a", "2024-01-02", 9.0)]
    gold = spark.createDataFrame(data, "route_id string, feed string, ingestion_date string, avg_speed_kmh double")
    assert [r.route_id for r in kpis.presentation_order(gold).collect()] == ["R5", "R4", "R3", "R2", "R1"]


def test_gold_shuffles_raw_rows_once(spark):
    frame = positions_frame(spark, [dict()])
    gold = kpis.gold_from_bronze(frame)
    gold.collect()
    final = gold._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("partial_max_by") == 1 and "ReusedExchange" in final


def test_partition_filters_reach_the_scan(spark, tmp_path):
    data = [dict(event_ts=day(n), feed=f, vehicle_id=f"V{n}") for n in range(3) for f in ("bmtc", "namma_metro")]
    folder = str(tmp_path / "bronze")
    sinks.refresh(sinks.bronze_rows(positions_frame(spark, data)), folder, sinks.LAKE_PARTITIONS)
    chosen = explore.filtered(lake.bronze(spark, folder), "2024-01-02", "bmtc")
    plan = chosen.select("vehicle_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ingestion_date" in plan and "ReadSchema: struct<vehicle_id:string>" in plan
    assert rows(chosen.select("vehicle_id")) == [("V1",)]
    assert explore.filtered(lake.bronze(spark, folder)).count() == 6


def test_dynamic_overwrite_replaces_only_its_partitions(spark, tmp_path):
    folder = str(tmp_path / "static")
    def load(feed, ids):
        df = spark.createDataFrame([(i, feed, "2024-01-01") for i in ids],
                                   "stop_id string, _feed_name string, _ingestion_date string")
        sinks.load_static(df, folder)
    load("a", ["S1", "S2"])
    load("b", ["S3"])
    load("a", ["S1", "S4"])
    assert rows(spark.read.parquet(folder).select("stop_id")) == [("S1",), ("S3",), ("S4",)]


def test_old_generations_read_with_nulls(spark, tmp_path):
    frame = positions_frame(spark, [dict()])
    frame.drop("bearing").write.parquet(str(tmp_path / "a"))
    frame.write.parquet(str(tmp_path / "b"))
    both = lake.bronze(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert both.schema == schemas.BRONZE_POSITION
    assert sorted(r.bearing is None for r in both.collect()) == [False, True]
    assert lake.union_generations(frame.drop("bearing"), frame).count() == 2


def test_profiles(spark):
    data = [dict(vehicle_id=v, event_ts=at(seconds=i)) for i, v in enumerate(["A", "A", "B"])]
    frame = positions_frame(spark, data + [dict(vehicle_id="C", route_id=None, feed="namma_metro", speed_mps=None)])
    totals = explore.totals(frame).first()
    assert (totals.total_rows, totals.total_vehicles, totals.feeds, totals.unique_routes) == (4, 3, 2, 1)
    assert explore.totals(frame.limit(0)).first().total_rows == 0
    top = explore.profile_order(explore.profile(frame)).first()
    assert (top.feed, top.row_count, top.unique_vehicles, top.avg_speed_mps) == ("bmtc", 3, 2, 5.0)
    assert [r.vehicle_id for r in explore.newest_sample(frame, 2).collect()] == ["B", "A"]


def test_replay_of_one_date(spark):
    data = [dict(event_ts=at(minutes=m)) for m in (0, 10, 59, 61)] + [dict(event_ts=day(1))]
    silver = clean.silver(positions_frame(spark, data))
    frames = explore.replay_frames(silver, 3600, START.date())
    assert rows(frames.select("entity_id")) == [("e0002",), ("e0003",)]
    assert explore.replay_frames(silver, 3600).count() == 3


def test_checks_count_and_raise(spark):
    frame = positions_frame(spark, [dict(), dict(feed=None), dict(feed="other"), dict(latitude=None)])
    checks = quality.not_null("latitude") + quality.accepted_values("feed", ("bmtc",))
    report = quality.report(frame, "t", checks)
    assert rows(report) == [("t", "feed", "accepted_values", 1), ("t", "latitude", "not_null", 1)]
    with pytest.raises(quality.ExpectationFailed, match="t.latitude not_null: 1 rows"):
        quality.require(report)
    quality.require(quality.report(frame.limit(0), "t", checks))
    assert quality.report(frame, "t", quality.between("latitude", 0.0, 1.0)).first().failures == 3


def test_load_stamp_is_one_moment(spark):
    frame = clean.stamped(positions_frame(spark, [dict(), dict()]))
    assert frame.select("updated_at").distinct().count() == 1
    assert frame.where(F.col("updated_at").isNull()).count() == 0


def test_daily_run_builds_both_layers_and_checks(spark, tmp_path):
    folders = [str(tmp_path / n) for n in ("bronze", "silver", "gold")]
    data = [dict(event_ts=day(n), vehicle_id=f"V{v}") for n in range(3) for v in range(2)]
    sinks.refresh(sinks.bronze_rows(positions_frame(spark, data)), folders[0], sinks.LAKE_PARTITIONS)
    report = layers.run(spark, *folders)
    assert report.count() == 10 and report.agg(F.sum("failures")).first()[0] == 0
    assert spark.read.parquet(folders[2]).count() == 3

    # One date arrives anew; only its partition changes.
    late = positions_frame(spark, [dict(event_ts=day(1), vehicle_id=f"V{v}") for v in range(5)])
    sinks.overwrite_partitions(sinks.bronze_rows(late), folders[0], *sinks.LAKE_PARTITIONS)
    layers.run(spark, *folders, dates=["2024-01-02"])
    gold = {r.ingestion_date: r.unique_vehicles for r in spark.read.parquet(folders[2]).collect()}
    assert gold == {"2024-01-01": 2, "2024-01-02": 5, "2024-01-03": 2}

    foreign = positions_frame(spark, [dict(feed="other", event_ts=day(5))])
    sinks.overwrite_partitions(sinks.bronze_rows(foreign), folders[0], *sinks.LAKE_PARTITIONS)
    with pytest.raises(quality.ExpectationFailed, match="silver.feed accepted_values: 1 rows"):
        layers.run(spark, *folders)
    # The published tables are as they were.
    assert spark.read.parquet(folders[1]).where("feed = 'other'").count() == 0
    assert spark.read.parquet(folders[2]).count() == 3


def layout(schema):
    return [(f.name, f.dataType) for f in schema]


def test_outputs_have_the_declared_layouts(spark, tmp_path):
    frame = positions_frame(spark, [dict()])
    updates = spark.createDataFrame([], "trip_id string, route_id string, arrival_delay int, event_ts timestamp")
    assert layout(alerts.delay_alerts(frame, updates).schema) == layout(schemas.DELAY_EVENT)
    assert layout(alerts.bunching_alerts(frame).schema) == layout(schemas.BUNCHING_ALERT)
    assert layout(sinks.bronze_rows(frame).schema) == layout(schemas.BRONZE_POSITION)
    loads = spark.createDataFrame([("f", "2024-01-01", "c", 0)],
                                  "feed_name string, ingestion_date string, checksum string, rows_loaded long")
    sinks.append_feed_log(schedule.feed_log_rows(loads), str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert layout(log.schema) == layout(schemas.FEED_LOG) and log.first().status == "empty"
    record = model.model_record(spark, "m", "1", "Staging", "uri")
    assert layout(record.schema) == layout(schemas.MODEL_RECORD)


def test_clip(spark):
    values = spark.createDataFrame([(-1.0,), (0.4,), (3.0,)], "v double")
    assert [r[0] for r in values.select(numbers.clip(F.col("v"), 0.0, 1.0)).collect()] == [0.0, 0.4, 1.0]
