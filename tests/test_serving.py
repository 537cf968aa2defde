from datetime import datetime, timedelta, timezone

from conftest import positions_frame, rows
from pyspark.sql import functions as F

from headway.functions import geo
from headway.operators import alerts, explore, state

NOW = datetime(2024, 1, 1, 9, tzinfo=timezone.utc)


def ago(seconds):
    return NOW - timedelta(seconds=seconds)


def test_last_write_wins_and_blank_ids_are_skipped(spark):
    data = [dict(vehicle_id="A", ingested_at=2, event_ts=ago(10)), dict(vehicle_id="A", ingested_at=1, event_ts=ago(0)),
            dict(vehicle_id=""), dict(vehicle_id=None), dict(vehicle_id="B")]
    latest = state.latest_vehicle_state(positions_frame(spark, data))
    assert rows(latest.select("vehicle_id", "entity_id")) == [("A", "e0000"), ("B", "e0004")]
    assert state.vehicle_lookup(latest, "A").count() == 1
    assert state.vehicle_lookup(latest, "nobody").count() == 0


def test_a_key_filter_is_applied_before_the_shuffle(spark, tmp_path):
    positions_frame(spark, [dict(vehicle_id="A"), dict(vehicle_id="B")]).write.parquet(str(tmp_path / "p"))
    found = state.vehicle_lookup(state.latest_vehicle_state(spark.read.parquet(str(tmp_path / "p"))), "A")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(vehicle_id,A)" in plan and "Filter" not in plan.split("Exchange")[0]
    assert rows(found.select("vehicle_id")) == [("A",)]


def test_expiry_bounds(spark):
    frame = positions_frame(spark, [dict(vehicle_id=f"V{s}", event_ts=ago(s)) for s in (0, 90, 91, 300, 301)])
    now = F.lit(NOW)
    assert rows(state.active_vehicles(frame, now).select("vehicle_id")) == [("V0",), ("V300",), ("V90",), ("V91",)]
    assert rows(state.live_route_members(frame, now).select("vehicle_id")) == [("V0",), ("V90",)]


def alert_frames(spark):
    delays = spark.createDataFrame(
        [("T1", "R1", "A", 700, "DELAY", ago(10)), ("T2", None, "B", -130, "EARLY", ago(20))],
        "trip_id string, route_id string, vehicle_id string, delay_sec int, alert_type string, event_ts timestamp")
    pairs = spark.createDataFrame(
        [("R1", "A", "B", 12.5, ago(400), ago(301)), ("R1", "A", "C", 1.0, ago(299), ago(400))],
        "route_id string, vehicle_id_a string, vehicle_id_b string, distance_m double, "
        "window_start timestamp, window_end timestamp")
    return delays, pairs


def test_alert_feed_identity_severity_and_expiry(spark):
    feed = alerts.alert_feed(*alert_frames(spark))
    assert rows(feed.select("alert_type", "severity")) == [
        ("BUNCHING", "INFO"), ("BUNCHING", "INFO"), ("DELAY", "CRITICAL"), ("EARLY", "WARNING")]
    again = alerts.alert_feed(*alert_frames(spark))
    assert rows(feed.select("alert_id")) == rows(again.select("alert_id"))
    assert feed.select("alert_id").distinct().count() == 4
    recent = alerts.recent_alerts(feed, F.lit(NOW))
    assert [r.vehicle_id for r in recent.collect()] == ["A", "B", "A"]
    assert alerts.recent_alerts(feed, F.lit(NOW), limit=1).count() == 1
    valid = alerts.valid_alerts(feed)
    assert valid.count() == 3 and {r.message for r in valid.collect()} == {""}
    nothing = alerts.alert_feed(*[f.limit(0) for f in alert_frames(spark)])
    assert alerts.recent_alerts(nothing, F.lit(NOW)).count() == 0


def test_record_checks(spark):
    records = spark.createDataFrame(
        [("BUS-1", "12.9716", "77.5946", "1700000000", None, None),
         ("METRO-4", "12.9", "77.6", "1700000100", "-30", "12.5"),
         (None, "12.9", "77.6", "1", None, None), ("X", "north", "77.6", "1", None, None),
         ("X", "12.9", None, "1", None, None), ("X", "12.9", "77.6", "soon", None, None),
         ("X", "12.9", "77.6", "1", "late", None), ("X", "12.9", "77.6", "1", None, "fast")],
        "vehicle_id string, latitude string, longitude string, timestamp string, delay_seconds string, "
        "speed_mps string")
    first, second = state.valid_positions(records).orderBy("timestamp").collect()
    assert (first.is_bunching, first.eta_seconds, first.speed_mps, first.feed) == (False, None, 0.0, "")
    assert (second.delay_seconds, second.speed_mps, second.timestamp) == (-30, 12.5, 1700000100)
    assert [r.reject_reason for r in state.rejected_positions(records).collect()] == [
        "vehicle_id", "latitude", "longitude", "timestamp", "delay_seconds", "speed_mps"]
    assert state.valid_positions(records.limit(0)).count() == 0


def test_projection_and_deep_links(spark):
    frame = positions_frame(spark, [dict(latitude=geo.CITY_ORIGIN[0], longitude=geo.CITY_ORIGIN[1]),
                                    dict(latitude=geo.CITY_ORIGIN[0] + 1, longitude=geo.CITY_ORIGIN[1] - 1)])
    a, b = state.planar_positions(frame).orderBy("entity_id").collect()
    assert (a.x, a.z) == (0.0, 0.0)
    assert (round(b.x, 3), round(b.z, 3)) == (-110540.0, 111320.0)


def test_enrichment(spark):
    frame = positions_frame(spark, [dict(vehicle_id="A", trip_id="T1", event_ts=ago(5)),
                                    dict(vehicle_id="B", trip_id=None, event_ts=ago(5)),
                                    dict(vehicle_id="C", trip_id="T2", event_ts=ago(5), route_id="R2")])
    updates = spark.createDataFrame(
        [("T1", 10, ago(100)), ("T1", 300, ago(50)), ("T1", None, ago(1)), ("T3", 5, ago(1))],
        "trip_id string, arrival_delay int, event_ts timestamp")
    out = explore.enriched_positions(frame, updates, alerts.bunched_vehicles(frame))
    assert rows(out.select("vehicle_id", "delay_seconds", "is_bunching")) == [
        ("A", 300, True), ("B", None, True), ("C", None, False)]


def test_route_summary_takes_the_newest_day(spark):
    routes = spark.createDataFrame([("R1", "One"), ("R2", "Two")], "route_id string, route_long_name string")
    gold = spark.createDataFrame([("R1", "bmtc", "2024-01-01", 5.0), ("R1", "bmtc", "2024-01-02", 6.0)],
                                 "route_id string, feed string, ingestion_date string, avg_speed_kmh double")
    out = explore.route_summary(routes, gold)
    assert rows(out.select("route_id", "avg_speed_kmh")) == [("R1", 6.0), ("R2", None)]


def test_alertable_rows_make_all_alive_alerts_and_few_others(spark):
    # One position each 30 seconds for 2,000 seconds, the last 100 seconds after the moment asked for.
    data = [dict(vehicle_id=f"V{n % 3}", trip_id=f"T{n % 2}", event_ts=NOW + timedelta(seconds=100 - 30 * n)) for n in range(67)]
    seen = positions_frame(spark, data)
    told = seen.select("trip_id", "route_id", F.lit(700).alias("arrival_delay"), "event_ts")

    def alive(a, b):
        feed = alerts.alert_feed(alerts.delay_alerts(a, b), alerts.bunching_alerts(a))
        return rows(alerts.recent_alerts(feed, F.lit(NOW)))

    few = [alerts.alertable(df, F.lit(NOW)) for df in (seen, told)]
    assert alive(*few) == alive(seen, told) and len(alive(seen, told)) > 30
    assert few[0].count() < 20
