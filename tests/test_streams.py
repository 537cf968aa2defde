import json
import os
from datetime import datetime, timedelta, timezone

import pytest
from conftest import positions_frame, rows
from pyspark.sql import functions as F

from headway import schemas
from headway.operators import alerts, clean, state
from headway.sinks import lake, messages as message_sinks
from headway.sources import messages
from headway.streaming import jobs, presence, runner

START = datetime(2024, 1, 1, 8, tzinfo=timezone.utc)


def message(i, seconds, **more):
    return {"entity_id": f"e{i}", "feed": "bmtc", "feed_type": "vehicle_positions",
            "feed_timestamp": 0, "ingested_at": i, "vehicle_id": f"V{i}", "label": "", "trip_id": "T1",
            "route_id": "R1", "latitude": 12.95, "longitude": 77.55, "bearing": 0.0, "speed_mps": 5.0,
            "current_stop_sequence": 1, "current_status": "IN_TRANSIT_TO", "occupancy_status": None,
            "timestamp": int(START.timestamp()) + seconds, "unknown_member": 1, **more}


class Inbox:
    """A folder of message files, one file per arrival."""

    def __init__(self, folder):
        self.folder, self.files = folder, 0
        folder.mkdir()

    def put(self, *items):
        self.files += 1
        lines = [i if isinstance(i, str) else json.dumps(i) for i in items]
        path = self.folder / f"{self.files:03d}.json"
        path.write_text("\n".join(lines) + "\n")
        # Files are read by their time, which is the same for files of one millisecond.
        arrived = path.stat().st_mtime_ns + self.files * 2_000_000_000
        os.utime(path, ns=(arrived, arrived))

    def positions(self, spark, per_batch=1):
        return messages.parse_positions(messages.file_stream(spark, str(self.folder), per_batch))


@pytest.fixture
def inbox(tmp_path):
    return Inbox(tmp_path / "in")


def bronze(stream):
    return stream.select(*schemas.BRONZE_POSITION.fieldNames())


def test_bad_messages_are_dropped(spark, inbox):
    inbox.put(message(1, 0), "{not json", "", json.dumps({"vehicle_id": "no key"}), message(2, 1))
    out = runner.to_table(bronze(inbox.positions(spark)), "t")
    assert rows(out.select("entity_id")) == [("e1",), ("e2",)]
    batch = messages.parse_positions(messages.file_batch(spark, str(inbox.folder)))
    assert rows(batch.select("entity_id")) == [("e1",), ("e2",)]
    assert batch.first().event_ts.replace(tzinfo=timezone.utc) - START in (timedelta(0), timedelta(seconds=1))


def test_parse_reads_each_message_once(spark):
    raw = spark.createDataFrame([(json.dumps(message(1, 0)),)], "value string").repartition(2)
    plan = messages.parse_positions(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_flattening_drops_other_entities_and_blank_texts(spark):
    schema = """feed string, header struct<timestamp: bigint>, entity array<struct<id: string,
      vehicle: struct<trip: struct<trip_id: string, route_id: string>, vehicle: struct<id: string, label: string>,
        position: struct<latitude: double, longitude: double, bearing: double, speed: double>,
        current_stop_sequence: int, current_status: string, occupancy_status: string, timestamp: bigint>,
      trip_update: struct<trip: struct<trip_id: string, route_id: string>, vehicle: struct<id: string>,
        stop_time_update: array<struct<stop_sequence: int, stop_id: string, arrival: struct<delay: int>,
          departure: struct<delay: int>>>>>>"""
    vehicle = (None, ("", "bus"), (1.0, 2.0, 3.0, 4.0), 5, "STOPPED_AT", None, 99)
    update = (("T", ""), None, [(1, "S1", (60,), None), (2, "S2", None, (30,))])
    feeds = spark.createDataFrame([("bmtc", (7,), [("a", vehicle, None), ("b", None, update), ("c", None, None)]),
                                   ("bmtc", (8,), []), ("bmtc", (9,), None)], schema)
    flat = messages.flatten_vehicles(feeds).collect()
    assert [(r.entity_id, r.vehicle_id, r.trip_id, r.speed_mps, r.feed_timestamp) for r in flat] == [
        ("a", None, None, 4.0, 7)]
    assert len(flat[0]) == 17 and flat[0].ingested_at > 0
    stops = messages.explode_stops(messages.flatten_trip_updates(feeds)).collect()
    assert [(r.stop_id, r.arrival_delay, r.departure_delay, r.vehicle_id, r.route_id) for r in stops] == [
        ("S1", 60, None, None, None), ("S2", None, 30, None, None)]


def test_stream_joins_across_batches_equal_batch(spark, inbox):
    for i, s in enumerate([0, 30, 95, 200, 280, 400]):
        inbox.put(message(i, s), message(i + 100, s + 5, route_id="R2", trip_id="T2"))
    stream = bronze(inbox.positions(spark))
    static = messages.parse_positions(messages.file_batch(spark, str(inbox.folder)))
    columns = ["route_id", "vehicle_id_a", "vehicle_id_b", "window_start", "window_end"]
    found = runner.to_table(jobs.bunching_alerts(stream, bronze(inbox.positions(spark)), slices=2), "b")
    expected = alerts.bunching_alerts(static)
    assert expected.count() > 3
    assert rows(found.select(*columns)) == rows(expected.select(*columns))

    update = F.struct("trip_id", "route_id", F.lit(300).alias("arrival_delay"), "event_ts")
    updates = stream.select(update.alias("u")).select("u.*")
    late = runner.to_table(jobs.delay_alerts(bronze(inbox.positions(spark)), updates), "d")
    batch = alerts.delay_alerts(static, static.select(update.alias("u")).select("u.*"))
    assert rows(late) == rows(batch) and batch.count() > 6


def test_a_trip_with_half_the_rows_spreads_by_its_measured_load(spark, inbox):
    for n in range(4):
        inbox.put(*[message(100 * n + k, 30 * n + k % 7, trip_id="busy" if k % 2 else f"T{k}") for k in range(60)])
    static = messages.parse_positions(messages.file_batch(spark, str(inbox.folder)))
    slices = alerts.delay_slices(static, rows_per_slice=25)
    assert rows(slices) == [("busy", 5)]  # 120 rows in the fullest bin.
    assert alerts.delay_slices(static).count() == 0
    update = F.struct("trip_id", "route_id", F.lit(300).alias("arrival_delay"), "event_ts")
    stream = bronze(inbox.positions(spark))
    updates = stream.where("ingested_at % 10 < 3").select(update.alias("u")).select("u.*")
    found = runner.to_table(jobs.delay_alerts(bronze(inbox.positions(spark)), updates, slices), "d")
    few = static.where("ingested_at % 10 < 3").select(update.alias("u")).select("u.*")
    want = alerts.delay_alerts(static, few)
    assert rows(found) == rows(want) and want.where("trip_id = 'busy'").count() > 1000
    sliced = alerts.delay_alerts(static, few, slices=slices)
    assert rows(sliced) == rows(want)


def test_rows_behind_the_watermark_do_not_join(spark, inbox):
    inbox.put(message(1, 0))
    inbox.put(message(2, 4000))
    inbox.put(message(3, 8000))
    inbox.put(message(4, 5))  # would pair with the first, but comes hours late
    found = runner.to_table(jobs.bunching_alerts(bronze(inbox.positions(spark)), bronze(inbox.positions(spark))), "w")
    assert found.count() == 0
    batch = alerts.bunching_alerts(messages.parse_positions(messages.file_batch(spark, str(inbox.folder))))
    assert batch.count() == 1


def test_bunching_state_holds_columns_and_expires(spark, inbox):
    for n in range(3):  # 200 vehicles a delivery, all of them within 90 seconds.
        inbox.put(*[message(200 * n + k, 20 * n + k % 20) for k in range(200)])
    inbox.put(message(1000, 3000, trip_id="T2"))
    read = [bronze(inbox.positions(spark)) for _ in range(2)]
    found, query = runner.observed(jobs.bunching_alerts(*read), "state")
    static = messages.parse_positions(messages.file_batch(spark, str(inbox.folder)))
    columns = [*found.columns[:3], F.round("distance_m", 6), *found.columns[4:]]
    assert rows(found.select(*columns)) == rows(alerts.bunching_alerts(static).select(*columns))
    assert found.count() == 600 * 599 // 2
    held = [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in query.recentProgress]
    assert max(held) < 40  # One value for the rows of a shard; every row was a state of its own.
    assert held[-1] < max(held)


def test_a_far_event_time_does_not_stop_the_bunching_stream(spark, inbox):
    inbox.put(message(1, 0), message(2, 0), message(3, 10**10), message(4, 10**10))
    found = runner.to_table(jobs.bunching_alerts(bronze(inbox.positions(spark)), bronze(inbox.positions(spark))), "far")
    assert rows(found.select("vehicle_id_a", "vehicle_id_b")) == [("V1", "V2"), ("V3", "V4")]


def test_alert_messages_are_written_compressed(spark, inbox, tmp_path):
    inbox.put(*[message(k, 0) for k in range(60)])
    read = [bronze(inbox.positions(spark)) for _ in range(2)]
    writer = message_sinks.json_sink(jobs.bunching_alerts(*read), str(tmp_path / "out"), str(tmp_path / "cp"), "route_id")
    writer.trigger(availableNow=True).start().awaitTermination()
    told = spark.read.text(str(tmp_path / "out"))
    size = sum(f.stat().st_size for f in (tmp_path / "out").glob("part-*"))
    assert told.count() == 60 * 59 // 2 and size < 20 * told.count()
    assert {"V0", "V1"} <= {json.loads(r.value)["vehicle_id_a"] for r in told.collect()}


def test_restart_continues_without_repeats(spark, inbox, tmp_path):
    def run():
        writer = lake.bronze_sink(inbox.positions(spark), str(tmp_path / "out"), str(tmp_path / "cp"))
        writer.trigger(availableNow=True).start().awaitTermination()

    inbox.put(message(1, 0), message(2, 0, latitude=None))
    run()
    run()
    inbox.put(message(3, 1, feed="namma_metro"))
    run()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert rows(out.select("entity_id", "feed")) == [("e1", "bmtc"), ("e3", "namma_metro")]
    assert (tmp_path / "out" / "feed=bmtc" / "ingestion_date=2024-01-01").is_dir()


def test_dedup_stream_equals_batch_for_closed_windows(spark, inbox):
    for i, s in enumerate([0, 10, 29, 31, 59, 61, 300]):
        inbox.put(message(i, s, vehicle_id="V1"))
    out = runner.to_table(jobs.dedup(bronze(inbox.positions(spark))), "dd")
    batch = clean.dedup(messages.parse_positions(messages.file_batch(spark, str(inbox.folder))))
    closed = batch.where(F.unix_seconds("event_ts") < int(START.timestamp()) + 240)
    assert rows(out.select("entity_id")) == rows(closed.select("entity_id")) == [("e2",), ("e4",), ("e5",)]


def test_latest_state_versions(spark, inbox):
    inbox.put(message(1, 0, vehicle_id="A"), message(2, 0, vehicle_id="B"))
    inbox.put(message(5, 9, vehicle_id="A"), message(3, 60, vehicle_id="A"), message(4, 1, vehicle_id=""))
    versions = runner.to_versions(jobs.latest_state(bronze(inbox.positions(spark))), "ls")
    assert versions.where("vehicle_id = 'A'").count() == 2
    newest = clean.newest_per(versions, ["vehicle_id"], [F.col("version")])
    assert rows(newest.select("vehicle_id", "entity_id")) == [("A", "e5"), ("B", "e2")]


def test_state_and_route_sets_expire_90_seconds_after_the_last_write(spark, inbox):
    for i, (vehicle, s) in enumerate([("A", 0), ("A", 90), ("B", 100), ("A", 300), ("C", 1000)]):
        inbox.put(message(i, s, vehicle_id=vehicle))
    stream = bronze(inbox.positions(spark))
    seconds = F.unix_seconds("expires_at") - int(START.timestamp())
    expired = runner.to_table(jobs.expired_state(stream), "ex")
    assert rows(expired.select("vehicle_id", "entity_id", seconds)) == [("A", "e1", 180), ("A", "e3", 390), ("B", "e2", 190)]
    members = runner.to_versions(jobs.route_members(bronze(inbox.positions(spark))), "rm")
    sets = jobs.listed_vehicles(members, runner.to_table(jobs.route_windows(bronze(inbox.positions(spark))), "rs"))
    ends = F.unix_seconds("session_end") - int(START.timestamp())
    assert rows(sets.select("vehicle_id", ends)) == [("A", 190), ("A", 390), ("B", 190)]
    batch = state.route_vehicle_sessions(messages.parse_positions(messages.file_batch(spark, str(inbox.folder))))
    assert rows(batch.select("vehicle_id", ends)) == [("A", 190), ("A", 390), ("B", 190), ("C", 1090)]


def test_presences_live_and_expire_over_batches(spark, inbox, tmp_path):
    """Someone is always on the route, so it never falls silent; all of them go and some come back."""
    heard = [[("A", 0), ("C", 5)], [("B", 60)], [("A", 120), (None, 121), ("", 122)], [("B", 180), ("C", 170)],
             [("A", 240), ("A", 200)], [("B", 300)], [("A", 390)]]
    for n, batch in enumerate(heard):
        inbox.put(*[message(10 * n + k, s, vehicle_id=v) for k, (v, s) in enumerate(batch)])
    seconds = [(F.unix_seconds(c) - int(START.timestamp())).alias(c) for c in ("first_seen", "expires_at")]
    told = runner.to_versions(jobs.route_members(bronze(inbox.positions(spark))), "rm")
    assert told.select("version").distinct().count() >= 6  # The busy route speaks in every batch.
    gone = told.where("NOT alive").select("vehicle_id", *seconds)
    assert set(rows(gone)) == {("A", 0, 90), ("A", 120, 330), ("B", 60, 150), ("B", 180, 270), ("C", 5, 95),
                               ("C", 170, 260)} and gone.count() == 6
    assert told.where("alive AND vehicle_id = 'A'").count() == 4
    assert rows(presence.live(told, ["route_id", "vehicle_id"]).select("vehicle_id", *seconds)) == [
        ("A", 390, 480), ("B", 300, 390)]

    def run():
        changes = jobs.latest_state(bronze(inbox.positions(spark)))
        presence.live_table(changes, ["vehicle_id"], str(tmp_path / "live"), str(tmp_path / "cp")) \
            .trigger(availableNow=True).start().awaitTermination()
        assert len(list((tmp_path / "live").iterdir())) <= 2  # Superseded versions are removed.
        table = presence.read_live(changes, str(tmp_path / "live"))
        return rows(table.select("vehicle_id", "entity_id", *seconds))

    assert run() == [("A", "e60", 390, 480), ("B", "e50", 300, 390)]
    inbox.put(message(90, 1000, vehicle_id="D"))  # After a restart, time goes on and the others expire.
    assert run() == [("D", "e90", 1000, 1090)]


def test_presences_merge_like_session_windows():
    import random

    import pandas as pd

    r = random.Random(1)
    events = [("k%d" % r.randrange(3), r.randrange(900), n) for n in range(200)]
    frame = pd.DataFrame({"key": [k for k, _, _ in events], "event_ts": pd.to_datetime([t for _, t, _ in events], unit="s"),
                          "n": [n for _, _, n in events]})
    frame = frame.assign(first_seen=frame["event_ts"], expires_at=frame["event_ts"] + pd.Timedelta(seconds=9),
                         _touched=False)
    held = frame[:0]
    for at in range(0, 200, 37):
        held = presence.merged(pd.concat([held, frame[at:at + 37]]) if at else frame[:37], ["key"], ["n"])
    want = []
    for key in ("k0", "k1", "k2"):
        own = sorted((t, n) for k, t, n in events if k == key)
        group = []
        for t, n in [*own, (10**6, 0)]:
            if group and t > group[-1][0] + 9:
                want.append((key, group[0][0], group[-1][0] + 9, max(n for _, n in group)))
                group = []
            group.append((t, n))
    got = [(r.key, int(r.first_seen.timestamp()), int(r.expires_at.timestamp()), r.n) for r in held.itertuples()]
    assert sorted(got) == want


def test_two_sinks_in_one_session(spark, inbox, tmp_path):
    inbox.put(message(1, 0))
    writers = [message_sinks.json_sink(inbox.positions(spark), str(tmp_path / n), str(tmp_path / f"cp-{n}"), "entity_id")
               .trigger(availableNow=True) for n in ("a", "b")]
    for query in lake.fan_out(*writers):
        query.awaitTermination()
    for n in ("a", "b"):
        value = json.loads(spark.read.text(str(tmp_path / n)).first().value)
        assert value["entity_id"] == "e1"

    seen = []
    writer = inbox.positions(spark).writeStream.option("checkpointLocation", str(tmp_path / "cp-c"))
    writer = lake.per_batch(writer, lambda df, i: seen.append(("x", df.count())), lambda df, i: seen.append(("y", i)))
    writer.trigger(availableNow=True).start().awaitTermination()
    assert seen == [("x", 1), ("y", 0)]


def test_keyed_messages_and_kafka_options(spark):
    out = message_sinks.to_messages(positions_frame(spark, [dict()]), "entity_id").first()
    assert out.key == "e0000" and json.loads(out.value)["vehicle_id"] == "V1"
    assert message_sinks.to_messages(positions_frame(spark, [dict()])).first().key is None
    options = messages.kafka_options("host:9092", ["delays", "bunching"], "earliest", maxOffsetsPerTrigger="10")
    assert options["subscribe"] == "delays,bunching" and options["startingOffsets"] == "earliest"
    assert options["maxOffsetsPerTrigger"] == "10"
    assert messages.kafka_options("h", "positions")["startingOffsets"] == "latest"


def test_snapshots_hold_the_live_vehicles(spark, inbox, tmp_path):
    inbox.put(message(1, 0, vehicle_id="A"), message(2, 100, vehicle_id="B"), message(3, 95, vehicle_id="A"),
              message(4, 9, vehicle_id="gone"))
    writer = jobs.snapshots(bronze(inbox.positions(spark)), str(tmp_path / "out"), str(tmp_path / "cp"),
                            as_of=F.lit(START + timedelta(seconds=100)))
    writer.trigger(availableNow=True).start().awaitTermination()
    bodies = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out" / "batch=0")).collect()]
    assert sorted((v["vehicle_id"], v["entity_id"]) for b in bodies for v in b["data"]) == [("A", "e3"), ("B", "e2")]


def test_the_alert_and_lake_jobs_end_to_end(spark, tmp_path):
    inboxes = {"vehicle-positions": Inbox(tmp_path / "positions"), "trip-updates": Inbox(tmp_path / "updates")}
    inboxes["vehicle-positions"].put(message(1, 0), message(2, 5), message(3, 5, vehicle_id=""))
    inboxes["trip-updates"].put({"entity_id": "u1", "feed": "bmtc", "feed_type": "trip_updates",
                                 "feed_timestamp": int(START.timestamp()) + 20, "ingested_at": 1, "trip_id": "T1",
                                 "route_id": "R1", "vehicle_id": None, "stop_time_updates": [
                                     {"stop_sequence": 1, "stop_id": "S1", "arrival_delay": 700},
                                     {"stop_sequence": 2, "stop_id": "S2", "arrival_delay": 100}]})

    def read(topic):
        return messages.file_stream(spark, str(inboxes[topic].folder))

    def write(df, topic, key):
        return message_sinks.json_sink(df, str(tmp_path / topic), str(tmp_path / f"cp-{topic}"), key)

    writers = jobs.alert_writers(read, write, slices=3)
    writers.append(jobs.bronze_writer(read, str(tmp_path / "bronze"), str(tmp_path / "cp-bronze")))
    for query in lake.fan_out(*[w.trigger(availableNow=True) for w in writers]):
        query.awaitTermination()
    delays = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "delay-events")).collect()]
    assert sorted((d["vehicle_id"], d["delay_sec"], d["alert_type"]) for d in delays) == [
        ("V1", 700, "DELAY"), ("V2", 700, "DELAY")]
    pairs = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "bunching-alerts")).collect()]
    assert [(p["vehicle_id_a"], p["vehicle_id_b"], p["distance_m"]) for p in pairs] == [("V1", "V2", 0.0)]
    assert spark.read.parquet(str(tmp_path / "bronze")).count() == 2
