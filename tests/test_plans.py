"""Range joins, order statistics and sessions against brute force, hot keys included."""

import math
import random
import statistics
from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
import pytest
from conftest import positions_frame, rows
from pyspark.sql import functions as F

from headway.functions import geo, times
from headway.operators import alerts, explore, state
from headway.plans import asof, packs
from headway.plans.ordered import exact_median, ordinal_codes
from headway.plans.rangejoin import interval_join, measured_slices
from headway.plans.sessions import gap_sessions

START = datetime(2024, 1, 1, 8, tzinfo=timezone.utc)


def meters(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    h = (math.sin((p2 - p1) / 2) ** 2
         + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2)
    return 2 * geo.EARTH_RADIUS_M * math.asin(math.sqrt(min(1.0, h)))


@pytest.mark.parametrize("centre", [(12.95, 77.55), (0.0, 179.9999), (-65.0, -180.0), (89.99, 10.0),
                                    (-90.0, 0.0), (51.5, 0.0)])
def test_grid_cover_finds_every_point_in_the_radius(spark, centre):
    rng = random.Random(7)

    def scatter(n):
        out = []
        for _ in range(n):
            lat = max(-90.0, min(90.0, centre[0] + rng.uniform(-0.02, 0.02)))
            spread = min(180.0, 0.02 / max(math.cos(math.radians(lat)), 1e-4))
            lon = (centre[1] + rng.uniform(-spread, spread) + 180.0) % 360.0 - 180.0
            out.append((lat, lon))
        return out

    left, right = scatter(60), scatter(60)
    a = spark.createDataFrame([(i, *p) for i, p in enumerate(left)], "i int, lat double, lon double")
    b = spark.createDataFrame([(j, *p) for j, p in enumerate(right)], "j int, lat double, lon double")
    a = geo.with_cell(a, "lat", "lon", 1000.0)
    b = geo.with_cover(b, "lat", "lon", 500.0, 1000.0).withColumnsRenamed({"lat": "lat2", "lon": "lon2"})
    met = a.join(b, ["_band", "_cell"])
    assert met.count() == met.select("i", "j").distinct().count()  # each pair meets once
    near = met.where(geo.haversine_m(*[F.col(c) for c in ("lat", "lon", "lat2", "lon2")]) < 500.0)
    expected = {(i, j) for i, p in enumerate(left) for j, q in enumerate(right) if meters(p, q) < 500}
    assert {(r.i, r.j) for r in near.select("i", "j").collect()} == expected


@pytest.mark.parametrize("slices", [1, 3])
def test_interval_join_equals_brute_force_on_a_hot_key(spark, slices):
    rng = random.Random(3)
    a = [(i, "hot" if rng.random() < 0.4 else f"k{rng.randrange(5)}", rng.randrange(0, 4000))
         for i in range(300)]
    b = [(j, "hot" if rng.random() < 0.4 else f"k{rng.randrange(5)}", rng.randrange(0, 4000))
         for j in range(300)]
    left = spark.createDataFrame(a, "i int, ka string, sa long").withColumn("ta", F.timestamp_seconds("sa"))
    right = spark.createDataFrame(b, "j int, kb string, sb long").withColumn("tb", F.timestamp_seconds("sb"))
    out = interval_join(left, right, [("ka", "kb")], "ta", "tb", 90, slices=slices)
    expected = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and abs(x[2] - y[2]) <= 90)
    assert sorted((r.i, r.j) for r in out.select("i", "j").collect()) == expected


def test_bunching_rules_at_their_bounds(spark):
    step = 499.0 * geo.DEG_PER_M
    data = [
        dict(vehicle_id="A", event_ts=START),
        dict(vehicle_id="B", event_ts=START + timedelta(seconds=90), latitude=12.95 + step),
        dict(vehicle_id="C", event_ts=START + timedelta(seconds=90, milliseconds=1)),
        dict(vehicle_id="D", event_ts=START - timedelta(seconds=60), latitude=12.95 - 501 * geo.DEG_PER_M),
        dict(vehicle_id="E", event_ts=START, route_id=None),
        dict(vehicle_id="F", event_ts=START, route_id="UNKNOWN"),
        dict(vehicle_id="G", event_ts=START, latitude=None),
        dict(vehicle_id="H", event_ts=START, route_id="R2"),
    ]
    found = alerts.bunching_alerts(positions_frame(spark, data)).collect()
    assert {(r.vehicle_id_a, r.vehicle_id_b) for r in found} == {("A", "B"), ("B", "C")}
    pair = next(r for r in found if r.vehicle_id_a == "A")
    assert pair.distance_m == pytest.approx(499.0, abs=0.01)
    assert pair.window_end - pair.window_start == timedelta(seconds=90)


def test_bunching_equals_brute_force_with_copies(spark):
    rng = random.Random(11)
    data = []
    for _ in range(250):
        row = dict(vehicle_id=f"V{rng.randrange(8)}", route_id="R1" if rng.random() < 0.6 else "R2",
                   latitude=12.95 + rng.uniform(0, 0.03), longitude=77.55 + rng.uniform(0, 0.03),
                   event_ts=START + timedelta(seconds=rng.randrange(0, 1200)))
        data += [row] * (4 if rng.random() < 0.2 else 1)
    frame = positions_frame(spark, data)
    pairs, members = [], set()
    for a in data:
        for b in data:
            if (a["route_id"] == b["route_id"] and a["vehicle_id"] < b["vehicle_id"]
                    and abs((a["event_ts"] - b["event_ts"]).total_seconds()) <= 90
                    and meters((a["latitude"], a["longitude"]), (b["latitude"], b["longitude"])) < 500):
                pairs.append((a["vehicle_id"], b["vehicle_id"], a["event_ts"].timestamp(),
                              b["event_ts"].timestamp()))
                members |= {(x["vehicle_id"], x["event_ts"].timestamp()) for x in (a, b)}
    seconds = [F.unix_seconds(c).cast("double") for c in ("window_start", "window_end")]
    found = alerts.bunching_alerts(frame).select("vehicle_id_a", "vehicle_id_b", *seconds)
    assert sorted(tuple(r) for r in found.collect()) == sorted(pairs)
    flagged = alerts.bunched_vehicles(frame).select("vehicle_id", F.unix_seconds("event_ts").cast("double"))
    assert {tuple(r) for r in flagged.collect()} == members


def test_bunching_meets_ranges_and_not_rows(spark):
    frame = positions_frame(spark, [dict(vehicle_id=f"V{i}") for i in range(40)])
    found = alerts.bunching_alerts(frame.union(frame), window_s=900)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan
    assert found.count() == 4 * 40 * 39 // 2


@pytest.mark.parametrize("fresh", [False, True])
def test_packs_equal_brute_force_across_their_bounds(monkeypatch, fresh):
    for name, value in (("PACK_ROWS", 7), ("PACK_CANDIDATES", 40), ("STEP", 11)):
        monkeypatch.setattr(packs, name, value)
    rng, width, tolerance = random.Random(4), 360, 90
    data = []
    for i in range(400):
        at, left = rng.randrange(0, 2000), rng.random() < 0.5
        for k in [at // width] if left else range((at - tolerance) // width, (at + tolerance) // width + 1):
            data.append(dict(left=left, key=f"R{i % 2}", k1=k, at=at * 10**6, id=f"V{i % 60}", n=1, i=i,
                             lat=12.95 + rng.choice([0.0, 0.004]), lon=77.55))
    rng.shuffle(data)
    origin = times.BUCKET_ORIGIN_SECONDS * 10**6
    table = pa.Table.from_pylist([d | dict(at=d["at"] + origin) for d in data]).sort_by("at")
    table = table.append_column("fresh", pa.array([i % 3 == 0 for i in range(len(table))]))
    table = packs._grouped(table, ["key", "k1"])
    new = table["fresh"].to_numpy().astype(bool) if fresh else None
    made = list(packs._packed(table, ["key", "k1"], tolerance, width, new))
    assert len(made) > 50
    found = sorted((a["id"][int(i)].as_py(), b["id"][int(j)].as_py(), a["at"][int(i)].as_py(), b["at"][int(j)].as_py())
                   for pack in made for a, b, left, right, _ in packs._pairs(pack, 300.0)
                   for i, j in zip(left, right))
    rows_ = table.to_pylist()
    expected = sorted((a["id"], b["id"], a["at"], b["at"]) for a in rows_ for b in rows_
                      if a["left"] and not b["left"] and (a["key"], a["k1"]) == (b["key"], b["k1"]) and a["id"] < b["id"]
                      and abs(a["at"] - b["at"]) <= tolerance * 10**6 and a["lat"] == b["lat"]
                      and (not fresh or a["fresh"] or b["fresh"]))
    assert found == expected and len(found) > 100
    assert [int(i) for part in packs._repeated(np.array([3, 1, 20, 2])) for i in part] == [0] * 3 + [1] + [2] * 20 + [3] * 2


def test_millimetres_round_half_up(spark):
    from headway.registry.realtime import rounded

    values = [0.0, 0.0005, 0.00049999999999999994, 1.0015, 499.9995, 123.4565, 0.1235, 17.0, None] + [
        random.Random(n).uniform(0, 500) for n in range(300)]
    frame = spark.createDataFrame([(v,) for v in values], "distance_m double")
    same = rounded(frame.withColumn("was", F.round(F.col("distance_m") * 1000) / 1000))
    assert same.where("NOT (distance_m <=> was)").count() == 0


def test_delay_join_bounds_and_copies(spark):
    positions = positions_frame(spark, [
        dict(vehicle_id="A", event_ts=START), dict(vehicle_id="A", event_ts=START),
        dict(vehicle_id="B", event_ts=START + timedelta(seconds=120)),
        dict(vehicle_id="C", event_ts=START + timedelta(seconds=121)),
        dict(vehicle_id="D", event_ts=START, trip_id=None)])
    updates = spark.createDataFrame(
        [("T1", "R1", "S1", 121, START), ("T1", "R1", "S2", -121, START), ("T1", "R1", "S3", 120, START),
         ("T1", "R1", "S4", None, START), ("T2", "R1", "S1", 900, START), (None, "R1", "S1", 900, START)],
        "trip_id string, route_id string, stop_id string, arrival_delay int, event_ts timestamp")
    out = alerts.delay_alerts(positions, updates)
    assert rows(out.select("vehicle_id", "delay_sec", "alert_type")) == sorted(
        [("A", 121, "DELAY"), ("A", -121, "EARLY")] * 2 + [("B", 121, "DELAY"), ("B", -121, "EARLY")], key=repr)
    assert rows(alerts.one_alert_per_trip(out).select("vehicle_id", "delay_sec")) == [("A", 121), ("B", 121)]


def test_exact_median_with_a_group_holding_most_rows(spark):
    rng = np.random.default_rng(5)
    groups = {"hot": np.concatenate([rng.gamma(2.0, 3.0, 4001), np.zeros(3000)]),
              "even": np.array([1.0, 2.0, 10.0, 4.0]), "one": np.array([7.5]),
              "negative": np.array([-3.0, -1.0, 0.0, 2.0, -500.0]), "same": np.full(50, 3.25)}
    data = [(g, float(v)) for g, values in groups.items() for v in values] + [("one", None), ("none", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(8)
    found = {r.g: r.m for r in exact_median(df, ["g"], "v", "m").collect()}
    assert found == {g: statistics.median(v.tolist()) for g, v in groups.items()}


def test_ordinal_codes_follow_the_sorted_order(spark):
    names = [f"R{i}" for i in range(120)] + ["Ä", "a", "", "R1"]
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "route_id string")
    found = {r.route_id: r.code for r in ordinal_codes(df, "route_id", "code").collect()}
    assert found == {n: i for i, n in enumerate(sorted(set(names), key=lambda s: s.encode()))}


def test_ordinal_codes_spread_ids_with_a_common_start(spark):
    ids = spark.range(3000).select(F.format_string("route-of-the-city-%05d", "id").alias("route_id"))
    codes = ordinal_codes(ids.union(ids.limit(50)), "route_id", "code")
    assert codes.where("code <> cast(right(route_id, 5) AS int)").count() == 0 and codes.count() == 3000
    ranges = codes.select("route_id", (F.col("code") / 750).cast("int").alias("part"))
    assert ranges.select("part").distinct().count() == 4
    plan = codes._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan  # The ranges are written; nothing samples them twice.


@pytest.mark.parametrize("gap", [90, 600])
def test_gap_sessions_equal_brute_force(spark, gap):
    rng = random.Random(gap)
    data = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(4)}", f"v{rng.randrange(6)}",
             rng.randrange(0, 20_000)) for _ in range(400)]
    data += [("edge", "v1", 0), ("edge", "v2", gap), ("edge", "v1", 2 * gap + 1), (None, "v1", 5)]
    df = spark.createDataFrame(data, "k string, m string, s long").withColumn("ts", F.timestamp_seconds("s"))
    expected = {}
    for key in {d[0] for d in data if d[0]}:
        events = sorted((s, m) for k, m, s in data if k == key)
        current = []
        for s, m in events + [(10**9, "")]:
            if current and s - current[-1][0] > gap:
                for member in {c[1] for c in current}:
                    expected[(key, current[0][0], current[-1][0] + gap, member)] = sum(
                        1 for c in current if c[1] == member)
                current = []
            current.append((s, m))
    out = gap_sessions(df, "k", "m", "ts", gap)
    found = {(r.k, r.a, r.b, r.m): r.observations for r in out.select(
        "k", F.unix_seconds("session_start").alias("a"), F.unix_seconds("session_end").alias("b"), "m",
        "observations").collect()}
    assert found == expected


def test_nearest_stop_and_route_deviation(spark):
    rng = random.Random(2)
    here = [dict(vehicle_id=f"V{i}", latitude=12.95 + rng.uniform(-0.02, 0.02),
                 longitude=77.55 + rng.uniform(-0.02, 0.02),
                 route_id="R1" if i % 3 else "R9") for i in range(80)]
    stops = [(f"S{i}", 12.95 + rng.uniform(-0.02, 0.02), 77.55 + rng.uniform(-0.02, 0.02)) for i in range(25)]
    frame = positions_frame(spark, here)
    stop_frame = spark.createDataFrame(stops, "stop_id string, stop_lat double, stop_lon double")
    found = {r.entity_id: r.stop_id for r in explore.nearest_stop(frame, stop_frame, 100.0).collect()}
    assert len(found) == len(here)
    for i, p in enumerate(here):
        d, s = min((meters((p["latitude"], p["longitude"]), (b, c)), a) for a, b, c in stops)
        assert found[f"e{i:04d}"] == s

    shape = spark.createDataFrame([("R1", 12.95, 77.55 + i * 0.001) for i in range(10)],
                                  "route_id string, shape_pt_lat double, shape_pt_lon double")
    out = {r.entity_id: r for r in explore.route_deviation(frame, shape, 200.0, 600.0).collect()}
    assert set(out) == {f"e{i:04d}" for i in range(len(here))}
    for i, p in enumerate(here):
        row = out[f"e{i:04d}"]
        if p["route_id"] == "R1":  # Beyond the search radius too.
            d = min(meters((p["latitude"], p["longitude"]), (12.95, 77.55 + j * 0.001)) for j in range(10))
            assert row.is_deviation == (d > 200)
            assert row.distance_m == pytest.approx(d, abs=0.01)
        else:
            assert row.distance_m is None and row.is_deviation is None
    twice = frame.union(frame)
    assert explore.nearest_stop(twice, stop_frame).count() == 2 * len(here)
    assert explore.route_deviation(twice, shape, 200.0, 10.0).where("distance_m > 10").count() > 0


def test_nearest_stop_at_any_distance(spark):
    stop_frame = spark.createDataFrame([("A", 12.95, 77.55), ("B", 12.95, 77.55), ("C", 60.0, 10.0),
                                        ("N", None, 1.0)], "stop_id string, stop_lat double, stop_lon double")
    here = [(12.95, 77.55), (14.0, 78.0), (0.0, 0.0), (-60.0, -170.0), (89.9, 0.0), (None, 77.0)]
    frame = positions_frame(spark, [dict(latitude=a, longitude=b) for a, b in here])
    found = {r.entity_id: (r.stop_id, r.distance_m) for r in explore.nearest_stop(frame, stop_frame).collect()}
    assert len(found) == len(here) and found["e0005"] == (None, None)
    for i, (lat, lon) in enumerate(here[:-1]):
        d, s = min((meters((lat, lon), p), s) for s, p in (("A", (12.95, 77.55)), ("C", (60.0, 10.0))))
        assert found[f"e{i:04d}"][0] == s and found[f"e{i:04d}"][1] == pytest.approx(d, abs=0.01)
    none = explore.nearest_stop(frame, stop_frame.where("stop_id = 'N'"))
    assert none.count() == len(here) and none.where("stop_id IS NOT NULL").count() == 0


def test_as_of_join_against_brute_force(spark):
    rng = random.Random(5)
    left = [(i, rng.choice("abc") if i % 9 else None, rng.randrange(4000) if i % 11 else None) for i in range(300)]
    left += left[:5]
    right = [(rng.choice("abd"), rng.randrange(4000), rng.choice([None, 1, 2, 3])) for _ in range(120)]
    stamp = F.timestamp_seconds("at")
    a = spark.createDataFrame(left, "id int, key string, at long").withColumn("at", stamp)
    b = spark.createDataFrame(right, "key string, at long, delay int").withColumn("at", stamp)
    out = asof.newest_before(a, b, "key", "at", "delay", "known").select("id", "known").collect()

    def known(key, at):
        before = [(t, d) for k, t, d in right if k == key and d is not None and at is not None and t <= at]
        return max(before)[1] if key and before else None

    assert sorted(map(tuple, out), key=repr) == sorted(((i, known(k, t)) for i, k, t in left), key=repr)


def test_snapshot_messages_hold_every_vehicle_once(spark):
    data = [dict(vehicle_id=f"V{i}", route_id="R1") for i in range(500)]
    live = state.latest_vehicle_state(positions_frame(spark, data)).select("vehicle_id", "route_id")
    messages = state.snapshot_messages(live, per_message=100).collect()
    assert len(messages) > 1 and sum(m.vehicles for m in messages) == 500
    import json
    bodies = [json.loads(m.body) for m in messages]
    assert {b["type"] for b in bodies} == {"snapshot"}
    assert len({v["vehicle_id"] for b in bodies for v in b["data"]}) == 500


def test_slices_do_not_grow_with_the_density(spark):
    def repeats(copies):
        history = spark.range(200 * copies).select(
            F.concat(F.lit("k"), F.when(F.col("id") % 5 < 2, 0).otherwise(F.col("id") % 20)).alias("key"),
            F.timestamp_seconds(F.col("id") % 200).alias("ts"))
        found = {r.key: r.slices for r in measured_slices(history, "key", "ts", 1000, rows_per_slice=2).collect()}
        counts = {r.key: r["count"] for r in history.groupBy("key").count().collect()}
        return sum(n * found.get(k, 1) for k, n in counts.items()) / (200 * copies), found["k0"]

    few, many = repeats(1), repeats(50)
    assert few == many and many[0] <= 4 and many[1] > 1
