from datetime import date, timedelta

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from headway.operators import features, model
from headway.sinks import lake as sinks
from headway.sources import lake


def panel(spark, days, feed="bmtc", nulls=()):
    data = []
    for route, n in days.items():
        for i in range(n):
            day = (date(2024, 1, 1) + timedelta(days=i)).isoformat()
            am = None if (route, i) in nulls else 10.0 + i
            data.append((route, feed, day, 20.0 + i, am, 30.0, 5.0, 50.0, 80.0 - i, 3 + i, 40 + i))
    columns = ", ".join(f"{c} {'string' if c in ('route_id', 'feed', 'ingestion_date') else 'bigint' if c in ('unique_vehicles', 'total_observations') else 'double'}"
                        for c in features.GOLD_INPUT)
    return spark.createDataFrame(data, columns)


def test_input_filter_and_summary(spark):
    gold = panel(spark, {"R1": 3, "UNKNOWN": 2, "R2": 1}).withColumn("other", F.lit(1))
    kept = features.gold_input(gold)
    assert kept.columns == list(features.GOLD_INPUT)
    assert tuple(features.input_summary(kept).first()) == (4, "2024-01-01", "2024-01-03", 2, 1)


def test_median_fill_uses_the_whole_table(spark):
    frame = panel(spark, {"R1": 4}, nulls={("R1", 3)})
    filled = {r.ingestion_date: r.avg_speed_am_peak_kmh for r in features.fill_with_medians(frame).collect()}
    assert filled["2024-01-04"] == 11.0 and filled["2024-01-01"] == 10.0


def test_engineering(spark):
    frame = panel(spark, {"R2": 5, "R10": 3, "R3": 2}).unionByName(panel(spark, {"R2": 4}, "namma_metro"))
    frame = frame.unionByName(panel(spark, {"R2": 3}, "elsewhere"))
    out = features.engineer(frame)
    assert out.groupBy("route_id", "feed").count().count() == 4  # two days of history needed
    assert {(r.route_id, r.route_encoded) for r in out.collect()} == {("R10", 0), ("R2", 1)}
    assert {(r.feed, r.feed_encoded) for r in out.collect()} == {("bmtc", 0), ("namma_metro", 1), ("elsewhere", 0)}
    last = out.where("route_id = 'R2' and feed = 'bmtc' and ingestion_date = date'2024-01-05'").first()
    assert (last.lag_1_speed, last.lag_2_speed, last.lag_3_speed) == (23.0, 22.0, 21.0)
    assert (last.speed_momentum, last.rolling_7d_speed) == (1.0, 22.0)
    assert (last.day_of_week, last.is_weekend) == (4, 0)
    first = out.where("route_id = 'R10'").first()
    assert first.lag_3_speed is None
    assert first.day_sin == pytest.approx(np.sin(2 * np.pi * 2 / 7))


def ready(spark, days):
    return features.engineer(panel(spark, {r: n + 2 for r, n in days.items()}))


def test_sequences_need_one_day_more_than_their_length(spark):
    out = features.sequences(ready(spark, {"R1": 7, "R2": 8, "R3": 10}))
    assert rows(out.groupBy("route_id").count()) == [("R2", 1), ("R3", 3)]
    sample = out.where("route_id = 'R2'").first()
    x = np.array(sample.x, dtype=float)
    assert x.shape == (7, 17)
    assert x[:, 0].tolist() == [22.0, 23.0, 24.0, 25.0, 26.0, 27.0, 28.0] and sample.target_speed_kmh == 29.0


def test_usable_length(spark):
    assert [features.usable_length(ready(spark, {"R1": n})) for n in (1, 2, 5, 8, 12)] == [1, 1, 4, 7, 7]


def test_scaling_against_numpy(spark):
    samples = features.sequences(ready(spark, {"R1": 12, "R2": 9}))
    params = features.scaler_params(samples)
    scaled = features.scale(samples, params).orderBy("route_id", "date").collect()
    x = np.array([r.x for r in scaled], dtype=np.float32)
    y = np.array([r.target_speed_kmh for r in scaled], dtype=np.float32)
    low, high = np.nanmin(x, axis=(0, 1)), np.nanmax(x, axis=(0, 1))
    span = np.where(high - low == 0, 1, high - low)
    found = np.array([[[np.nan if v is None else v for v in step] for step in r.x_scaled] for r in scaled])
    assert np.allclose(found, (x - low) / span, atol=1e-6, equal_nan=True)
    assert np.all(found[:, :, features.FEATURES.index("feed_encoded")] == 0)  # constant feature
    assert np.allclose([r.target_scaled for r in scaled], (y - y.min()) / (y.max() - y.min()), atol=1e-6)
    back = features.unscale_target(F.col("target_scaled"), float(y.min()), float(y.max()))
    again = [r[0] for r in features.scale(samples, params).orderBy("route_id", "date").select(back).collect()]
    assert np.allclose(again, y, atol=1e-4)
    assert features.scaler_table(params).count() == 17


def test_feature_store_round_trip(spark, tmp_path):
    samples = features.sequences(ready(spark, {"R1": 10}))
    params = features.scaler_params(samples)
    scaled = features.scale(samples, params)
    sinks.save_feature_store(scaled, params, str(tmp_path))
    read, scaler = lake.feature_store(spark, str(tmp_path))
    assert read.count() == 3 and set(read.columns) == set(scaled.columns)
    row = scaler.first()
    assert row.seq_len == 7 and row.feature_cols == list(features.FEATURES)
    assert row.x_min[0] == 22.0
    assert features.scale(read.drop("x_scaled", "target_scaled"), scaler).count() == 3


@pytest.mark.parametrize("kind", ["linear", "gbt"])
def test_training_scoring_and_record(spark, tmp_path, kind):
    samples = features.sequences(ready(spark, {f"R{i}": 20 for i in range(4)}))
    params = features.scaler_params(samples)
    scaled = model.with_split(features.scale(samples, params)).persist()
    fitted = model.train(scaled, kind)
    scored = model.score(fitted, scaled, params)
    assert scored.count() == samples.count()
    metrics = model.error_metrics(scored, "target_speed_kmh", "predicted_speed_kmh").first()
    assert metrics.rmse < 3.0 and metrics.mae <= metrics.rmse
    record = model.model_record(spark, "speed", "1", "Production", str(tmp_path / "model"))
    model.save_best(fitted, str(tmp_path / "model"), record, str(tmp_path / "registry"))
    assert spark.read.parquet(str(tmp_path / "registry")).first().version == "1"
    from pyspark.ml import PipelineModel
    again = model.score(PipelineModel.load(str(tmp_path / "model")), scaled, params)
    assert rows(again.select("predicted_speed_kmh")) == rows(scored.select("predicted_speed_kmh"))
    scaled.unpersist()


def test_split_is_repeatable(spark):
    samples = features.sequences(ready(spark, {f"R{i}": 30 for i in range(10)}))
    first, second = (rows(model.with_split(s).select("route_id", "date", "split"))
                     for s in (samples, samples.repartition(7)))
    assert first == second
    counts = dict(rows(model.split_counts(samples)))
    assert 0.05 < counts["validation"] / sum(counts.values()) < 0.3


def test_unknown_model(spark):
    with pytest.raises(ValueError):
        model.regressor("other")


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 0.0)], "a double, p double")
    assert tuple(model.error_metrics(df, "a", "p").first()) == (pytest.approx(5 ** 0.5, abs=1e-4), 2.0, 2)
