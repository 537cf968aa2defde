"""Dated runs: what they read, what they publish, and what a crash leaves."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from conftest import positions_frame, rows
from pyspark.sql import functions as F

from headway.operators import clean, kpis, quality
from headway.plans import incremental, layers
from headway.sinks import lake as sinks, published
from headway.sources import lake

START = datetime(2024, 1, 1, 8, tzinfo=timezone.utc)


def month(days, seed=1, **more):
    r = random.Random(seed)
    return [dict(vehicle_id=f"V{r.randrange(5)}", route_id=f"R{r.randrange(3)}", entity_id=f"{d}-{n}",
                 speed_mps=r.choice([0.0, 0.3, 2.5, 7.1, 7.2, r.uniform(0, 30)]), ingested_at=n,
                 event_ts=START + timedelta(days=d, seconds=r.randrange(50000))) | more
            for d in days for n in range(40)]


def land(spark, folder, data):
    sinks.overwrite_partitions(sinks.bronze_rows(positions_frame(spark, data)), folder, *sinks.LAKE_PARTITIONS)


def plain(table):
    return rows(table.drop("updated_at").select(*sorted(c for c in table.columns if c != "updated_at")))


def test_counts_of_parts_add_up(spark):
    silver = clean.silver(positions_frame(spark, month(range(3))))
    whole = kpis.daily(kpis.partials(silver))
    early = F.hour("event_ts") < 14
    parts = kpis.partials(silver.where(early)).unionByName(kpis.partials(silver.where(~early)))
    assert plain(kpis.daily(kpis.merged(parts))) == plain(whole)
    assert plain(kpis.with_windows(whole)) == plain(kpis.gold(silver))
    assert kpis.daily(kpis.partials(silver.limit(0))).count() == 0


def test_dated_runs_equal_a_whole_one(spark, tmp_path):
    bronze, root = str(tmp_path / "bronze"), str(tmp_path / "lake")
    land(spark, bronze, month(range(10)))
    incremental.run(spark, bronze, root, ["2024-01-01", "2024-01-02", "2024-01-03"])
    assert incremental.read(spark, root, "gold").select("ingestion_date").distinct().count() == 3
    incremental.run(spark, bronze, root, [f"2024-01-{d:02d}" for d in range(4, 11)])
    land(spark, bronze, month([1], seed=2))
    report = incremental.run(spark, bronze, root, ["2024-01-02"])
    assert report.agg(F.sum("failures")).first()[0] == 0
    want = kpis.gold_from_bronze(lake.bronze(spark, bronze))
    assert plain(incremental.read(spark, root, "gold")) == plain(want)
    assert incremental.read(spark, root, "silver").count() == clean.silver(lake.bronze(spark, bronze)).count()
    incremental.run(spark, bronze, root)
    assert plain(incremental.read(spark, root, "gold")) == plain(want)
    assert len(published.vacuum(spark, root, incremental.LAYERS, keep=1)) == 12
    assert plain(incremental.read(spark, root, "gold")) == plain(want)


def test_a_dated_run_reads_its_dates_only(spark, tmp_path):
    bronze, root = str(tmp_path / "bronze"), str(tmp_path / "lake")
    land(spark, bronze, month(range(3)))
    part = layers.silver_part(lake.bronze(spark, bronze), ["2024-01-02"])
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ingestion_date" in plan or "PartitionFilters: [(ingestion_date" in plan
    incremental.run(spark, bronze, root, ["2024-01-01", "2024-01-03"])
    for gone in (tmp_path / "bronze").glob("*/ingestion_date=2024-01-0[13]/*"):
        gone.unlink()  # Only the run's own date is left to read.
    incremental.run(spark, bronze, root, ["2024-01-02"])
    dates = incremental.read(spark, root, "gold").select("ingestion_date").distinct()
    assert rows(dates) == [("2024-01-01",), ("2024-01-02",), ("2024-01-03",)]
    one = published.dated(spark, root, "daily", incremental.read(spark, root, "daily").schema, {"2024-01-02": "x"})
    assert "PartitionFilters" in one._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("where", ["gold", "publish", "check"])
def test_a_crash_leaves_the_tables_as_they_were(spark, tmp_path, monkeypatch, where):
    bronze, root = str(tmp_path / "bronze"), str(tmp_path / "lake")
    land(spark, bronze, month(range(2)))
    incremental.run(spark, bronze, root)
    before = {layer: plain(incremental.read(spark, root, layer)) for layer in incremental.LAYERS}
    land(spark, bronze, month([1], seed=3) + (month([4], feed="other") if where == "check" else []))

    def crash(*args, **kwargs):
        if where == "publish" or args[2] == "gold":
            raise OSError("lost")
        return written(*args, **kwargs)

    written = published.write_run
    with monkeypatch.context() as patch:
        if where != "check":
            patch.setattr(published, "write_run" if where == "gold" else "publish", crash)
        with pytest.raises((OSError, quality.ExpectationFailed)):
            incremental.run(spark, bronze, root, run_id="again")
    assert {layer: plain(incremental.read(spark, root, layer)) for layer in incremental.LAYERS} == before
    if where != "check":
        incremental.run(spark, bronze, root, run_id="again")
        assert plain(incremental.read(spark, root, "gold")) == plain(kpis.gold_from_bronze(lake.bronze(spark, bronze)))


def test_two_runs_at_once_cannot_both_publish(spark, tmp_path):
    root = str(tmp_path / "lake")
    assert published.in_force(spark, root) == (0, {})
    assert published.publish(spark, root, 0, {"gold": "a", "dates": {}}) == 1
    with pytest.raises(RuntimeError, match="another run"):
        published.publish(spark, root, 0, {"gold": "b", "dates": {}})
    assert published.in_force(spark, root) == (1, {"gold": "a", "dates": {}})
