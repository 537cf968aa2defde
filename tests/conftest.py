import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from headway.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "6g", "headway-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def positions_frame(spark, data):
    """Positions from dicts; whatever is missing gets a plain default."""
    from headway import schemas
    from datetime import datetime, timezone

    def full(i, row):
        base = {"entity_id": f"e{i:04d}", "vehicle_id": "V1", "route_id": "R1", "trip_id": "T1",
                "latitude": 12.95, "longitude": 77.55, "bearing": 0.0, "speed_mps": 5.0,
                "current_status": "IN_TRANSIT_TO", "feed": "bmtc", "ingested_at": i,
                "event_ts": datetime(2024, 1, 1, 8, tzinfo=timezone.utc)}
        base.update(row)
        ts = base["event_ts"]
        base.setdefault("ingestion_date", ts.strftime("%Y-%m-%d") if ts else None)
        return tuple(base[f] for f in schemas.BRONZE_POSITION.fieldNames())

    return spark.createDataFrame([full(i, r) for i, r in enumerate(data)], schemas.BRONZE_POSITION)
