"""Suppression by parallels: crowded cells are settled as cells."""

import random
from datetime import datetime, timedelta

import duckdb

from wayfold.operators import grid
from wayfold.plans import trajectories
from wayfold.plans.catalogue import ORACLE


def test_crowded_cells_are_settled_without_comparing_their_samples(spark, tmp_path, monkeypatch):
    """Many lines along each other: hardly a sample goes on to be compared, and the masked runs are those of the SQL."""
    r, began, rows = random.Random(3), datetime(2024, 1, 1), []
    for user in range(60):
        for n in range(12):
            rows.append((user * 100 + n, began + timedelta(hours=30 * n, seconds=r.randint(0, 3600)), user, "view", r.uniform(100, 103) if user < 45 else r.uniform(0, 900), "{}"))
    rows += [(9000 + n, began + timedelta(hours=30 * n), 60, "view", float("nan") if n == 4 else 101.0, "{}") for n in range(8)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * replace (ts::timestamp as ts) from '{tmp_path}/events.parquet/*.parquet' where user_id < 60")
    want = sorted(tuple(x) for x in con.sql(ORACLE["parallel_suppression"]).fetchall())
    met, near = [], grid.near_blocks
    monkeypatch.setattr(grid, "near_blocks", lambda points, *rest, **named: met.append(points) or near(points, *rest, **named))
    found = sorted(tuple(x) for x in trajectories.parallel_suppression(spark, str(tmp_path)).where("user_id < 60").select("user_id", "start", "end").collect())
    every = met[0].sparkSession.read.parquet(f"{tmp_path}/events.parquet").where("user_id < 45").count()
    assert found == want and len(want) > 15
    assert met[0].where("user_id < 45").count() < every / 4
    for cells in (0, 1 << 16):  # sizes sent to all tasks, or shuffled
        monkeypatch.setattr(grid, "CELLS", cells)
        assert sorted(tuple(x) for x in trajectories.parallel_suppression(spark, str(tmp_path)).where("user_id < 60").select("user_id", "start", "end").collect()) == want
