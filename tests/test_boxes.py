"""Unions of upright rectangles by strips."""

import random
from datetime import datetime, timedelta
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from wayfold.plans import linework
from wayfold.plans.catalogue import ORACLE


def test_events_a_microsecond_apart_have_the_area_that_the_sql_has(spark, tmp_path):
    """Sides a few microseconds apart are sides of their own: areas here lie some 1e-9 beside the edge where the third digit turns."""
    rows, began = [], datetime(2024, 1, 3, 5)
    for user in range(120):
        for n, (late, up) in enumerate([(0, 0.0), (user % 5 + 1, 0.000125 * (user % 7 - 3))]):
            rows.append((user * 10 + 5 * n, began + timedelta(microseconds=late, hours=user % 3), user, "view", 100.0 + user / 100 + up, '{"k": 0}'))
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * replace (ts::timestamp as ts) from '{tmp_path}/events.parquet/*.parquet'")
    want = dict(con.sql(ORACLE["rectangle_union"]).fetchall())
    assert {r.key: r.area for r in linework.rectangle_union(spark, str(tmp_path)).collect()} == want and len(want) == 120


@pytest.mark.parametrize("portion", [7, 1 << 20])
def test_areas_equal_the_exact_sum_over_cells(spark, monkeypatch, portion):
    from wayfold.operators import boxes

    r = random.Random(portion)
    made = [(r.randint(0, 9), *(r.choice([1e6, 0.0]) + r.randint(0, 40) / 7 + r.choice([0.0, 3e-10]) for _ in range(2)), r.uniform(1, 9), r.uniform(1, 9)) for _ in range(150)]
    rows = [(k, w, s, w + dx, s + dy) for k, w, s, dx, dy in made]
    odd = [(3, 5.0, 5.0, 5.0, 9.0), (4, 1.0, None, 2.0, 2.0), (None, 1.0, 1.0, 2.0, 2.0), (99, 2.0, 1.0, 1.0, 2.0), (5, 1.0, float("nan"), 2.0, float("nan"))]
    want = {}
    for k in {x[0] for x in rows}:
        mine = [tuple(map(Fraction, x[1:])) for x in rows if x[0] == k]
        xs, ys = (sorted({x[i] for x in mine} | {x[i + 2] for x in mine}) for i in (0, 1))
        want[k] = float(sum((b - a) * (d - c) for a, b in zip(xs, xs[1:], strict=False) for c, d in zip(ys, ys[1:], strict=False) if any(w <= a and b <= e and s <= c and d <= n for w, s, e, n in mine)))
    names, found = boxes.union_areas(*(np.array(c) for c in zip(*rows, strict=True)))
    assert dict(zip(names.tolist(), found.tolist(), strict=True)) == pytest.approx(want, rel=1e-15, abs=1e-12)
    monkeypatch.setattr(boxes, "PORTION", portion)
    monkeypatch.setattr(boxes, "ROWS", 16)
    again = {x.key: x.area for x in boxes.areas(spark.createDataFrame(rows + odd, "key long, w double, s double, e double, n double"), "key").collect()}
    assert again == pytest.approx(want, rel=1e-15, abs=1e-12)
