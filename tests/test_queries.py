"""Every query with SQL against the SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from wayfold.plans import linework
from wayfold.plans.catalogue import ORACLE, QUERIES
from wayfold.plans.tables import POINTS, SEGMENTS, samples_sql
from wayfold.plans.trajectories import RADIUS, STEP

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(frame):
    clean = lambda v: None if v is None or pd.isna(v) else round(float(v), 6) + 0.0 if isinstance(v, float) else int(v) if hasattr(v, "item") and not isinstance(v, bool) else v
    names = sorted(frame.columns)
    return names, sorted((tuple(map(clean, r)) for r in frame[names].itertuples(index=False)), key=repr)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sql, name):
    assert rows(QUERIES[name](spark, FOLDER).toPandas()) == rows(sql.sql(ORACLE[name]).df())


def test_quantised_steps_are_products_of_floats(spark, tmp_path):
    """0.3195 as a float times a thousand is 319.5 as a float, and less as a double."""
    spark.sql("SELECT 1L AS vec_id, array(cast(0.001 AS float), cast(0.3195 AS float)) AS embedding, 0 AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = QUERIES["delta_decode"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert rows(found) == rows(con.sql(ORACLE["delta_decode"]).df()) and found["y"][0] == 38.2


def between(ax, ay, bx, by):
    """Angle of two directions whichever way they point, in degrees; 90 without length."""
    whole = math.hypot(ax, ay) * math.hypot(bx, by)
    return 90.0 if whole == 0 else math.degrees(math.acos(min(1.0, abs(ax * bx + ay * by) / whole)))


def far(px, py, x1, y1, x2, y2):
    dx, dy = x2 - x1, y2 - y1
    whole = dx * dx + dy * dy
    t = 0.0 if whole == 0 else max(0.0, min(1.0, ((px - x1) * dx + (py - y1) * dy) / whole))
    return math.hypot(px - x1 - t * dx, py - y1 - t * dy)


@pytest.fixture(scope="module")
def matched(sql):
    """The first half of the matcher, sample by sample, in plain Python: owners, runs, gaps and coverage."""
    segs = sql.sql(f"WITH {SEGMENTS} SELECT user_id, x1, y1, x2, y2 FROM segs").fetchall()
    kind = dict(sql.sql(f"WITH {POINTS} SELECT user_id, least(3, CAST(floor(min(x) / 4) AS INTEGER) + 1) FROM pts GROUP BY user_id").fetchall())
    samples = {(u, s): (x, y, tx, ty) for u, s, x, y, tx, ty in sql.sql(f"WITH {samples_sql(STEP)} SELECT user_id, sample, x, y, tx, ty FROM samples").fetchall()}
    parts = sorted({u for u, _ in samples})
    owners = {}
    for part in parts:
        mine = sorted(s for u, s in samples if u == part)
        cost = {}
        for s in mine:
            x, y, tx, ty = samples[(part, s)]
            for edge, x1, y1, x2, y2 in segs:
                if edge != part and far(x, y, x1, y1, x2, y2) <= RADIUS and (angle := between(tx, ty, x2 - x1, y2 - y1)) <= 55:
                    cost[(s, edge)] = min(cost.get((s, edge), math.inf), far(x, y, x1, y1, x2, y2) + 0.2 * angle)
        owned = {}
        for c in (1, 2, 3):
            here = {s: [(v, e) for (t, e), v in cost.items() if t == s and kind[e] == c] for s in mine}
            picked, last = {}, None
            for s in range(mine[-1] + 1):
                if s in owned or not here.get(s):
                    last = None
                else:
                    last = picked[s] = min((v - (2.0 if e == last else 0.0), e) for v, e in here[s])[1]
            for s, e in picked.items():
                lo = hi = s
                while picked.get(lo - 1) == e:
                    lo -= 1
                while picked.get(hi + 1) == e:
                    hi += 1
                if hi - lo + 1 >= 3:
                    owned[s] = e
        owners[part] = owned
    masked = {p: {s for s, e in owners[p].items() if any(q != p and kind[o[t]] < kind[e] and math.dist(samples[(p, s)][:2], samples[(q, t)][:2]) <= 5 and between(*samples[(p, s)][2:], *samples[(q, t)][2:]) <= 55 for q, o in owners.items() for t in o)} for p in parts}
    out = {"runs": [], "gaps": [], "coverage": []}
    for part in parts:
        gone = set()
        for s in masked[part]:
            lo = hi = s
            while lo - 1 in masked[part]:
                lo -= 1
            while hi + 1 in masked[part]:
                hi += 1
            if hi - lo + 1 >= 6:
                gone.add(s)
        owned = {s: e for s, e in owners[part].items() if s not in gone}
        healed, fills = dict(owned), {}
        for e in set(owned.values()):
            at = sorted(s for s in owned if owned[s] == e)
            for a, b in zip(at, at[1:], strict=False):
                if 1 <= b - a - 1 <= 2:
                    for s in range(a + 1, b):
                        fills[s] = max(fills.get(s, (-1, -1)), (a, e))
        healed |= {s: e for s, (_, e) in fills.items() if (part, s) in samples}
        runs = []
        for s in sorted(healed):
            if runs and runs[-1][0] == healed[s] and runs[-1][2] == s:
                runs[-1][2] = s + 1
            else:
                runs.append([healed[s], s, s + 1])
        rows = [(part, k, e, kind[e], a, b, max(0.0, a * STEP - STEP / 2), (b - 1) * STEP + STEP / 2) for k, (e, a, b) in enumerate(sorted(runs, key=lambda r: (r[1], r[0])), 1)]
        out["runs"] += rows
        order = sorted(rows, key=lambda r: (r[6] + r[7], r[1]))
        for a, b in zip(order, order[1:], strict=False):
            size = max(0.0, b[6] - a[7])
            out["gaps"].append((part, a[1], a[2], a[7], b[2], b[6], size, "accepted-same-source-range" if a[2] == b[2] else "unresolved-gap-too-long" if size > 300 else "accepted-direct-source-junction" if size <= 1e-9 else "open"))
        n = sum(u == part for u, _ in samples)
        out["coverage"].append((part, n, len(healed), round(100 * len(healed) / n, 3)))
    return out


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("match_runs", ["part", "run", "owner", "class", "start", "end", "from_m", "to_m"]),
        ("match_gaps", ["part", "run", "owner", "to_m", "next_owner", "next_from", "gap_m", "decision"]),
        ("match_coverage", ["part", "n_samples", "n_owned", "covered_pct"]),
    ],
)
def test_matcher_equals_a_walk_over_the_samples(spark, matched, name, columns):
    found = sorted(tuple(r) for r in QUERIES[name](spark, FOLDER).select(*columns).collect())
    assert found == sorted(matched[name.removeprefix("match_")]) and found


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_labels_take_the_first_anchor_that_is_free(spark):
    rows = [r.asDict() for r in linework._anchors(spark, FOLDER).collect()]
    taken, want = {}, set()
    for user in sorted({r["user_id"] for r in rows}):
        boxes = taken.setdefault(user // 20, [])
        for r in sorted((r for r in rows if r["user_id"] == user), key=lambda r: r["anchor"]):
            box = (r["x"] - r["w"] / 2, r["y"] - r["h"] / 2, r["x"] + r["w"] / 2, r["y"] + r["h"] / 2)
            if all(box[2] <= b[0] or b[2] <= box[0] or box[3] <= b[1] or b[3] <= box[1] for b in boxes):
                boxes.append(box)
                want.add((user, r["anchor"]))
                break
    assert {(r.id, r.anchor) for r in QUERIES["label_places"](spark, FOLDER).collect()} == want and want


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_every_query_is_compared_with_something():
    assert set(QUERIES) - set(ORACLE) == {"match_runs", "match_gaps", "match_coverage", "label_places"}
