"""Links of detections against all pairs, and no pair leaves the task of its frame."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import detections as det

SCHEMA = "camera_id string, frame_idx long, det_id long, bbox array<int>, confidence double"


def overlap(a, b):
    both = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    area = lambda c: (c[2] - c[0]) * (c[3] - c[1])
    return both / (area(a) + area(b) - both) if both > 0 else 0.0


def plain(rows):
    out = {}
    for f in {r[1] for r in rows}:
        now, prev = [r for r in rows if r[1] == f], [r for r in rows if r[1] == f - 1]
        taken = set()
        for stage, lo, hi, least in ((1, 0.5, 9, 0.30), (2, 0.1, 0.5, 0.15)):
            pairs = [(-overlap(a[3], b[3]), a[2], b[2]) for a in now if lo <= a[4] < hi for b in prev if b[2] not in taken]
            pairs = [p for p in pairs if -p[0] >= least]
            to = {a: min((o, b) for o, x, b in pairs if x == a)[1] for _, a, _ in pairs}
            back = {b: min((o, a) for o, a, x in pairs if x == b)[1] for _, _, b in pairs}
            made = {(a, b): stage for a, b in to.items() if back[b] == a}
            taken |= {b for _, b in made}
            out |= made
    return out


@pytest.mark.parametrize("span", [12, 60, 600])
def test_links_are_those_of_all_pairs(spark, span):
    """Boxes of many sizes, equal ones, ones without area, and weak detections."""
    rng = np.random.default_rng(span)
    rows = []
    for i in range(600):
        x, y, w, h = (int(v) for v in (rng.integers(0, span), rng.integers(0, span), rng.choice([0, 3, 20, 90, 500]), rng.choice([2, 30, 200])))
        rows.append(("C1", i % 4, int(rng.permutation(600)[0]) * 1000 + i, [x, y, x + w, y + h], float(rng.choice([0.05, 0.3, 0.9]))))
    got = det.frame_association(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.det_id, r.prev_id): r.stage for r in got} == plain(rows) and got
    by_id = {r[2]: r[3] for r in rows}
    assert all(r.overlap == pytest.approx(overlap(by_id[r.det_id], by_id[r.prev_id]), abs=1e-4) for r in got)


def test_pairs_are_not_joined(spark):
    d = spark.range(4000).select(F.lit("C1").alias("camera_id"), (F.col("id") % 2).alias("frame_idx"), F.col("id").alias("det_id"), F.array(*[(F.col("id") % 9 + x).cast("int") for x in (0, 0, 50, 50)]).alias("bbox"), F.lit(0.9).alias("confidence"))
    links = det.frame_association(d)
    assert "Window" not in links._jdf.queryExecution().executedPlan().toString() and links.count() == 9
