"""Links over missed frames against plain rounds, made with one shuffle of the detections."""

import numpy as np
from pyspark.sql import functions as F

from sightline.operators import detections as det

SCHEMA = "camera_id string, frame_idx long, det_id long, bbox array<int>, confidence double"


def overlap(a, b):
    both = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    area = lambda c: (c[2] - c[0]) * (c[3] - c[1])
    return both / (area(a) + area(b) - both) if both > 0 else 0.0


def plain(rows, max_age):
    links = {}
    for gap in range(1, max_age + 1):
        linked, followed, more = set(links), {p for p, _ in links.values()}, {}
        for f in {r[1] for r in rows}:
            now = [r for r in rows if r[1] == f and r[2] not in linked]
            prev = [r for r in rows if r[1] == f - gap and r[2] not in followed and (gap == 1 or r[4] >= 0.5 or r[2] in linked)]
            taken = set()
            for lo, hi, least in ((0.5, 9, 0.30), (0.1, 0.5, 0.15)):
                pairs = [(-overlap(a[3], b[3]), a[2], b[2]) for a in now if lo <= a[4] < hi for b in prev if b[2] not in taken]
                pairs = [p for p in pairs if -p[0] >= least]
                to = {a: min((o, b) for o, x, b in pairs if x == a)[1] for _, a, _ in pairs}
                back = {b: min((o, a) for o, a, x in pairs if x == b)[1] for _, _, b in pairs}
                made = {a: b for a, b in to.items() if back[b] == a}
                taken |= set(made.values())
                more |= {a: (b, gap) for a, b in made.items()}
        links |= more
    return links


def test_links_over_gaps_are_those_of_plain_rounds(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i, n in enumerate(rng.permutation(900)):
        x, y = int(rng.integers(0, 400)), int(rng.integers(0, 120))
        rows.append(("C1", int(rng.integers(-40, 90)), int(n), [x, y, x + 120, y + 90], float(rng.choice([0.05, 0.3, 0.9]))))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for max_age in (2, 3, 5):
        got = {r.det_id: (r.prev_id, r.gap) for r in det.association_over_gaps(df, max_age).collect()}
        assert got == plain(rows, max_age) and {g for _, g in got.values()} == set(range(1, max_age + 1))


def test_detections_are_shuffled_once_for_all_gaps(spark):
    d = spark.range(4000).select(F.lit("C1").alias("camera_id"), (F.col("id") % 90).alias("frame_idx"), F.col("id").alias("det_id"), F.array(*[(F.col("id") % 9 + x).cast("int") for x in (0, 0, 50, 50)]).alias("bbox"), F.lit(0.9).alias("confidence"))
    plan = det.association_over_gaps(d, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1 and "Scan parquet" not in plan


def test_members_of_tracks_are_the_chains_of_links(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = []
    for i, n in enumerate(rng.permutation(1500)):
        x, y = int(rng.integers(0, 300)), int(rng.integers(0, 60))
        place = (int(rng.integers(-40, 90)), [x, y, x + 120, y + 90])
        frame, box = (None, place[1]) if i % 100 == 0 else (place[0], [x, None, 1, 2]) if i % 100 == 1 else place
        rows.append(("C1" if i % 3 else "C2", frame, int(n), box, float(rng.choice([0.05, 0.3, 0.9])), "car", 0.5))
    df = spark.createDataFrame(rows, SCHEMA + ", class_name string, quality double").repartition(5)
    kept, write = [], det.written

    def counted(some, name):
        out = write(some, name)
        kept.append(out.count())
        return out

    for max_age in (1, 3):
        want = {(r.camera_id, r.det_id, r.track) for r in det.chained_tracks(det.association_over_gaps(df, max_age), df).collect()}
        kept.clear()
        monkeypatch.setattr(det, "written", counted)
        summary = det.tracks(df, max_age).collect()
        monkeypatch.setattr(det, "written", write)
        # heads are sought among the last frames of runs alone
        assert sum(kept) < 1.6 * len(rows)
        got = [(r.camera_id, r.det_id, r.track_id) for r in det.track_members(df, max_age).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert sum(r.n_frames for r in summary) == len(want) and {(r.camera_id, r.track_id) for r in summary} == {(c, t) for c, _, t in want}
