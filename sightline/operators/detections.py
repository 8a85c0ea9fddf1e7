"""Detection tables: association of frames, tracks and plate reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sightline.functions.plates import clean_plate, format_plate, repair_plate
from sightline.storage import written


def frame_association(d: DataFrame) -> DataFrame:
    """Links of detections with those one frame before: sure ones first at an overlap of 0.30 or more, then weak ones
    (confidence 0.10 to 0.50) at 0.15 or more with what is left. One to one by mutually best overlap, ties by least id.

    The detections of a frame meet those of the frame before in one task, and only links leave it: pairs are neither
    sorted nor written.
    """
    return _associated(d, 1).drop("gap")


#: Of a box's width: how far the left sides of boxes may be apart that are compared in each turn, the nearest first.
REACH = (1 / 9, 1 / 3, 1.0, 3.0, 9.0)


def _ranks(ids: pa.ChunkedArray) -> np.ndarray:
    order = pc.sort_indices(ids, null_placement="at_start").to_numpy()
    out = np.empty(len(order), int)
    out[order] = np.arange(len(order))
    return out


def _distinct(box: np.ndarray, rank: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of the rows with one box that of the least rank, by left sides: at equal overlaps no other is ever best."""
    rows = rows[((box[rows, 2] > box[rows, 0]) & (box[rows, 3] > box[rows, 1]))]
    rows = rows[np.lexsort((rank[rows], *box[rows].T[::-1]))]
    return rows[np.r_[True, (box[rows[1:]] != box[rows[:-1]]).any(1)]] if len(rows) else rows


def _best(p: np.ndarray, q: np.ndarray, rank: np.ndarray, least: float, block: int = 256, wide: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """For each box of p the box of q that overlaps it most, the one of least rank at ties, and the overlap; -1 below ``least``.

    Both are in the order of their left sides. Where these are apart by c of p's width, the overlap is 1 / (1 + c) at most, so boxes are met in
    turns of growing c, and a box whose best is above what later turns can give is done.
    """
    at, top, left = np.full(len(p), -1), np.zeros(len(p)), np.arange(len(p))
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    areas = area(q)
    for c in REACH:
        reach = c * (p[:, 2] - p[:, 0])
        for some in (left[i : i + block] for i in range(0, len(left), block)):
            x, size, top[some], at[some] = p[some], area(p[some])[:, None], 0.0, -1
            lo, hi = np.searchsorted(q[:, 0], (x[:, 0] - reach[some]).min(), "left"), np.searchsorted(q[:, 0], (x[:, 0] + reach[some]).max(), "right")
            for start in range(lo, hi, wide):
                y = q[start : min(start + wide, hi)]
                both = np.maximum(0.0, np.minimum(x[:, 2:3], y[:, 2]) - np.maximum(x[:, 0:1], y[:, 0])) * np.maximum(0.0, np.minimum(x[:, 3:4], y[:, 3]) - np.maximum(x[:, 1:2], y[:, 1]))
                overlap = both / (size + areas[start : start + len(y)] - both)
                found = overlap.max(1)
                ranked = np.where(overlap == found[:, None], rank[start : start + len(y)], np.iinfo(int).max)
                nearest = ranked.argmin(1)
                old = at[some]
                better = (found > top[some]) | ((found == top[some]) & (old >= 0) & (ranked.min(1) < rank[old]))
                at[some[better]], top[some[better]] = start + nearest[better], found[better]
        if 1 / (1 + c) < least - 1e-9:
            break
        left = left[top[left] <= 1 / (1 + c) + 1e-9]
    at[top < least] = -1
    return at, top


def _linked(box: np.ndarray, rank: np.ndarray, rows: np.ndarray, prev: np.ndarray, prev_rank: np.ndarray, prev_rows: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of both sides that are best for each other, with their overlaps."""
    rows, prev_rows = _distinct(box, rank, rows), _distinct(prev, prev_rank, prev_rows)
    if not len(rows) or not len(prev_rows):
        return rows[:0], prev_rows[:0], np.zeros(0)
    to, top = _best(box[rows], prev[prev_rows], prev_rank[prev_rows], least)
    chosen = np.unique(to[to >= 0])
    back, _ = _best(prev[prev_rows[chosen]], box[rows], rank[rows], least)
    mutual = np.flatnonzero(to >= 0)
    mutual = mutual[back[np.searchsorted(chosen, to[mutual])] == mutual]
    return rows[mutual], prev_rows[to[mutual]], top[mutual]


def _runs(d: DataFrame, max_age: int, *more: str) -> tuple[DataFrame, int, int]:
    """Detections by camera and run of frames, with those of the frames just before it, and how many frames a run and these are.

    The links of a frame over gaps up to n follow from it and the n (n + 1) / 2 frames before. Rows without a place are left out.
    """
    halo = max_age * (max_age + 1) // 2
    run = max(16, 4 * halo)
    frame, corners = F.col("frame_idx").cast("long"), [F.col("bbox")[i].cast("double").alias(f"b{i}") for i in range(4)]
    sure = F.when(F.col("confidence") >= 0.5, 2).when(F.col("confidence") >= 0.1, 1).otherwise(0).cast("byte")
    rows = d.select("camera_id", frame.alias("_frame"), "det_id", sure.alias("sure"), *corners, *more).dropna(subset=["camera_id", "_frame", "b0", "b1", "b2", "b3"])
    own = F.col("_frame") - F.pmod("_frame", F.lit(run))
    runs = F.explode(F.filter(F.array(own, F.when(F.col("_frame") >= own + (run - halo), own + run)), lambda x: x.isNotNull()))
    return rows.withColumn("_run", runs).withColumn("_at", (F.col("_frame") - F.col("_run")).cast("int")).drop("_frame"), run, halo


def _rounds(t: pa.Table, max_age: int) -> tuple[np.ndarray, ...]:
    """Of the rows of a run: the linked rows of its own frames, the rows before them, overlaps, stages and gaps; and of all rows their
    frames, which rows are linked, and whether they are sure (2), weak (1) or less."""
    box, rank, at, kind = np.stack([t.column(f"b{i}").to_numpy() for i in range(4)], 1), _ranks(t.column("det_id")), t.column("_at").to_numpy(), t.column("sure").to_numpy()
    order = np.argsort(at, kind="stable")
    frames, starts = np.unique(at[order], return_index=True)
    of = dict(zip(frames.tolist(), np.split(order, starts[1:]), strict=True))
    linked, followed = np.zeros(len(at), bool), np.zeros(len(at), bool)
    found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0), 0, 0)]
    for gap in range(1, max_age + 1):
        # a round goes by what the rounds before it have left; over more than a frame a track goes on from sure and linked detections
        left, ends = (kind > 0) & ~linked, ~followed & ((gap == 1) | (kind == 2) | linked)
        for f, rows in of.items():
            now, prev = rows[left[rows]], of.get(f - gap, rows[:0])
            prev = prev[ends[prev]]
            if not len(now) or not len(prev):
                continue
            for stage, some, least in ((1, kind[now] == 2, 0.30), (2, kind[now] == 1, 0.15)):
                to, back, overlap = _linked(box, rank, now[some], box, rank, prev[~followed[prev]], least)
                linked[to], followed[back] = True, True
                found.append((to, back, overlap, stage, gap))
    to, back, overlap = (np.concatenate([x[i] for x in found]) for i in range(3))
    stage, gap = (np.repeat(np.array([x[i] for x in found], np.int32), [len(x[0]) for x in found]) for i in (3, 4))
    mine = at[to] >= 0
    return to[mine], back[mine], overlap[mine], stage[mine], gap[mine], at, linked, kind


def _frames(t: pa.Table, kind: pa.DataType) -> pa.ChunkedArray:
    return pc.add(t.column("_run"), t.column("_at").cast("int64")).cast(kind)


def _associated(d: DataFrame, max_age: int) -> DataFrame:
    """Links of detections with earlier ones up to ``max_age`` frames back, in rounds, the nearest gap first.

    A camera's frames are cut into runs, and a run's detections meet in one task with those of the frames just before it: all rounds
    are made there and rows are shuffled about once. Only links of the run's own frames leave it. Ids name one detection of a camera.
    """
    rows, _, _ = _runs(d, max_age)
    frame = to_arrow_type(d.schema["frame_idx"].dataType)

    def links(t: pa.Table) -> pa.Table:
        to, back, overlap, stage, gap, *_ = _rounds(t, max_age)
        out = t.select(["camera_id", "det_id"]).append_column("frame_idx", _frames(t, frame)).take(pa.array(to)).select(["camera_id", "frame_idx", "det_id"])
        for name, column in (("prev_id", t.column("det_id").take(pa.array(back))), ("overlap", pa.array(overlap)), ("stage", pa.array(stage)), ("gap", pa.array(gap))):
            out = out.append_column(name, column)
        return out

    kind = lambda c: d.schema[c].dataType.simpleString()
    schema = f"camera_id {kind('camera_id')}, frame_idx {kind('frame_idx')}, det_id {kind('det_id')}, prev_id {kind('det_id')}, overlap double, stage int, gap int"
    return rows.groupBy("camera_id", "_run").applyInArrow(links, schema).withColumn("overlap", F.round("overlap", 4))


def association_over_gaps(d: DataFrame, max_age: int = 30) -> DataFrame:
    """Links as of ``frame_association``, and over up to ``max_age`` frames where a vehicle was missed, with their ``gap``.

    Gaps are joined in rounds, the nearest first: each round links detections that have no earlier one yet with the last
    ones of tracks so far, by the same two stages. A track goes on from sure detections and from linked ones.
    """
    return _associated(d, max(1, max_age))


def tracks(d: DataFrame, max_age: int = 30) -> DataFrame:
    """Summaries of tracks from detections: association over gaps, chains of links, then the summary of each chain.

    d has quality. A track whose vehicle is missed for more than ``max_age`` frames ends, and a later one is a new track.
    """
    return track_summary(track_members(d, max(1, max_age)))


def track_members(d: DataFrame, max_age: int) -> DataFrame:
    """Detections of tracks with track_id, as ``chained_tracks`` names them from the links over gaps, and what ``track_summary`` reads.

    Links are made run by run of frames, and a run's task chains its own: a detection leaves it with the first of its chain there, or
    with one of the run before, where ``open`` is set. Only the last frames of runs (``edge``) may be asked for by the next run, so
    heads are found by doubling among these few alone. Rows carry their columns, so detections are shuffled once and met with nothing again.
    """
    more = ["confidence", "quality", "class_name"]
    rows, run, _ = _runs(d, max_age, *more)
    corners = [f"b{i}" for i in range(4)]
    frame = to_arrow_type(d.schema["frame_idx"].dataType)

    def members(t: pa.Table) -> pa.Table:
        to, back, _, _, _, at, linked, kind = _rounds(t, max_age)
        up = np.arange(len(at))
        up[to] = back
        while (up[up] != up).any():
            up = up[up]
        followed = np.zeros(len(at), bool)
        followed[back] = True
        starts = np.flatnonzero((at >= 0) & ~linked & ((kind == 2) | followed))
        # a weak detection that only the next run follows starts a track, unless its own run has linked it
        maybe = np.flatnonzero((at < 0) & (kind < 2) & followed)
        some = np.concatenate([to, starts, maybe])
        tail = np.arange(len(some)) < len(to)
        out = t.select(["camera_id", "det_id", *more, *corners]).append_column("frame_idx", _frames(t, frame)).append_column("track_id", t.column("det_id").take(pa.array(up))).take(pa.array(some))
        flags = {"open": tail & (at[up[some]] < 0), "edge": tail & (at[some] >= run - max_age), "maybe": at[some] < 0}
        for name, flag in flags.items():
            out = out.append_column(name, pa.array(flag))
        return out

    kind = lambda c: d.schema[c].dataType.simpleString()
    schema = ", ".join([f"{c} {kind(c)}" for c in ("camera_id", "det_id", *more)] + [f"{c} double" for c in corners] + [f"frame_idx {kind('frame_idx')}, track_id {kind('det_id')}, open boolean, edge boolean, maybe boolean"])
    found = written(rows.groupBy("camera_id", "_run").applyInArrow(members, schema), "track-members")
    key = ["camera_id", "track_id"]
    edges = heads = found.filter("edge").select("camera_id", "det_id", "track_id", "open")
    turn = 0
    while not heads.filter("open").isEmpty():
        up = heads.select("camera_id", F.col("det_id").alias("track_id"), F.col("track_id").alias("_up"), F.col("open").alias("_open"))
        heads = heads.join(up, key, "left").select("camera_id", "det_id", F.coalesce("_up", "track_id").alias("track_id"), (F.col("open") & F.coalesce("_open", F.lit(False))).alias("open"))
        heads, turn = written(heads, f"heads{turn}"), turn + 1
    names = ["camera_id", "det_id", *more, "frame_idx", *corners, "track_id"]
    ends = heads.select("camera_id", F.col("det_id").alias("track_id"), F.col("track_id").alias("_up"))
    late = found.filter("open").join(ends, key, "left").withColumn("track_id", F.coalesce("_up", "track_id")).select(*names)
    weak = found.filter("maybe").join(edges.select("camera_id", "det_id"), ["camera_id", "det_id"], "left_anti").select(*names)
    placed = found.filter("not open and not maybe").select(*names).unionByName(late).unionByName(weak)
    placed = placed.withColumn("bbox", F.array(*corners).cast(d.schema["bbox"].dataType)).drop(*corners)
    # sure detections without a frame or box are tracks of their own
    lone = F.col("frame_idx").isNull()
    for i in range(4):
        lone |= F.col("bbox")[i].isNull()
    alone = d.filter((F.col("confidence") >= 0.5) & F.col("camera_id").isNotNull() & lone).withColumn("track_id", F.col("det_id"))
    return placed.unionByName(alone.select(*placed.columns))


def chained_tracks(links: DataFrame, d: DataFrame) -> DataFrame:
    """camera_id, det_id, track: detections of frames that follow each other, chained by their links to the first one.

    Sure detections (confidence 0.50 or more) without a link to an earlier frame start tracks, named by their ids; so
    do linked ones with none before. Heads are found by doubling: each round a detection takes over the head of its
    head, so a chain of n links takes about log2(n) rounds of one join.
    """
    heads, turn, moving = written(links.select("camera_id", "det_id", F.col("prev_id").alias("track")), "tracks"), 0, True
    while moving:
        up = heads.select("camera_id", F.col("det_id").alias("track"), F.col("track").alias("_up"))
        # written before it is asked whether anything moved, so a round is computed once
        moved = written(heads.join(up, ["camera_id", "track"], "left").select("camera_id", "det_id", F.coalesce("_up", "track").alias("track"), F.col("_up").isNotNull().alias("_moved")), f"tracks{turn}")
        moving, turn = not moved.filter("_moved").isEmpty(), turn + 1
        heads = moved.drop("_moved")
    starts = heads.select("camera_id", F.col("track").alias("det_id")).unionByName(d.filter("confidence >= 0.5").select("camera_id", "det_id")).distinct().join(heads, ["camera_id", "det_id"], "left_anti")
    return heads.select("camera_id", "det_id", "track").unionByName(starts.select("camera_id", "det_id", F.col("det_id").alias("track")))


def track_summary(d: DataFrame) -> DataFrame:
    """Per camera and track: best snapshot with its box and class, best quality, mean confidence, frames, latest box.

    The mean is rounded twice, so that the order in which its terms are added does not decide a half.
    """
    best = F.struct("quality", F.col("det_id"))
    return d.groupBy("camera_id", "track_id").agg(
        F.max_by("det_id", best).alias("best_det"), F.max_by("bbox", best).alias("best_bbox"), F.max_by("bbox", F.struct("frame_idx", "det_id")).alias("latest_bbox"), F.max_by("class_name", best).alias("best_class"), F.max("quality").alias("best_quality"), F.round(F.round(F.avg("confidence"), 9), 4).alias("mean_confidence"), F.count(F.lit(1)).alias("n_frames"), F.max_by("det_id", F.struct("frame_idx", "det_id")).alias("latest_det"),
    )


def normalize_plates(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Rows with repaired plate, parser confidence, validity and display form."""
    r = df.withColumn("_r", repair_plate(F.col(raw)))
    return r.withColumns({"plate": F.col("_r.plate"), "parser_confidence": F.col("_r.confidence"), "is_valid": F.col("_r.valid"), "display": format_plate(F.col("_r.plate"))}).drop("_r")


def plate_quality_report(plates: DataFrame) -> DataFrame:
    """Per camera: plates, shares that are valid and that repair changed after cleaning, mean confidence."""
    return plates.groupBy("camera_id").agg(F.count(F.lit(1)).alias("plates"), F.round(F.avg(F.col("is_valid").cast("double")), 4).alias("valid_rate"), F.round(F.avg((F.col("plate") != clean_plate(F.col("raw"))).cast("double")), 4).alias("repaired_rate"), F.round(F.avg("plate_confidence"), 4).alias("mean_confidence"))
