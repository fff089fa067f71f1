"""Boxes, detections and their association to events."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from itertools import accumulate, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from hydroframe.functions.columns import interval_iou, overlap_coefficient, weighted_quantile

#: Thresholds for association: temporal IoU, overlap coefficient, gap in seconds, frequency IoU.
MERGE = {"time_iou": 0.25, "overlap": 0.55, "gap_s": 0.04, "frequency_iou": 0.10}


def boxes_to_intervals(boxes: DataFrame) -> DataFrame:
    """Normalised boxes (x, y, w, h) of windows as sample intervals and frequency ranges.

    Needs start_sample, valid_samples, sample_rate_hz, total_samples, t0, t1, f0 and f1 of the window.
    The interval stays in the valid part and the recording and holds a sample at least; the frequency
    axis points down.
    """
    c = F.col
    x0, x1 = F.greatest(F.lit(0.0), c("x") - c("w") / 2), F.least(F.lit(1.0), c("x") + c("w") / 2)
    y0, y1 = F.greatest(F.lit(0.0), c("y") - c("h") / 2), F.least(F.lit(1.0), c("y") + c("h") / 2)
    time, band = F.greatest(F.lit(1e-9), c("t1") - c("t0")), F.greatest(F.lit(1e-9), c("f1") - c("f0"))
    valid = c("valid_samples") / c("sample_rate_hz")
    at = lambda x: c("start_sample") + F.rint(F.greatest(F.lit(0.0), F.least(valid, c("t0") + x * time)) * c("sample_rate_hz")).cast("long")
    rows = boxes.withColumn("_a", F.greatest(F.lit(0), F.least(c("total_samples") - 1, at(x0)))).withColumn("_b", at(x1))
    rows = rows.withColumn("event_start", c("_a")).withColumn("event_end", F.greatest(c("_a") + 1, F.least(c("total_samples"), c("_b"))))
    return rows.withColumn("fmin_hz", c("f1") - y1 * band).withColumn("fmax_hz", c("f1") - y0 * band).drop("_a", "_b")


def detections(intervals: DataFrame, fmax: float) -> DataFrame:
    """Seconds from samples, frequencies held to [0, fmax], one contributing window each."""
    c = F.col
    held = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(fmax), x))
    return intervals.select(
        "recording_id", "seq", (c("event_start") / c("sample_rate_hz")).alias("start_s"), (c("event_end") / c("sample_rate_hz")).alias("end_s"),
        held(c("fmin_hz")).alias("fmin_hz"), held(c("fmax_hz")).alias("fmax_hz"), "confidence", F.array("window_index").alias("windows"), F.lit(1).alias("raw_count"),
    )


#: Adjacent windows of a recording that are suppressed in one task.
ADMIT_WINDOWS = 64


def admit_boxes(boxes: DataFrame, confidence: float = 0.25, iou: float = 0.7, most: int = 300) -> DataFrame:
    """Boxes with enough confidence that no more confident box of their window overlaps by more than ``iou``, ``most`` a window.

    Rows are dealt out by ``ADMIT_WINDOWS`` adjacent windows of a recording and sorted, so that each
    window's boxes follow one another; each window is suppressed for itself.
    """

    def stays(x0, x1, y0, y1) -> np.ndarray:
        area, left, stay = (x1 - x0) * (y1 - y0), np.arange(len(x0)), []
        while len(left) and len(stay) < most:
            k, rest = left[0], left[1:]
            stay.append(k)
            both = np.clip(np.minimum(x1[k], x1[rest]) - np.maximum(x0[k], x0[rest]), 0, None) * np.clip(np.minimum(y1[k], y1[rest]) - np.maximum(y0[k], y0[rest]), 0, None)
            union = area[k] + area[rest] - both
            left = rest[~(np.divide(both, union, out=np.zeros_like(both), where=union > 0) > iou)]
        return np.array(stay)

    def suppress(rows: pa.Table) -> pa.Table:
        x, y, w, h = (rows[c].to_numpy() for c in ("x", "y", "w", "h"))
        sides = x - w / 2, x + w / 2, y - h / 2, y + h / 2
        begin = _window_begins(rows)
        keep = [i + (stays(*(c[i:j] for c in sides)) if j - i > 1 else np.zeros(1, int)) for i, j in zip(begin, np.append(begin[1:], len(x)), strict=True)]
        return rows.take(pa.array(np.concatenate(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if len(rows):
                last = int(_window_begins(rows)[-1])  # the next batch may go on with this window
                if last:
                    yield from suppress(rows.slice(0, last)).to_batches()
                held = rows.slice(last)
        if held is not None:
            yield from suppress(held).to_batches()

    rows = boxes.where(F.col("confidence") >= confidence).withColumn("_block", F.floor(F.col("window_index") / ADMIT_WINDOWS)).repartition("recording_id", "_block")
    rows = rows.sortWithinPartitions("recording_id", "window_index", F.desc("confidence"), "seq").select(*boxes.columns)
    return rows.mapInArrow(run, boxes.schema)


def _window_begins(rows: pa.Table) -> np.ndarray:
    """Where the rows of a window begin, of rows sorted by recording and window."""
    names, windows = (rows[c].to_numpy() for c in ("recording_id", "window_index"))
    return np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]) | (windows[1:] != windows[:-1])]))


def windows_with_boxes(windows: DataFrame, boxes: DataFrame) -> DataFrame:
    """Each box with the columns of its window; windows without boxes and boxes without a window are left out."""
    return boxes.join(windows, ["recording_id", "window_index"])


#: Levels of interval lengths: cells of level k are 2**k seconds wide.
LEVELS = (-20, 40)


def interval_cells(rows: DataFrame, low: Column, high: Column) -> tuple[DataFrame, DataFrame]:
    """Rows by the cells of their interval's own level, and by those of each level of their recording from their own up: level, cell, first_cell.

    A level's cells are as wide as its longest interval at least, so an interval has two cells a level at
    most. Two intervals that meet share a cell of the longer one's level, whatever their lengths. Adds
    ``own`` (the level), ``level``, ``cell`` and ``first`` (the first cell of that level).
    """
    length = F.greatest(high - low, F.lit(2.0 ** LEVELS[0]))
    rows = rows.withColumn("own", F.least(F.lit(LEVELS[1]), F.greatest(F.lit(LEVELS[0]), F.ceil(F.log2(length)).cast("int"))))
    at = lambda level, x: F.floor(x / F.pow(F.lit(2.0), level)).cast("long")

    def spread(df: DataFrame) -> DataFrame:
        cells = F.sequence(at(F.col("level"), low), at(F.col("level"), F.greatest(low, high)))
        return df.withColumn("first", at(F.col("level"), low)).withColumn("cell", F.explode(cells))

    there = rows.groupBy("recording_id").agg(F.collect_set("own").alias("levels"))
    upward = rows.join(there, "recording_id").withColumn("level", F.explode(F.filter("levels", lambda k: k >= F.col("own")))).drop("levels")
    return spread(rows.withColumn("level", F.col("own"))), spread(upward)


def association_pairs(rows: DataFrame, merge: dict[str, float] = MERGE) -> DataFrame:
    """Pairs of detections (a before b by seq) of a recording that may belong together, with their score.

    Intervals, longer by the gap, meet in cells of the longer one's length (see interval_cells): a row goes
    out twice a level at most, however lengths are mixed, and a pair is looked at in the first cell that
    both have. Detections of equal bounds are pairs as others are.
    """
    c = F.col
    kept = rows.select("recording_id", "seq", "start_s", "end_s", "fmin_hz", "fmax_hz", "windows")
    own, upward = interval_cells(kept, c("start_s"), F.greatest(c("start_s"), c("end_s")) + merge["gap_s"])
    x, y = upward.alias("x"), own.alias("y")
    once = (c("x.own") < c("y.own")) | ((c("x.own") == c("y.own")) & (c("x.seq") < c("y.seq")))
    both = x.join(y, (c("x.recording_id") == c("y.recording_id")) & (c("x.level") == c("y.level")) & (c("x.cell") == c("y.cell")) & once & (c("x.cell") == F.greatest("x.first", "y.first")))
    t = [c("x.start_s"), c("x.end_s"), c("y.start_s"), c("y.end_s")]
    f = [c("x.fmin_hz"), c("x.fmax_hz"), c("y.fmin_hz"), c("y.fmax_hz")]
    gap = F.greatest(F.lit(0.0), F.greatest(t[0], t[2]) - F.least(t[1], t[3]))
    near = (interval_iou(*t) >= merge["time_iou"]) | (overlap_coefficient(*t) >= merge["overlap"]) | (gap <= merge["gap_s"])
    both = both.where(~F.arrays_overlap("x.windows", "y.windows") & near & (interval_iou(*f) >= merge["frequency_iou"]))
    score = 2 * interval_iou(*t) + overlap_coefficient(*t) + interval_iou(*f) - gap
    return both.select(c("x.recording_id").alias("recording_id"), F.least("x.seq", "y.seq").alias("seq_a"), F.greatest("x.seq", "y.seq").alias("seq_b"), score.alias("score"))


def islands(rows: DataFrame, gap_s: float) -> DataFrame:
    """Adds island, the number of the run of detections that no gap longer than ``gap_s`` parts."""
    order = Window.partitionBy("recording_id").orderBy("start_s", F.desc("confidence"), "seq")
    before = F.max("end_s").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", (before.isNull() | (F.col("start_s") - before > gap_s)).cast("long"))
    return rows.withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


class Cluster:
    """Detections taken for one event so far: bounds, windows, and members by frequency for the weighted medians."""

    def __init__(self, first_confidence: float, first_seq: int):
        self.first = first_confidence, first_seq
        self.start, self.end, self.confidence, self.raw_count = float("inf"), float("-inf"), 0.0, 0
        self.windows: set[int] = set()
        self.low: list[tuple[float, float]] = []
        self.high: list[tuple[float, float]] = []

    def add(self, start, end, fmin, fmax, confidence, windows, raw_count) -> None:
        self.start, self.end, self.confidence = min(self.start, start), max(self.end, end), max(self.confidence, confidence)
        self.windows |= windows
        self.raw_count += raw_count
        weight = max(1e-6, confidence)
        insort(self.low, (fmin, weight))
        insort(self.high, (fmax, weight))
        self.fmin, self.fmax = weighted_median(self.low), weighted_median(self.high)

    def values(self) -> tuple:
        return self.start, self.end, self.fmin, self.fmax, self.confidence, sorted(self.windows), self.raw_count, *self.first


def weighted_median(members: list[tuple[float, float]]) -> float:
    """Of sorted (value, weight): the first value at which half of all weight is reached."""
    upto = list(accumulate(w for _, w in members))
    return members[bisect_left(upto, upto[-1] / 2)][0]


def affinity(c: Cluster, start: float, end: float, fmin: float, fmax: float, merge: dict[str, float]) -> float | None:
    """How well a detection fits a cluster, or nothing if they may not be one event."""
    shared_f = min(fmax, c.fmax) - max(fmin, c.fmin)
    f_iou = shared_f / (max(fmax, c.fmax) - min(fmin, c.fmin)) if shared_f > 0 else 0.0
    if f_iou < merge["frequency_iou"]:
        return None
    shared, gap = max(0.0, min(end, c.end) - max(start, c.start)), max(0.0, max(start, c.start) - min(end, c.end))
    span, short = max(end, c.end) - min(start, c.start), min(end - start, c.end - c.start)
    iou, overlap = shared / span if span > 0 else 0.0, shared / short if short > 0 else 0.0
    if iou < merge["time_iou"] and overlap < merge["overlap"] and gap > merge["gap_s"]:
        return None
    return 2 * iou + overlap + f_iou - gap


def grow_clusters(detections: Iterator[tuple], merge: dict[str, float]) -> Iterator[Cluster]:
    """Each detection, in the order given, joins the best of the clusters that hold none of its windows, of equals the last, or opens one.

    Detections come by start; a cluster that ends further before than the gap is done and given out, so
    that only clusters still within reach are held.
    """
    live: list[Cluster] = []
    for start, end, fmin, fmax, confidence, windows, raw_count, seq in detections:
        limit = start - merge["gap_s"]
        yield from (c for c in live if c.end < limit)
        live = [c for c in live if c.end >= limit]
        best, most = None, float("-inf")
        for c in live:
            fit = affinity(c, start, end, fmin, fmax, merge) if c.windows.isdisjoint(windows) else None
            if fit is not None and fit >= most:
                best, most = c, fit
        if best is None:
            best = Cluster(confidence, seq)
            live.append(best)
        best.add(start, end, fmin, fmax, confidence, windows, raw_count)
    yield from live


#: Sweeps over frequency and time after the first over time.
SWEEPS = 2


def cells(rows: DataFrame, gap_s: float, sweeps: int = SWEEPS) -> DataFrame:
    """Adds cell: detections of different cells of a recording can't come into one event.

    No gap longer than ``gap_s`` parts an island in time. An event's median bounds lie within the hull of its
    detections' frequencies, so those of an island whose hulls don't meet stay apart, and each band of
    an island may fall apart in time again. More sweeps only cut finer; results are the same.
    """
    rows = islands(rows, gap_s).withColumn("cell", F.col("island").cast("string"))
    low, high = F.least("fmin_hz", "fmax_hz"), F.greatest("fmin_hz", "fmax_hz")
    for _ in range(sweeps):
        for order, begin, end, apart in (([low, F.col("seq")], low, high, lambda x: x >= 0), ([F.col("start_s"), F.col("seq")], F.col("start_s"), F.col("end_s"), lambda x: x > gap_s)):
            by = Window.partitionBy("recording_id", "cell").orderBy(*order)
            before = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
            rows = rows.withColumn("_new", F.coalesce(apart(begin - before), F.lit(False)).cast("int"))
            rows = rows.withColumn("_part", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("cell", F.concat_ws(".", "cell", "_part"))
    return rows.drop("_new", "_part", "island")


EVENTS = "start_s double, end_s double, fmin_hz double, fmax_hz double, confidence double, windows array<int>, raw_count long"
OPENED = "first_confidence double, first_seq long"


def merge_events(rows: DataFrame, merge: dict[str, float] = MERGE, sweeps: int = SWEEPS) -> DataFrame:
    """Events of each recording: bounds, best confidence, contributing windows, raw count and event_id.

    Detections fall into cells of time and frequency that no event reaches across (see cells). Cells of one
    detection are events as they are; the others are dealt out over tasks, which run through each in order
    and hold only the events still within reach. The cut needs a gap of 0 at least and positive thresholds.
    """
    if merge["gap_s"] < 0 or merge["time_iou"] <= 0 or merge["overlap"] <= 0 or merge["frequency_iou"] <= 0:
        raise ValueError("cells need a gap of 0 at least and positive thresholds")
    names = [x.split()[0] for x in EVENTS.split(", ")]
    kind = dict(rows.dtypes)["recording_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = ((key, d) for b in batches for key, d in zip(zip(b["recording_id"].to_pylist(), b["cell"].to_pylist(), strict=True), zip(*(b[c].to_pylist() for c in [*names[:5], "windows", "raw_count", "seq"]), strict=True), strict=True))
        held: list[tuple] = []
        for (recording, _), own in groupby(every, key=lambda x: x[0]):
            held += [(recording, *c.values()) for c in grow_clusters(((*d[:5], set(d[5]), *d[6:]) for _, d in own), merge)]
            if len(held) >= 5000:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        kinds = [None, *[pa.float64()] * 5, pa.list_(pa.int32()), pa.int64(), pa.float64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=["recording_id", *names, "first_confidence", "first_seq"])

    placed = cells(rows, merge["gap_s"], sweeps).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("recording_id", "cell")))
    alone = placed.where("_n = 1").select(
        "recording_id", *names[:5], F.array_sort(F.array_distinct("windows")).alias("windows"), F.col("raw_count").cast("long").alias("raw_count"), F.col("confidence").alias("first_confidence"), F.col("seq").cast("long").alias("first_seq")
    )
    several = placed.where("_n > 1").select("recording_id", "cell", "seq", *names)
    # a fixed number of tasks: Spark would join them by the size of the rows, which are narrow and dear
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    several = several.repartition(tasks, "recording_id", "cell").sortWithinPartitions("recording_id", "cell", "start_s", F.desc("confidence"), "seq")
    merged = several.mapInArrow(run, f"recording_id {kind}, {EVENTS}, {OPENED}")
    return number_events(alone.unionByName(merged), F.desc("first_confidence"), "first_seq").drop("first_confidence", "first_seq")


def event_bounds(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of detections that are assigned to events already: least start, greatest end, and medians of the frequencies weighted by confidence."""
    rows = rows.withColumn("_weight", F.greatest(F.lit(1e-6), F.col("confidence")))
    out = rows.groupBy(*keys).agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
    for name in ("fmin_hz", "fmax_hz"):
        out = out.join(weighted_quantile(rows, keys, name, "_weight", 0.5, name), keys)
    return out


def number_events(events: DataFrame, *opened: Column | str) -> DataFrame:
    """W0001 and so on by start; ties in the order ``opened``, in which the events' first detections came."""
    order = Window.partitionBy("recording_id").orderBy("start_s", *opened)
    return events.withColumn("event_id", F.format_string("W%04d", F.row_number().over(order)))


def detect_windows(windows: DataFrame, detector, schema: str) -> DataFrame:
    """Boxes from a supplied function of an iterator of pandas frames of windows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from detector(batches)

    return windows.mapInPandas(run, schema)


#: Windows that a detector sees together, and boxes of a window at most.
DETECT_BATCH, MOST_BOXES = 8, 300
BOX = ("x", "y", "w", "h", "confidence")


def detect_batches(windows: DataFrame, make_detector: Callable, shape: tuple[int, int], batch: int = DETECT_BATCH) -> DataFrame:
    """recording_id, window_index, box, x, y, w, h and confidence, from a detector that each Python worker makes once.

    ``windows``: recording_id, window_index, grid; ``shape``: rows and columns of all grids. The detector that
    ``make_detector()`` gives takes a stack of up to ``batch`` grids and gives for each an array of boxes, BOX by
    row, of which the first MOST_BOXES count.
    """

    def make():
        detector = make_detector()

        def predict(grids: np.ndarray) -> np.ndarray:
            out = np.full((len(grids), MOST_BOXES * len(BOX)), np.nan)
            for row, boxes in zip(out, detector(grids), strict=True):
                flat = np.asarray(boxes, float)[:MOST_BOXES].ravel()
                row[: len(flat)] = flat
            return out

        return predict

    detect = predict_batch_udf(make, return_type=ArrayType(DoubleType()), batch_size=batch, input_tensor_shapes=[list(shape)])
    found = windows.select("recording_id", "window_index", detect(F.flatten("grid")).alias("flat"))
    step = len(BOX)
    boxes = F.transform(F.sequence(F.lit(0), F.lit(MOST_BOXES - 1)), lambda i: F.struct(i.alias("box"), *[F.get("flat", i * step + k).alias(n) for k, n in enumerate(BOX)]))
    return found.select("recording_id", "window_index", F.explode(F.filter(boxes, lambda b: b["confidence"].isNotNull() & ~F.isnan(b["confidence"]))).alias("b")).select("recording_id", "window_index", "b.*")
