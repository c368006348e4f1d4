"""Motion by the difference of neighbouring frames: the share of cells that change by more than a threshold.

Frames are arrays of whole numbers. Each is blurred (weights 1, 2, 1; a border cell counts as its own neighbour) and compared
with the one before; the first of a camera has none and does not move. Blurred cells are four times as large, and so is the
threshold, so all stays exact."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def blurred(cells: Column) -> Column:
    left = F.concat(F.slice(cells, 1, 1), F.slice(cells, 1, F.greatest(F.size(cells) - 1, F.lit(0))))
    right = F.concat(F.slice(cells, 2, F.greatest(F.size(cells), F.lit(1))), F.slice(cells, -1, 1))
    return F.zip_with(F.zip_with(left, cells, lambda a, b: a + b * 2), right, lambda a, b: a + b)


def _told(now: Column, before: Column, threshold: int, percent: float) -> tuple[Column, Column]:
    """Changed cells and whether they are `percent` of all or more; frames of different sizes do not compare."""
    both = F.zip_with(now, before, lambda a, b: (F.abs(a - b) > 4 * threshold).cast("int"))
    n = F.when(F.size(now) == F.size(before), F.aggregate(both, F.lit(0), lambda s, x: s + x))
    return F.coalesce(n, F.lit(0)), F.coalesce((F.size(now) > 0) & (n * 100.0 >= F.size(now) * F.lit(float(percent))), F.lit(False))


def frame_motion(frames: DataFrame, threshold: int = 25, percent: float = 1.0, per_slice: int = 4096) -> DataFrame:
    """camera_id, at, n_changed, motion for frames (camera_id, at, cells); at are whole numbers, one frame each.

    A camera's frames are cut into slices of `per_slice` numbers. Windows are over slices; the last frame of the slice before
    is carried over from a table of one frame a slice, so no task reads a camera's whole history."""
    sliced = frames.select("camera_id", "at", blurred(F.col("cells")).alias("now"), F.floor(F.col("at") / per_slice).alias("slice"))
    ends = sliced.groupBy("camera_id", "slice").agg(F.max_by("now", "at").alias("end"))
    carried = ends.select("camera_id", "slice", F.lag("end").over(Window.partitionBy("camera_id").orderBy("slice")).alias("carried"))
    before = F.coalesce(F.lag("now").over(Window.partitionBy("camera_id", "slice").orderBy("at")), F.col("carried"))
    n, moves = _told(F.col("now"), F.col("before"), threshold, percent)
    return sliced.join(carried, ["camera_id", "slice"]).withColumn("before", before).select("camera_id", "at", n.cast("long").alias("n_changed"), moves.alias("motion"))


def frame_motion_stream(frames: DataFrame, threshold: int = 25, percent: float = 1.0) -> DataFrame:
    """As frame_motion over a stream whose batches come in order: state is one frame a camera."""

    def step(key, parts, state):
        rows = pd.concat(list(parts)).sort_values("at")
        last = list(state.get[0]) if state.exists else None
        out = []
        for at, cells in zip(rows["at"].tolist(), rows["now"].tolist(), strict=True):
            now = [int(x) for x in cells]
            n = sum(abs(a - b) > 4 * threshold for a, b in zip(now, last, strict=True)) if last is not None and len(last) == len(now) else None
            out.append((key[0], int(at), n or 0, bool(n is not None and now and n * 100.0 >= len(now) * percent)))
            last = now
        state.update((last,))
        yield pd.DataFrame(out, columns=["camera_id", "at", "n_changed", "motion"])

    told = frames.select("camera_id", "at", F.transform(blurred(F.col("cells")), lambda x: x.cast("long")).alias("now"))
    return told.groupBy("camera_id").applyInPandasWithState(step, "camera_id long, at long, n_changed long, motion boolean", "last array<long>", "append", GroupStateTimeout.NoTimeout)
