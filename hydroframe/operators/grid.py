"""Connected components of grids larger than a task: tiles labelled apart, seams joined to a fixed point."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydroframe.operators.spectral import label_runs
from hydroframe.sources.scratch import checkpointed

#: Rows of a tile, and columns that a row may have. A cell's number is its row times COLUMNS plus its column.
TILE_ROWS, COLUMNS = 4096, 1 << 20


def tile_runs(grid: DataFrame, threshold: float, tile_rows: int) -> DataFrame:
    """Runs of cells at or above the threshold: row, begin, stop, and label, the number of the first cell of the run's component within its tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows, lines = None, [], []

        def labelled() -> pa.RecordBatch:
            found = label_runs(rows, (np.flatnonzero(np.diff(np.concatenate([[0], x.astype(np.int8), [0]]))) for x in lines))
            own = np.array(found, np.int64).reshape(-1, 5)
            return pa.RecordBatch.from_arrays([pa.array(own[:, k]) for k in range(3)] + [pa.array(own[:, 3] * COLUMNS + own[:, 4])], names=["row", "begin", "stop", "label"])

        for batch in batches:
            for row, values in zip(batch["row"].to_pylist(), batch["samples"], strict=True):
                if row // tile_rows != tile:
                    if rows:
                        yield labelled()
                    tile, rows, lines = row // tile_rows, [], []
                rows.append(row)
                lines.append(np.asarray(values.values.to_numpy(zero_copy_only=False), float) >= threshold if values.is_valid else np.zeros(0, bool))
        if rows:
            yield labelled()

    tile = F.floor(F.col("row") / tile_rows)
    # a fixed number of tasks: Spark would join tiles by the size of the table
    tasks = int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = grid.select("row", "samples").repartition(tasks, tile).sortWithinPartitions("row")
    return dealt.mapInArrow(run, "row long, begin long, stop long, label long")


def stars(edges: DataFrame) -> DataFrame:
    """(a, b): each node of a graph, but the least of its component, with that one. ``edges``: a, b.

    Edges to larger neighbours go to the least neighbour, then those to smaller ones do, in turn, until
    nothing changes; a chain of n nodes takes some log n turns. Nodes meet by joins and minima, so that one
    with many neighbours is no group.
    """
    known = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        seen = known.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            return known
        state = seen
        both = known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        known = checkpointed(small.where("a <> b").distinct())


def ranked(values: DataFrame, name: str) -> DataFrame:
    """Distinct ``name`` with number, from 1 in ascending order; ranges are numbered apart and moved by what lies before them."""
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = checkpointed(values.select(name).distinct().repartitionByRange(n, name).withColumn("part", F.spark_partition_id()))
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row a range
    return parts.join(before, "part").select(name, (F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(name))).alias("number"))


def label_grid(grid: DataFrame, threshold: float, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Runs (row, begin, stop) of a grid's cells at or above the threshold, with component, numbered by scan order of first cells.

    ``grid``: row (from 0, distinct; rows that are missing part their neighbours) and samples. Cells of
    a component touch by side or corner. Tiles of ``tile_rows`` rows are labelled each for itself; runs that
    touch across a seam join their tiles' components. Null rows have no cells, and neither have
    null and undefined values.
    """
    runs = checkpointed(tile_runs(grid, threshold, tile_rows))
    upper = runs.where((F.col("row") + 1) % tile_rows == 0).select((F.col("row") + 1).alias("row"), F.col("begin").alias("a0"), F.col("stop").alias("a1"), F.col("label").alias("a"))
    lower = runs.where(F.col("row") % tile_rows == 0).select("row", F.col("begin").alias("b0"), F.col("stop").alias("b1"), F.col("label").alias("b"))
    touching = upper.join(lower, "row").where("a0 <= b1 AND b0 <= a1").select("a", "b")
    joined = stars(touching).select(F.col("a").alias("label"), F.col("b").alias("first"))
    rooted = checkpointed(runs.join(joined, "label", "left").select("row", "begin", "stop", F.coalesce("first", "label").alias("first")))
    return rooted.join(ranked(rooted, "first"), "first").select("row", "begin", "stop", F.col("number").alias("component"))


def component_bounds(runs: DataFrame) -> DataFrame:
    """Per component of label_grid: cells, first_row, last_row, first_bin and last_bin."""
    return runs.groupBy("component").agg(F.sum(F.col("stop") - F.col("begin")).alias("cells"), F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.min("begin").alias("first_bin"), (F.max("stop") - 1).alias("last_bin"))
