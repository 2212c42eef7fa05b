"""A stored index of upstream areas: cells in an order in which all that drains through a cell is one range.

A cell is numbered before all that drains into it, and each inflow takes as
many numbers as it has cells upstream.  So a cell's number is the sum, along
its downstream path, of one for the step and the sizes of the inflows that
come before at each confluence: one doubling.  The upstream area of any cell
is then ``place`` to ``last``, and many outlets are answered by one scan of
the slices that their ranges touch, without following any path again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hydrospark.operators.flow import plus, pull, sized
from hydrospark.operators.ranges import every_range
from hydrospark.operators.ranking import global_rank, latest_before, running_total
from hydrospark.storage import write_table

#: Cells in a slice of the stored index, which is a folder of its own.
SLICE = 1 << 22


def number(flow: DataFrame) -> DataFrame:
    """``cell, place, last`` for a flow graph ``cell, nxt``: cells upstream of a cell, itself included, have the numbers ``place`` to ``last``.

    Inflows of a cell, and ends of paths, go by their cell number.  A next cell
    that the graph doesn't have ends the path.  Cells are distinct; an empty
    graph gives no rows, a cycle is an error.
    """
    sizes = sized(flow)
    # a cell has few inflows: eight on a grid
    before = F.sum("acc").over(Window.partitionBy("nxt").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("acc")
    inner = sizes.where("nxt is not null").select("cell", "nxt", "acc", (before + 1).alias("before"))
    ends = running_total(sizes.where("nxt is null"), F.col("acc"), F.col("cell")).select("cell", "nxt", "acc", "before")
    places = pull(inner.unionByName(ends), {"place": F.col("before")}, plus, kept=["acc"])
    return places.select("cell", "place", (F.col("place") + F.col("acc") - 1).alias("last"))


def write_index(flow: DataFrame, path: str, slice_cells: int = SLICE) -> None:
    """Store the index of a flow graph: once by slices of ``place``, once by slices of ``cell``, each sorted within a slice."""
    rows = write_table(number(flow), "numbers").df
    for key in ("place", "cell"):
        sliced = rows.withColumn("slice", F.floor(F.col(key) / slice_cells))
        dealt = sliced.repartitionByRange("slice", key).sortWithinPartitions("slice", key)
        dealt.write.partitionBy("slice").parquet(f"{path}/by_{key}")
    flow.sparkSession.createDataFrame([(slice_cells,)], "slice_cells long").coalesce(1).write.parquet(f"{path}/size")


class UpstreamIndex:
    """Reads a stored index.

    Outlets are a table ``cell``; repeated ones count once, those that the
    graph doesn't have, and null, have no rows.  Which slices are read is
    decided by their numbers, of which there are no more than folders.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.slice_cells = spark.read.parquet(f"{path}/size").first()[0]

    def _slices(self, key: str, wanted: DataFrame) -> DataFrame:
        numbers = sorted(r[0] for r in wanted.distinct().collect())
        schema = "cell long, place long, last long, slice long"
        return self.spark.read.schema(schema).parquet(f"{self.path}/by_{key}").where(F.col("slice").isin(numbers))

    def spans(self, outlets: DataFrame) -> DataFrame:
        """``outlet, place, last``, from the slices of cells that hold outlets."""
        asked = outlets.select("cell").where("cell is not null").distinct()
        rows = self._slices("cell", asked.select(F.floor(F.col("cell") / self.slice_cells)))
        return write_table(rows.join(asked, "cell").select(F.col("cell").alias("outlet"), "place", "last"), "spans").df

    def _held(self, spans: DataFrame) -> DataFrame:
        size = self.slice_cells
        touched = spans.select(F.explode(F.sequence(F.floor(F.col("place") / size), F.floor(F.col("last") / size))))
        return self._slices("place", touched).select("cell", "place")

    def upstream(self, outlets: DataFrame) -> DataFrame:
        """``outlet, cell``: every cell that drains through an outlet, the outlet included; nested outlets each get all of theirs."""
        spans = self.spans(outlets)
        return every_range(self._held(spans), spans.select("outlet", F.col("place").alias("low"), F.col("last").alias("high")), [("place", "low", "high")], "outlet").select("outlet", "cell")

    def basins(self, outlets: DataFrame) -> DataFrame:
        """``cell, label``: the first outlet that a cell drains through, as ``flow.basin_labels`` gives it."""
        spans = self.spans(outlets)
        # pieces lie apart, so a cell meets one of them at most
        return every_range(self._held(spans), nearest_pieces(spans), [("place", "low", "high")], "outlet").select("cell", F.col("outlet").alias("label"))


def nearest_pieces(spans: DataFrame) -> DataFrame:
    """``outlet, low, high``: the numbers cut at the ends of all spans (``outlet, place, last``), each piece with its innermost span.

    Spans are nested or apart.  The number of spans open at an end is a running
    sum, and the innermost of d open spans is the latest one that was the d-th
    to open.  So spans in spans, however deep, cost two rows each.
    """
    opened = spans.select(F.col("place").alias("at"), F.lit(1).alias("opens"), "outlet")
    closed = spans.select((F.col("last") + 1).alias("at"), F.lit(0).alias("opens"), "outlet")
    events = running_total(opened.unionByName(closed), 2 * F.col("opens") - 1, F.col("at"), F.col("opens"), F.col("outlet"), name="open")
    events = events.withColumn("depth", F.col("open") + 2 * F.col("opens") - 1)
    found = latest_before(events, F.when(F.col("opens") == 1, F.col("outlet")), F.col("depth"), F.col("at"), F.col("opens"), F.col("outlet"), name="inner")
    label = F.when(F.col("depth") > 0, F.col("inner"))
    # where several spans end the outermost decides, and a span that begins there comes after them
    borders = found.groupBy("at").agg(F.max_by(label, F.struct("opens", -F.col("depth"))).alias("outlet"))
    placed = write_table(global_rank(borders, F.col("at")), "borders").df
    after = placed.select((F.col("rank") - 1).alias("rank"), (F.col("at") - 1).alias("high"))
    return placed.join(after, "rank").where("outlet is not null").select("outlet", F.col("at").alias("low"), "high")
