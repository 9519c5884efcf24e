"""Ordered per-vehicle computations that do not hang on the size of one vehicle.

Rows of a vehicle are ordered by ``(t_ms, seq)``. Vehicles of usual size are one window
partition each. A vehicle with more than ``hot_rows`` rows is cut by a range partitioning
into slices of consecutive rows; every step then runs inside the slices, and what one
slice hands to the next is worked out on a table with one row per slice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackfold.session import cut

ORDER = ("t_ms", "seq")
HOT_ROWS = 2_000_000
BROADCAST_VEHICLES = 100_000


@dataclass(frozen=True)
class Split:
    """Rows of usual vehicles, sliced rows of hot vehicles (or None), how many rows in all and hot, how many vehicles."""

    usual: DataFrame
    hot: DataFrame | None
    rows: int | None
    hot_rows: int | None = None
    vehicles: int | None = None


def split_hot(rows: DataFrame, hot_rows: int | None = HOT_ROWS, sized_by: DataFrame | None = None) -> Split:
    """Set the vehicles with more than ``hot_rows`` rows apart and cut them into slices.

    One job counts rows per vehicle; it reads the columns behind ``vehicle`` only and combines
    on the map side. Sliced rows carry a ``slice`` number that rises with the row order.
    ``sized_by`` is counted instead of ``rows`` where these are costly to compute: any rows with
    as many rows per vehicle, such as the input of a filter for its output.
    """
    if hot_rows is None:
        return Split(rows, None, None)
    counts = (rows if sized_by is None else sized_by).groupBy("vehicle").count()
    many = F.col("count") > hot_rows
    # at most (all rows / hot_rows) vehicles can be hot
    total, vehicles, theirs, fleet = counts.agg(
        F.sum("count"), F.count_if(many), F.sum(F.when(many, F.col("count"))), F.count(F.lit(1))).first()
    if not vehicles:
        return Split(rows, None, total, vehicles=fleet)
    names = cut(counts.filter(many).select("vehicle"))
    side = F.broadcast(names) if vehicles <= BROADCAST_VEHICLES else names
    usual = rows.join(side, "vehicle", "left_anti")
    hot = (
        rows.join(side, "vehicle", "left_semi")
        .repartitionByRange(ceil(theirs / hot_rows) + 1, "vehicle", *ORDER)
        .withColumn("slice", F.spark_partition_id())
    )
    # range bounds come from sampling, so the slices are written down before they are used;
    # a slice is one task's output and becomes one folder
    return Split(usual, cut(hot, "slice"), total, theirs, fleet)


class Ordered:
    """Rows of vehicles in time order, whole (keys = vehicle) or sliced (vehicle, slice)."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.sliced = "slice" in df.columns
        self.keys = ["vehicle", "slice"] if self.sliced else ["vehicle"]

    @property
    def window(self):
        return Window.partitionBy(*self.keys).orderBy(*ORDER)

    def with_columns(self, **columns: Column) -> "Ordered":
        return Ordered(self.df.withColumns(columns))

    def previous(self, **columns: Column) -> "Ordered":
        """Add each value as it was on the row before; null on a vehicle's first row."""
        value = F.struct(*[c.alias(n) for n, c in columns.items()])
        df = self.df.withColumn("_before", F.lag(value).over(self.window))
        if self.sliced:
            df = self._hand_over(df, F.max_by(value, F.struct(*ORDER)), lambda w: F.lag("_end").over(w))
            df = df.withColumn("_before", F.coalesce("_before", "_carry")).drop("_carry")
        return Ordered(df.withColumns({n: F.col(f"_before.{n}") for n in columns}).drop("_before"))

    def running_sum(self, **columns: Column) -> "Ordered":
        """Add the sum of each value from the vehicle's first row to this one."""
        upto = self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        if not self.sliced:
            return Ordered(self.df.withColumns({n: F.sum(c).over(upto) for n, c in columns.items()}))
        ends = F.struct(*[F.sum(c).alias(n) for n, c in columns.items()])
        df = self.df.withColumns({f"_in_{n}": F.sum(c).over(upto) for n, c in columns.items()})
        df = self._hand_over(
            df,
            ends,
            lambda w: F.struct(*[
                F.sum(F.col(f"_end.{n}")).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias(n)
                for n in columns
            ]),
        )
        # null only as long as no value was seen, as in an uncut window
        df = df.withColumns({
            n: F.when(F.col(f"_carry.{n}").isNull(), F.col(f"_in_{n}"))
            .otherwise(F.col(f"_carry.{n}") + F.coalesce(F.col(f"_in_{n}"), F.lit(0)))
            for n in columns})
        return Ordered(df.drop("_carry", *[f"_in_{n}" for n in columns]))

    def last_seen(self, name: str, value: Column) -> "Ordered":
        """Add the latest non-null value among the rows strictly before this one."""
        before = self.window.rowsBetween(Window.unboundedPreceding, -1)
        df = self.df.withColumn(name, F.last(value, ignorenulls=True).over(before))
        if self.sliced:
            df = self._hand_over(
                df,
                F.max_by(value, F.when(value.isNotNull(), F.struct(*ORDER))),
                lambda w: F.last("_end", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
            )
            df = df.withColumn(name, F.coalesce(name, "_carry")).drop("_carry")
        return Ordered(df)

    def _hand_over(self, df: DataFrame, end: Column, carry: Callable) -> DataFrame:
        """Join to each slice what the slices before it leave behind, as ``_carry``."""
        ends = self.df.groupBy(*self.keys).agg(end.alias("_end"))
        slices = Window.partitionBy("vehicle").orderBy("slice")
        return df.join(ends.select(*self.keys, carry(slices).alias("_carry")), self.keys, "left")


def in_order(
    rows: DataFrame, body: Callable[[Ordered], DataFrame], hot_rows: int | None = HOT_ROWS,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Apply ``body`` to the usual vehicles and to the slices of the hot ones."""
    split = split_hot(rows, hot_rows, sized_by)
    out = body(Ordered(split.usual))
    if split.hot is None:
        return out
    return out.unionByName(body(Ordered(split.hot)).select(out.columns))
