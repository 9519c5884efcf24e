"""Sequential filters over vehicles too large for one task.

A filter step needs the state after the row before, so the slices of a hot vehicle depend on
each other. All slices start at once from a guess; then every slice whose start differs from
the end of the slice before it is run again from that end. A filter that is corrected often
forgets its start, so few passes settle it. After ``speculate`` passes only the first
unsettled slice of each vehicle is run, so the work stays linear for a filter that forgets
nothing. The loop ends when every start equals the end before it: the result is that of the
plain sequential run.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackfold.session import cut

START_CODE = 9
KEYS = ["vehicle", "slice"]
ROWS_PER_TASK = 2_000_000


def with_starts(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Put each slice's start state in front of its rows, as a row of code ``START_CODE``."""
    lead = starts.select(
        *KEYS,
        F.lit(-(2**63)).cast("bigint").alias("t_ms"),
        F.lit(START_CODE).cast("tinyint").alias("code"),
        F.col("start").alias("state"),
    )
    return rows.withColumn("state", F.lit(None).cast("array<double>")).unionByName(lead, allowMissingColumns=True)


def gather(rows: DataFrame, total: int | None = None, by_time: bool = False) -> DataFrame:
    """Rows of a vehicle (or slice) in one partition and in order, ready to be folded.

    They follow one another there, or with ``by_time`` all vehicles of the partition are in one order of time.

    The number of partitions is set, from the number of rows where that is known: adaptive
    execution would judge the few bytes per row and put the whole fold, which is bound by
    computing, into few tasks.
    """
    keys = [k for k in KEYS if k in rows.columns]
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if total is not None:
        partitions = max(partitions, ceil(total / ROWS_PER_TASK))
    return rows.repartition(partitions, *keys).sortWithinPartitions(*([] if by_time else keys), "t_ms", "seq")


def settle(
    rows: DataFrame,
    run: Callable[[DataFrame], DataFrame],
    first: Column,
    guess: Callable[[DataFrame], DataFrame] | None = None,
    speculate: int = 3,
) -> DataFrame:
    """Start state of every slice: ``vehicle, slice, start``.

    ``rows`` are a table cut into slices. ``run`` maps rows with starts to
    ``vehicle, slice, end``. ``first`` is the state before a vehicle's first row. ``guess`` gives
    ``vehicle, slice, start`` for all slices; without it nothing is speculated.

    One small table per pass holds each slice's last start and end, the start it ought to have
    (``next``) and whether the two differ (``open``).
    """
    order = Window.partitionBy("vehicle").orderBy("slice")
    leading = F.row_number().over(order) == 1
    state = F.lit(None).cast("array<double>")
    if guess is None:
        table = rows.select(*KEYS).distinct().withColumn("next", F.when(leading, first))
    else:
        table = guess(rows).select(*KEYS, F.when(leading, first).otherwise(F.col("start")).alias("next"))
    table = table.select(*KEYS, state.alias("start"), state.alias("end"), "next",
                         F.col("next").isNotNull().alias("open"))
    passes = 0
    while True:
        table = cut(table)
        pending = table.filter("open")
        if pending.isEmpty():
            return table.select(*KEYS, "start")
        if guess is None or passes >= speculate:
            # everything before the first open slice is final already
            pending = pending.withColumn("_n", F.row_number().over(order)).filter("_n = 1")
        pending = pending.select(*KEYS, F.col("next").alias("start"))
        ends = run(with_starts(rows.join(pending.select(*KEYS), KEYS, "left_semi"), pending))
        table = (
            table.select(*KEYS, F.col("start").alias("_start"), F.col("end").alias("_end"))
            .join(pending, KEYS, "left")
            .join(ends, KEYS, "left")
            .select(*KEYS, F.coalesce("start", "_start").alias("start"), F.coalesce("end", "_end").alias("end"))
            .withColumn("next", F.when(leading, first).otherwise(F.lag("end").over(order)))
            .withColumn("open", F.col("next").isNotNull() & ~F.col("next").eqNullSafe(F.col("start")))
        )
        passes += 1
