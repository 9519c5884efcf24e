"""Matching observed objects to the known landmarks of a vehicle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackfold.functions import geometry
from trackfold.session import cut


# fine cells per ``match_below``: their diagonal is well below it, so few of them are cut by its circle
FINE = 4
# side of a square in ``ambiguous_below``: a landmark is near observations of four squares then
SQUARE = 2
SEEN = ["vehicle", "obs_id", "x", "y"]


def spread_boxes(placed: DataFrame, far: float, side: float) -> DataFrame:
    """Fine cells with a landmark as boxes, once for each square with places nearer than ``far``."""
    boxes = placed.groupBy("vehicle", "fx", "fy").agg(
        F.min("idx").alias("idx"), F.min_by("lx", "idx").alias("lx"), F.min_by("ly", "idx").alias("ly"),
        F.min("lx").alias("x0"), F.max("lx").alias("x1"), F.min("ly").alias("y0"), F.max("ly").alias("y1"),
    ).drop("fx", "fy")

    def squares(low: str, high: str) -> Column:
        # each step rises with its operand, also after rounding, so no place nearer than ``far`` is left out
        first, last = F.col(low) - F.lit(far), F.col(high) + F.lit(far)
        return F.explode(F.sequence(F.floor(first / F.lit(side)), F.floor(last / F.lit(side))))

    return boxes.select("*", squares("x0", "x1").alias("sx")).select("*", squares("y0", "y1").alias("sy"))


def associate(
    observations: DataFrame, landmarks: DataFrame, match_below: float = 0.4, ambiguous_below: float = 2.0
) -> DataFrame:
    """Status of every observation: ``match`` with a landmark, ``ambiguous`` or ``new``.

    ``observations``: vehicle, obs_id (unique), x, y. ``landmarks``: vehicle, idx, x, y.
    The landmark of lowest ``idx`` nearer than ``match_below`` wins, not the nearest one. Without
    a match, a landmark between the two limits makes the observation ambiguous.

    Landmarks are first gathered in fine cells, each with the box they fill and its lowest index. A
    box goes into the squares with places nearer to it than ``ambiguous_below``, an observation into
    its own only. A box that lies wholly on one side of both limits speaks for all its landmarks; a
    box of one place always does. Only of boxes that a limit cuts, and that could still change the
    answer, are the landmarks looked at one by one. So an observation meets a bounded number of
    cells, however many landmarks are in them.

    Observations and boxes meet once: what they make of each other is a table in the shared folder,
    a row per observation and one more for each box that a limit cuts.
    """
    far, side, fine = F.lit(ambiguous_below), SQUARE * ambiguous_below, F.lit(match_below / FINE)
    # a place that is not finite is near nothing, and would spoil the box it is put into
    known = landmarks.filter((F.abs("x") < F.lit(float("inf"))) & (F.abs("y") < F.lit(float("inf"))))
    placed = known.select(
        "vehicle", "idx", F.col("x").alias("lx"), F.col("y").alias("ly"),
        F.floor(F.col("x") / fine).alias("fx"), F.floor(F.col("y") / fine).alias("fy"),
    )
    spread = spread_boxes(placed, ambiguous_below, side).withColumnsRenamed({n: f"_{n}" for n in ("vehicle", "sx", "sy")})
    seen = observations.select(
        *SEEN, F.floor(F.col("x") / F.lit(side)).alias("sx"), F.floor(F.col("y") / F.lit(side)).alias("sy"))
    # the distance of every landmark of the box is between these, also after rounding: each step of
    # sight_range rises with its operands
    low = geometry.sight_range(
        F.greatest(F.col("x0") - F.col("x"), F.col("x") - F.col("x1"), F.lit(0.0)),
        F.greatest(F.col("y0") - F.col("y"), F.col("y") - F.col("y1"), F.lit(0.0)))
    high = geometry.sight_range(
        F.greatest(F.abs(F.col("x0") - F.col("x")), F.abs(F.col("x") - F.col("x1"))),
        F.greatest(F.abs(F.col("y0") - F.col("y")), F.abs(F.col("y") - F.col("y1"))))
    # the size of the spread-out boxes is not known beforehand: sorted and spillable, never
    # broadcast; adaptive execution splits crowded squares on the observation side
    near = (F.col("vehicle") == F.col("_vehicle")) & (F.col("sx") == F.col("_sx")) & (F.col("sy") == F.col("_sy"))
    pairs = seen.join(spread.hint("merge"), near & (low < far), "left").withColumns({"_low": low, "_high": high})
    one = (F.col("x0") == F.col("x1")) & (F.col("y0") == F.col("y1"))
    low, high = F.col("_low"), F.col("_high")
    inside = high < F.lit(match_below)
    between = (low > F.lit(match_below)) & (high < far)
    crossed = ~one & ~inside & ~between
    hit = F.when(inside, F.col("idx"))
    # numbers of fixed size only, so they are summed up in place and nothing is sorted
    met = cut(pairs.groupBy(
        *SEEN, F.when(crossed, F.floor(F.col("x0") / fine)).alias("fx"), F.when(crossed, F.floor(F.col("y0") / fine)).alias("fy"),
    ).agg(
        F.min(hit).alias("idx"), F.min_by("lx", hit).alias("lx"), F.min_by("ly", hit).alias("ly"),
        F.max(F.coalesce(between, F.lit(False))).alias("close"),
        # a box the smaller circle cuts may hold a match; any that is cut may hold a landmark between
        F.max(F.when(crossed, low < F.lit(match_below))).alias("may"),
        F.min(F.when(crossed, F.col("idx"))).alias("least"),
    ))
    found = met.groupBy(*SEEN).agg(F.min("idx").alias("_idx"), F.max("close").alias("_close"))
    parts = met.filter("fx IS NOT NULL").select(*SEEN, "fx", "fy", "may", "least")
    unsure = F.when(F.col("_idx").isNotNull(), F.col("may") & (F.col("least") < F.col("_idx"))).otherwise(F.col("may") | ~F.col("_close"))
    looked = parts.alias("p").join(found.alias("f"), F.expr(" AND ".join(f"p.{n} <=> f.{n}" for n in SEEN)))
    looked = looked.filter(unsure).select(*[f"p.{n}" for n in (*SEEN, "fx", "fy")])
    listed = placed.groupBy("vehicle", "fx", "fy", "lx", "ly").agg(F.min("idx").alias("idx"))
    away = geometry.sight_range(F.col("lx") - F.col("x"), F.col("ly") - F.col("y"))
    singly = looked.join(listed.hint("merge"), ["vehicle", "fx", "fy"]).withColumn("_d", away)
    hit = F.when(F.col("_d") < F.lit(match_below), F.col("idx"))
    between = (F.col("_d") > F.lit(match_below)) & (F.col("_d") < far)
    both = met.select(*SEEN, "idx", "lx", "ly", "close").unionByName(
        singly.select(*SEEN, hit.alias("idx"), "lx", "ly", between.alias("close")))
    best = both.groupBy(*SEEN).agg(
        F.min("idx").alias("landmark"), F.min_by("lx", "idx").alias("lx"), F.min_by("ly", "idx").alias("ly"),
        F.max("close").alias("close"))
    status = F.when(F.col("landmark").isNotNull(), "match").when(F.col("close"), "ambiguous").otherwise("new")
    return best.select(*SEEN, status.alias("status"), "landmark", "lx", "ly")
