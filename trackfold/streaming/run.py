"""Running a streaming job over what has arrived so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackfold.session import scratch_path
from trackfold.streaming.jobs import END_MS

END = T.StructType([
    T.StructField("vehicle", T.StringType()), T.StructField("t_ms", T.LongType()), T.StructField("kind", T.StringType())])


def end_mark(spark: SparkSession, name: str) -> str:
    """A folder for the mark that ends a recording; ``drain`` writes it when all has been read."""
    path = scratch_path(spark, f"{name}-end")
    spark.createDataFrame([], END).write.parquet(path)
    return path


def with_end(rows: DataFrame, end: str, kind: str = "odo") -> DataFrame:
    """A stream with the mark of its end, which passes for a row of ``kind``."""
    marks = rows.sparkSession.readStream.schema(END).parquet(end)
    if kind != "odo":
        marks = marks.selectExpr("vehicle", "t_ms", f"'{kind}' AS kind")
    if "kind" not in rows.columns:
        marks = marks.drop("kind")
    kind_of_seq = rows.schema["seq"].dataType
    # not null: pandas would turn whole numbers beside a null into floats
    first = F.lit(0) if not isinstance(kind_of_seq, T.StructType) else F.struct(*[
        F.lit("" if isinstance(f.dataType, T.StringType) else 0).cast(f.dataType).alias(f.name) for f in kind_of_seq])
    marks = marks.withColumn("seq", first.cast(kind_of_seq))
    return rows.unionByName(marks, allowMissingColumns=True)


def drain(
    stream: DataFrame, name: str, output: str | None = None, checkpoint: str | None = None, end: str | None = None,
) -> DataFrame:
    """Process everything available into a parquet table and read it back.

    With ``end`` the recording is over: once all is read the mark is written there, which moves the
    watermark past every row, and a second run brings out what has waited. Paths default to new
    ones below the shared folder; give both to continue an earlier run.
    """
    spark = stream.sparkSession
    output = output or scratch_path(spark, f"{name}-rows")
    checkpoint = checkpoint or scratch_path(spark, f"{name}-state")

    def run() -> None:
        query = (
            stream.writeStream.format("parquet")
            .option("path", output)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    run()
    if end is not None:
        spark.createDataFrame([("", END_MS, "odo")], END).coalesce(1).write.mode("append").parquet(end)
        run()
    return spark.read.schema(stream.schema).parquet(output)
