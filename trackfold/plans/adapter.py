"""The driver's tables as sensor recordings. The SQL side builds the same rows in ``oracles``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamReader

from trackfold.schema import EKF_START, EkfConfig, SlamConfig, Start
from trackfold.session import tune

EPOCH_MS = 1704067200000  # 2024-01-01, the first day of the events table
TICK_MS = 100000
START = Start(EKF_START.x, EKF_START.y, 0.0, 0)
EKF = EkfConfig(start=START)
SLAM = SlamConfig(start=Start())
EVENT_TYPES = {"odo": ("click", "view", "signup"), "gps": ("purchase",)}
SCANS_PER_VEHICLE = 4
MICRO_BATCH = 1 << 30  # bytes
SCAN_SEQ = 10**15  # scans come after events of the same time

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
])

EMBEDDINGS = T.StructType([
    T.StructField("vec_id", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _arriving(spark: SparkSession, schema: T.StructType) -> DataStreamReader:
    """Files in micro-batches of bounded size, so a vehicle's rows within one stay bounded."""
    return tune(spark).readStream.schema(schema).option("maxBytesPerTrigger", MICRO_BATCH)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arriving(spark, EVENTS).parquet(f"{sf_dir}/events.parquet*")


def scan_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arriving(spark, EMBEDDINGS).parquet(f"{sf_dir}/embeddings.parquet*")


def sensor_rows(events: DataFrame) -> DataFrame:
    """Odometry and GPS rows of a fleet; other events keep their type as kind."""
    events.sparkSession.conf.set("spark.sql.session.timeZone", "UTC")
    number = F.col("event_id")
    kind = (
        F.when(F.col("event_type").isin(*EVENT_TYPES["odo"]), "odo")
        .when(F.col("event_type").isin(*EVENT_TYPES["gps"]), "gps")
        .otherwise(F.col("event_type"))
    )
    odo, gps = F.col("kind") == "odo", F.col("kind") == "gps"
    millis = F.unix_millis(F.col("ts").cast("timestamp")) - F.lit(EPOCH_MS)
    return events.select(
        F.concat(F.lit("vehicle"), F.col("user_id").cast("string")).alias("vehicle"),
        F.floor(millis / F.lit(TICK_MS)).alias("t_ms"),
        number.alias("seq"),
        kind.alias("kind"),
        (F.col("value") / 100.0).alias("_speed"),
        ((number % 21 - 10) / 100.0).alias("_steering"),
        (F.lit(-67.65) + (number % 101 - 50) / 10.0).alias("_x"),
        (F.lit(-41.71) + (number % 89 - 44) / 10.0).alias("_y"),
    ).select(
        "vehicle", "t_ms", "seq", "kind",
        F.when(odo, F.col("_speed")).alias("speed"),
        F.when(odo, F.col("_steering")).alias("steering"),
        F.when(gps, F.col("_x")).alias("gps_x"),
        F.when(gps, F.col("_y")).alias("gps_y"),
    )


def sensors(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """Rows of the given kinds, chosen by a filter the parquet reader can use; all without one."""
    events = table(spark, sf_dir, "events")
    if kinds:
        events = events.filter(F.col("event_type").isin(*[t for k in kinds for t in EVENT_TYPES[k]]))
    return sensor_rows(events)


def scan_rows(embeddings: DataFrame) -> DataFrame:
    """Range scans in metres with pose increments, four scans per vehicle."""
    number = F.col("vec_id")
    return embeddings.select(
        F.concat(F.lit("vehicle"), F.floor(number / SCANS_PER_VEHICLE).cast("string")).alias("vehicle"),
        ((number % SCANS_PER_VEHICLE + 1) * 5000).alias("t_ms"),
        (number + F.lit(SCAN_SEQ)).alias("seq"),
        F.lit("laser").alias("kind"),
        (F.lit(0.5) + (number % 7) / 10.0).alias("x_inc"),
        ((number % 5 - 2) / 20.0).alias("y_inc"),
        ((number % 9 - 4) / 20.0).alias("phi_inc"),
        F.transform("embedding", lambda e: F.abs(e.cast("double")) * 100.0).alias("ranges"),
    )


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_rows(table(spark, sf_dir, "embeddings"))


def raw_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scans in centimetres, as the sensor gives them."""
    return scans(spark, sf_dir).withColumn("ranges", F.transform("ranges", lambda r: r * 100.0))


def mapping_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odometry of the vehicles together with their scans in centimetres."""
    odometry = sensors(spark, sf_dir, "odo").select(
        "vehicle", "t_ms", "seq", "kind", "speed", "steering"
    )
    laser = raw_scans(spark, sf_dir).select("vehicle", "t_ms", "seq", "kind", "ranges")
    return odometry.unionByName(laser, allowMissingColumns=True)


def tagged_lines(rows: DataFrame) -> DataFrame:
    """Sensor rows as the recorder writes them, with ``,`` or ``;`` between fields."""
    number = F.regexp_extract("vehicle", r"(\d+)$", 1)
    fields = (
        F.when(F.col("kind") == "odo", F.array("kind", F.col("t_ms").cast("string"),
                                               F.col("steering").cast("string"), F.col("speed").cast("string"), number))
        .when(F.col("kind") == "gps", F.array("kind", F.col("t_ms").cast("string"),
                                              F.col("gps_y").cast("string"), F.col("gps_x").cast("string"), number))
        .otherwise(F.array("kind", F.col("t_ms").cast("string"), F.col("seq").cast("string")))
    )
    line = F.when(F.col("seq") % 2 == 0, F.array_join(fields, ",")).otherwise(F.array_join(fields, ";"))
    return rows.select("seq", line.alias("value"))


def scan_text(ranges: str) -> Column:
    return F.concat(F.lit('"['), F.array_join(F.transform(ranges, lambda r: r.cast("string")), ", "), F.lit(']"'))
