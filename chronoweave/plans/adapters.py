"""Views of business tables as inputs of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as signals in rows: clip_id, label, i, x."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip_id"), "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as signals in rows: one clip for each type and day, 24 samples, the sum of values in each hour."""
    events = table(spark, sf_dir, "events")
    hour = F.floor(F.unix_timestamp("ts") / 3600)
    sums = events.groupBy("event_type", hour.alias("h")).agg(F.sum("value").alias("x"))
    days = sums.select("event_type", F.floor(F.col("h") / 24).alias("day")).distinct()
    grid = days.select("event_type", "day", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("i")).withColumn("h", F.col("day") * 24 + F.col("i"))
    return grid.join(sums, ["event_type", "h"], "left").select(F.concat_ws("/", "event_type", F.col("day").cast("string")).alias("clip_id"), "i", F.coalesce("x", F.lit(0.0)).alias("x"))


#: Takes of the shoot: each device records TAKES times LENGTH hours; takes begin STEP hours apart, devices STAGGER hours apart.
TAKES, LENGTH, STEP, STAGGER, RATE = 3, 160, 224, 16, 8.0


def shoot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a shoot: five devices, which each see all events but those of their own type, record three takes."""
    events = table(spark, sf_dir, "events")
    hour = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))) / 3600).cast("int")
    sums = events.groupBy("event_type", hour.alias("h")).agg(F.sum("value").alias("v"))
    kinds = events.select("event_type").distinct()
    named = kinds.alias("a").join(kinds.alias("b"), F.expr("b.event_type <= a.event_type")).groupBy(F.col("a.event_type").alias("t")).agg((F.count("*") - 1).cast("int").alias("k"))
    takes = named.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(TAKES - 1)))).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(LENGTH - 1))))
    takes = takes.withColumn("h", STEP * F.col("m") + STAGGER * F.col("k") + F.col("s"))
    seen = takes.join(sums, "h", "left").groupBy("t", "k", "m", "s").agg(F.coalesce(F.sum(F.when(F.col("event_type") != F.col("t"), F.col("v"))), F.lit(0.0)).alias("x"))
    arrays = seen.groupBy("t", "k", "m").agg(F.array_sort(F.collect_list(F.struct("s", "x"))).alias("sx"))
    nothing = lambda kind: F.lit(None).cast(kind)
    return arrays.select(
        F.lit("shoot").alias("project_id"), (F.col("k") * TAKES + F.col("m")).cast("int").alias("clip_index"), F.concat_ws("-", "t", F.col("m").cast("string")).alias("clip_id"), F.col("t").alias("track_id"),
        F.concat_ws("-", "t", F.col("m").cast("string")).alias("name"), F.lit(RATE).alias("sample_rate"), F.col("sx.x").alias("samples"), nothing("double").alias("timecode_seconds"),
        nothing("double").alias("recorded_at_seconds"), nothing("string").alias("recorded_at_source"), nothing("double").alias("frame_rate"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders, each numbered within its order: l_linenumber repeats."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").withColumn("line", F.row_number().over(order))


def recordings(spark: SparkSession, sf_dir: str, named: bool = True) -> DataFrame:
    """Lines of orders as clips without signal: a part is a project, its supplier the device, and seven years are pressed into times that meet. ``recorded_at`` is there for all, trusted or not.

    Without names there is no clip_id, and clip_index is some number of each
    clip of an order, so that the lines of an order need not be brought together.
    """
    at = F.unix_timestamp("l_shipdate") / 5000.0
    if named:
        rows = lines(spark, sf_dir)
        names = [(F.col("l_orderkey") * 100 + F.col("line")).alias("clip_index"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("line").cast("string")).alias("clip_id")]
    else:
        rows = table(spark, sf_dir, "lineitem")
        names = [F.when(F.col("l_orderkey").isNotNull(), F.monotonically_increasing_id()).alias("clip_index")]
    return rows.select(
        F.col("l_partkey").cast("string").alias("project_id"), *names, F.col("l_suppkey").cast("string").alias("track_id"),
        (F.col("l_quantity") * 60.0).alias("duration_seconds"), at.alias("recorded_at"), F.when(F.col("l_returnflag") != "N", at).alias("trusted_at"),
    )


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: a path made of the URL's, with a made-up name; size and time of change from the page."""
    pages = table(spark, sf_dir, "pages")
    folder = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("MP4", "wav", "mov", "mp3", "txt")]), (F.col("page_id") % 5 + 1).cast("int"))
    number = F.col("page_id").cast("string")
    padded = F.lpad(number, F.greatest(F.lit(4), F.length(number)), F.lit("0"))  # lpad cuts what is longer
    name = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("C2_", "A001C0", "clip", "Z", "01 ", "GX-")]), (F.col("page_id") % 6 + 1).cast("int")), padded, F.lit("."), kind)
    card = F.when(F.col("page_id") % 7 == 0, F.lit("/PRIVATE/AVCHD")).when(F.col("page_id") % 7 == 1, F.lit("/DCIM")).when(F.col("page_id") % 7 == 2, F.lit("/Contents/CLIP")).otherwise(F.lit(""))
    return pages.select(
        "page_id", F.concat(folder, card, F.lit("/"), name).alias("path"), F.length("html").cast("long").alias("size"), (F.col("page_id") * 1000).cast("long").alias("modified"), (F.col("page_id") % 4 != 0).alias("has_video")
    )
