"""Synthetic images and symbol lists, the same in every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bits import running_offsets

PIXELS = "image_id bigint, y int, x int, c1 double, c2 double, c3 double"
META = "image_id bigint, width int, height int, sx int, sy int, max_val int, is_sampled boolean"


def grid(spark: SparkSession, height: int, width: int) -> DataFrame:
    """(y, x): one range over all cells, so a large image is made by many tasks."""
    i = F.col("id")
    return spark.range(height * width).select(F.floor(i / width).cast("int").alias("y"), (i % width).cast("int").alias("x"))


def gradient_image(spark: SparkSession, height: int = 2160, width: int = 3840) -> DataFrame:
    """(y, x, m): the gray test gradient."""
    return grid(spark, height, width).select("y", "x", ((F.col("x") + 8 * F.col("y")) % 256).cast("int").alias("m"))


def colour_image(spark: SparkSession, height: int, width: int, image_id: int = 0) -> DataFrame:
    """pixels whose three channels differ, for chroma."""
    x, y = F.col("x"), F.col("y")
    return grid(spark, height, width).select(F.lit(image_id).cast("long").alias("image_id"), "y", "x", ((x + 8 * y) % 256).cast("double").alias("c1"), ((3 * x + y) % 256).cast("double").alias("c2"), ((x * y) % 256).cast("double").alias("c3"))


def empty_image(spark: SparkSession, width: int, height: int, max_val: int, image_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """(pixels without rows, metadata of an image that isn't sampled)."""
    return spark.createDataFrame([], PIXELS), spark.createDataFrame([(image_id, width, height, 1, 1, max_val, False)], META)


def symbol_runs(spark: SparkSession, runs: int, low: int, high: int, shortest: int, longest: int, total: int, seed: int = 1) -> DataFrame:
    """(seq, symbol): runs of random symbols and lengths until min(total, runs * longest) symbols are there.

    Draws are a linear congruence of the run's number, so any task makes any run by itself.
    """
    total = min(total, runs * longest)
    draw = lambda salt: F.pmod((F.col("id") * 1103515245 + (12345 + 7919 * (seed + salt))) % 2147483648, F.lit(2147483648))
    symbol = (F.floor(draw(0) / 65536) % (high - low + 1) + low).cast("int")
    count = (F.floor(draw(5) / 65536) % (longest - shortest + 1) + shortest).cast("int")
    # at least `shortest` a run, so this many runs are enough
    many = -(-total // max(1, shortest))
    made = spark.range(many).select("id", symbol.alias("symbol"), F.posexplode(F.array_repeat(F.lit(1), count)).alias("pos", "one"))
    starts = spark.range(many).select("id", count.alias("n"))
    placed = running_offsets(starts.withColumn("s", F.lit(0)), ["s"], "id", "n", "start").select("id", "start")
    return made.join(placed, "id").select((F.col("start") + F.col("pos")).alias("seq"), "symbol").where(F.col("seq") < total)


def value_images(blocks: DataFrame, id_col: str, array_col: str, scale: float = 1.0) -> DataFrame:
    """blocks (image_id, comp, block_row, block_col, block): each row's array of 64 numbers as one 8x8 block."""
    block = F.transform(F.col(array_col), lambda v: v.cast("double") * scale)
    return blocks.select(F.lit(0).cast("long").alias("image_id"), F.lit(0).alias("comp"), F.col(id_col).alias("scan"), block.alias("block"))
