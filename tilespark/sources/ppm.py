"""Text images of the P3 kind, and files of bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import wrap_byte

#: A comment may stand between the tokens of the header only; a number is read as far as its digits go.
_GAP = r"\s+(?:#[^\n]*\n\s*)*"
HEADER = rf"(?s)^\s*P3{_GAP}([+-]?\d+)[^\s#]*{_GAP}([+-]?\d+)[^\s#]*{_GAP}([+-]?\d+)[^\s#]*\s(.*)$"


def read_text_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, text): one row a file."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.input_file_name().alias("path"))
    return files.select(F.xxhash64("path").alias("image_id"), "text")


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes): whole files, with an error where none can be read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("bytes"))


def image_headers(images: DataFrame) -> DataFrame:
    """image_meta of (image_id, text)."""
    get = lambda i: F.regexp_extract("text", HEADER, i).cast("int")
    return _checked(images).select("image_id", get(1).alias("width"), get(2).alias("height"), F.lit(1).alias("sx"), F.lit(1).alias("sy"), get(3).alias("max_val"), F.lit(False).alias("is_sampled"))


def _checked(images: DataFrame) -> DataFrame:
    start = F.regexp_extract("text", r"^\s*(\S*)", 1)
    fault = F.when(start != "P3", F.raise_error(F.concat(F.lit("not a P3 image: "), start))).when(~F.col("text").rlike(HEADER), F.raise_error(F.lit("the header of a P3 image ends early")))
    return images.withColumn("text", F.coalesce(fault.cast("string"), F.col("text")))


def parse_text_images(images: DataFrame) -> DataFrame:
    """(image_id, y, x, r, g, b) of (image_id, text): row by row, values wrapped to a byte.

    Errors: another magic word, a header that ends early, too few numbers, and anything but numbers among them,
    comments included. Tokens beyond the last pixel are ignored.
    """
    get = lambda i: F.regexp_extract("text", HEADER, i)
    body = _checked(images).select("image_id", get(1).cast("int").alias("w"), get(2).cast("int").alias("h"), F.split(F.trim(F.regexp_replace(get(4), r"\s+", " ")), " ").alias("t"))
    need = F.col("w") * F.col("h") * 3
    body = body.select("image_id", "w", F.when(F.size("t") < need, F.raise_error(F.lit("too few numbers in a P3 image")).cast("array<string>")).otherwise(F.slice("t", F.lit(1), need)).alias("t"))
    number = lambda k: F.when(F.regexp_extract(F.get("t", 3 * F.col("p") + k), r"^[+-]?\d+", 0) == "", F.raise_error(F.lit("a pixel is not a number")).cast("int")).otherwise(wrap_byte(F.regexp_extract(F.get("t", 3 * F.col("p") + k), r"^[+-]?\d+", 0).cast("long")))
    cells = body.withColumn("p", F.explode(F.sequence(F.lit(0), F.floor(F.size("t") / 3).cast("int") - 1)))
    return cells.select("image_id", F.floor(F.col("p") / F.col("w")).cast("int").alias("y"), (F.col("p") % F.col("w")).cast("int").alias("x"), number(0).alias("r"), number(1).alias("g"), number(2).alias("b"))
