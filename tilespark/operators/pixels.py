"""Operators on pixels (image_id, y, x, c1, c2, c3): each a projection, one grouped average or one equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import COLOUR, SHIFT

CHANNELS = ("c1", "c2", "c3")


def pad_edge(pixels: DataFrame, width: int, height: int, step_x: int, step_y: int) -> DataFrame:
    """Pixels up to multiples of the steps; the last row and column are repeated.

    No join: a pixel of the last column or row emits its copies itself, so the plan has no shuffle.
    """
    wide, high = -(-width // step_x) * step_x, -(-height // step_y) * step_y
    span = lambda c, size, full: F.when(F.col(c) == size - 1, F.sequence(F.lit(size - 1), F.lit(full - 1))).otherwise(F.array(F.col(c)))
    ys = pixels.withColumn("y", F.explode(span("y", height, high)))
    return ys.withColumn("x", F.explode(span("x", width, wide)))


def rgb_to_ycbcr(pixels: DataFrame, max_val: float | None = None) -> DataFrame:
    """Luma and both chroma channels, centred on 0; with max_val divided by it."""
    names = dict(zip(CHANNELS, COLOUR))
    out = {c: sum((F.col(s) * w for s, w in zip(CHANNELS, weights)), F.lit(shift)) for (c, weights), shift in zip(names.items(), SHIFT)}
    if max_val:
        out = {c: v / float(max_val) for c, v in out.items()}
    return pixels.select("image_id", "y", "x", *[v.alias(c) for c, v in out.items()])


def _fail_if_sampled(is_sampled: bool) -> None:
    if is_sampled:
        raise ValueError("the image is sampled already")


def subsample_average(pixels: DataFrame, sx: int, sy: int, is_sampled: bool = False) -> DataFrame:
    """(image_id, cy, cx, c2, c3): mean chroma of each sy by sx tile; combined before the shuffle."""
    _fail_if_sampled(is_sampled)
    tile = (F.floor(F.col("y") / sy).cast("int").alias("cy"), F.floor(F.col("x") / sx).cast("int").alias("cx"))
    return pixels.groupBy("image_id", *tile).agg(F.avg("c2").alias("c2"), F.avg("c3").alias("c3"))


def subsample_stride(pixels: DataFrame, channel: str, cols: int, rows: int) -> DataFrame:
    """(image_id, cy, cx, v): every cols-th column and rows-th row of one channel."""
    kept = pixels.where((F.col("y") % rows == 0) & (F.col("x") % cols == 0))
    return kept.select("image_id", F.floor(F.col("y") / rows).cast("int").alias("cy"), F.floor(F.col("x") / cols).cast("int").alias("cx"), F.col(channel).alias("v"))


def upsample_nearest(luma: DataFrame, chroma: DataFrame, sx: int, sy: int) -> DataFrame:
    """Full pixels of luma (image_id, y, x, c1) and subsampled chroma (image_id, cy, cx, c2, c3)."""
    keyed = luma.withColumns({"cy": F.floor(F.col("y") / sy).cast("int"), "cx": F.floor(F.col("x") / sx).cast("int")})
    return keyed.join(chroma, ["image_id", "cy", "cx"]).select("image_id", "y", "x", *CHANNELS)


def replace_pixels(pixels: DataFrame, changes: DataFrame, sx: int = 1, sy: int = 1) -> DataFrame:
    """pixels with the values of changes (image_id, y, x, c1, c2, c3, seq) written, the last one by seq to a place.

    With subsampled chroma (sx, sy) a change writes chroma to its tile's place.
    """
    last = lambda c, *key: changes.withColumns({"y": F.floor(F.col("y") / key[0]).cast("int"), "x": F.floor(F.col("x") / key[1]).cast("int")}).groupBy("image_id", "y", "x").agg(*[F.max_by(n, "seq").alias(f"_{n}") for n in c])
    out = pixels.join(last(["c1"], 1, 1), ["image_id", "y", "x"], "left").join(last(["c2", "c3"], sy, sx), ["image_id", "y", "x"], "left")
    return out.select("image_id", "y", "x", *[F.coalesce(f"_{c}", c).alias(c) for c in CHANNELS])


def unpivot_planes(pixels: DataFrame) -> DataFrame:
    """(image_id, comp, y, x, v): one row a channel."""
    return pixels.select("image_id", "y", "x", F.expr("stack(3, 0, c1, 1, c2, 2, c3) AS (comp, v)")).select("image_id", "comp", "y", "x", "v")


def to_blocks(planes: DataFrame) -> DataFrame:
    """(image_id, comp, block_row, block_col, block): 64 values row by row, from planes (image_id, comp, y, x, v).

    The one shuffle of an image: from here on a row is a block.
    """
    at = (F.col("y") % 8 * 8 + F.col("x") % 8).cast("int")
    keyed = planes.select("image_id", "comp", F.floor(F.col("y") / 8).cast("int").alias("block_row"), F.floor(F.col("x") / 8).cast("int").alias("block_col"), F.struct(at.alias("at"), "v").alias("cell"))
    grouped = keyed.groupBy("image_id", "comp", "block_row", "block_col").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    return grouped.select("image_id", "comp", "block_row", "block_col", F.col("cells.v").alias("block"))
