"""Text forms: comparing texts line by line, and dumps of channels, codes and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import code_text


def first_difference(texts: DataFrame, left: str = "a", right: str = "b", key: str = "doc_id") -> DataFrame:
    """(key, first_diff): number of the first line (from 1) in which two texts differ, null if they are equal.

    A missing line differs from any, and a null text from any text. Lines of a row are compared within the row.
    """
    lines = texts.select(key, F.split(left, "\n", -1).alias("x"), F.split(right, "\n", -1).alias("y"))
    number = F.sequence(F.lit(0), F.greatest(F.coalesce(F.size("x"), F.lit(0)), F.coalesce(F.size("y"), F.lit(0)), F.lit(1)) - 1)
    differs = F.filter(number, lambda i: ~F.get(F.col("x"), i).eqNullSafe(F.get(F.col("y"), i)))
    return lines.select(key, (F.get(differs, F.lit(0)) + 1).alias("first_diff"))


def dump_lines(planes: DataFrame, width: int, decimals: int | None = None) -> DataFrame:
    """(image_id, comp, y, line): each row of a channel as text, numbers right-aligned to `width`."""
    number = F.format_string(f"%{width}.{decimals}f", F.col("v").cast("double")) if decimals is not None else F.lpad(F.col("v").cast("int").cast("string"), width, " ")
    cells = planes.select("image_id", "comp", "y", F.struct("x", number.alias("t")).alias("c"))
    rows = cells.groupBy("image_id", "comp", "y").agg(F.array_sort(F.collect_list("c")).alias("c"))
    return rows.select("image_id", "comp", "y", F.array_join("c.t", " ").alias("line"))


def channel_width(planes: DataFrame, decimals: int = 2) -> DataFrame:
    """(image_id, comp, width): characters of the longest number, for a dump in two passes."""
    return planes.groupBy("image_id", "comp").agg(F.max(F.length(F.format_string(f"%.{decimals}f", F.col("v").cast("double")))).alias("width"))


def image_text(meta: DataFrame, planes: DataFrame, width: int = 3) -> DataFrame:
    """(image_id, text): the dump of a whole image, sizes first, then one matrix a channel."""
    rows = dump_lines(planes, width).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("comp", "y", "line"))).alias("r"))
    head = F.format_string("width %d height %d sx %d sy %d sampled %s", "width", "height", "sx", "sy", F.col("is_sampled").cast("string"))
    return meta.join(rows, "image_id").select("image_id", F.concat(head, F.lit("\n"), F.array_join("r.line", "\n")).alias("text"))


def p3_text(cells: DataFrame, height: int, width: int) -> DataFrame:
    """(y, line): rows of a gray image (y, x, m) as lines of a P3 file; header lines have negative numbers."""
    rows = cells.groupBy("y").agg(F.array_sort(F.collect_list(F.struct("x", F.concat_ws(" ", "m", "m", "m").alias("t")))).alias("c")).select("y", F.array_join("c.t", " ").alias("line"))
    head = cells.sparkSession.createDataFrame([(-3, "P3"), (-2, f"{width} {height}"), (-1, "255")], "y int, line string")
    return head.unionByName(rows)


def channel_stats(blocks: DataFrame) -> DataFrame:
    """(image_id, comp, n_blocks, n_rows, n_cols) of blocks."""
    return blocks.groupBy("image_id", "comp").agg(F.count("*").alias("n_blocks"), (F.max("block_row") + 1).alias("n_rows"), (F.max("block_col") + 1).alias("n_cols"))


def code_lines(codes: DataFrame, key: list[str]) -> DataFrame:
    """(key, symbol, hex, bits): every code as digits."""
    return codes.select(*key, "symbol", F.hex("symbol").alias("hex"), code_text(F.col("code"), F.col("len")).alias("bits"))


def tree_lines(codes: DataFrame, key: list[str]) -> DataFrame:
    """(key, line, path, depth, symbol, freq, text): the code tree sideways, right subtrees first, one line a node.

    Nodes are the beginnings of the codes; inner ones have no symbol and the sum of what is below them.
    """
    bits = codes.select(*key, "symbol", "freq", "len", code_text(F.col("code"), F.col("len")).alias("bits"))
    every = bits.select(*key, "symbol", "freq", "len", "bits", F.explode(F.sequence(F.lit(0), F.col("len"))).alias("depth"))
    nodes = every.groupBy(*key, F.expr("left(bits, depth)").alias("path"), "depth").agg(F.max(F.when(F.col("depth") == F.col("len"), F.col("symbol"))).alias("symbol"), F.sum("freq").alias("freq"))
    place = F.concat(F.translate("path", "01", "02"), F.lit("1"))
    label = F.concat(F.repeat(F.lit("    "), F.col("depth")), F.coalesce(F.col("symbol").cast("string"), F.lit("*")))
    # a key has at most 511 nodes
    return nodes.select(*key, F.row_number().over(W.partitionBy(*key).orderBy(place.desc())).alias("line"), "path", "depth", "symbol", "freq", label.alias("text"))


def codes_by_length(codes: DataFrame, key: list[str]) -> DataFrame:
    """(key, len, n, symbols): the leaves of each level."""
    grouped = codes.groupBy(*key, "len").agg(F.array_sort(F.collect_list("symbol")).alias("s"))
    return grouped.select(*key, "len", F.size("s").cast("long").alias("n"), F.array_join(F.transform("s", lambda x: x.cast("string")), " ").alias("symbols"))
