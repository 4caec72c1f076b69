"""Operators on 8x8 blocks, one row a block: transform, quantization, zig-zag order, scan order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.constants import BLOCK_BASIS, CHROMA, LUMA, ZIGZAG, cosine_basis


def _product(df: DataFrame, column: str, matrix: np.ndarray) -> DataFrame:
    """df with an array column of 64 numbers multiplied by a matrix: one matrix product an Arrow batch."""
    schema = T.StructType([T.StructField(f.name, T.ArrayType(T.DoubleType())) if f.name == column else f for f in df.schema.fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(column)
            values = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, 64) @ matrix
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * 64)
            columns = [pa.ListArray.from_arrays(offsets, pa.array(values.reshape(-1))) if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def dct8(blocks: DataFrame, column: str = "block") -> DataFrame:
    """blocks with their 64 cosine coefficients (type II, orthonormal), row i the vertical frequency."""
    return _product(blocks, column, BLOCK_BASIS.T)


def idct8(blocks: DataFrame, column: str = "block") -> DataFrame:
    """The inverse of dct8."""
    return _product(blocks, column, BLOCK_BASIS)


def dct8_by_join(cells: DataFrame, key: list[str]) -> DataFrame:
    """(key, i, j, f) of (key, y, x, v): the same transform as two joins with the basis and two sums, rows then columns.

    Slower than dct8; kept as a form that SQL alone can check. The basis has 64 rows.
    """
    basis = cells.sparkSession.createDataFrame([(k, n, float(v)) for k, row in enumerate(cosine_basis()) for n, v in enumerate(row)], "k int, n int, w double")
    rows = cells.join(F.broadcast(basis), F.col("x") == F.col("n")).groupBy(*key, "y", F.col("k").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return rows.join(F.broadcast(basis), F.col("y") == F.col("n")).groupBy(*key, F.col("k").alias("i"), "j").agg(F.sum(F.col("v") * F.col("w")).alias("f"))


def quantize(blocks: DataFrame, chroma: Column | None = None, column: str = "block") -> DataFrame:
    """Coefficients over the table's steps, rounded half away from zero (array of int).

    Coefficients are rounded to 6 decimals first, so that ties don't depend on the order of summation.
    """
    table = F.array(*[F.lit(v) for v in LUMA])
    if chroma is not None:
        table = F.when(chroma, F.array(*[F.lit(v) for v in CHROMA])).otherwise(table)
    return blocks.withColumn(column, F.zip_with(F.col(column), table, lambda f, q: F.round(F.round(f, 6) / q).cast("int")))


def zigzag(blocks: DataFrame, column: str = "block", to: str = "zz") -> DataFrame:
    """blocks with the column in zig-zag order.

    The column is named once a place, so the optimizer keeps what makes it apart and computes that once a block.
    """
    return blocks.withColumn(to, F.array(*[F.get(F.col(column), F.lit(p)) for p in ZIGZAG])).drop(column)


def scan_order(blocks: DataFrame, columns: Column, sx: int, sy: int) -> DataFrame:
    """blocks with mcu and k: luma goes by units of sy by sx blocks, row by row; partial units at the edge go.

    columns: blocks in a row of the plane.
    """
    across = F.floor(columns / sx).cast("long")
    row, col = F.col("block_row"), F.col("block_col")
    mcu = F.floor(row / sy).cast("long") * across + F.floor(col / sx).cast("long")
    return blocks.where(F.floor(col / sx) < across).withColumns({"mcu": mcu, "k": (row % sy * sx + col % sx).cast("int")})
