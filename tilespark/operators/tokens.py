"""Operators that turn zig-zag blocks into tokens: differences, run lengths, categories and symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import category, value_bits
from .settle import settle

#: Blocks of one scan that a window sees at once; chunks hand their last value on.
CHUNK = 4096


def dc_delta(blocks: DataFrame, part: list[str], order: str, column: str = "dc") -> DataFrame:
    """blocks with diff: the first value of a scan, then each value less the one before it.

    Two levels: windows run within chunks of CHUNK scan numbers, and only the last value of every chunk crosses
    over, so one long scan doesn't come together in one task. The blocks are settled, as both levels read them.
    """
    chunk = F.floor(F.col(order) / CHUNK)
    keyed = settle(blocks.withColumn("_chunk", chunk))
    inner = W.partitionBy(*part, "_chunk").orderBy(order)
    ends = keyed.groupBy(*part, "_chunk").agg(F.max_by(column, order).alias("_end"))
    over = W.partitionBy(*part).orderBy("_chunk")
    ends = ends.select(*part, "_chunk", F.lag("_end", 1, 0).over(over).alias("_before"))
    out = keyed.withColumn("_last", F.lag(column, 1).over(inner)).join(ends, [*part, "_chunk"])
    return out.withColumn("diff", F.col(column) - F.coalesce("_last", "_before")).drop("_chunk", "_last", "_before")


def ac_runs(blocks: DataFrame, zz: str = "zz") -> DataFrame:
    """blocks with tok_seq, run, value: each non-zero coefficient after the first with the zeros before it.

    Sixteen zeros in a row are (15, 0); zeros up to the end are one (0, 0). A block is an array: the places of its
    non-zero values are listed once, and each run lies between neighbours, so nothing is shuffled.
    """
    pair = lambda r, x: F.struct(r.cast("int").alias("run"), x.cast("int").alias("value"))
    kept = [c for c in blocks.columns if c != zz]
    places = F.filter(F.sequence(F.lit(1), F.lit(63)), lambda p: F.get(F.col(zz), p) != 0)
    found = blocks.select(*kept, zz, places.alias("_at"))

    def island(p, i):
        zeros = p - F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("_at"), i - 1)) - 1
        return F.concat(F.array_repeat(pair(F.lit(15), F.lit(0)), F.floor(zeros / 16).cast("int")), F.array(pair(zeros % 16, F.get(F.col(zz), p))))

    none = F.array().cast("array<struct<run:int,value:int>>")
    end = F.when(F.coalesce(F.get(F.col("_at"), F.size("_at") - 1), F.lit(0)) < 63, F.array(pair(F.lit(0), F.lit(0)))).otherwise(none)
    every = F.concat(F.flatten(F.transform("_at", island)), end)
    return found.select(*kept, F.posexplode(every).alias("_pos", "_pair")).select(*kept, (F.col("_pos") + 1).alias("tok_seq"), F.col("_pair.run").alias("run"), F.col("_pair.value").alias("value"))


def ac_symbols(runs: DataFrame) -> DataFrame:
    """runs with category, symbol (run and category in one byte), bits and nbits of the value."""
    size = category(F.col("value"))
    return runs.withColumns({"category": size, "symbol": (F.col("run") * 16 + size).cast("int"), "bits": value_bits(F.col("value")), "nbits": size})


def dc_symbols(blocks: DataFrame, column: str = "diff") -> DataFrame:
    """blocks with category (their symbol), bits and nbits of the difference."""
    size = category(F.col(column))
    return blocks.withColumns({"category": size, "symbol": size, "bits": value_bits(F.col(column)), "nbits": size})


def symbol_frequencies(tokens: DataFrame, key: list[str], symbol: str = "symbol", step: int = 1, position: str | None = None) -> DataFrame:
    """(key, symbol, freq): counts, combined before the shuffle; with a step only of every step-th position."""
    kept = tokens.where(F.col(position) % step == 0) if step > 1 and position else tokens
    return kept.groupBy(*key, F.col(symbol).alias("symbol")).agg(F.count("*").alias("freq"))


def zip_equal(rows: DataFrame, arrays: dict[str, str]) -> DataFrame:
    """rows with pos and one column an array (new name: array column), element by element; an error where sizes differ."""
    sizes = [F.size(c) for c in arrays.values()]
    same = F.array_min(F.array(*sizes)) == F.array_max(F.array(*sizes))
    zipped = F.when(same, F.arrays_zip(*arrays.values())).otherwise(F.raise_error(F.lit("arrays of different sizes")))
    out = rows.select("*", F.posexplode(zipped).alias("pos", "_x"))
    return out.withColumns({new: F.col(f"_x.{old}") for new, old in arrays.items()}).drop("_x")
