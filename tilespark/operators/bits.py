"""Bit-level operators: offsets, packing, stuffing, text of bits, reading back."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows of one stream that a window sees at once.
CHUNK = 4096


def running_offsets(rows: DataFrame, part: list[str], order: str, length: str, to: str = "off") -> DataFrame:
    """rows with the total of `length` before each one, in order of a number; rows without one come last, and nulls in `part` are a stream too.

    Two levels: running sums within chunks of CHUNK order numbers, and one over the chunks' totals, so a long
    stream is spread over tasks; only a row a chunk meets in one.
    """
    keyed = rows.withColumn("_chunk", F.floor(F.col(order) / CHUNK))
    before = lambda *p: W.partitionBy(*p)
    totals = keyed.groupBy(*part, "_chunk").agg(F.sum(length).alias("_total"))
    outer = before(*part).orderBy(F.asc_nulls_last("_chunk")).rowsBetween(W.unboundedPreceding, -1)
    keys = [*part, "_chunk"]
    totals = totals.select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(keys)], F.coalesce(F.sum("_total").over(outer), F.lit(0)).alias("_base"))
    inner = before(*part, "_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    own = keyed.withColumn("_own", F.coalesce(F.sum(length).over(inner), F.lit(0)))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(keys)])
    return own.join(totals, same).withColumn(to, (F.col("_own") + F.col("_base")).cast("long")).drop("_chunk", "_own", "_base", *[f"_key{i}" for i in range(len(keys))])


def check_lengths(tokens: DataFrame, length: str = "len") -> DataFrame:
    """tokens, with an error where a length is below 0 or above 64."""
    fail = F.raise_error(F.concat(F.lit("bad token length "), F.col(length).cast("string")))
    return tokens.withColumn(length, F.when((F.col(length) < 0) | (F.col(length) > 64), fail.cast("int")).otherwise(F.col(length)))


def pack_bits(tokens: DataFrame, part: list[str], order: str, code: str = "code", length: str = "len") -> DataFrame:
    """(part, byte_ix, v): the low `length` bits of each code, high bit first, end to end; the last byte is filled up with ones.

    A token is split into the bytes that it overlaps (9 at most), and bytes are put together by bitwise or.
    """
    placed = running_offsets(check_lengths(tokens, length), part, order, length).select(*part, F.col(code).alias("_c"), F.col(length).alias("_n"), F.col("off").alias("_o")).where("_n > 0")
    ends = tokens.groupBy(*part).agg(F.sum(length).alias("_o")).where("_o % 8 <> 0")
    pad = ends.select(*part, F.expr("shiftleft(1L, cast(8 - _o % 8 as int)) - 1").alias("_c"), F.expr("cast(8 - _o % 8 as int)").alias("_n"), "_o")
    every = placed.select(*part, F.col("_c").cast("long").alias("_c"), F.col("_n").cast("int").alias("_n"), "_o").unionByName(pad)
    split = every.withColumn("byte_ix", F.explode(F.expr("sequence(_o div 8, (_o + _n - 1) div 8)")))
    # the code's bits moved so that the byte's last bit is bit 0; only this byte's eight bits stay
    masked = F.expr("case when _n = 64 then _c else _c & (shiftleft(1L, _n) - 1) end")
    shift = F.expr("cast((byte_ix + 1) * 8 - (_o + _n) as int)")
    split = split.withColumns({"_c": masked, "_s": shift}).withColumn("_v", F.expr("case when _s >= 0 then shiftleft(_c, _s) else shiftrightunsigned(_c, -_s) end & 255"))
    return split.groupBy(*part, "byte_ix").agg(F.bit_or("_v").cast("int").alias("v"))


def gather_bytes(bytes_: DataFrame, part: list[str]) -> DataFrame:
    """(part, hex): the bytes of each stream in order, as hexadecimal digits. Pieces of CHUNK bytes are put together
    first, so a stream's row is joined from pieces and not sorted byte by byte in one task."""
    piece = bytes_.groupBy(*part, F.expr(f"byte_ix div {CHUNK}").alias("_p")).agg(F.array_sort(F.collect_list(F.struct("byte_ix", F.lpad(F.hex("v"), 2, "0").alias("h")))).alias("b"))
    joined = piece.select(*part, F.struct("_p", F.array_join("b.h", "").alias("h")).alias("x")).groupBy(*part).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return joined.select(*part, F.array_join("x.h", "").alias("hex"))


def stuff(hex_column):
    """Hexadecimal digits with 00 after every byte FF. Bytes are taken apart first, so FF across two bytes stays."""
    return F.array_join(F.transform(F.regexp_extract_all(hex_column, F.lit("(..)"), 1), lambda h: F.when(h == "FF", "FF00").otherwise(h)), "")


def bits_text(hex_column):
    """The bits of bytes given as hexadecimal digits, as characters 0 and 1."""
    return F.array_join(F.transform(F.regexp_extract_all(hex_column, F.lit("(..)"), 1), lambda h: F.lpad(F.conv(h, 16, 2), 8, "0")), "")


def gather_pieces(bytes_: DataFrame, part: list[str], size: int) -> DataFrame:
    """(part, piece, octets): the bytes of each stream in order as numbers, `size` of them a row, so no row grows with its stream."""
    found = F.sort_array(F.collect_list(F.struct("byte_ix", "v"))).alias("_b")
    return bytes_.groupBy(*part, F.expr(f"byte_ix div {size}").alias("piece")).agg(found).select(*part, "piece", F.col("_b.v").alias("octets"))


def piece_bytes(width: int) -> int:
    """Bytes of CHUNK numbers of `width` bits: pieces of so many begin with a number's first bit."""
    if not 1 <= width <= 64:
        raise ValueError(f"numbers have 1 to 64 bits, not {width}")
    return CHUNK * width // 8


def read_pieces(pieces: DataFrame, part: list[str], width: int) -> DataFrame:
    """(part, seq, value): the numbers of `width` bits in pieces of piece_bytes(width) bytes, from a stream's start as long as whole ones are there.

    A piece's numbers are one array, and only that is exploded: rows that carry the bytes along would hold them once a number.
    """

    def taken(first: str, n: int) -> str:
        # the n bits (57 at most) from bit `first` on; the bytes that they touch fit into a long
        span = (n + 14) // 8
        joined = " | ".join(f"shiftleft(cast(coalesce(get(octets, cast(({first}) div 8 as int) + {j}), 0) as long), {8 * (span - 1 - j)})" for j in range(span))
        return f"(shiftrightunsigned({joined}, {8 * span - n} - ({first}) % 8) & {(1 << n) - 1}L)"

    piece_bytes(width)
    one = taken(f"i * {width}", width) if width <= 57 else f"(shiftleft({taken(f'i * {width}', width - 32)}, 32) | {taken(f'i * {width} + {width - 32}', 32)})"
    n = f"cast(size(octets) * 8 div {width} as int)"
    rows = pieces.select(*part, "piece", F.posexplode(F.expr(f"case when {n} > 0 then transform(sequence(0, {n} - 1), i -> {one}) end")).alias("_i", "value"))
    return rows.select(*part, (F.col("piece") * CHUNK + F.col("_i")).cast("int").alias("seq"), "value")


def read_bits(streams: DataFrame, part: list[str], width: int, bytes_col: str = "bytes") -> DataFrame:
    """(part, seq, value): the numbers of `width` bits in a binary column, from its start as long as whole ones are there.

    For streams that are rows already; read_pieces() reads those that are too long to be one.
    """
    size, b = piece_bytes(width), F.col(bytes_col)
    n = F.ceil(F.octet_length(b) / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda p: F.struct(p.cast("long").alias("piece"), F.substring(b, p * size + 1, F.lit(size)).alias("_b")))
    pieces = streams.select(*part, F.explode(F.when(n > 0, cut)).alias("_x")).select(*part, "_x.piece", "_x._b")
    octets = F.expr("transform(sequence(1, octet_length(_b)), i -> cast(conv(hex(substring(_b, i, 1)), 16, 10) as int))")
    return read_pieces(pieces.select(*part, "piece", octets.alias("octets")), part, width)


def has_bits(bytes_column, cursor):
    """Whether bits are left at a cursor."""
    return cursor < F.octet_length(bytes_column).cast("long") * 8


def read_bit(bytes_column, cursor):
    """The bit at a cursor, high bit of each byte first; an error at the end."""
    byte = F.conv(F.hex(F.substring(bytes_column, (F.floor(cursor / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.floor(byte / F.pow(F.lit(2), 7 - cursor % 8)) % 2
    return F.when(has_bits(bytes_column, cursor), bit.cast("int")).otherwise(F.raise_error(F.lit("no bits left")).cast("int"))
