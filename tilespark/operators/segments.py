"""Marker segments of a baseline file as hexadecimal digits, and the whole file of every image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import CHROMA, LUMA, ZIGZAG
from ..functions.scalars import byte_hex, clamp, u16_hex
from . import bits, blocks, huffman, pixels, tokens
from .settle import settle

# Start and end of the image, the application segment, the start of the scan.
START, END = "FFD8", "FFD9"
APP0 = "FFE000104A46494600010100000100010000"
SCAN = "FFDA000C03010002110311003F00"
#: (table_id, class and number) in the order of the file.
TABLES = (("y_dc", 0x00), ("y_ac", 0x10), ("c_dc", 0x01), ("c_ac", 0x11))


def quant_segment() -> str:
    """Both tables in one segment: zig-zag order, values 1 to 255."""
    body = "".join(f"{i:02X}" + "".join(f"{max(1, min(255, t[p])):02X}" for p in ZIGZAG) for i, t in enumerate((LUMA, CHROMA)))
    return f"FFDB{2 + len(body) // 2:04X}{body}"


def frame_segment(height: Column, width: Column, sx: Column, sy: Column) -> Column:
    """Baseline frame of three components; luma's sampling factors are clamped to 1..4."""
    factors = byte_hex(clamp(sx, 1, 4) * 16 + clamp(sy, 1, 4))
    return F.concat(F.lit("FFC0001108"), u16_hex(height), u16_hex(width), F.lit("0301"), factors, F.lit("00"), F.lit("021101031101"))


def code_segments(codes: DataFrame, key: list[str]) -> DataFrame:
    """(key, hex) of codes (key, symbol, len, code, info): counts of the lengths 1 to 16, then symbols by length and code."""
    guard = F.when(F.col("len").between(1, 16), F.col("len")).otherwise(F.raise_error(F.lit("a code's length is not 1 to 16")).cast("int"))
    grouped = codes.withColumn("len", guard).groupBy(*key, "info").agg(F.array_sort(F.collect_list(F.struct("len", "code", "symbol"))).alias("e"))
    count = lambda n: F.size(F.filter("e", lambda x: x["len"] == n))
    counts = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(16)), lambda n: byte_hex(count(n))), "")
    symbols = F.array_join(F.transform("e", lambda x: byte_hex(x["symbol"])), "")
    return grouped.select(*key, F.concat(F.lit("FFC4"), u16_hex(19 + F.size("e")), byte_hex(F.col("info")), counts, symbols).alias("hex"))


def image_blocks(images: DataFrame, width: int, height: int, sx: int, sy: int) -> DataFrame:
    """(image_id, comp, block_row, block_col, mcu, k, zz) of pixels in red, green and blue.

    Padding goes to whole units of 8*sx by 8*sy, so no block is missing at the edge.
    """
    if sx not in (1, 2, 4) or sy not in (1, 2, 4):
        raise ValueError("sampling steps are 1, 2 or 4")
    across = -(-width // (8 * sx))
    full = pixels.rgb_to_ycbcr(pixels.pad_edge(images, width, height, 8 * sx, 8 * sy))
    luma = full.select("image_id", F.lit(0).alias("comp"), "y", "x", F.col("c1").alias("v"))
    small = pixels.subsample_average(full, sx, sy).select("image_id", F.expr("stack(2, 1, c2, 2, c3) AS (comp, v)"), F.col("cy").alias("y"), F.col("cx").alias("x"))
    cells = luma.unionByName(small.select("image_id", "comp", "y", "x", "v"))
    done = blocks.zigzag(blocks.quantize(blocks.dct8(pixels.to_blocks(cells)), chroma=F.col("comp") > 0))
    luma_blocks = blocks.scan_order(done.where("comp = 0"), F.lit(across * sx), sx, sy)
    chroma = done.where("comp > 0").withColumns({"mcu": F.col("block_row").cast("long") * across + F.col("block_col"), "k": F.lit(0)})
    return luma_blocks.unionByName(chroma)


def token_stream(zz_blocks: DataFrame, sx: int, sy: int) -> tuple[DataFrame, DataFrame]:
    """(tokens, codes): every coded token in file order, and the four code tables of each image.

    tokens: image_id, mcu, comp_seq, tok_seq, table_id, symbol, hcode, hlen, vbits, vlen, is_eob.
    The histogram of an image is complete before any of its tokens is coded: one shuffle of counts.
    """
    place = zz_blocks.withColumns({"comp_seq": F.when(F.col("comp") == 0, F.col("k")).otherwise(F.lit(sx * sy - 1) + F.col("comp")), "scan": F.when(F.col("comp") == 0, F.col("mcu") * (sx * sy) + F.col("k")).otherwise(F.col("mcu"))})
    side = F.when(F.col("comp") == 0, "y").otherwise("c")
    dc = tokens.dc_delta(place.select("image_id", "comp", "mcu", "comp_seq", "scan", F.get("zz", F.lit(0)).alias("dc")), ["image_id", "comp"], "scan")
    dc = tokens.dc_symbols(dc).select("image_id", "mcu", "comp_seq", F.lit(0).alias("tok_seq"), F.concat(side, F.lit("_dc")).alias("table_id"), "symbol", F.col("bits").alias("vbits"), F.col("nbits").alias("vlen"), F.lit(False).alias("is_eob"))
    ac = tokens.ac_symbols(tokens.ac_runs(place.select("image_id", "comp", "mcu", "comp_seq", "zz")))
    ac = ac.select("image_id", "mcu", "comp_seq", "tok_seq", F.concat(side, F.lit("_ac")).alias("table_id"), "symbol", F.col("bits").alias("vbits"), F.col("nbits").alias("vlen"), (F.col("symbol") == 0).alias("is_eob"))
    every = dc.unionByName(ac)
    codes = huffman.huffman_codes(tokens.symbol_frequencies(every, ["image_id", "table_id"]), ["image_id", "table_id"])
    return huffman.encode_symbols(every, codes, ["image_id", "table_id"]), codes


def encode_images(images: DataFrame, width: int, height: int, sx: int = 2, sy: int = 2, original_size: bool = False) -> DataFrame:
    """(image_id, hex): a whole baseline file of every image (image_id, y, x, c1, c2, c3 in red, green, blue) of one size.

    The frame records the padded size, or the original one on demand.
    """
    # blocks feed the histograms and the coding, which can't start before those are complete
    stream, codes = token_stream(settle(image_blocks(images, width, height, sx, sy)), sx, sy)
    # two bit strings a token, code then value
    per_block = stream.groupBy("image_id", "mcu", "comp_seq").agg(F.array_sort(F.collect_list(F.struct("tok_seq", "hcode", "hlen", "vbits", "vlen"))).alias("t"))
    coded = per_block.select("image_id", (F.col("mcu") * (sx * sy + 2) + F.col("comp_seq")).alias("block"), F.posexplode(F.flatten(F.transform("t", lambda x: F.array(F.struct(x["hcode"].alias("code"), x["hlen"].alias("len")), F.struct(x["vbits"].alias("code"), x["vlen"].alias("len")))))).alias("pos", "x"))
    # at most 2 * 64 strings a block
    flat = coded.select("image_id", (F.col("block") * 256 + F.col("pos")).alias("seq"), F.col("x.code").alias("code"), F.col("x.len").cast("int").alias("len"))
    scan = bits.gather_bytes(bits.pack_bits(flat, ["image_id"], "seq"), ["image_id"]).select("image_id", bits.stuff(F.col("hex")).alias("scan"))
    info = F.create_map(*[x for name, n in TABLES for x in (F.lit(name), F.lit(n))])
    tables = code_segments(codes.withColumn("info", info[F.col("table_id")]), ["image_id", "table_id"])
    place = F.create_map(*[x for i, (name, _) in enumerate(TABLES) for x in (F.lit(name), F.lit(i))])
    tables = tables.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(place[F.col("table_id")].alias("i"), "hex"))).alias("d")).select("image_id", F.array_join("d.hex", "").alias("tables"))
    wide, high = (width, height) if original_size else (-(-width // (8 * sx)) * 8 * sx, -(-height // (8 * sy)) * 8 * sy)
    frame = frame_segment(F.lit(high), F.lit(wide), F.lit(sx), F.lit(sy))
    return scan.join(tables, "image_id").select("image_id", F.concat(F.lit(START + APP0 + quant_segment()), frame, "tables", F.lit(SCAN), "scan", F.lit(END)).alias("hex"))


def header_segments(images: DataFrame) -> DataFrame:
    """(segment, hex) of image_meta, without the code tables."""
    frame = frame_segment(F.col("height"), F.col("width"), F.col("sx"), F.col("sy"))
    named = [("soi", F.lit(START)), ("app0", F.lit(APP0)), ("dqt", F.lit(quant_segment())), ("sof0", frame), ("sos", F.lit(SCAN)), ("eoi", F.lit(END))]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("segment"), v.alias("hex")) for n, v in named]))
    return images.select(rows.alias("s")).select("s.segment", "s.hex")
