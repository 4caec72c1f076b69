"""Values that were derived by hand, and invariants of the whole path."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilespark.functions.constants import ZIGZAG
from tilespark.operators import bits, blocks, huffman, pixels, segments, tokens
from tilespark.sources import ppm, sinks, synthetic


def gray(spark, h, w):
    m = F.col("m").cast("double")
    return synthetic.gradient_image(spark, h, w).select(F.lit(0).cast("long").alias("image_id"), "y", "x", m.alias("c1"), m.alias("c2"), m.alias("c3"))


def test_zigzag_of_the_standard():
    assert ZIGZAG[:10] == (0, 1, 8, 16, 9, 2, 3, 10, 17, 24) and ZIGZAG[-3:] == (55, 62, 63) and sorted(ZIGZAG) == list(range(64))


def test_colours(spark):
    rows = spark.createDataFrame([(0, 0, 0, 255.0, 0.0, 0.0), (0, 0, 1, 9.0, 9.0, 9.0)], synthetic.PIXELS)
    red, grey = pixels.rgb_to_ycbcr(rows).orderBy("x").collect()
    assert np.allclose([red.c1, red.c2, red.c3], [-51.755, -43.0185, 127.5])
    assert np.allclose([grey.c1, grey.c2, grey.c3], [9 - 128, 0.0009, 0.0009])


def test_padding_repeats_the_edge(spark):
    row = spark.createDataFrame([(0, 0, x, float(x + 1), 0.0, 0.0) for x in range(3)], synthetic.PIXELS)
    out = pixels.pad_edge(row, 3, 1, 2, 2).orderBy("y", "x").collect()
    assert [(r.y, r.x, r.c1) for r in out] == [(y, x, v) for y in (0, 1) for x, v in enumerate([1.0, 2.0, 3.0, 3.0])]


def test_averages_and_strides(spark):
    g = gray(spark, 4, 4)
    assert [r.c2 for r in pixels.subsample_average(g, 2, 2).orderBy("cy", "cx").collect()] == [4.5, 6.5, 20.5, 22.5]
    assert [r.v for r in pixels.subsample_stride(g, "c2", 2, 2).orderBy("cy", "cx").collect()] == [0.0, 2.0, 16.0, 18.0]
    with pytest.raises(ValueError):
        pixels.subsample_average(g, 2, 2, is_sampled=True)


def _gradient_block(spark):
    cells = gray(spark, 8, 8).select("image_id", F.lit(0).alias("comp"), "y", "x", (F.col("c1") - 128).alias("v"))
    return pixels.to_blocks(cells)


def test_transform_and_quantization(spark):
    f = blocks.dct8(_gradient_block(spark)).first().block
    assert np.allclose([f[0], f[1], f[8], f[24]], [-772, -18.2216, -145.7731, -15.2385], atol=1e-3)
    zz = blocks.zigzag(blocks.quantize(blocks.dct8(_gradient_block(spark)))).first().zz
    assert {i: v for i, v in enumerate(zz) if v} == {0: -48, 1: -2, 2: -12, 9: -1}
    even = spark.createDataFrame([(0, [-128.0] * 64)], "image_id bigint, block array<double>")
    assert np.allclose(blocks.dct8(even).first().block, [-1024] + [0] * 63)
    ties = spark.createDataFrame([(0, [40.0, -27.5] + [0.0] * 62)], "image_id bigint, block array<double>")
    assert blocks.quantize(ties).first().block[:2] == [3, -3]


@pytest.mark.parametrize(
    "ac, pairs",
    [
        ({}, [(0, 0)]),
        ({1: -3, 4: 2, 25: 7}, [(0, -3), (2, 2), (15, 0), (4, 7), (0, 0)]),
        ({16: 5}, [(15, 5), (0, 0)]),
        ({17: 5}, [(15, 0), (0, 5), (0, 0)]),
        ({63: 1}, [(15, 0), (15, 0), (15, 0), (14, 1)]),
    ],
)
def test_run_lengths(spark, ac, pairs):
    df = spark.createDataFrame([(0, [9] + [ac.get(i, 0) for i in range(1, 64)])], "k int, zz array<int>")
    assert [(r.run, r.value) for r in tokens.ac_runs(df).orderBy("tok_seq").collect()] == pairs


def test_differences_and_categories(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([5, 7, 4])] + [(1, 5000, 3), (1, 9000, 8)], "s int, i bigint, dc int")
    out = tokens.dc_delta(df, ["s"], "i").orderBy("s", "i").collect()
    assert [r.diff for r in out] == [5, 2, -3, 3, 5]
    v = spark.createDataFrame([(x,) for x in (0, 1, -1, 5, -5, 255, -256, -2047)], "diff int")
    assert [(r.category, r.bits) for r in tokens.dc_symbols(v).collect()] == [(0, 0), (1, 1), (1, 0), (3, 5), (3, 2), (8, 255), (9, 255), (11, 0)]


def test_codes():
    assert huffman.canonical(huffman.tree_depths({0: 5, 1: 9, 2: 12, 3: 1})) == {2: (1, 0), 1: (2, 2), 0: (3, 6), 3: (4, 14)}
    assert huffman.canonical(huffman.tree_depths({7: 3})) == {7: (1, 0)}


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 255), st.integers(1, 1 << 40), min_size=2, max_size=120))
def test_codes_are_prefix_free_and_short(freqs):
    depth = huffman.tree_depths(freqs)
    limited = huffman.limit_depths(depth)
    assert sum(2.0**-d for d in limited.values()) == 1 and max(limited.values()) <= 15
    if max(depth.values()) <= 15:
        assert sum(f * limited[s] for s, f in freqs.items()) == sum(f * depth[s] for s, f in freqs.items())
    words = sorted(f"{c:0{n}b}" for n, c in huffman.canonical(limited).values())
    assert all(not b.startswith(a) for a, b in zip(words, words[1:])) and not any(set(w) == {"1"} for w in words)


def test_missing_code_is_an_error(spark):
    codes = spark.createDataFrame([(1, 1, 0)], "symbol int, len int, code bigint")
    seen = spark.createDataFrame([(1,), (2,)], "symbol int")
    with pytest.raises(Exception, match="no code for symbol"):
        huffman.encode_symbols(seen, codes, []).collect()


def test_packing_flushing_stuffing(spark):
    def hexa(rows):
        df = spark.createDataFrame([(0, i, c, n) for i, (c, n) in enumerate(rows)], "s int, i bigint, code bigint, len int")
        return bits.gather_bytes(bits.pack_bits(df, ["s"], "i"), ["s"]).first().hex

    assert hexa([(0b101, 3), (1, 1), (0b100101100, 9), (0b111, 3)]) == "B967"
    assert hexa([(0b101, 3)]) == "BF"
    assert hexa([(-1, 64), (2, 3)]) == "F" * 16 + "5F"
    assert spark.range(1).select(bits.stuff(F.lit("01FF0FF0FF"))).first()[0] == "01FF000FF0FF00"
    with pytest.raises(Exception, match="bad token length"):
        hexa([(1, 65)])


def _numbers(data: bytes, width: int) -> list[int]:
    t = "".join(f"{b:08b}" for b in data)
    return [int(t[i : i + width], 2) for i in range(0, len(t) - width + 1, width)]


def test_reading_a_long_stream(spark):
    """Rows that carried the stream along came to 80 GB here."""
    data = {"long": np.random.default_rng(3).bytes(300_000), "empty": b"", "null": None, "short": b"\xff", None: b"\x80\x40\x20"}
    found = bits.read_bits(spark.createDataFrame(list(data.items()), "k string, bytes binary"), ["k"], 9).collect()
    want = {(k, i): v for k, b in data.items() for i, v in enumerate(_numbers(b or b"", 9))}
    assert len(found) == len(want) and {(r.k, r.seq): r.value for r in found} == want


@pytest.mark.parametrize("width", [1, 9, 57, 58, 64])
def test_numbers_return_from_pieces(spark, width):
    n = bits.CHUNK + 900
    rows = spark.range(n).select((F.col("id") % 2 == 0).alias("s"), "id", F.xxhash64("id").alias("code"), F.lit(width).alias("len"))
    pieces = bits.gather_pieces(bits.pack_bits(rows.unionByName(rows.withColumn("s", F.lit(None).cast("boolean"))), ["s"], "id"), ["s"], bits.piece_bytes(width))
    assert max(len(r.octets) for r in pieces.collect()) == bits.piece_bytes(width)
    found = {(r.s, r.seq): r.value % (1 << width) for r in bits.read_pieces(pieces, ["s"], width).collect()}
    want = {(s, i): r.code % (1 << width) for s, step, at in ((True, 2, 0), (False, 2, 1), (None, 1, 0)) for i, r in enumerate(rows.orderBy("id").collect()[at::step])}
    # a stream's last byte is filled up with ones, which are more numbers where they are short
    assert {k: v for k, v in found.items() if k in want} == want and (width < 8) >= (len(found) > len(want))


def test_widths_that_are_no_number(spark):
    for width in (0, 65):
        with pytest.raises(ValueError):
            bits.read_bits(spark.createDataFrame([(b"a",)], "bytes binary"), [], width)


def test_segments(spark):
    meta = spark.createDataFrame([(0, 16, 16, 2, 2, 255, True)], synthetic.META)
    found = {r.segment: r.hex for r in segments.header_segments(meta).collect()}
    assert found["sof0"] == "FFC00011080010001003012200021101031101"
    codes = spark.createDataFrame([(0, s, n, c, 0) for s, (n, c) in huffman.canonical(huffman.tree_depths({0: 5, 1: 9, 2: 12, 3: 1})).items()], "k int, symbol int, len int, code bigint, info int")
    assert segments.code_segments(codes, ["k"]).first().hex == "FFC4001700" + "01010101" + "00" * 12 + "02010003"


def _decode(data: bytes) -> list[np.ndarray]:
    """Quantized zig-zag blocks of a baseline file, in file order: a decoder for tests only."""
    at, tables, frame = 2, {}, None
    while True:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if marker == 0xC0:
            frame = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), body[7] >> 4, body[7] & 15
        if marker == 0xC4:
            code, i, own = 0, 17, {}
            for n in range(1, 17):
                for _ in range(body[n]):
                    own[(n, code)] = body[i]
                    code, i = code + 1, i + 1
                code <<= 1
            tables[body[0]] = own
        at += 2 + size
        if marker == 0xDA:
            break
    stream = "".join(f"{b:08b}" for b in data[at:-2].replace(b"\xff\x00", b"\xff"))
    pos = 0

    def symbol(table):
        nonlocal pos
        for n in range(1, 17):
            if (n, int(stream[pos : pos + n], 2)) in table:
                pos += n
                return table[(n, int(stream[pos - n : pos], 2))]
        raise AssertionError("no code")

    def value(n):
        nonlocal pos
        if not n:
            return 0
        v = int(stream[pos : pos + n], 2)
        pos += n
        return v if v >> (n - 1) else v - (1 << n) + 1

    high, wide, sx, sy = frame
    out, last = [], [0, 0, 0]
    for _ in range((high // (8 * sy)) * (wide // (8 * sx))):
        for comp in [0] * (sx * sy) + [1, 2]:
            block = np.zeros(64, int)
            c = int(comp > 0)
            last[comp] += value(symbol(tables[c]))
            block[0], k = last[comp], 1
            while k < 64:
                s = symbol(tables[0x10 | c])
                if s == 0:
                    break
                k += s >> 4
                block[k] = value(s & 15)
                k += 1
            out.append(block)
    assert set(stream[pos:]) <= {"1"} and len(stream) - pos < 8
    return out


@pytest.mark.parametrize("sx, sy", [(2, 2), (1, 1), (2, 1)])
def test_a_file_decodes_to_its_blocks(spark, sx, sy):
    image = synthetic.colour_image(spark, 21, 37)
    data = bytes.fromhex(segments.encode_images(image, 37, 21, sx, sy).first().hex)
    assert data[:2] == b"\xff\xd8" and data[-2:] == b"\xff\xd9"
    made = segments.image_blocks(image, 37, 21, sx, sy).orderBy("mcu", "comp", "k").collect()
    assert all((np.array(r.zz) == b).all() for r, b in zip(made, _decode(data), strict=True))


def test_a_gray_image_has_one_chroma_symbol(spark):
    data = bytes.fromhex(segments.encode_images(gray(spark, 16, 16), 16, 16).first().hex)
    assert all((b == 0).all() for b in _decode(data)[4:])


def test_text_images_with_faults(spark):
    def parse(text):
        return ppm.parse_text_images(spark.createDataFrame([(1, text)], "image_id bigint, text string")).collect()

    assert [(r.r, r.g, r.b) for r in parse("P3\n1 1 255\n300 -1 7x")] == [(44, 255, 7)]
    for bad, why in (("P2\n1 1 255\n1 2 3", "not a P3"), ("P3\n1 1", "ends early"), ("P3\n1 1 255\n1 2", "too few"), ("P3\n1 1 255\n1 # 2\n3", "not a number")):
        with pytest.raises(Exception, match=why):
            parse(bad)


def test_files_go_out_and_come_back(spark, tmp_path):
    files = spark.createDataFrame([("a.bin", bytearray(b"\x00\xff")), ("b.bin", bytearray(b"\x01"))], "name string, bytes binary")
    sinks.write_byte_files(files, str(tmp_path / "out"))
    assert {r.path.rsplit("/", 1)[1]: bytes(r.bytes) for r in ppm.read_bytes(spark, str(tmp_path / "out" / "*.bin")).collect()} == {"a.bin": b"\x00\xff", "b.bin": b"\x01"}
    (tmp_path / "i.ppm").write_text("P3\n1 1 255\n1 2 3\n")
    assert ppm.parse_text_images(ppm.read_text_images(spark, str(tmp_path / "i.ppm"))).count() == 1
    lines = spark.range(30).select("id", F.col("id").cast("string").alias("t"))
    sinks.write_lines(lines, "id", "t", str(tmp_path / "lines"))
    assert sorted(int(r.value) for r in spark.read.text(str(tmp_path / "lines")).collect()) == list(range(30))


def test_images_are_encoded_as_they_arrive(spark, tmp_path):
    from tilespark.streaming.encode import encode_stream

    image = synthetic.colour_image(spark, 8, 8)
    image.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(image.schema).parquet(str(tmp_path / "in"))
    query = encode_stream(stream, 8, 8, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert query.awaitTermination(120)
    assert [r.hex for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [r.hex for r in segments.encode_images(image, 8, 8).collect()]
