"""Length-limited canonical Huffman codes, one set for every key, as functions of a histogram."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.constants import LONGEST


def tree_depths(freqs: dict[int, int]) -> dict[int, int]:
    """Depth of every symbol; ties go to the subtree with the smaller least symbol. One symbol has depth 1."""
    if len(freqs) == 1:
        return dict.fromkeys(freqs, 1)
    heap = [(f, s, [s]) for s, f in freqs.items()]
    heapq.heapify(heap)
    depth = dict.fromkeys(freqs, 0)
    while len(heap) > 1:
        (fa, sa, a), (fb, sb, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in a + b:
            depth[s] += 1
        heapq.heappush(heap, (fa + fb, min(sa, sb), a + b))
    return depth


def limit_depths(depth: dict[int, int], longest: int = LONGEST) -> dict[int, int]:
    """Depths of at most `longest`: by level, two leaves too deep free their parent for one of them, and the other
    pairs with the deepest leaf at least two levels above. Symbols keep their order by depth."""
    most = max(depth.values(), default=0)
    count = [0] * (max(most, longest) + 2)
    for d in depth.values():
        count[d] += 1
    for level in range(most, longest, -1):
        while count[level]:
            above = next(i for i in range(level - 2, 0, -1) if count[i])
            count[level] -= 2
            count[level - 1] += 1
            count[above] -= 1
            count[above + 1] += 2
    order = sorted(depth, key=lambda s: (depth[s], s))
    lengths = [level for level, n in enumerate(count) for _ in range(n)]
    return dict(zip(order, lengths))


def canonical(lengths: dict[int, int], spare_last: bool = True) -> dict[int, tuple[int, int]]:
    """symbol -> (length, code), in order of length and symbol; the last code, all ones, gets a 0 behind it."""
    out, code, before = {}, 0, 0
    for s in sorted(lengths, key=lambda s: (lengths[s], s)):
        code <<= lengths[s] - before
        before = lengths[s]
        out[s] = (before, code)
        code += 1
    if spare_last and len(out) > 1:
        s = max(lengths, key=lambda s: (lengths[s], s))
        out[s] = (out[s][0] + 1, out[s][1] << 1)
    return out


def huffman_codes(freqs: DataFrame, key: list[str], longest: int = LONGEST, spare_last: bool = True) -> DataFrame:
    """(key, symbol, freq, len, code) of (key, symbol, freq). Each key's histogram is small (symbols are bytes)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        known = dict(zip(pdf["symbol"].tolist(), pdf["freq"].tolist()))
        codes = canonical(limit_depths(tree_depths(known), longest), spare_last)
        return pdf.assign(len=[codes[s][0] for s in pdf["symbol"].tolist()], code=[codes[s][1] for s in pdf["symbol"].tolist()])

    kinds = {f.name: f.dataType.simpleString() for f in freqs.schema.fields}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in [*key, "symbol", "freq"]], "len int", "code bigint"])
    rows = freqs.select(*key, "symbol", "freq")
    if not key:
        return rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda pdf: build(pdf.drop(columns="_all")), schema)
    return rows.groupBy(*key).applyInPandas(build, schema)


def canonical_codes(lengths: DataFrame, key: list[str]) -> DataFrame:
    """(key, symbol, len, code) of given lengths, by a running sum of the space that shorter codes take."""
    before = W.partitionBy(*key).orderBy("len", "symbol").rowsBetween(W.unboundedPreceding, -1)
    taken = F.coalesce(F.sum(F.expr("shiftleft(1L, 16 - len)")).over(before), F.lit(0))
    return lengths.withColumn("_taken", taken).select(*key, "symbol", "len", F.expr("shiftright(_taken, 16 - len)").alias("code"))


def merge_cost(freqs: DataFrame, key: list[str]) -> DataFrame:
    """(key, cost): bits that an unlimited code takes, by merging the two least sums until one is left."""
    listed = freqs.groupBy(*key).agg(F.array_sort(F.collect_list("freq")).alias("h"))
    start = F.struct(F.col("h").alias("h"), F.lit(0).cast("long").alias("cost"))

    def step(acc, _):
        both = F.get(acc["h"], 0) + F.get(acc["h"], 1)
        rest = F.array_sort(F.concat(F.slice(acc["h"], F.lit(3), F.size(acc["h"])), F.array(both)))
        return F.struct(rest.alias("h"), (acc["cost"] + both).alias("cost"))

    rounds = F.when(F.size("h") > 1, F.sequence(F.lit(2), F.size("h"))).otherwise(F.array().cast("array<int>"))
    return listed.select(*key, F.aggregate(rounds, start, step, lambda a: a["cost"]).alias("cost"))


def encode_symbols(tokens: DataFrame, codes: DataFrame, key: list[str], strict: bool = True, keep_missing: bool = False) -> DataFrame:
    """tokens with hcode and hlen. A symbol without a code is an error if strict; else it is left out, or kept with
    length 0. Codes are at most 256 rows a key, so Spark broadcasts them where their size allows."""
    small = codes.select(*key, "symbol", F.col("code").alias("hcode"), F.col("len").alias("hlen"))
    out = tokens.join(small, [*key, "symbol"], "left" if strict or keep_missing else "inner")
    if strict:
        fail = F.raise_error(F.concat(F.lit("no code for symbol "), F.col("symbol").cast("string")))
        return out.withColumn("hcode", F.when(F.col("hlen").isNull(), fail.cast("long")).otherwise(F.col("hcode")))
    return out.withColumns({"hcode": F.coalesce("hcode", F.lit(0)), "hlen": F.coalesce("hlen", F.lit(0))})
