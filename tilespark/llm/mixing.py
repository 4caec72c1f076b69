"""Operator 7: mixing sources to target weights with hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import SPACE, free_name, materialize, replace_columns, table

#: Bits of the hash that one level of histograms resolves, and the levels there are.
LEVEL_BITS, LEVELS = 6, 10
#: A boundary bucket of so many hash values at most is settled value by value.
SETTLE = 512
#: Values that are kept back to fill what is left, and starts that are tried for that.
SPARE, STARTS = 24, 12
#: The table of sources is broadcast up to so many rows; beyond it sources are joined by shuffle.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`; null counts 0."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(bare) > 0, F.size(F.split(bare, SPACE, -1))).otherwise(0).cast("long")


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _rank(h: Column, level: int) -> Column:
    """The leading bits of the hash, as a number that is not negative."""
    return F.shiftrightunsigned(h, 64 - LEVEL_BITS * level) if level else F.lit(0).cast("long")


def _rank_at(h: Column, level: Column) -> Column:
    """_rank by a column of levels."""
    return F.when(level > 0, F.call_function("shiftrightunsigned", h, (64 - LEVEL_BITS * level).cast("int"))).otherwise(F.lit(0).cast("long"))


def _running(rows: DataFrame, order: list, sums: dict[str, str], tag: str) -> DataFrame:
    """rows in order with r, their number from 0, and for each column of `sums` its total over the rows before.

    Sorted by ranges of the order, so each task numbers a part; only one row a part meets in one task.
    """
    placed = materialize(rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)), tag)
    inner = W.partitionBy("_part").orderBy("_id").rowsBetween(W.unboundedPreceding, -1)
    outer = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(F.count("*").alias("r"), *[F.sum(c).alias(s) for s, c in sums.items()])
    before = totals.select("_part", *[F.coalesce(F.sum(s).over(outer), F.lit(0)).alias(f"_{s}") for s in ("r", *sums)])
    own = placed.withColumns({"r": F.col("_id").bitwiseAND((1 << 33) - 1)} | {s: F.coalesce(F.sum(c).over(inner), F.lit(0)) for s, c in sums.items()})
    return own.join(F.broadcast(before), "_part").withColumns({s: F.col(s) + F.col(f"_{s}") for s in ("r", *sums)}).drop("_part", "_id", *[f"_{s}" for s in ("r", *sums)])


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(k, source_size, target) of rows (k, size): the weights repeat along the sources by code point, null last.

    A target stops at cap times its source's size; what is cut is shared again by weight. That is the least level
    l with sum(min(cap_i, l * w_i)) = total, found with running sums over cap_i / w_i. One row a source; sources are sorted by ranges, so there may be very many.
    """
    per = _running(sizes.groupBy("k").agg(F.sum("size").alias("source_size")), [F.col("k") == "", "k"], {}, "mix-sources")
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("r") % len(weights) + 1).cast("int")))
    per = per.withColumn("c", F.col("source_size") * float(cap)).withColumn("q", F.col("c") / F.col("w")).withColumnRenamed("r", "name")
    total, tw = per.agg(F.sum("source_size") * float(share), F.sum("w")).first()
    per = _running(per, ["q", "name"], {"bc": "c", "bw": "w"}, "mix-levels")
    # the first source, by what it can take a unit of weight, that the level doesn't fill
    per = per.withColumn("level", (F.lit(total) - F.col("bc")) / (F.lit(tw) - F.col("bw")))
    fit = per.where(F.col("level") <= F.col("q")).agg(F.min(F.struct("q", "r", "level"))["level"]).first()[0]
    return per.select("k", "source_size", F.col("c").alias("target") if fit is None else F.least(F.col("c"), F.lit(fit) * F.col("w")).alias("target"))


def _with_plan(rows: DataFrame, plan: DataFrame, n: int) -> DataFrame:
    """rows joined with one row a source; from BROADCAST_SOURCES on by shuffle, and the largest sources by broadcast."""
    return rows.join(F.broadcast(plan) if n <= BROADCAST_SOURCES else plan, "k")


def mixing_plan(units: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0) -> tuple[DataFrame, int]:
    """Plan of rows (k, size, h): one row a source with its whole copies, the hash threshold of one copy more and its level.

    Each level sums words by source and hash bucket, takes the buckets that fit below the budget, and looks only at
    the bucket on the boundary again, by the next bits. A source whose bucket has SETTLE hash values or fewer stays at its
    level, whatever others need, and that bucket is settled value by value: in order of hash up to the first that doesn't fit, then the largest that still fit.
    Nothing is sorted but those; the result depends on the hashes only, so reruns agree.
    """
    state = materialize(source_targets(units, weights, share, cap).withColumns({"base": F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(cap)))).otherwise(0)}).withColumns({"gap": F.col("target") - F.col("base") * F.col("source_size"), "level": F.lit(0), "bound": F.lit(0).cast("long")}).join(units.groupBy("k").agg(F.count("*").alias("n")), "k"), "mix-targets")
    n = state.count()
    level, most = 0, state.agg(F.max("n")).first()[0] or 0
    while most > SETTLE and level < LEVELS:
        level += 1
        settled, open_ = state.where(F.col("n") <= SETTLE), state.where(F.col("n") > SETTLE)
        inside = _with_plan(units, open_.select("k", "bound"), n).where(_rank(F.col("h"), level - 1) == F.col("bound"))
        hist = inside.groupBy("k", _rank(F.col("h"), level).alias("b")).agg(F.sum("size").alias("s"), F.count("*").alias("n"))
        upto = W.partitionBy("k").orderBy("b").rowsBetween(W.unboundedPreceding, W.currentRow)
        cut = hist.withColumn("cum", F.sum("s").over(upto)).join(F.broadcast(open_.select("k", "gap")) if n <= BROADCAST_SOURCES else open_.select("k", "gap"), "k").where(F.col("cum") > F.col("gap"))
        first = cut.groupBy("k").agg(F.min_by(F.struct("b", (F.col("gap") - F.col("cum") + F.col("s")).alias("left"), "n"), "b").alias("x"))
        # a source without a boundary takes all of its remaining buckets
        old = open_.select("k", "source_size", "target", "base", "gap", "bound")
        past = F.shiftleft(F.col("bound") + 1, LEVEL_BITS)
        finer = old.join(first, "k", "left").select("k", "source_size", "target", "base", F.coalesce("x.left", F.lit(0.0)).alias("gap"), F.lit(level).alias("level"), F.coalesce("x.b", past).alias("bound"), F.coalesce("x.n", F.lit(0)).alias("n"))
        state = materialize(finer.unionByName(settled), f"mix-level{level}")
        most = state.agg(F.max("n")).first()[0] or 0
    inside = _with_plan(units, state.select("k", "bound", "level"), n).where(_rank_at(F.col("h"), F.col("level")) == F.col("bound"))
    values = inside.groupBy("k", "h").agg(F.sum("size").alias("size")).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("h", "size"))).alias("values"))
    plan = state.join(values, "k", "left")
    empty = F.array().cast("array<bigint>")
    plan = plan.withColumn("values", F.coalesce("values", F.array().cast("array<struct<h:bigint,size:bigint>>")))
    taking = lambda a, x, more: F.struct((a.left - x.size).alias("left"), F.concat(a.own, F.array(x.h)).alias("own"), *more)
    # in order of hash up to the first that doesn't fit, but for some values kept back
    begun = F.aggregate(F.slice("values", F.lit(1), F.greatest(F.lit(0), F.size("values") - SPARE)), F.struct(F.col("gap").alias("left"), empty.alias("own"), F.lit(True).alias("open")), lambda a, x: F.when(a.open & (x.size <= a.left), taking(a, x, [F.lit(True).alias("open")])).otherwise(F.struct(a.left.alias("left"), a.own.alias("own"), F.lit(False).alias("open"))))
    plan = plan.withColumn("got", begun)
    others = F.transform(F.filter("values", lambda x: ~F.array_contains(F.col("got.own"), x.h)), lambda x: F.struct(x.size.alias("size"), x.h.alias("h")))
    plan = plan.withColumn("others", F.sort_array(others, False))
    plan = plan.withColumn("fits", F.filter("others", lambda x: x.size <= F.col("got.left")))
    # then the largest that still fit, from a few starts; or the smallest of all, if to exceed comes nearer
    fill = lambda skip: F.aggregate(F.slice("fits", skip + 1, SETTLE), F.struct(F.col("got.left").alias("left"), empty.alias("own")), lambda a, x: F.when(x.size <= a.left, taking(a, x, [])).otherwise(a))
    ways = [F.struct(w["left"].alias("off"), w["own"].alias("own")) for w in map(fill, range(STARTS))]
    over = F.array_min(F.filter("others", lambda x: x.size > F.col("got.left")))
    ways.append(F.when(over.isNotNull(), F.struct((over["size"] - F.col("got.left")).alias("off"), F.array(over["h"]).alias("own"))))
    plan = plan.withColumn("own", F.concat("got.own", F.array_min(F.array_compact(F.array(*ways)))["own"]))
    return materialize(plan.select("k", "source_size", "target", F.col("base").cast("int").alias("base"), "bound", "level", "own"), "mix-plan"), n


def _copies(h: Column) -> Column:
    rank = _rank_at(h, F.col("level"))
    more = (rank < F.col("bound")) | ((rank == F.col("bound")) & F.array_contains("own", h))
    return F.col("base") + F.when(more, 1).otherwise(0)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """docs with copies (0, 1 or 2): how often the mix takes each row.

    Cases: a null text has no words and is never needed to meet a target; a null source is a source of its own, the
    last; rows equal in id and text share one hash and so one decision; an empty table gives an empty result. An
    input column named `copies` is replaced. One source may hold most rows: sums are combined before the shuffle.
    """
    docs = replace_columns(docs, ["copies"])
    k, h = (free_name(docs, f"mix_{x}") for x in ("k", "h"))
    units = docs.select(_key(F.col(f"`{source_col}`")).alias("k"), word_count(F.col(f"`{text_col}`")).alias("size"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("h"))
    plan, n = mixing_plan(materialize(units, "mix-units"), weights, share, cap)
    small = plan.select(F.col("k").alias(k), "base", "bound", "level", "own")
    names = {c: free_name(docs, f"mix_{c}") for c in ("base", "bound", "level", "own")}
    small = small.withColumnsRenamed(names)
    rank = _rank_at(F.col(h), F.col(names["level"]))
    more = (rank < F.col(names["bound"])) | ((rank == F.col(names["bound"])) & F.array_contains(names["own"], F.col(h)))
    joined = docs.withColumns({k: _key(F.col(f"`{source_col}`")), h: F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))}).join(F.broadcast(small) if n <= BROADCAST_SOURCES else small, k)
    return joined.withColumn("copies", F.col(names["base"]) + F.when(more, 1).otherwise(0)).drop(k, h, *names.values())


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(id, size, source_size, target, taken) of every row; the texts are read once."""
    units = materialize(docs.select(F.col(f"`{id_col}`").alias(id_col), _key(F.col(f"`{source_col}`")).alias("k"), word_count(F.col(f"`{text_col}`")).alias("size"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("h")), "mix-units")
    plan, n = mixing_plan(units.select("k", "size", "h"), weights, share, cap)
    return _with_plan(units, plan, n).select(id_col, "size", "source_size", "target", (F.col("size") * _copies(F.col("h"))).cast("long").alias("taken"))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
