"""Operator 3: robust multivariate outliers by minimum covariance determinants, in DataFrame expressions only."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACE, free_name, join_counted, materialize, table

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Documents with fewer words, or a larger share in percent of repeated words, fail the base rules.
LEAST_WORDS, MOST_REPEAT = 50, 50
#: Coordinates of the vector, each with the least deviation that counts as one (log words, word length, log symbol
#: share, share of duplicate lines, share of repeated words).
COORDS = ("x0", "x1", "x2", "x3", "x4")
LEAST_SCALE = (0.5, 0.3, 0.6, 0.20, 0.07)
#: Share of a group that the determinant is made least over, concentration steps of all starts and then of the best one,
#: rows that a group of its own needs.
SUBSET, FIRST_STEPS, STEPS, LEAST_GROUP = 0.75, 2, 3, 200
#: Consistency at the normal distribution for five coordinates and three quarters of the rows.
CONSISTENCY = 1.6
#: Squared distance beyond which a row is rejected: in the far tail of chi-square with five degrees of freedom
#: (0.9999 lies at 25.7), since statistics of clean prose have longer tails than a normal distribution.
CUTOFF = 25.7
#: Histogram bins a doubling of the squared distance, and of a coordinate's range.
BINS_LOG, BINS_COORD = 32, 50.0
BROADCAST_GROUPS = 50_000


def base_statistics(text: Column) -> dict[str, Column]:
    """Expressions that need only the text; the words are made apart, once."""
    kept = F.length(F.translate(text, SYMBOLS, ""))
    return {"n_symbols": (F.length(text) - kept).cast("long")}


def with_statistics(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long).

    Repeated words: each 3-word window of a text becomes (hash, position); sorting them puts equal windows side by
    side; the positions of windows that have an equal neighbour, in order, cover min(3, gap to the next) words each.
    All of it stays within the row, so nothing is shuffled.
    """
    t, w, l, g, p = (free_name(docs, f"stat_{x}") for x in "twlgp")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    out = docs.withColumn(t, text).withColumn(w, F.when(F.length(bare) > 0, F.split(bare, SPACE, -1)).otherwise(F.array().cast("array<string>")))
    out = out.withColumn(l, F.filter(F.split(F.col(t), "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0))
    windows = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.struct(F.xxhash64(F.get(F.col(w), i - 1), F.get(F.col(w), i), F.get(F.col(w), i + 1)).alias("h"), i.alias("i"))))
    out = out.withColumn(g, F.sort_array(F.coalesce(windows, F.array().cast("array<struct<h:bigint,i:int>>"))))
    # 0 marks windows without an equal neighbour
    twins = F.transform(F.col(g), lambda x, k: F.when((F.get(F.col(g), k - 1)["h"] == x["h"]) | (F.get(F.col(g), k + 1)["h"] == x["h"]), x["i"]).otherwise(0))
    out = out.withColumn(p, F.array_sort(F.array_remove(twins, 0)))
    covered = F.aggregate(F.col(p), F.struct(F.lit(-9).alias("last"), F.lit(0).cast("long").alias("n")), lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")), lambda a: a["n"])
    return out.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": base_statistics(F.col(t))["n_symbols"],
            "n_dup_lines": (F.size(l) - F.size(F.array_distinct(l))).cast("long"),
            "n_repeat_words": covered,
        }
    ).drop(t, w, l, g, p)


def vector(n_lines_words: Column | None = None) -> list[Column]:
    """The transformed statistics: logarithms and shares, so that one long document doesn't stretch a group."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return [F.log1p(F.col("n_words").cast("double")), F.col("word_chars") / n, F.log((F.col("n_symbols") + 1) / (chars + 100)) / 1.0, F.col("n_dup_lines") / (n / 50 + 1), F.col("n_repeat_words") / (n + 10)]


def _attach(rows: DataFrame, groups: DataFrame, sizes: DataFrame, n: int, on: list[str]) -> DataFrame:
    """rows joined with what is known of their groups: broadcast, or from BROADCAST_GROUPS groups on by shuffle, in which the
    groups of most rows are broadcast alone. sizes: (g, n) of the rows."""
    if n <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), on)
    total = sizes.agg(F.sum("n")).first()[0]
    counted = groups.join(sizes.select("g", "n"), "g")
    return join_counted(rows, counted, on, total, [c for c in groups.columns if c not in on])


def _factor(stats: DataFrame) -> DataFrame:
    """Cholesky factors l{i}_{j} of the covariances c{i}_{j}, whose diagonal is at least the square of LEAST_SCALE."""
    d = len(COORDS)
    for j in range(d):
        new = {}
        own = F.col(f"c{j}_{j}") - sum((F.col(f"l{j}_{k}") * F.col(f"l{j}_{k}") for k in range(j)), F.lit(0.0))
        stats = stats.withColumn(f"l{j}_{j}", F.sqrt(F.greatest(own, F.lit(LEAST_SCALE[j] ** 2 / 4))))
        for i in range(j + 1, d):
            new[f"l{i}_{j}"] = (F.col(f"c{i}_{j}") - sum((F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}_{j}")
        if new:
            stats = stats.withColumns(new)
    return stats


def _distance(rows: DataFrame) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance by forward substitution."""
    z: list[str] = []
    for i, x in enumerate(COORDS):
        rows = rows.withColumn(f"z{i}", (F.col(x) - F.col(f"m{i}") - sum((F.col(f"l{i}_{k}") * F.col(f"z{k}") for k in range(i)), F.lit(0.0))) / F.col(f"l{i}_{i}"))
        z.append(f"z{i}")
    return rows.withColumn("d2", sum((F.col(c) * F.col(c) for c in z), F.lit(0.0))).drop(*z)


def _cut_bins(hist: DataFrame, share: float, name: str, keys: list[str]) -> DataFrame:
    """For rows (keys, b, n) the least bin b of each key up to which at least the share of its rows lies."""
    upto = W.partitionBy(*keys).orderBy("b").rowsBetween(W.unboundedPreceding, W.currentRow)
    return hist.withColumns({"cum": F.sum("n").over(upto), "all": F.sum("n").over(W.partitionBy(*keys))}).where(F.col("cum") >= share * F.col("all")).groupBy(*keys).agg(F.min("b").alias(name))


def _middles(rows: DataFrame, value, name: str, of) -> DataFrame:
    """(g, name0..): for each coordinate the bin that holds its median, all coordinates in one pass; `of` makes it a value."""
    stacked = rows.select("g", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(value(i) * BINS_COORD).alias("b")) for i in range(len(COORDS))])).alias("x")).select("g", "x.i", "x.b")
    bins = _cut_bins(stacked.groupBy("g", "i", "b").agg(F.count("*").alias("n")), 0.5, "b", ["g", "i"])
    return bins.groupBy("g").agg(*[F.max(F.when(F.col("i") == i, of(F.col("b")))).alias(f"{name}{i}") for i in range(len(COORDS))])


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Means and covariances of each key; the covariance is enlarged for the part that was left out, and LEAST_SCALE is added."""
    d = range(len(COORDS))
    aggs = [F.avg(x).alias(f"m{i}") for i, x in enumerate(COORDS)]
    aggs += [F.covar_pop(COORDS[i], COORDS[j]).alias(f"c{i}_{j}") for i in d for j in range(i + 1)]
    out = rows.groupBy(*keys).agg(*aggs)
    return out.withColumns({f"c{i}_{j}": F.col(f"c{i}_{j}") * CONSISTENCY + (LEAST_SCALE[i] ** 2 if i == j else 0.0) for i in d for j in range(i + 1)})


def _starts(rows: DataFrame, middle: DataFrame, sizes: DataFrame, n: int) -> DataFrame:
    """(g, s, m0.., c0_0..): three estimates to start from, around the medians: deviations of the coordinates alone, the
    covariance of directions, and that of the coordinates' hyperbolic tangents; all in units of the median deviations."""
    d = range(len(COORDS))
    z = {f"z{i}": (F.col(x) - F.col(f"m{i}")) / F.col(f"s{i}") for i, x in enumerate(COORDS)}
    scaled = _attach(rows, middle, sizes, n, ["g"]).withColumns(z).withColumn("norm", F.sqrt(sum((F.col(c) * F.col(c) for c in z), F.lit(1e-12))))
    pairs = [(i, j) for i in d for j in range(i + 1)]
    told = scaled.groupBy("g").agg(
        *[F.avg(F.col(f"z{i}") * F.col(f"z{j}") / (F.col("norm") * F.col("norm"))).alias(f"u{i}_{j}") for i, j in pairs],
        *[F.avg(F.tanh(f"z{i}") * F.tanh(f"z{j}")).alias(f"t{i}_{j}") for i, j in pairs],
    )
    own = middle.join(told, "g")
    # each shape has its trace made that of the first
    forms = []
    for s, name in enumerate(("", "u", "t")):
        trace = sum((F.col(f"{name}{i}_{i}") for i in d), F.lit(1e-12)) / len(COORDS) if name else F.lit(1.0)
        of = lambda i, j: (F.col(f"{name}{i}_{j}") / trace if name else F.lit(1.0 if i == j else 0.0)) * F.col(f"s{i}") * F.col(f"s{j}")  # noqa: B023, E731
        forms.append(F.struct(F.lit(s).alias("s"), *[(of(i, j) + (LEAST_SCALE[i] ** 2 if i == j else 0.0)).alias(f"c{i}_{j}") for i, j in pairs]))
    return own.select("g", *[f"m{i}" for i in d], F.explode(F.array(*forms)).alias("x")).select("g", *[f"m{i}" for i in d], "x.*")


def _concentrate(rows: DataFrame, est: DataFrame, sizes: DataFrame, n: int) -> DataFrame:
    """One step: the estimates (g, s) of the share SUBSET of the rows that are nearest by the ones before, with `det`, the
    root of the determinant."""
    far = _distance(_attach(rows, est, sizes, n, ["g"])).withColumn("b", F.floor(F.log2(F.col("d2") + 1e-6) * BINS_LOG)).select("g", "s", *COORDS, "b")
    bound = materialize(_cut_bins(far.groupBy("g", "s", "b").agg(F.count("*").alias("n")), SUBSET, "bound", ["g", "s"]), "mcd-bound")
    near = _attach(far, bound, sizes, n, ["g", "s"]).where(F.col("b") <= F.col("bound"))
    det = functools.reduce(lambda a, b: a * b, (F.col(f"l{i}_{i}") for i in range(len(COORDS))))
    return materialize(_factor(_moments(near, ["g", "s"])).withColumn("det", det), "mcd-step")


def robust_estimates(rows: DataFrame, sizes: DataFrame, n: int) -> DataFrame:
    """(g, s, m0.., c0_0.., l0_0.., det): each group's minimum-covariance-determinant estimate.

    Three starts go through FIRST_STEPS concentration steps; the one with the least determinant goes on for STEPS more,
    and of all its estimates the one with the least determinant is kept. A step takes the share SUBSET of the rows of
    least distance, by a histogram of the distance's logarithm, and estimates anew. LEAST_SCALE squared is added to each
    variance, as in a regularised determinant, which a step doesn't enlarge but for the width of a bin. Groups are
    combined before each shuffle, so one may hold most rows, and histograms have a bounded number of bins a group.
    """
    d = range(len(COORDS))
    middle = materialize(_middles(rows, lambda i: F.col(COORDS[i]), "m", lambda b: (b + 0.5) / BINS_COORD), "mcd-medians")
    off = _attach(rows, middle, sizes, n, ["g"])
    spread = _middles(off, lambda i: F.abs(F.col(COORDS[i]) - F.col(f"m{i}")), "s", lambda b: b / BINS_COORD * 1.4826)
    floors = {f"s{i}": F.sqrt(F.pow(f"s{i}", F.lit(2.0)) + LEAST_SCALE[i] ** 2) for i in d}
    middle = materialize(middle.join(spread, "g").withColumns(floors), "mcd-spreads")
    est = materialize(_factor(_starts(rows, middle, sizes, n)), "mcd-starts")
    for _ in range(FIRST_STEPS):
        est = _concentrate(rows, est, sizes, n)
    best = lambda e: e.groupBy("g").agg(F.min_by(F.struct(*[c for c in e.columns if c != "g"]), F.struct("det", "s")).alias("x")).select("g", "x.*")
    est = materialize(best(est), "mcd-best")
    seen = est
    for _ in range(STEPS):
        est = _concentrate(rows, est, sizes, n)
        seen = seen.unionByName(est)
    return materialize(best(seen), "mcd-least")


def robust_distances(rows: DataFrame) -> DataFrame:
    """rows (g, x0..x4, anything else) with d2, each measured by its group's minimum-covariance-determinant estimate."""
    sizes = materialize(rows.groupBy("g").agg(F.count("*").alias("n")), "mcd-groups")
    n = sizes.count()
    est = robust_estimates(rows.select("g", *COORDS), sizes, n).drop("s", "det")
    return _distance(_attach(rows, est, sizes, n, ["g"])).drop(*[c for c in est.columns if c not in ("g", *rows.columns)])


def reject_outliers(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """id_cols with the statistics, base_failed, distance (squared) and kept.

    Estimates are per language and source; pairs of fewer than LEAST_GROUP rows that pass the base rules share the
    estimate of their language, and languages of fewer share one of all rows. Only rows that pass the base rules
    are estimated from.

    Cases: a null or empty text has no words and fails the base rules; null languages and sources are values of
    their own; repeated rows get equal results; an empty table gives an empty result; statistics without any spread
    count with LEAST_SCALE.
    """
    own = docs.select(*[F.col(f"`{c}`") for c in id_cols], F.col(f"`{text_col}`").alias("stat__text"), F.col(f"`{lang_col}`").cast("string").alias("stat__lang"), F.col(f"`{source_col}`").cast("string").alias("stat__source"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT * F.col("n_words"))
    rows = with_statistics(own, "stat__text").drop("stat__text").withColumn("base_failed", failed)
    rows = materialize(rows.withColumns(dict(zip(COORDS, vector()))), "mcd-rows")
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    good = rows.where(~F.col("base_failed"))
    per = materialize(good.groupBy("stat__lang", "stat__source").agg(F.count("*").alias("n")), "mcd-pairs")
    langs = W.partitionBy("stat__lang")
    fine, coarse = F.concat(name("stat__lang"), F.lit("\x1f"), name("stat__source")), name("stat__lang")
    group = F.when(F.col("n") >= LEAST_GROUP, fine).when(F.sum("n").over(langs) >= LEAST_GROUP, F.concat(F.lit("lang "), coarse)).otherwise(F.lit("all"))
    pair = F.concat_ws("\x1e", name("stat__lang"), name("stat__source")).alias("pair")
    groups = materialize(per.withColumn("g", group).select(pair, "g", "n"), "mcd-names")
    keyed = good.withColumn("pair", pair)
    told = robust_distances(join_counted(keyed, groups, ["pair"], good.count(), ["g"]).drop("pair"))
    passed = told.withColumn("distance", F.col("d2")).withColumn("kept", F.col("d2") <= CUTOFF)
    rest = rows.where("base_failed").withColumn("distance", F.lit(None).cast("double")).withColumn("kept", F.lit(False))
    cols = [*[F.col(f"`{c}`") for c in id_cols], *STATS, "base_failed", "distance", "kept"]
    return passed.select(*cols).unionByName(rest.select(*cols))


def op3_robust_outliers(spark, sf_dir: str) -> DataFrame:
    return reject_outliers(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
