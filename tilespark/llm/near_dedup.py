"""Operator 10: near duplicates by an inverted join on the coordinates of MinHash signatures."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, components, free_name, join_counted, map_arrow, materialize, mix, range_hashes, release, shingle_sets, table

#: Coordinates of a signature, and most minima that one of them is made of.
COORDS, MOST_MINIMA = 48, 4
#: Most pairs at the wanted similarity that the count of matches may lose.
LOSS = 1e-6
_A = np.random.default_rng(7).integers(1, 1 << 63, COORDS * MOST_MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(8).integers(0, 1 << 63, COORDS * MOST_MINIMA, np.uint64)
_STEP = np.uint64(0x9FB21C651E98DF25)
#: Leaders that a class is compared with at first; all others that may be alike are found by their shingles afterwards.
LEADERS = 3


def plan(percent: int) -> tuple[int, int]:
    """(minima of a coordinate, matches that a pair needs): the most of both at which a pair of the wanted similarity,
    which matches in each coordinate with probability similarity^minima, is lost with probability LOSS at most."""
    for minima in range(MOST_MINIMA, 0, -1):
        p = (percent / 100) ** minima
        lost, matches = 0.0, 0
        while matches < COORDS and (lost := lost + math.comb(COORDS, matches) * p**matches * (1 - p) ** (COORDS - matches)) <= LOSS:
            matches += 1
        if matches:
            return minima, matches
    raise ValueError(f"{COORDS} coordinates don't tell pairs of similarity {percent} % apart")


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, minima: int) -> DataFrame:
    """(i, t, c, n, sig): id, hash of the text, class of equal shingle sets (null without words), set size, signature.

    sig: a 64-bit name of each coordinate-value pair; a coordinate's value is several minima together, so that texts
    that only share common words agree in next to none.
    """
    kind = docs.select(F.col(f"`{id_col}`")).schema[0].dataType

    def sign(batch: pa.RecordBatch) -> dict:
        rows = batch.num_rows
        c, n, sig = np.zeros(rows, np.uint64), np.zeros(rows, np.int64), np.zeros((rows, COORDS), np.uint64)
        for row, end, values, first in shingle_sets(batch.column(2), size):
            counts = np.diff(first)
            n[row:end] = counts
            has = np.flatnonzero(counts)
            if len(has):
                c[row + has] = range_hashes(values, first[:-1][has], first[1:][has])
                at = first[:-1][has]
                with np.errstate(over="ignore"):
                    for k in range(COORDS):
                        name = np.full(len(has), k + 1, np.uint64)
                        for j in range(k * minima, (k + 1) * minima):
                            name = mix(name * _STEP + np.minimum.reduceat((values * _A[j] + _B[j]) >> np.uint64(32), at))
                        sig[row + has, k] = name
        flat = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * COORDS), pa.array(sig.reshape(-1).view(np.int64)))
        return {"i": batch.column(0), "t": batch.column(1), "c": pa.array(c.view(np.int64), mask=n == 0), "n": n, "sig": flat}

    fields = [T.StructField("i", kind), T.StructField("t", T.LongType()), T.StructField("c", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sig", T.ArrayType(T.LongType()))]
    own = docs.select(F.col(f"`{id_col}`").alias("i"), F.xxhash64(F.col(f"`{text_col}`")).alias("t"), F.col(f"`{text_col}`").alias("x"))
    return map_arrow(own, sign, T.StructType(fields))


def _postings(classes: DataFrame, matches: int) -> DataFrame:
    """(c, v, known): the postings of each class under its rarest coordinate-value pairs, as far as they can meet another.

    Of the lists that a class shares with others, a class that matches it in enough of them is met in one of the rarest
    size - matches + 1; the longest matches - 1 are skipped, and looked into only for pairs that were met. A class that
    shares fewer lists than that matches no other: most documents end here. known: lengths of all its lists, which is
    most for the text that a group's copies stem from.
    """
    posted = classes.select("c", "n", F.explode("sig").alias("v"))
    often = materialize(posted.groupBy("v").agg(F.count("*").alias("n")).where("n > 1"), "near-often")
    lists = join_counted(posted.withColumnRenamed("n", "size"), often, ["v"], COORDS * classes.count(), ["n"])
    shared = lists.groupBy("c", "size").agg(F.sort_array(F.collect_list(F.struct("n", "v"))).alias("p")).where(F.size("p") >= matches)
    rarest = F.explode(F.slice("p", F.lit(1), F.size("p") - (matches - 1)))
    known = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    out = materialize(shared.select("c", F.col("size").alias("n"), known.alias("known"), rarest.alias("x")).select("c", "n", "x.v", "known"), "near-postings")
    release(often)
    return out


#: Most bytes of a row (class, size, signature) and of a short one.
SIGNED, SHORT = 32 + 8 * COORDS, 64


def _alike(pairs: DataFrame, active: DataFrame, percent: int, matches: int) -> DataFrame:
    """(a, b): the pairs whose set sizes allow the similarity and whose lists coincide often enough."""
    for x in "ab":
        known = active.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
        pairs = attach(pairs, known, [x], SIGNED)
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return pairs.where(fits & (F.size(F.array_intersect("sa", "sb")) >= matches)).select("a", "b")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): the pairs whose full shingle sets have the similarity; b may be one class of very many pairs."""

    def verify(batch: pa.RecordBatch) -> dict:
        sets = []
        for side in (2, 3):
            coded, own = batch.column(side).dictionary_encode(), []
            for _, _, values, first in shingle_sets(coded.dictionary, size):
                own += [values[x:y] for x, y in zip(first[:-1].tolist(), first[1:].tolist())]
            sets.append([own[i] for i in coded.indices.to_pylist()])
        good = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(*sets)):
            shared = len(np.intersect1d(x, y, assume_unique=True))
            good[i] = 100 * shared >= percent * (len(x) + len(y) - shared) and shared > 0
        take = pa.array(np.flatnonzero(good))
        return {"a": batch.column(0).take(take), "b": batch.column(1).take(take)}

    side = lambda x: texts.select(F.col("c").alias(x), F.col("x").alias(f"x{x}")).hint("merge")
    rows = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "xa", "xb")
    return map_arrow(rows, verify, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def _rare_pairs(apart: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): pairs of classes (c, w, g, n) of one cluster w, but of different components g, that may have the similarity.

    Two such sets share a shingle among the rarest of each: of n, all but percent of them, plus one. Counts are taken
    within the cluster; a shingle that only one of its classes has takes a place of the prefix and meets nothing, so a
    class that differs from all others by more than the similarity allows meets none. The place of the first shared
    shingle bounds what can be shared from there on, which drops most pairs that share a common one.
    """

    def spread(batch: pa.RecordBatch) -> dict:
        rows, s = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for row, end, values, first in shingle_sets(batch.column(4), size):
            rows.append(np.repeat(np.arange(row, end), np.diff(first)))
            s.append(values)
        take = pa.array(np.concatenate(rows))
        return {k: batch.column(i).take(take) for i, k in enumerate("wcgm")} | {"s": np.concatenate(s).view(np.int64)}

    given = texts.join(apart.hint("merge"), "c").select("w", "c", "g", F.col("n").alias("m"), "x")
    held = materialize(map_arrow(given, spread, T.StructType([T.StructField(k, T.LongType()) for k in "wcgms"])), "near-held")
    often = materialize(held.groupBy("w", "s").agg(F.count("*").alias("n")).where("n > 1"), "near-shingles")
    shared = held.join(often.hint("merge"), ["w", "s"])
    ranked = shared.groupBy("w", "c", "g", F.col("m").alias("n")).agg(F.sort_array(F.collect_list(F.struct(F.col("n").alias("f"), "s"))).alias("p"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    lone = (F.col("n") - F.size("p")).cast("int")
    posts = ranked.select("c", "w", "g", "n", lone.alias("lone"), F.posexplode(F.slice("p", F.lit(1), F.greatest(F.lit(0), (prefix - lone).cast("int")))).alias("i", "x"))
    posts = materialize(posts.select("c", "w", "g", "n", F.col("x.s").alias("s"), (F.col("n") - F.col("lone") - F.col("i")).alias("rest")), "near-rare")
    release(held, often)
    x, y = (posts.select("w", "s", F.col("c").alias(k), F.col("g").alias(f"g{k}"), F.col("n").alias(f"n{k}"), F.col("rest").alias(f"r{k}")) for k in "ab")
    fits = (F.col("ga") < F.col("gb")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.least("ra", "rb") * (100 + percent) >= percent * (F.col("na") + F.col("nb")))
    pairs = x.join(y.withColumnsRenamed({"w": "wb", "s": "sb"}).hint("merge"), (F.col("w") == F.col("wb")) & (F.col("s") == F.col("sb")) & fits)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _clusters(posts: DataFrame, led: DataFrame) -> DataFrame:
    """(c, w): classes that have a list in common, directly or by others, have one w. Each class is joined with its first
    leader (a, b), and then what lists still part, so that the edges are few."""
    first = components(led, "near-clusters").select(F.col("node").alias("c"), F.col("component").alias("u"))
    first = materialize(posts.select("c").distinct().join(first, "c", "left").select("c", F.coalesce("u", "c").alias("u")), "near-first")
    held = materialize(attach(posts.select("c", "v"), first, ["c"], SHORT).select("v", "u"), "near-held")
    parted = materialize(held.groupBy("v").agg(F.min("u").alias("b"), F.max("u").alias("most")).where("b < most").select("v", "b"), "near-parted")
    edges = materialize(attach(held, parted, ["v"], SHORT).where("u <> b").select(F.col("u").alias("a"), "b"), "near-bridges")
    bridged = materialize(components(edges, "near-bridged").select(F.col("node").alias("u"), F.col("component").alias("w")), "near-bridged")
    return attach(first, bridged, ["u"], SHORT, "left").select("c", F.coalesce("w", "u").alias("w"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row, and text_hash to tell rows of one id apart.

    Rows with equal shingle sets are one class. Classes are posted under every coordinate-value pair of their signature;
    a pair of classes is looked at if it meets in one of its rarest lists and coincides in at least as many lists as
    `plan` says, which loses a pair at exactly the similarity with probability LOSS. First each class meets the LEADERS
    that lead most of its lists, the best-known members, which joins the members of a large group without pairing them.
    Classes of lists that still hold several components then meet by the rarest shingles of their full sets, counted
    within the cluster of all that lists connect; those are all that may be alike. All pairs are confirmed on their full sets. Links that are never looked at join
    what is joined already. Joins in which one class, list or leader may have very many rows either count their keys first,
    broadcast a counted table, or stand last in their job, where Spark splits large partitions.

    Cases: null and empty texts have an empty set, link with nothing and are kept; texts of fewer words than `size`
    are one shingle; null ids take part and count as larger than any id; repeated rows share a class and, with equal
    ids, are all kept if one is; an empty table gives an empty result; other columns are ignored.
    """
    minima, matches = plan(percent)
    rows = materialize(signatures(docs, id_col, text_col, size, minima), "near-rows")
    classes = rows.where("c is not null").groupBy("c").agg(F.min("i").alias("least"), F.min(F.struct("i", "t")).alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = materialize(classes, "near-classes")
    posts = _postings(classes, matches)
    active = materialize(classes.join(posts.select("c").distinct(), "c", "left_semi").select("c", "rep", "n", "sig"), "near-active")
    lead = materialize(posts.groupBy("v").agg(F.max_by("c", F.struct("known", "c")).alias("b"), F.max("known").alias("known"), F.count("*").alias("m")).where("m > 1").select("v", "b", "known"), "near-leaders")
    star = materialize(attach(posts.select("v", F.col("c").alias("a")), lead, ["v"], SHORT).where("a <> b").select("a", "b", "known"), "near-star")
    ranked = star.groupBy("a", "b").agg(F.count("*").alias("met"), F.max("known").alias("known")).groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("met", "known", "b")), False), 1, LEADERS).alias("x"))
    led = materialize(ranked.select("a", F.posexplode("x").alias("rank", "x")).select("a", "rank", "x.b"), "near-led")
    tested = materialize(_alike(led.select("a", "b"), active, percent, matches), "near-pairs")

    # the texts of all active classes, fetched once
    needed = active.select("c", F.col("rep.i").alias("ri"), F.col("rep.t").alias("rt"))
    named = docs.select(F.col(f"`{id_col}`").alias("i"), F.xxhash64(F.col(f"`{text_col}`")).alias("t"), F.col(f"`{text_col}`").alias("x"))
    texts = materialize(named.join(needed.hint("merge"), (named["t"] == needed["rt"]) & named["i"].eqNullSafe(needed["ri"])).select("c", "x"), "near-texts")
    if texts.count() > active.count():  # rows that are equal in id and text
        texts = materialize(texts.dropDuplicates(["c"]), "near-texts")

    links = materialize(_confirmed(tested, texts, size, percent), "near-links")
    comps = components(links, "near")
    places = _clusters(posts, led.where("rank = 0")).join(comps.select(F.col("node").alias("c"), F.col("component").alias("g")), "c", "left").select("c", "w", F.coalesce("g", "c").alias("g"))
    places = materialize(places, "near-places")
    labelled = materialize(attach(posts.select("c", "v", "n"), places, ["c"], SHORT), "near-labelled")
    mixed = materialize(labelled.groupBy("v").agg(F.min("g").alias("x"), F.max("g").alias("y")).where("x < y").select("v"), "near-mixed")
    apart = materialize(attach(labelled, mixed, ["v"], SHORT, "left_semi").select("c", "w", "g", "n"), "near-left")
    apart = materialize(apart.distinct(), "near-apart")
    cross = _rare_pairs(apart, texts, size, percent)
    known = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    cross = materialize(cross.join(known, ["a", "b"], "left_anti"), "near-cross")
    if not cross.isEmpty():
        more = materialize(_alike(cross, active, percent, matches), "near-pairs")
        found = materialize(_confirmed(more, texts, size, percent), "near-links")
        if not found.isEmpty():
            comps = components(links.union(found), "near")
    release(texts, posts, star, led, labelled)

    # only classes that are linked have another component than themselves
    ids = materialize(comps.select(F.col("node").alias("c"), F.col("component").alias("g")).join(classes.select("c", "least"), "c"), "near-ids")
    of = materialize(ids.groupBy("g").agg(F.min("least").alias("component_id")), "near-least")
    linked = materialize(attach(ids.select("c", "g"), of, ["g"], SHORT).select("c", "component_id"), "near-linked")
    named_classes = classes.select("c", "least").join(linked, "c", "left").select("c", F.coalesce("component_id", "least").alias("component_id"))
    named_classes = materialize(named_classes, "near-components")
    out = rows.select("i", "t", "c", "n").join(named_classes.hint("merge"), "c", "left")
    own = F.when(F.col("c").isNull(), F.col("i")).otherwise(F.col("component_id"))
    return out.select(F.col("i").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("i").eqNullSafe(own).alias("kept"), F.col("t").alias("text_hash"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """docs without near duplicates: of each component the row of least id stays (one of rows equal in id and text)."""
    i, t = free_name(docs, "near_i"), free_name(docs, "near_t")
    kept = near_duplicates(docs, id_col, text_col, size, percent).where("kept").select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias(i), F.col("text_hash").alias(t)).distinct()
    keyed = docs.withColumns({i: F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), t: F.xxhash64(F.col(f"`{text_col}`"))})
    return keyed.join(materialize(kept, "near-kept").hint("merge"), [i, t]).dropDuplicates([i, t]).drop(i, t)


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, size=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 80 * (a.n + b.n - shared)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON r.doc_id = l.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id, d.doc_id = min(r.c) AS kept
FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
