"""Operator 6: near-duplicate vectors by counting collisions in many sorted one-dimensional projections."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, components, join_counted, map_arrow, materialize, mix, release, table

#: Vectors of a block; blocks of a cluster meet in pairs, one task each. A label of no more vectors is one cluster.
BLOCK = 1024
#: Width of a cell in deviations of a linked pair's difference on one line; lines of a cell, at least and at most; most
#: pairs at the wanted cosine that no cluster holds; cells that a vector and its leader need in common.
CELL, FEWEST, MOST, LOSS, COMMON = 5.0, 4, 12, 1e-5, 2
#: Half width of a window as a share of the largest distance of a linked pair, and projections counted on all pairs.
WINDOW, FIRST = 0.5, 16
_rotations: dict[int, np.ndarray] = {}


def rotation(dim: int) -> np.ndarray:
    """A fixed random orthonormal basis: its columns are the projections."""
    if dim not in _rotations:
        _rotations[dim] = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))[0]
    return _rotations[dim]


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def collisions(left: np.ndarray, right: np.ndarray, distance: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that collide often enough in the windows of their projections (rows are projected unit vectors).

    The projections are an orthonormal basis, so the squared differences of a pair sum to its squared distance d^2.
    With windows of half width w, at most d^2 / w^2 projections of a linked pair can miss: the least count follows
    from that, and no linked pair is lost.
    """
    dim = left.shape[1]
    w = distance * WINDOW + 1e-9
    misses = int(distance * distance / (w * w) + 1e-6)
    first = min(FIRST, dim)
    count = np.zeros((len(left), len(right)), np.uint8)
    for j in range(first):
        order = np.argsort(right[:, j], kind="stable")
        rank = np.empty(len(right), np.uint16)
        rank[order] = np.arange(len(right), dtype=np.uint16)
        line = right[order, j]
        low = np.searchsorted(line, left[:, j] - w, "left")
        width = (np.searchsorted(line, left[:, j] + w, "right") - low).astype(np.uint16)
        # inside the window: low <= rank < low + width, in unsigned arithmetic
        count += (rank[None, :] - low.astype(np.uint16)[:, None]) < width[:, None]
    i, k = np.nonzero(count >= max(0, first - misses))
    total = count[i, k].astype(np.int32)
    for j in range(first, dim):
        total += np.abs(left[i, j] - right[k, j]) <= w
        if j % 16 == 15:
            alive = total >= j + 1 - misses
            i, k, total = i[alive], k[alive], total[alive]
    alive = total >= dim - misses
    return i[alive], k[alive]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of each index' component under links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def cell_plan(vectors: int) -> tuple[int, int]:
    """(lines of a cell, cells of a vector) for a label of so many vectors: more lines the more vectors, so that few
    unrelated ones share a cell, and as many cells as keep the loss of linked pairs below LOSS."""
    lines = min(MOST, max(FEWEST, math.ceil(math.log(max(vectors, 2)) / 1.3)))
    # a linked pair lies in one cell of a line with probability 1 - E|difference| / width; some leaders are strangers
    p = 0.87 * (1 - math.sqrt(2 / math.pi) / CELL) ** lines
    cells = COMMON
    while sum(math.comb(cells, k) * p**k * (1 - p) ** (cells - k) for k in range(COMMON)) > LOSS:
        cells += 1
    return lines, cells


@functools.lru_cache(64)
def _directions(dim: int, lines: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of all lines, and the offsets of their cells in widths."""
    rng = np.random.default_rng((dim, lines))
    d = rng.standard_normal((dim, lines * cells))
    return d / np.linalg.norm(d, axis=0), rng.random(lines * cells)


def _clusters(placed: DataFrame, sizes: DataFrame, distance: float) -> DataFrame:
    """(k, c): the cluster of each vector (g, k, v) of the labels (g, n) of more than BLOCK, of those that have any mate.

    Every vector lies in many cells, each a piece of several random lines; in each cell it names a leader, the largest
    key. Vectors that share COMMON cells with their leader are connected with it. A row a vector and cell is dealt,
    without the vector itself, so what is shuffled grows with the vectors, whatever their clusters.
    """

    def cells(batch: pa.RecordBatch) -> dict:
        lists, k, n = batch.column(0), batch.column(1), batch.column(2).to_numpy()
        g = np.array([xxhash.xxh3_64_intdigest(x) for x in batch.column(3).to_pylist()], np.uint64)
        dims, rows, keys = lists.value_lengths().to_numpy(zero_copy_only=False), [], []
        for dim, count in sorted(set(zip(dims.tolist(), n.tolist()))):
            own = np.flatnonzero((dims == dim) & (n == count))
            lines, many = cell_plan(count)
            d, offset = _directions(dim, lines, many)
            x = _matrix(lists.take(pa.array(own)))
            x /= np.abs(x).max(1)[:, None]
            x /= np.linalg.norm(x, axis=1)[:, None]
            at = np.floor((x @ d) / (distance * CELL / math.sqrt(dim)) + offset).astype(np.int64).view(np.uint64)
            key = g[own][:, None] + mix(np.arange(many, dtype=np.uint64))[None, :]
            with np.errstate(over="ignore"):
                for j in range(lines):
                    key = mix(key * np.uint64(0x9FB21C651E98DF25) + at[:, j::lines])
            rows.append(np.repeat(own, many))
            keys.append(key.reshape(-1))
        return {"k": k.take(pa.array(np.concatenate(rows))), "cell": np.concatenate(keys).view(np.int64)}

    large = attach(placed, sizes.where(F.col("n") > BLOCK), ["g"], 128).select("v", "k", "n", "g")
    held = materialize(map_arrow(large, cells, T.StructType([T.StructField("k", T.LongType()), T.StructField("cell", T.LongType())])), "vec-held")
    leaders = materialize(held.groupBy("cell").agg(F.max("k").alias("b"), F.count("*").alias("n")).where("n > 1"), "vec-leaders")
    pairs = join_counted(held, leaders, ["cell"], held.count(), ["b"]).where("k <> b").groupBy("k", "b").agg(F.count("*").alias("common")).where(F.col("common") >= COMMON)
    edges = materialize(pairs.select(F.col("k").alias("a"), "b"), "vec-edges")
    release(held, leaders)
    return components(edges, "vec-clusters").select(F.col("node").alias("k"), F.col("component").cast("string").alias("c"))


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98) -> DataFrame:
    """(id, n_links, component_id, kept) of every row: links are pairs of one label with at least this cosine.

    Equal vectors of a label are one class with a multiplicity. A label of up to BLOCK classes is one cluster, and no
    linked pair is lost; the vectors of a larger one are clustered by the cells that they share with others, in which a
    pair at exactly the cosine is lost with probability LOSS. Within a cluster the pairs are counted over sorted
    projections, block by block, and the cosine of those that pass is taken in double precision. A meeting of blocks
    returns a row a vector (its links and the root it reaches), never pairs.

    Cases: rows with a null label, or a vector that is null, empty, zero or holds nulls or non-finite numbers, link
    with nothing; vectors of different length never link; repeated rows link with each other; null ids count as
    larger than any id; very large components don't overflow; columns other than the three named are ignored, whatever
    their names; an empty table gives an empty result. Work within a cluster grows with the square of its size, as all
    of its links are counted.
    """
    distance = math.sqrt(2 - 2 * cosine)
    v = F.col("v")
    fine = F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), F.col(f"`{label_col}`").alias("label"))
    rows = materialize(rows.withColumn("k", F.when(fine, F.xxhash64("label", "v"))), "vec-rows")
    classes = rows.where("k is not null").groupBy("k").agg(F.min("i").alias("least"), F.count("*").alias("m"), F.first("label").alias("label"), F.first("v").alias("v"))
    placed = materialize(classes.select("v", "k", "m", "least", F.concat_ws("\x1f", F.col("label").cast("string"), F.size("v").cast("string")).alias("g")), "vec-classes")
    sizes = materialize(placed.groupBy("g").agg(F.count("*").alias("n")), "vec-sizes")
    own = attach(placed.select("k", "g"), sizes.where(F.col("n") <= BLOCK).select("g"), ["g"], 128).select("k", F.concat(F.lit("="), "g").alias("c"))
    own = materialize(own.unionByName(_clusters(placed, sizes, distance)), "vec-clusters")
    blocks = materialize(own.groupBy("c").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "vec-blocks")
    known = materialize(attach(own, blocks, ["c"], 128), "vec-placed")
    blocked = placed.select("v", "k", "m").join(known.hint("merge"), "k").withColumn("b", F.pmod(F.hash("k"), F.col("blocks")))
    # meetings as (left block, right block)
    meetings = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("b", x).alias("lb"), F.greatest("b", x).alias("rb"), (F.col("b") > x).alias("right")))
    sent = blocked.select("c", "k", "m", "v", F.explode(meetings).alias("x")).select("c", "x.*", "k", "m", "v")

    def meet(t: pa.Table) -> pa.Table:
        right = t["right"].to_numpy()
        x, k, m = _matrix(t["v"]), t["k"].to_numpy(), t["m"].to_numpy()
        x = x / np.abs(x).max(1)[:, None]
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        p = unit @ rotation(x.shape[1])
        left = np.flatnonzero(~right)
        same = t["lb"][0] == t["rb"][0]
        other = left if same else np.flatnonzero(right)
        links, a_all, b_all = np.zeros(len(x), np.int64), [], []
        if len(left) and len(other):
            # rows of the left block in strips, so that a block of one large group stays small in memory
            for s in range(0, len(left), 512):
                strip = left[s : s + 512]
                i, j = collisions(p[strip], p[other], distance)
                a, b = strip[i], other[j]
                if same:
                    a, b = a[a < b], b[a < b]
                for c in range(0, len(a), 1 << 17):
                    aa, bb = a[c : c + (1 << 17)], b[c : c + (1 << 17)]
                    dot = np.einsum("ij,ij->i", x[aa], x[bb]) / np.sqrt(np.einsum("ij,ij->i", x[aa], x[aa]) * np.einsum("ij,ij->i", x[bb], x[bb]))
                    good = dot >= cosine
                    a_all.append(aa[good])
                    b_all.append(bb[good])
        a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (a_all, b_all))
        np.add.at(links, a, m[b])
        np.add.at(links, b, m[a])
        root = k[_roots(len(x), a, b)]
        out = np.flatnonzero(links > 0)
        return pa.table({"k": pa.array(k[out]), "links": pa.array(links[out]), "root": pa.array(root[out])})

    found = materialize(sent.groupBy("c", "lb", "rb").applyInArrow(meet, "k long, links long, root long"), "vec-links")
    total = materialize(found.groupBy("k").agg(F.sum("links").alias("links")), "vec-total")
    comps = components(found.where("k <> root").select(F.col("k").alias("a"), F.col("root").alias("b")), "vec").withColumnRenamed("node", "k")
    linked = placed.select("k", "m", "least").join(total, "k", "left").join(comps, "k", "left").withColumn("c", F.coalesce("component", "k"))
    linked = materialize(linked.select("k", "c", "least", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links")), "vec-linked")
    # only classes with links share a component
    least = materialize(linked.where("c <> k or n_links > 0").groupBy("c").agg(F.min("least").alias("component_id")), "vec-least")
    named = materialize(attach(linked, least, ["c"], 64, "left").select("k", "n_links", F.coalesce("component_id", "least").alias("component_id")), "vec-components")
    out = rows.select("i", "k").join(named.hint("merge"), "k", "left")
    own = F.when(F.col("k").isNull(), F.col("i")).otherwise(F.col("component_id"))
    return out.select(F.col("i").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("i").eqNullSafe(own).alias("kept"))


def op6_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.y, r.c FROM r JOIN p ON r.vec_id = p.x),
n AS (SELECT x AS vec_id, count(*) AS n FROM p GROUP BY 1)
SELECT r.vec_id, coalesce(any_value(n.n), 0) AS n_links, min(c) AS component_id, r.vec_id = min(c) AS kept
FROM r LEFT JOIN n ON n.vec_id = r.vec_id GROUP BY r.vec_id
"""
