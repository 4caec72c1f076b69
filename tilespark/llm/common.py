"""Shared plumbing: shared-folder tables, Arrow row mapping and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Java and Python regular expression of one word.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of text that one numpy step handles; a longer single text is one step of its own.
STEP_BYTES = 1 << 19
#: Rows of an Arrow batch that are handled at once, so that what a step makes of them stays small.
STEP_ROWS = 1000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset, a local folder on a local master and an error elsewhere."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tilespark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Lineage is cut by files every executor can read, so a lost executor costs only its running tasks.
    Shuffle files of the writing query are released as soon as it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    try:
        spark.conf.set(_CLEANUP, "true")
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that `materialize` wrote and nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.stored_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def doc_keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """128 bits of id and text: rows equal in both are one document, seen several times. A null text counts as empty."""
    i, t = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return F.xxhash64(i, t), F.xxhash64(t, i, F.lit(1))


#: A key with this share of all counted rows is common: there are at most so many of them, which bounds their broadcast.
COMMON_KEYS = 1000


def join_counted(rows: DataFrame, counts: DataFrame, keys: list[str], total: int, columns: list[str] | None = None) -> DataFrame:
    """rows joined with counts (keys, n, more) of at most `total` rows, with the columns of counts that are named.

    Keys of at least total / COMMON_KEYS rows, COMMON_KEYS at most, are broadcast, so the rows of a very common key stay
    where they are; the others meet in a shuffle in which no key has more than that share.
    """
    columns = columns or []
    common = F.col("n") * COMMON_KEYS >= total
    hot = F.broadcast(counts.where(common & (F.col("n") > 1)).select(*keys, *columns))
    rest = counts.where(~(common & (F.col("n") > 1))).select(*keys, *columns)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(rest.hint("merge"), keys))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def replace_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """df without columns that the operator is about to add (compared as Spark does, without case)."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: T.StructType) -> DataFrame:
    """mapInArrow with a function from a batch to columns of the output schema."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, STEP_ROWS):
                if (out := fn(batch.slice(start, STEP_ROWS))) is not None:
                    yield pa.RecordBatch.from_arrays([out[f.name].cast(f.type) if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def add_columns(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], fields: list[T.StructField], drop: tuple[str, ...] = ()) -> DataFrame:
    """df with new columns computed batch by batch in Arrow; `drop` names input columns to leave out."""
    keep = [f for f in df.schema.fields if f.name not in drop and f.name not in {x.name for x in fields}]
    schema = T.StructType(keep + fields)

    def both(batch: pa.RecordBatch) -> dict:
        return {f.name: batch.column(batch.schema.get_field_index(f.name)) for f in keep} | fn(batch)

    return map_arrow(df, both, schema)


# ---------------------------------------------------------------- word hashing
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2^64, for n positions at least."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, STEP_BYTES + (1 << 18))
        base = int(_BASES[which])
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            have = tuple(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (np.uint64(base), np.uint64(inverse)))
        _powers[which] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of values[start:end] for each range; equal contents give equal hashes wherever they stand."""
    power, inverse = _power_tables(len(values), which)
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * power[: len(values)], out=prefix[1:])
        out = (prefix[ends] - prefix[starts]) * inverse[starts]
        return mix(out + mix((ends - starts).astype(np.uint64) + np.uint64(which)))


def word_bounds(data: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) byte offsets of the words, and each text's first word number (one more entry than texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(doc_ends) + 1, np.int64)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cuts = doc_ends[(doc_ends < len(data)) & (doc_ends > 0)]
    first[cuts] = solid[cuts]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[cuts - 1] = solid[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.concatenate([np.zeros(1, np.int64), np.searchsorted(starts, doc_ends)])


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def text_steps(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces of a string column of about STEP_BYTES: (first row, row after the last, bytes, end offset of each text). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row, n = 0, len(column)
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + STEP_BYTES, side="right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], (offsets[row + 1 : end + 1] - offsets[row])
        row = end


def words_of(data: np.ndarray, ends: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, and each text's first word number."""
    starts, stops, first = word_bounds(data, ends)
    return range_hashes(data.astype(np.uint64) + np.uint64(1), starts, stops, which), first


#: Bytes up to which a counted table is broadcast.
SMALL = 16 << 20


def is_small(table: DataFrame, row_bytes: int) -> bool:
    """Whether a table of rows of so many bytes at most may be broadcast: its rows are counted."""
    return table.count() * row_bytes <= SMALL


def attach(rows: DataFrame, known: DataFrame, keys: list[str], row_bytes: int, how: str = "inner") -> DataFrame:
    """rows joined with a stored table of one row a key: broadcast if it is small, else by a shuffle, of whose partitions
    Spark splits those that a very common key makes large, as both sides are dealt anew for it."""
    return rows.join(F.broadcast(known) if is_small(known, row_bytes) else known.hint("merge"), keys, how)


def components(edges: DataFrame, tag: str) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), the smallest node of each.

    Rounds of hooking: every node sends the least label it sees to its neighbours and to its own label, then
    labels jump. Every aggregate is a minimum, so a node with very many links is combined before the shuffle. Labels
    are broadcast while they are few; beyond that, joins count their keys first, so that such a node isn't brought
    together in one task either.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialize(both, f"{tag}-edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"), F.count("*").alias("n"))
    labels = materialize(labels.select("node", "n", F.least("node", "m").alias("label"), F.col("node").alias("old")), f"{tag}-labels")
    small = is_small(labels, 64)
    total, nodes = (0, 0) if small else (both.count(), labels.count())
    none = F.lit(None).cast("long")
    while not labels.where("label <> old").isEmpty():
        known = labels.select(F.col("node").alias("b"), "n", "label")
        seen = both.join(F.broadcast(known.drop("n")), "b") if small else join_counted(both, known, ["b"], total, ["label"])
        seen = seen.select(F.col("a").alias("node"), "label", none.alias("own"), none.alias("n")).union(labels.select("node", "label", F.col("label").alias("own"), "n"))
        near = seen.groupBy("node").agg(F.min("label").alias("least"), F.max("own").alias("own"), F.max("n").alias("n"))
        # what a node sees is also told to the node that its label names
        told = F.explode(F.array(F.struct("node", "least", "own", "n"), F.struct(F.col("own").alias("node"), "least", none.alias("own"), none.alias("n")))).alias("x")
        merged = near.select(told).select("x.*").groupBy("node").agg(F.min("least").alias("label"), F.max("own").alias("old"), F.max("n").alias("n"))
        merged = materialize(merged, f"{tag}-merged")
        up = merged.select(F.col("node").alias("label"), F.col("label").alias("up"))
        if small:
            jumped = merged.join(F.broadcast(up), "label")
        else:
            jumped = join_counted(merged.withColumnRenamed("n", "links"), merged.groupBy("label").agg(F.count("*").alias("n")).join(up, "label"), ["label"], nodes, ["up"]).withColumnRenamed("links", "n")
        new = materialize(jumped.select("node", "n", F.least("label", "up").alias("label"), "old"), f"{tag}-labels")
        release(labels, merged)
        labels = new
    return labels.select("node", F.col("label").alias("component"))


# ---------------------------------------------------------------- word shingles
_STEP = np.uint64(0x9FB21C651E98DF25)


def shingle_sets(column: pa.Array, size: int, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Sorted sets of the hashed word shingles of texts, piece by piece: (first row, row after the last, values, first value of each row and the end).

    A text of fewer words has its whole sequence as one shingle, one without words has none.
    """
    for row, end, data, ends in text_steps(column):
        h, first = words_of(lower_ascii(data) if lower else data, ends)
        n = np.diff(first)
        parts, counts = [], np.zeros(end - row, np.int64)
        with np.errstate(over="ignore"):
            full = h
            for j in range(1, size):
                full = mix(full[:-1] * _STEP + h[j:]) if len(full) > 1 else full[:0]
            for i in np.flatnonzero(n):
                a, words = int(first[i]), int(n[i])
                if words >= size:
                    own = np.unique(full[a : a + words - size + 1])
                else:
                    one = h[a : a + 1]
                    for j in range(1, words):
                        one = mix(one * _STEP + h[a + j : a + j + 1])
                    own = mix(one + np.uint64(words))
                parts.append(own)
                counts[i] = len(own)
        yield row, end, np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])
