"""Operator 1: a quality classifier of zstandard dictionaries built from good and bad labelled text."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, map_arrow, materialize, replace_columns, table

#: Pieces of labelled lines of a class, and labelled rows of a class, that are learned from at most: the bound of the sample.
SAMPLE_LINES, SAMPLE_ROWS = 20_000, 3_000
#: Bytes of a line piece in the sample, of a dictionary, of a piece that is compressed at once; the level.
LINE_BYTES, DICT_BYTES, PIECE_BYTES, LEVEL = 512, 65_536, 2_048, 3
#: Documents with this score or more are predicted good.
THRESHOLD = 0.3
#: Added to the difference and to the length that it is normalised by: a text too short to tell anything scores as good
#: as one with a small difference, and one that both dictionaries compress to next to nothing doesn't.
PRIOR, PRIOR_LENGTH = 2.0, 40.0
_NEAR = 1e-6


@dataclass(frozen=True)
class Model:
    """Two dictionaries, and the calibration of the difference that they make: likelihood = logistic(weight * d + level)."""

    good: bytes
    bad: bytes
    weight: float
    level: float


class Measure:
    """The normalised difference of a text's compressed sizes with the bad and with the good dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        def make(d: bytes):
            own = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO) if d else None
            if own:
                own.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.good, self.bad = make(good), make(bad)

    def __call__(self, text: bytes) -> float:
        pieces = [text[i : i + PIECE_BYTES] for i in range(0, len(text), PIECE_BYTES)]
        gain = sum(len(self.bad.compress(p)) - len(self.good.compress(p)) for p in pieces)
        return (gain + PRIOR) / (len(text) + PRIOR_LENGTH)


def likelihood(d: np.ndarray, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(d * model.weight + model.level, -30, 30)))


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * len(x) / 100)
    penalty[-1] = _NEAR
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + _NEAR)
        step = np.linalg.solve(h, x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(id_col: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _dictionary(lines: list[bytes]) -> bytes:
    if sum(map(len, lines)) < 2048:
        return b"".join(lines)
    try:
        return zstandard.train_dictionary(DICT_BYTES, lines, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few distinct samples to train on: the raw text itself
        return b"".join(lines)[-DICT_BYTES:]


def line_pieces(batch: pa.RecordBatch) -> dict:
    """All lines of the texts in pieces of LINE_BYTES bytes, the last one shorter; characters stay whole."""
    out = set()
    for t in batch.column(0).to_pylist():
        for line in filter(None, t.split("\n")):
            data, at = line.encode(), 0
            while at < len(data):
                end = min(at + LINE_BYTES, len(data))
                while end < len(data) and data[end] & 0xC0 == 0x80:
                    end -= 1
                out.add(data[at:end].decode())
                at = end
    return {"line": sorted(out)}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from a bounded sample of the labelled rows that aren't held out.

    Labelled ids are chosen by hash first, 2 * SAMPLE_ROWS of each class, so documents are only scanned.
    Dictionaries: of each class the SAMPLE_LINES pieces of least hash, of lines in pieces of LINE_BYTES, without pieces
    that both classes hold. Calibration: logistic regression over the normalised difference of the SAMPLE_ROWS rows of
    least hash of each class, whole texts, with the classes weighing as in all labelled rows; only the differences reach
    the driver. An id with both labels counts as bad; null labels and ids without a text teach nothing.
    """
    named = labels.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{label_col}`").alias("y")).where("y in (0, 1)").where(~held_out(F.col("i"))).groupBy("i").agg(F.min("y").alias("y"))
    share = {r.y: r.n for r in named.groupBy("y").agg(F.count("*").alias("n")).collect()}
    # ids of least hash, twice the bound as some may have no text: few enough to broadcast whatever the table's size
    picked = [named.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(2 * SAMPLE_ROWS) for y in (0, 1)]
    chosen = materialize(picked[0].unionByName(picked[1]), "quality-labels")
    known = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")).where("t is not null")
    sample = materialize(known.join(F.broadcast(chosen), "i").withColumn("h", F.xxhash64("i", "t")), "quality-sample")
    rows: dict[int, list] = {}
    for y in (0, 1):
        lines = map_arrow(sample.where(F.col("y") == y).select("t"), line_pieces, T.StructType([T.StructField("line", T.StringType())])).distinct()
        rows[y] = [r.line.encode() for r in lines.orderBy(F.xxhash64("line"), "line").limit(SAMPLE_LINES).collect()]
    both = set(rows[0]) & set(rows[1])
    good, bad = (_dictionary([x for x in rows[y] if x not in both]) for y in (1, 0))
    fields = T.StructType([T.StructField("d", T.DoubleType()), T.StructField("y", T.DoubleType())])

    def measure(batch: pa.RecordBatch) -> dict:
        m = Measure(good, bad)
        return {"d": [m(t) for t in batch.column(0).cast(pa.large_binary()).to_pylist()], "y": batch.column(1).to_numpy().astype(float)}

    seen = []
    for y in (0, 1):
        own = sample.where(F.col("y") == y).orderBy("h", "i").limit(SAMPLE_ROWS).select("t", "y")
        seen += map_arrow(own, measure, fields).collect()
    return calibrate(good, bad, np.array([r.d for r in seen]), np.array([r.y for r in seen]), share)


def calibrate(good: bytes, bad: bytes, d: np.ndarray, y: np.ndarray, share: dict) -> Model:
    """The model of dictionaries, of differences d with labels y, and of the number of all labelled rows of each label."""
    if len(set(y.tolist())) < 2:  # one class or none: nothing to tell apart
        return Model(good, bad, 0.0, 4.0 if len(y) == 0 or y[0] == 1 else -4.0)
    center, scale = d.mean(), d.std() + _NEAR
    w, level = _fit_logistic(((d - center) / scale)[:, None], y)
    # the classes were sampled apart; shift the intercept to the share that they have among all labelled rows
    level += math.log(share[1] / share[0]) - math.log((y == 1).sum() / (y == 0).sum())
    return Model(good, bad, float(w / scale), float(level - w * center / scale))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with score, 0 to 1: likelihood of label 1, from the whole text alone.

    Cases: null and empty texts get the score of the empty text; an empty table gives an empty result; other columns
    stay; an input column named `score` is replaced. Equal texts get equal scores.
    """
    docs = replace_columns(docs, ["score"])
    model = docs.sparkSession.sparkContext.broadcast(model)
    measures: list[Measure] = []

    def scored(batch: pa.RecordBatch) -> dict:
        m = model.value
        if not measures:
            measures.append(Measure(m.good, m.bad))
        texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.large_binary())
        return {"score": likelihood(np.array([measures[0](t.as_py() or b"") for t in texts]), m)}

    return add_columns(docs, scored, [T.StructField("score", T.DoubleType())])


def op1_quality_compression(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
