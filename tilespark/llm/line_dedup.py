"""Operator 8: lines that many documents share are dropped everywhere, with two Bloom filters as a sieve."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, doc_keys, free_name, join_counted, map_arrow, materialize, release, replace_columns, table

#: Lines that one pair of filters is made for, its bits a line and its hash functions.
SHARD_LINES, BITS, PROBES = 500_000, 16, 4
BLANK = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes | None) -> list[bytes]:
    """One key a line: blanks stripped at both ends, A-Z lower-cased."""
    return [x.strip(BLANK).lower() for x in (text or b"").split(b"\n")]


class Bloom:
    """A Bloom filter for 64-bit hashes. One that holds what it was made for gets another beside it, so it never fills up."""

    def __init__(self, lines: int):
        self.lines, self.parts, self.room = lines, [], 0

    def _places(self, h: np.ndarray) -> list[np.ndarray]:
        """Places of the bits of each hash, by double hashing."""
        with np.errstate(over="ignore"):
            step = (h >> np.uint64(32)) | np.uint64(1)
            return [((h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i) * step * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(16)) % np.uint64(self.lines * BITS) for i in range(PROBES)]

    def has(self, h: np.ndarray) -> np.ndarray:
        out, places = np.zeros(len(h), bool), self._places(h) if self.parts else []
        for part in self.parts:
            own = np.ones(len(h), bool)
            for p in places:
                own &= (part[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0
            out |= own
        return out

    def put(self, h: np.ndarray) -> None:
        if not len(h):
            return
        if self.room < len(h):
            self.parts.append(np.zeros(self.lines * BITS // 8 + 1, np.uint8))
            self.room = max(self.lines, len(h))
        self.room -= len(h)
        for p in self._places(h):
            np.bitwise_or.at(self.parts[-1], p >> np.uint64(3), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))


FOUND = T.StructType([T.StructField(c, T.LongType()) for c in ("k1", "k2", "d1", "d2")] + [T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("seen", T.IntegerType())])


def _occurrences(docs: DataFrame, id_col: str, text_col: str, min_length: int) -> DataFrame:
    """(k1, k2, d1, d2, at, seen): 128 bits of each line key of each document, 128 bits of the document, line numbers.

    seen: 0 if no other document of the step holds the line, else 1 for the first of them and 2 for the others.
    """

    def lines(batch: pa.RecordBatch) -> dict:
        rows, keys, at, seen = [], [], [], []
        met: dict[bytes, int] = {}
        for row, text in enumerate(batch.column(2).cast(pa.large_binary()).to_pylist()):
            own: dict[bytes, list[int]] = {}
            for number, k in enumerate(line_keys(text)):
                if len(k) >= min_length and (min_length < 2 or len(k.decode()) >= min_length):
                    own.setdefault(k, []).append(number)
            for k, numbers in own.items():
                digest = xxhash.xxh3_128_digest(k)
                if digest in met:
                    if met[digest] >= 0:
                        seen[met[digest]], met[digest] = 1, -1
                    seen.append(2)
                else:
                    met[digest] = len(seen)
                    seen.append(0)
                rows.append(row)
                keys.append(digest)
                at.append(numbers)
        both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
        take = pa.array(rows, pa.int64())
        return {"k1": both[:, 0], "k2": both[:, 1], "d1": batch.column(0).take(take), "d2": batch.column(1).take(take), "at": at, "seen": seen}

    d1, d2 = doc_keys(id_col, text_col)
    return map_arrow(docs.select(d1.alias("d1"), d2.alias("d2"), F.col(f"`{text_col}`").alias("t")), lines, FOUND)


def _suspected(dealt: DataFrame, parts: int) -> DataFrame:
    """The rows whose line the twice-seen filter of their partition suspects: of (k1, k2, d1, d2, at, seen), dealt by line.

    All rows of a line meet in one task, which reads them once: a line that the once-seen filter holds goes into the
    twice-seen one. Rows seen before or again pass at once; the first ones wait until all rows have been read, and so
    a task keeps no more than one row a line.
    """
    lines = SHARD_LINES

    def sieve(batches):
        once, twice, waiting = Bloom(lines), Bloom(lines), []
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            again = batch.column(5).to_numpy() > 0
            distinct, back, n = np.unique(h, return_inverse=True, return_counts=True)
            more = (n > 1) | once.has(distinct)
            more |= np.bincount(back, again, len(distinct)) > 0
            once.put(distinct[~more])
            twice.put(distinct[more])
            passed = twice.has(h)
            yield batch.filter(pa.array(passed))
            if not passed.all():
                waiting.append(batch.filter(pa.array(~passed)))
        for batch in waiting:
            yield batch.filter(pa.array(twice.has(batch.column(0).to_numpy().view(np.uint64))))

    return dealt.repartition(parts, "k1").mapInArrow(sieve, FOUND)


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_length: int = 1) -> DataFrame:
    """docs with kept_text, n_lines and n_dropped: lines whose key at least min_docs rows hold are gone everywhere.

    Method: hashes of lines are dealt, at most once a line and step of a thousand documents, to tasks that each hold a
    once-seen and a twice-seen Bloom filter of bounded size, about SHARD_LINES hashes a task. Only lines that the
    twice-seen filter suspects, and those that one step met in two documents, go on to the exact count of documents by
    128-bit keys. Filters stay in their task, whatever the size of the input. A very common line is counted before the
    shuffle, and its rows are not brought together.

    Cases: a null or empty text is one empty line, of no key when min_length >= 1, and gives kept_text ''. Each row
    counts as a document, repeated rows and null ids too; rows equal in id and text get equal results. An empty
    table gives an empty result. Input columns named like the three added ones are replaced.
    """
    docs = replace_columns(docs, ["kept_text", "n_lines", "n_dropped"])
    every = materialize(_occurrences(docs, id_col, text_col, min_length), "lines-seen")
    dealt, direct = every.where("seen < 2"), every.where("seen = 2")
    parts = max(1, -(-dealt.count() // SHARD_LINES))
    found = materialize(_suspected(dealt, parts).unionByName(direct).drop("seen"), "lines-suspected")
    release(every)
    common = materialize(found.groupBy("k1", "k2").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs), "lines-common")
    d1, d2, at = (free_name(docs, f"line_dedup_{x}") for x in ("d1", "d2", "at"))
    rows = common.agg(F.sum("n")).first()[0] or 0
    gone = join_counted(found, common, ["k1", "k2"], rows).groupBy(F.col("d1").alias(d1), F.col("d2").alias(d2)).agg(F.flatten(F.collect_set("at")).alias(at))
    gone = materialize(gone, "lines-gone")
    release(found, common)
    keys = doc_keys(id_col, text_col)
    with_keys = docs.withColumns({d1: keys[0], d2: keys[1]})

    def cut(batch: pa.RecordBatch) -> dict:
        texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.large_binary()).to_pylist()
        drops = batch.column(batch.schema.get_field_index(at)).to_pylist()
        kept, n_lines, n_dropped = [], [], []
        for text, drop in zip(texts, drops):
            parts = (text or b"").split(b"\n")
            out = set(drop or ())
            kept.append(b"\n".join(x for j, x in enumerate(parts) if j not in out).decode())
            n_lines.append(len(parts))
            n_dropped.append(len(out))
        return {"kept_text": pa.array(kept, pa.string()), "n_lines": n_lines, "n_dropped": n_dropped}

    added = [T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    return add_columns(with_keys.join(gone.hint("merge"), [d1, d2], "left"), cut, added, drop=(d1, d2, at))


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (SELECT doc_id, rid, u.x AS line, u.o AS ord, lower_key FROM (
       SELECT doc_id, rid, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS o
       FROM (SELECT *, row_number() OVER () AS rid FROM documents)) u,
     LATERAL (SELECT translate(regexp_replace(regexp_replace(u.x, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key)),
k AS (SELECT lower_key FROM l WHERE length(lower_key) >= 1 GROUP BY 1 HAVING count(DISTINCT rid) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE k.lower_key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY ord) FILTER (WHERE k.lower_key IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN k USING (lower_key) GROUP BY rid, doc_id
"""
