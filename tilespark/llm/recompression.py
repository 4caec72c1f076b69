"""Operator 4: long repeated word sequences by recompression: rounds that name runs and pairs of symbols everywhere alike."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, doc_keys, free_name, join_counted, map_arrow, materialize, mix, range_hashes, release, replace_columns, table, text_steps, words_of

#: Partitions of the alphabet that a round applies at once; a boundary outlasts a round with probability (3/4)^7.
PARTITIONS = 7
#: Symbols of the first round with fewer words are too common to tell windows apart.
LEAST_SYMBOL = 3
_MASK = np.uint64((1 << PARTITIONS) - 1)


def compress(names: np.ndarray, first: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round over the symbols of several texts: (first symbol of every new symbol, new names, first new symbol of every text).

    Adjacent symbols join if they are equal (a run) or if one of the round's partitions of the alphabet has the first
    on its left and the second on its right side (a pair). Whether they join depends on the two alone, so equal
    sequences are named equally but for the symbols at their ends. A name is a fingerprint of what it stands for:
    all tasks give the same names without exchanging them.
    """
    if not len(names):
        return np.zeros(0, np.int64), names, np.zeros(len(first), np.int64)
    side = mix(names + np.uint64(0x51ED270B * (turn + 1)))
    join = (names[1:] == names[:-1]) | ((~side[:-1] & side[1:] & _MASK) != 0)
    keep = np.concatenate([[True], ~join])
    keep[first[:-1][first[:-1] < len(names)]] = True
    at = np.flatnonzero(keep)
    ends = np.append(at[1:], len(names))
    return at, range_hashes(names, at, ends, turn & 1), np.searchsorted(at, first)


class Parse:
    """Words of several texts and their symbols after one and after two rounds."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, window: int):
        self.window = window
        self.words, self.first = words_of(data, ends, 0)
        self.other, _ = words_of(data, ends, 1)
        self.at1, self.name1, self.first1 = compress(self.words, self.first, 0)
        at2, _, self.first2 = compress(self.name1, self.first1, 1)
        self.at2 = self.at1[at2] if len(at2) else at2

    def symbols(self, doc: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, name) of the first round's symbols of a text, word numbers within it."""
        a, b = self.first1[doc], self.first1[doc + 1]
        start = self.at1[a:b] - self.first[doc]
        return start, np.append(start[1:], self.first[doc + 1] - self.first[doc]), self.name1[a:b]

    def known(self, start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
        """Symbols that their own words and one word on either side determine, within a window's reach."""
        return (start > 0) & (end < n) & (end - start >= LEAST_SYMBOL) & (end - start + 2 <= self.window)

    def units(self, doc: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end of the starts, end): symbols of the second round with what the windows that start in them reach."""
        a, b = self.first2[doc], self.first2[doc + 1]
        n = self.first[doc + 1] - self.first[doc]
        start = self.at2[a:b] - self.first[doc]
        stop = np.append(start[1:], n)
        # up to the end of the symbol that holds the last word of the last window
        last = np.minimum(np.searchsorted(stop, stop + self.window - 1, "left"), len(stop) - 1) if len(stop) else stop
        return start, stop, stop[last] if len(stop) else stop

    def fingerprint(self, doc: int, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = self.first[doc]
        return range_hashes_within(self.words, base, self.first[doc + 1], start, end, 0), range_hashes_within(self.other, base, self.first[doc + 1], start, end, 1)


def range_hashes_within(values: np.ndarray, a: int, b: int, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    return range_hashes(values[a:b], start, end, which)


def _occurrences(docs: DataFrame, window: int) -> DataFrame:
    """(k1, k2, a, b, x): symbols of the first round (x even) and units of the second (x odd) of all texts."""

    def parse(batch: pa.RecordBatch) -> dict:
        row_of, a_all, b_all, x_all = [], [], [], []
        for row, end, data, ends in text_steps(batch.column(2)):
            p = Parse(data, ends, window)
            for doc in range(end - row):
                n = int(p.first[doc + 1] - p.first[doc])
                if n < window:
                    continue
                start, stop, name = p.symbols(doc)
                own = np.flatnonzero(p.known(start, stop, n))
                us, _, ue = p.units(doc)
                long = np.flatnonzero(ue - us >= window)
                ua, ub = p.fingerprint(doc, us[long], ue[long])
                row_of.append(np.full(len(own) + len(long), row + doc))
                a_all += [name[own], ua]
                b_all += [np.zeros(len(own), np.uint64), ub]
                x_all += [own * 2, long * 2 + 1]
        if not row_of:
            return None
        take = pa.array(np.concatenate(row_of))
        return {"k1": batch.column(0).take(take), "k2": batch.column(1).take(take), "a": np.concatenate(a_all).view(np.int64), "b": np.concatenate(b_all).view(np.int64), "x": np.concatenate(x_all).astype(np.int32)}

    fields = [T.StructField(c, T.LongType()) for c in ("k1", "k2", "a", "b")] + [T.StructField("x", T.IntegerType())]
    return map_arrow(docs, parse, T.StructType(fields))


def _candidates(docs: DataFrame, window: int) -> DataFrame:
    """(k1, k2, sure, p, w1, w2): of each document the window starts that its units prove repeated, as flat intervals,
    and the windows to compare: their starts and 128-bit fingerprints.

    A unit that occurs again proves its windows; only its first occurrence lends them to the comparison. Of other
    windows only those are compared in which every symbol that the window determines occurs again.
    """

    def look(batch: pa.RecordBatch) -> dict:
        flags = batch.column(3)
        sure, at, w1, w2 = [[] for _ in range(batch.num_rows)], [], [], []
        lengths = np.zeros(batch.num_rows, np.int64)
        for row, end, data, ends in text_steps(batch.column(2)):
            p = Parse(data, ends, window)
            for doc in range(end - row):
                n = int(p.first[doc + 1] - p.first[doc])
                if n < window:
                    continue
                mark = np.array(flags[row + doc].as_py() or [], np.int64)
                start, stop, _ = p.symbols(doc)
                lone = p.known(start, stop, n)
                lone[mark[mark % 4 == 0] // 4] = False
                # a symbol that occurs once rules out all windows that hold it and the words beside it
                ruled = np.zeros(n + 2, np.int64)
                low, high = np.maximum(stop[lone] + 1 - window, 0), start[lone] - 1
                np.add.at(ruled, low[low <= high], 1)
                np.add.at(ruled, high[low <= high] + 1, -1)
                wanted = np.cumsum(ruled)[: n - window + 1] == 0
                us, ue, _ = p.units(doc)
                for m in mark[mark % 2 == 1].tolist():
                    u, leads = m // 4, bool(m & 2)
                    a, b = int(us[u]), min(int(ue[u]), n - window + 1)
                    if a < b:
                        sure[row + doc] += [a, b]
                        wanted[a:b] = leads
                own = np.flatnonzero(wanted)
                lengths[row + doc] = len(own)
                x, y = p.fingerprint(doc, own, own + window)
                at.append(own)
                w1.append(x)
                w2.append(y)
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
        join = lambda z, t: np.concatenate(z) if z else np.zeros(0, t)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (join(at, np.int64).astype(np.int32), join(w1, np.uint64).view(np.int64), join(w2, np.uint64).view(np.int64))]
        return {"k1": batch.column(0), "k2": batch.column(1), "sure": pa.array(sure, pa.list_(pa.int32())), "p": lists[0], "w1": lists[1], "w2": lists[2]}

    whole = T.ArrayType(T.IntegerType())
    fields = [T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("sure", whole), T.StructField("p", whole), T.StructField("w1", T.ArrayType(T.LongType())), T.StructField("w2", T.ArrayType(T.LongType()))]
    return map_arrow(docs, look, T.StructType(fields))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """docs with kept_words (joined by one space), n_words and n_removed: words in windows that start elsewhere too are gone.

    Method: two rounds of recompression give every text symbols of about 7 and of about 56 words. Spark counts the
    names; second-round units that occur again prove their windows repeated, so copies of long passages need one
    representative only. Windows left over are compared by 128-bit fingerprints where all symbols in them occur
    again. Counts are combined before each shuffle, and names and windows that very many texts share stay where they
    are while their counts are broadcast, so a passage in very many documents never comes together in one task.

    Cases: a null or empty text has no words; texts of fewer words than the window stay whole; rows equal in id and
    text count as two documents (each removes the other's windows); an empty table gives an empty result; other
    columns stay, and those named like the added ones are replaced.
    """
    docs = replace_columns(docs, ["kept_words", "n_words", "n_removed"])
    k1, k2 = doc_keys(id_col, text_col)
    texts = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(f"`{text_col}`").alias("text"))
    names = materialize(_occurrences(texts, window), "repeats-names")
    often = names.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.when(F.col("x") % 2 == 1, F.struct("k1", "k2", "x"))).alias("lead")).where("n > 1").select("a", "b", "n", F.col("lead.k1").alias("l1"), F.col("lead.k2").alias("l2"), F.col("lead.x").alias("lx"))
    often = materialize(often, "repeats-often")
    # 4 * number, + 1 for a unit, + 2 for a unit's first occurrence
    leads = F.coalesce((F.col("k1") == F.col("l1")) & (F.col("k2") == F.col("l2")) & (F.col("x") == F.col("lx")), F.lit(False))
    flag = (F.shiftright("x", 1) * 4 + F.col("x") % 2 + F.when(leads, 2).otherwise(0)).alias("flag")
    flags = join_counted(names, often, ["a", "b"], names.count(), ["l1", "l2", "lx"]).select("k1", "k2", flag).groupBy("k1", "k2").agg(F.collect_set("flag").alias("flags"))
    flags = materialize(flags, "repeats-flags")
    release(names, often)
    looked = materialize(_candidates(texts.join(flags.hint("merge"), ["k1", "k2"], "left"), window), "repeats-windows")
    windows = looked.where(F.size("p") > 0).select("k1", "k2", F.explode(F.arrays_zip("p", "w1", "w2")).alias("w")).select("k1", "k2", "w.*")
    twice = materialize(windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1"), "repeats-twice")
    found = join_counted(windows, twice, ["w1", "w2"], twice.agg(F.sum("n")).first()[0] or 0).select("k1", "k2", F.col("p").alias("a"), (F.col("p") + 1).alias("b"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("sure") - 2, F.lit(2)), lambda i: F.struct(F.get(F.col("sure"), i).alias("a"), F.get(F.col("sure"), i + 1).alias("b")))
    proved = looked.where(F.size("sure") > 0).select("k1", "k2", F.explode(pairs).alias("s")).select("k1", "k2", "s.*")
    c1, c2, cover = (free_name(docs, f"repeats_{x}") for x in ("k1", "k2", "cover"))
    covers = found.union(proved).groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias(cover))
    covers = materialize(covers.select(F.col("k1").alias(c1), F.col("k2").alias(c2), F.col(f"{cover}.a").alias(f"{cover}_a"), F.col(f"{cover}.b").alias(f"{cover}_b")), "repeats-cover")

    def cut(batch: pa.RecordBatch) -> dict:
        column = lambda c: batch.column(batch.schema.get_field_index(c))
        kept, n_words, n_removed = [], [], []
        for text, a, b in zip(column(text_col).cast(pa.large_binary()), column(f"{cover}_a"), column(f"{cover}_b")):
            words = (text.as_py() or b"").split()
            n_words.append(len(words))
            if a.is_valid:
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, a.values.to_numpy(), 1)
                np.add.at(gone, b.values.to_numpy() + window - 1, -1)
                stay = np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()
                words = [words[i] for i in stay]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words).decode())
        return {"kept_words": pa.array(kept, pa.string()), "n_words": n_words, "n_removed": n_removed}

    keyed = docs.withColumns({c1: k1, c2: k2}).join(covers.hint("merge"), [c1, c2], "left")
    added = [T.StructField("kept_words", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    return add_columns(keyed, cut, added, drop=(c1, c2, f"{cover}_a", f"{cover}_b"))


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op4_recompression(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_words").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT rid, unnest(range(1, len(ws) - 33)) AS p, unnest(list_transform(range(1, len(ws) - 33), lambda i: md5(array_to_string(ws[i:i + 34], ' ')))) AS h FROM w WHERE len(ws) >= 35),
r AS (SELECT h FROM p GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT rid, unnest(range(p, p + 35)) AS i FROM p SEMI JOIN r USING (h)),
k AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
s AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM k ANTI JOIN c USING (rid, i) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN s USING (rid)
"""
