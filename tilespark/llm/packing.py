"""Operator 5: bounded-space online packing of token sequences."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import STEP_BYTES, materialize, table

#: Open windows of a partition, partitions whose leftovers one task merges, gaps that are left as padding.
OPEN, FAN_IN, LEAST_CUT = 8, 16, 8
#: Chunks of text whose ids a worker remembers at most, and characters of the longest of them: a bound in bytes.
MEMORY, LONGEST = 400_000, 64

PIECE = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, at int, open int"


class Packer:
    """Windows of `limit` ids. A piece goes where it leaves the least room; when none has room, the fullest window is
    filled up with a cut of the piece (unless its gap is tiny) and emitted."""

    def __init__(self, limit: int, first_id: int, keep_ids: bool):
        self.limit, self.next_id, self.keep_ids = limit, first_id, keep_ids
        self.windows: list[list] = []  # [used, [(doc_id, start, ids bytes, doc_tokens)]]
        self.done: list[tuple] = []

    def emit(self, window: list) -> None:
        offset = 0
        for doc_id, start, ids, total in window[1]:
            n = len(ids) // 4
            self.done.append((doc_id, start, n, zlib.crc32(ids), total, self.next_id, offset, ids if self.keep_ids else None, None, None))
            offset += n
        self.next_id += 1

    def add(self, doc_id, start: int, ids: bytes, total: int) -> None:
        while True:
            n = len(ids) // 4
            if n >= self.limit:  # a full sequence of its own
                self.emit([self.limit, [(doc_id, start, ids[: 4 * self.limit], total)]])
                ids, start = ids[4 * self.limit :], start + self.limit
                if not ids:
                    return
                continue
            fits = [w for w in self.windows if w[0] + n <= self.limit]
            if fits:
                best = max(fits, key=lambda w: w[0])
                best[0] += n
                best[1].append((doc_id, start, ids, total))
                if best[0] == self.limit:
                    self.windows.remove(best)
                    self.emit(best)
                return
            if len(self.windows) < OPEN:
                self.windows.append([n, [(doc_id, start, ids, total)]])
                return
            fullest = max(self.windows, key=lambda w: w[0])
            self.windows.remove(fullest)
            gap = self.limit - fullest[0]
            if gap >= LEAST_CUT:
                fullest[1].append((doc_id, start, ids[: 4 * gap], total))
                ids, start = ids[4 * gap :], start + gap
            self.emit(fullest)

    def finish(self) -> None:
        """Empty all windows: full sequences, and the rest as sequences of powers of two."""
        rest = [p for w in self.windows for p in w[1]]
        self.windows = []
        left = sum(len(p[2]) // 4 for p in rest)
        while left:
            room = self.limit if left >= self.limit else 1 << (left.bit_length() - 1)
            left -= room
            window: list = [room, []]
            while room:
                doc_id, start, ids, total = rest.pop(0)
                n = min(room, len(ids) // 4)
                window[1].append((doc_id, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    rest.insert(0, (doc_id, start + n, ids[4 * n :], total))
                room -= n
            self.emit(window)

    def leftovers(self, at: int) -> list[tuple]:
        return [(d, start, len(ids) // 4, None, total, None, None, ids, at, i) for i, w in enumerate(self.windows) for d, start, ids, total in w[1]]

    def flush(self) -> list[tuple]:
        out, self.done = self.done, []
        return out


class Encoder:
    """Ids of a whole text by a public tokenizer file (BPE with word ends; white space ends a token and is dropped).

    Chunks between blanks and line feeds are encoded one by one and remembered. New chunks of Latin letters and signs
    are encoded together by merge ranks, which for this kind of vocabulary give the ids of the merge list; any other
    chunk, and any that may hold a special token, goes through the tokenizer itself.
    """

    END, LINE = "\0", "\n"

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.memory = Tokenizer.from_file(path), {}
        model = json.loads(self.tokenizer.to_str())
        # the byte-level alphabet: printable Latin-1 stands for itself, other bytes for code points from 256 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        special = {t["content"] for t in model["added_tokens"]}
        suffix = model["model"]["end_of_word_suffix"]
        ranks = {}
        for token, i in model["model"]["vocab"].items():
            if token not in special:
                end = token.endswith(suffix) and token != suffix
                ranks[bytes(byte_of[c] for c in (token[: -len(suffix)] if end else token)) + self.END.encode() * end] = i
        self.line = ranks[self.LINE.encode()]
        ranks[self.END.encode()] = 1 + max(ranks.values())
        self.ranked = tiktoken.Encoding("words", pat_str=r"[^\x00\n]+\x00|\n", mergeable_ranks=ranks, special_tokens={})
        self.words = regex.compile(model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.other = regex.compile(r"[^\x21-\x7e\xa1-\u024f]|<\|")

    def encoded(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of each chunk."""
        out: dict[str, bytes] = {}
        joined = self.LINE.join(chunks)
        if self.other.search(joined.replace(self.LINE, "")):
            odd = [c for c in chunks if self.other.search(c)]
            for c, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)):
                out[c] = np.array(e.ids, "<u4").tobytes()
            chunks = [c for c in chunks if c not in out]
            joined = self.LINE.join(chunks)
        if not chunks:
            return out
        ids = np.asarray(self.ranked.encode_to_numpy(self.words.sub(rf"\g<0>{self.END}", joined.lower()))).astype("<u4")
        cuts = np.concatenate([[-1], np.flatnonzero(ids == self.line), [len(ids)]]) * 4
        packed = ids.tobytes()
        for c, a, b in zip(chunks, cuts[:-1].tolist(), cuts[1:].tolist()):
            out[c] = packed[a + 4 : b]
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        parts = [t.replace("\n", " ").split(" ") for t in texts]
        every = set().union(*parts)
        new = [c for c in every if c not in self.memory]
        if len(self.memory) + len(new) > MEMORY:
            self.memory, new = {}, list(every)
        got = self.encoded(new)
        # long chunks serve this call only
        self.memory |= {c: ids for c, ids in got.items() if len(c) <= LONGEST}
        long = {c: ids for c, ids in got.items() if len(c) > LONGEST}
        get = lambda c: long[c] if len(c) > LONGEST else self.memory[c]
        return [b"".join(map(get, p)) for p in parts]


_encoders: dict[str, Encoder] = {}


def _batches(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _merger(limit: int, turn: int, last: bool, keep_ids: bool, names: list[str]):
    """Packs the leftovers of FAN_IN partitions anew; the last one empties its windows."""

    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        packer = Packer(limit, (turn << 56) | (int(key[0]) << 28), keep_ids)
        pdf = pdf.sort_values(["at", "open", "start"], kind="stable")
        ids = pdf["doc_id"].astype(object).where(pdf["doc_id"].notna(), None)
        for doc_id, start, own, total in zip(ids, pdf["start"], pdf["ids"], pdf["doc_tokens"]):
            packer.add(doc_id, int(start), bytes(own), int(total))
        if last:
            packer.finish()
        return pd.DataFrame(packer.flush() + packer.leftovers(int(key[0])), columns=names, dtype=object)

    return merge


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents in sequences of at most `limit` ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Each partition packs online with OPEN windows; what is left in them is merged by FAN_IN partitions at a time
    until one task is left, which holds FAN_IN * OPEN windows at most. Results depend only on the order of rows
    within the input's partitions. The executors read the tokenizer file from their own installation.

    Cases: a null or empty text is end_id alone; a null id, repeated ids and repeated rows are documents of their
    own; long texts give several full sequences; an empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = docs.select(F.col(f"`{id_col}`")).dtypes[0][1]
    schema = T.StructType.fromDDL(PIECE.format(kind=kind))
    arrow = to_arrow_schema(schema)
    end = np.array([end_id], "<u4").tobytes()

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoders.setdefault(tokenizer_path, None) or Encoder(tokenizer_path)
        _encoders[tokenizer_path] = encode
        at = TaskContext.get().partitionId()
        packer = Packer(limit, at << 28, keep_ids)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).fill_null("")
            size, row = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
            while row < len(texts):
                stop = max(row + 1, int(np.searchsorted(size, (size[row - 1] if row else 0) + STEP_BYTES, side="right")))
                for doc_id, ids in zip(doc_ids[row:stop].to_pylist(), encode(texts[row:stop].to_pylist())):
                    packer.add(doc_id, 0, ids + end, len(ids) // 4 + 1)
                yield from _batches(packer.flush(), arrow)
                row = stop
        yield from _batches(packer.flush() + packer.leftovers(at), arrow)

    pieces = materialize(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(first_pass, schema), "pack-first")
    done, turn = [pieces.where("at is null")], 0
    rest = pieces.where("at is not null")
    most = rest.agg(F.max("at")).first()[0]
    while most is not None:
        turn += 1
        last = most < FAN_IN

        merged = materialize(rest.groupBy(F.expr(f"at div {FAN_IN}").alias("g")).applyInPandas(_merger(limit, turn, last, keep_ids, schema.names), schema), "pack-merge")
        done.append(merged.where("at is null"))
        rest = merged.where("at is not null")
        most = None if last else rest.agg(F.max("at")).first()[0]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("at", "open") if keep_ids else out.drop("at", "open", "ids")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
