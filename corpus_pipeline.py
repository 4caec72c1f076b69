"""A corpus pipeline: quality, common lines, near duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of `documents`, in their order, whatever names other columns have.

Cases, for all stages: null ids, languages and sources are values like others; very long texts are read whole; an empty
table gives an empty result. What a stage makes of null and empty texts, ties and repeated rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.llm import line_dedup, mixing, near_dedup, packing, quality
from tilespark.llm.common import materialize, table


def _aside(docs: DataFrame, used: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """docs with all columns but the used ones under names that no operator adds, and those names by the old ones."""
    names = {c: c if c in used else f"aside__{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def _back(out: DataFrame, names: dict[str, str], new: dict | None = None) -> DataFrame:
    """The columns under their old names, some of them with new values."""
    return out.select(*[(new or {}).get(c, F.col(n)).alias(c) for c, n in names.items()])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go. Null and empty texts get the score of the empty text, so all
    of them stay or all go; equal texts, and so repeated rows, share one verdict; a score on the threshold stays."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    rows, names = _aside(docs, ("doc_id", "text"))
    return _back(quality.score(rows, model).where(F.col("score") >= quality.THRESHOLD), names)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least 10 documents share go from all texts; n_chars follows. No document goes: one that loses all
    its lines has an empty text, and a null text stays null with its n_chars. Repeated rows count as documents each."""
    rows, names = _aside(docs, ("doc_id", "text", "n_chars"))
    out = line_dedup.drop_common_lines(rows, min_docs=10, min_length=1)
    known = F.col("text").isNotNull()
    new = {"text": F.when(known, F.col("kept_text")), "n_chars": F.when(known, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))}
    return _back(out, names, new)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays: the one of least id, a
    null id being the largest, and one row of several that are equal in id and text. Texts without words are no
    duplicates of anything else, but rows of them that are equal in id and text are one."""
    rows, names = _aside(docs, ("doc_id", "text"))
    return _back(near_dedup.keep_one_of_each(rows, size=5, percent=80), names)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 3, 1, 2, repeating, and 150 % of all words: rows leave, stay, or stand twice, and then keep their
    doc_id. Texts without words are never needed; rows equal in id and text are decided together."""
    rows, names = _aside(docs, ("doc_id", "text", "source"))
    mixed = mixing.mix_sources(rows)
    return _back(mixed.withColumn("copies", F.explode(F.array_repeat(F.lit(1), F.col("copies")))), names)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 ids. A null or empty text is its end mark alone; every row is packed, so the
    pieces of a document that the mix takes twice stand twice, at different places of the sequences."""
    import public_tokenizers

    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Compression, near duplicates and tokenizers can't be expressed in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
