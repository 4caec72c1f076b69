"""The pipeline: each stage on all that its predecessor kept."""

import re
from collections import Counter

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from tilespark.llm import queries
from tilespark.llm.common import attach, components, join_counted, materialize


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = queries.queries()[name](spark, sf_dir).toPandas(), c.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda f: sorted(tuple(map(str, r)) for r in f[sorted(f.columns)].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


def test_stages_follow_each_other(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    columns, before = docs.columns, docs.cache()
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, d).cache()
        if name != "packing":
            assert after.columns == columns and [t for _, t in after.dtypes] == [t for _, t in docs.dtypes]
        had, has = (Counter(r.doc_id for r in x.select("doc_id").collect()) for x in (before, after))
        assert set(has) <= set(had)
        if name == "quality":
            wrong = [i for i, q in labels.items() if q != (i in has)]
            assert len(wrong) <= 0.03 * len(labels)
        if name == "lines":
            assert has == had
            keys = Counter(k for r in after.collect() for k in {x.strip().lower() for x in r.text.split("\n")} if k)
            assert max(keys.values()) < 10
        if name == "near_duplicates":
            assert max(has.values()) == 1 and len(has) < len(had)
        if name == "mixing":
            assert set(has.values()) == {1, 2}
            words = lambda x: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in x.collect())
            assert abs(words(after) - 1.5 * words(before)) <= 0.01 * words(before)
        if name == "packing":
            assert set(has) == set(had)
            assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
        before = after


def test_stages_bear_hard_cases(spark, sf_dir):
    long = " ".join(f"w{i % 700}" for i in range(30_000))
    base = [(1, None), (2, ""), (3, " \n "), (4, long), (4, long), (None, "one two three four five six"), (None, None), (5, "one two three four five six"), (6, "x\n\u00a0\n y")]
    rows = [(i, t, None if i == 3 else "en", None if i == 6 else "a", None if t is None else len(t)) for i, t in base] + [(20 + i, f"shared line\nown words {i} of the text", "en", "b", 30) for i in range(12)]
    given = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # columns named like those that operators add
    docs = given.withColumns({c: F.lit("clash") for c in ("score", "kept_text", "n_lines", "copies", "n_shingles", "least")}).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        got = Counter((r.doc_id, r.text) for r in out.collect())
        assert all(r.score == r.copies == "clash" for r in out.collect())
        had = Counter((r.doc_id, r.text) for r in docs.collect())
        if name == "quality":
            kinds = {(t or "") == "" for _, t in got if not (t or "")}
            assert set(got) <= set(had) and got[(4, long)] in (0, 2) and (got[(1, None)] == got[(2, "")] == got[(None, None)]) and kinds <= {True}
        if name == "lines":
            assert got[(1, None)] == 1 and got[(2, "")] == 1 and got[(4, long)] == 2 and all("shared line" not in (t or "") for _, t in got) and sum(got.values()) == len(rows)
        if name == "near_duplicates":
            assert got[(4, long)] == 1 and (5, "one two three four five six") in got and (None, "one two three four five six") not in got and all(got[x] == 1 for x in ((1, None), (2, ""), (3, " \n "), (None, None)))
        if name == "mixing":
            assert set(got) <= set(had) and got[(4, long)] in (0, 2, 4)
    assert {r.doc_id for r in corpus_pipeline.packing_stage(spark, docs, sf_dir).collect()} == {i for i, *_ in rows}


def test_stages_bear_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    assert all(stage(spark, docs, sf_dir).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_components(spark):
    edges = [(i, i + 1) for i in range(200) if i % 50 != 49] + [(1000, 5), (5, 1000), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {i: i // 50 * 50 for i in range(200)} | {1000: 0}
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def test_components_beyond_a_broadcast(spark, monkeypatch):
    from tilespark.llm import common

    monkeypatch.setattr(common, "SMALL", -1)
    monkeypatch.setattr(common, "COMMON_KEYS", 3)
    edges = [(i, i + 1) for i in range(60) if i % 20 != 19] + [(500, i) for i in range(501, 600)] + [(7, 590), (9000, 8000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    want = {i: i // 20 * 20 for i in range(60)} | {i: 0 for i in range(500, 600)} | {8000: 8000, 9000: 8000}
    assert got == want


def test_joins_by_counted_keys_equal_plain_ones(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 1500).alias("k"))
    counts = materialize(rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("most")).where("k % 2 = 0"), "counts")
    want = Counter(map(tuple, rows.join(counts, "k").select("id", "k", "most").collect()))
    got = join_counted(rows, counts, ["k"], 5000, ["most"])
    assert Counter(map(tuple, got.select("id", "k", "most").collect())) == want
    assert Counter(map(tuple, attach(rows, counts.select("k", "most"), ["k"], 1 << 30).select("id", "k", "most").collect())) == want
    assert Counter(map(tuple, attach(rows, counts.select("k", "most"), ["k"], 16).select("id", "k", "most").collect())) == want
