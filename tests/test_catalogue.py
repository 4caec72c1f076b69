"""Every query against its SQL, as the driver compares them."""

import os

import duckdb
import pandas as pd
import pytest

from tilespark.plans import catalogue


def as_text(frame: pd.DataFrame) -> list[tuple]:
    def one(v):
        if isinstance(v, (bool,)):
            return str(v)
        if isinstance(v, float):
            return "null" if v != v else f"{v:.9g}"
        return "null" if v is None or v is pd.NA else str(v)

    return sorted(tuple(one(v) for v in row) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = catalogue.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert as_text(got) == as_text(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_read_bits_without_type_or_id(spark, sf_dir, tmp_path):
    """Rows without a type are a stream, a row without an id is the last of its stream."""
    c = duckdb.connect()
    odd = "CASE WHEN event_id < 900 THEN event_id * 3 - 200 END AS event_id, nullif(event_type, 'view') AS event_type, CASE WHEN event_id % 7 > 0 THEN value END AS value"
    c.sql(f"CREATE TABLE events AS SELECT {odd} FROM '{sf_dir}/events.parquet' WHERE event_id < 900 OR event_id = 950")
    c.sql(f"COPY events TO '{tmp_path}/events.parquet'")
    want = c.sql(catalogue.ORACLES["read_bits"]).df()
    assert want.event_type.isna().any()
    assert as_text(catalogue.QUERIES["read_bits"](spark, str(tmp_path)).toPandas()) == as_text(want)
