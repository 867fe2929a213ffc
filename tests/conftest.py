import tempfile
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='metricwell-test-')}")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="metricwell-wh-"))
        .getOrCreate()
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    """Columns and rows in order, numbers rounded, nulls alike."""
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        try:
            df[c] = pd.to_numeric(df[c]).astype(float).round(6)
        except (ValueError, TypeError):
            df[c] = df[c].astype(str)
        df[c] = df[c].astype(str).replace({"<NA>": "nan", "None": "nan", "-0.0": "0.0"})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="session")
def same():
    def check(got: pd.DataFrame, want: pd.DataFrame) -> None:
        pd.testing.assert_frame_equal(plain(got), plain(want))

    return check


@pytest.fixture(scope="session")
def data() -> str:
    assert Path(DATA).exists()
    return DATA
