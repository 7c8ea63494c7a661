from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.default.parallelism", "4").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        p = Path(SMALL, f"{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p / '*.parquet' if p.is_dir() else p}'")
    return c


def cells(frame) -> list[tuple]:
    """Rows with columns by name, in an order of their own, numbers rounded."""

    def plain(v):
        if v is None or (isinstance(v, float) and v != v):
            return "null"
        v = v.item() if hasattr(v, "item") and getattr(v, "ndim", 0) == 0 else v
        if isinstance(v, float):
            return repr(int(v)) if v.is_integer() else repr(round(v, 6))
        return repr(v)

    import pandas as pd

    names = sorted(frame.columns)
    return sorted(tuple("null" if v is pd.NA else plain(v) for v in row) for row in frame[names].astype(object).itertuples(index=False))
