from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


def plain(value):
    """A value that compares: floats to nine digits, arrays as lists."""
    if isinstance(value, float):
        return "nan" if value != value else float(f"{value:.9g}")
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    return value


@pytest.fixture(scope="session")
def same_as_sql(spark, sf_dir):
    """Holds a DataFrame against SQL over the driver's tables."""
    import duckdb

    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")

    def check(df, sql):
        result = con.execute(sql)
        names = [c[0] for c in result.description]
        assert sorted(names) == sorted(df.columns)
        order = [names.index(c) for c in df.columns]
        expected = sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=lambda r: [*map(str, r)])
        found = sorted((tuple(plain(v) for v in r) for r in df.collect()), key=lambda r: [*map(str, r)])
        assert found == expected

    return check
