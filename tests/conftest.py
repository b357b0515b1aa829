import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def same():
    """Whether a DataFrame has the rows that SQL gives, whatever their order."""
    import duckdb

    con = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")

    def rows(columns, values):
        order = sorted(range(len(columns)), key=columns.__getitem__)
        return sorted(tuple(f"{v[i]:.6g}" if isinstance(v[i], float) else str(v[i]) for i in order) for v in values)

    def check(df, sql):
        found = con.sql(sql)
        names, want = list(found.columns), found.fetchall()
        assert sorted(df.columns) == sorted(names)
        assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want)

    return check
