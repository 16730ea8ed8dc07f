import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in Path(SF).iterdir():
        con.sql(f"CREATE VIEW {p.name.split('.')[0]} AS SELECT * FROM '{p}'")
    return con


def _cell(x):
    return f"{x:.6f}" if isinstance(x, float) else str(x)


def rows_of(columns, rows):
    """Rows as sorted texts, columns by name."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(_cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def same(spark, duck):
    def check(query, sql):
        got = query(spark, SF)
        want = duck.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())

    return check
