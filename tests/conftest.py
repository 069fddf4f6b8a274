import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def same_as_sql(spark, data):
    """Compares a registered query with its SQL on the smallest tables."""
    import glob

    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")

    def value(x):
        if isinstance(x, float):
            return round(x, 6)
        return tuple(map(value, x)) if isinstance(x, list) else x

    def rows(found, columns):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted((tuple(value(r[i]) for i in order) for r in found), key=repr)

    def check(query, sql):
        df = query(spark, data)
        expected = con.sql(sql)
        assert sorted(df.columns) == sorted(expected.columns)
        assert rows(df.collect(), df.columns) == rows(expected.fetchall(), expected.columns)

    return check
