import os

import pytest
from pyspark.sql import SparkSession

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '4')}]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 6)
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return value


@pytest.fixture(scope="session")
def agrees(spark):
    """Assert that a query and its SQL give the same rows over a folder of tables."""
    import duckdb

    def check(query, sql, folder):
        con = duckdb.connect()
        for name in os.listdir(folder):
            path = f"{folder}/{name}/*.parquet" if os.path.isdir(f"{folder}/{name}") else f"{folder}/{name}"
            con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{path}')")
        df = query(spark, folder)
        names = sorted(df.columns)
        mine = sorted(([plain(r[n]) for n in names] for r in df.collect()), key=repr)
        result = con.execute(sql)
        columns = [d[0] for d in result.description]
        assert sorted(columns) == names
        theirs = sorted(([plain(r[columns.index(n)]) for n in names] for r in result.fetchall()), key=repr)
        assert mine == theirs

    return check
