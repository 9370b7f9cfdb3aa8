import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


def rows_of(frame):
    """Rows as sorted tuples of columns in order of their names, floats rounded."""

    def plain(v):
        return round(v, 6) if isinstance(v, float) else v

    names = sorted(frame.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in frame.collect()), key=repr)


def rows_of_sql(sql, folder):
    """The same of DuckDB's answer on the tables of a folder."""
    import glob

    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{source}')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)

    def plain(v):
        return round(v, 6) if isinstance(v, float) else v

    return sorted(names), sorted((tuple(plain(r[k]) for k in order) for r in found.fetchall()), key=repr)


@pytest.fixture(scope="session")
def same_as_sql():
    """Holds a frame against SQL over a folder of tables."""

    def check(frame, sql, folder):
        names, got = rows_of(frame)
        sql_names, wanted = rows_of_sql(sql, folder)
        assert names == sql_names
        assert len(got) == len(wanted)
        for a, b in zip(got, wanted, strict=True):
            assert a == b

    return check
