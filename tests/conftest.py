import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    work = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(work / "warehouse"))
        .config("spark.checkpoint.dir", f"file://{work}/shared")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def same(sf_dir):
    """Compares a DataFrame with DuckDB SQL over the tables, rows in any order and columns by name."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")

    def order(rows):
        return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])

    def check(df, sql):
        got = con.execute(sql)
        names = [x[0] for x in got.description]
        assert sorted(names) == sorted(df.columns)
        at = sorted(range(len(names)), key=lambda i: names[i])
        want = order(tuple(r[i] for i in at) for r in got.fetchall())
        have = order(tuple(r) for r in df.select(*sorted(df.columns)).collect())
        assert len(have) == len(want)
        assert [(a, b) for a, b in zip(have, want) if a != b][:3] == []

    return check
