import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parent.parent), os.environ.get("PYTHONPATH", "")])

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in sorted(Path(SF).glob("*.parquet")):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con


def rows(df):
    """A result's rows as comparable tuples, in any order."""

    def plain(v):
        return round(v, 6) if isinstance(v, float) else v

    columns = sorted(df.columns)
    return sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)


def duck_rows(con, sql):
    columns = sorted(con.sql(sql).columns)

    def plain(v):
        return round(v, 6) if isinstance(v, float) else v

    quoted = ", ".join(f'"{c}"' for c in columns)
    return columns, sorted((tuple(plain(v) for v in r) for r in con.sql(f"select {quoted} from ({sql})").fetchall()), key=repr)
