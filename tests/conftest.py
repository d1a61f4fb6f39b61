import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    import os

    from pyspark.sql import SparkSession

    os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
    here = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(here / "checkpoints"))
        .config("spark.sql.warehouse.dir", str(here / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def compare(spark, make, sql, sf_dir):
    """Rows of a query and of its SQL in DuckDB, as sorted texts."""
    import duckdb

    def spelt(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, (list, tuple)):
            return tuple(spelt(x) for x in v)
        if isinstance(v, float):
            return float(f"{v:.9g}") if v else 0.0
        return v if v is None or isinstance(v, (int, bool)) else str(v)

    got = make(spark, sf_dir).toArrow()
    names = sorted(got.column_names)
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    want = con.sql(sql)
    assert sorted(want.columns) == names
    at = [want.columns.index(n) for n in names]
    return sorted(repr(tuple(spelt(r[n]) for n in names)) for r in got.to_pylist()), sorted(repr(tuple(spelt(r[i]) for i in at)) for r in want.fetchall())
