import glob
import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", f"{shared}/checkpoints").config("spark.sql.warehouse.dir", f"{shared}/warehouse").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def same_rows(a, b):
    """Whether two pandas tables hold the same rows in any order."""
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)

    def plain(x):
        x = x[cols].convert_dtypes()
        for c in cols:
            if str(x[c].dtype).startswith("Float"):
                x[c] = x[c].astype(float).round(6) + 0.0
            elif str(x[c].dtype).startswith(("Int", "int")):
                x[c] = x[c].astype("Int64")
        return x.astype(str).sort_values(cols).reset_index(drop=True)

    a, b = plain(a), plain(b)
    assert a.shape == b.shape
    assert (a.values == b.values).all()
