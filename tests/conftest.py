import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    made = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.codegen.fallback", "false")  # a plan that can't be compiled fails its test
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    # The small views that many queries build on are made once for all tests.
    from graphloom.plans import views

    kept, write = {}, views.materialize
    views.materialize = lambda df, name: kept[name] if name in kept else kept.setdefault(name, write(df, name))
    yield made
    views.materialize = write
    made.stop()


def duck(sql, sf_dir=SF):
    """The rows of a DuckDB query over sf_dir's tables."""
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    found = con.sql(sql)
    return [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()]


def same(rows, others):
    """Both as sorted lists of tuples by column name, numbers rounded."""

    def plain(v):
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    def key(rows):
        return sorted((tuple(plain(r[c]) for c in sorted(r)) for r in rows), key=repr)

    return key(rows) == key(others)
