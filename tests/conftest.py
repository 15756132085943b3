import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(rows):
    def one(v):
        if isinstance(v, float):
            return round(v, 5) + 0.0
        return tuple(map(one, v)) if isinstance(v, (list, tuple)) else v

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


def same_as_sql(spark, run, sql, sf_dir="/root/testdata/sf0.001"):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = run(spark, sf_dir)
    columns = sorted(df.columns)
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    want = [[r[names.index(c)] for c in columns] for r in got.fetchall()]
    assert normal(df.select(columns).collect()) == normal(want)
