"""Row ids, worker tables and scratch tables."""

import os

import pytest
from pyspark.sql import functions as F

from mensura.llm import common


def test_row_ids_do_not_follow_splits(spark, tmp_path):
    spark.range(30_000).repartition(12).write.parquet(f"{tmp_path}/t")
    ids = lambda: {r["id"]: tuple(r["rid"]) for r in common.with_row_ids(spark.read.parquet(f"{tmp_path}/t").where("id % 3 = 0")).collect()}
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes")
    given = {n: spark.conf.get(n, None) for n in names}
    first = ids()
    try:
        for size, least in (("4096", "40"), ("1g", "2")):
            spark.conf.set(names[0], size)
            spark.conf.set(names[1], least)
            spark.conf.set(names[2], "1")
            assert ids() == first
    finally:
        for n, v in given.items():
            spark.conf.set(n, v) if v is not None else spark.conf.unset(n)
    assert len(set(first.values())) == 10_000


def test_row_ids_are_unique_where_rows_are_read_twice(spark, tmp_path):
    spark.range(50).write.parquet(f"{tmp_path}/t")
    once = spark.read.parquet(f"{tmp_path}/t")
    for df in (spark.read.parquet(f"{tmp_path}/t", f"{tmp_path}/t"), once.union(once), once.crossJoin(once.withColumnRenamed("id", "file").limit(2)), once.groupBy(F.col("id").alias("row")).count()):
        got = common.with_row_ids(df)
        assert got.columns == [*df.columns, "rid"] and got.select("rid").distinct().count() == df.count()


def test_scratch_tables_go_and_kept_ones_stay(spark):
    with common.scratch(spark):
        gone, stays = common.written(spark.range(3), "gone"), common.written(spark.range(4), "stays", keep=True)
        assert gone.count() == 3
    path = lambda df: df.inputFiles()[0].removeprefix("file:").replace("//", "/")
    assert stays.count() == 4 and os.path.exists(path(stays)) and not os.path.exists(path(gone))


def test_a_worker_holds_one_thing():
    a = common.held("a", lambda: [1])
    assert common.held("a", lambda: [2]) is a
    common.held("b", lambda: [3])
    assert common.held("a", lambda: [2]) == [2]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from mensura.llm.common import shared_dir

    def session(master, **conf):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)), sparkContext=SimpleNamespace(master=master, applicationId=f"{master}{conf}"))

    for where in ("file:/tmp/warehouse", "/tmp/warehouse"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(session("spark://host:7077", **{"spark.sql.warehouse.dir": where}))
    assert shared_dir(session("yarn", **{"spark.sql.warehouse.dir": "hdfs://x/w/"})) == "hdfs://x/w"
    assert shared_dir(session("yarn", **{"spark.checkpoint.dir": "hdfs://x/c/"})) == "hdfs://x/c"
    assert shared_dir(session("local[4]")).startswith("file:///")
