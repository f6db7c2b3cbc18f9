from types import SimpleNamespace

import pytest

from skein.plans import scratch
from skein.plans.iterate import Rounds, until


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)

    def set(self, key, value):
        self[key] = value


def session(master, **conf):
    return SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: Conf({"spark.master": master, **conf})), conf=Conf())


def test_shared_folder():
    given = session("spark://x:1", **{"spark.checkpoint.dir": "hdfs://a/b/"})
    assert scratch.shared_dir(given) == "hdfs://a/b" and not given.conf
    with pytest.raises(ValueError):
        scratch.shared_dir(session("spark://x:1"))
    local = session("local[2]")
    assert scratch.shared_dir(local) == scratch.shared_dir(local) == local.conf["spark.checkpoint.dir"]


def test_written_tables(spark):
    df = scratch.written(spark.range(5), "t")
    assert df.count() == 5 and "parquet" in df.inputFiles()[0]
    assert scratch.written(spark.range(0), "t").count() == 0


def test_rounds(spark):
    rounds = Rounds(spark.range(0), "r")
    rounds.add(spark.range(2))
    rounds.add(spark.range(2, 5))
    assert sorted(r[0] for r in rounds.all().collect()) == [0, 1, 2, 3, 4]
    state, n = until(spark.range(8), lambda d, k: d.filter(f"id >= {k}"), lambda a, b, k: b.count() <= 5, "u", 10)
    assert (state.count(), n) == (5, 3)


def test_large_shuffles_are_dealt_by_their_rows(spark, monkeypatch):
    from skein import queries
    from skein.plans import scratch

    d, name = "/root/testdata/sf0.001", "spark.sql.adaptive.coalescePartitions.enabled"
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for big, there in ((10**9, False), (600, True)):
        monkeypatch.setattr(scratch, "TASK_ROWS", big)
        for g in (queries.supplies(spark, d), queries.copurchase(spark, d).transpose(), queries.succession(spark, d)):
            assert ("REPARTITION_BY_NUM" in plan(g.edges)) == there
        before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get(name)
        with scratch.spread(spark, 6_100):
            now = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get(name)
        assert now == (("11", "false") if there else before)
        assert before == (spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get(name))
