import pytest

from webloom.llm import common


def test_batches_are_put_back(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with common.small_batches(spark):
        assert spark.conf.get(name) == str(common.BATCH_ROWS)
    assert spark.conf.get(name) == before
    spark.conf.set(name, "7")
    with pytest.raises(ZeroDivisionError), common.small_batches(spark):
        assert spark.conf.get(name) == "7"
        1 / 0
    assert spark.conf.get(name) == "7"
    spark.conf.set(name, before)


def test_stored_and_dropped(spark):
    df = common.stored(spark.range(5))
    assert df.count() == 5
    common.dropped(df)
    with pytest.raises(Exception, match="(?i)not_?\\s?exist"):
        df.collect()


def test_free_names():
    assert common.fresh(["_A", "b", "_a_"], "_a", "b", "c", "_a") == ["_a__", "b_", "c", "_a___"]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())


def test_least_hashed(spark):
    rows = [("a", 3 * i) for i in range(1000)] + [("b", i) for i in range(4)] + [(None, 5)]
    df = spark.createDataFrame(rows, "label string, h long")
    got = [(r.label, r.h) for r in common.least_hashed(df, 10).collect()]
    assert sorted(x for x in got if x[0]) == sorted([("a", 3 * i) for i in range(10)] + [("b", i) for i in range(4)])
    assert common.least_hashed(df.limit(0), 10).count() == 0
