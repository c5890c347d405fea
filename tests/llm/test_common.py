import time

from chronoweave.llm import common


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def test_a_cut_leaves_no_shuffle_files(spark):
    """Even while its plan is still held."""
    before = shuffle_files(spark)
    plan = spark.range(10_000).repartition(4, "id").selectExpr("id % 100 as k").groupBy("k").count()
    rows = common.cut(plan)
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(common.SHUFFLE_CLEANUP, None) in (None, "false")
    assert rows.count() == plan.count() == 100 and rows.join(rows.groupBy("k").count(), "k").count() == 100
