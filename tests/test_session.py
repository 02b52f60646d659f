import time

from pyspark.sql import functions as F

from namewright import session


def test_cut_leaves_no_shuffle_files(spark):
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: {x for x in blocks.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    before = files()
    made = session.cut(spark.range(1000).groupBy(F.col("id") % 7).count())
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and made.count() == 7
    assert spark.conf.get(session.DROP_SHUFFLES, None) != "true"
