from stockbook.plans.lineage import cut_lineage
from stockbook.session import checkpoint_dir


def test_checkpoint_dir_is_read_not_replaced(spark):
    before = spark.sparkContext.getCheckpointDir()
    assert before                                   # set by the fixture or the environment
    assert checkpoint_dir(spark) == before          # read, never replaced
    df = cut_lineage(spark.range(10))
    assert df.count() == 10
    assert spark.sparkContext.getCheckpointDir() == before
