"""Written stages leave no shuffle files behind."""

from cartlens.session import _FILE_CLEANUP, stage


def test_a_stage_leaves_no_shuffle_files(spark):
    """Loops would pile them up until the driver's memory makes it look for unused ones."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(disk.getAllFiles().mkString("\n").split("\n"))
    before = files()
    staged = stage(spark.range(1000).repartition(5, "id"), "shuffled")
    assert not {f for f in files() - before if "shuffle_" in f}
    assert staged.count() == 1000
    assert spark.conf.get(_FILE_CLEANUP, "false") == "false"  # other queries keep theirs
