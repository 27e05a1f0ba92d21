"""Stored tables and their lifetime."""

import os

from shroud.llm import common


def folders(paths):
    return [p for p in paths if os.path.exists(p.removeprefix("file:"))]


def test_clean_deletes_what_no_kept_frame_reads(spark):
    common.clean(spark)
    a, b = common.stored(spark.range(5).toDF("a"), "test-a"), common.stored(spark.range(7).toDF("b"), "test-b")
    paths = list(common._WRITTEN)
    assert len(folders(paths)) == 2
    assert common.clean(spark, a) == 1 and a.count() == 5 and len(folders(paths)) == 1
    both = a.crossJoin(common.stored(spark.range(1).toDF("c"), "test-c"))
    assert common.clean(spark, both) == 0 and both.count() == 5
    mark = common.written()
    later = common.stored(spark.range(3).toDF("d"), "test-d")
    assert common.clean(spark, before=mark) == 1 and len(common.written()) == 2 and later is not None
    assert common.clean(spark) == 2 and folders(paths) == [] and b is not None
