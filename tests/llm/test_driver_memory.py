"""The driver collects its garbage while an operator writes many tables."""

from glyphmill.llm import common


def test_garbage_is_collected_between_tables(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    scratch, before = common.Scratch(spark, "garbage"), full()
    for i in range(2 * common.GARBAGE):
        scratch.cut(spark.range(i))
    assert full() >= before + 2
    scratch.close()
