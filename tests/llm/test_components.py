"""Connected components: results, and what the rounds leave in the driver."""

from barloom.llm.components import connected_components


def test_the_driver_is_collected_between_rounds(spark):
    """A chain takes several rounds; what each leaves in the driver does not wait until its heap has grown to the limit."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    collections = lambda: sum(b.getCollectionCount() for b in beans if "Young" not in b.getName())
    before = collections()
    out = connected_components(spark.range(30).selectExpr("id AS u", "id + 1 AS v"))
    assert collections() - before >= 3
    assert {(r.node, r.component) for r in out.collect()} == {(i, 0) for i in range(31)}
