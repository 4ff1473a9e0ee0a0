"""Query sets and centre sets grow with their tables."""

from recollect.plans import queries as own
from recollect.plans import service, upkeep  # noqa: F401


def test_nearest_centres_grow(spark, sf):
    v = own.T.vectors(spark, sf)
    got = own.queries()["c15_nearest_of_class"](spark, sf)
    inside = v.where("label = 0").select(own.F.col("id").alias("centre"))
    assert inside.count() > 10
    assert got.join(inside, "centre", "left_anti").isEmpty()
    assert got.select("centre").distinct().count() > 10
