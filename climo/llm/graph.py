"""Connected components of link tables, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climo.llm.tables import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (u, v): the smallest id reachable.

    Each round every id takes the smallest label of its neighbours, then its label's own label, so the
    rounds grow with the logarithm of a component's diameter.  Only minima per id are gathered (summed up
    before the shuffle), however many neighbours an id has.  Self links are allowed; links with a null end
    are left out; an empty table gives no rows.
    """
    pairs = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).where("a is not null and b is not null")
    both = written(pairs.union(pairs.select("b", "a")).distinct())
    labels = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "id"))
    while True:
        seen = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("_near"))
        step = labels.join(seen.withColumnRenamed("a", "id"), "id").select(
            "id", "component", F.least("component", "_near").alias("_next"))
        jump = labels.select(F.col("id").alias("_next"), F.col("component").alias("_jump"))
        new = written(step.join(jump, "_next").select("id", "component", F.least("_next", "_jump").alias("_new")))
        changed = new.where("_new <> component").limit(1).count()
        labels = new.select("id", F.col("_new").alias("component"))
        if not changed:
            return labels
