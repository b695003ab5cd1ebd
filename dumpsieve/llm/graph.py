"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dumpsieve.llm.shared import stored


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    Each round every node hooks onto its smallest neighbour, chains are shortened twice,
    and links are rewritten to the hooks, so the links shrink by a factor each round until
    none is left. Rounds are tables in the shared folder; nothing comes to the driver but counts.
    """
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a != b")
    links = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    while not links.isEmpty():
        hooks = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("u"), F.least("a", "b").alias("p"))
        hooks = stored(hooks, "hooks")
        for _ in range(2):
            up = hooks.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            hooks = stored(hooks.join(up, "p").select("u", F.col("pp").alias("p")), "hooks")
        to = hooks.select(F.col("u").alias("component"), F.col("p").alias("to"))
        found = stored(
            found.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "found"
        )
        moved = links.join(hooks.select(F.col("u").alias("a"), F.col("p").alias("x")), "a").join(
            hooks.select(F.col("u").alias("b"), F.col("p").alias("y")), "b"
        )
        moved = moved.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        links = stored(moved.distinct(), "links")
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return found
