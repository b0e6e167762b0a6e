"""Connected components of a table of links, by rounds of contraction; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.llm.shared import dropped, written


def connected_components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (id, component), for every id that occurs: component is the smallest id that links reach.

    In each round every node picks the smallest node in its neighbourhood, follows that pick twice more, and links
    are redrawn between the nodes that remain. A component's smallest node always remains. Each round's table is
    written to the shared folder, so lineage stays short and lost executors cost one round at most.
    """
    links = written(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = written(links.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id")), "labels")
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        picks = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("to"))
        for _ in range(2):
            picks = picks.alias("p").join(picks.alias("q"), F.col("p.to") == F.col("q.id")).select("p.id", "q.to")
        picks = written(picks, "picks")
        at = lambda c, out, df: df.join(picks.select(F.col("id").alias(c), F.col("to").alias(out)), c, "left")  # noqa: B023, E731
        redrawn = at("b", "y", at("a", "x", links)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        new_labels = written(at("component", "to", labels).select("id", F.coalesce("to", "component").alias("component")), "labels")
        new_links = written(redrawn.where("a != b").distinct(), "links")
        for old in (labels, links, picks):
            dropped(old)
        labels, links = new_labels, new_links
    dropped(links)
    return labels
