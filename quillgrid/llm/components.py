"""Connected components of a large link table, by minimum labels, hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import cut, packed


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 100, most: int | None = None) -> DataFrame:
    """(node, root): for each node of `links`, the smallest node that it is linked with, directly or not.

    Links go both ways; repeated links, loops and nulls do no harm. In each round every node takes the
    smallest label among its neighbours, offers it to the node its own label names, and jumps to the label
    of its label, so paths shorten by half and the rounds grow with the logarithm of the longest one.
    Labels that a thousandth of all nodes share, of which there are a thousand at most, are broadcast in the
    jump, so a component with many of the nodes isn't looked up by one task. Only counts reach the driver.
    An empty table gives an empty result. `most`: how many links there are at most, if known.
    """
    pairs = links.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node is not null and other is not null and node <> other")
    both = pairs.unionByName(pairs.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct()
    most = None if most is None else 2 * most
    edges = cut(packed(both, most))
    labels = cut(
        packed(edges.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("root")), most)
    )
    held = labels.count()
    crowd = max(100, held // 1000)
    for _ in range(rounds):
        near = (
            edges.join(labels.select(F.col("node").alias("other"), F.col("root").alias("seen")), "other")
            .groupBy("node")
            .agg(F.min("seen").alias("near"))
        )
        seen = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("mine"))
        offers = seen.groupBy(F.col("old").alias("node")).agg(F.min("mine").alias("offer"))
        hooked = cut(
            packed(seen.join(offers, "node", "left").select("node", "old", F.least("mine", F.coalesce("offer", "mine")).alias("mine")), held)
        )
        hubs = cut(packed(hooked.groupBy("mine").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= crowd).select("mine"), held))
        parents = hooked.select(F.col("node").alias("mine"), F.col("mine").alias("above"))
        few = F.broadcast(parents.join(F.broadcast(hubs), "mine", "left_semi"))
        many = hooked.join(F.broadcast(hubs), "mine", "left_anti").join(parents, "mine")
        step = cut(packed(hooked.join(few, "mine").unionByName(many).select("node", "old", F.col("above").alias("root")), held))
        labels = step.select("node", "root")
        if step.where("old <> root").isEmpty():
            return labels
    raise RuntimeError(f"components not found in {rounds} rounds")
