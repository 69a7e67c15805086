"""Connected components of a link table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberledger.llm.shared import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes of the links (a, b): root is the smallest node of the component.

    Each round takes the smallest root among a node's neighbours and then the root of that root,
    so long chains shrink by half; every round is written to shared storage.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    roots = stored(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(
            F.col("a").alias("node")).agg(F.min("root").alias("near"))
        new = roots.join(near, "node").select(
            "node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        above = new.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = stored(new.join(above, "root").select("node", "old", F.col("above").alias("root")),
                     "roots")
        if not new.where("old <> root").limit(1).count():
            return new.drop("old")
        roots = new.drop("old")
