"""Connected components of a graph of links, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.session import staged

MAX_ROUNDS = 200


def components(links: DataFrame) -> DataFrame:
    """(``node``, ``label``) for every node of ``links`` (long columns ``a``, ``b``).

    ``label`` is the smallest node of the component. Each round moves every root's tree
    below the smallest label among its neighbours and then halves the paths, so long
    chains need a logarithmic number of rounds, not one per link. Loops and repeated
    links do no harm. Labels and links stay distributed; the driver sees one count a round.
    """
    links = staged(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = staged(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("label", F.col("node")), "labels")
    current = links
    for _ in range(MAX_ROUNDS):
        # Links between labels: each larger label takes the smallest it is linked with.
        parents = current.groupBy(F.col("b").alias("_from")).agg(F.min("a").alias("_to"))
        parents = staged(parents, "parents")
        if parents.isEmpty():
            return labels
        # A parent may have a parent of its own: follow while there is one.
        while True:
            up = parents.select(F.col("_from").alias("_via"), F.col("_to").alias("_top"))
            jumped = staged(parents.join(up, F.col("_to") == F.col("_via"), "left").select(
                "_from", F.coalesce("_top", "_to").alias("_to"), F.col("_top").isNotNull().alias("_moved")), "parents")
            parents = jumped.drop("_moved")
            if jumped.filter("_moved").isEmpty():
                break
        labels = staged(labels.join(parents, F.col("label") == F.col("_from"), "left").select(
            "node", F.coalesce("_to", "label").alias("label")), "labels")

        def renamed(df, name):
            return df.join(parents, F.col(name) == F.col("_from"), "left").withColumn(
                name, F.coalesce("_to", name)).drop("_from", "_to")

        current = renamed(renamed(current, "a"), "b")
        current = staged(current.filter("a <> b").select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    raise RuntimeError("the components did not settle")
