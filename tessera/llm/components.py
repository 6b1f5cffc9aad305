"""Connected components of an edge list, as distributed union-find.

Two steps alternate until nothing changes. *Hook*: each node takes the least root that any of its
neighbours has (a min aggregate, combined before the shuffle). *Jump*: each node takes its root's
root, which halves the depth of the trees. Both move one narrow row for each node or edge; nothing
is collected but the count of changed nodes. Each round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Table


def components(spark: SparkSession, edges: DataFrame, a: str = "a", b: str = "b") -> Table:
    """Table (node, root) of all nodes in ``edges``: ``root`` is the least node of its component.

    Nodes can be of any ordered type. Loops, repeated edges and nulls do no harm (edges with a null
    end are left out). An empty edge list gives an empty table.
    """
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = Table(spark, ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = Table(spark, both.df.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("root")), "roots")
    while True:
        # hook: what the neighbours' roots offer; offers to a root itself let whole trees merge
        seen = both.df.join(labels.df, both.df.v == labels.df.node).groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        met = labels.df.join(seen, "node").select("node", "root", F.least("root", "near").alias("near"))
        offers = met.where(F.col("near") < F.col("root")).groupBy(F.col("root").alias("at")).agg(F.min("near").alias("offer"))
        hooked = Table(spark, met.join(offers, F.col("node") == F.col("at"), "left").select("node", F.col("root").alias("was"), F.least("near", "offer").alias("root")), "hooked")
        # jump twice
        up = hooked.df.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = hooked.df.join(up, "root", "left").select("node", "was", F.least(F.col("above"), F.col("root")).alias("root"))
        new = Table(spark, jumped, "roots")
        moved = new.df.where(F.col("was") != F.col("root")).limit(1).count()
        hooked.drop()
        labels.drop()
        labels = new
        labels.df = new.df.select("node", "root")
        if not moved:
            both.drop()
            return labels
