"""Connected components of a link table with DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def components(links: DataFrame, limit: int = 60) -> DataFrame:
    """node, comp (the smallest node that links reach) of every node in links (a, b: long). Links are stored tables.

    Each round takes the least label among neighbours and then the label of that label, so paths shorten by more than half
    a round. Only minima are gathered per node, so a node with very many links costs partial sums, not a list.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).filter("u <> v")
    now = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("comp")), "comp")
    for _ in range(limit):
        near = both.join(now.select(F.col("node").alias("v"), "comp"), "v").groupBy("u").agg(F.min("comp").alias("m"))
        low = now.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("comp").alias("was"), F.least("comp", "m").alias("comp"))
        jump = now.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        new = materialize(low.join(jump, "comp", "left").select("node", "was", F.least("comp", F.coalesce("further", "comp")).alias("comp")), "comp")
        release(now)
        now = new
        if new.filter("was <> comp").isEmpty():
            return now.select("node", "comp")
    raise RuntimeError("components did not settle")
