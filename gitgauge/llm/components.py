"""Connected components of a graph of links, as grouped aggregates over written tables."""

from pyspark.sql import functions as F

from .common import written

MAX_ROUNDS = 60


def components(links, left="a", right="b"):
    """node, component (the smallest node reachable) for every node that has a link.

    Each round every node hears the smallest label among its neighbours and then the label of that label; the number of nodes
    whose label fell is counted, and the rounds end when there is none. State is two columns per linked node, written to the
    shared folder each round, so lost executors cost one round. A hub's many links are pre-aggregated by the partial minimum.
    """
    both = written(
        links.select(F.col(left).alias("node"), F.col(right).alias("other")).unionByName(
            links.select(F.col(right).alias("node"), F.col(left).alias("other"))).filter("node <> other").distinct(), "links")
    state = written(both.groupBy("node").agg(F.min("other").alias("o")).select("node", F.least("node", "o").alias("label")), "labels")
    for _ in range(MAX_ROUNDS):
        heard = both.join(state.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("heard"))
        near = state.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("near"))
        up = state.select(F.col("node").alias("near"), F.col("label").alias("jump"))
        new = written(near.join(up, "near", "left").select("node", "old", F.least("near", F.coalesce("jump", "near")).alias("label")), "labels")
        moved = new.filter("label < old").limit(1).count()
        state = new.select("node", "label")
        if not moved:
            return state.select("node", F.col("label").alias("component"))
    raise RuntimeError("components did not settle; the links form a chain of more than 2 ** 60 nodes")
