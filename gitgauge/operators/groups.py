"""Shapes that recur and must survive a group that holds a third of all rows."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32
MAX_BROADCAST_ROWS = 500_000
LIMIT_CONF = "spark.sql.optimizer.windowGroupLimitThreshold"


def top_k(df: DataFrame, keys, order, k: int, spread, rank="rank", salts=SALTS) -> DataFrame:
    """First k rows of each group, with their 1-based rank.

    ``order`` must be total. ``spread`` names columns that differ inside a group. The literal k lets Spark
    put a WindowGroupLimit before each shuffle; the first window runs per (group, salt), so a hot group is cut
    to k rows in many tasks, and the second one sees at most ``salts * k`` rows of it. Spark does this only for limits up
    to a setting, which is raised in the session for a larger k.
    """
    conf = df.sparkSession.conf
    if int(conf.get(LIMIT_CONF)) < k:
        conf.set(LIMIT_CONF, str(k))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    near = Window.partitionBy(*keys, "_salt").orderBy(*order)
    far = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_near", F.row_number().over(near))
        .filter(F.col("_near") <= k)
        .withColumn(rank, F.row_number().over(far))
        .filter(F.col(rank) <= k)
        .withColumn(rank, F.col(rank).cast("bigint"))
        .drop("_salt", "_near")
    )


def broadcast_if_bounded(df: DataFrame, groups: DataFrame, k: int, max_rows=MAX_BROADCAST_ROWS) -> DataFrame:
    """Marks a top-k result for broadcast if it is proven small: it has at most k rows per distinct row of ``groups``.

    The check reads the group columns only. Above the bound the join stays a shuffle join. Without the mark Spark would
    shuffle the big side of the join before it learns how small this one is.
    """
    n = groups.distinct().limit(max_rows // k + 1).count()
    return F.broadcast(df) if n * k <= max_rows else df
