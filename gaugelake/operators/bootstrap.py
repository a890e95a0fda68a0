"""Cluster bootstraps: whole clusters are drawn, by md5 of seed, iteration and draw. Rows are summed by cluster first, so draws meet clusters, never rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugelake.functions.columns import draw
from gaugelake.tables import written


def _drawn(clusters: DataFrame, keys: list[str], iterations: int, seed: int) -> DataFrame:
    """``clusters`` (one row for each of a group) as drawn: as many draws as clusters in each iteration."""
    own, all_ = Window.partitionBy(*keys).orderBy("cluster"), Window.partitionBy(*keys)
    numbered = clusters.withColumns({"_k": F.row_number().over(own) - 1, "_n": F.count("*").over(all_)})
    turns = numbered.select(*keys, "_k", "_n").withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    picks = turns.select(*keys, "iteration", draw(seed, F.col("_n"), F.col("iteration"), F.col("_k")).alias("_k"))
    return picks.join(numbered.drop("_n"), [*keys, "_k"])


def cluster_bootstrap(rows: DataFrame, keys: list[str], cluster: str, value: str, iterations: int = 2000, seed: int = 20260309) -> DataFrame:
    """estimate (pooled mean of rows) of each group and its 95 % interval under draws of whole clusters."""
    sums = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(cluster).alias("cluster")).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count(value).alias("c"))
    clusters, _ = written(sums, "clusters")  # for the estimate, the numbers and the draws
    means = _drawn(clusters, keys, iterations, seed).groupBy(*keys, "iteration").agg((F.sum("s") / F.sum("c")).alias("m"))
    spread = means.groupBy(*keys).agg(F.percentile("m", F.lit(0.025)).alias("lower_95"), F.percentile("m", F.lit(0.975)).alias("upper_95"))
    plain = clusters.groupBy(*keys).agg((F.sum("s") / F.sum("c")).alias("estimate"), F.count("*").alias("clusters"))
    return plain.join(spread, keys)


def paired_bootstrap(differences: DataFrame, keys: list[str], cluster: str, value: str = "difference", lower_is_better: bool = True, iterations: int = 2000, seed: int = 20260309) -> DataFrame:
    """Mean difference, and interval and chance to be better of the mean of cluster means under draws of clusters.

    The pooled bootstrap above weighs rows, this one clusters: they agree only when clusters are of one size.
    """
    sums = differences.groupBy(*keys, F.col(cluster).alias("cluster")).agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.count(value).alias("c"))
    clusters, _ = written(sums, "clusters")
    means = _drawn(clusters, keys, iterations, seed).groupBy(*keys, "iteration").agg(F.avg("m").alias("b"))
    better = F.col("b") < 0 if lower_is_better else F.col("b") > 0
    spread = means.groupBy(*keys).agg(F.percentile("b", F.lit(0.025)).alias("lower_95"), F.percentile("b", F.lit(0.975)).alias("upper_95"), F.avg(better.cast("double")).alias("probability_better"))
    plain = clusters.groupBy(*keys).agg((F.sum("s") / F.sum("c")).alias("paired_difference"), F.count("*").alias("clusters"))
    return plain.join(spread, keys)
