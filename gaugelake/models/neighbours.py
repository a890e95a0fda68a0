"""Distance-weighted nearest neighbours on bit sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelake.operators.similarity import most_similar


def knn_predict(queries: DataFrame, train: DataFrame, k: int = 5, target: str = "target", least: float = 1e-9, others: bool = False) -> DataFrame:
    """(entity_id, predicted): the mean target of the k most cosine-similar rows of ``train``, weighed by 1 / distance. Ties: least id; every query has a row.

    ``others``: a query's own row is no neighbour.
    """
    near = most_similar(queries, train, k, others=others, measure="cosine").join(train.select(F.col("entity_id").alias("candidate"), F.col(target).alias("y")), "candidate")
    w = 1 / F.greatest(1 - F.col("similarity"), F.lit(least))
    return near.groupBy("query").agg((F.sum(w * F.col("y")) / F.sum(w)).alias("predicted")).withColumnRenamed("query", "entity_id")


def knn_dense(queries: DataFrame, train: DataFrame, features: list[str], k: int = 5, target: str = "target", least: float = 1e-9, others: bool = False) -> DataFrame:
    """(entity_id, predicted): as knn_predict, by Euclidean distance of dense features without nulls.

    Blocks hold rows of like distance from the origin; two of them meet only if their rows can be near enough, and k rows a query leave each.
    """
    vector = F.array(*[F.col(f).cast("double") for f in features]).alias("bits")
    near = most_similar(queries.select("entity_id", vector), train.select("entity_id", vector), k, others=others, measure="euclidean")
    near = near.join(train.select(F.col("entity_id").alias("candidate"), F.col(target).alias("y")), "candidate")
    w = 1 / F.greatest(-F.col("similarity"), F.lit(least))
    return near.groupBy("query").agg((F.sum(w * F.col("y")) / F.sum(w)).alias("predicted")).withColumnRenamed("query", "entity_id")
