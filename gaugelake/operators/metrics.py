"""Regression and classification metrics by group.

Ranks and thresholds need scores in order. Rows are first counted by distinct score; sums before a score come from one sort over all tasks
(``ranks.running_sums``), so no window and no task holds a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelake.operators.ranks import running_sums
from gaugelake.tables import large, small, written


def _mean_ranks(counts: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """(keys, column, name): the mean rank of each value, of rows (keys, column, n)."""
    placed = running_sums(counts, keys, [column], ["n"])
    return placed.select(*keys, column, (F.col("before_n") + (F.col("n") + 1) / 2).alias(name))


def average_ranks(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """``df`` with the rank of ``column`` in its group; ties share their mean rank."""
    df, _ = written(df, "ranked")  # counted, then joined
    counts = df.groupBy(*keys, column).agg(F.count("*").alias("n"))
    return large(df).join(large(_mean_ranks(counts, keys, column, name)), [*keys, column])


def regression_metrics(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """rmse, mae, r2 and Spearman's rho of (truth, predicted) by group, of the rows that have both; n counts all rows. rho is null unless both have two values at least.

    Equal pairs are counted first; ranks join these counts, and a group whose keys hold nulls is a group.
    """
    named = [f"_key{i}" for i in range(len(keys))]
    # Null keys stay groups through the joins below: each key travels as a struct.
    shaped = predictions.select(*[F.struct(F.col(k)).alias(n) for k, n in zip(keys, named, strict=True)], F.col("truth").cast("double").alias("truth"), F.col("predicted").cast("double").alias("predicted"))
    pairs, _ = written(shaped.groupBy(*named, "truth", "predicted").agg(F.count("*").alias("_n")), "pairs")
    full = pairs.where("truth IS NOT NULL AND predicted IS NOT NULL")

    def ranks(column: str, name: str) -> DataFrame:
        return _mean_ranks(full.groupBy(*named, column).agg(F.sum("_n").alias("n")), named, column, name)

    ranked, _ = written(large(full).join(large(ranks("truth", "_rt")), [*named, "truth"]).join(large(ranks("predicted", "_rp")), [*named, "predicted"]), "ranked")
    w, gap, t = F.col("_n"), F.col("truth") - F.col("predicted"), F.col("truth")
    n = F.sum(w)
    # Ranks of n rows have the mean (n + 1) / 2.
    middle = (F.col("n") + 1) / 2
    out = ranked.groupBy(*named).agg(
        n.alias("n"), F.sum(w * gap * gap).alias("_sse"), F.sum(w * F.abs(gap)).alias("_sae"), F.avg(t).alias("_any"), F.sum(w * t).alias("_st"), F.count_distinct("truth").alias("_nt"), F.count_distinct("predicted").alias("_np"),
        F.sum(w * F.col("_rt") * F.col("_rp")).alias("_tp"), F.sum(w * F.col("_rt") * F.col("_rt")).alias("_tt"), F.sum(w * F.col("_rp") * F.col("_rp")).alias("_pp"),
    )
    out, seen = written(out, "sums")
    means = out.select(*named, (F.col("_st") / F.col("n")).alias("_mean"))
    spread = full.join(small(means, seen["n"]), named).groupBy(*named).agg(F.sum(w * (t - F.col("_mean")) * (t - F.col("_mean"))).alias("_sst"))
    every = pairs.groupBy(*named).agg(F.sum("_n").alias("_all"))
    out = every.join(out, named, "left").join(spread, named, "left")
    square = F.col("n") * middle * middle
    rho = F.when((F.col("_nt") > 1) & (F.col("_np") > 1), F.try_divide(F.col("_tp") - square, F.sqrt((F.col("_tt") - square) * (F.col("_pp") - square))))
    return out.select(
        *[F.col(c).getField(k).alias(k) for k, c in zip(keys, named, strict=True)], F.col("_all").alias("n"), F.sqrt(F.col("_sse") / F.col("n")).alias("rmse"), (F.col("_sae") / F.col("n")).alias("mae"),
        F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst")).alias("r2"), rho.alias("spearman"),
    )


def gaussian_nll(predictions: DataFrame, keys: list[str], floor: float = 1e-12) -> DataFrame:
    """Mean negative log-likelihood, mean sigma and coverage of the 95 % interval, of (truth, predicted, sigma)."""
    s = F.greatest(F.col("sigma"), F.lit(floor))
    z = (F.col("truth") - F.col("predicted")) / s
    return predictions.groupBy(*keys).agg(F.avg(F.ln(s) + 0.5 * F.ln(2 * F.pi()) + 0.5 * z * z).alias("nll"), F.avg(s).alias("mean_sigma"), F.avg((F.abs(z) <= 1.96).cast("double")).alias("coverage_95"))


def interval(predictions: DataFrame, z: float = 1.96) -> DataFrame:
    """Bounds of the 95 % interval."""
    return predictions.withColumns({"lower_95": F.col("predicted") - z * F.col("sigma"), "upper_95": F.col("predicted") + z * F.col("sigma")})


def classification_metrics(scored: DataFrame, keys: list[str]) -> DataFrame:
    """ROC AUC (Mann-Whitney), average precision, Brier score and log loss of (label 0/1, probability) by group; the first two are null for one class alone."""
    slim = scored.where("label IS NOT NULL AND probability IS NOT NULL").select(*keys, F.col("label").cast("long").alias("label"), F.col("probability").cast("double").alias("probability"))
    df, _ = written(slim, "scores")
    p = F.least(F.greatest(F.col("probability"), F.lit(2.220446049250313e-16)), F.lit(1 - 2.220446049250313e-16))
    loss = -F.when(F.col("label") == 1, F.ln(p)).otherwise(F.ln(1 - p))
    plain = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("label").alias("positives"), F.avg(F.pow(F.col("probability") - F.col("label"), 2)).alias("brier"), F.avg(loss).alias("log_loss"))
    counts = df.groupBy(*keys, "probability").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    placed = running_sums(counts, keys, ["probability"], ["n", "pos"], descending=True)
    # A positive ranks before the negatives below its score, and half before those at it.
    above = (F.col("before_n") - F.col("before_pos")) + (F.col("n") - F.col("pos")) / 2
    precision = (F.col("before_pos") + F.col("pos")) / (F.col("before_n") + F.col("n"))
    curves = placed.groupBy(*keys).agg(F.sum(F.col("pos") * above).alias("_lost"), F.sum(F.col("pos") * precision).alias("_ap"))
    both = (F.col("positives") > 0) & (F.col("positives") < F.col("n"))
    out = plain.join(curves, keys) if keys else plain.crossJoin(curves)
    return out.select(*keys, "n", "positives", F.when(both, 1 - F.col("_lost") / (F.col("positives") * (F.col("n") - F.col("positives")))).alias("roc_auc"), F.when(both, F.col("_ap") / F.col("positives")).alias("average_precision"), "brier", "log_loss")


def discrimination(scored: DataFrame, model: str = "model", source: str = "source") -> DataFrame:
    """Classification metrics of each model over all sources (ALL) and for each."""
    return classification_metrics(scored.withColumn(source, F.explode(F.array(F.lit("ALL"), F.col(source)))), [model, source])
