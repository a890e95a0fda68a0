"""Exact quantiles of groups of any size, all groups and fractions at once, by radix selection.

Values become whole numbers in the same order, and a slim table of (group, number) is written once. Each pass counts the rows of every part
of the number line that still holds a wanted place, by its next 16 bits, and goes on with the parts where places fall. Four passes fix all 64
bits; mostly fewer do, as a part with one distinct value is settled. A histogram has 65,536 rows at most, whatever the group's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugelake.tables import small, written

#: Bits that are still open after each pass.
_OPEN = (48, 32, 16, 0)


def order_key(value: Column) -> Column:
    """A long that grows with a double: its exponent and mantissa, negated below zero. Both zeros share one; NaN comes last."""
    size = F.abs(value)
    near = F.floor(F.log2(size)).try_cast("int")  # off by one at most, near powers of two
    power = lambda e: F.pow(F.lit(2.0), e.cast("double"))  # noqa: E731  exact
    exponent = near + F.when(size >= 2 * power(near), 1).when(size < power(near), -1).otherwise(0)
    mantissa = ((size / power(exponent) - 1) * float(1 << 52)).try_cast("long")
    normal = (exponent + 1023).cast("long") * F.lit(1 << 52) + mantissa
    tiny = (size * float(2.0**1022) * float(1 << 52)).try_cast("long")  # below the least normal number
    infinite = F.lit(2047 << 52)
    bits = F.when(size == 0, F.lit(0).cast("long")).when(size == float("inf"), infinite).when(size < 2.0**-1022, tiny).otherwise(normal)
    return F.when(F.isnan(value), infinite + 1).when(value < 0, -bits).otherwise(bits)


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """(keys, a column for each fraction): linear quantiles of the values that are not null; null keys are a group, groups without a value have no row."""
    group = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]) if keys else F.struct(F.lit(0).alias("k0"))
    slim = df.select(group.alias("g"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL").withColumn("k", order_key(F.col("v")))
    slim, _ = written(slim, "values")
    wanted, seen = None, {}
    for open_ in _OPEN:
        part = F.shiftright("k", open_).alias("part")
        found = [F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")]
        if wanted is None:
            counts = slim.groupBy("g", part).agg(*found).withColumn("within", F.lit(0).cast("long"))
        else:
            held = small(wanted.select(F.col("g").alias("_g"), F.col("part").alias("within"), "places"), seen["n"])
            rows = slim.join(held, (F.col("g") == F.col("_g")) & (F.shiftright("k", open_ + 16) == F.col("within")))
            counts = rows.groupBy("g", "within", part).agg(*found, F.first("places").alias("places"))
        all_ = Window.partitionBy("g", "within")  # a histogram: 65,536 rows at most
        counts = counts.withColumns({"all": F.sum("n").over(all_), "before": F.coalesce(F.sum("n").over(all_.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
        if wanted is None:
            counts = counts.withColumn("places", F.array(*[p for name, q in fractions.items() for p in _places(name, q)]))
        mine = F.filter("places", lambda p: (p["place"] >= F.col("before")) & (p["place"] < F.col("before") + F.col("n")))
        moved = F.transform(mine, lambda p: F.struct(p["name"].alias("name"), p["upper"].alias("upper"), p["rest"].alias("rest"), (p["place"] - F.col("before")).alias("place")))
        hit = counts.select("g", "part", "low", "high", moved.alias("places")).where(F.size("places") > 0)
        wanted, seen = written(hit, "places", open=F.count_if(F.col("low") < F.col("high")))
        if not seen.get("open"):
            break
    each = wanted.select("g", "low", F.explode("places").alias("p")).select("g", "low", "p.*")
    at = lambda name, upper: F.max(F.when((F.col("name") == name) & (F.col("upper") == upper), F.col("low")))
    rest = lambda name: F.max(F.when(F.col("name") == name, F.col("rest")))
    values = [(at(n, False) * (1 - rest(n)) + at(n, True) * rest(n)).alias(n) for n in fractions]
    return each.groupBy("g").agg(*values).select(*[F.col("g").getField(f"k{i}").alias(k) for i, k in enumerate(keys)], *fractions)


def _places(name: str, fraction: float) -> list[Column]:
    """The two places, from 0, between which a quantile of ``all`` values lies, and how far from the first."""
    at = F.lit(float(fraction)) * (F.col("all") - 1)
    made = lambda upper, place: F.struct(F.lit(name).alias("name"), F.lit(upper).alias("upper"), (at - F.floor(at)).alias("rest"), place.cast("long").alias("place"))
    return [made(False, F.floor(at)), made(True, F.ceil(at))]


def with_quantiles(summary: DataFrame, df: DataFrame, keys: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """A summary by ``keys`` with these quantiles of ``df``."""
    found = grouped_quantiles(df, keys, value, fractions)
    right = found.select(*[F.col(k).alias(f"_q_{k}") for k in keys], *fractions)
    on = [F.col(k).eqNullSafe(F.col(f"_q_{k}")) for k in keys]
    return summary.join(right, on, "left").drop(*[f"_q_{k}" for k in keys])
