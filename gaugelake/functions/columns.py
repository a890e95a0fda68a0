"""Column expressions that the operators share. NaN and infinities are missing values; convert them at the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite_or_null(column: Column) -> Column:
    """A double, or null where it is NaN or infinite."""
    return F.when(~F.isnan(column) & (F.abs(column) < float("inf")), column)


def number_or_null(column: Column, kind: str = "double") -> Column:
    """The number a string holds, null where it holds none."""
    return finite_or_null(column.try_cast(kind)) if kind in ("double", "float") else column.try_cast(kind)


def present(df: DataFrame, name: str, kind: str) -> Column:
    """A column of ``df`` cast leniently to ``kind``, or nulls where there is none."""
    if name not in df.columns:
        return F.lit(None).cast(kind)
    return number_or_null(F.col(f"`{name}`"), kind) if kind == "double" else F.col(f"`{name}`").try_cast(kind)


def filled(column: Column) -> Column:
    """A trimmed string, null where nothing is left."""
    return F.nullif(F.trim(column), F.lit(""))


def slug(column: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(column), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def slug_or_error(column: Column) -> Column:
    """:func:`slug`; a name of which nothing is left ends the query."""
    made = slug(column)
    return F.when(made != "", made).when(column.isNotNull(), F.raise_error(F.concat(F.lit("no letter or digit in a name: "), column)))


def utc_now() -> Column:
    """The time of the query as ISO 8601 in UTC."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def record_id(source: Column, row: Column) -> Column:
    return F.format_string("%s:%07d", source, row)


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


# Flags are named after their threshold with one decimal, p for the point.
FLAG, RATE = "q_abs_error_gt_", "failure_rate_gt_"


def threshold_name(threshold: float, prefix: str = FLAG) -> str:
    whole, tenths = divmod(round(float(threshold) * 10), 10)
    return f"{prefix}{whole}p{tenths}"


def joined_set(column: Column, separator: str = "|") -> Column:
    """Aggregate: sorted distinct values in one string; empty when all are null."""
    return F.array_join(F.array_sort(F.collect_set(column)), separator)


def joined_list(column: Column, separator: str = "|") -> Column:
    """Aggregate: sorted values, repeats kept, in one string."""
    return F.array_join(F.array_sort(F.collect_list(column)), separator)


def first_by(column: Column, order: Column) -> Column:
    """Aggregate: the value of the least ``order`` among rows where it is not null."""
    return F.min_by(column, F.when(column.isNotNull(), order))


def share(condition: Column) -> Column:
    """Aggregate: the part of rows that meet a condition; null counts as not met."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def sample_key(seed: Column | int, name: Column) -> Column:
    """A string whose order is pseudo-random and the same in any engine with md5."""
    return F.md5(F.concat_ws(":", F.lit(seed).cast("string") if isinstance(seed, int) else seed.cast("string"), name.cast("string")))


def draw(seed: int, n: Column, *parts: Column) -> Column:
    """A pseudo-random whole number from 0 to n - 1."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long"), n)


def esol(log_p: Column, weight: Column, rotors: Column, aromatic: Column) -> Column:
    """A published linear solubility equation."""
    # Its coefficients.
    return F.lit(0.16) - 1.5 * log_p - 0.01 * weight + 0.5 * rotors - 1.5 * aromatic
