"""One schema for sources that name and shape their columns differently."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gaugelake.functions.columns import filled, present, record_id


@dataclass
class Mapping:
    """How a source fills the common schema: a column's name, or an expression over the source's own columns."""

    source: str
    columns: dict[str, str | Callable[[DataFrame], Column]] = field(default_factory=dict)
    row_col: str | None = None


def conform(df: DataFrame, schema: StructType, mapping: Mapping) -> DataFrame:
    """``df`` in the common schema: mapped columns cast leniently, the others null; source and record_id are filled in.

    record_id is the mapped one, or the source and the row's number (``row_col``) where that is missing or blank.
    """
    out = []
    for f in schema:
        kind, how = f.dataType.simpleString(), mapping.columns.get(f.name)
        value = present(df, how, kind) if isinstance(how, str) else how(df).cast(kind) if how else F.lit(None).cast(kind)
        if f.name == "source":
            value = F.lit(mapping.source)
        elif f.name == "record_id" and mapping.row_col:
            value = F.coalesce(filled(value), record_id(F.lit(mapping.source), F.col(mapping.row_col)))
        out.append(value.alias(f.name))
    return df.select(*out)


def unify(parts: list[tuple[DataFrame, Mapping]], schema: StructType) -> DataFrame:
    """All sources, one after another, in the common schema."""
    return reduce(DataFrame.unionByName, [conform(df, schema, m) for df, m in parts])


def union_loose(parts: list[DataFrame]) -> DataFrame:
    """UNION ALL by name; a column that a part lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[filled(c) for c in columns])


def by_role(df: DataFrame, ids: list[str]) -> DataFrame:
    """Identifiers, then predictors (x_) and outcomes (y_), each in order of name."""
    roles = [sorted(c for c in df.columns if c.startswith(p)) for p in ("x_", "y_")]
    return df.select(*ids, *roles[0], *roles[1])


def without_outcome(df: DataFrame, outcome: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(inputs without the outcome, keys with the locked outcome)."""
    return df.drop(outcome), df.select(*keys, outcome, F.lit(True).alias("locked_for_model_selection"))
