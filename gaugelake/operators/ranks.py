"""Places and running sums in groups of any size.

Rows are sorted once over all tasks, by ranges of (group, order). Each task adds up its own rows in one streaming pass; the sums of what stands
before it come from a small table with a row for each task and group. So no window and no task holds a group, and none is dealt by group.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from gaugelake.tables import small, written

_GROUP, _TASK = "_group", "_task"


def running_sums(df: DataFrame, keys: list[str], order: list[str], names: list[str], descending: bool = False) -> DataFrame:
    """``df`` with ``before_x`` for each x of ``names`` (whole numbers): the sum over the rows of its group that come first by ``order``.

    Groups are those of equal ``keys``, nulls included. Rows equal in ``order`` may come in any sequence: count equal ones first where that matters.
    A hot value is no hot task then, and one that isn't counted first is one only as far as its rows are equal in all of ``order``.
    """
    group = F.to_json(F.struct(*[F.col(k) for k in keys]), {"ignoreNullFields": "false"}) if keys else F.lit("")
    rows, _ = written(df.withColumn(_GROUP, group), "unsorted")  # sampled for the ranges, then sorted
    ways = [F.asc(_GROUP), *[F.desc(c) if descending else F.asc(c) for c in order]]
    sorted_ = rows.repartitionByRange(*ways).sortWithinPartitions(*ways)
    extra = [StructField(_TASK, IntegerType()), *[StructField(f"before_{n}", LongType()) for n in names]]
    schema = StructType([*df.schema.fields, StructField(_GROUP, StringType()), *extra])

    def add_up(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        task, last, carried = TaskContext.get().partitionId(), None, dict.fromkeys(names, 0)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            groups = batch.column(batch.schema.get_field_index(_GROUP))
            new = np.ones(n, bool)
            new[1:] = pc.not_equal(groups.slice(1), groups.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new[0] = groups[0].as_py() != last
            start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            sums = []
            for name in names:
                x = batch.column(batch.schema.get_field_index(name)).cast(pa.int64()).to_numpy(zero_copy_only=False)
                upto = np.cumsum(x) - x
                before = upto - upto[start]
                if not new[0]:  # the first group goes on from the batch before
                    first = int(np.argmax(new)) if new.any() else n
                    before[:first] += carried[name]
                carried[name] = int(before[-1] + x[-1])
                sums.append(pa.array(before, pa.int64()))
            last = groups[n - 1].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, task, np.int32)), *sums], [*batch.schema.names, _TASK, *[f"before_{c}" for c in names]])

    summed, _ = written(sorted_.mapInArrow(add_up, schema), "summed")
    tails = summed.groupBy(_GROUP, _TASK).agg(*[F.max(F.col(f"before_{n}") + F.col(n)).alias(f"_{n}") for n in names])
    ahead = Window.partitionBy(_GROUP).orderBy(_TASK).rowsBetween(Window.unboundedPreceding, -1)  # a row for each task that has the group
    offsets, seen = written(tails.select(_GROUP, _TASK, *[F.coalesce(F.sum(f"_{n}").over(ahead), F.lit(0)).alias(f"_{n}") for n in names]), "offsets")
    out = summed.join(small(offsets, seen["n"]), [_GROUP, _TASK])
    return out.select(*df.columns, *[(F.col(f"before_{n}") + F.col(f"_{n}")).alias(f"before_{n}") for n in names])


def places(df: DataFrame, keys: list[str], order: list[str], name: str = "place") -> DataFrame:
    """``df`` with the place of each row in its group, from 1. ``order`` should tell rows apart."""
    return running_sums(df.withColumn("_one", F.lit(1)), keys, order, ["_one"]).withColumn(name, F.col("before__one") + 1).drop("_one", "before__one")
