"""Window-like operators over ordered rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from ..streaming.keyed import Machine, over_batch


def ordinal(df: DataFrame, group: list[str], order: list, into: str, prefix: str = "p", digits: int = 5) -> DataFrame:
    """Numbers rows in order: p00001, p00002, ..."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(into, F.format_string(f"{prefix}%0{digits}d", F.row_number().over(w)))


def sessions(df: DataFrame, group: list[str], order: list, starts: Column, into: str) -> DataFrame:
    """Numbers runs of rows; a run begins where starts holds, and with the first row."""
    w = Window.partitionBy(*group).orderBy(*order)
    flagged = df.withColumn("_s", F.when((F.row_number().over(w) == 1) | F.coalesce(starts, F.lit(False)), 1).otherwise(0))
    return flagged.withColumn(into, F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def running_last(df: DataFrame, group: list[str], order: list, value: Column, into: str) -> DataFrame:
    """The last value so far that isn't null."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(into, F.last(value, ignorenulls=True).over(w))


def switched(df: DataFrame, group: list[str], order: list, on: Column, off: Column, into: str) -> DataFrame:
    """A state that on turns on and off turns off, for the row itself and those after it."""
    event = F.when(on, True).when(off, False)
    return running_last(df, group, order, event, into).withColumn(into, F.coalesce(F.col(into), F.lit(False)))


def budget_prefix(df: DataFrame, group: list[str], order: list, cost: Column, room: Column) -> DataFrame:
    """Rows taken in order until the running cost exceeds the room; costs are positive."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(cost).over(w)).where(F.col("running") <= room)


class _SkipFill(Machine):
    """Room that is left, taken up by the rows that still fit."""

    columns = ("o", "c")

    def __init__(self, room: float, kind: str):
        self.room, self.out = room, f"o {kind}"

    def start(self):
        return self.room

    def step(self, state, row):
        order, cost = row
        return (state - cost, [(order,)]) if cost is not None and cost <= state else (state, [])


def skip_fill(df: DataFrame, group: list[str], order: str, cost: str, room: float) -> DataFrame:
    """Rows taken in order while they still fit; a row that doesn't is skipped and the next is tried.

    What fits depends on all rows before, so a group is one task's; that task holds the room left, not the rows.
    """
    rows = df.select(F.struct(*group).alias("g"), F.col(order).alias("o"), F.col(cost).cast("double").alias("c"))
    taken = over_batch(rows, "g", "o", _SkipFill(float(room), df.schema[order].dataType.simpleString()))
    return df.join(taken.select("g.*", F.col("o").alias(order)), [*group, order], "left_semi")


def ranked(df: DataFrame, group: list[str], order: list[Column], into: str) -> DataFrame:
    """df with each row's place from 1 in its group, without a sort of a whole group in one task.

    Rows are dealt by ranges of group and order; a place is that in the task's part of the group plus the sizes of the parts
    before. order should leave no ties; equal rows are placed by the layout of the input.
    """
    by = [*[F.col(c) for c in group], *order]
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    rows = stored(rows.withColumn("_part", F.shiftright("_at", 33)), "ordered")
    parts = rows.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("_part").alias("_of"), *[F.col(c).alias(f"_of_{c}") for c in group], (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_from"))
    joined = rows.join(parts, [F.col("_part") == F.col("_of"), *[F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group]])
    return joined.select(*df.columns, (F.col("_at") + F.col("_from")).alias(into))


#: Slices that the values of one group are dealt to before they are ranked.
SLICES = 64


def running_sum(df: DataFrame, group: str, order: str, value: str, into: str) -> DataFrame:
    """Running sums of value by (group, order), which are unique numbers, without a sort of a whole group in one task.

    Rows are dealt to slices of equal width between a group's least and largest order; a slice's rows are
    summed by themselves, and what the slices before it hold, one aggregated row a group and slice, is added.
    """
    ends = df.groupBy(group).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    place = (F.col(order) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0)) * SLICES
    slices = df.join(ends, group).withColumn("_slice", F.coalesce(F.floor(place), F.lit(0))).drop("_lo", "_hi")
    before = slices.groupBy(group, "_slice").agg(F.sum(value).alias("_v"))
    before = before.withColumn("_before", F.sum("_v").over(Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.sum(value).over(Window.partitionBy(group, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    out = slices.withColumn("_inside", inside).join(before.drop("_v"), [group, "_slice"])
    return out.withColumn(into, F.col("_inside") + F.coalesce("_before", F.lit(0))).drop("_slice", "_inside", "_before")


def heading_parent(df: DataFrame, group: list[str], order: str, level: str, into: str, most: int = 9) -> DataFrame:
    """The order of the nearest earlier row of a lower level: one running maximum for each level, no self-join."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = df
    for k in range(most):
        out = out.withColumn(f"_last{k}", F.max(F.when(F.col(level) == k, F.col(order))).over(w))
    lower = [F.when(F.lit(k) < F.col(level), F.col(f"_last{k}")) for k in range(most)]
    return out.withColumn(into, F.greatest(*lower)).drop(*[f"_last{k}" for k in range(most)])


def overlaps(df: DataFrame, group: list[str], start: str, stop: str, into: str) -> DataFrame:
    """Whether a span runs into the next one by start."""
    w = Window.partitionBy(*group).orderBy(start, stop)
    return df.withColumn(into, F.coalesce(F.lead(start).over(w) < F.col(stop), F.lit(False)))


def page(df: DataFrame, order: list, offset: int, limit: int, group: list[str] | None = None) -> DataFrame:
    """One page with its position, the total, whether it is partial, and the next offset (null at the end).

    Each task keeps the first offset + limit rows of a group before the shuffle; totals are counted apart.
    """
    if group:
        first = df.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("position") <= offset + limit)
        rows = first.join(df.groupBy(*group).agg(F.count(F.lit(1)).alias("total")), group)
    else:
        first = df.orderBy(*order).limit(offset + limit)
        rows = first.withColumn("position", F.row_number().over(Window.orderBy(*order))).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("total"))))
    more = F.col("total") > offset + limit
    return rows.where(F.col("position") > offset).withColumn("partial", more).withColumn("next_offset", F.when(more, F.lit(offset + limit)))
