"""Row numbers, running sums and previous-row values inside ordered groups of any size.

A plain window sorts each group in one task. Here a hot group is cut into consecutive slices,
the window runs per slice, and one summary row per slice carries the state across the cuts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxline.operators.hot import HOT_ROWS, hot_keys, null_safe_join, split_hot
from boxline.session import pin

WHOLE = -1


class OrderedGroups:
    """Rows of ``df`` grouped by ``keys`` and ordered by ``order`` (which must end in a unique id).

    Hot groups are found by a count of the key columns and cut by a range partitioning of their
    rows only. Pass ``hot`` to reuse keys already found, or ``detect=False`` when groups are small
    by construction.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: list[str],
        order: list[Column | str],
        limit: int = HOT_ROWS,
        hot: DataFrame | None = None,
        detect: bool = True,
    ):
        self.keys = list(keys)
        self.order = [F.col(o) if isinstance(o, str) else o for o in order]
        if hot is None and detect:
            hot = hot_keys(df, self.keys, limit)
        if hot is None:
            self.sliced = False
            self.rows = df.withColumn("_slice", F.lit(WHOLE))
            return
        self.sliced = True
        light, heavy = split_hot(df, hot, self.keys)
        total = hot.agg(F.sum("_rows")).first()[0]
        cuts = math.ceil(total / limit) + 1
        heavy = pin(
            heavy.repartitionByRange(cuts, *[F.col(k) for k in self.keys], *self.order)
            .withColumn("_slice", F.spark_partition_id())
        )
        self.rows = light.withColumn("_slice", F.lit(WHOLE)).unionByName(heavy)

    def _derive(self, rows: DataFrame) -> OrderedGroups:
        made = object.__new__(OrderedGroups)
        made.keys, made.order, made.sliced, made.rows = self.keys, self.order, self.sliced, rows
        return made

    @property
    def _window(self):
        parts = [*self.keys, "_slice"] if self.sliced else self.keys
        return Window.partitionBy(*parts).orderBy(*self.order)

    @property
    def _slices(self):
        return Window.partitionBy(*self.keys).orderBy("_slice")

    def _carried(self, rows: DataFrame, summary: DataFrame, carry: Column) -> DataFrame:
        """``rows`` with ``_carry``, computed over the slice summaries of each cut group."""
        edge = (
            summary.withColumn("_carry", carry)
            .where(F.col("_carry").isNotNull())
            .select(*self.keys, "_slice", "_carry")
        )
        return null_safe_join(rows, edge, [*self.keys, "_slice"], "left")

    def _cut_rows(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.col("_slice") != WHOLE)

    def running_sum(self, value: Column, name: str) -> OrderedGroups:
        """Adds the inclusive running sum of ``value``."""
        frame = self._window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        if not self.sliced:
            return self._derive(self.rows.withColumn(name, F.sum(value).over(frame)))
        rows = self.rows.withColumn("_v", value)
        summary = self._cut_rows(rows).groupBy(*self.keys, "_slice").agg(F.sum("_v").alias("_t"))
        before = self._slices.rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_local", F.sum("_v").over(frame))
        rows = self._carried(rows, summary, F.sum("_t").over(before))
        return self._derive(
            rows.withColumn(name, F.col("_local") + F.coalesce(F.col("_carry"), F.lit(0)))
            .drop("_v", "_local", "_carry")
        )

    def row_number(self, name: str) -> OrderedGroups:
        """Adds the 1-based position of each row in its group."""
        if not self.sliced:
            return self._derive(self.rows.withColumn(name, F.row_number().over(self._window)))
        summary = (
            self._cut_rows(self.rows).groupBy(*self.keys, "_slice")
            .agg(F.count(F.lit(1)).alias("_t"))
        )
        before = self._slices.rowsBetween(Window.unboundedPreceding, -1)
        rows = self.rows.withColumn("_local", F.row_number().over(self._window))
        rows = self._carried(rows, summary, F.sum("_t").over(before))
        return self._derive(
            rows.withColumn(name, F.col("_local") + F.coalesce(F.col("_carry"), F.lit(0)))
            .drop("_local", "_carry")
        )

    def previous(self, values: dict[str, Column]) -> OrderedGroups:
        """Adds each value as it stands in the row before (null in the first row of a group)."""
        packed = F.struct(*[v.alias(n) for n, v in values.items()])
        rows = self.rows.withColumn("_own", packed)
        rows = rows.withColumn("_prev", F.lag("_own").over(self._window))
        if self.sliced:
            ends = (
                self._cut_rows(rows)
                .withColumn("_next", F.lead(F.lit(1)).over(self._window))
                .where(F.col("_next").isNull())
            )
            rows = self._carried(rows, ends, F.lag("_own").over(self._slices))
            rows = rows.withColumn("_prev", F.coalesce("_prev", "_carry")).drop("_carry")
        for name in values:
            rows = rows.withColumn(name, F.col("_prev")[name])
        return self._derive(rows.drop("_own", "_prev"))

    def with_columns(self, columns: dict[str, Column]) -> OrderedGroups:
        """Adds row-wise columns without losing the grouping."""
        return self._derive(self.rows.withColumns(columns))

    def frame(self) -> DataFrame:
        """The rows as a plain DataFrame."""
        return self.rows.drop("_slice")


def ranked(
    df: DataFrame, keys: list[str], order: list[Column | str], name: str, **options
) -> DataFrame:
    """``row_number`` of each row in its group, safe for hot groups."""
    return OrderedGroups(df, keys, order, **options).row_number(name).frame()


def first_rows(
    df: DataFrame, keys: list[str], order: list[Column | str], count: int, name: str = "rank"
) -> DataFrame:
    """The first ``count`` rows of each group with their rank.

    Spark keeps only ``count`` rows per group and task before the shuffle, so a hot group sends
    few rows.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= count)


def slice_rows(
    df: DataFrame, position: str, size: int, before: int = 0, after: int = 0
) -> DataFrame:
    """Cuts groups whose rows carry a dense 0-based ``position`` into slices of ``size`` rows.

    Adds ``_slice`` and ``_own``. A slice also holds copies (``_own`` false) of the ``before``
    rows ahead of it and the ``after`` rows behind it, so that a short window needs no other slice.
    """
    home = F.floor(F.col(position) / size).cast("int")
    if not before and not after:
        return df.withColumns({"_slice": home, "_own": F.lit(True)})
    offset = F.pmod(F.col(position), F.lit(size))
    places = F.array_compact(F.array(
        home,
        F.when((offset < after) & (home > 0), home - 1),
        F.when(offset >= size - before, home + 1) if before else F.lit(None).cast("int"),
    ))
    return (
        df.withColumn("_home", home)
        .withColumn("_slice", F.explode(places))
        .withColumn("_own", F.col("_slice") == F.col("_home"))
        .drop("_home")
    )


def with_group_totals(sliced: DataFrame, keys: list[str], totals: dict[str, Column]) -> DataFrame:
    """Joins whole-group aggregates to rows that carry ``_slice``.

    The totals are repeated once per slice and joined on (keys, slice), so no task receives more
    than one slice of a hot group.
    """
    per_key = sliced.groupBy(*keys).agg(
        *[value.alias(name) for name, value in totals.items()], F.max("_slice").alias("_last")
    )
    per_slice = per_key.withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), F.col("_last")))
    ).drop("_last")
    return null_safe_join(sliced, per_slice, [*keys, "_slice"], "inner")
