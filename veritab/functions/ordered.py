"""Ordered passes over groups of any size.

A window partitioned by the group key puts a whole group into one task. Groups up to
`limit` rows take that path. Above it the table is range-partitioned on (key, order), so a
hot group spreads over many partitions; each partition is a *run*, windows work inside
(key, run), and one small row per run carries the boundary value to the next run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import pin

RUN_LIMIT = 500_000


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows in the largest group: one number, from partial counts."""
    row = df.groupBy(*keys).count().agg(F.max("count")).first()
    return row[0] or 0


def into_runs(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Range-partitioned rows with a run number.

    The number depends on sampled range bounds, so it is fixed by a checkpoint.
    """
    spread = df.repartitionByRange(*keys, *order)
    return pin(spread.withColumn("run", F.spark_partition_id()))


class Ordered:
    """Rows of `df` in `order` within `keys`; each method adds one column. No limit: groups are known to be small."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], limit: int | None = RUN_LIMIT):
        self.keys, self.order = keys, order
        self.split = limit is not None and largest_group(df, keys) > limit
        self.df = into_runs(df, keys, order) if self.split else df
        self.inner = [*keys, "run"] if self.split else keys

    def _inside(self):
        return W.partitionBy(*self.inner).orderBy(*self.order)

    def _carry(self, tail: Column, carried: Column, name: str) -> DataFrame:
        """One value per run, turned into what the runs before it hand over."""
        tails = self.df.groupBy(*self.inner).agg(tail.alias("tail"))
        return tails.withColumn(name, carried).drop("tail")

    def _before(self):
        return W.partitionBy(*self.keys).orderBy("run").rowsBetween(W.unboundedPreceding, -1)

    def row_number(self, out: str) -> Ordered:
        """1-based position in the group."""
        inside = F.row_number().over(self._inside()).cast("long")
        if not self.split:
            self.df = self.df.withColumn(out, inside)
            return self
        bases = self._carry(F.count("*"), F.coalesce(F.sum("tail").over(self._before()), F.lit(0)), "base")
        self.df = self.df.withColumn(out, inside).join(bases, self.inner).withColumn(
            out, F.col(out) + F.col("base")
        ).drop("base")
        return self

    def previous(self, values: list[str], out: str) -> Ordered:
        """Struct of `values` of the row before, null on the first row."""
        packed = F.struct(*values)
        inside = F.lag(packed).over(self._inside())
        if not self.split:
            self.df = self.df.withColumn(out, inside)
            return self
        step = F.lag("tail").over(W.partitionBy(*self.keys).orderBy("run"))
        carry = self._carry(F.max_by(packed, F.struct(*self.order)), step, "carry")
        self.df = self.df.withColumn(out, inside).join(carry, self.inner).withColumn(
            out, F.coalesce(out, "carry")
        ).drop("carry")
        return self

    def fill(self, value: str, out: str) -> Ordered:
        """The last non-null `value` up to and including the row."""
        inside = F.last(value, ignorenulls=True).over(self._inside().rowsBetween(W.unboundedPreceding, 0))
        if not self.split:
            self.df = self.df.withColumn(out, inside)
            return self
        place = F.when(F.col(value).isNotNull(), F.struct(*self.order))
        step = F.last("tail", ignorenulls=True).over(self._before())
        carry = self._carry(F.max_by(value, place), step, "carry")
        self.df = self.df.withColumn(out, inside).join(carry, self.inner).withColumn(
            out, F.coalesce(out, "carry")
        ).drop("carry")
        return self

    def running_max(self, value: str, out: str) -> Ordered:
        """Largest `value` up to and including the row."""
        inside = F.max(value).over(self._inside().rowsBetween(W.unboundedPreceding, 0))
        if not self.split:
            self.df = self.df.withColumn(out, inside)
            return self
        carry = self._carry(F.max(value), F.max("tail").over(self._before()), "carry")
        self.df = self.df.withColumn(out, inside).join(carry, self.inner).withColumn(
            out, F.greatest(out, "carry")
        ).drop("carry")
        return self

    def done(self) -> DataFrame:
        return self.df.drop("run") if self.split else self.df


def row_numbers(
    df: DataFrame, keys: list[str], order: list[str], out: str = "rn", limit: int | None = RUN_LIMIT
) -> DataFrame:
    """Add the 1-based position of each row in its group."""
    return Ordered(df, keys, order, limit).row_number(out).done()


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], values: list[str],
    out: str = "previous", limit: int = RUN_LIMIT,
) -> DataFrame:
    """Add a struct of `values` taken from the row before, null on the first row of a group."""
    return Ordered(df, keys, order, limit).previous(values, out).done()
