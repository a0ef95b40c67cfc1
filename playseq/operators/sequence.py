"""Ordered sequences: the window vocabulary every sequence operator is written in.

A sequence is all rows with equal ``keys``, in the order of ``order``. Operators use three verbs only:

* :meth:`Ordered.shift` reads a neighbouring row,
* :meth:`Ordered.running` accumulates a sum, minimum or maximum up to (or from) each row,
* :meth:`Ordered.total` aggregates the whole sequence.

For ordinary keys these are Spark windows on the same partitioning and order, so a chain of operators
needs one exchange and one sort. Runs that restart (islands) are expressed without another window key:
a running minimum or maximum of a struct that starts with a rising counter restarts by itself.

A key with more rows than one task should sort is cut into ordered slices (:meth:`Ordered.over`). The
same verbs then work per slice, and a table with one row per slice carries the boundary values across.
Results are the same either way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from playseq.operators.storage import filter_by_keys, written

SLICE = "_slice"
HOT_ROWS_CONF = "spark.playseq.hotRows"
HOT_ROWS = 1_000_000

_AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max}
_BEFORE = Window.unboundedPreceding
_AFTER = Window.unboundedFollowing


def _merge(how: str, left: Column, right: Column) -> Column:
    """Combine two partial results, either of which may be missing."""
    if how == "sum":
        return F.when(left.isNull(), right).when(right.isNull(), left).otherwise(left + right)
    return F.least(left, right) if how == "min" else F.greatest(left, right)


@dataclass(frozen=True)
class Ordered:
    """A keyed, ordered view of a table."""

    keys: tuple[str, ...] = ("game_id",)
    order: tuple[str, ...] = ("ord",)
    sliced: bool = False

    def by(self, *order: str) -> Ordered:
        """The same keys in another order, which must not move rows between slices."""
        return replace(self, order=order)

    @property
    def columns(self) -> list[str]:
        """Columns an operator has to carry along to stay in sequence."""
        return [*self.keys, *([SLICE] if self.sliced else [])]

    def window(self, *within: str, backwards: bool = False) -> WindowSpec:
        order = [F.col(c).desc() if backwards else F.col(c).asc() for c in self.order]
        return Window.partitionBy(*self.keys, *within).orderBy(*order)

    # -- verbs -----------------------------------------------------------------------------------

    def shift(self, df: DataFrame, **columns: tuple) -> DataFrame:
        """Add ``name=(value, offset[, default])``: the value ``offset`` rows earlier (negative: later)."""
        specs = {name: (*spec, None)[:3] for name, spec in columns.items()}
        if self.sliced:
            return self._shift_slices(df, specs)
        w = self.window()
        return df.withColumns({name: F.lag(v, k, d).over(w) for name, (v, k, d) in specs.items()})

    def running(self, df: DataFrame, *, backwards: bool = False, **columns: tuple) -> DataFrame:
        """Add ``name=(how, value[, inclusive])``: sum, min or max of all rows up to this one.

        ``backwards`` accumulates from the end; ``inclusive=False`` leaves out the row itself. An
        aggregate over no rows is null.
        """
        specs = {name: (*spec, True)[:3] for name, spec in columns.items()}
        if self.sliced:
            return self._running_slices(df, specs, backwards)
        w = self.window(backwards=backwards)
        return df.withColumns(
            {n: _AGGREGATES[how](v).over(w.rowsBetween(_BEFORE, 0 if inc else -1)) for n, (how, v, inc) in specs.items()}
        )

    def total(self, df: DataFrame, **columns: tuple) -> DataFrame:
        """Add ``name=(how, value)``: the aggregate of the whole sequence, on each of its rows."""
        if self.sliced:
            return self._total_slices(df, columns)
        w = Window.partitionBy(*self.keys)
        return df.withColumns({n: _AGGREGATES[how](v).over(w) for n, (how, v) in columns.items()})

    def number(self, df: DataFrame, name: str) -> DataFrame:
        """Add the row number, from 1, as a bigint."""
        if not self.sliced:
            return df.withColumn(name, F.row_number().over(self.window()).cast("bigint"))
        return self.running(df, **{name: ("sum", F.lit(1).cast("bigint"))})

    # -- hot keys --------------------------------------------------------------------------------

    def over(self, df: DataFrame, operator: Callable[[DataFrame, Ordered], DataFrame]) -> DataFrame:
        """Run ``operator(rows, ordered)`` on all keys, cutting those with too many rows into slices.

        One pre-aggregated count over the key columns finds hot keys; ordinary tables pay only that.
        """
        limit = int(df.sparkSession.conf.get(HOT_ROWS_CONF, str(HOT_ROWS)))
        hot = df.groupBy(*self.keys).count().where(F.col("count") > limit).select(*self.keys)
        if hot.isEmpty():
            return operator(df, self)
        hot = written(hot)
        ordinary = operator(filter_by_keys(df, hot, self.keys, keep=False), self)
        # Counting, sampling and cutting each read the hot rows, so they are computed once before.
        cut, ordered = self.slice(written(filter_by_keys(df, hot, self.keys), "hot"), limit)
        return ordinary.unionByName(operator(cut, ordered).select(*ordinary.columns))

    def slice(self, df: DataFrame, rows: int) -> tuple[DataFrame, Ordered]:
        """Range-partition by key and order and remember the partition of each row as its slice."""
        parts = max(2, -(-df.count() // max(rows, 1)))
        cut = df.repartitionByRange(parts, *self.keys, *self.order).withColumn(SLICE, F.spark_partition_id())
        return written(cut), replace(self, sliced=True)

    def _join_slices(self, df: DataFrame, per_slice: DataFrame) -> DataFrame:
        """Join one row per (keys, slice) to the rows of that slice."""
        names = [*self.keys, SLICE]
        right = per_slice.withColumnsRenamed({c: "_r_" + c for c in names})
        same = F.lit(True)
        for c in names:
            same = same & F.col(c).eqNullSafe(F.col("_r_" + c))
        return df.join(right, same, "left").drop(*["_r_" + c for c in names])

    def _running_slices(self, df: DataFrame, specs: dict, backwards: bool) -> DataFrame:
        df = written(df)
        local = self.window(SLICE, backwards=backwards)
        along = Window.partitionBy(*self.keys).orderBy(F.col(SLICE).desc() if backwards else F.col(SLICE).asc())
        sums = df.groupBy(*self.keys, SLICE).agg(*[_AGGREGATES[how](v).alias("_s_" + n) for n, (how, v, _) in specs.items()])
        carried = sums.select(
            *self.keys,
            SLICE,
            *[_AGGREGATES[how]("_s_" + n).over(along.rowsBetween(_BEFORE, -1)).alias("_c_" + n) for n, (how, _, _) in specs.items()],
        )
        here = df.withColumns(
            {"_l_" + n: _AGGREGATES[how](v).over(local.rowsBetween(_BEFORE, 0 if inc else -1)) for n, (how, v, inc) in specs.items()}
        )
        joined = self._join_slices(here, carried)
        joined = joined.withColumns({n: _merge(how, F.col("_l_" + n), F.col("_c_" + n)) for n, (how, _, _) in specs.items()})
        return joined.drop(*[p + n for n in specs for p in ("_l_", "_c_")])

    def _total_slices(self, df: DataFrame, specs: dict) -> DataFrame:
        df = written(df)
        sums = df.groupBy(*self.keys, SLICE).agg(*[_AGGREGATES[how](v).alias("_s_" + n) for n, (how, v) in specs.items()])
        whole = Window.partitionBy(*self.keys)
        totals = sums.select(*self.keys, SLICE, *[_AGGREGATES[how]("_s_" + n).over(whole).alias(n) for n, (how, _) in specs.items()])
        return self._join_slices(df, totals)

    def _shift_slices(self, df: DataFrame, specs: dict) -> DataFrame:
        back = max([k for _, k, _ in specs.values() if k > 0], default=0)
        ahead = max([-k for _, k, _ in specs.values() if k < 0], default=0)
        values = F.struct(*[v.alias(f"v{i}") for i, (v, _, _) in enumerate(specs.values())])
        w = self.window(SLICE)
        here = written(
            df.withColumns(
                {
                    "_value": values,
                    "_first": F.row_number().over(w),
                    "_last": F.row_number().over(self.window(SLICE, backwards=True)),
                }
            )
        )
        # At most `back` rows at the end and `ahead` rows at the start of each slice matter outside it.
        edges = here.where((F.col("_last") <= back) | (F.col("_first") <= ahead)).groupBy(*self.keys, SLICE).agg(
            F.sort_array(F.collect_list(F.when(F.col("_last") <= back, F.struct("_first", "_value")))).alias("_tail"),
            F.sort_array(F.collect_list(F.when(F.col("_first") <= ahead, F.struct("_first", "_value")))).alias("_head"),
        )
        along = Window.partitionBy(*self.keys).orderBy(SLICE)
        around = edges.select(
            *self.keys,
            SLICE,
            F.flatten(F.collect_list("_tail").over(along.rowsBetween(-max(back, 1), -1))).alias("_before"),
            F.flatten(F.collect_list("_head").over(along.rowsBetween(1, max(ahead, 1)))).alias("_after"),
        )
        out = self._join_slices(here, around)
        added = {}
        for i, (name, (_, k, default)) in enumerate(specs.items()):
            inside = F.lag(F.col("_value")[f"v{i}"], k).over(w)
            if k > 0:
                position, edge = F.size("_before") + F.col("_first") - 1 - k, F.col("_before")
                is_inside = F.col("_first") > k
            else:
                position, edge = -k - F.col("_last"), F.col("_after")
                is_inside = F.col("_last") > -k
            exists = (position >= 0) & (position < F.size(edge))
            outside = F.when(exists, F.get(edge, position)["_value"][f"v{i}"]).otherwise(F.lit(default))
            added[name] = F.when(is_inside, inside).otherwise(outside)
        return out.withColumns(added).drop("_value", "_first", "_last", "_before", "_after")


GAME = Ordered()
