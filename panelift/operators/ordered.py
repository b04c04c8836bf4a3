"""Order-dependent operators without a single-partition window.

Rows are range-partitioned on (unit, order), sorted inside each partition and numbered.
``_slice`` is the range partition, ``_pos`` a position that rises along the whole order.
A unit that is larger than one slice simply continues in the next one, so a unit that holds
a third of all rows is still spread evenly. Two mechanisms join the slices again:

* carry: summaries of the units that cross a slice border, prefix-combined. A slice has at most
  two such units (its first and its last), so the carried table is small and is broadcast; when
  no unit crosses a border there is nothing to carry.
* context: the last k rows before a slice are copied into it, so bounded frames
  (lag, lead, moving windows) see their neighbours.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, VariantType

from panelift.session import spill

_SHIFT = 33  # monotonically_increasing_id keeps the row position in its lower 33 bits


def order_columns(order_by: Sequence[str]) -> list[Column]:
    """'name' sorts ascending with missing values last, '-name' descending with missing last."""
    return [
        F.col(name[1:]).desc_nulls_last() if name.startswith("-") else F.col(name).asc_nulls_last()
        for name in order_by
    ]


def _same(keys: Sequence[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys])


class Sliced:
    """A frame cut into ordered slices; build it with :func:`slice_rows`."""

    def __init__(self, frame: DataFrame, unit: Sequence[str], data_columns: Sequence[str]):
        self.frame = frame
        self.unit = list(unit)
        self.columns = list(data_columns)
        self.spark = frame.sparkSession
        # One row per slice: bounded by the number of range partitions. Its first and last unit come along.
        ends = [f(F.struct(*self.unit), "_pos").alias(n) for n, f in (("first", F.min_by), ("last", F.max_by))] if self.unit else []
        rows = sorted(frame.groupBy("_slice").agg(F.count(F.lit(1)).alias("n"), *ends).collect(), key=lambda r: r["_slice"])
        self.sizes = [(r["_slice"], r["n"]) for r in rows]
        self._ends = [(r["_slice"], tuple(r["first"]), tuple(r["last"])) if self.unit else (r["_slice"], (), ()) for r in rows]

    @property
    def row_count(self) -> int:
        return sum(n for _, n in self.sizes)

    def _crossing(self) -> DataFrame | None:
        """(slice, unit) pairs whose unit goes on in the next slice or comes from the one before.

        Read off the first and last unit of each slice; None when no unit crosses a border.
        """
        if not hasattr(self, "_pairs"):
            pairs = set()
            for (a, _, left), (b, right, _) in zip(self._ends, self._ends[1:]):
                if all(x == y or (x != x and y != y) for x, y in zip(left, right)):
                    pairs |= {(a, left), (b, right)}
            self._pairs = [(s, *u) for s, u in pairs]
        if not self._pairs:
            return None
        kinds = {f.name: f.dataType.simpleString() for f in self.frame.schema.fields}
        schema = ", ".join(["_k__slice int", *[f"`_k_{c}` {kinds[c]}" for c in self.unit]])
        return self.spark.createDataFrame(self._pairs, schema)

    def numbered(self, name: str = "_row") -> DataFrame:
        """Contiguous 0-based row number over the whole order (slice offset + position)."""
        rows, before = [], 0
        for slice_id, n in self.sizes:
            rows.append((slice_id, before))
            before += n
        offsets = self.spark.createDataFrame(rows, "_slice int, _before long")
        mask = F.lit((1 << _SHIFT) - 1)
        return (
            self.frame.join(F.broadcast(offsets), "_slice")
            .withColumn(name, F.col("_before") + F.col("_pos").bitwiseAND(mask))
            .drop("_before")
        )

    def windows(self):
        """Windows inside (slice, unit), forward and backward."""
        keys = ["_slice", *self.unit]
        return (
            Window.partitionBy(*keys).orderBy("_pos"),
            Window.partitionBy(*keys).orderBy(F.col("_pos").desc()),
        )

    def scan(
        self,
        number: str | None = None,
        sums: dict[str, str] | None = None,
        last: dict[str, str] | None = None,
        following: dict[str, str] | None = None,
        frame: DataFrame | None = None,
    ) -> DataFrame:
        """Add running columns per unit, each given as {output: input}.

        ``number``: 1-based row number; ``sums``: running sum (missing counts as 0);
        ``last``: last value seen up to and including the row; ``following``: next value seen
        from the row on. Missing values are skipped by the last two.
        """
        sums, last, following = sums or {}, last or {}, following or {}
        frame = self.frame if frame is None else frame
        keys = ["_slice", *self.unit]
        pos = F.col("_pos")

        summary = [F.count(F.lit(1)).alias("_n")]
        summary += [F.sum(c).alias(f"_s_{o}") for o, c in sums.items()]
        summary += [F.max_by(c, F.when(F.col(c).isNotNull(), pos)).alias(f"_l_{o}") for o, c in last.items()]
        summary += [F.min_by(c, F.when(F.col(c).isNotNull(), pos)).alias(f"_f_{o}") for o, c in following.items()]
        crossing = self._crossing()
        carry = None
        if crossing is not None:
            borders = frame.join(F.broadcast(crossing), _same(keys, "_k_"), "left_semi")
            per_slice = borders.groupBy(*keys).agg(*summary)
            unit_keys = self.unit or [F.lit(0)]
            ahead = Window.partitionBy(*unit_keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
            behind = Window.partitionBy(*unit_keys).orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
            carried = [F.sum("_n").over(ahead).alias("_c_n")]
            carried += [F.sum(f"_s_{o}").over(ahead).alias(f"_c_s_{o}") for o in sums]
            carried += [F.last(f"_l_{o}", ignorenulls=True).over(ahead).alias(f"_c_l_{o}") for o in last]
            carried += [F.last(f"_f_{o}", ignorenulls=True).over(behind).alias(f"_c_f_{o}") for o in following]
            carry = per_slice.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *carried)

        forward, backward = self.windows()
        upto = forward.rowsBetween(Window.unboundedPreceding, 0)
        downto = backward.rowsBetween(Window.unboundedPreceding, 0)
        local = []
        if number:
            local.append(F.row_number().over(forward).cast("long").alias("_t_n"))
        local += [F.sum(c).over(upto).alias(f"_t_s_{o}") for o, c in sums.items()]
        local += [F.last(c, ignorenulls=True).over(upto).alias(f"_t_l_{o}") for o, c in last.items()]
        local += [F.last(c, ignorenulls=True).over(downto).alias(f"_t_f_{o}") for o, c in following.items()]
        joined = frame.select("*", *local)
        if carry is not None:
            # At most two rows per slice.
            joined = joined.join(F.broadcast(carry), _same(keys, "_k_"), "left")
        # Zero and missing carries where nothing crosses.
        plus = lambda name: F.coalesce(F.col(name), F.lit(0)) if carry is not None else F.lit(0)
        also = lambda name: [name] if carry is not None else []

        added = []
        if number:
            added.append((F.col("_t_n") + plus("_c_n")).alias(number))
        for o in sums:
            added.append((F.coalesce(F.col(f"_t_s_{o}"), F.lit(0)) + plus(f"_c_s_{o}")).alias(o))
        added += [F.coalesce(f"_t_l_{o}", *also(f"_c_l_{o}")).alias(o) for o in last]
        added += [F.coalesce(f"_t_f_{o}", *also(f"_c_f_{o}")).alias(o) for o in following]
        replaced = {number, *sums, *last, *following}
        return joined.select(*[c for c in frame.columns if c not in replaced], *added)

    def context(self, before: int = 0, after: int = 0) -> DataFrame:
        """Frame plus neighbour rows: column ``_own`` is false on rows copied from other slices.

        Use ``windows()`` on the result for frames of up to ``before`` rows back and ``after``
        rows ahead, then keep ``_own`` rows.
        """
        plan = []  # (source slice, target slice, rows kept from its end or start)
        for index, (target, _) in enumerate(self.sizes):
            for wanted, step in ((before, -1), (after, 1)):
                at = index + step
                while wanted > 0 and 0 <= at < len(self.sizes):
                    source, n = self.sizes[at]
                    base = source << _SHIFT
                    low, high = (base + n - wanted, base + n) if step < 0 else (base, base + wanted)
                    plan.append((source, target, low, high))
                    wanted -= n
                    at += step
        own = self.frame.withColumn("_own", F.lit(True))
        if not plan:
            return own
        copies = self.spark.createDataFrame(plan, "_slice int, _target int, _low long, _high long")
        borrowed = (
            self.frame.join(F.broadcast(copies), "_slice")
            .filter((F.col("_pos") >= F.col("_low")) & (F.col("_pos") < F.col("_high")))
            .withColumn("_slice", F.col("_target"))
            .drop("_target", "_low", "_high")
            .withColumn("_own", F.lit(False))
        )
        return own.unionByName(borrowed)

    def shifted(self, wanted: dict[str, tuple[str, int]]) -> DataFrame:
        """Add {output: (input, k)}: the value k rows earlier in the unit (negative k: later)."""
        steps = [k for _, k in wanted.values()] or [0]
        framed = self.context(max([*steps, 0]), -min([*steps, 0]))
        forward, _ = self.windows()
        added = [
            (F.lag(c, k) if k >= 0 else F.lead(c, -k)).over(forward).alias(o) for o, (c, k) in wanted.items()
        ]
        return framed.select("*", *added).filter("_own").drop("_own")

    def attach(self, rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
        """Join a table with one row per unit onto rows of these slices (inner or left).

        Units that cross a slice border, the only ones that can be larger than a slice, are at most
        one per border: their table rows are broadcast. All other units fit a slice and are joined
        by an ordinary shuffle, so no task gets more than a slice of one unit.
        """
        if not self.unit:
            keyed = table.withColumn("_one", F.lit(1))
            return rows.withColumn("_one", F.lit(1)).join(F.broadcast(keyed), "_one", how).drop("_one")
        crossing = self._crossing()
        renamed = table.withColumnsRenamed({c: f"_k_{c}" for c in self.unit})
        drop = [f"_k_{c}" for c in self.unit]
        same = _same(self.unit, "_k_")
        if crossing is None:
            return rows.join(renamed, same, how).drop(*drop)
        large = F.broadcast(crossing.drop("_k__slice").distinct())
        few = renamed.join(large.withColumnsRenamed({c: f"_l{c}" for c in drop}), _same(drop, "_l"), "left_semi")
        many = renamed.join(large.withColumnsRenamed({c: f"_l{c}" for c in drop}), _same(drop, "_l"), "left_anti")
        hot = rows.join(large, same, "left_semi").join(F.broadcast(few), same, how).drop(*drop)
        cold = rows.join(large, same, "left_anti").join(many, same, how).drop(*drop)
        return hot.unionByName(cold)

    def restore(self, df: DataFrame) -> DataFrame:
        """Drop the helper columns."""
        return df.drop("_slice", "_pos")


def slice_rows(
    df: DataFrame,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    slices: int | None = None,
) -> Sliced:
    """Range-partition ``df`` along (unit, order) and write the slices to the shared folder.

    Rows that tie in the order follow a hash of their values, so ties have one fixed order and a
    time or score shared by very many rows is spread over several slices too.
    """
    if not order_by:
        raise ValueError("an order is needed: name the columns in order_by")
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, AtomicType) and not isinstance(f.dataType, VariantType)]
    keys = [F.col(c).asc_nulls_last() for c in partition_by] + order_columns(order_by)
    if plain:
        keys.append(F.xxhash64(*plain).asc())
    placed = (
        df.repartitionByRange(slices, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pos", F.monotonically_increasing_id())
        .withColumn("_slice", F.shiftright("_pos", _SHIFT).cast("int"))
    )
    return Sliced(spill(placed, "slices"), partition_by, df.columns)


def add_row_id(df: DataFrame, order_by: Sequence[str], name: str = "id", slices: int | None = None) -> DataFrame:
    """Contiguous 0-based id as first column; fails if the column exists."""
    if name in df.columns:
        raise ValueError(f"column {name!r} already exists")
    sliced = slice_rows(df, order_by, slices=slices)
    return sliced.numbered(name).select(name, *df.columns)


def split_by_time(
    df: DataFrame, order_by: Sequence[str], share: float, name: str = "is_train", slices: int | None = None
) -> DataFrame:
    """Flag the first int((1 - share) * n) rows by order as training rows."""
    sliced = slice_rows(df, order_by, slices=slices)
    cut = int((1 - share) * sliced.row_count)
    return sliced.numbered("_row").select(*df.columns, (F.col("_row") < cut).cast("int").alias(name))


def row_range(df: DataFrame, order_by: Sequence[str], start: int, end: int, slices: int | None = None) -> DataFrame:
    """Rows at positions start..end (both included) of the order."""
    sliced = slice_rows(df, order_by, slices=slices)
    return sliced.numbered("_row").filter(F.col("_row").between(start, end)).select(*df.columns)


def add_lags(
    df: DataFrame,
    columns: Sequence[str],
    max_lag: int,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    slices: int | None = None,
) -> DataFrame:
    """Columns {name}_lag1..{name}_lag{max_lag}; without ``partition_by`` lags cross units."""
    sliced = slice_rows(df, order_by, partition_by, slices)
    wanted = {f"{c}_lag{k}": (c, k) for k in range(1, max_lag + 1) for c in columns}
    return sliced.restore(sliced.shifted(wanted))


def running_effect(
    df: DataFrame,
    actual: str,
    prediction: str,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    slices: int | None = None,
) -> DataFrame:
    """effect = actual - prediction and its running sum per unit."""
    scored = df.withColumn("effect", F.col(actual) - F.col(prediction))
    sliced = slice_rows(scored, order_by, partition_by, slices)
    return sliced.restore(sliced.scan(sums={"cumulative_effect": "effect"}))


def align_by_position(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """Row i of ``left`` (in its order) beside row i of ``right``; the longer side's rest is left out.

    The orders must be total. Column names must differ.
    """
    numbered = [slice_rows(df, list(order)).numbered("_place").select("_place", *df.columns) for df, order in ((left, left_order), (right, right_order))]
    return numbered[0].join(numbered[1], "_place").drop("_place")


def modal_step(
    df: DataFrame,
    time_column: str,
    partition_by: Sequence[str] = (),
    slices: int | None = None,
) -> DataFrame:
    """Most common positive or zero difference between neighbouring times; the smallest wins ties.

    ``time_column`` must be numeric (epoch seconds for timestamps). One row per unit.
    """
    # Rows alike are counted first: a time that stands n times has n - 1 steps of zero, and no tie is left to sort.
    times = df.filter(F.col(time_column).isNotNull()).groupBy(*partition_by, time_column).agg(F.count(F.lit(1)).alias("_times"))
    sliced = slice_rows(times, [time_column], partition_by, slices)
    placed = sliced.shifted({"_before": (time_column, 1)})
    step = F.col(time_column) - F.col("_before")
    kinds = F.array(F.struct(step.alias("step"), F.lit(1).cast("long").alias("k")), F.struct((F.col(time_column) - F.col(time_column)).alias("step"), (F.col("_times") - 1).alias("k")))
    steps = placed.select(*partition_by, F.inline(kinds)).filter("step is not null and k > 0")
    counted = steps.groupBy(*partition_by, "step").agg(F.sum("k").alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("k"), F.col("step").alias("step")))
    return counted.groupBy(*partition_by).agg(best.alias("_b")).select(
        *partition_by, F.col("_b.step").alias("step"), (-F.col("_b.k")).alias("step_count")
    )
