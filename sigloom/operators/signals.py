"""Daily signal operators. Every threshold is a required argument: none of
these rules has a default that could pass for somebody else's."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.operators.names import same


def daily_panel(events: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """(key, dt, total): decimal sums, so the result doesn't hang on row order."""
    return events.groupBy(F.col(key).alias("key"), F.to_date(ts).alias("dt")).agg(
        F.sum(F.col(value).cast("decimal(18,2)")).cast("decimal(38,2)").alias("total")
    )


def simple_return(panel: DataFrame, value: str = "total") -> DataFrame:
    """Adds ret, the change against the key's previous day; null on its first."""
    w = Window.partitionBy("key").orderBy("dt")
    v = F.col(value).cast("double")
    prev = F.lag(v).over(w)
    return panel.withColumn("ret", F.when(prev != 0, v / prev - 1))


def three_state(ret: Column, lo: float, hi: float) -> Column:
    """1 above hi, -1 below lo, else 0; null stays null."""
    return F.when(ret.isNull(), None).when(ret > hi, 1).when(ret < lo, -1).otherwise(0).cast("int")


def large_move(ret: Column, fall: float, rise: float) -> Column:
    """'rise', 'fall' or 'none'."""
    return F.when(ret >= rise, "rise").when(ret <= fall, "fall").otherwise("none")


def lagged_state() -> Column:
    """The state of the day before."""
    return F.lag("state").over(Window.partitionBy("key").orderBy("dt"))


def numbered_segments(states: DataFrame) -> DataFrame:
    """Adds seg, the number of a day's run of equal states within its key, from 1."""
    w = Window.partitionBy("key").orderBy("dt")
    new = (~F.col("state").eqNullSafe(lagged_state())) | (F.row_number().over(w) == 1)
    return states.withColumn("seg", F.sum(new.cast("long")).over(w))


def segments(states: DataFrame) -> DataFrame:
    """Runs of equal state per key: (key, seg, state, start_dt, end_dt, n_days)."""
    return (
        numbered_segments(states)
        .groupBy("key", "seg")
        .agg(
            F.first("state").alias("state"),
            F.min("dt").alias("start_dt"),
            F.max("dt").alias("end_dt"),
            F.count("*").alias("n_days"),
        )
    )


def transitions(states: DataFrame) -> DataFrame:
    """(key, prev_state, state, n_days, share): how often each state follows each;
    shares are of a key's previous state."""
    pairs = states.withColumn("prev_state", lagged_state()).filter("state IS NOT NULL AND prev_state IS NOT NULL")
    n = pairs.groupBy("key", "prev_state", "state").agg(F.count("*").alias("n_days"))
    return n.withColumn("share", F.col("n_days") / F.sum("n_days").over(Window.partitionBy("key", "prev_state")))


def reversals(states: DataFrame) -> DataFrame:
    """Days on which a non-zero state meets its opposite on the day before."""
    w = Window.partitionBy("key").orderBy("dt")
    return states.withColumn("prev_state", F.lag("state").over(w)).filter(
        (F.col("state") * F.col("prev_state")) == -1
    )


def zero_segment_reversals(states: DataFrame) -> DataFrame:
    """Zero runs whose neighbours have opposite signs."""
    w = Window.partitionBy("key").orderBy("seg")
    return (
        segments(states)
        .withColumn("before", F.lag("state").over(w))
        .withColumn("after", F.lead("state").over(w))
        .filter((F.col("state") == 0) & (F.col("before") * F.col("after") == -1))
    )


def nonzero_exits(states: DataFrame) -> DataFrame:
    """Days that leave a non-zero state."""
    w = Window.partitionBy("key").orderBy("dt")
    return states.withColumn("prev_state", F.lag("state").over(w)).filter(
        (F.col("prev_state") != 0) & (F.col("state") != F.col("prev_state"))
    )


def execution_dates(calendar: DataFrame) -> DataFrame:
    """Each session with the next one. The calendar is small (one row a day), so
    one partition orders it."""
    return calendar.select("dt").distinct().withColumn("execution_dt", F.lead("dt").over(Window.orderBy("dt")))


def delayed_reversals(states: DataFrame, within: int) -> DataFrame:
    """Days whose state is the opposite of the last non-zero state of the `within`
    days before; days of state 0 or null may lie between."""
    w = Window.partitionBy("key").orderBy("dt").rowsBetween(-within, -1)
    last = F.last(F.when(F.col("state") != 0, F.col("state")), ignorenulls=True).over(w)
    return states.withColumn("prev_state", last).filter((F.col("state") * F.col("prev_state")) == -1)


def confirmed_reversals(states: DataFrame, days: int) -> DataFrame:
    """Reversals whose new state is held for `days` days, the first included."""
    ahead = Window.partitionBy("key").orderBy("dt").rowsBetween(0, days - 1)
    held = F.count(F.when(F.col("state") != 0, F.col("state"))).over(ahead) == days
    one = F.min("state").over(ahead) == F.max("state").over(ahead)
    return reversals(states.withColumn("held", held & one)).filter("held").drop("held")


def holding_positions(states: DataFrame, hold: int, slice_days: int = 1000) -> DataFrame:
    """(key, dt, position, age): a non-zero state opens a position when none is
    open; it closes after `hold` days. A null state opens nothing.

    The fold is a machine with 2 hold + 1 states. Each slice of a key's days is run
    once from every state at the same time, which gives the slice's effect; the
    effects are chained along the key, one short row a slice; then each slice is run
    from the state it really begins in. The work is linear, and neither a key nor
    its result is ever in one row or one task.
    """
    own = states.select(F.col("key").alias("_key"), F.col("dt").alias("_dt"), F.coalesce(F.col("state"), F.lit(0)).cast("int").alias("_state"))
    own = own.withColumn("_slice", F.floor(F.unix_date("_dt") / F.lit(slice_days)))
    days = own.groupBy("_key", "_slice").agg(F.sort_array(F.collect_list(F.struct("_dt", "_state"))).alias("_days"))
    # A machine state is one number: position * (hold + 1 + age), 0 if none is open.
    starts = F.array(F.lit(0), *(F.lit(p * (hold + 1 + a)) for p in (1, -1) for a in range(1, hold + 1)))

    def step(at: Column, state: Column) -> Column:
        position, age = F.signum(at).cast("int"), F.abs(at) % (hold + 1)
        still = (at != 0) & (age < hold)
        opens = F.when(state != 0, F.signum(state).cast("int") * (hold + 2)).otherwise(F.lit(0))
        return F.when(still, at + position).otherwise(opens)

    ends = F.aggregate("_days", starts, lambda acc, d: F.transform(acc, lambda at: step(at, d["_state"])))
    effects = days.select("_key", "_slice", F.map_from_arrays(starts, ends).alias("_effect"))
    before = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    chained = F.aggregate(F.collect_list("_effect").over(before), F.lit(0), lambda at, e: e[at])
    starting = effects.select(F.col("_key").alias("_k"), F.col("_slice").alias("_s"), chained.alias("_at"))
    begun = days.join(starting, same([F.col("_key"), F.col("_slice")], [F.col("_k"), F.col("_s")]))
    zero = F.struct(F.col("_at").alias("at"), F.expr("cast(array() as array<int>)").alias("all"))
    run = F.aggregate(
        "_days", zero,
        lambda acc, d: F.struct(step(acc["at"], d["_state"]).alias("at"), F.concat(acc["all"], F.array(step(acc["at"], d["_state"]))).alias("all")),
        lambda acc: acc["all"],
    )
    out = begun.select("_key", F.explode(F.arrays_zip(F.col("_days._dt").alias("dt"), run.alias("at"))).alias("_d"))
    return out.select(
        F.col("_key").alias("key"), F.col("_d.dt").alias("dt"), F.signum("_d.at").cast("int").alias("position"), (F.abs("_d.at") % (hold + 1)).cast("int").alias("age")
    )


def holding_positions_long(states: DataFrame, hold: int) -> DataFrame:
    """holding_positions as a stream of sorted rows in Arrow batches: one pass, with
    a position and an age for each task; nothing of a key is held."""

    def fold(batches):
        key, position, age = object(), 0, 0
        for batch in batches:
            positions, ages = [], []
            for k, state in zip(batch.column("key").to_pylist(), batch.column("state").to_pylist()):
                if k != key:
                    key, position, age = k, 0, 0
                if position and age < hold:
                    age += 1
                else:
                    position = state or 0
                    age = int(position != 0)
                positions.append(position)
                ages.append(age)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("dt"), pa.array(positions, pa.int32()), pa.array(ages, pa.int32())], ["key", "dt", "position", "age"])

    ordered = states.select("key", "dt", "state").repartition("key").sortWithinPartitions("key", "dt")
    return ordered.mapInArrow(fold, "key string, dt date, position int, age int")
