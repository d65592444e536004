"""Operators on ordered rows: every relation has a stream key and an explicit ordinal.

Each takes and returns a DataFrame. Windows are always partitioned by the stream, so a plan has one shuffle by stream
key that later steps with the same key reuse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

Keys = list[str]


def ordered(keys: Keys, *order: str) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(*order)


def exclusive_sum(df: DataFrame, keys: Keys, order: Keys, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows before: decode times from deltas, byte offsets from sizes."""
    running = F.sum(value).over(ordered(keys, *order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn(out, running - F.col(value))


def exclusive_sum_by_range(df: DataFrame, keys: Keys, order: str, value: str, out: str, width: int = 1 << 16) -> DataFrame:
    """The same in two levels, for few keys with many rows each: ``order`` is a whole number, and rows meet in ranges of
    ``width`` of it; only the ranges' totals are summed up over a whole key."""
    part, before = "__framewright_range", "__framewright_before"
    ranged = df.withColumn(part, F.floor(F.col(order) / width))
    totals = ranged.groupBy(*keys, part).agg(F.sum(value).alias(before))
    totals = exclusive_sum(totals, keys, [part], before, out).select(*keys, part, F.col(out).alias(before))
    inside = exclusive_sum(ranged, [*keys, part], [order], value, out).join(totals, [*keys, part])
    return inside.withColumn(out, F.col(out) + F.col(before)).select(*df.columns, out)


def expand_runs(df: DataFrame, count: str, ordinal: str = "i") -> DataFrame:
    """One row for each of ``count`` repetitions; a run of none gives no row."""
    return df.where(F.col(count) > 0).withColumn(ordinal, F.explode(F.sequence(F.lit(0).cast("long"), F.col(count).cast("long") - 1)))


def runs_as_intervals(runs: DataFrame, keys: Keys, first: str, end: str = "end_excl") -> DataFrame:
    """Gives each run the start of the next one as its end; the last run is open (null)."""
    return runs.withColumn(end, F.lead(first).over(ordered(keys, first)))


def as_of_run(rows: DataFrame, runs: DataFrame, keys: Keys, at: str, first: str, values: Keys) -> DataFrame:
    """For each row the values of the last run that starts at or before ``at`` (null if none does).

    Both sides are sorted together once and the last run is carried forward, which is linear; no range join.
    """
    tag = "__framewright_run"
    carried = F.struct(*values)
    other = [c for c in rows.columns if c not in (*keys, at)]
    left = rows.select(*keys, at, F.struct(*other, F.lit(1).alias("__framewright_row")).alias("row"), F.lit(None).cast(runs.select(carried.alias("v")).schema["v"].dataType).alias(tag))
    right = runs.select(*keys, F.col(first).alias(at), F.lit(None).cast(left.schema["row"].dataType).alias("row"), carried.alias(tag))
    both = right.unionByName(left)
    w = W.partitionBy(*keys).orderBy(F.col(at), F.col("row").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn(tag, F.last(tag, ignorenulls=True).over(w)).where("row is not null")
    return found.select(*keys, at, *(F.col(f"row.{c}").alias(c) for c in other), *(F.col(f"{tag}.{v}").alias(v) for v in values))


def suffix_min(df: DataFrame, keys: Keys, order: Keys, value: str, out: str) -> DataFrame:
    """Least value from this row on: a picture may be shown once nothing behind it is earlier."""
    return df.withColumn(out, F.min(value).over(ordered(keys, *order).rowsBetween(0, W.unboundedFollowing)))


def presentation_order(df: DataFrame, keys: Keys, pts: str, order: str, out: str) -> DataFrame:
    """Rank by presentation time; equal times keep decode order."""
    return df.withColumn(out, F.row_number().over(ordered(keys, pts, order)).cast("long"))


def seek_start(df: DataFrame, keys: Keys, order: str, pts: str, key_frame: Column, at: Column, out: str = "start") -> DataFrame:
    """The last keyframe, in decode order, shown at or before ``at``; 0 if there is none."""
    hit = F.max(F.when(key_frame & (F.col(pts) <= at), F.col(order)))
    return df.groupBy(*keys).agg(F.coalesce(hit, F.lit(0).cast("long")).alias(out))


def audio_seek_start(df: DataFrame, keys: Keys, order: str, pts: str, at: Column, back: int = 2, out: str = "start") -> DataFrame:
    """``back`` packets before the first one at or after ``at``, not below 0; one past the end counts as found."""
    first = F.coalesce(F.min(F.when(F.col(pts) >= at, F.col(order))), F.max(order) + 1)
    return df.groupBy(*keys).agg(F.greatest(first - back, F.lit(0)).cast("long").alias(out))


def interleave(audio: DataFrame, video: DataFrame, keys: Keys, offset: str, out: str = "position") -> DataFrame:
    """Both tracks' packets in file order; equal offsets put audio first."""
    both = audio.withColumn("track", F.lit("audio")).unionByName(video.withColumn("track", F.lit("video")))
    return both.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(F.col(offset), F.col("track") != "audio", *[c for c in audio.columns if c not in (*keys, offset)])).cast("long"))


def drop_adjacent_repeats(df: DataFrame, keys: Keys, order: Keys, value: str) -> DataFrame:
    """Rows that don't equal the row before them in ``value``."""
    mark = "__framewright_before"
    before = F.lag(value).over(ordered(keys, *order))
    return df.withColumn(mark, before).where(F.col(mark).isNull() | ~F.col(mark).eqNullSafe(F.col(value))).drop(mark)


def continuity(df: DataFrame, keys: Keys, order: Keys, counter: str, packet: str | None = None, modulus: int = 16, out: str = "lost") -> DataFrame:
    """True where the counter isn't the one before plus 1. With ``packet``, exact repetitions are dropped first."""
    if packet:
        df = drop_adjacent_repeats(df, keys, order, packet)
    before = F.lag(counter).over(ordered(keys, *order))
    return df.withColumn(out, F.coalesce(F.col(counter) != F.pmod(before + 1, F.lit(modulus)), F.lit(False)))


def islands(df: DataFrame, keys: Keys, order: Keys, starts: Column, out: str) -> DataFrame:
    """Number of starts up to this row: packets belong to the unit whose start came last; 0 is before any."""
    return df.withColumn(out, F.sum(starts.cast("long")).over(ordered(keys, *order).rowsBetween(W.unboundedPreceding, 0)))


def assemble(df: DataFrame, keys: Keys, order: str, payload: str, out: str = "data") -> DataFrame:
    """Payloads of each group joined in order; a group is one coded unit."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.hex(payload).alias("p"))))
    return df.groupBy(*keys).agg(F.unhex(F.array_join(F.transform(rows, lambda r: r["p"]), "")).alias(out))


def carry_forward(df: DataFrame, keys: Keys, order: Keys, value: str, out: str) -> DataFrame:
    """The last value that isn't null up to this row."""
    return df.withColumn(out, F.last(value, ignorenulls=True).over(ordered(keys, *order).rowsBetween(W.unboundedPreceding, 0)))


def clock_from_anchors(df: DataFrame, keys: Keys, order: Keys, anchor: str, samples: str, rate: int, scale: int, out: str) -> DataFrame:
    """Ticks of a frame: the last anchor at or before it plus the samples since, by one division; null before any."""
    group, since = "__framewright_group", "__framewright_since"
    df = islands(df, keys, order, F.col(anchor).isNotNull(), group)
    w = W.partitionBy(*keys, group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn(since, F.sum(samples).over(w) - F.col(samples))
    at = F.first(anchor, ignorenulls=True).over(w) + F.expr(f"cast({since} as bigint) * {scale} div {rate}")
    return df.withColumn(out, F.when(F.col(group) > 0, at)).drop(group, since)


def implicit_offsets(df: DataFrame, keys: Keys, order: Keys, uri: str, offset: str, length: str, out: str = "resolved_offset") -> DataFrame:
    """Byte ranges without an offset go on where the segment before ended, if it has the same URI and a range.

    Null where there is no range, and for an implicit range with no such segment before it; ``valid`` tells them apart.
    """
    group = "__framewright_group"
    w = ordered(keys, *order)
    goes_on = F.col(offset).isNull() & F.col(length).isNotNull() & F.lag(uri).over(w).eqNullSafe(F.col(uri)) & F.lag(length).over(w).isNotNull()
    df = df.withColumn(group, F.sum((~goes_on).cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    run = W.partitionBy(*keys, group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    start = F.first(offset).over(run) + F.sum(length).over(run) - F.col(length)
    df = df.withColumn(out, F.when(F.col(length).isNotNull(), start)).drop(group)
    return df.withColumn("valid", F.col(length).isNull() | F.col(out).isNotNull())


def unwrap(df: DataFrame, keys: Keys, order: Keys, value: str, bits: int, out: str) -> DataFrame:
    """Counter values of ``bits`` bits made monotonic-ish: half a turn up or more than half down changes the turn."""
    turn, half = 1 << bits, 1 << (bits - 1)
    w = ordered(keys, *order)
    d = F.col(value) - F.lag(value).over(w)
    step = "__framewright_step"
    df = df.withColumn(step, F.when(d <= -half, turn).when(d > half, -turn).otherwise(0).cast("long"))
    return df.withColumn(out, F.col(value) + F.sum(step).over(w.rowsBetween(W.unboundedPreceding, 0))).drop(step)


def block_durations(df: DataFrame, keys: Keys, order: Keys, window: str, out: str) -> DataFrame:
    """Overlapped blocks give a quarter of the window before plus a quarter of their own; the first gives half."""
    before = F.lag(window, 1).over(ordered(keys, *order))
    return df.withColumn(out, F.when(before.isNull(), F.expr(f"{window} div 2")).otherwise(F.expr("0") + F.floor(before / 4) + F.floor(F.col(window) / 4)).cast("long"))


def trimmed(df: DataFrame, front: Column, tail: Column, samples: str) -> DataFrame:
    """The samples without ``front`` ones at the start and ``tail`` at the end."""
    return df.withColumn(samples, F.slice(samples, front.cast("int") + 1, F.greatest(F.size(samples) - front - tail, F.lit(0)).cast("int")))


def spread_trim(df: DataFrame, keys: Keys, order: Keys, frames: str, front: str, tail: str) -> DataFrame:
    """Padding of a block shared out over its packets: ``front`` from the first on, ``tail`` from the last back."""
    w = ordered(keys, *order)
    total = F.sum(frames).over(W.partitionBy(*keys))
    before = F.sum(frames).over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col(frames)
    behind = total - before - F.col(frames)
    return df.withColumns({"trim_front": F.least(F.greatest(F.col(front) - before, F.lit(0)), F.col(frames)), "trim_tail": F.least(F.greatest(F.col(tail) - behind, F.lit(0)), F.col(frames)), "valid": F.col(front) + F.col(tail) <= total})


def bounded_reorder(df: DataFrame, keys: Keys, order: str, pts: str, capacity: int, out: str = "released_at") -> DataFrame:
    """Decode step at which a picture leaves a reorder buffer of ``capacity``: once more than that many wait.

    A picture leaves when ``capacity`` later-shown ones have arrived, at its own step at the earliest; null: at the end.
    """
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(pts).alias("p")))).alias("all"))

    def step(state: Column, x: Column) -> Column:
        waiting = F.array_sort(F.concat(state["waiting"], F.array(F.struct(x["p"].alias("p"), x["o"].alias("o")))))
        over = F.size(waiting) > capacity
        return F.struct(
            F.when(over, F.slice(waiting, 2, capacity)).otherwise(waiting).alias("waiting"),
            F.when(over, F.concat(state["out"], F.array(F.struct(waiting[0]["o"].alias("o"), x["o"].alias("r"))))).otherwise(state["out"]).alias("out"),
        )

    start = F.expr(f"named_struct('waiting', cast(array() as array<struct<p:{dict(df.dtypes)[pts]},o:{dict(df.dtypes)[order]}>>), 'out', cast(array() as array<struct<o:{dict(df.dtypes)[order]},r:{dict(df.dtypes)[order]}>>))")
    released = rows.select(*keys, F.explode(F.aggregate("all", start, step)["out"]).alias("e")).select(*keys, F.col("e.o").alias(order), F.col("e.r").alias(out))
    return df.join(released, [*keys, order], "left")


def repeated(df: DataFrame, keys: Keys) -> DataFrame:
    """Keys that occur more than once, with how often: must be empty where they have to be unique."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def not_appended(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of an earlier snapshot that a later one lacks: must be empty where tables only grow."""
    return old.exceptAll(new)
