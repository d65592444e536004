"""Queries on ordered sample streams: timing, offsets, seeking, interleaving, assembly and validation.

The tables hold no media bytes, so rows stand for them: in ``events`` ``event_type`` is the track, ``user_id`` the
stream, ``event_id`` the ordinal and ``length(props)`` the size; in ``lineitem`` an order is a chunk and a line a sample;
``part`` gives chunk runs. Line numbers repeat within an order, so ties break by the other columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import containers as C
from framewright.operators import sequence as S

STREAM = ["user_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.length("props").cast("long").alias("size"), "value")


LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def interleave_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of each stream from the last keyframe at or before its middle, in byte order."""
    e = S.exclusive_sum(units(spark, sf_dir), STREAM, ["event_id"], "size", "byte_offset")
    e = S.presentation_order(e, STREAM, "event_id", "event_id", "dts").withColumn("dts", F.col("dts") - 1)
    e = e.withColumn("is_key", F.col("event_type") == "purchase")
    seek = e.groupBy(*STREAM).agg(F.floor(F.max("dts") / 2).alias("seek_dts"))
    e = e.join(seek, STREAM)
    start = S.seek_start(e, STREAM, "dts", "dts", F.col("is_key"), F.col("seek_dts"), "start_dts")
    return e.join(start, STREAM).where("dts >= start_dts").select("user_id", "event_id", "event_type", "byte_offset", "size", "dts", "is_key")


def decode_time_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decode times of each track: the sizes before, as deltas."""
    return S.exclusive_sum_by_range(units(spark, sf_dir), ["event_type"], "event_id", "size", "decode_time").select("event_type", "event_id", "decode_time")


def rle_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-length entries of all orders written out; the quantity is the run's length."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"))
    return S.expand_runs(li, "q").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("sum_i"))


def chunk_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each line's part key the last run of all parts that starts at or before it, by the supplier's bucket."""
    runs = table(spark, sf_dir, "part").select((F.col("p_size") % 10).alias("bucket"), F.col("p_partkey").alias("first"), "p_size")
    rows = table(spark, sf_dir, "lineitem").select(F.pmod("l_suppkey", F.lit(10)).cast("int").alias("bucket"), F.col("l_partkey").alias("at"), "l_orderkey", "l_linenumber")
    return S.as_of_run(rows, runs, ["bucket"], "at", "first", ["p_size"])


def chunk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte offset of each sample inside its chunk."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE, F.col("l_quantity").cast("long").alias("size"))
    return S.exclusive_sum(li, ["l_orderkey"], LINE, "size", "chunk_offset").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "size", "chunk_offset")


def future_min_pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = units(spark, sf_dir).withColumn("pts", (F.col("event_id") * 7919) % 1000)
    return S.suffix_min(e, STREAM, ["event_id"], "pts", "future_min").select("user_id", "event_id", "pts", "future_min")


def reorder_by_pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = units(spark, sf_dir).withColumn("pts", (F.col("event_id") * 7919) % 1000)
    return S.presentation_order(e, STREAM, "pts", "event_id", "rank").select("user_id", "event_id", "pts", "rank")


def bounded_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decode step at which each picture leaves a reorder buffer of 4."""
    e = S.presentation_order(units(spark, sf_dir), STREAM, "event_id", "event_id", "dts").withColumn("pts", F.col("dts") + (F.col("dts") * 5) % 4)
    return S.bounded_reorder(e.select("user_id", "dts", "pts"), STREAM, "dts", "pts", 4)


def seek_keyframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last keyframe at or before ordinal 5000 of the table, per stream; 0 if none."""
    return S.seek_start(units(spark, sf_dir), STREAM, "event_id", "event_id", F.col("event_type") == "purchase", F.lit(5000), "start")


def audio_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.presentation_order(units(spark, sf_dir), STREAM, "event_id", "event_id", "n").withColumn("n", F.col("n") - 1)
    return S.audio_seek_start(e, STREAM, "n", "event_id", F.lit(5000))


def interleave_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tracks of each customer's orders merged by offset; ties put audio first."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_totalprice").cast("long").alias("offset"), "o_orderkey")
    audio, video = o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1")
    return S.interleave(audio.withColumn("offset", F.expr("offset div 1000")), video.withColumn("offset", F.expr("offset div 1000")), ["o_custkey"], "offset")


def continuity_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses by a four-bit counter after exact repetitions are dropped."""
    e = units(spark, sf_dir).withColumn("cc", (F.col("event_id") % 16).cast("int"))
    return S.continuity(e, STREAM, ["event_id"], "cc").groupBy(*STREAM).agg(F.sum(F.col("lost").cast("long")).alias("losses"))


def adjacent_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drop_adjacent_repeats(units(spark, sf_dir), STREAM, ["event_id"], "event_type").select("user_id", "event_id", "event_type")


def pes_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of packets: each ``error`` row starts one."""
    e = S.islands(units(spark, sf_dir), STREAM, ["event_id"], F.col("event_type") == "error", "unit")
    return e.groupBy("user_id", "unit").agg(F.count(F.lit(1)).alias("packets"), F.sum("size").alias("bytes"), F.min("event_id").alias("first_id"))


def pts_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = units(spark, sf_dir).withColumn("anchor", F.when(F.col("event_type") == "view", F.col("event_id")))
    return S.carry_forward(e, STREAM, ["event_id"], "anchor", "pts").select("user_id", "event_id", "pts")


def anchored_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nanoseconds of frames of 1024 samples at 48 kHz since the last anchor."""
    e = units(spark, sf_dir).withColumn("anchor", F.when(F.col("event_type") == "view", F.col("event_id") * 1000)).withColumn("samples", F.lit(1024).cast("long"))
    return S.clock_from_anchors(e, STREAM, ["event_id"], "anchor", "samples", 48000, 1000000000, "ns").select("user_id", "event_id", "ns")


def media_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment numbers from 501 on and cumulative discontinuity numbers from 3 on."""
    e = S.presentation_order(units(spark, sf_dir), STREAM, "event_id", "event_id", "sequence").withColumn("sequence", F.col("sequence") + 500)
    e = S.islands(e, STREAM, ["event_id"], F.col("event_type") == "error", "d")
    return e.select("user_id", "event_id", "sequence", (F.col("d") + 3).alias("discontinuity_sequence"))


def implicit_byte_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte ranges that leave their offset to the segment before."""
    e = units(spark, sf_dir).withColumns({"uri": F.col("event_type"), "length": F.when(F.col("event_id") % 5 != 0, F.col("size")), "offset": F.when(F.col("event_id") % 3 == 0, F.col("event_id") * 10)})
    return S.implicit_offsets(e, STREAM, ["event_id"], "uri", "offset", "length").select("user_id", "event_id", "resolved_offset", "valid")


def poc_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = units(spark, sf_dir).withColumn("lsb", (F.col("event_id") * 3) % 16)
    return S.unwrap(e, STREAM, ["event_id"], "lsb", 4, "poc").select("user_id", "event_id", "poc")


def block_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = units(spark, sf_dir).withColumn("window", F.when(F.col("event_type") == "view", 2048).otherwise(256).cast("long"))
    return S.block_durations(e, STREAM, ["event_id"], "window", "frames").select("user_id", "event_id", "frames")


def spread_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padding of an order's block shared out over its packets."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE, F.col("l_quantity").cast("long").alias("frames"), F.lit(30).cast("long").alias("front"), F.lit(45).cast("long").alias("tail"))
    return S.spread_trim(li, ["l_orderkey"], LINE, "frames", "front", "tail").select("l_orderkey", "l_linenumber", "l_partkey", "trim_front", "trim_tail", "valid")


def target_duration_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Playlists (orders) with a segment that rounds to more than the target of 49."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.floor(F.col("l_quantity") + 0.5).cast("long").alias("d"))
    return li.groupBy("l_orderkey").agg(F.max("d").alias("longest")).where("longest > 49")


def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order, line) pairs that aren't unique."""
    return S.repeated(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def not_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an earlier snapshot, all orders, that the later one lacks."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return S.not_appended(o, o.where("o_orderkey % 50 <> 3"))


def sync_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that have samples."""
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_custkey")


def packet_loss_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks without samples."""
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


def media_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.exclusive_sum(units(spark, sf_dir), STREAM, ["event_id"], "size", "offset").withColumnRenamed("user_id", "file_id")
    return C.media_end(e)


def packet_program_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets with their stream's codec; packets of unknown streams are dropped."""
    codecs = spark.createDataFrame([("view", "h264"), ("purchase", "aac")], "event_type string, codec string")
    return units(spark, sf_dir).join(codecs, "event_type").select("event_id", "codec")


def first_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first supported track (part type) of each kind (brand)."""
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 20).alias("file_id"), F.col("p_brand").alias("kind"), F.col("p_partkey").alias("number"), F.when(F.col("p_size") % 2 == 0, "opus").otherwise("raw").alias("codec"))
    return C.first_supported(p, ["opus"])


def reference_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest earlier and later picture orders around 5000, as text lists."""
    e = units(spark, sf_dir).select("user_id", F.col("event_id").alias("poc"), F.lit(5000).cast("long").alias("current"))
    out = C.nearest_references(e, STREAM, "poc", "current")
    return out.select("user_id", F.array_join(F.transform("list0", lambda x: x.cast("string")), ",").alias("list0"), F.array_join(F.transform("list1", lambda x: x.cast("string")), ",").alias("list1"))


def symbol_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapted probability of each context (stream) from counts of zeros and ones."""
    from framewright.functions.integer import merge_probability

    e = units(spark, sf_dir)
    c = e.groupBy("user_id").agg(F.sum((F.col("event_type") == "view").cast("long")).alias("zero"), F.sum((F.col("event_type") != "view").cast("long")).alias("one"))
    return c.select("user_id", merge_probability(F.lit(128), F.col("zero"), F.col("one"), 20, 128).alias("p"))


def fragment_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of fragments with values left to headers and defaults."""
    file, track = (F.col("user_id") % 7).alias("file_id"), F.col("user_id").alias("track")
    e = S.presentation_order(units(spark, sf_dir), STREAM, "event_id", "event_id", "i")
    runs = e.select(file, track, "i", F.when(F.col("event_id") % 2 == 0, F.col("size")).alias("duration"), F.when(F.col("event_id") % 3 == 0, F.col("size") + 1).alias("size"), F.when(F.col("event_id") % 5 == 0, 65536).cast("long").alias("flags"), F.when(F.col("event_id") % 4 == 0, 3).cast("long").alias("composition"), (F.col("user_id") * 1000).alias("data_offset"))
    users = e.select(file, track, F.col("user_id").alias("u")).distinct()
    headers = users.select("file_id", "track", F.when(F.col("u") % 2 == 0, 10).cast("long").alias("h_duration"), F.lit(None).cast("long").alias("h_size"), F.when(F.col("u") % 2 == 1, 0).cast("long").alias("h_flags"), (F.col("u") * 100).alias("base_time"))
    defaults = users.where("u % 11 <> 5").select("file_id", "track", F.lit(7).cast("long").alias("d_duration"), F.lit(4).cast("long").alias("d_size"), F.lit(65536).cast("long").alias("d_flags"))
    return C.fragment_samples(runs, headers, defaults)


QUERIES = {f.__name__: f for f in (
    interleave_seek, decode_time_prefix, rle_expand, chunk_asof, chunk_offsets, future_min_pts, reorder_by_pts, bounded_reorder, seek_keyframe, audio_seek, interleave_merge,
    continuity_gaps, adjacent_repeats, pes_islands, pts_forward_fill, anchored_clock, media_sequence, implicit_byte_ranges, poc_unwrap, block_durations, spread_trim,
    target_duration_violations, repeated_keys, not_appended, sync_semi, packet_loss_anti, media_end, packet_program_map, first_tracks, reference_lists, symbol_histogram, fragment_samples,
)}

SQL = {
    "interleave_seek": """
with e as (
  select user_id, event_id, event_type, length(props)::bigint as size, event_type = 'purchase' as is_key,
    (sum(length(props)) over (partition by user_id order by event_id rows unbounded preceding) - length(props))::bigint as byte_offset,
    row_number() over (partition by user_id order by event_id) - 1 as dts
  from events),
s as (select user_id, max(dts) // 2 as seek_dts from e group by 1),
k as (select e.user_id, max(dts) filter (is_key and dts <= seek_dts) as start_dts from e join s using (user_id) group by 1)
select user_id, event_id, event_type, byte_offset, size, dts, is_key from e join k using (user_id) where dts >= coalesce(start_dts, 0)""",
    "decode_time_prefix": "select event_type, event_id, (sum(length(props)) over (partition by event_type order by event_id rows unbounded preceding) - length(props))::bigint as decode_time from events",
    "rle_expand": "select l_orderkey, sum(l_quantity::bigint)::bigint as n, sum(l_quantity::bigint * (l_quantity::bigint - 1) // 2)::bigint as sum_i from lineitem group by 1",
    "chunk_asof": """
with runs as (select p_size % 10 as bucket, p_partkey as first, p_size from part),
r as (select (l_suppkey % 10)::int as bucket, l_partkey as at, l_orderkey, l_linenumber from lineitem)
select r.bucket, r.at, r.l_orderkey, r.l_linenumber, runs.p_size from r asof left join runs on r.bucket = runs.bucket and r.at >= runs.first""",
    "chunk_offsets": """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::bigint as size,
  (sum(l_quantity::bigint) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate rows unbounded preceding) - l_quantity::bigint)::bigint as chunk_offset from lineitem""",
    "future_min_pts": "select user_id, event_id, event_id * 7919 % 1000 as pts, min(event_id * 7919 % 1000) over (partition by user_id order by event_id rows between current row and unbounded following) as future_min from events",
    "reorder_by_pts": "select user_id, event_id, event_id * 7919 % 1000 as pts, row_number() over (partition by user_id order by event_id * 7919 % 1000, event_id) as rank from events",
    "bounded_reorder": """
with e as (select user_id, row_number() over (partition by user_id order by event_id) as dts, count(*) over (partition by user_id) as n from events),
p as (select *, dts + dts * 5 % 4 as pts from e),
r as (select *, row_number() over (partition by user_id order by pts, dts) + 4 as r from p)
select user_id, dts, pts, case when r <= n then r end as released_at from r""",
    "seek_keyframe": "select user_id, coalesce(max(event_id) filter (event_type = 'purchase' and event_id <= 5000), 0) as start from events group by 1",
    "audio_seek": """
with e as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as n from events)
select user_id, greatest(coalesce(min(n) filter (event_id >= 5000), max(n) + 1) - 2, 0) as start from e group by 1""",
    "interleave_merge": """
with o as (select o_custkey, floor(o_totalprice)::bigint // 1000 as "offset", o_orderkey, case when o_orderkey % 2 = 0 then 'audio' else 'video' end as track from orders)
select *, row_number() over (partition by o_custkey order by "offset", track <> 'audio', o_orderkey) as position from o""",
    "continuity_gaps": """
with e as (select user_id, event_id % 16 as cc, lag(event_id % 16) over (partition by user_id order by event_id) as p from events)
select user_id, count(*) filter (p is not null and cc <> (p + 1) % 16) as losses from e group by 1""",
    "adjacent_repeats": "select user_id, event_id, event_type from (select *, lag(event_type) over (partition by user_id order by event_id) as p from events) where p is null or p <> event_type",
    "pes_islands": """
with e as (select user_id, event_id, length(props) as size, sum((event_type = 'error')::int) over (partition by user_id order by event_id rows unbounded preceding)::bigint as unit from events)
select user_id, unit, count(*) as packets, sum(size)::bigint as bytes, min(event_id) as first_id from e group by 1, 2""",
    "pts_forward_fill": "select user_id, event_id, last_value(case when event_type = 'view' then event_id end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as pts from events",
    "anchored_clock": """
with e as (select user_id, event_id, case when event_type = 'view' then event_id * 1000 end as anchor, sum((event_type = 'view')::int) over (partition by user_id order by event_id rows unbounded preceding) as g from events)
select user_id, event_id, case when g > 0 then max(anchor) over (partition by user_id, g) + (row_number() over (partition by user_id, g order by event_id) - 1) * 1024 * 1000000000 // 48000 end as ns from e""",
    "media_sequence": """
select user_id, event_id, row_number() over (partition by user_id order by event_id) + 500 as sequence,
  sum((event_type = 'error')::int) over (partition by user_id order by event_id rows unbounded preceding)::bigint + 3 as discontinuity_sequence from events""",
    "implicit_byte_ranges": """
with e as (select user_id, event_id, event_type as uri, case when event_id % 5 <> 0 then length(props) end as length, case when event_id % 3 = 0 then event_id * 10 end as off from events),
f as (select *, (off is null and length is not null and lag(uri) over w = uri and lag(length) over w is not null) as goes_on from e window w as (partition by user_id order by event_id)),
g as (select *, sum(case when goes_on is true then 0 else 1 end) over (partition by user_id order by event_id rows unbounded preceding) as grp from f),
h as (select user_id, event_id, length, case when length is not null then first_value(off) over w + sum(length) over w - length end as r from g window w as (partition by user_id, grp order by event_id rows unbounded preceding))
select user_id, event_id, r::bigint as resolved_offset, length is null or r is not null as valid from h""",
    "poc_unwrap": """
with e as (select user_id, event_id, event_id * 3 % 16 as lsb from events),
d as (select *, lsb - lag(lsb) over (partition by user_id order by event_id) as x from e)
select user_id, event_id, lsb + sum(case when x <= -8 then 16 when x > 8 then -16 else 0 end) over (partition by user_id order by event_id rows unbounded preceding)::bigint as poc from d""",
    "block_durations": """
with e as (select user_id, event_id, case when event_type = 'view' then 2048 else 256 end as w from events)
select user_id, event_id, coalesce(lag(w) over (partition by user_id order by event_id) // 4 + w // 4, w // 2)::bigint as frames from e""",
    "spread_trim": """
with e as (select l_orderkey, l_linenumber, l_partkey, l_quantity::bigint as f, sum(l_quantity::bigint) over (partition by l_orderkey) as t,
  sum(l_quantity::bigint) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate rows unbounded preceding) as s from lineitem)
select l_orderkey, l_linenumber, l_partkey, least(greatest(30 - (s - f), 0), f)::bigint as trim_front, least(greatest(45 - (t - s), 0), f)::bigint as trim_tail, 75 <= t as valid from e""",
    "target_duration_violations": "select l_orderkey, max(floor(l_quantity + 0.5))::bigint as longest from lineitem group by 1 having max(floor(l_quantity + 0.5)) > 49",
    "repeated_keys": "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1",
    "not_appended": "select o_orderkey, o_orderstatus from orders except all select o_orderkey, o_orderstatus from orders where o_orderkey % 50 <> 3",
    "sync_semi": "select o_orderkey, o_custkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey)",
    "packet_loss_anti": "select o_orderkey, o_custkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)",
    "media_end": "select user_id as file_id, sum(length(props))::bigint as media_end from events group by 1",
    "packet_program_map": "select event_id, case event_type when 'view' then 'h264' else 'aac' end as codec from events where event_type in ('view', 'purchase')",
    "first_tracks": """
with p as (select p_partkey % 20 as file_id, p_brand as kind, p_partkey as number, case when p_size % 2 = 0 then 'opus' else 'raw' end as codec from part)
select * from p where codec = 'opus' qualify row_number() over (partition by file_id, kind order by number) = 1""",
    "reference_lists": """
with e as (select user_id, event_id as poc from events),
l as (select user_id, coalesce(string_agg(poc::varchar, ',' order by poc desc) filter (poc < 5000), '') as past, coalesce(string_agg(poc::varchar, ',' order by poc) filter (poc > 5000), '') as future from e group by 1)
select user_id, past || case when past <> '' and future <> '' then ',' else '' end || future as list0, future || case when past <> '' and future <> '' then ',' else '' end || past as list1 from l""",
    "symbol_histogram": """
with c as (select user_id, count(*) filter (event_type = 'view') as z, count(*) as t from events group by 1),
o as (select user_id, least(greatest((256 * z + t // 2) // t, 1), 255) as o, 128 * least(t, 20) // 20 as f from c)
select user_id, (128 * (256 - f) + o * f + 128) >> 8 as p from o""",
    "fragment_samples": """
with e as (select user_id % 7 as file_id, user_id as track, user_id as u, event_id, length(props) as s, row_number() over (partition by user_id order by event_id) as i from events),
r as (select *, coalesce(case when event_id % 2 = 0 then s end, case when u % 2 = 0 then 10 end, 7) as duration, coalesce(case when event_id % 3 = 0 then s + 1 end, 4) as size,
  coalesce(case when event_id % 5 = 0 then 65536 end, case when u % 2 = 1 then 0 end, 65536) as flags, case when event_id % 4 = 0 then 3 else 0 end as comp from e where u % 11 <> 5),
t as (select *, u * 1000 + sum(size) over w - size as o, u * 100 + sum(duration) over w - duration as d from r window w as (partition by file_id, track order by i rows unbounded preceding))
select file_id, track, i, o::bigint as "offset", size::bigint as size, d::bigint as decode_time, (d + comp)::bigint as presentation_time, flags & 65536 = 0 as keyframe from t""",
}
