"""Queries through the format readers: files are built from table rows, then read back as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.integer import shl
from framewright.plans.sequence_queries import table
from framewright.sources import containers, hls, mpegts, readers


def playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A live playlist for each user: a segment for each event, a discontinuity before each error."""
    e = table(spark, sf_dir, "events")
    line = F.concat(F.when(F.col("event_type") == "error", "#EXT-X-DISCONTINUITY\n").otherwise(""), F.lit("#EXTINF:"), (F.col("event_id") % 9 + 1).cast("string"), F.lit(",title "), F.col("event_id").cast("string"), F.lit("\nu"), F.col("event_id").cast("string"), F.lit(".ts"))
    rows = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("lines"))
    head = F.lit("#EXTM3U\n#EXT-X-TARGETDURATION:9\n#EXT-X-MEDIA-SEQUENCE:5\n")
    return rows.select(F.col("user_id").cast("string").alias("playlist_id"), F.concat(head, F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("text"))


def hls_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hls.segments(playlists(spark, sf_dir)).select("playlist_id", "ordinal", "uri", "duration", "title", "sequence", "discontinuity", "discontinuity_sequence", "valid")


def hls_playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hls.playlists(playlists(spark, sf_dir)).select("playlist_id", "kind", "version", "target_duration", "media_sequence", "end_list", F.col("error.code").alias("code"))


def _le(value: Column, size: int) -> Column:
    """Hexadecimal little-endian bytes of a whole number."""
    bits = F.lpad(F.hex(value.cast("long").bitwiseAND(F.lit((1 << 8 * size) - 1))), 2 * size, "0")
    return F.concat(*(F.substring(bits, 2 * i + 1, 2) for i in reversed(range(size))))


def wav_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 16-bit file for each vector, read back in packets of 16 frames."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("file_id"), F.array_join(F.transform("embedding", lambda x: _le(F.floor(x.cast("double") * 10000), 2)), "").alias("samples"), F.size("embedding").alias("n"))
    text = lambda s: F.lit(s.encode().hex().upper())
    body = F.concat(text("WAVEfmt "), _le(F.lit(16), 4), _le(F.lit(1), 2), _le(F.lit(1), 2), _le(F.lit(8000), 4), _le(F.lit(16000), 4), _le(F.lit(2), 2), _le(F.lit(16), 2), text("data"), _le(F.col("n") * 2, 4), F.col("samples"))
    files = v.select("file_id", F.unhex(F.concat(text("RIFF"), _le(36 + F.col("n") * 2, 4), body)).alias("content"))
    out = readers.wav_packets(files, frames=16)
    peak = F.array_max(F.transform("samples", lambda x: F.round(x.cast("double") * 32768).cast("long")))
    return out.select(F.col("file_id").cast("long").alias("vec_id"), "packet", "timestamp_ns", F.size("samples").cast("long").alias("frames"), peak.alias("peak"))


def transport_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transport stream for each user, a packet for each event: PID by type, counter by the user's event number."""
    from framewright.operators.sequence import presentation_order

    e = presentation_order(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_id", "i")
    pid = F.when(F.col("event_type") == "view", 257).when(F.col("event_type") == "error", 8191).otherwise(258)
    word = (shl(F.lit(0x47).cast("long"), 24) + shl(F.when(F.col("event_id") % 4 == 0, 0x4000).otherwise(0) + pid, 8) + 0x10 + F.col("i") % 16)
    packet = F.concat(F.lpad(F.hex(word), 8, "0"), F.rpad(F.hex(F.encode(F.col("event_id").cast("string"), "utf-8")), 368, "5A"))
    rows = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("i", packet.alias("p")))).alias("ps"))
    files = rows.select(F.col("user_id").cast("string").alias("file_id"), F.unhex(F.array_join(F.transform("ps", lambda x: x["p"]), "")).alias("content"))
    out = mpegts.decode(mpegts.packets(files))
    return out.select(F.col("file_id").cast("long").alias("user_id"), "n", "pid", "starts", "counter", F.length("payload").cast("long").alias("bytes"), "valid")


def _be(value, size: int = 4) -> Column:
    """Hexadecimal big-endian bytes of a whole number."""
    value = F.lit(value) if isinstance(value, int) else value
    return F.lpad(F.hex(value.cast("long").bitwiseAND(F.lit((1 << 8 * size) - 1))), 2 * size, "0")


def _box(kind: str, *body: Column) -> Column:
    inside = F.concat(*body)
    return F.concat(_be(F.length(inside) / 2 + 8), F.lit(kind.encode().hex()), inside)


def fragmented_mp4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fragmented file for each user, a fragment for each type of event and a sample for each event, read back.

    Sizes are each sample's own; users with even ids leave durations to the defaults, others have them, too; compositions
    are there for every third. The first sample of each fragment has flags of its own. Users whose id leaves 5 when
    divided by 11 have no defaults: their file is an error.
    """
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.length("props").cast("long").alias("size"))
    u = F.col("user_id")
    own, shown = u % 2 == 1, u % 3 == 0
    entry = F.concat(F.when(own, _be(F.col("event_id") % 50)).otherwise(""), _be(F.col("size")), F.when(shown, _be(F.col("event_id") % 7)).otherwise(""))
    runs = e.groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list(F.struct("event_id", entry.alias("x")))).alias("xs"), F.sum("size").alias("bytes"))
    flags = 0x205 + F.when(own, 0x100).otherwise(0) + F.when(shown, 0x800).otherwise(0)
    run = _box("trun", _be(flags), _be(F.size("xs")), _be(64), _be(0), F.array_join(F.transform("xs", lambda x: x["x"]), ""))
    header = _box("tfhd", _be(0x20020), _be(1), _be(0x10000))
    moof = _box("moof", _box("mfhd", _be(0), _be(1)), _box("traf", header, _box("tfdt", _be(0), _be(F.length("event_type") * 1000)), run))
    parts = runs.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_type", moof.alias("m")))).alias("ms"))
    extends = _box("mvex", F.when(u % 11 != 5, _box("trex", _be(0), _be(1), _be(1), _be(7), _be(4), _be(0))).otherwise(""))
    files = parts.select(F.col("user_id").cast("string").alias("file_id"), F.unhex(F.concat(_box("moov", extends), F.array_join(F.transform("ms", lambda m: m["m"]), ""))).alias("content"))
    out = readers.mp4_fragments(files)
    return out.select(F.col("file_id").cast("long").alias("user_id"), "fragment", "n", "size", "decode_time", "presentation_time", "keyframe", F.col("error").isNotNull().alias("broken"))


def _section_packet(pid: int, table: int, number: int, body: bytes) -> str:
    """Hexadecimal packet of one whole section of a table."""
    data = bytes([table]) + (0xB000 + len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0" + body
    data = b"\0" + data + containers.crc32_mpeg(data).to_bytes(4, "big")
    return (b"\x47" + (0x4000 + pid).to_bytes(2, "big") + b"\x10" + data.ljust(184, b"\xff")).hex()


def _stamp(t: Column) -> Column:
    """Hexadecimal time stamp of 33 bits, each of its three parts ended by a one."""
    from framewright.functions.integer import shr

    return F.concat(_be(0x21 + shr(t, 30) * 2, 1), _be(shr(t, 15) % 32768 * 2 + 1, 2), _be(t % 32768 * 2 + 1, 2))


def _stream_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transport stream for each user: its tables, then a packet for each event, with a unit of its own that holds the
    event's id as text. Views go to one stream, all others to another; errors claim more bytes than there are."""
    from framewright.operators.sequence import presentation_order

    e = table(spark, sf_dir, "events").withColumn("pid", F.when(F.col("event_type") == "view", 257).otherwise(258))
    e = presentation_order(presentation_order(e, ["user_id"], "event_id", "event_id", "at"), ["user_id", "pid"], "event_id", "event_id", "i")
    text = F.hex(F.encode(F.col("event_id").cast("string"), "utf-8"))
    size = F.when(F.col("event_type") == "error", 60000).otherwise(8 + F.length(text) / 2)
    unit = F.concat(F.lit("000001E0"), _be(size, 2), F.lit("808005"), _stamp(F.pmod(F.col("event_id") * 3003, F.lit(1 << 33))), text)
    word = shl(F.lit(0x47).cast("long"), 24) + shl(F.lit(0x4000) + F.col("pid"), 8) + 0x10 + F.col("i") % 16
    packet = F.concat(_be(word), F.rpad(unit, 368, "5A"))
    head = _section_packet(0, 0, 1, bytes.fromhex("0001E100")) + _section_packet(256, 2, 1, bytes.fromhex("E101F0001BE101F0000FE102F00006E103F000"))
    rows = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("at", packet.alias("p")))).alias("ps"))
    return rows.select(F.col("user_id").cast("string").alias("file_id"), F.unhex(F.concat(F.lit(head), F.array_join(F.transform("ps", lambda x: x["p"]), ""))).alias("content"))


def _stream_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When packets of each file are shown, as an index beside it says: one for every quarter of the turn of a time stamp."""
    from framewright.operators.sequence import presentation_order

    e = presentation_order(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", "event_id", "at")
    e = e.withColumn("ticks", F.col("event_id") * 3003).groupBy("user_id", F.floor(F.col("ticks") / (1 << 31)).alias("quarter"))
    return e.agg(F.min("at").alias("at"), F.min("ticks").alias("ticks")).select(F.col("user_id").cast("string").alias("file_id"), (F.col("at") + 1).alias("n"), "ticks")  # behind two packets of tables


def transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of each file, from its tables."""
    out = mpegts.elementary_streams(mpegts.decode(mpegts.packets(_stream_files(spark, sf_dir))))
    return out.select(F.col("file_id").cast("long").alias("user_id"), "pid", "codec")


def pes_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of each stream put together again; those that end short are errors. Time stamps have 33 bits, an index beside
    the files makes them whole."""
    rows = mpegts.decode(mpegts.packets(_stream_files(spark, sf_dir)))
    out = mpegts.elementary_packets(rows, mpegts.elementary_streams(rows), _stream_clock(spark, sf_dir))
    return out.select(F.col("file_id").cast("long").alias("user_id"), "pid", "codec", "unit", "pts", "discontinuity", F.decode("data", "utf-8").alias("data"), F.col("error").isNotNull().alias("broken"))


QUERIES = {f.__name__: f for f in (hls_segments, hls_playlists, wav_packets, transport_packets, fragmented_mp4, transport_streams, pes_units)}

SQL = {
    "hls_segments": """
with e as (select *, row_number() over (partition by user_id order by event_id) - 1 as o, sum((event_type = 'error')::int) over (partition by user_id order by event_id rows unbounded preceding)::bigint as d from events)
select user_id::varchar as playlist_id, o as ordinal, 'u' || event_id || '.ts' as uri, (event_id % 9 + 1)::double as duration, 'title ' || event_id as title, o + 5 as sequence, event_type = 'error' as discontinuity, d as discontinuity_sequence, true as valid from e""",
    "hls_playlists": "select user_id::varchar as playlist_id, 'media' as kind, 1::bigint as version, 9.0::double as target_duration, 5::bigint as media_sequence, false as end_list, null::varchar as code from events group by user_id",
    "wav_packets": """
with v as (select vec_id, unnest(range(0, len(embedding), 16)) as first, embedding as e from embeddings)
select vec_id, first // 16 as packet, first * 1000000000 // 8000 as timestamp_ns, least(16, len(e) - first) as frames,
  list_max(list_transform(e[first + 1:first + 16], lambda x: floor(x::double * 10000)::bigint)) as peak from v""",
    "transport_packets": """
with e as (select *, row_number() over (partition by user_id order by event_id) as i from events)
select user_id, i - 1 as n, case event_type when 'view' then 257 else 258 end as pid, event_id % 4 = 0 as starts, i % 16 as counter, 184 as bytes, true as valid from e where event_type <> 'error'""",
    "fragmented_mp4": """
with e as (select user_id, event_type, event_id, length(props)::bigint as size, case when user_id % 2 = 1 then event_id % 50 else 7 end as d from events where user_id % 11 <> 5),
f as (select *, dense_rank() over (partition by user_id order by event_type) - 1 as fragment, row_number() over (partition by user_id order by event_type, event_id) - 1 as n,
  length(event_type) * 1000 + sum(d) over (partition by user_id, event_type order by event_id rows unbounded preceding) - d as t, row_number() over (partition by user_id, event_type order by event_id) as i from e)
select user_id, fragment, n, size, t::bigint as decode_time, (t + case when user_id % 3 = 0 then event_id % 7 else 0 end)::bigint as presentation_time, i = 1 as keyframe, false as broken from f
union all select distinct user_id, null, null, null, null, null, null, true from events where user_id % 11 = 5""",
    "transport_streams": "select distinct user_id, 257 as pid, 'h264' as codec from events union all select distinct user_id, 258, 'aac' from events",
    "pes_units": """
with e as (select user_id, event_id, event_type, case event_type when 'view' then 257 else 258 end as pid from events)
select user_id, pid, case pid when 257 then 'h264' else 'aac' end as codec, row_number() over (partition by user_id, pid order by event_id) as unit,
  case when event_type <> 'error' then event_id * 3003 end as pts, false as discontinuity, case when event_type <> 'error' then event_id::varchar end as data, event_type = 'error' as broken from e""",
}
