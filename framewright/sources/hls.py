"""HTTP live streaming playlists as relations: one row a line, windows for what carries over between lines.

Input: playlist_id, text. Nothing loops over playlists; a playlist's lines are a partition of its windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from framewright.operators.sequence import implicit_offsets

KEY = ["playlist_id"]

# Tags that may occur once, tags of either kind of playlist, tags that aren't supported, and limits.
SINGLE = ("#EXTM3U", "#EXT-X-VERSION", "#EXT-X-TARGETDURATION", "#EXT-X-MEDIA-SEQUENCE", "#EXT-X-DISCONTINUITY-SEQUENCE", "#EXT-X-ENDLIST", "#EXT-X-PLAYLIST-TYPE", "#EXT-X-INDEPENDENT-SEGMENTS")
MASTER = ("#EXT-X-STREAM-INF", "#EXT-X-MEDIA", "#EXT-X-SESSION-KEY", "#EXT-X-SESSION-DATA")
MEDIA = ("#EXT-X-TARGETDURATION", "#EXT-X-MEDIA-SEQUENCE", "#EXT-X-DISCONTINUITY-SEQUENCE", "#EXTINF", "#EXT-X-BYTERANGE", "#EXT-X-DISCONTINUITY", "#EXT-X-MAP", "#EXT-X-KEY", "#EXT-X-PLAYLIST-TYPE", "#EXT-X-ENDLIST", "#EXT-X-PROGRAM-DATE-TIME", "#EXT-X-DATERANGE")
UNSUPPORTED = ("#EXT-X-I-FRAMES-ONLY", "#EXT-X-I-FRAME-STREAM-INF", "#EXT-X-START", "#EXT-X-DEFINE", "#EXT-X-PART", "#EXT-X-PART-INF", "#EXT-X-SKIP", "#EXT-X-PRELOAD-HINT", "#EXT-X-SERVER-CONTROL", "#EXT-X-RENDITION-REPORT")
PLAYLIST_BYTES, LINE_BYTES, SEGMENTS, VARIANTS, NEWEST = 2 << 20, 16 << 10, 10_000, 128, 7

_NAME_VALUE = r'([A-Z0-9-]+)=("[^"]*"|[^",\s]+)'


def attributes(text: Column) -> Column:
    """name -> value of an attribute list; quoted values keep their quotes. Null if the list is malformed or repeats a name."""
    names = F.regexp_extract_all(text, F.lit(_NAME_VALUE), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(_NAME_VALUE), F.lit(2))
    whole = F.rlike(text, F.lit(f"^{_NAME_VALUE}(,{_NAME_VALUE})*$")) & (F.size(F.array_distinct(names)) == F.size(names)) & (F.size(names) <= 32)
    return F.when(whole, F.map_from_arrays(names, values))


def quoted(attrs: Column, name: str) -> Column:
    """The text of a quoted attribute; null if it is missing or not quoted."""
    v = F.try_element_at(attrs, F.lit(name))
    return F.when(F.rlike(v, F.lit('^".*"$')), F.substring(v, F.lit(2), F.length(v) - 2))


def plain(attrs: Column, name: str) -> Column:
    v = F.try_element_at(attrs, F.lit(name))
    return F.when(~F.startswith(v, F.lit('"')), v)


def whole_number(text: Column) -> Column:
    """Of at most 20 digits; null if it is none or too large."""
    return F.when(F.rlike(text, F.lit("^[0-9]{1,20}$")), text.try_cast("bigint"))


def positive_decimal(text: Column) -> Column:
    v = F.when(F.rlike(text, F.lit(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$")), text.try_cast("double"))
    return F.when((v > 0) & (v < float("inf")), v)


def is_reference(text: Column) -> Column:
    return (F.length(text) > 0) & ~F.rlike(text, F.lit(r"\s")) & ~F.contains(text, F.lit("{$"))


def byte_range(text: Column) -> Column:
    """struct<length, offset>; the offset is null where it is left out, all is null where it is malformed."""
    length, at = whole_number(F.regexp_extract(text, "^([0-9]+)(@([0-9]+))?$", 1)), F.regexp_extract(text, "^([0-9]+)(@([0-9]+))?$", 3)
    good = F.rlike(text, F.lit("^[0-9]{1,20}(@[0-9]{1,20})?$")) & (length > 0) & ((at == "") | whole_number(at).isNotNull())
    return F.when(good, F.struct(length.alias("length"), whole_number(F.nullif(at, F.lit(""))).alias("offset")))


def lines(playlists: DataFrame) -> DataFrame:
    """playlist_id, line, value, tag, argument of the lines that count: no empty ones, no comments."""
    rows = playlists.select(*KEY, F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    rows = rows.select(*KEY, (F.col("line") + 1).alias("line"), F.regexp_replace("raw", "\r$", "").alias("value"))
    is_tag = F.startswith("value", F.lit("#EXT"))
    rows = rows.where((F.col("value") != "") & (is_tag | ~F.startswith("value", F.lit("#"))))
    colon = F.instr("value", ":")
    tag = F.when(is_tag, F.when(colon > 0, F.substring(F.col("value"), F.lit(1), colon - 1)).otherwise(F.col("value")))
    return rows.select(*KEY, "line", "value", tag.alias("tag"), F.when(is_tag & (colon > 0), F.substring(F.col("value"), colon + 1, F.length("value"))).alias("argument"))


def _units(rows: DataFrame) -> DataFrame:
    """Adds ``unit``: how many URIs came before a line, which is the segment or variant that it belongs to."""
    before = W.partitionBy(*KEY).orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("unit", F.coalesce(F.sum(F.col("tag").isNull().cast("long")).over(before), F.lit(0)))


def _argument(tag: str) -> Column:
    return F.first(F.when(F.col("tag") == tag, F.col("argument")), ignorenulls=True)


def segments(playlists: DataFrame) -> DataFrame:
    """playlist_id, ordinal, uri, duration, title, sequence, discontinuity, discontinuity_sequence, map_uri, map_offset,
    map_length, offset, length, valid."""
    rows = _units(lines(playlists))
    head = rows.groupBy(*KEY).agg(
        F.coalesce(whole_number(_argument("#EXT-X-MEDIA-SEQUENCE")), F.lit(0)).alias("s0"), F.coalesce(whole_number(_argument("#EXT-X-DISCONTINUITY-SEQUENCE")), F.lit(0)).alias("d0"),
        F.max(F.col("tag").isin(*MASTER)).alias("master"),
    )
    per = rows.groupBy(*KEY, "unit").agg(
        F.first(F.when(F.col("tag").isNull(), F.col("value")), ignorenulls=True).alias("uri"), _argument("#EXTINF").alias("inf"), _argument("#EXT-X-BYTERANGE").alias("range"),
        F.count(F.when(F.col("tag") == "#EXT-X-DISCONTINUITY", 1)).alias("breaks"), F.last(F.when(F.col("tag") == "#EXT-X-MAP", F.col("argument")), ignorenulls=True).alias("map"),
    )
    w = W.partitionBy(*KEY).orderBy("unit").rowsBetween(W.unboundedPreceding, 0)
    per = per.withColumns({"map": F.last("map", ignorenulls=True).over(w), "broken": F.sum("breaks").over(w)}).where("uri is not null").join(head, KEY).where(~F.coalesce("master", F.lit(False)))
    spec, attrs = byte_range(F.col("range")), attributes(F.col("map"))
    duration = positive_decimal(F.regexp_extract("inf", "^([^,]*),", 1))
    per = per.select(
        *KEY, F.col("unit").alias("ordinal"), "uri", duration.alias("duration"), F.regexp_extract("inf", "^[^,]*,(.*)$", 1).alias("title"), (F.col("s0") + F.col("unit")).alias("sequence"),
        (F.col("breaks") > 0).alias("discontinuity"), (F.col("d0") + F.col("broken")).alias("discontinuity_sequence"), quoted(attrs, "URI").alias("map_uri"), byte_range(quoted(attrs, "BYTERANGE"))["offset"].alias("map_offset"),
        byte_range(quoted(attrs, "BYTERANGE"))["length"].alias("map_length"), spec["offset"].alias("given"), spec["length"].alias("length"), (F.col("range").isNull() | spec.isNotNull()).alias("sound"),
    )
    out = implicit_offsets(per, KEY, ["ordinal"], "uri", "given", "length", "offset")
    fits = F.col("length").isNull() | (F.col("offset") <= F.lit((1 << 63) - 1) - F.col("length"))
    return out.withColumn("valid", F.col("valid") & F.col("sound") & F.col("duration").isNotNull() & is_reference(F.col("uri")) & F.coalesce(fits, F.lit(False))).drop("given", "sound")


def variants(playlists: DataFrame) -> DataFrame:
    """playlist_id, ordinal, uri, bandwidth, average_bandwidth, codecs, width, height, frame_rate, audio, video, subtitles,
    external_audio."""
    rows = _units(lines(playlists))
    per = rows.groupBy(*KEY, "unit").agg(F.first(F.when(F.col("tag").isNull(), F.col("value")), ignorenulls=True).alias("uri"), _argument("#EXT-X-STREAM-INF").alias("inf")).where("uri is not null and inf is not null")
    a = F.col("a")
    size = F.split(plain(a, "RESOLUTION"), "x")
    codecs = F.transform(F.split(quoted(a, "CODECS"), ","), lambda c: F.trim(c))
    out = per.withColumn("a", attributes(F.col("inf"))).select(
        *KEY, F.row_number().over(W.partitionBy(*KEY).orderBy("unit")).alias("ordinal"), "uri", whole_number(plain(a, "BANDWIDTH")).alias("bandwidth"), whole_number(plain(a, "AVERAGE-BANDWIDTH")).alias("average_bandwidth"), codecs.alias("codecs"),
        whole_number(F.get(size, 0)).alias("width"), whole_number(F.get(size, 1)).alias("height"), positive_decimal(plain(a, "FRAME-RATE")).alias("frame_rate"), quoted(a, "AUDIO").alias("audio"), quoted(a, "VIDEO").alias("video"), quoted(a, "SUBTITLES").alias("subtitles"),
    ).withColumn("ordinal", F.col("ordinal") - 1)
    apart = renditions(playlists).where("kind = 'AUDIO' and uri is not null").select(*KEY, F.col("group_id").alias("audio"), F.lit(True).alias("external_audio")).distinct()
    return out.join(apart, [*KEY, "audio"], "left").withColumn("external_audio", F.coalesce("external_audio", F.lit(False)))


def renditions(playlists: DataFrame) -> DataFrame:
    """playlist_id, ordinal, kind, group_id, name, uri, language, instream_id, is_default, autoselect, forced."""
    a = F.col("a")
    rows = lines(playlists).where(F.col("tag") == "#EXT-X-MEDIA").withColumn("a", attributes(F.col("argument")))
    yes = lambda n: F.coalesce(plain(a, n) == "YES", F.lit(False))
    return rows.select(
        *KEY, (F.row_number().over(W.partitionBy(*KEY).orderBy("line")) - 1).alias("ordinal"), plain(a, "TYPE").alias("kind"), quoted(a, "GROUP-ID").alias("group_id"), quoted(a, "NAME").alias("name"), quoted(a, "URI").alias("uri"),
        quoted(a, "LANGUAGE").alias("language"), quoted(a, "INSTREAM-ID").alias("instream_id"), yes("DEFAULT").alias("is_default"), yes("AUTOSELECT").alias("autoselect"), yes("FORCED").alias("forced"),
    )


def playlists(texts: DataFrame) -> DataFrame:
    """playlist_id, kind, version, independent_segments, target_duration, media_sequence, discontinuity_sequence,
    playlist_type, end_list, error: Unsupported, InvalidData with the first reason, or null."""
    rows = _units(lines(texts))
    has = lambda t: F.max(F.coalesce(F.col("tag") == t, F.lit(False)))
    rows = rows.withColumns({"same": F.count(F.lit(1)).over(W.partitionBy(*KEY, "tag")), "in_unit": F.count(F.lit(1)).over(W.partitionBy(*KEY, "tag", "unit"))})
    method = F.when(F.col("tag").isin("#EXT-X-KEY", "#EXT-X-SESSION-KEY"), F.coalesce(plain(attributes(F.col("argument")), "METHOD"), F.lit("?")))
    late = lambda t: F.max(F.coalesce((F.col("tag") == t) & (F.col("unit") > 0), F.lit(False)))
    agg = rows.groupBy(*KEY).agg(
        F.coalesce(whole_number(_argument("#EXT-X-VERSION")), F.lit(1)).alias("version"), has("#EXT-X-INDEPENDENT-SEGMENTS").alias("independent_segments"), whole_number(_argument("#EXT-X-TARGETDURATION")).alias("target_duration"),
        whole_number(_argument("#EXT-X-MEDIA-SEQUENCE")).alias("media_sequence"), whole_number(_argument("#EXT-X-DISCONTINUITY-SEQUENCE")).alias("discontinuity_sequence"), _argument("#EXT-X-PLAYLIST-TYPE").alias("playlist_type"), has("#EXT-X-ENDLIST").alias("end_list"),
        F.max(F.coalesce(F.col("tag").isin(*MASTER), F.lit(False))).alias("master"), F.max(F.coalesce(F.col("tag").isin(*MEDIA), F.lit(False))).alias("media"), F.max(F.coalesce(F.col("tag").isin(*UNSUPPORTED), F.lit(False))).alias("unsupported"),
        F.max(F.coalesce(F.col("tag").isin(*SINGLE) & (F.col("same") > 1), F.lit(False))).alias("twice"), F.max(F.coalesce(F.col("tag").isin("#EXTINF", "#EXT-X-BYTERANGE", "#EXT-X-DISCONTINUITY", "#EXT-X-STREAM-INF") & (F.col("in_unit") > 1), F.lit(False))).alias("pending"),
        F.max(F.coalesce(method != "NONE", F.lit(False))).alias("encrypted"), F.count(F.when(F.col("tag").isNull(), 1)).alias("uris"), F.max("unit").alias("last"), F.max(F.when(F.col("tag").isin("#EXTINF", "#EXT-X-BYTERANGE", "#EXT-X-DISCONTINUITY", "#EXT-X-STREAM-INF"), F.col("unit"))).alias("last_pending"),
        (late("#EXT-X-MEDIA-SEQUENCE") | late("#EXT-X-DISCONTINUITY-SEQUENCE")).alias("late"), F.max(F.length("value")).alias("longest"), F.max(F.contains("value", F.lit("\r"))).alias("bare"),
        F.greatest(F.max(F.when((F.col("tag") == "#EXTINF") & F.rlike("argument", F.lit(r"^[^,]*\.")), 3).otherwise(1)), F.max(F.when(F.col("tag") == "#EXT-X-BYTERANGE", 4).otherwise(1)), F.max(F.when(F.col("tag") == "#EXT-X-MAP", 6).otherwise(1))).alias("needed"),
        has("#EXT-X-VERSION").alias("versioned"), has("#EXT-X-TARGETDURATION").alias("targeted"), F.max(F.coalesce(F.col("tag").isNull() & F.contains("value", F.lit("{$")), F.lit(False))).alias("variables"),
    )
    seg = segments(texts).groupBy(*KEY).agg(F.max(F.floor(F.col("duration") + 0.5)).alias("longest_segment"), F.min("valid").alias("all_valid"))
    var = variants(texts).groupBy(*KEY).agg(F.count(F.lit(1)).alias("variants"), F.min(F.col("bandwidth").isNotNull()).alias("all_bandwidth"))
    groups = renditions(texts).select(*KEY, "kind", "group_id").distinct()
    named = variants(texts).select(*KEY, F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("group_id")) for k, c in (("AUDIO", "audio"), ("VIDEO", "video"), ("SUBTITLES", "subtitles"))))).alias("g")).select(*KEY, "g.*").where("group_id is not null")
    missing = named.join(groups, [*KEY, "kind", "group_id"], "left_anti").select(*KEY).distinct().withColumn("missing", F.lit(True))
    double = renditions(texts).groupBy(*KEY, "kind", "group_id", "name").count().where("count > 1").select(*KEY).distinct().withColumn("double", F.lit(True))
    out = texts.select(*KEY, "text").join(agg, KEY, "left")
    for other in (seg, var, missing, double):
        out = out.join(other, KEY, "left")
    reasons = [
        (F.octet_length("text") > PLAYLIST_BYTES, "playlist too long"),
        (F.rlike("text", F.lit("[\\x00-\\x09\\x0b\\x0c\\x0e-\\x1f\\x7f-\\u009f\\ufeff]")), "control character"),
        (~F.rlike("text", F.lit("^#EXTM3U\\r?(\\n|$)")), "no header"),
        (F.col("longest") > LINE_BYTES, "line too long"),
        (F.col("bare"), "bare carriage return"),
        (F.col("twice"), "tag repeated"),
        (F.col("master") & F.col("media"), "mixed kinds"),
        (F.col("pending"), "tag repeated before its URI"),
        (F.col("late"), "sequence after a segment"),
        (F.col("last_pending") >= F.col("uris"), "unfinished segment or variant"),
        (F.col("version") < F.col("needed"), "version too low"),
        (F.col("master") & (F.coalesce("variants", F.lit(0)) == 0), "no variants"),
        (F.col("master") & (F.col("variants") != F.col("uris")), "URI without variant"),
        (F.col("master") & ~F.col("all_bandwidth"), "variant without bandwidth"),
        (F.coalesce("missing", F.lit(False)), "no such rendition group"),
        (F.coalesce("double", F.lit(False)), "rendition repeated"),
        (F.col("uris") > F.when(F.col("master"), VARIANTS).otherwise(SEGMENTS), "too many URIs"),
        (~F.col("master") & (F.coalesce("target_duration", F.lit(0)) == 0), "no target duration"),
        (~F.coalesce("all_valid", F.lit(True)), "invalid segment"),
        (F.col("longest_segment") > F.col("target_duration"), "segment exceeds target"),
        (~F.coalesce(F.col("playlist_type").isin("EVENT", "VOD"), F.lit(True)), "invalid type"),
        ((F.col("playlist_type") == "VOD") & ~F.col("end_list"), "no end"),
    ]
    reason = F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for c, r in reasons))
    no = F.coalesce(F.col("unsupported") | F.col("encrypted") | F.col("variables") | (F.col("version") > NEWEST), F.lit(False))
    error = F.when(no, F.struct(F.lit("Unsupported").alias("code"), F.lit("").alias("message"))).when(reason.isNotNull(), F.struct(F.lit("InvalidData").alias("code"), reason.alias("message")))
    return out.select(*KEY, F.when(F.col("master"), "master").otherwise("media").alias("kind"), "version", "independent_segments", F.col("target_duration").cast("double").alias("target_duration"), F.coalesce("media_sequence", F.lit(0)).alias("media_sequence"), F.coalesce("discontinuity_sequence", F.lit(0)).alias("discontinuity_sequence"), "playlist_type", "end_list", error.alias("error"))
