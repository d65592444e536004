"""Sample tables of container files as relations: run tables in, one row a sample out.

A file's tables are ``stsz`` (n, size), ``stsc`` (first_chunk, per_chunk), ``stco`` (chunk, chunk_offset), ``stts``
(run, run_count, delta), ``ctts`` (run, run_count, composition) and ``stss`` (n), all with file_id and track and counted
from 1. Everything is joined by (file_id, track); no step looks at more than one row of a run at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from framewright.operators.sequence import as_of_run, exclusive_sum, expand_runs, ordered

FILE = ["file_id", "track"]


def numbered_runs(runs: DataFrame, value: str) -> DataFrame:
    """file_id, track, n from 1, value: the runs of a table written out."""
    runs = exclusive_sum(runs, FILE, ["run"], "run_count", "before")
    return expand_runs(runs, "run_count").select(*FILE, (F.col("before") + F.col("i") + 1).cast("long").alias("n"), F.col(value).cast("long"))


def chunk_members(stsc: DataFrame, stco: DataFrame) -> DataFrame:
    """file_id, track, n, chunk, chunk_offset: which chunk holds sample n.

    A run of ``stsc`` holds for its first chunk and all up to the next run's.
    """
    chunks = as_of_run(stco.select(*FILE, "chunk", "chunk_offset"), stsc.select(*FILE, "first_chunk", "per_chunk"), FILE, "chunk", "first_chunk", ["per_chunk"])
    chunks = exclusive_sum(chunks, FILE, ["chunk"], "per_chunk", "before")
    return expand_runs(chunks, "per_chunk").select(*FILE, (F.col("before") + F.col("i") + 1).cast("long").alias("n"), "chunk", "chunk_offset")


def samples(stsz: DataFrame, stsc: DataFrame, stco: DataFrame, stts: DataFrame, ctts: DataFrame, stss: DataFrame) -> DataFrame:
    """file_id, track, n, chunk, offset, size, decode_time, presentation_time, keyframe.

    Without a ctts entry a sample is shown when decoded; a track without stss has only keyframes.
    """
    where = chunk_members(stsc, stco)
    rows = stsz.select(*FILE, "n", "size").join(where, [*FILE, "n"])
    rows = exclusive_sum(rows, [*FILE, "chunk"], ["n"], "size", "inside")
    times = exclusive_sum(numbered_runs(stts, "delta"), FILE, ["n"], "delta", "decode_time").select(*FILE, "n", "decode_time")
    rows = rows.join(times, [*FILE, "n"]).join(numbered_runs(ctts, "composition"), [*FILE, "n"], "left")
    rows = rows.join(stss.select(*FILE, "n", F.lit(True).alias("sync")).distinct(), [*FILE, "n"], "left")
    rows = rows.join(stss.groupBy(*FILE).agg(F.lit(True).alias("listed")), FILE, "left")
    return rows.select(
        *FILE, "n", "chunk", (F.col("chunk_offset") + F.col("inside")).alias("offset"), "size", "decode_time",
        (F.col("decode_time") + F.coalesce("composition", F.lit(0))).alias("presentation_time"), (F.col("sync").isNotNull() | F.col("listed").isNull()).alias("keyframe"),
    )


def run_coverage(stsz: DataFrame, runs: DataFrame) -> DataFrame:
    """Tracks whose runs don't cover exactly the samples there are: must be empty."""
    have = stsz.groupBy(*FILE).agg(F.count(F.lit(1)).alias("samples"))
    cover = runs.groupBy(*FILE).agg(F.sum("run_count").alias("covered"))
    return have.join(cover, FILE, "full").where(~F.col("samples").eqNullSafe(F.col("covered")))


def fragment_samples(runs: DataFrame, headers: DataFrame, defaults: DataFrame) -> DataFrame:
    """Samples of fragments: what a run leaves open comes from its track's header, then from the file's defaults.

    ``runs``: file_id, track, i, duration?, size?, flags?, composition?, data_offset; ``headers``: file_id, track,
    h_duration?, h_size?, h_flags?, base_time; ``defaults``: file_id, track, d_duration, d_size, d_flags. A track without
    defaults gives no sample. Bit 16 of the flags marks samples that aren't keyframes.
    """
    rows = runs.join(headers, FILE).join(defaults, FILE)
    for c in ("duration", "size", "flags"):
        rows = rows.withColumn(c, F.coalesce(c, f"h_{c}", f"d_{c}").cast("long"))
    rows = exclusive_sum(rows, FILE, ["i"], "size", "inside")
    rows = exclusive_sum(rows, FILE, ["i"], "duration", "since")
    time = F.col("base_time") + F.col("since")
    return rows.select(*FILE, "i", (F.col("data_offset") + F.col("inside")).alias("offset"), "size", time.alias("decode_time"), (time + F.coalesce("composition", F.lit(0))).alias("presentation_time"), (F.col("flags").bitwiseAND(0x10000) == 0).alias("keyframe"))


def without_defaults(runs: DataFrame, defaults: DataFrame) -> DataFrame:
    """Tracks that have fragments and no defaults, whose samples ``fragment_samples`` leaves out: must be empty."""
    return runs.select(*FILE).distinct().join(defaults, FILE, "left_anti")


def media_end(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file_id").agg(F.max(F.col("offset") + F.col("size")).alias("media_end"))


def undelivered(rows: DataFrame, packets: DataFrame) -> DataFrame:
    """Samples for which no packet came: must be empty at the end of a file."""
    return rows.join(packets.select(*FILE, "n").distinct(), [*FILE, "n"], "left_anti")


def not_monotonic(rows: DataFrame) -> DataFrame:
    """Samples that lie before the one in front of them, or behind the file's end (file_size)."""
    before = F.lag("offset").over(ordered(FILE, "n"))
    return rows.withColumn("before", before).where((F.col("before") > F.col("offset")) | (F.col("offset") + F.col("size") > F.col("file_size"))).drop("before")


def in_ranges(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Samples that lie whole inside one of the data ranges (first, last) of their file; ranges don't overlap."""
    found = as_of_run(rows, ranges.select("file_id", "first", "last"), ["file_id"], "offset", "first", ["last"])
    return found.where(F.col("offset") + F.col("size") <= F.col("last"))


def first_supported(tracks: DataFrame, codecs: list[str]) -> DataFrame:
    """The first track of each kind whose codec is supported."""
    w = W.partitionBy("file_id", "kind").orderBy("number")
    return tracks.where(F.col("codec").isin(codecs)).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def nearest_references(pictures: DataFrame, keys: list[str], poc: str, current: str) -> DataFrame:
    """Two reference lists by picture order: earlier ones nearest first, then later ones, and the other way round."""
    all_ = F.array_sort(F.collect_list(poc))
    rows = pictures.groupBy(*keys, current).agg(all_.alias("all"))
    past, future = F.reverse(F.filter("all", lambda p: p < F.col(current))), F.filter("all", lambda p: p > F.col(current))
    return rows.select(*keys, current, F.concat(past, future).alias("list0"), F.concat(future, past).alias("list1"))
