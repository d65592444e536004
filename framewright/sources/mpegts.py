"""Transport streams as relations: packets, tables, counters and elementary packets.

Packets have a fixed size, so a file's bytes are cut into rows once; header fields are bit operations on columns. A packet
that breaks the format is reported by ``faults`` and ends whatever was being put together in its file: the next packet of
every PID counts as one after a loss. Units that lost a packet or end short are rows with an error and without data.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from framewright.functions.integer import be_uint, shr
from framewright.operators.sequence import as_of_run, assemble, islands
from framewright.sources import containers
from framewright.sources.bits import Incomplete, Invalid
from framewright.sources.readers import parse

SIZE, NULL, STAMP_BITS = 188, 0x1FFF, 33
#: Packets of a batch.
ROWS = 1 << 14
# Stream types that are read.
CODECS = {0x1B: "h264", 0x0F: "aac"}


def packets(files: DataFrame) -> DataFrame:
    """file_id, n, packet: 188 bytes each; a rest at the end is an incomplete packet and left out."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                whole = len(content.as_buffer()) // SIZE if content.is_valid else 0
                for first in range(0, whole, ROWS):  # the bytes aren't copied, only looked at
                    n = min(ROWS, whole - first)
                    bytes_ = pa.Array.from_buffers(pa.binary(SIZE), n, [None, content.as_buffer().slice(first * SIZE, n * SIZE)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([file.as_py()] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), bytes_], names=["file_id", "n", "packet"])

    return files.select(F.col("file_id").cast("string"), "content").mapInArrow(cut, "file_id string, n long, packet binary")


def decode(rows: DataFrame) -> DataFrame:
    """file_id, n, pid, starts, error, counter, control, discontinuity, payload, packet, valid; null packets are dropped."""
    p, head = F.col("packet"), F.col("__framewright_head")
    rows = rows.select("file_id", "n", "packet", be_uint(p, 0, 6).alias("__framewright_head"))  # one number of all that is read
    byte = lambda i: shr(head, 8 * (5 - i)).bitwiseAND(F.lit(255))
    bit = lambda x, k: shr(x, k).bitwiseAND(F.lit(1)) == 1
    control = shr(byte(3), 4).bitwiseAND(F.lit(3))
    extra = F.when(control >= 2, byte(4) + 1).otherwise(0)
    fits = F.when(control == 2, extra == 184).when(control == 3, extra <= 183).otherwise(control == 1)
    rows = rows.select(
        "file_id", "n", shr(head, 24).bitwiseAND(F.lit(0x1FFF)).cast("int").alias("pid"), bit(byte(1), 6).alias("starts"), bit(byte(1), 7).alias("error"), byte(3).bitwiseAND(F.lit(15)).cast("int").alias("counter"), control.cast("int").alias("control"),
        F.when(extra > 1, bit(byte(5), 7)).otherwise(False).alias("discontinuity"), F.when(control.bitwiseAND(F.lit(1)) == 1, F.substring(p, (extra + 5).cast("int"), F.lit(SIZE))).alias("payload"), "packet",
        ((byte(0) == 0x47) & (shr(byte(3), 6) == 0) & fits).alias("valid"),
    )
    return rows.where(F.col("pid") != NULL)


def _comparable(c: Column) -> Column:
    """A packet without its clock bytes, where repetitions may differ."""
    head = be_uint(c, 3, 3)
    clock = (head.bitwiseAND(F.lit(0x200010)) == 0x200010) & (shr(head, 8).bitwiseAND(F.lit(255)) >= 7)
    return F.when(clock, F.concat(F.substring(c, 1, 6), F.substring(c, 13, SIZE))).otherwise(c)


def faults(rows: DataFrame) -> DataFrame:
    """file_id, n, error: packets that break the format."""
    byte = lambda i: be_uint(F.col("packet"), i, 1)
    what = F.when(byte(0) != 0x47, "sync byte").when(shr(byte(3), 6) != 0, "scrambled").otherwise("adaptation field")
    return rows.where(~F.col("valid")).select("file_id", "n", what.alias("error"))


def checked(rows: DataFrame) -> DataFrame:
    """Payload packets without repetitions, with ``lost``: the counter doesn't follow, the packet says so itself, or a
    broken packet of the file came in between."""
    broken = (~F.col("valid")).cast("int")
    rows = rows.withColumn("resets", F.sum(broken).over(W.partitionBy("file_id").orderBy("n").rowsBetween(W.unboundedPreceding, 0)))
    w = W.partitionBy("file_id", "pid").orderBy("n")
    rows = rows.where(F.col("valid") & F.col("payload").isNotNull() & ~F.col("error"))
    rows = rows.withColumn("same", F.lag(_comparable(F.col("packet"))).over(w) == _comparable(F.col("packet"))).where(~F.coalesce("same", F.lit(False)))
    before = F.lag("counter").over(w)
    follows = F.col("discontinuity") | (F.col("counter") == (before + 1) % 16)
    reset = F.col("resets") != F.coalesce(F.lag("resets").over(w), F.lit(0))
    return rows.withColumn("lost", F.coalesce(~follows, F.lit(False)) | F.col("discontinuity") | reset).drop("same", "resets")


def sections(rows: DataFrame) -> DataFrame:
    """file_id, pid, first_n, section: table sections put together across packets by the pointer at their start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, begun = None, None, 0
        for batch in batches:
            out: list[tuple] = []
            for file, pid, n, starts, lost, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, pid) != of:
                    of, held = (file, pid), None
                if lost:
                    held = None
                if starts:
                    pointer, payload = payload[0], payload[1:]
                    if held is not None:
                        out.append((*of, begun, held + payload[:pointer]))
                    held, begun, payload = b"", n, payload[pointer:]
                if held is None:
                    continue
                held += payload
                while len(held) >= 3 and held[0] != 0xFF:
                    size = 3 + (int.from_bytes(held[1:3], "big") & 0xFFF)
                    if len(held) < size:
                        break
                    out.append((*of, begun, held[:size]))
                    held = held[size:]
                if held[:1] == b"\xff":
                    held = None
            whole = [r for r in out if len(r[3]) >= 3 and len(r[3]) == 3 + (int.from_bytes(r[3][1:3], "big") & 0xFFF)]
            columns = list(zip(*whole, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["file_id", "pid", "first_n", "section"])

    rows = checked(rows).select(F.col("file_id").cast("string").alias("file_id"), "pid", "n", "starts", "lost", "payload")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number isn't made less where packets are small
    return rows.repartition(parts, "file_id", "pid").sortWithinPartitions("file_id", "pid", "n").mapInArrow(run, "file_id string, pid int, first_n long, section binary")


def _streams(rows: DataFrame, table: int) -> DataFrame:
    def kernel(data: bytes) -> list[dict]:
        if not data or data[0] != table:
            raise Invalid("table")
        return [{"number": n, "pid": pid} for n, pid in containers.program_streams(data)]

    return parse(rows.select("file_id", F.col("section").alias("content")), kernel, "number int, pid int").distinct()


def tables(rows: DataFrame) -> DataFrame:
    """file_id, pid, table, extension, version, sections, conflict: tables that are complete and in force.

    Sections that repeat must repeat their bytes, and all must agree on how many there are; else ``conflict`` says why.
    """
    s = F.col("section")
    byte = lambda i: be_uint(s, i, 1)
    parts = sections(rows).where(F.length("section") >= 12).select("file_id", "pid", "first_n", byte(0).alias("table"), be_uint(s, 3, 2).alias("extension"), shr(byte(5), 1).bitwiseAND(F.lit(31)).alias("version"), byte(5).bitwiseAND(F.lit(1)).alias("current"), byte(6).alias("number"), byte(7).alias("last"), "section")
    keys = ["file_id", "pid", "table", "extension", "version"]
    each = parts.where("current = 1").groupBy(*keys, "number").agg(F.min("section").alias("section"), F.max("section").alias("other"), F.min("last").alias("last"), F.max("last").alias("other_last"), F.min("first_n").alias("first_n"))
    whole = each.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("number", "section"))).alias("all"), F.max("other_last").alias("last"), F.min("first_n").alias("first_n"),
        F.max(F.when(F.col("section") != F.col("other"), "conflicting sections").when(F.col("last") != F.col("other_last"), "number of sections")).alias("conflict"),
    )
    return whole.where(F.size("all") == F.col("last") + 1).select(*keys, "first_n", F.transform("all", lambda x: x["section"]).alias("sections"), "conflict")


def _of_sections(found: DataFrame, table: int) -> DataFrame:
    """file_id, number, pid of the entries of all tables of one kind."""
    return _streams(found.where((F.col("table") == table) & F.col("conflict").isNull()).select("file_id", F.explode("sections").alias("section")), table)


def programs(rows: DataFrame) -> DataFrame:
    """file_id, pid, error: where each file's only program has its map; a file with several programs, or whose tables
    conflict, is a row with an error."""
    found = tables(rows.where("pid = 0"))
    entries = _of_sections(found, 0).groupBy("file_id").agg(F.min("pid").alias("pid"), F.when(F.count(F.lit(1)) > 1, "several programs").alias("error"))
    conflicts = found.where("conflict is not null").select("file_id", F.lit(None).cast("int").alias("pid"), F.col("conflict").alias("error"))
    return entries.select("file_id", "pid", "error").unionByName(conflicts)


def elementary_streams(rows: DataFrame) -> DataFrame:
    """file_id, pid, codec: from the association table to the only program's map; unknown types are left out."""
    found = programs(rows).where("error is null").select("file_id", "pid")
    # other packets than of PIDs that are some file's map stay where they are; there are 8,192 PIDs at most
    maps = rows.join(F.broadcast(found.select("pid").distinct()), "pid", "left_semi").join(found, ["file_id", "pid"], "left_semi")
    codec = F.lit(None).cast("string")
    for number, name in CODECS.items():
        codec = F.when(F.col("number") == number, name).otherwise(codec)
    return _of_sections(tables(maps), 2).select("file_id", "pid", codec.alias("codec")).where("codec is not null")


def whole_times(units: DataFrame, clock: DataFrame, *times: str) -> DataFrame:
    """``units`` (file_id, n, ...) with times of 33 bits made whole: those nearest to the last row of ``clock`` (file_id,
    n, ticks) at or before them, which tells about when packet n is shown. Without such a row times stay as they are."""
    turn, ticks = 1 << STAMP_BITS, F.col("__framewright_ticks")
    known = clock.select(F.col("file_id").cast("string").alias("file_id"), F.col("n").cast("long").alias("n"), F.col("ticks").cast("long").alias("__framewright_ticks"))
    near = lambda t: ticks - turn // 2 + F.pmod(t - ticks + turn // 2, F.lit(turn))
    found = as_of_run(units, known, ["file_id"], "n", "n", ["__framewright_ticks"])
    return found.withColumns({t: F.when(ticks.isNull(), F.col(t)).otherwise(near(F.col(t))) for t in times}).select(*units.columns)


def elementary_packets(rows: DataFrame, streams: DataFrame, clock: DataFrame | None = None) -> DataFrame:
    """file_id, pid, codec, unit, pts, dts, discontinuity, data, error. A unit begins at a packet that says so; one that
    loses a packet or ends short has an error and no data, and the next one is marked. Times have 33 bits, as in the
    file, or are whole by ``clock``, see whole_times."""
    rows = checked(rows).join(streams, ["file_id", "pid"])
    rows = islands(rows, ["file_id", "pid"], ["n"], F.col("starts"), "unit").where("unit > 0")
    flags = rows.groupBy("file_id", "pid", "codec", "unit").agg(F.max(F.col("lost") & ~F.col("starts")).alias("broken"), F.max(F.col("lost") & F.col("starts")).alias("gap"), F.min("n").alias("n"))
    w = W.partitionBy("file_id", "pid").orderBy("unit")
    flags = flags.withColumn("discontinuity", F.col("gap") | F.coalesce(F.lag("broken").over(w), F.lit(False)))
    whole = assemble(rows, ["file_id", "pid", "unit"], "n", "payload").join(flags, ["file_id", "pid", "unit"])

    @F.arrow_udf("struct<pts:long,dts:long,data:binary,error:string>")
    def header(units: pa.Array, broken: pa.Array) -> pa.Array:
        out = []
        for u, lost in zip(units.to_pylist(), broken.to_pylist(), strict=True):
            try:
                if lost:
                    raise Invalid("lost packet")
                h = containers.pes_header(u)
                end = 6 + h["length"] if h["length"] else len(u)
                if end > len(u):
                    raise Incomplete("unit ends short")
                out.append({"pts": h["pts"], "dts": h["dts"], "data": u[h["payload"] : end], "error": None})
            except Invalid as e:
                out.append({"error": f"{type(e).__name__}: {e}"})
        return pa.array(out, pa.struct([("pts", pa.int64()), ("dts", pa.int64()), ("data", pa.binary()), ("error", pa.string())]))

    units = whole.withColumn("h", header("data", "broken")).select("file_id", "pid", "codec", "unit", *(F.col(f"h.{c}").alias(c) for c in ("pts", "dts")), "discontinuity", F.col("h.data").alias("data"), F.col("h.error").alias("error"), "n")
    return (whole_times(units, clock, "pts", "dts") if clock is not None else units).drop("n")
