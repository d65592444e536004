"""Media files as tables.

``read`` loads files with Spark's binaryFile source, so they may lie in any store; the other functions take a table with
file_id and content and give one row a sample, block, packet or frame. A file that can't be read gives a row in the
errors table, or raises, by ``errors``. Every result has the file's id and an explicit ordinal.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.integer import be_uint, le_uint
from framewright.operators import containers as C
from framewright.sources import bitstreams, containers, fonts, images
from framewright.sources.bits import Invalid, Unsupported


def read(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """file_id (the path), length and content of files; content is only read where it is used."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file_id"), "length", "content")


def _arrow(schema: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def parse(files: DataFrame, kernel: Callable[[bytes], list[dict]], schema: str, errors: str = "skip") -> DataFrame:
    """Rows that ``kernel`` makes of each file's content, with file_id in front.

    ``errors``: "skip" leaves broken files out, "row" gives them one row with the column error, "raise" stops.
    """
    full = f"file_id string, {schema}" + ", error string" * (errors == "row")

    form = _arrow(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows += [{"file_id": file} | r for r in kernel(content.as_py() or b"")]
                except (Invalid, Unsupported) as e:
                    if errors == "raise":
                        raise
                    if errors == "row":
                        rows.append({"file_id": file, "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(rows, schema=form)

    return files.select(F.col("file_id").cast("string"), "content").mapInArrow(run, full)


WEBM_TRACKS = "number bigint, kind string, codec string, width bigint, height bigint, sampling_frequency double, channels bigint, bit_depth bigint, codec_delay_ns bigint, seek_pre_roll_ns bigint, default_duration_ns bigint, codec_private binary"
WEBM_BLOCKS = "n bigint, track bigint, kind string, timestamp_ns bigint, key_frame boolean, packets array<binary>, discard_padding_ns bigint"


def webm_tracks(files: DataFrame, errors: str = "skip") -> DataFrame:
    return parse(files, lambda b: containers.webm(b, False)[0], WEBM_TRACKS, errors)


def webm_blocks(files: DataFrame, audio: bool = True, errors: str = "skip") -> DataFrame:
    """Without ``audio`` only video blocks are taken from the files."""
    return parse(files, lambda b: containers.webm(b, audio)[1], WEBM_BLOCKS, errors)


_MP4 = {
    "tracks": "track string, timescale bigint, media_start bigint, codec string, width int, height int",
    "stsz": "track string, n bigint, size bigint",
    "stsc": "track string, run int, first_chunk bigint, per_chunk bigint, description int",
    "stco": "track string, chunk bigint, chunk_offset bigint",
    "stts": "track string, run int, run_count bigint, delta bigint",
    "ctts": "track string, run int, run_count bigint, composition bigint",
    "stss": "track string, n bigint",
}


def mp4_table(files: DataFrame, name: str, errors: str = "skip") -> DataFrame:
    """One of a movie's tables: tracks, stsz, stsc, stco, stts, ctts, stss."""
    return parse(files, lambda b: containers.mp4_tables(b)[name], _MP4[name], errors)


def mp4_samples(files: DataFrame) -> DataFrame:
    """Every sample of every track of classic MP4 files."""
    return C.samples(*(mp4_table(files, n) for n in ("stsz", "stsc", "stco", "stts", "ctts", "stss")))


def mp4_fragments(files: DataFrame, errors: str = "row") -> DataFrame:
    """Every sample of every fragment of fragmented MP4 files, in file order."""
    return parse(files, containers.fragment_samples, "fragment bigint, track bigint, n bigint, offset bigint, size bigint, decode_time bigint, presentation_time bigint, keyframe boolean", errors)


def mp4_boxes(files: DataFrame, errors: str = "skip") -> DataFrame:
    return parse(files, lambda b: [{"n": i, "path": p, "first": a, "last": z} for i, (p, a, z) in enumerate(containers.box_tree(b))], "n bigint, path string, first bigint, last bigint", errors)


def wav_format(files: DataFrame, errors: str = "skip") -> DataFrame:
    return parse(files, lambda b: [containers.wav(b)], "float boolean, channels int, rate int, bits int, align int, offset bigint, frames bigint", errors)


def pcm(raw: bytes, bits: int, floating: bool = False, unsigned: bool = False, big: bool = False) -> np.ndarray:
    """Samples from -1 to 1 of raw PCM. Values that aren't finite are an error."""
    if bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        b = b[:, ::-1] if big else b
        x = ((b[:, 0].astype(np.int64) | b[:, 1].astype(np.int64) << 8 | b[:, 2].astype(np.int64) << 16) ^ 1 << 23) - (1 << 23)
    else:
        order = ">" if big else "<"
        x = np.frombuffer(raw, f"{order}{'f' if floating else 'u' if unsigned else 'i'}{bits // 8}")
    if floating:
        if not np.isfinite(x).all():
            raise Invalid("sample")
        return np.clip(x.astype(np.float64), -1, 1).astype(np.float32)
    half = float(1 << (bits - 1))
    return ((x.astype(np.float64) - (half if unsigned else 0)) / half).astype(np.float32)


def wav_packets(files: DataFrame, frames: int = 4096, errors: str = "skip") -> DataFrame:
    """packet, timestamp_ns, sample_rate, channels, samples: at most ``frames`` frames a packet."""

    def kernel(data: bytes) -> list[dict]:
        f = containers.wav(data)
        out = []
        for i, first in enumerate(range(0, f["frames"], frames)):
            n = min(frames, f["frames"] - first)
            raw = data[f["offset"] + first * f["align"] : f["offset"] + (first + n) * f["align"]]
            out.append({"packet": i, "timestamp_ns": first * 1_000_000_000 // f["rate"], "sample_rate": f["rate"], "channels": f["channels"], "samples": pcm(raw, f["bits"], f["float"], f["bits"] == 8).tolist()})
        return out

    return parse(files, kernel, "packet bigint, timestamp_ns bigint, sample_rate int, channels int, samples array<float>", errors)


def yuv_rgba(y: np.ndarray, u: np.ndarray | None, v: np.ndarray | None, clamp: bool = True) -> np.ndarray:
    """Interleaved opaque pixels of planes; chroma is repeated to the luma's size."""
    h, w = y.shape
    grow = lambda p: np.zeros((h, w), np.int32) if p is None else np.repeat(np.repeat(p.astype(np.int32) - 128, -(-h // p.shape[0]), 0), -(-w // p.shape[1]), 1)[:h, :w]
    d, e = grow(u), grow(v)
    c = y.astype(np.int32) - 16
    c = 298 * (np.maximum(c, 0) if clamp else c)
    out = np.full((h, w, 4), 255, np.uint8)
    for k, x in enumerate((c + 409 * e, c - 100 * d - 208 * e, c + 516 * d)):
        out[..., k] = np.clip((x + 128) >> 8, 0, 255)
    return out


def y4m_frames(files: DataFrame, errors: str = "skip") -> DataFrame:
    """frame_index, width, height, fps_num, fps_den, timestamp, rgba."""

    def kernel(data: bytes) -> list[dict]:
        f = containers.y4m(data)
        w, h, cw, ch = f["width"], f["height"], f["chroma_width"], f["chroma_height"]
        out = []
        for i, at in enumerate(f["frames"]):
            p = np.frombuffer(data, np.uint8, f["frame_bytes"], at)
            y, rest = p[: w * h].reshape(h, w), p[w * h :]
            u, v = (rest[: cw * ch].reshape(ch, cw), rest[cw * ch :].reshape(ch, cw)) if cw else (None, None)
            out.append({"frame_index": i, "width": w, "height": h, "fps_num": f["fps_num"], "fps_den": f["fps_den"], "timestamp": i * f["fps_den"] / f["fps_num"], "rgba": yuv_rgba(y, u, v).tobytes()})
        return out

    return parse(files, kernel, "frame_index bigint, width int, height int, fps_num bigint, fps_den bigint, timestamp float, rgba binary", errors)


def image_info(files: DataFrame, errors: str = "row") -> DataFrame:
    """format, width and height from headers; pixels are never unpacked."""

    def kernel(data: bytes) -> list[dict]:
        w, h = images.dimensions(data)
        return [{"format": images.sniff(data), "width": w, "height": h}]

    return parse(files, kernel, "format string, width bigint, height bigint", errors)


def image_pixels(files: DataFrame, errors: str = "row") -> DataFrame:
    """width, height and premultiplied rgba; plain PNG, BMP and GIF are reconstructed, other formats are Unsupported."""

    def kernel(data: bytes) -> list[dict]:
        kind = images.sniff(data)
        if kind not in images.PIXELS:
            raise Unsupported(kind or "unknown image")
        w, h, rgba = images.PIXELS[kind](data)
        return [{"width": w, "height": h, "rgba": rgba}]

    return parse(files, kernel, "width bigint, height bigint, rgba binary", errors)


def avif_items(files: DataFrame, errors: str = "skip") -> DataFrame:
    """item, type, is_primary, is_alpha, extents, properties of each item of AVIF files."""

    def kernel(data: bytes) -> list[dict]:
        x = images.avif_items(data)
        return [{"item": i, "type": t, "is_primary": i == x["primary"], "is_alpha": i == images.avif_alpha(x), "extents": [{"offset": a, "length": n} for a, n in x["extents"].get(i, ("", []))[1]], "properties": [k for k, _ in x["properties"].get(i, [])]} for i, t in x["items"].items()]

    return parse(files, kernel, "item bigint, type string, is_primary boolean, is_alpha boolean, extents array<struct<offset:bigint,length:bigint>>, properties array<string>", errors)


def font_tables(files: DataFrame, errors: str = "row") -> DataFrame:
    """n, tag, offset, length of an sfnt, WOFF 1 (unpacked) or WOFF 2 (as stored) font."""

    def kernel(data: bytes) -> list[dict]:
        if data[:4] == b"wOF2":
            return [{"n": i, "tag": t["tag"], "offset": None, "length": t["length"]} for i, t in enumerate(fonts.woff2_directory(data))]
        font = fonts.woff1(data) if data[:4] == b"wOFF" else data
        return [{"n": i, "tag": t, "offset": o, "length": n} for i, (t, _, o, n) in enumerate(fonts.sfnt_directory(font))]

    return parse(files, kernel, "n int, tag string, offset bigint, length bigint", errors)


def font_facts(files: DataFrame, errors: str = "row") -> DataFrame:
    """fs_type (embedding rights) and wide_offsets (of glyphs) of sfnt and WOFF 1 fonts; null where a font lacks the table."""
    return parse(files, lambda b: [fonts.facts(fonts.woff1(b) if b[:4] == b"wOFF" else b)], "fs_type int, wide_offsets boolean", errors)


#: Units that ``units`` splits payloads into: name -> (kernel, schema).
UNITS: dict[str, tuple[Callable[[bytes], list[dict]], str]] = {
    "av1": (lambda b: bitstreams.av1_obus(b), "kind int, temporal_id int, spatial_id int, payload binary"),
    "avc4": (lambda b: [{"kind": u[0] & 31, "payload": u} for u in bitstreams.avc_nals(b, 4)], "kind int, payload binary"),
    "annexb": (lambda b: [{"group": g, "kind": u[0] & 31, "payload": u} for g, us in enumerate(bitstreams.annex_b_units(b)) for u in us], "group int, kind int, payload binary"),
    "vp9": (lambda b: [{"payload": f} for f in bitstreams.superframe(b)], "payload binary"),
    "opus": (lambda b: [{"config": p["config"], "samples": p["frame_samples"], "payload": f} for p in [bitstreams.opus_packet(b)] for f in p["frames"]], "config int, samples int, payload binary"),
}


def units(files: DataFrame, kind: str, errors: str = "skip") -> DataFrame:
    """Coded units of each payload, in order (n)."""
    kernel, schema = UNITS[kind]
    return parse(files, lambda b: [{"n": i} | u for i, u in enumerate(kernel(b))], f"n int, {schema}", errors)


#: Headers that ``headers`` reads: name -> (kernel, schema).
HEADERS: dict[str, tuple[Callable[[bytes], dict], str]] = {
    "adts": (bitstreams.adts_header, "object_type int, rate int, channels int, header_length int, frame_length int"),
    "aac": (bitstreams.aac_config, "object_type int, rate int, channels int, frame_length int"),
    "opus_head": (bitstreams.opus_head, "channels int, pre_skip int, input_rate bigint, gain int, family int"),
    "vorbis": (bitstreams.vorbis_id, "channels int, rate bigint, short int, long int"),
    "avc_sequence": (bitstreams.avc_sequence, "id int, profile int, level int, chroma int, depth int, frame_num_bits int, order_type int, order_bits int, references int, width int, height int, progressive boolean"),
    "avc_picture": (bitstreams.avc_picture, "id int, sequence int, cabac boolean, references0 int, references1 int, weighted boolean, bipredictive int, qp int, chroma_qp int, transform8 boolean"),
    "vp8": (bitstreams.vp8_header, "key boolean, version int, shown boolean, first_partition bigint, width int, height int, x_scale int, y_scale int"),
    "vp9": (bitstreams.vp9_header, "profile int, show_existing int, key boolean, shown boolean, resilient boolean, depth int, width int, height int"),
    "av1_sequence": (bitstreams.av1_sequence, "profile int, still boolean, reduced boolean, level int, max_width int, max_height int"),
    "eot": (fonts.eot_header, "total bigint, font_size bigint, version bigint, flags bigint, fs_type int, family string, roots array<string>, data_offset bigint"),
}


def headers(files: DataFrame, kind: str, errors: str = "row") -> DataFrame:
    """One row of header fields a payload."""
    kernel, schema = HEADERS[kind]
    names = [c.split(" ")[0] for c in schema.split(", ")]
    return parse(files, lambda b: [{k: v for k, v in kernel(b).items() if k in names}], schema, errors)


def in_chunks(files: DataFrame, size: int) -> DataFrame:
    """file_id, seq, bytes: contents cut into chunks, as a stream would bring them."""
    at = F.sequence(F.lit(0).cast("long"), F.floor((F.length("content") - 1) / size))
    return files.where(F.length("content") > 0).select("file_id", F.explode(at).alias("seq"), "content").select("file_id", "seq", F.substring(F.col("content"), (F.col("seq") * size + 1).cast("int"), F.lit(size)).alias("bytes"))


def from_chunks(chunks: DataFrame) -> DataFrame:
    """file_id and content of chunks put together in order of seq."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("seq")
        out = io.BytesIO()
        for b in t.column("bytes"):
            out.write(b.as_py() or b"")
        return pa.table({"file_id": t.column("file_id")[:1], "content": pa.array([out.getvalue()], pa.binary())})

    return chunks.groupBy("file_id").applyInArrow(run, f"file_id {dict(chunks.dtypes)['file_id']}, content binary")


def native_headers(files: DataFrame) -> DataFrame:
    """Sizes that need no more than fixed offsets, as column expressions: PNG, GIF and BMP."""
    c = F.col("content")
    png, gif, bmp = F.startswith(c, F.lit(b"\x89PNG\r\n\x1a\n")), F.startswith(c, F.lit(b"GIF8")), F.startswith(c, F.lit(b"BM"))
    return files.select(
        "file_id",
        F.when(png, "png").when(gif, "gif").when(bmp, "bmp").alias("format"),
        F.when(png, be_uint(c, 16, 4)).when(gif, le_uint(c, 6, 2)).when(bmp, le_uint(c, 18, 4)).alias("width"),
        F.when(png, be_uint(c, 20, 4)).when(gif, le_uint(c, 8, 2)).when(bmp, le_uint(c, 22, 4)).alias("height"),
    )
