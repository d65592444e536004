"""Byte layouts of container files: EBML, ISO boxes, transport packets, RIFF and Y4M, read into plain rows.

Functions here work on the bytes of one file. They are the kernels of readers.py, which runs them over tables.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from framewright.sources.bits import Incomplete, Invalid, Unsupported, ebml_id, ebml_size

# EBML element ids.
SEGMENT, INFO, TRACKS, CLUSTER, TRACK, VIDEO, AUDIO, GROUP = 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0xAE, 0xE0, 0xE1, 0xA0
EBML, DOCTYPE, SCALE, NUMBER, KIND, CODEC, PRIVATE, DEFAULT, DELAY, PREROLL = 0x1A45DFA3, 0x4282, 0x2AD7B1, 0xD7, 0x83, 0x86, 0x63A2, 0x23E383, 0x56AA, 0x56BB
WIDTH, HEIGHT, RATE, CHANNELS, DEPTH, TIME, SIMPLE, BLOCK, PADDING = 0xB0, 0xBA, 0xB5, 0x9F, 0x6264, 0xE7, 0xA3, 0xA1, 0x75A2
PARENTS = frozenset((EBML, SEGMENT, INFO, TRACKS, CLUSTER, TRACK, VIDEO, AUDIO, GROUP))
VIDEO_CODECS, AUDIO_CODECS = ("V_VP8", "V_VP9", "V_AV1"), ("A_OPUS", "A_VORBIS", "A_PCM/INT/LIT", "A_PCM/INT/BIG", "A_PCM/FLOAT/IEEE")


def split_lace(data: bytes, flags: int) -> list[bytes]:
    """Packets of a block's payload by its lacing: none, Xiph, fixed or EBML."""
    kind = flags >> 1 & 3
    if kind == 0:
        return [data]
    if not data:
        raise Invalid("lace")
    count, at = data[0] + 1, 1
    if count < 2:
        raise Invalid("lace count")
    if kind == 2:
        size, rest = divmod(len(data) - 1, count)
        if rest or not size:
            raise Invalid("fixed lace")
        sizes = [size] * count
    else:
        sizes = []
        if kind == 1:
            for _ in range(count - 1):
                n = 0
                while True:
                    if at >= len(data):
                        raise Invalid("lace")
                    n += data[at]
                    at += 1
                    if data[at - 1] < 255:
                        break
                sizes.append(n)
        else:
            for i in range(count - 1):
                value, width = ebml_size(data, at)
                if value is None:
                    raise Invalid("lace")
                sizes.append(value if not i else sizes[-1] + value - ((1 << 7 * width - 1) - 1))
                at += width
        sizes.append(len(data) - at - sum(sizes))
        if min(sizes) < 0:
            raise Invalid("lace sizes")
    out = []
    for n in sizes:
        out.append(data[at : at + n])
        at += n
    return out


def ebml_elements(data: bytes) -> Iterator[tuple[tuple[int, ...], int, bytes]]:
    """(ids of the parents, id, payload) of leaves in order; a parent is given with an empty payload when it ends.

    Parents of unknown size end where an element begins that can't be inside them.
    """
    stack: list[tuple[int, int | None]] = []
    at = 0
    while at < len(data) or stack:
        while stack and stack[-1][1] is not None and at >= stack[-1][1]:
            yield tuple(i for i, _ in stack[:-1]), stack.pop()[0], b""
        if at >= len(data):
            while stack:
                if stack[-1][1] is not None and stack[-1][1] > len(data):
                    raise Incomplete("element")
                yield tuple(i for i, _ in stack[:-1]), stack.pop()[0], b""
            return
        number, width = ebml_id(data, at)
        while stack and stack[-1][1] is None and (number in (CLUSTER, TRACKS, INFO) and stack[-1][0] == CLUSTER or number == SEGMENT):
            yield tuple(i for i, _ in stack[:-1]), stack.pop()[0], b""
        size, more = ebml_size(data, at + width)
        at += width + more
        if number in PARENTS:
            if size is None and number not in (SEGMENT, CLUSTER):
                raise Invalid("unknown size")
            stack.append((number, None if size is None else at + size))
            continue
        if size is None:
            raise Invalid("unknown size")
        if at + size > len(data):
            raise Incomplete("element")
        yield tuple(i for i, _ in stack), number, data[at : at + size]
        at += size


def _float(data: bytes) -> float:
    if len(data) not in (0, 4, 8):
        raise Invalid("float size")
    return struct.unpack(">f" if len(data) == 4 else ">d", data)[0] if data else 0.0


def webm(data: bytes, audio: bool = True) -> tuple[list[dict], list[dict]]:
    """Tracks and blocks of a file. Without ``audio`` the audio payloads aren't taken.

    Of each kind only the first supported track has blocks. A video block with lacing isn't supported.
    """
    tracks: list[dict] = []
    blocks: list[dict] = []
    current: dict = {}
    group: dict = {}
    scale, cluster, chosen = 1_000_000, 0, {}
    doctype = None

    def take(raw: bytes, simple: bool) -> dict | None:
        number, width = ebml_size(raw)
        if number is None or len(raw) < width + 3:
            raise Invalid("block")
        relative, flags = struct.unpack(">hB", raw[width : width + 3])
        kind = next((k for k, t in chosen.items() if t["number"] == number), None)
        if kind is None or kind == "audio" and not audio:
            return None
        body = raw[width + 3 :]
        if kind == "video" and flags & 6:
            raise Unsupported("laced video")
        time = (cluster + relative) * scale
        if cluster + relative < 0:
            raise Invalid("time before the start")
        key = bool(flags & 0x80) if simple else bool(body) and not body[0] & 1
        return {"n": len(blocks), "track": number, "kind": kind, "timestamp_ns": time, "key_frame": key, "packets": split_lace(body, flags), "discard_padding_ns": 0}

    for parents, number, body in ebml_elements(data):
        whole = int.from_bytes(body, "big") if len(body) <= 8 else 0
        if number == DOCTYPE:
            doctype = body.rstrip(b"\0").decode("ascii", "replace")
            if doctype not in ("webm", "matroska"):
                raise Unsupported("document type")
        elif number == SCALE and parents[-1:] == (INFO,):
            if not whole:
                raise Invalid("time scale")
            scale = whole
        elif TRACK in parents:
            if number == CODEC:
                current["codec"] = body.rstrip(b"\0").decode("ascii", "replace")
            elif number == PRIVATE:
                current["codec_private"] = body
            elif number == RATE:
                current["sampling_frequency"] = _float(body)
            elif (name := {NUMBER: "number", KIND: "kind", DEFAULT: "default_duration_ns", DELAY: "codec_delay_ns", PREROLL: "seek_pre_roll_ns", WIDTH: "width", HEIGHT: "height", CHANNELS: "channels", DEPTH: "bit_depth"}.get(number)) is not None:
                current[name] = whole
        elif number == TRACK:
            kind = {1: "video", 2: "audio"}.get(current.get("kind"))
            track = {"number": 0, "codec": None, "width": None, "height": None, "sampling_frequency": 8000.0 if kind == "audio" else None, "channels": 1 if kind == "audio" else None, "bit_depth": None, "codec_delay_ns": 0, "seek_pre_roll_ns": 0, "default_duration_ns": None, "codec_private": None} | current | {"kind": kind}
            if track["codec"] == "A_OPUS":
                track["sampling_frequency"] = 48000.0
            tracks.append(track)
            if kind and track["codec"] in (VIDEO_CODECS if kind == "video" else AUDIO_CODECS):
                chosen.setdefault(kind, track)
            current = {}
        elif number == TIME and parents[-1:] == (CLUSTER,):
            cluster = whole
        elif number == SIMPLE:
            if (b := take(body, True)) is not None:
                blocks.append(b)
        elif number == BLOCK and parents[-1:] == (GROUP,):
            group["block"] = take(body, False)
        elif number == PADDING and parents[-1:] == (GROUP,):
            group["padding"] = int.from_bytes(body, "big", signed=True)
        elif number == GROUP:
            if group.get("block") is not None:
                if group["block"]["kind"] == "audio":
                    group["block"]["discard_padding_ns"] = group.get("padding", 0)
                blocks.append(group["block"] | {"n": len(blocks)})
            group = {}
    if doctype is None or not tracks:
        raise Invalid("no document type or track")
    return tracks, blocks


def boxes(data: bytes, first: int = 0, end: int | None = None) -> Iterator[tuple[str, int, int]]:
    """(kind, payload start, payload end) of sibling boxes."""
    end = len(data) if end is None else end
    while first < end:
        if first + 8 > end:
            raise Incomplete("box")
        size, kind, head = int.from_bytes(data[first : first + 4], "big"), data[first + 4 : first + 8].decode("latin-1"), 8
        if size == 1:
            if first + 16 > end:
                raise Incomplete("box")
            size, head = int.from_bytes(data[first + 8 : first + 16], "big"), 16
        elif size == 0:
            size = end - first
        if size < head:
            raise Invalid("box size")
        if first + size > end:
            raise Incomplete("box")
        yield kind, first + head, first + size
        first += size


_HOLDERS = frozenset(("moov", "trak", "mdia", "minf", "stbl", "mvex", "moof", "traf", "edts", "dinf"))


def box_tree(data: bytes, first: int = 0, end: int | None = None, path: str = "") -> Iterator[tuple[str, int, int]]:
    """(path, payload start, payload end) of all boxes, parents before children."""
    for kind, a, b in boxes(data, first, end):
        yield f"{path}/{kind}", a, b
        if kind in _HOLDERS:
            yield from box_tree(data, a, b, f"{path}/{kind}")


def _full(data: bytes, a: int, b: int) -> tuple[int, int, int]:
    """Version, flags and where the rest begins."""
    if b - a < 4:
        raise Incomplete("full box")
    return data[a], int.from_bytes(data[a + 1 : a + 4], "big"), a + 4


def _numbers(data: bytes, at: int, end: int, width: int, rows: int, form: str) -> list[tuple]:
    if at + rows * width > end:
        raise Incomplete("table")
    return list(struct.iter_unpack(form, data[at : at + rows * width]))


def mp4_tables(data: bytes) -> dict[str, list[dict]]:
    """tracks, stsz, stsc, stco, stts, ctts and stss of a file's movie, each a list of rows."""
    movie = next(((a, b) for k, a, b in boxes(data) if k == "moov"), None)
    if movie is None:
        raise Incomplete("movie")
    if movie[1] - movie[0] > 32 << 20:
        raise Invalid("movie too large")
    out: dict[str, list[dict]] = {k: [] for k in ("tracks", "stsz", "stsc", "stco", "stts", "ctts", "stss")}
    for t, (kind, a, b) in enumerate(x for x in boxes(data, *movie) if x[0] == "trak"):
        found = {p.rpartition("/")[2]: (x, y) for p, x, y in box_tree(data, a, b)}
        if not {"mdhd", "hdlr", "stsd"} <= set(found):
            raise Invalid("track")
        version, _, at = _full(data, *found["mdhd"])
        scale = int.from_bytes(data[at + (16 if version else 8) : at + (20 if version else 12)], "big")
        handler = data[found["hdlr"][0] + 8 : found["hdlr"][0] + 12].decode("latin-1")
        track = f"{ {'vide': 'video', 'soun': 'audio'}.get(handler, handler) }{t}"
        codec, x, y = next(boxes(data, found["stsd"][0] + 8, found["stsd"][1]), (None, 0, 0))
        size = struct.unpack(">HH", data[x + 24 : x + 28]) if handler == "vide" and y - x >= 28 else (None, None)
        start = 0
        if "elst" in found:
            version, _, at = _full(data, *found["elst"])
            if int.from_bytes(data[at : at + 4], "big") == 1:
                start = int.from_bytes(data[at + 12 : at + 20] if version else data[at + 8 : at + 12], "big", signed=True)
                rate = data[at + 20 : at + 24] if version else data[at + 12 : at + 16]
                if start < 0 or rate != b"\0\1\0\0":
                    raise Unsupported("edit list")
        out["tracks"].append({"track": track, "timescale": scale, "media_start": start, "codec": codec, "width": size[0], "height": size[1]})

        def table(name: str, width: int, form: str, skip: int = 0) -> list[tuple]:
            if name not in found:
                return []
            _, _, at = _full(data, *found[name])  # noqa: B023
            return _numbers(data, at + skip + 4, found[name][1], width, int.from_bytes(data[at + skip : at + skip + 4], "big"), form)  # noqa: B023

        if "stsz" in found:
            at = found["stsz"][0] + 4
            same, count = struct.unpack(">II", data[at : at + 8])
            if count > 1_000_000:
                raise Invalid("too many samples")
            sizes = [same] * count if same else [r[0] for r in table("stsz", 4, ">I", 4)]
            out["stsz"] += [{"track": track, "n": i + 1, "size": s} for i, s in enumerate(sizes)]
        out["stsc"] += [{"track": track, "run": i, "first_chunk": r[0], "per_chunk": r[1], "description": r[2]} for i, r in enumerate(table("stsc", 12, ">III"))]
        offsets = table("stco", 4, ">I") or table("co64", 8, ">Q")
        out["stco"] += [{"track": track, "chunk": i + 1, "chunk_offset": r[0]} for i, r in enumerate(offsets)]
        out["stts"] += [{"track": track, "run": i, "run_count": r[0], "delta": r[1]} for i, r in enumerate(table("stts", 8, ">II"))]
        signed = "ctts" in found and data[found["ctts"][0]] == 1
        out["ctts"] += [{"track": track, "run": i, "run_count": r[0], "composition": r[1]} for i, r in enumerate(table("ctts", 8, ">Ii" if signed else ">II"))]
        out["stss"] += [{"track": track, "n": r[0]} for r in table("stss", 4, ">I")]
    return out


# Flags of a fragment's track header and runs, with the field each stands for, in order.
TRACK_FIELDS = ((0x1, "base", 8), (0x2, "description", 4), (0x8, "duration", 4), (0x10, "size", 4), (0x20, "flags", 4))
RUN_FIELDS = ((0x1, "offset", 4), (0x4, "first_flags", 4))
SAMPLE_FIELDS = ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "composition"))
BASE_IS_FRAGMENT, NOT_SYNC = 0x20000, 0x10000


def _fields(data: bytes, at: int, end: int, flags: int, known) -> tuple[dict[str, int], int]:
    out = {}
    for bit, name, size in known:
        if flags & bit:
            if at + size > end:
                raise Incomplete(name)
            out[name] = int.from_bytes(data[at : at + size], "big", signed=name == "offset")
            at += size
    return out, at


def _one(data: bytes, found: list[tuple[str, int, int]], kind: str, needed: bool = True) -> tuple[int, int] | None:
    here = [(a, b) for k, a, b in found if k == kind]
    if len(here) > 1 or needed and not here:
        raise Invalid(f"{kind}: {len(here)} boxes")
    return here[0] if here else None


def fragment_defaults(data: bytes) -> dict[int, dict[str, int]]:
    """Of each track of a fragmented movie what its fragments may leave open."""
    movie = next(((a, b) for k, a, b in boxes(data) if k == "moov"), None)
    extends = movie and next(((a, b) for k, a, b in boxes(data, *movie) if k == "mvex"), None)
    if not extends:
        raise Unsupported("no fragments")
    out: dict[int, dict[str, int]] = {}
    for kind, a, b in boxes(data, *extends):
        if kind == "trex":
            version, flags, at = _full(data, a, b)
            if b - at < 20:
                raise Incomplete("trex")
            number, *values = struct.unpack(">5I", data[at : at + 20])
            if version or flags:
                raise Unsupported("trex")
            if not number or number in out:
                raise Invalid("track defaults")
            out[number] = dict(zip(("description", "duration", "size", "flags"), values, strict=True))
    return out


def fragment_samples(data: bytes) -> list[dict]:
    """Samples of all fragments of a file: what a run leaves open comes from its header, then from the track's defaults.

    A run without an offset goes on where the one before ended. A fragment without a time goes on where the track's last
    one ended. The flags for a run's first sample are for a run that has none of its own.
    """
    defaults, clock, out = fragment_defaults(data), {}, []
    for number, (start, a, b) in enumerate((s, a, b) for s, k, a, b in _placed(data) if k == "moof"):
        parts = list(boxes(data, a, b))
        _one(data, parts, "mfhd")
        data_end = start
        for t, (x, y) in enumerate((x, y) for k, x, y in parts if k == "traf"):
            inner = list(boxes(data, x, y))
            if any(k in ("senc", "saiz", "saio") for k, _, _ in inner):
                raise Unsupported("encrypted fragment")
            _, flags, at = _full(data, *(header := _one(data, inner, "tfhd")))
            if at + 4 > header[1]:
                raise Incomplete("tfhd")
            track = int.from_bytes(data[at : at + 4], "big")
            if track not in defaults:
                raise Invalid(f"track {track} without defaults")
            own, _ = _fields(data, at + 4, header[1], flags, TRACK_FIELDS)
            base = own.get("base", start if flags & BASE_IS_FRAGMENT or not t else data_end)
            known = defaults[track] | own
            if known["description"] != 1:
                raise Unsupported("sample description")
            if time := _one(data, inner, "tfdt", False):
                version, _, at = _full(data, *time)
                clock[track] = int.from_bytes(data[at : at + (8 if version else 4)], "big")
            now, at_byte = clock.get(track, 0), base
            for k, p, q in inner:
                if k != "trun":
                    continue
                version, flags, at = _full(data, p, q)
                if flags & 0x404 == 0x404:
                    raise Invalid("flags for the first sample and for each")
                count = int.from_bytes(data[at : at + 4], "big")
                run, at = _fields(data, at + 4, q, flags, RUN_FIELDS)
                at_byte = base + run["offset"] if "offset" in run else at_byte
                names = [name for bit, name in SAMPLE_FIELDS if flags & bit]
                form = ">" + "".join("i" if name == "composition" and version else "I" for name in names)
                rows = _numbers(data, at, q, 4 * len(names), count, form) if names else [()] * count
                for i, row in enumerate(rows):
                    v = known | ({"flags": run["first_flags"]} if not i and "first_flags" in run else {}) | dict(zip(names, row, strict=True))
                    out.append({"fragment": number, "track": track, "n": len(out), "offset": at_byte, "size": v["size"], "decode_time": now, "presentation_time": now + v.get("composition", 0), "keyframe": not v["flags"] & NOT_SYNC})
                    at_byte += v["size"]
                    now += v["duration"]
            clock[track], data_end = now, at_byte
    return out


def _placed(data: bytes) -> Iterator[tuple[int, str, int, int]]:
    """Top-level boxes with where they begin."""
    start = 0
    for kind, a, b in boxes(data):
        yield start, kind, a, b
        start = b


def descriptor(data: bytes, at: int = 0) -> tuple[int, int, int]:
    """Tag, payload start and payload end of a descriptor with a length of up to four bytes."""
    if at >= len(data):
        raise Incomplete("descriptor")
    tag, n = data[at], 0
    for i in range(4):
        if at + 1 + i >= len(data):
            raise Incomplete("descriptor")
        b = data[at + 1 + i]
        n = n << 7 | b & 127
        if b < 128:
            if at + 2 + i + n > len(data):
                raise Incomplete("descriptor")
            return tag, at + 2 + i, at + 2 + i + n
    raise Invalid("descriptor length")


def decoder_config(esds: bytes) -> bytes:
    """The AudioSpecificConfig inside an esds box's payload."""
    tag, a, b = descriptor(esds, 4)
    if tag != 3:
        raise Invalid("descriptor")
    flags, at = esds[a + 2], a + 3
    at += 2 * bool(flags & 0x80)
    if flags & 0x40:
        at += 1 + esds[at]
    at += 2 * bool(flags & 0x20)
    tag, a, b = descriptor(esds, at)
    if tag != 4 or b - a < 13:
        raise Invalid("descriptor")
    if esds[a] not in (0x40, 0x66, 0x67, 0x68):
        raise Unsupported("object type")
    tag, a, b = descriptor(esds, a + 13)
    if tag != 5:
        raise Invalid("descriptor")
    return esds[a:b]


def wav(data: bytes) -> dict:
    """Format and samples' place of a RIFF file."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise Invalid("not RIFF")
    end = min(len(data), 8 + int.from_bytes(data[4:8], "little"))
    if len(data) > end + (end & 1):
        raise Invalid("data behind the file")
    out: dict = {}
    at = 12
    while at + 8 <= end:
        kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        at += 8
        if at + size > end:
            raise Incomplete("chunk")
        if kind == b"fmt ":
            if out or size < 16:
                raise Invalid("format")
            tag, channels, rate, per_second, align, bits = struct.unpack("<HHIIHH", data[at : at + 16])
            if tag not in (1, 3) or bits not in ((8, 16, 24, 32) if tag == 1 else (32,)) or channels not in (1, 2) or not 0 < rate <= 384000:
                raise Unsupported("format")
            if align != channels * bits // 8 or per_second != rate * align:
                raise Invalid("format")
            out = {"float": tag == 3, "channels": channels, "rate": rate, "bits": bits, "align": align}
        elif kind == b"data":
            if not out or "offset" in out:
                raise Invalid("data chunk")
            if size % out["align"]:
                raise Invalid("data size")
            out |= {"offset": at, "frames": size // out["align"]}
        at += size + (size & 1)
    if "offset" not in out:
        raise Invalid("no data")
    return out


def y4m(data: bytes) -> dict:
    """Format, first frame and frame size of a YUV4MPEG2 file."""
    stop = data.find(b"\n", 0, 4097)
    if not data.startswith(b"YUV4MPEG2") or stop < 0:
        raise Invalid("header")
    width = height = rate = None
    chroma = "420"
    for part in data[:stop].decode("latin-1").split(" ")[1:]:
        if part[:1] == "W":
            width = int(part[1:])
        elif part[:1] == "H":
            height = int(part[1:])
        elif part[:1] == "F":
            rate = tuple(map(int, part[1:].split(":")))
        elif part[:1] == "C":
            chroma = "420" if part.startswith("C420") and part[4:5] != "p" else part[1:]
    if chroma not in ("420", "422", "444", "mono"):
        raise Unsupported("chroma")
    if not width or not height or not rate or len(rate) != 2 or not all(rate) or width * height > 8 << 20:
        raise Invalid("size or rate")
    w = 0 if chroma == "mono" else width if chroma == "444" else -(-width // 2)
    h = 0 if chroma == "mono" else -(-height // 2) if chroma == "420" else height
    size, at, frames = width * height + 2 * w * h, stop + 1, []
    while at < len(data):
        line = data.find(b"\n", at, at + 4097)
        if line < 0 or not data.startswith(b"FRAME", at) or line + 1 + size > len(data):
            raise Incomplete("frame")
        frames.append(line + 1)
        at = line + 1 + size
    return {"width": width, "height": height, "fps_num": rate[0], "fps_den": rate[1], "chroma": chroma, "chroma_width": w, "chroma_height": h, "frames": frames, "frame_bytes": size}


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def check_descriptors(data: bytes) -> None:
    """Descriptors must fill their place; those of conditional access aren't read."""
    at = 0
    while at < len(data):
        if at + 2 > len(data) or at + 2 + data[at + 1] > len(data):
            raise Invalid("descriptor")
        if data[at] == 9:
            raise Unsupported("conditional access")
        at += 2 + data[at + 1]


#: Streams of a program at most.
MAX_STREAMS = 16


def program_streams(section: bytes) -> list[tuple[int, int]]:
    """(number, PID) of a program association section, or (stream type, PID) of a program map section."""
    if len(section) < 12 or crc32_mpeg(section):
        raise Invalid("section")
    end = 3 + (int.from_bytes(section[1:3], "big") & 0xFFF) - 4
    if section[0] == 0:
        if (end - 8) % 4:
            raise Invalid("section")
        rows = [struct.unpack(">HH", section[i : i + 4]) for i in range(8, end, 4)]
        out = [(n, pid & 0x1FFF) for n, pid in rows]
        if len({n for n, _ in out}) < len(out) or any(not 0x10 <= pid < 0x1FFF for _, pid in out):
            raise Invalid("program")
        return [(n, pid) for n, pid in out if n]  # number 0 is the network's
    if section[0] != 2:
        raise Invalid("table")
    out, at = [], 12 + (int.from_bytes(section[10:12], "big") & 0xFFF)
    if at > end:
        raise Invalid("section")
    check_descriptors(section[12:at])
    while at + 5 <= end:
        out.append((section[at], int.from_bytes(section[at + 1 : at + 3], "big") & 0x1FFF))
        after = at + 5 + (int.from_bytes(section[at + 3 : at + 5], "big") & 0xFFF)
        if after > end:
            raise Invalid("section")
        check_descriptors(section[at + 5 : after])
        at = after
    if at != end:
        raise Invalid("section")
    if len({p for _, p in out}) < len(out) or any(not 0x10 <= pid < 0x1FFF for _, pid in out):
        raise Invalid("PID")
    if len(out) > MAX_STREAMS:
        raise Invalid("too many streams")
    return out


def pes_header(data: bytes) -> dict:
    """Time stamps and payload start of a packet."""
    if len(data) < 9:
        raise Incomplete("header")
    if data[:3] != b"\0\0\1" or data[6] >> 6 != 2:
        raise Invalid("start code")
    has, size = data[7] >> 6, data[8]
    if has == 1 or len(data) < 9 + size:
        raise Invalid("header")

    def stamp(at: int) -> int:
        b = data[at : at + 5]
        if len(b) < 5 or not b[0] & b[2] & b[4] & 1:
            raise Invalid("time stamp")
        return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1

    return {"pts": stamp(9) if has else None, "dts": stamp(14) if has == 3 else None, "payload": 9 + size, "length": int.from_bytes(data[4:6], "big")}
