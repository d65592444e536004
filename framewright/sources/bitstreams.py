"""Headers and framing of coded audio and video units. Each function reads one unit and returns plain values."""

from __future__ import annotations

import struct

from framewright.sources.bits import Bits, Incomplete, Invalid, LowBits, Unsupported

# Sampling frequencies by index, and Opus frame lengths in samples at 48 kHz by configuration group.
AAC_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)
OPUS_FRAMES = {"silk": (480, 960, 1920, 2880), "hybrid": (480, 960), "celt": (120, 240, 480, 960)}


def av1_obus(data: bytes) -> list[dict]:
    """Open bitstream units with a size field each."""
    out, at = [], 0
    while at < len(data):
        b = Bits(data, 8 * at)
        if b.flag():
            raise Invalid("forbidden bit")
        kind, extension, sized, reserved = b.read(4), b.flag(), b.flag(), b.flag()
        if reserved:
            raise Invalid("reserved bit")
        temporal, spatial = (b.read(3), b.read(2)) if extension else (0, 0)
        if extension and b.read(3):
            raise Invalid("reserved bits")
        if not sized:
            raise Unsupported("unit without size")
        size = b.leb128()
        if size > 64 << 20:
            raise Invalid("unit too large")
        at = b.at // 8 + size
        if at > len(data):
            raise Incomplete("unit")
        out.append({"kind": kind, "temporal_id": temporal, "spatial_id": spatial, "payload": data[at - size : at]})
    return out


def avc_nals(data: bytes, prefix: int) -> list[bytes]:
    """Units behind length fields of 1, 2 or 4 bytes."""
    if prefix not in (1, 2, 4):
        raise Invalid("length size")
    out, at = [], 0
    while at < len(data):
        if at + prefix > len(data):
            raise Incomplete("length")
        n = int.from_bytes(data[at : at + prefix], "big")
        at += prefix
        if not n or n > 32 << 20:
            raise Invalid("unit length")
        if at + n > len(data):
            raise Incomplete("unit")
        if data[at] & 0x80 or not data[at] & 31:
            raise Invalid("unit header")
        out.append(data[at : at + n])
        at += n
    return out


def annex_b_units(data: bytes) -> list[list[bytes]]:
    """Units between start codes, grouped: a delimiter behind coded slices begins the next group."""
    pieces = data.replace(b"\0\0\0\1", b"\0\0\1").split(b"\0\0\1")
    if pieces[0].strip(b"\0"):
        raise Invalid("data before the first start code")
    groups: list[list[bytes]] = []
    coded = True
    for unit in (p.rstrip(b"\0") for p in pieces[1:]):
        if not unit or unit[0] & 0x80:
            raise Invalid("unit header")
        if not groups or unit[0] & 31 == 9 and coded:
            groups.append([])
            coded = False
        coded |= 1 <= unit[0] & 31 <= 5
        groups[-1].append(unit)
    return groups


def independent(units: list[bytes]) -> bool:
    """Whether a decoder can start here: both parameter sets, an IDR slice and no other slice."""
    kinds = {u[0] & 31 for u in units}
    return {5, 7, 8} <= kinds and not kinds & {1, 2, 3, 4}


def unescaped(unit: bytes) -> bytes:
    """A unit's payload without emulation prevention bytes."""
    out = bytearray()
    zeros = 0
    for b in unit[1:]:
        if zeros >= 2 and b == 3:
            zeros = 0
            continue
        zeros = zeros + 1 if not b else 0
        out.append(b)
    return bytes(out)


def _skip_scaling_list(b: Bits, size: int) -> None:
    last = following = 8
    for _ in range(size):
        if following:
            following = (last + b.se()) % 256
        last = following or last


def avc_sequence(unit: bytes) -> dict:
    """Sequence parameters."""
    if unit[:1] and unit[0] & 31 != 7:
        raise Invalid("not a sequence parameter set")
    b = Bits(unescaped(unit))
    profile, constraints, level, number = b.read(8), b.read(8), b.read(8), b.ue()
    chroma, depth, depth_c = 1, 8, 8
    if profile in (100, 110, 122, 244, 44, 83, 86, 118, 128, 138, 139, 134, 135):
        chroma = b.ue()
        if chroma > 3:
            raise Invalid("chroma format")
        if chroma == 3:
            b.flag()
        depth, depth_c = 8 + b.ue(), 8 + b.ue()
        b.flag()
        if b.flag():
            for i in range(12 if chroma == 3 else 8):
                if b.flag():
                    _skip_scaling_list(b, 16 if i < 6 else 64)
    frame_bits, order = 4 + b.ue(), b.ue()
    order_bits = 0
    if order == 0:
        order_bits = 4 + b.ue()
    elif order == 1:
        b.flag(), b.se(), b.se()
        for _ in range(min(b.ue(), 255)):
            b.se()
    elif order > 2:
        raise Invalid("picture order type")
    references, gaps = b.ue(), b.flag()
    width, height, progressive = 16 * (b.ue() + 1), b.ue() + 1, b.flag()
    height *= 16 * (2 - progressive)
    if not progressive:
        b.flag()
    b.flag()
    left = right = top = bottom = 0
    if b.flag():
        x, y = (1 if chroma in (0, 3) else 2), (1 if chroma != 1 else 2) * (2 - progressive)
        left, right, top, bottom = x * b.ue(), x * b.ue(), y * b.ue(), y * b.ue()
    if left + right >= width or top + bottom >= height:
        raise Invalid("crop")
    return {"id": number, "profile": profile, "constraints": constraints, "level": level, "chroma": chroma, "depth": depth, "chroma_depth": depth_c, "frame_num_bits": frame_bits, "order_type": order, "order_bits": order_bits, "references": references, "gaps": gaps, "width": width - left - right, "height": height - top - bottom, "progressive": progressive}


def avc_picture(unit: bytes) -> dict:
    """Picture parameters, with the later extension's where they are there."""
    if unit[:1] and unit[0] & 31 != 8:
        raise Invalid("not a picture parameter set")
    raw = unescaped(unit)
    b = Bits(raw)
    out = {"id": b.ue(), "sequence": b.ue(), "cabac": b.flag()}
    b.flag()
    if b.ue():
        raise Unsupported("slice groups")
    out["references0"], out["references1"] = b.ue() + 1, b.ue() + 1
    out["weighted"], out["bipredictive"] = b.flag(), b.read(2)
    out["qp"], _ = 26 + b.se(), b.se()
    out["chroma_qp"] = b.se()
    out["deblocking"], out["constrained_intra"], out["redundant"] = b.flag(), b.flag(), b.flag()
    end = len(raw) * 8 - 1 - ((raw[-1] & -raw[-1]).bit_length() - 1) if raw and raw[-1] else len(raw) * 8
    out["transform8"] = b.flag() if b.at < end else False
    return out


def avc_slice_type(unit: bytes) -> int:
    b = Bits(unescaped(unit[:64]))
    b.ue()
    kind = b.ue()
    if kind > 9:
        raise Invalid("slice type")
    return kind % 5


def reorder_capacity(sequence: dict) -> int:
    """Pictures that the level's memory holds, 16 at most."""
    # Macroblocks that decoded pictures may take, by level.
    most = {9: 396, 10: 396, 11: 900, 12: 2376, 13: 2376, 20: 2376, 21: 4752, 22: 8100, 30: 8100, 31: 18000, 32: 20480, 40: 32768, 41: 32768, 42: 34816, 50: 110400, 51: 184320, 52: 184320}.get(sequence["level"])
    if most is None:
        raise Unsupported("level")
    blocks = -(-sequence["width"] // 16) * -(-sequence["height"] // 16)
    return min(16, most // blocks)


def adts_header(data: bytes) -> dict:
    b = Bits(data)
    if b.read(12) != 0xFFF:
        raise Invalid("sync word")
    b.read(1)
    if b.read(2):
        raise Invalid("layer")
    bare = b.flag()
    profile, index = b.read(2), b.read(4)
    b.read(1)
    channels = b.read(3)
    b.read(4)
    length = b.read(13)
    b.read(11)
    if b.read(2):
        raise Unsupported("several blocks in a frame")
    header = 7 if bare else 9
    if index >= len(AAC_RATES) or length < header:
        raise Invalid("frame")
    return {"object_type": profile + 1, "rate": AAC_RATES[index], "channels": channels, "header_length": header, "frame_length": length}


def aac_config(data: bytes) -> dict:
    """AudioSpecificConfig."""
    b = Bits(data)
    kind = b.read(5)
    if kind == 31:
        kind = 32 + b.read(6)
    index = b.read(4)
    if index == 15:
        rate = b.read(24)
    elif index < len(AAC_RATES):
        rate = AAC_RATES[index]
    else:
        raise Invalid("sampling frequency")
    channels = b.read(4)
    if kind not in (1, 2) or channels not in (1, 2):
        raise Unsupported("object type or channels")
    short = b.flag()
    if b.flag():
        b.read(14)
    if b.flag():
        raise Unsupported("extension")
    return {"object_type": kind, "rate": rate, "channels": channels, "frame_length": 960 if short else 1024}


def opus_packet(data: bytes) -> dict:
    """Configuration, channels and frames of a packet."""
    if not data:
        raise Invalid("empty packet")
    toc, rest = data[0], data[1:]
    config, code = toc >> 3, toc & 3
    samples = OPUS_FRAMES["silk"][config % 4] if config < 12 else OPUS_FRAMES["hybrid"][config % 2] if config < 16 else OPUS_FRAMES["celt"][config % 4]

    def length(at: int) -> tuple[int, int]:
        if at >= len(rest):
            raise Invalid("frame length")
        if rest[at] < 252:
            return rest[at], at + 1
        if at + 1 >= len(rest):
            raise Invalid("frame length")
        return rest[at] + 4 * rest[at + 1], at + 2

    if code == 0:
        frames = [rest]
    elif code == 1:
        if len(rest) % 2:
            raise Invalid("halves")
        frames = [rest[: len(rest) // 2], rest[len(rest) // 2 :]]
    elif code == 2:
        n, at = length(0)
        if at + n > len(rest):
            raise Invalid("frame")
        frames = [rest[at : at + n], rest[at + n :]]
    else:
        if not rest:
            raise Invalid("frame count")
        count, padded, variable, at = rest[0] & 63, rest[0] & 64, rest[0] & 128, 1
        padding = 0
        while padded:
            if at >= len(rest):
                raise Invalid("padding")
            padding += min(rest[at], 254)
            at += 1
            if rest[at - 1] < 255:
                break
        if not count or count * samples > 5760 or at + padding > len(rest):
            raise Invalid("frame count")
        sizes = []
        if variable:
            for _ in range(count - 1):
                n, at = length(at)
                sizes.append(n)
            left = len(rest) - padding - at - sum(sizes)
        else:
            left, remainder = divmod(len(rest) - padding - at, count)
            sizes = [left] * (count - 1)
            if remainder:
                raise Invalid("frame sizes")
        if left < 0:
            raise Invalid("frame sizes")
        frames = []
        for n in [*sizes, left]:
            frames.append(rest[at : at + n])
            at += n
    if any(len(f) > 1275 for f in frames):
        raise Invalid("frame too long")
    return {"config": config, "stereo": bool(toc & 4), "frame_samples": samples, "frames": frames, "samples": samples * len(frames)}


def opus_head(data: bytes) -> dict:
    if len(data) < 19 or data[:8] != b"OpusHead" or data[8] >> 4:
        raise Invalid("header")
    channels, skip, rate, gain, family = data[9], *struct.unpack("<HIhB", data[10:19])
    if not channels or family == 0 and (channels > 2 or len(data) != 19):
        raise Invalid("channels")
    return {"channels": channels, "pre_skip": skip, "input_rate": rate, "gain": gain, "family": family}


def vorbis_id(data: bytes) -> dict:
    if len(data) != 30 or data[:7] != b"\x01vorbis":
        raise Invalid("header")
    version, channels, rate, _, _, _, sizes, framing = struct.unpack("<IBIiiiBB", data[7:30])
    small, large = sizes & 15, sizes >> 4
    if version or not channels or not rate or not 6 <= small <= large <= 13 or not framing & 1:
        raise Invalid("header")
    return {"channels": channels, "rate": rate, "short": 1 << small, "long": 1 << large}


def xiph_headers(data: bytes) -> list[bytes]:
    """The three header packets of a codec's private data."""
    if not data or data[0] != 2:
        raise Invalid("header count")
    at, sizes = 1, []
    for _ in range(2):
        n = 0
        while True:
            if at >= len(data):
                raise Invalid("lacing")
            n += data[at]
            at += 1
            if data[at - 1] < 255:
                break
        sizes.append(n)
    if at + sum(sizes) >= len(data):
        raise Invalid("lacing")
    return [data[at : at + sizes[0]], data[at + sizes[0] : at + sum(sizes)], data[at + sum(sizes) :]]


def huffman_codes(lengths: list[int]) -> list[int | None]:
    """Codewords by entry: each takes the leftmost free place of its length; too many or too few are an error."""
    free = {0: [0]}
    out: list[int | None] = []
    used = [n for n in lengths if n]
    for n in lengths:
        if not n:
            out.append(None)
            continue
        # the deepest free node not below n keeps codes packed to the left
        choices = [(code << (n - d), d) for d, codes in free.items() if d <= n for code in codes]
        if not choices:
            raise Invalid("too many codes")
        place, depth = min(choices)
        code = place >> (n - depth)
        free[depth].remove(code)
        for d in range(depth + 1, n + 1):
            free.setdefault(d, []).append((place >> (n - d)) | 1)
        out.append(place)
    if len(used) > 1 and any(free.values()):
        raise Invalid("too few codes")
    return out


def superframe(data: bytes) -> list[bytes]:
    """Frames of a packet with an index at its end, or the packet itself."""
    if not data:
        raise Invalid("empty packet")
    mark = data[-1]
    if mark & 0xE0 != 0xC0:
        return [data]
    count, width = (mark & 7) + 1, ((mark >> 3) & 3) + 1
    size = 2 + count * width
    if len(data) < size or data[-size] != mark:
        return [data]
    sizes = [int.from_bytes(data[len(data) - size + 1 + i * width : len(data) - size + 1 + (i + 1) * width], "little") for i in range(count)]
    if sum(sizes) != len(data) - size or not all(sizes):
        raise Invalid("frame sizes")
    out, at = [], 0
    for n in sizes:
        out.append(data[at : at + n])
        at += n
    return out


def vp8_header(data: bytes) -> dict:
    if len(data) < 3:
        raise Incomplete("tag")
    tag = int.from_bytes(data[:3], "little")
    key, version, shown, first = not tag & 1, tag >> 1 & 7, bool(tag >> 4 & 1), tag >> 5
    out = {"key": key, "version": version, "shown": shown, "first_partition": first, "width": None, "height": None, "x_scale": None, "y_scale": None}
    if version > 3:
        raise Unsupported("version")
    if key:
        if len(data) < 10:
            raise Incomplete("header")
        if data[3:6] != b"\x9d\x01\x2a":
            raise Invalid("start code")
        w, h = struct.unpack("<HH", data[6:10])
        out |= {"width": w & 0x3FFF, "height": h & 0x3FFF, "x_scale": w >> 14, "y_scale": h >> 14}
        if not out["width"] or not out["height"]:
            raise Invalid("size")
    if first > len(data) - (10 if key else 3):
        raise Invalid("partition")
    return out


def vp9_header(data: bytes) -> dict:
    """Start of the uncompressed header, with the size of keyframes."""
    b = Bits(data)
    if b.read(2) != 2:
        raise Invalid("marker")
    profile = b.read(1) | b.read(1) << 1
    if profile == 3 and b.flag():
        raise Invalid("reserved bit")
    out = {"profile": profile, "show_existing": None, "key": False, "shown": True, "resilient": False, "depth": None, "width": None, "height": None}
    if b.flag():
        return out | {"show_existing": b.read(3)}
    out["key"], out["shown"], out["resilient"] = not b.flag(), b.flag(), b.flag()
    if out["key"]:
        if b.read(24) != 0x498342:
            raise Invalid("sync code")
        out["depth"] = (12 if b.flag() else 10) if profile >= 2 else 8
        if b.read(3) == 7:
            if profile not in (1, 3):
                raise Invalid("color space")
            b.read(1)
        else:
            b.flag()
            if profile in (1, 3):
                b.read(3)
        out["width"], out["height"] = b.read(16) + 1, b.read(16) + 1
    return out


def av1_sequence(payload: bytes) -> dict:
    """Start of a sequence header, up to the largest frame size."""
    b = Bits(payload)
    profile, still, reduced = b.read(3), b.flag(), b.flag()
    if profile > 2 or reduced and not still:
        raise Invalid("profile")
    level = 0
    if reduced:
        level = b.read(5)
    else:
        if b.flag():
            b.read(64)
            if b.flag():
                b.uvlc()
            if b.flag():
                raise Unsupported("decoder model")
        delay = b.flag()
        for i in range(b.read(5) + 1):
            b.read(12)
            at = b.read(5)
            level = level if i else at
            if at > 7:
                b.read(1)
            if delay and b.flag():
                b.read(4)
    wide, high = b.read(4) + 1, b.read(4) + 1
    return {"profile": profile, "still": still, "reduced": reduced, "level": level, "max_width": b.read(wide) + 1, "max_height": b.read(high) + 1}


def low_bits(data: bytes, widths: list[int]) -> list[int]:
    b = LowBits(data)
    return [b.read(w) for w in widths]


def pvq_counts(dimensions: int, pulses: int) -> list[int]:
    """How many vectors of whole numbers of so many dimensions have 0, 1 ... pulses; 32 bits at most."""
    row = [1] + [0] * pulses
    for _ in range(dimensions):
        fresh = [1]
        for k in range(1, pulses + 1):
            fresh.append(min(row[k] + row[k - 1] + fresh[k - 1], (1 << 32) - 1))
        row = fresh
    return row


def pvq_unrank(dimensions: int, pulses: int, index: int) -> list[int]:
    """The vector of a number, in the usual order."""
    out = []
    for left in range(dimensions, 0, -1):
        if not pulses:
            out.append(0)
            continue
        smaller = pvq_counts(left - 1, pulses)
        k = 0
        while True:  # the magnitude: none first, then one of either sign, and so on
            here = smaller[pulses - k] * (1 if k == 0 else 2)
            if index < here:
                break
            index -= here
            k += 1
            if k > pulses:
                raise Invalid("index")
        sign = 1
        if k:
            half = smaller[pulses - k]
            sign, index = (1, index) if index < half else (-1, index - half)
        out.append(sign * k)
        pulses -= k
    return out
