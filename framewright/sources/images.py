"""Sniffing and headers of raster images; pixels of plain PNG, BMP and GIF."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from framewright.sources.bits import Incomplete, Invalid, Unsupported
from framewright.sources.containers import boxes

JXL_BOX = b"\0\0\0\x0cJXL \r\n\x87\n"


def is_avif(data: bytes) -> bool:
    if len(data) < 16 or data[4:8] != b"ftyp":
        return False
    size = int.from_bytes(data[:4], "big")
    brands = [data[8:12], *(data[i : i + 4] for i in range(16, min(size, len(data)), 4))]
    return size >= 16 and any(b in (b"avif", b"avis") for b in brands)


def is_jpeg_xl(data: bytes) -> bool:
    return data[:2] == b"\xff\x0a" or data[:12] == JXL_BOX


def sniff(data: bytes) -> str | None:
    if is_avif(data):
        return "avif"
    if is_jpeg_xl(data):
        return "jxl"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    for magic, name in ((b"\x89PNG\r\n\x1a\n", "png"), (b"\xff\xd8\xff", "jpeg"), (b"GIF87a", "gif"), (b"GIF89a", "gif"), (b"BM", "bmp"), (b"\0\0\1\0", "ico")):
        if data.startswith(magic):
            return name
    return None


def avif_items(data: bytes) -> dict:
    """Primary item, items with extents, properties by item, and references."""
    meta = next(((a, b) for k, a, b in boxes(data) if k == "meta"), None)
    if meta is None:
        raise Incomplete("meta")
    parts = {k: (a, b) for k, a, b in boxes(data, meta[0] + 4, meta[1])}
    out: dict = {"primary": None, "items": {}, "extents": {}, "properties": {}, "references": []}
    if "pitm" in parts:
        a, _ = parts["pitm"]
        out["primary"] = int.from_bytes(data[a + 4 : a + (8 if data[a] else 6)], "big")
    if "iinf" in parts:
        a, b = parts["iinf"]
        for k, x, _ in boxes(data, a + (8 if data[a] else 6), b):
            if k == "infe":
                wide = 4 if data[x] >= 3 else 2
                number = int.from_bytes(data[x + 4 : x + 4 + wide], "big")
                if int.from_bytes(data[x + 4 + wide : x + 6 + wide], "big"):
                    raise Unsupported("protected item")
                out["items"][number] = data[x + 6 + wide : x + 10 + wide].decode("latin-1")
    if "iloc" in parts:
        a, b = parts["iloc"]
        version, at = data[a], a + 4
        sizes = data[at] >> 4, data[at] & 15, data[at + 1] >> 4, data[at + 1] & 15
        at += 2
        wide = 4 if version == 2 else 2
        count, at = int.from_bytes(data[at : at + wide], "big"), at + wide

        def read(n: int) -> int:
            nonlocal at
            at += n
            return int.from_bytes(data[at - n : at], "big")

        for _ in range(count):
            number = read(wide)
            method = read(2) & 15 if version else 0
            if method > 1 or read(2):
                raise Unsupported("item location")
            base = read(sizes[2])
            extents = []
            for _ in range(read(2)):
                if version and sizes[3]:
                    read(sizes[3])
                extents.append((base + read(sizes[0]), read(sizes[1])))
            out["extents"][number] = ("idat" if method else "file", extents)
    if "iprp" in parts:
        known, links = [], {}
        for k, a, b in boxes(data, *parts["iprp"]):
            if k == "ipco":
                known = [(kind, data[x:y]) for kind, x, y in boxes(data, a, b)]
            elif k == "ipma":
                version, flags, at = data[a], data[a + 3] & 1, a + 8
                for _ in range(int.from_bytes(data[a + 4 : a + 8], "big")):
                    wide = 4 if version else 2
                    number, at = int.from_bytes(data[at : at + wide], "big"), at + wide
                    n, at = data[at], at + 1
                    step = 2 if flags else 1
                    links.setdefault(number, []).extend(int.from_bytes(data[at + i * step : at + i * step + step], "big") & (0x7FFF if flags else 0x7F) for i in range(n))
                    at += n * step
        out["properties"] = {i: [known[p - 1] for p in ps if 0 < p <= len(known)] for i, ps in links.items()}
    if "iref" in parts:
        a, b = parts["iref"]
        wide = 4 if data[a] else 2
        for k, x, _ in boxes(data, a + 4, b):
            n = int.from_bytes(data[x + wide : x + wide + 2], "big")
            out["references"] += [(k, int.from_bytes(data[x : x + wide], "big"), int.from_bytes(data[x + wide + 2 + i * wide : x + wide + 2 + (i + 1) * wide], "big")) for i in range(n)]
    return out


def avif_alpha(index: dict) -> int | None:
    """The auxiliary item that holds the primary one's alpha."""
    for kind, source, target in index["references"]:
        if kind == "auxl" and target == index["primary"] and any(k == "auxC" and b"alpha" in body for k, body in index["properties"].get(source, [])):
            return source
    return None


def avif_payload(data: bytes, index: dict, item: int) -> bytes:
    where, extents = index["extents"][item]
    base = 0
    if where == "idat":
        meta = next((a, b) for k, a, b in boxes(data) if k == "meta")
        base = next(a for k, a, _ in boxes(data, meta[0] + 4, meta[1]) if k == "idat")
    out = b"".join(data[base + a : base + a + n] for a, n in extents)
    if len(out) != sum(n for _, n in extents):
        raise Incomplete("item")
    return out


def dimensions(data: bytes) -> tuple[int, int]:
    """Width and height as shown, from headers only."""
    kind = sniff(data)
    if kind == "png":
        w, h = struct.unpack(">II", data[16:24])
    elif kind == "gif":
        w, h = struct.unpack("<HH", data[6:10])
    elif kind == "bmp":
        w, h = struct.unpack("<ii", data[18:26])
        h = abs(h)
    elif kind == "ico":
        sizes = [(data[6 + 16 * i] or 256, data[7 + 16 * i] or 256) for i in range(int.from_bytes(data[4:6], "little"))]
        w, h = max(sizes, key=lambda s: s[0] * s[1])
    elif kind == "webp":
        form = data[12:16]
        if form == b"VP8X":
            w, h = 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        elif form == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            w, h = 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        else:
            w, h = (x & 0x3FFF for x in struct.unpack("<HH", data[26:30]))
    elif kind == "jpeg":
        at, w, h = 2, 0, 0
        while at + 9 <= len(data):
            if data[at] != 0xFF:
                raise Invalid("marker")
            mark = data[at + 1]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                break
            at += 2 if mark == 0xFF or 0xD0 <= mark <= 0xD9 else 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    elif kind == "avif":
        index = avif_items(data)
        w = h = 0
        for name, body in index["properties"].get(index["primary"], []):
            if name == "ispe":
                w, h = struct.unpack(">II", body[4:12])
            elif name == "irot" and body[0] & 1:
                w, h = h, w
    else:
        raise Unsupported(kind or "unknown image")
    if not w or not h:
        raise Invalid("size")
    return w, h


def png_rgba(data: bytes) -> tuple[int, int, bytes]:
    """Premultiplied pixels of an 8-bit PNG that isn't interlaced."""
    if sniff(data) != "png":
        raise Invalid("not PNG")
    at, parts, palette, clear = 8, [], None, b""
    w = h = kind = 0
    while at + 12 <= len(data):
        size, name = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(name + body) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            raise Invalid("chunk")
        if name == b"IHDR":
            w, h, depth, kind, _, _, lace = struct.unpack(">IIBBBBB", body)
            if depth != 8 or lace:
                raise Unsupported("depth or interlace")
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            clear = body
        elif name == b"IDAT":
            parts.append(body)
        at += 12 + size
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, 1 + w * n)
    rows = np.zeros((h + 1, w * n + n), np.uint8)  # a zero row above and a zero pixel to the left
    for y in range(h):
        filter_, line, up, out = raw[y, 0], raw[y, 1:], rows[y], rows[y + 1]
        if filter_ == 0:
            out[n:] = line
        elif filter_ == 2:
            out[n:] = line + up[n:]
        elif filter_ == 1:
            out[n:] = np.cumsum(line.reshape(w, n), axis=0, dtype=np.uint8).reshape(-1)
        elif filter_ == 3:
            for i in range(n, len(out)):
                out[i] = (int(line[i - n]) + (int(out[i - n]) + int(up[i])) // 2) & 255
        elif filter_ == 4:
            for i in range(n, len(out)):
                a, b, c = int(out[i - n]), int(up[i]), int(up[i - n])
                p = a + b - c
                nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                out[i] = (int(line[i - n]) + nearest) & 255
        else:
            raise Invalid("filter")
    px = rows[1:, n:].reshape(h, w, n)
    alpha = np.full((h, w), 255, np.uint16)
    if kind == 3:
        if palette is None:
            raise Invalid("no palette")
        if clear:
            table = np.full(256, 255, np.uint16)
            table[: len(clear)] = np.frombuffer(clear, np.uint8)
            alpha = table[px[..., 0]]
        rgb = palette[px[..., 0]]
    else:
        rgb = px[..., :3] if n >= 3 else np.repeat(px[..., :1], 3, axis=2)
        if kind in (4, 6):
            alpha = px[..., -1].astype(np.uint16)
    out = np.empty((h, w, 4), np.uint8)
    out[..., :3] = rgb.astype(np.uint16) * alpha[..., None] // 255
    out[..., 3] = alpha
    return w, h, out.tobytes()


def _premultiplied(rgba: np.ndarray) -> bytes:
    out = rgba.astype(np.uint16)
    out[..., :3] = out[..., :3] * out[..., 3:] // 255
    return out.astype(np.uint8).tobytes()


def bmp_rgba(data: bytes) -> tuple[int, int, bytes]:
    """Premultiplied pixels of a BMP of 1, 4, 8, 24 or 32 bits that isn't compressed."""
    if len(data) < 54:
        raise Incomplete("header")
    start, size, w, h, _, bits, packing = struct.unpack("<IIiiHHI", data[10:34])
    up, h = h > 0, abs(h)
    if w <= 0 or not h or w * h > 1 << 26:
        raise Invalid("size")
    if packing or bits not in (1, 4, 8, 24, 32):
        raise Unsupported("compression or depth")
    each = (w * bits + 31) // 32 * 4
    if start + each * h > len(data):
        raise Incomplete("pixels")
    rows = np.frombuffer(data, np.uint8, each * h, start).reshape(h, each)
    rows = rows[::-1] if up else rows
    out = np.full((h, w, 4), 255, np.uint8)
    if bits >= 24:
        out[..., :3] = rows[:, : w * bits // 8].reshape(h, w, bits // 8)[..., 2::-1]
    else:
        count = int.from_bytes(data[46:50], "little") or 1 << bits
        if 14 + size + 4 * count > len(data):
            raise Incomplete("palette")
        palette = np.frombuffer(data, np.uint8, 4 * count, 14 + size).reshape(-1, 4)
        index = np.unpackbits(rows, axis=1).reshape(h, -1, bits) @ (1 << np.arange(bits)[::-1])
        if index[:, :w].max() >= count:
            raise Invalid("colour")
        out[..., :3] = palette[index[:, :w], 2::-1]
    return w, h, _premultiplied(out)


def _unpacked(data: bytes, width: int, limit: int) -> bytes:
    """Variable-width codes of a growing dictionary, least significant bit first, for ``limit`` bytes at most."""
    clear, stop = 1 << width, (1 << width) + 1
    words = [bytes([i]) for i in range(clear)] + [b"", b""]
    out, size, held, bits, before, at = [], width + 1, 0, 0, None, 0
    made = 0
    while made < limit:
        while bits < size:
            if at == len(data):
                raise Incomplete("codes")
            held |= data[at] << bits
            bits, at = bits + 8, at + 1
        code, held, bits = held & ((1 << size) - 1), held >> size, bits - size
        if code == stop:
            break
        if code == clear:
            del words[clear + 2 :]
            size, before = width + 1, None
            continue
        if code < len(words):
            word = words[code]
        elif code == len(words) and before is not None:
            word = before + before[:1]
        else:
            raise Invalid("code")
        out.append(word)
        made += len(word)
        if before is not None and len(words) < 4096:
            words.append(before + word[:1])
            if len(words) == 1 << size and size < 12:
                size += 1
        before = word
    return b"".join(out)[:limit]


def gif_rgba(data: bytes) -> tuple[int, int, bytes]:
    """Premultiplied pixels of a GIF's first picture on its canvas; what it doesn't cover is transparent."""
    if len(data) < 13:
        raise Incomplete("header")
    w, h, flags = struct.unpack("<HHB", data[6:11])
    if not w or not h or w * h > 1 << 26:
        raise Invalid("size")

    def colours(flags: int, at: int) -> tuple[np.ndarray | None, int]:
        if not flags & 0x80:
            return None, at
        n = 2 << (flags & 7)
        if at + 3 * n > len(data):
            raise Incomplete("colours")
        return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while True:
            if at >= len(data) or at + 1 + data[at] > len(data):
                raise Incomplete("block")
            size = data[at]
            if not size:
                return b"".join(parts), at + 1
            parts.append(data[at + 1 : at + 1 + size])
            at += 1 + size

    palette, at = colours(flags, 13)
    clear = None
    while at < len(data):
        if data[at] == 0x21:
            body, after = blocks(at + 2)
            if data[at + 1 : at + 2] == b"\xf9" and len(body) >= 4 and body[0] & 1:
                clear = body[3]
            at = after
            continue
        if data[at] != 0x2C:
            raise Invalid("block")
        if at + 11 > len(data):
            raise Incomplete("picture")
        x, y, pw, ph, local = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        own, at = colours(local, at + 10)
        table = own if own is not None else palette
        if table is None or not pw or not ph or x + pw > w or y + ph > h or not 2 <= data[at] <= 8:
            raise Invalid("picture")
        packed, _ = blocks(at + 1)
        index = np.frombuffer(_unpacked(packed, data[at], pw * ph), np.uint8)
        if len(index) < pw * ph:
            raise Incomplete("picture")
        index = index.reshape(ph, pw)
        if local & 0x40:  # every eighth row, then those between, and so on
            order = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, ph, step)]
            index = index[np.argsort(order)]
        if index.max() >= len(table):
            raise Invalid("colour")
        out = np.zeros((h, w, 4), np.uint8)
        out[y : y + ph, x : x + pw, :3] = table[index]
        out[y : y + ph, x : x + pw, 3] = 255 if clear is None else np.where(index == clear, 0, 255)
        return w, h, _premultiplied(out)
    raise Incomplete("no picture")


#: Formats whose pixels are reconstructed.
PIXELS = {"png": png_rgba, "bmp": bmp_rgba, "gif": gif_rgba}
