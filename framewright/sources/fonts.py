"""Font containers: directories, checksums, unpacking of WOFF 1 and plain EOT, embedding rights."""

from __future__ import annotations

import struct
import zlib
from urllib.parse import urlsplit

from framewright.sources.bits import Incomplete, Invalid, Unsupported, base128


def checksum(data: bytes) -> int:
    data += b"\0" * (-len(data) % 4)
    return sum(struct.unpack(f">{len(data) // 4}I", data)) & 0xFFFFFFFF


def sfnt_directory(data: bytes) -> list[tuple[str, int, int, int]]:
    """(tag, checksum, offset, length) of each table."""
    if len(data) < 12:
        raise Incomplete("directory")
    count = int.from_bytes(data[4:6], "big")
    if len(data) < 12 + 16 * count:
        raise Incomplete("directory")
    return [(data[i : i + 4].decode("latin-1"), *struct.unpack(">III", data[i + 4 : i + 16])) for i in range(12, 12 + 16 * count, 16)]


def build_sfnt(flavor: int, tables: list[tuple[str, bytes]]) -> bytes:
    """Tables by tag behind a directory, with the head table's checksum adjusted."""
    tables = sorted(tables)
    n = len(tables)
    power = 1 << (n.bit_length() - 1) if n else 1
    head = struct.pack(">IHHHH", flavor, n, 16 * power, power.bit_length() - 1, 16 * (n - power))
    at, directory, body = 12 + 16 * n, b"", b""
    adjust = None
    for tag, data in tables:
        if tag == "head" and len(data) >= 12:
            data = data[:8] + b"\0\0\0\0" + data[12:]
            adjust = at + 8
        directory += tag.encode("latin-1") + struct.pack(">III", checksum(data), at, len(data))
        data += b"\0" * (-len(data) % 4)
        body += data
        at += len(data)
    font = head + directory + body
    if adjust:
        font = font[:adjust] + struct.pack(">I", (0xB1B0AFBA - checksum(font)) & 0xFFFFFFFF) + font[adjust + 4 :]
    return font


def validate_sfnt(data: bytes) -> None:
    """Tags ascend, tables lie apart and inside, what a font needs is there, and the whole adds up."""
    if data[:4] not in (b"\0\1\0\0", b"OTTO", b"true"):
        raise Invalid("flavor")
    rows = sfnt_directory(data)
    tags = [r[0] for r in rows]
    if tags != sorted(set(tags)):
        raise Invalid("tags")
    ranges = sorted((o, o + n) for _, _, o, n in rows)
    if any(b > len(data) for _, b in ranges) or any(o % 4 for o, _ in ranges) or any(a[1] > b[0] for a, b in zip(ranges, ranges[1:], strict=False)):
        raise Invalid("ranges")
    if not {"head", "cmap", "hhea", "hmtx"} <= set(tags) or not {"glyf", "CFF ", "CFF2"} & set(tags):
        raise Invalid("tables")
    if checksum(data) != 0xB1B0AFBA:
        raise Invalid("checksum")


def woff1(data: bytes) -> bytes:
    """The font inside a WOFF 1 file."""
    if len(data) < 44 or data[:4] != b"wOFF":
        raise Invalid("header")
    flavor, length, count = struct.unpack(">IIH", data[4:14])
    if length != len(data):
        raise Invalid("length")
    tables = []
    for i in range(count):
        tag, offset, packed, size, expected = struct.unpack(">4sIIII", data[44 + 20 * i : 64 + 20 * i])
        body = data[offset : offset + packed]
        if len(body) != packed or packed > size:
            raise Invalid("table")
        if packed < size:
            body = zlib.decompress(body)
        if len(body) != size:
            raise Invalid("table size")
        tables.append((tag.decode("latin-1"), body))
    return build_sfnt(flavor, tables)




def woff2_directory(data: bytes) -> list[dict]:
    """Tables of a WOFF 2 file; their data are Brotli and aren't unpacked."""
    if len(data) < 48 or data[:4] != b"wOF2":
        raise Invalid("header")
    at, out = 48, []
    for _ in range(int.from_bytes(data[12:14], "big")):
        flags, at = data[at], at + 1
        if flags & 63 == 63:
            tag, at = data[at : at + 4].decode("latin-1"), at + 4
        else:
            tag = WOFF2_TAGS[flags & 63]
        size, n = base128(data, at)
        at += n
        version = flags >> 6
        changed = version != 3 if tag in ("glyf", "loca") else version != 0
        stored = size
        if changed:
            stored, n = base128(data, at)
            at += n
        out.append({"tag": tag, "length": size, "stored": stored, "transformed": changed})
    return out


# Tags by number.
WOFF2_TAGS = (
    "cmap", "head", "hhea", "hmtx", "maxp", "name", "OS/2", "post", "cvt ", "fpgm", "glyf", "loca", "prep", "CFF ", "VORG", "EBDT", "EBLC", "gasp", "hdmx", "kern", "LTSH", "PCLT", "VDMX", "vhea", "vmtx", "BASE", "GDEF", "GPOS", "GSUB", "EBSC", "JSTF", "MATH",
    "CBDT", "CBLC", "COLR", "CPAL", "SVG ", "sbix", "acnt", "avar", "bdat", "bloc", "bsln", "cvar", "fdsc", "feat", "fmtx", "fvar", "gvar", "hsty", "just", "lcar", "mort", "morx", "opbd", "prop", "trak", "Zapf", "Silf", "Glat", "Gloc", "Feat", "Sill",
)


def woff2_trailer(data: bytes) -> dict[str, tuple[int, int] | None]:
    """Places of a WOFF 2 file's metadata and private block, which must follow its data in this order, each at a multiple of
    four, with nothing but zeros between and nothing behind."""
    if len(data) < 48 or data[:4] != b"wOF2":
        raise Invalid("header")
    if int.from_bytes(data[8:12], "big") != len(data):
        raise Invalid("length")
    at = len(data)
    blocks = {"metadata": struct.unpack(">II", data[28:36]), "private": struct.unpack(">II", data[40:48])}
    out: dict[str, tuple[int, int] | None] = {}
    begin = None
    for name, (offset, size) in blocks.items():
        if bool(offset) != bool(size):
            raise Invalid(name)
        out[name] = (offset, offset + size) if size else None
        if size:
            if offset % 4 or offset + size > at or begin is not None and (offset < begin or offset - begin > 3 or any(data[begin:offset])):
                raise Invalid(name)
            begin = offset + size
    if begin is not None and (len(data) - begin > 3 or any(data[begin:])):
        raise Invalid("data behind the last block")
    return out


def facts(data: bytes) -> dict:
    """Embedding rights and width of glyph offsets, from the tables that say so."""
    found = {tag: data[o : o + n] for tag, _, o, n in sfnt_directory(data)}
    rights, head = found.get("OS/2", b""), found.get("head", b"")
    return {"fs_type": int.from_bytes(rights[8:10], "big") if len(rights) >= 10 else None, "wide_offsets": bool(int.from_bytes(head[50:52], "big")) if len(head) >= 52 else None}


def eot_header(data: bytes) -> dict:
    """Prefix of an EOT file: sizes, flags, names and the root strings it may be used under."""
    if len(data) < 82:
        raise Incomplete("header")
    total, size, version, flags = struct.unpack("<IIII", data[:16])
    if data[34:36] != b"LP" or version not in (0x10000, 0x20001, 0x20002):
        raise Invalid("header")
    out: dict = {"total": total, "font_size": size, "version": version, "flags": flags, "fs_type": int.from_bytes(data[32:34], "little"), "roots": [], "root_checksum": 0}
    at = 82

    def text() -> str:
        nonlocal at
        n = int.from_bytes(data[at : at + 2], "little")
        if at + 2 + n > len(data):
            raise Incomplete("name")
        at += 2 + n
        return data[at - n : at].decode("utf-16-le", "replace")

    for name in ("family", "style", "version_name", "full_name"):
        out[name] = text()
        at += 2
    if version >= 0x20001:
        begin = at
        root = text()
        out["roots"] = [r for r in root.split("\0") if r]
        raw = data[begin + 2 : at]
    else:
        raw = b""
    if version == 0x20002:
        out["root_checksum"] = int.from_bytes(data[at : at + 4], "little")
        at += 8
        at += 2
        n = int.from_bytes(data[at : at + 2], "little")
        at += 2 + n
        at += 4
        n = int.from_bytes(data[at : at + 4], "little")
        at += 4 + n
        if raw and (sum(raw) & 0xFFFFFFFF) ^ 0x50475342 != out["root_checksum"]:
            raise Invalid("root checksum")
    out["data_offset"] = at
    if at + size > total:
        raise Invalid("sizes")
    return out


def permitted_embedding(fs_type: int) -> bool:
    """Installable or editable, and not bitmaps only."""
    return (not fs_type & 15 or bool(fs_type & 8)) and not fs_type & 0x200


def root_permits(roots: list[str], page: str) -> bool:
    """Whether the page is under one of the roots: same scheme, host and port, path at a slash boundary."""
    ports = {"http": 80, "https": 443}
    p = urlsplit(page)
    for root in roots:
        r = urlsplit(root)
        same = (r.scheme, r.hostname, r.port or ports.get(r.scheme)) == (p.scheme, p.hostname, p.port or ports.get(p.scheme))
        base = r.path.rstrip("/")
        if same and (p.path == base or p.path.startswith(base + "/")):
            return True
    return not roots


def eot(data: bytes, page: str | None = None) -> bytes:
    """The font inside an EOT file that isn't compressed, if the page may embed it."""
    h = eot_header(data)
    if h["total"] != len(data):
        raise Invalid("size")
    if not permitted_embedding(h["fs_type"]) or page is not None and not root_permits(h["roots"], page) or page is None and h["roots"]:
        raise Unsupported("not permitted")
    if h["flags"] & 4:
        raise Unsupported("compressed")
    body = data[h["data_offset"] : h["data_offset"] + h["font_size"]]
    return bytes(b ^ 0x50 for b in body) if h["flags"] & 0x10000000 else body


def mtx_header(data: bytes, total: int) -> dict:
    """Copy limit and the three streams' ranges."""
    if len(data) < 10:
        raise Incomplete("header")
    limit, second, third = (int.from_bytes(data[i : i + 3], "big") for i in (1, 4, 7))
    if data[0] not in (3, 4) or not 10 <= second <= third <= total:
        raise Invalid("header")
    return {"version": data[0], "copy_limit": limit, "streams": [(10, second), (second, third), (third, total)]}


def ctf_directory(data: bytes) -> list[tuple[str, int, int]]:
    """(tag, offset, length) of a compact font's tables."""
    out = [(tag, offset, length) for tag, _, offset, length in sfnt_directory(data)]
    if any(o + n > len(data) for _, o, n in out):
        raise Incomplete("table")
    return out


def cvt_values(data: bytes) -> list[int]:
    """Control values from coded differences, wrapping at 16 bits."""
    n, at, value, out = int.from_bytes(data[:2], "big"), 2, 0, []
    for _ in range(n):
        if at >= len(data):
            raise Incomplete("values")
        code = data[at]
        at += 1
        if code < 238:
            d = code
        elif code == 238:
            d, at = int.from_bytes(data[at : at + 2], "big", signed=True), at + 2
        else:
            near = 238 * (code - 239 if code < 248 else code - 247) + data[at]
            d, at = -near if code < 248 else near, at + 1
        value = (value + d + 32768) % 65536 - 32768
        out.append(value)
    if at != len(data):
        raise Invalid("data behind the values")
    return out
