"""Readers of bits and variable-length numbers in headers. Payloads stay opaque."""

from __future__ import annotations


class Invalid(ValueError):
    """The data break the format."""


class Incomplete(Invalid):
    """More bytes are needed."""


class Unsupported(ValueError):
    """The data use something that isn't handled."""


class Bits:
    """Most significant bit first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def read(self, n: int) -> int:
        if self.at + n > 8 * len(self.data):
            raise Incomplete("out of bits")
        first, last = self.at // 8, (self.at + n + 7) // 8
        value = int.from_bytes(self.data[first:last], "big") >> (8 * last - self.at - n) if n else 0
        self.at += n
        return value & ((1 << n) - 1)

    def flag(self) -> bool:
        return bool(self.read(1))

    def ue(self) -> int:
        """Unsigned Exp-Golomb."""
        zeros = 0
        while not self.read(1):
            zeros += 1
            if zeros > 32:
                raise Invalid("code too long")
        return (1 << zeros) - 1 + self.read(zeros)

    def se(self) -> int:
        k = self.ue()
        return (k + 1) // 2 if k % 2 else -(k // 2)

    def leb128(self) -> int:
        value = 0
        for i in range(8):
            b = self.read(8)
            value |= (b & 127) << (7 * i)
            if b < 128:
                return value
        raise Invalid("number too long")

    def uvlc(self) -> int:
        zeros = 0
        while not self.read(1):
            zeros += 1
            if zeros >= 32:
                return (1 << 32) - 1
        return self.read(zeros) + (1 << zeros) - 1


class LowBits:
    """Least significant bit first."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "little"), 8 * len(data)

    def read(self, n: int) -> int:
        if n > self.left:
            raise Incomplete("out of bits")
        out = self.value & ((1 << n) - 1)
        self.value >>= n
        self.left -= n
        return out


def ebml_id(data: bytes, at: int = 0) -> tuple[int, int]:
    """Element id with its marker bits, and its length of 1 to 4 bytes."""
    if at >= len(data):
        raise Incomplete("id")
    size = 9 - data[at].bit_length() if data[at] else 9
    if size > 4:
        raise Invalid("id longer than 4 bytes")
    if at + size > len(data):
        raise Incomplete("id")
    return int.from_bytes(data[at : at + size], "big"), size


def ebml_size(data: bytes, at: int = 0) -> tuple[int | None, int]:
    """Element size and its length of 1 to 8 bytes; None is unknown (all ones)."""
    if at >= len(data):
        raise Incomplete("size")
    size = 9 - data[at].bit_length() if data[at] else 9
    if size > 8:
        raise Invalid("size longer than 8 bytes")
    if at + size > len(data):
        raise Incomplete("size")
    value = int.from_bytes(data[at : at + size], "big") & ((1 << 7 * size) - 1)
    return (None if value == (1 << 7 * size) - 1 else value), size


def base128(data: bytes, at: int = 0) -> tuple[int, int]:
    """Font table sizes: up to 5 bytes of 7 bits, no leading zeros, 32 bits at most."""
    value = 0
    for i in range(5):
        if at + i >= len(data):
            raise Incomplete("number")
        b = data[at + i]
        if (i == 0 and b == 0x80) or value & 0xFE000000:
            raise Invalid("number")
        value = value << 7 | b & 127
        if b < 128:
            return value, i + 1
    raise Invalid("number")


def u255(data: bytes, at: int = 0) -> tuple[int, int]:
    """Font point counts: one byte, or a word or an offset byte behind a code."""
    if at >= len(data):
        raise Incomplete("number")
    code = data[at]
    need = {253: 3, 254: 2, 255: 2}.get(code, 1)
    if at + need > len(data):
        raise Incomplete("number")
    if code == 253:
        return int.from_bytes(data[at + 1 : at + 3], "big"), 3
    if code == 254:
        return data[at + 1] + 506, 2
    return (data[at + 1] + 253, 2) if code == 255 else (code, 1)
