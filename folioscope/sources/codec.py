"""Decompression and number formats of help containers, bytes to bytes.

All lengths come from untrusted input: every function stops at the end of its data and honours a
limit on what it makes.
"""

from __future__ import annotations

import struct

LIMIT = 64 << 20


def lz77(data: bytes, limit: int = LIMIT) -> bytes:
    """Flag bytes, low bit first: 0 a literal, 1 a word of distance - 1 (12 bits) and length - 3 (4 bits)."""
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < limit:
        flags = data[i]
        i += 1
        for bit in range(8):
            if i >= n or len(out) >= limit:
                break
            if not flags >> bit & 1:
                out.append(data[i])
                i += 1
                continue
            if i + 1 >= n:
                return bytes(out)
            word = data[i] | data[i + 1] << 8
            i += 2
            back, length = (word & 0xFFF) + 1, (word >> 12) + 3
            for _ in range(length):
                out.append(out[-back] if back <= len(out) else 0)
    return bytes(out[:limit])


def phrases_expand(data: bytes, phrases: list[bytes], limit: int = LIMIT) -> bytes:
    """Bytes 1 to 15 start a two-byte phrase number; an odd one adds a blank."""
    out, i = bytearray(), 0
    while i < len(data) and len(out) < limit:
        c = data[i]
        i += 1
        if not 1 <= c <= 15 or i >= len(data):
            out.append(c)
            continue
        number, blank = divmod((c << 8) - 256 + data[i], 2)
        i += 1
        if number < len(phrases):
            out += phrases[number]
        if blank:
            out.append(32)
    return bytes(out[:limit])


def hall_expand(data: bytes, phrases: list[bytes], limit: int = LIMIT) -> bytes:
    """Opcodes by their low bits: short and long phrase numbers, literals, blanks, zeros."""
    out, i = bytearray(), 0
    while i < len(data) and len(out) < limit:
        c = data[i]
        i += 1
        number = -1
        if c & 1 == 0:
            number = c // 2
        elif c & 3 == 1:
            if i >= len(data):
                break
            number = c * 64 + 64 + data[i]  # c is 4 m + 1: 256 m + 128 + the next byte
            i += 1
        elif c & 7 == 3:
            out += data[i : i + c // 8 + 1]
            i += c // 8 + 1
        elif c & 15 == 7:
            out += b" " * (c // 16 + 1)
        else:
            out += b"\0" * (c // 16 + 1)
        if 0 <= number < len(phrases):
            out += phrases[number]
    return bytes(out[:limit])


def run_length(data: bytes, limit: int = LIMIT) -> bytes:
    """A count with its high bit set copies that many bytes; otherwise the next byte repeats."""
    out, i = bytearray(), 0
    while i < len(data) and len(out) < limit:
        count = data[i]
        i += 1
        if count & 0x80:
            out += data[i : i + (count & 0x7F)]
            i += count & 0x7F
        elif i < len(data):
            out += data[i : i + 1] * count
            i += 1
    return bytes(out[:limit])


def picture_bytes(data: bytes, packing: int, limit: int = LIMIT) -> bytes:
    """Packing 0 plain, 1 run length, 2 LZ77, 3 LZ77 and then run length."""
    if packing & 2:
        data = lz77(data, limit)
    return run_length(data, limit) if packing & 1 else data


class Reader:
    """A cursor over bytes; reading beyond the end raises ``EOFError``."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, form: str):
        size = struct.calcsize("<" + form)
        if self.at < 0 or self.at + size > len(self.data):
            raise EOFError(f"{size} bytes at {self.at} of {len(self.data)}")
        got = struct.unpack_from("<" + form, self.data, self.at)
        self.at += size
        return got[0] if len(got) == 1 else got

    def bytes(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise EOFError(f"{n} bytes at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def zero_ended(self) -> bytes:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise EOFError("a string has no end")
        got, self.at = self.data[self.at : end], end + 1
        return got

    def unsigned_word(self) -> int:
        low = self.take("B")
        return low // 2 + (self.take("B") * 128 if low & 1 else 0)

    def signed_word(self) -> int:
        low = self.take("B")
        return low // 2 + self.take("B") * 128 - 16384 if low & 1 else low // 2 - 64

    def unsigned_long(self) -> int:
        low = self.take("H")
        return low // 2 + (self.take("H") * 32768 if low & 1 else 0)

    def signed_long(self) -> int:
        low = self.take("H")
        return low // 2 + self.take("H") * 32768 - 0x40000000 if low & 1 else low // 2 - 16384


def phrase_lengths(data: bytes, count: int, bits: int) -> list[int]:
    """Lengths coded in unary steps of 2**bits and as many low bits, in 32-bit words, low bit first."""
    at = 0

    def bit() -> int:
        nonlocal at
        if at // 8 >= len(data):
            raise EOFError("phrase lengths end early")
        got = data[at // 8] >> at % 8 & 1
        at += 1
        return got

    out = []
    for _ in range(count):
        n = 1
        while bit():
            n += 1 << bits
        n += bit()
        for k in range(1, min(bits, 5)):
            n += bit() << k
        out.append(n)
    return out
