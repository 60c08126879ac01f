"""The block format: entries, offsets, their number and a checksum, little-endian."""

from __future__ import annotations

import struct
import zlib

Entry = tuple[bytes, bytes, int]


def encode(entries: list[Entry]) -> bytes:
    """entries: (key, value, version), in order."""
    body, offsets = bytearray(), []
    for key, value, version in entries:
        offsets.append(len(body))
        body += struct.pack("<H", len(key)) + key + struct.pack("<H", len(value)) + value + struct.pack("<Q", version)
    body += struct.pack(f"<{len(offsets)}H", *offsets) + struct.pack("<H", len(offsets))
    return bytes(body) + struct.pack("<I", zlib.crc32(body))


def decode(raw: bytes) -> list[Entry]:
    body, (checksum,) = raw[:-4], struct.unpack("<I", raw[-4:])
    if zlib.crc32(body) != checksum:
        raise ValueError("the block's checksum is wrong")
    (count,) = struct.unpack("<H", body[-2:])
    out = []
    for at in struct.unpack(f"<{count}H", body[-2 - 2 * count : -2]):
        (n,) = struct.unpack_from("<H", body, at)
        (m,) = struct.unpack_from("<H", body, at + 2 + n)
        end = at + 4 + n + m
        out.append((body[at + 2 : at + 2 + n], body[at + 4 + n : end], struct.unpack_from("<Q", body, end)[0]))
    return out
