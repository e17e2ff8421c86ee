"""Directory of a ZIP file by range reads: end record, ZIP64 records, central directory, local headers."""

from __future__ import annotations

import struct
from dataclasses import dataclass

# Signatures and field layouts of the ZIP format.
END, END64_LOCATOR, END64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
END_FIELDS, LOCATOR_FIELDS, END64_FIELDS = "<4s4H2LH", "<4sLQL", "<4sQ2H2L4Q"
CENTRAL_FIELDS, LOCAL_FIELDS = "<4s6H3L5H2L", "<4s5H3L2H"
ZIP64_EXTRA, STORED, FULL16, FULL32 = 1, 0, 0xFFFF, 0xFFFFFFFF
MAX_COMMENT = 1 << 16


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    crc: int
    packed: int
    size: int
    header: int  # offset of its local header


def read_range(file, start: int, size: int) -> bytes:
    file.seek(start)
    data = file.read(size)
    if len(data) != size:
        raise ValueError(f"wanted {size} bytes at {start}, found {len(data)}")
    return data


def central_range(file, length: int) -> tuple[int, int, int]:
    """(offset, bytes, members) of the central directory."""
    tail_at = max(0, length - MAX_COMMENT - struct.calcsize(END_FIELDS) - struct.calcsize(LOCATOR_FIELDS))
    tail = read_range(file, tail_at, length - tail_at)
    at = tail.rfind(END)
    while at >= 0:  # the end record is the one whose comment reaches the end of the file
        fields = struct.unpack_from(END_FIELDS, tail, at) if len(tail) - at >= struct.calcsize(END_FIELDS) else None
        if fields and at + struct.calcsize(END_FIELDS) + fields[7] == len(tail):
            break
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no ZIP end record")
    members, size, offset = fields[4], fields[5], fields[6]
    locator_at = at - struct.calcsize(LOCATOR_FIELDS)
    if locator_at >= 0 and tail[locator_at:locator_at + 4] == END64_LOCATOR and (FULL16 in fields[1:5] or FULL32 in fields[5:7]):
        end64 = read_range(file, struct.unpack_from(LOCATOR_FIELDS, tail, locator_at)[2], struct.calcsize(END64_FIELDS))
        fields = struct.unpack(END64_FIELDS, end64)
        if fields[0] != END64:
            raise ValueError("bad ZIP64 end record")
        members, size, offset = fields[7], fields[8], fields[9]
    return offset, size, members


def members(file, length: int) -> list[Member]:
    offset, size, count = central_range(file, length)
    data, at, out = read_range(file, offset, size), 0, []
    for _ in range(count):
        f = struct.unpack_from(CENTRAL_FIELDS, data, at)
        if f[0] != CENTRAL:
            raise ValueError("bad ZIP central directory")
        flags, method, crc, packed, full, n_name, n_extra, n_comment, header = f[3], f[4], f[7], f[8], f[9], f[10], f[11], f[12], f[16]
        at += struct.calcsize(CENTRAL_FIELDS)
        name = data[at:at + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = data[at + n_name:at + n_name + n_extra]
        while len(extra) >= 4:
            tag, width = struct.unpack_from("<2H", extra)
            if tag == ZIP64_EXTRA:  # holds, in this order, those of the three fields that did not fit
                wide = list(struct.unpack_from(f"<{width // 8}Q", extra, 4))
                full = wide.pop(0) if full == FULL32 else full
                packed = wide.pop(0) if packed == FULL32 else packed
                header = wide.pop(0) if header == FULL32 else header
            extra = extra[4 + width:]
        at += n_name + n_extra + n_comment
        out.append(Member(name, method, crc, packed, full, header))
    return out


def stored_range(file, member: Member) -> tuple[int, int]:
    """(offset, bytes) of a stored member's data in the file."""
    if member.method != STORED:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by range")
    f = struct.unpack(LOCAL_FIELDS, read_range(file, member.header, struct.calcsize(LOCAL_FIELDS)))
    if f[0] != LOCAL:
        raise ValueError("bad ZIP local header")
    return member.header + struct.calcsize(LOCAL_FIELDS) + f[9] + f[10], member.size
