"""Transport-packet header fields as column expressions.

The functions take the header bytes as integer columns; byte_at() reads one from
a BINARY column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PACKET = 188
SYNC = 0x47


def byte_at(data: Column, k: int) -> Column:
    """The byte at offset k (from 0) as an integer."""
    return F.conv(F.hex(F.substring(data, k + 1, 1)), 16, 10).cast("int")


def pid(b1: Column, b2: Column) -> Column:
    return F.shiftleft(b1.bitwiseAND(31), 8) + b2


def unit_start(b1: Column) -> Column:
    return b1.bitwiseAND(64) != 0


def transport_error(b1: Column) -> Column:
    return b1.bitwiseAND(128) != 0


def adaptation(b3: Column) -> Column:
    return F.shiftright(b3, 4).bitwiseAND(3)


def has_payload(b3: Column) -> Column:
    return adaptation(b3).isin(1, 3)


def counter(b3: Column) -> Column:
    return b3.bitwiseAND(15)


def payload_start(b3: Column, b4: Column) -> Column:
    """Where the payload starts; null without one or with an adaptation field that is too long."""
    a = adaptation(b3)
    return F.when(a == 1, 4).when((a == 3) & (b4 + 5 < PACKET), b4 + 5)


def discontinuity(b3: Column, b4: Column, b5: Column) -> Column:
    return (adaptation(b3) >= 2) & (b4 > 0) & (b5.bitwiseAND(128) != 0)


def with_counter(packet: Column, new: Column) -> Column:
    """The packet with another counter; every other byte stays."""
    b3 = byte_at(packet, 3).bitwiseAND(0xF0).bitwiseOR(F.pmod(new, F.lit(16)).cast("int"))
    return F.concat(F.substring(packet, 1, 3), F.unhex(F.lpad(F.hex(b3), 2, "0")), F.substring(packet, 5, PACKET - 4))


def marker(pid_value: int, cc: int = 0) -> bytes:
    """A packet without payload that signals a discontinuity on a stream."""
    head = bytes([SYNC, pid_value >> 8 & 31, pid_value & 255, 0x20 | cc & 15])
    return head + bytes([PACKET - 5, 0x80]) + b"\xff" * (PACKET - 6)


def timestamp33(b0: Column, b1: Column, b2: Column, b3: Column, b4: Column) -> Column:
    """A 33-bit presentation time from its five bytes."""
    wide = lambda c: c.cast("long")
    return (
        F.shiftleft(wide(F.shiftright(b0, 1).bitwiseAND(7)), 30)
        + F.shiftleft(wide(b1), 22)
        + F.shiftleft(wide(F.shiftright(b2, 1).bitwiseAND(127)), 15)
        + F.shiftleft(wide(b3), 7)
        + wide(F.shiftright(b4, 1).bitwiseAND(127))
    )


def clock_seconds(b0: Column, b1: Column, b2: Column, b3: Column, b4: Column) -> Column:
    """The base of a program clock reference in seconds."""
    wide = lambda c: c.cast("long")
    base = F.shiftleft(wide(b0), 25) + F.shiftleft(wide(b1), 17) + F.shiftleft(wide(b2), 9) + F.shiftleft(wide(b3), 1) + wide(F.shiftright(b4, 7))
    return base / F.lit(90000.0)


def bcd(b: Column) -> Column:
    return b.bitwiseAND(15) + F.shiftright(b, 4).bitwiseAND(15) * 10
