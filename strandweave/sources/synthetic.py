"""Synthetic captures of one tape: bytes are a function of (position, corrupt)."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

PAT, PMT, VIDEO, AUX = 0x000, 0x100, 0x200, 0x201


def packet(pid: int, cc: int, body: bytes, start: bool = False) -> bytes:
    assert len(body) <= 184
    return bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, 0x10 | cc & 15]) + body + b"\xff" * (184 - len(body))


def pat() -> bytes:
    return bytes([0, 0, 0xB0, 13, 0, 1, 0xC1, 0, 0, 0, 1, 0xE0 | PMT >> 8, PMT & 255, 0, 0, 0, 0])


def pmt() -> bytes:
    streams = b"".join(bytes([kind, 0xE0 | pid >> 8, pid & 255, 0xF0, 0]) for kind, pid in ((0x02, VIDEO), (0xA1, AUX)))
    return bytes([0, 2, 0xB0, 13 + len(streams), 0, 1, 0xC1, 0, 0, 0xE0 | VIDEO >> 8, VIDEO & 255, 0xF0, 0]) + streams + b"\0\0\0\0"


def bcd(x: int) -> int:
    return x // 10 << 4 | x % 10


def label(at: datetime, frame: int, hour: int = 0) -> bytes:
    pack = [0x63, 7, bcd(frame), bcd(at.second), bcd(at.minute), 0xC0 | hour, 0, bcd(at.day), bcd(at.month), bcd(at.year % 100), 0xFF, bcd(at.second), bcd(at.minute), bcd(at.hour), 0, 0, 0]
    return b"\0\0\1\xbf\0\x20" + bytes(pack)


def digits(x: int, base: int = 254) -> list[int]:
    """Digits of a number, the lowest first."""
    out = [x % base]
    while x := x // base:
        out.append(x % base)
    return out


def unit(position: int, frames: int = 4, corrupt: bool = False) -> bytes:
    head = b"\0\0\1\xb3" + b"\x11\x22\x33\x44"
    start = b"\0\0\1\xb8" + bytes([0, 0, 0, 0x40])
    seed = position * 7 + (101 if corrupt else 0)
    # Of a long tape, as many bytes as its positions need; none is below 2, so that no start code comes about.
    turn, *more = digits(position // 199)
    pictures = b"".join(b"\0\0\1\0" + bytes([2 + seed % 199, 2 + turn, 3 + f, 2 + corrupt, 9, *(2 + x for x in more)]) for f in range(frames))
    return head + start + pictures


@dataclass
class Tape:
    start: int
    stop: int
    damage: dict[int, str] = field(default_factory=dict)
    skip: tuple[int, ...] = ()
    base: datetime = datetime(2007, 1, 1, 9, 0, 0)

    def render(self) -> bytes:
        out, cc = [], dict.fromkeys((PAT, PMT, VIDEO, AUX), 0)

        def put(pid: int, body: bytes, start: bool) -> None:
            out.append(packet(pid, cc[pid], body, start))
            cc[pid] += 1

        for p in range(self.start, self.stop):
            if p in self.skip:
                continue
            at = self.base + timedelta(seconds=p)
            put(PAT, pat(), True)
            put(PMT, pmt(), True)
            put(AUX, label(at, p % 25), True)
            if self.damage.get(p) == "cc":
                cc[VIDEO] += 5
            data = unit(p, corrupt=self.damage.get(p) == "corrupt")
            for k in range(0, len(data), 184):
                put(VIDEO, data[k : k + 184], k == 0)
        return b"".join(out)

    def write(self, path) -> str:
        path.write_bytes(self.render())
        return str(path)
