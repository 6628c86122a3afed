"""Text expressions and small driver-side renderers of reports."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What divides words in a capture's name.
TITLE_SEPARATORS = " -_.·"


def kinds(cc: Column, tei: Column, dec: Column) -> Column:
    """What damaged a row, as a list in words."""
    names = F.concat_ws(", ", F.when(cc > 0, F.lit("dropped packets")), F.when(tei > 0, F.lit("transport error")), F.when(dec > 0, F.lit("decode error")))
    return F.when(names == "", F.lit("damage")).otherwise(names)


#: Message families of a decoder's log.
ERROR_LINE = "(?i)damaged|invalid|concealing|corrupt|forbidden|marker"
CONTAINER_LINE = "(?i)packet corrupt|corrupt input packet|non[- ]?monoton|monotonically increasing|packet mismatch"
HARMLESS_LINE = "MVs not available"
FRAME_LINE = "showinfo.*pts_time:([0-9.]+)"


def log_class(line: Column) -> Column:
    """frame, container (the demultiplexer's clock), error (a picture) or other."""
    quiet = line.contains("showinfo") | line.contains(HARMLESS_LINE)
    return F.when(line.rlike(FRAME_LINE), "frame").when(quiet | ~line.rlike(ERROR_LINE), "other").when(line.rlike(CONTAINER_LINE), "container").otherwise("error")


def frame_ticks(line: Column) -> Column:
    """The presentation time of a frame line in 90 kHz ticks, halves to even."""
    return F.rint(F.regexp_extract(line, FRAME_LINE, 1).try_cast("double") * 90000).cast("long")


def count_substring(text: Column, part: Column) -> Column:
    """Occurrences that don't overlap."""
    return ((F.length(text) - F.length(F.replace(text, part))) / F.length(part)).cast("long")


def common_prefix(low: Column, high: Column) -> Column:
    """Longest common prefix of two strings (of a set: of its least and greatest)."""
    n = F.least(F.length(low), F.length(high))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.substring(low, 1, k) != F.substring(high, 1, k))
    return F.when(n == 0, F.lit("")).otherwise(F.substring(low, F.lit(1), F.coalesce(F.try_element_at(differ, F.lit(1)) - 1, n)))


def title(tags: Sequence[str]) -> str:
    """The common prefix of some names, cut after its last separator."""
    if not tags:
        return ""
    low, high = min(tags), max(tags)
    if low == high:
        return low
    n = 0
    while n < min(len(low), len(high)) and low[n] == high[n]:
        n += 1
    cut = max((low[:n].rfind(s) for s in TITLE_SEPARATORS), default=-1)
    return low[: cut + 1].rstrip(TITLE_SEPARATORS) if cut >= 0 else low[:n]


def width(s: str) -> int:
    """Columns a terminal needs: wide characters take two."""
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def table(header: Sequence[str], rows: Sequence[Sequence[object]]) -> str:
    """A Markdown table whose columns stand under each other."""
    cells = [list(map(str, header)), *([str(x) for x in row] for row in rows)]
    widths = [max(width(r[k]) for r in cells) for k in range(len(header))]
    line = lambda r: "| " + " | ".join(c + " " * (w - width(c)) for c, w in zip(r, widths, strict=True)) + " |"
    return "\n".join([line(cells[0]), "|" + "|".join("-" * (w + 2) for w in widths) + "|", *map(line, cells[1:])])
