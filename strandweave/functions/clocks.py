"""Timecodes and wall clocks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without a time zone."""
    return F.unix_micros(ts.cast("timestamp"))


def timecode_seconds(tc: Column, fps: float = 25.0) -> Column:
    """HH:MM:SS:FF (or ;FF) in seconds; null for anything else."""
    parts = F.split(F.translate(tc, ";", ":"), ":")
    h, m, s, f = (F.try_element_at(parts, F.lit(k)).try_cast("int") for k in range(1, 5))
    seconds = h * 3600 + m * 60 + s + f / F.lit(fps)
    return F.when(F.size(parts) == 4, seconds)


def wall_clock(rec: Column) -> Column:
    """A full date and time; null for a date alone or a date that doesn't exist."""
    return F.when(rec.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), F.try_to_timestamp(rec, F.lit("yyyy-MM-dd HH:mm:ss")))


def hms(frames: Column, fps: float = 25.0) -> Column:
    """Frames as HH:MM:SS, cut off to whole seconds."""
    s = F.floor(frames / F.lit(fps)).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long") % 60, s % 60)


def date_part(rec: Column) -> Column:
    return F.when(rec.isNull(), F.lit("?")).when(F.instr(rec, " ") > 0, F.split_part(rec, F.lit(" "), F.lit(1))).otherwise(rec)


def time_part(rec: Column) -> Column:
    return F.when(F.coalesce(F.instr(rec, " "), F.lit(0)) > 0, F.split_part(rec, F.lit(" "), F.lit(2))).otherwise(F.lit("?"))


def timecode_or(tc: Column) -> Column:
    return F.coalesce(tc, F.lit("?"))
