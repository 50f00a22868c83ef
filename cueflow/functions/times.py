"""Time stamps as integer milliseconds, and their text forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One side of a caption's time line, and a clip's stamp.
VTT_STAMP = r"(?:(\d{2}):)?(\d{2}):(\d{2})\.(\d{3})"
CLIP_STAMP = r"^\d{1,2}(:\d{2}){1,2}$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space (of any script) at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def parse_timestamp_ms(text: Column) -> Column:
    """``M?M:SS`` or ``H?H:MM:SS`` as milliseconds; null if it isn't one or a part is over 59."""

    def parsed(parts: Column) -> Column:
        part = lambda i: F.coalesce(F.try_element_at(F.reverse(parts), F.lit(i)).cast("long"), F.lit(0))
        whole = lambda s, m, h: F.when(parts.isNotNull() & (s < 60) & (m < 60), ((h * 60 + m) * 60 + s) * 1000)
        return whole(part(1), part(2), part(3))

    split = lambda t: F.split(F.when(t.rlike(CLIP_STAMP), t), ":")
    return let(let(strip(text), split), parsed)


def stamp_ms(hours: Column, minutes: Column, seconds: Column, millis: Column) -> Column:
    """Milliseconds from the text parts of a caption stamp; the hours may be missing."""
    whole = lambda c: F.coalesce(c.try_cast("long"), F.lit(0))
    return ((whole(hours) * 60 + whole(minutes)) * 60 + whole(seconds)) * 1000 + whole(millis)


def vtt_ms(text: Column) -> Column:
    """The caption stamp ``[HH:]MM:SS.mmm`` as milliseconds."""
    part = lambda i: F.regexp_extract(text, VTT_STAMP, i)
    return F.when(text.rlike(VTT_STAMP), stamp_ms(part(1), part(2), part(3), part(4)))


def _clock(ms: Column) -> tuple[Column, Column, Column, Column]:
    ms = F.greatest(ms, F.lit(0)).cast("long")
    part = lambda size, most: F.pmod(F.floor(ms / size), F.lit(most)).cast("long")
    return F.floor(ms / 3_600_000).cast("long"), part(60_000, 60), part(1_000, 60), part(1, 1_000)


def format_duration(ms: Column) -> Column:
    """``MM:SS``, from an hour on ``H:MM:SS``; half seconds round to even."""
    total = F.greatest(F.rint(ms / 1000), F.lit(0)).cast("long")
    hours, minutes, seconds = F.floor(total / 3600), F.floor(total / 60) % 60, total % 60
    return F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, seconds)).when(ms.isNotNull(), F.format_string("%02d:%02d", minutes, seconds))


def format_hms_ms(ms: Column) -> Column:
    """``HH:MM:SS.mmm``."""
    return F.when(ms.isNotNull(), F.format_string("%02d:%02d:%02d.%03d", *_clock(ms)))


def format_srt(ms: Column) -> Column:
    """``HH:MM:SS,mmm``."""
    return F.when(ms.isNotNull(), F.format_string("%02d:%02d:%02d,%03d", *_clock(ms)))


def is_due(last: Column, now: Column, interval_ms: int) -> Column:
    """Whether ``interval_ms`` has passed since ``last``; a stamp that can't be read is due."""
    then = F.try_to_timestamp(last)
    return F.coalesce(F.unix_millis(now.cast("timestamp")) - F.unix_millis(then) >= interval_ms, F.lit(True))


def overlap_ms(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Common length of two intervals; negative: the gap between them."""
    return F.least(end_a, end_b) - F.greatest(start_a, start_b)


def duration_ms(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0), end - start)
