"""Values for file names, tables and caches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cueflow.functions.times import strip

# URL shapes, temporary suffixes, preview length and labels.
VIDEO_URL = r"(?i)^(https?://)?(www\.)?(youtube\.com/watch\?v=|youtu\.be/|youtube\.com/shorts/|m\.youtube\.com/watch\?v=)[\w\-]+"
VIDEO_ID = r"(?i)(?:youtube\.com/watch\?(?:.*&)?v=|youtu\.be/|youtube\.com/shorts/)([\w\-]{11})"
TEMPORARY_SUFFIXES = (".part", ".ytdl", ".tmp", ".temp")
PREVIEW_CHARS = 80
AUTO_TAG = "Tự động"


def valid_url(url: Column) -> Column:
    return F.coalesce(strip(url).rlike(VIDEO_URL), F.lit(False))


def extract_video_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, VIDEO_ID, 1), F.lit(""))


def format_filesize(size: Column) -> Column:
    """Whole bytes, or one decimal (half to even) of KB to TB; ``-`` for null."""
    shown = lambda power: F.format_string("%.1f", F.rint(size / 1024**power * 10) / 10)
    out = F.when(size.isNull(), "-").when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for power, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(size < 1024 ** (power + 1), F.concat(shown(power), F.lit(f" {unit}")))
    return out.otherwise(F.concat(shown(4), F.lit(" TB")))


def sanitize_filename(name: Column) -> Column:
    """Without the characters that file systems reject; ``clip`` if nothing is left."""
    cleaned = strip(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', ""))
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("clip"))


def output_filename(override: Column, index: Column) -> Column:
    return F.coalesce(F.nullif(override, F.lit("")), F.format_string("clip_%02d.mp4", index))


def transcript_preview(text: Column, language: Column, is_auto: Column) -> Column:
    """Language tag and the first characters of a transcript; a dash without one."""
    label = F.upper(F.coalesce(F.nullif(language, F.lit("")), F.lit("?")))
    tag = F.concat(F.lit("["), label, F.when(F.coalesce(is_auto, F.lit(False)), f" · {AUTO_TAG}").otherwise(""), F.lit("] "))
    cut = F.concat(F.regexp_replace(F.substring(text, 1, PREVIEW_CHARS), r"(?U)\s+$", ""), F.lit("…"))
    shown = F.when(F.length(text) > PREVIEW_CHARS, cut).otherwise(text)
    return F.when(F.coalesce(text, F.lit("")) == "", "—").otherwise(F.concat(tag, shown))


def settings_digest(*settings: Column) -> Column:
    """A short key of a list of settings."""
    return F.substring(F.sha1(F.concat_ws("|", *[s.cast("string") for s in settings])), 1, 16)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; 0 if one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)
