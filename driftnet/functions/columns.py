"""Scalar functions as column expressions."""

from __future__ import annotations

import string
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftnet.config import Config

TEXT_CAP = 2_000_000
EMBED_CLIP = 8_000
SNIPPET = 240
QUICK_HASH = 8 << 20
EDGE = 1 << 20


def clean_text(c: Column) -> Column:
    """Null becomes empty, NUL characters go."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit("\u0000"), F.lit(""))


def squeeze(c: Column) -> Column:
    """White space of any kind collapses to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_markup(c: Column) -> Column:
    """Tags become spaces, then white space collapses."""
    return squeeze(F.regexp_replace(c, "<[^>]+>", " "))


def snippet(c: Column, length: int = SNIPPET) -> Column:
    """The first characters of a text without white space around them."""
    return F.regexp_replace(F.substring(c, 1, length), r"(?U)^\s+|\s+$", "")


def one_line(c: Column, length: int = 150) -> Column:
    return F.substring(squeeze(c), 1, length)


def ascii_lower(c: Column) -> Column:
    """Lower case for A to Z only, as the catalogue's name search folds case."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def like_contains(c: Column, term: str) -> Column:
    """Whether ``c`` holds the term, A to Z in either case; % and _ of the term stay wildcards, nothing is an escape."""
    escape = next(chr(i) for i in range(1, 32) if chr(i) not in term)
    pattern = "%" + "".join(x.lower() if x in string.ascii_uppercase else x for x in term) + "%"
    return F.like(ascii_lower(c), F.lit(pattern), F.lit(escape))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """What follows the last dot, lower-cased; leading dots don't count, no dot gives ''."""
    return F.lower(F.regexp_extract(name, r"(?s)^\.*[^.].*\.([^.]*)$", 1))


def kind_of(ext: Column, cfg: Config | None = None) -> Column:
    """Kind by extension; the first set that has it decides."""
    e = F.regexp_replace(F.lower(F.coalesce(ext, F.lit(""))), r"^\.+", "")
    out = F.lit("unsupported")
    for kind, own in reversed((cfg or Config()).kinds()):
        out = F.when(e.isin(sorted(own)), kind).otherwise(out)
    return out


def content_hash(content: Column, size: Column | None = None) -> Column:
    """SHA-256 of the size in digits and the bytes; above 8 MiB of the size and the first and last MiB."""
    raw = content.cast("binary")
    size = F.octet_length(raw) if size is None else size
    edges = F.concat(F.substring(raw, 1, EDGE), F.substring(raw, -EDGE, EDGE))
    return F.sha2(F.concat(size.cast("string").cast("binary"), F.when(size <= QUICK_HASH, raw).otherwise(edges)), 256)


def live(deleted_at: Column) -> Column:
    return deleted_at.isNull()


def cooled_down(now: float, seconds: int = 60) -> Column:
    """A row that may be tried again: never tried, never failed, or long enough ago."""
    return (F.col("retry_count") == 0) | F.col("last_attempt").isNull() | (F.col("last_attempt") < now - seconds)


def under_any(path: Column, roots: Iterable[str]) -> Column:
    """Whether a path lies below one of the roots; 'nas' is not above 'nas2/x'."""
    out = F.lit(False)
    for r in roots:
        out = out | path.startswith(r.rstrip("/") + "/")
    return out


def dms_degrees(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Degrees, minutes, seconds and a hemisphere letter to signed decimal degrees; missing parts count 0."""
    z = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    value = z(degrees) + z(minutes) / 60 + z(seconds) / 3600
    return F.when(F.upper(F.substring(ref, 1, 1)).isin("S", "W"), -value).otherwise(value)


def human_size(n: Column) -> Column:
    """'?' for null or zero, else a whole number with B, K, M, G, T or P."""
    size = n.cast("double")
    out = F.concat(F.format_string("%.0f", F.bround(size / 1024.0**5, 0)), F.lit("P"))
    for i, unit in reversed(list(enumerate("BKMGT"))):
        out = F.when(size < 1024.0 ** (i + 1), F.concat(F.format_string("%.0f", F.bround(size / 1024.0**i, 0)), F.lit(unit))).otherwise(out)
    return F.when(n.isNull() | (n == 0), "?").otherwise(out)


def human_duration(seconds: Column) -> Column:
    s = seconds.cast("double")
    return (
        F.when(s < 90, F.concat(F.format_string("%.0f", F.bround(s, 0)), F.lit("s")))
        .when(s < 5400, F.concat(F.format_string("%.0f", F.bround(s / 60, 0)), F.lit(" min")))
        .when(s >= 5400, F.concat(F.format_string("%.1f", s / 3600), F.lit(" h")))
    )


def image_description(folder: Column, name: Column, taken: Column, place: Column, camera: Column, width: Column, height: Column, ocr: Column) -> Column:
    """The text an image is found by: labelled lines for what is known, the file first."""
    has = lambda c: c.isNotNull() & (c.cast("string") != "")
    line = lambda label, c: F.when(has(c), F.concat(F.lit(f"{label}: "), c))
    return F.concat_ws(
        "\n", F.concat(F.lit("file: "), F.concat_ws("/", folder, name)), line("taken", taken), line("place", place), line("camera", camera),
        F.when(F.coalesce(width, F.lit(0)) > 0, F.concat(F.lit("size: "), width.cast("string"), F.lit("x"), height.cast("string"))), line("text in image", ocr),
    )
