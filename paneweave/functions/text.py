"""Column expressions that write durations, labels, titles and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: colours of the wireframe by depth, and of the drawing by kind
DEPTH_COLORS = ["#e63946", "#457b9d", "#2a9d8f", "#e9c46a", "#9b5de5", "#f72585", "#fb8500", "#06d6a0"]
KIND_COLORS = {"container": (0, 120, 255), "text": (0, 180, 70), "icon": (255, 140, 0)}
LABEL_CHARS = 24


def _fixed(value: Column, places: int) -> Column:
    """A number with so many places; halves go to the even digit."""
    n = F.rint(value * 10**places).cast("long")
    whole = F.floor(n / 10**places).cast("string")
    return whole if places == 0 else F.concat(whole, F.lit("."), F.lpad((n % 10**places).cast("string"), places, "0"))


def format_ms(ms: Column) -> Column:
    return F.when(ms >= 1000, F.concat(_fixed(ms / 1000, 2), F.lit("s"))).when(ms >= 10, F.concat(_fixed(ms, 0), F.lit("ms"))).otherwise(F.concat(_fixed(ms, 1), F.lit("ms")))


def truncate_label(text: Column, most: int = LABEL_CHARS) -> Column:
    """Trimmed; longer texts are cut to ``most`` characters and an ellipsis."""
    t = F.regexp_replace(text, r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$", "")
    return F.when(F.char_length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most), F.lit("…")))


def html_escape(text: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def depth_color(depth: Column) -> Column:
    return F.get(F.array(*map(F.lit, DEPTH_COLORS)), F.pmod(depth - 1, F.lit(len(DEPTH_COLORS))).cast("int"))


def font_size(height: Column) -> Column:
    return F.least(F.greatest(F.floor(height * 2 / 3).cast("int"), F.lit(8)), F.lit(16))


def badge(depth: Column, kind: Column) -> Column:
    return F.concat(F.lit("L"), depth.cast("string"), F.lit(" · "), kind)


def percent(kind: Column, confidence: Column) -> Column:
    """`` · NN%`` where there is a confidence; icons' runs from 0 to 1."""
    value = F.when(kind == "icon", confidence.cast("double") * 100).otherwise(confidence.cast("double"))
    return F.when(confidence.isNull(), F.lit("")).otherwise(F.concat(F.lit(" · "), _fixed(value, 0), F.lit("%")))


def label_anchor(b: Column) -> Column:
    """Where a label stands: above the box, never outside the image."""
    return F.struct(F.greatest(b["x"], F.lit(0)).alias("x"), F.greatest(b["y"] - 16, F.lit(0)).alias("y"))


def distinct_parts(path: Column, separator: str = ":") -> Column:
    """The parts of a search path, each once, in the order in which they first occur; empty parts go."""
    return F.array_join(F.array_distinct(F.array_remove(F.split(path, separator), "")), separator)
