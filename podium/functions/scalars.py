"""Column expressions: numbers, names, durations, vectors and rectangles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def frame_interval(seconds: Column | str) -> Column:
    """Seconds between extracted frames of a video of that length: 100, 200 or 300 frames in all, in whole seconds and at least one."""
    s = as_column(seconds)
    exact = F.when(s < 1200, s / 100).when(s > 4800, s / 300).otherwise(s / 200)
    return F.greatest(F.lit(1), F.round(exact).cast("int"))


def frame_interval_exact(seconds: Column | str) -> Column:
    """The same before rounding."""
    s = as_column(seconds)
    return F.when(s < 1200, s / 100).when(s > 4800, s / 300).otherwise(s / 200)


def clock_seconds(text: Column | str) -> Column:
    """Whole seconds of H:M:S with an optional fraction, which is cut off."""
    parts = F.split(F.split_part(as_column(text), F.lit("."), F.lit(1)), ":")
    at = lambda i: F.get(parts, F.lit(i)).cast("int")
    return at(0) * 3600 + at(1) * 60 + at(2)


def iso_seconds(text: Column | str) -> Column:
    """Seconds of an ISO-8601 duration of days, hours, minutes and seconds, as in PT1H2M3S; missing parts are 0."""
    part = lambda unit: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(as_column(text), f"([0-9]+){unit}", 1), F.lit("")), F.lit("999999999")).cast("long"), F.lit(0).cast("long"))
    return part("D") * 86400 + part("H") * 3600 + part("M(?![0-9]*D)") * 60 + part("S")


def longer_than(seconds: Column | str, minutes: int) -> Column:
    """Whether a duration has more than that many full minutes."""
    return F.floor(as_column(seconds) / 60) > minutes


def iso_date(text: Column | str) -> Column:
    """MM-dd-yyyy as an ISO-8601 time in UTC."""
    return F.date_format(F.try_to_timestamp(as_column(text), F.lit("MM-dd-yyyy")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def catalog_id(text: Column | str, size: int = 11) -> Column:
    """The first hexadecimal digits of a text's SHA-1."""
    return F.substring(F.sha1(as_column(text).cast("binary")), 1, size)


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(as_column(path), r"([^/]*)$", 1)


def frame_number(path: Column | str) -> Column:
    """The digits after the first underscore of the base name that digits follow; null without."""
    return F.nullif(F.regexp_extract(base_name(path), "_([0-9]+)", 1), F.lit("")).cast("int")


def figure_frame(path: Column | str) -> Column:
    """The frame of a figure file <frame>_figure_<i>."""
    return F.nullif(F.regexp_extract(base_name(path), "^([0-9]+)_figure_", 1), F.lit("")).cast("int")


def capitalized(text: Column | str) -> Column:
    """First character in upper case, the others in lower case."""
    t = as_column(text)
    return F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, F.lit(2), F.length(t))))


def title_cased(text: Column | str) -> Column:
    """Every letter that no letter precedes in upper case, the others in lower case."""
    pieces = F.regexp_extract_all(as_column(text), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))), "")


def cleaned(text: Column | str) -> Column:
    """Line feeds as spaces, carriage returns removed."""
    return F.regexp_replace(F.regexp_replace(as_column(text), "\r", ""), "\n", " ")


def without_speaker(text: Column | str) -> Column:
    """What follows the first ': '; the text itself where there is none."""
    return F.regexp_replace(as_column(text), r"^(?s:.*?): ", "")


def is_downloaded(flag: Column | str) -> Column:
    """The catalog's flag, however it is written."""
    return F.coalesce(F.lower(F.trim(as_column(flag).cast("string"))).isin("true", "1"), F.lit(False))


def zero_as_null(value: Column | str) -> Column:
    """The catalogs' 0 for no value as null."""
    v = as_column(value).cast("string")
    return F.when(v != "0", v)


# numbers and vectors


def mish(x: Column | str) -> Column:
    x = as_column(x)
    return x * F.tanh(F.log1p(F.exp(x)))


def total(values: Column | str) -> Column:
    return F.aggregate(as_column(values), F.lit(0.0), lambda a, v: a + v.cast("double"))


def softmax(values: Column | str) -> Column:
    v = as_column(values)
    powers = F.transform(v, lambda x: F.exp(x.cast("double") - F.array_max(v).cast("double")))
    return F.transform(powers, lambda p: p / total(powers))


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(as_column(a), as_column(b), lambda x, y: x.cast("double") * y.cast("double")))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - a.b / (|a| |b|) in double precision; null where either is null or has length 0."""
    return 1 - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(as_column(a), as_column(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def entropy(counts: Column | str) -> Column:
    """Shannon entropy, base 2, of an array of counts."""
    whole = total(counts)
    return -total(F.transform(as_column(counts), lambda c: F.when(c > 0, c / whole * F.log2(c / whole)).otherwise(0.0)))


# rectangles: structs of xmax, ymax, xmin, ymin


def box(x: Column | str, y: Column | str, w: Column | str, h: Column | str) -> Column:
    """The corners of a rectangle given by place and size."""
    x, y, w, h = map(as_column, (x, y, w, h))
    return F.struct((x + w).alias("xmax"), (y + h).alias("ymax"), x.alias("xmin"), y.alias("ymin"))


def box_area(b: Column | str) -> Column:
    b = as_column(b)
    return (b["xmax"] - b["xmin"]) * (b["ymax"] - b["ymin"])


def box_overlap(a: Column | str, b: Column | str) -> Column:
    """The area that two rectangles share; 0 where they don't meet."""
    a, b = as_column(a), as_column(b)
    dx = F.least(a["xmax"], b["xmax"]) - F.greatest(a["xmin"], b["xmin"])
    dy = F.least(a["ymax"], b["ymax"]) - F.greatest(a["ymin"], b["ymin"])
    return F.when((dx >= 0) & (dy >= 0), dx * dy).otherwise(F.lit(0))
