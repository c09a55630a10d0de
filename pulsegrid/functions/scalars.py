"""Column expressions of the network model: lenient casts, clock arithmetic, tokens, distances, decay, text and rounding.

Every function takes and returns Columns, so all of them stay inside whole-stage
code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CYCLE = 120  # minutes of the clockface cycle
EARTH_KM = 6371.0
EARTH_KM_FINE = 6371.0088


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# casts, flags, keys ---------------------------------------------------------


def number_or(c, default: float | None = None, positive: bool = False) -> Column:
    """A lenient number: ``default`` where the text is no finite number (or not positive)."""
    x = F.expr(f"try_cast(trim(`{c}`) AS DOUBLE)") if isinstance(c, str) else c.try_cast("double")
    good = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    if positive:
        good = good & (x > 0)
    return F.when(good, x).otherwise(F.lit(default).cast("double"))


def integer_or(c, default: int | None = None, half_even: bool = True) -> Column:
    """A lenient whole number, rounded half to even or cut toward zero."""
    x = number_or(c)
    whole = F.bround(x, 0) if half_even else F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    return F.coalesce(whole.cast("long"), F.lit(default).cast("long"))


def not_nan(c) -> Column:
    """NaN to null, so that aggregates skip it."""
    x = col(c)
    return F.when(~F.isnan(x), x)


#: Texts that count as true.
TRUE_WORDS = ["1", "true", "yes"]


def truthy(c, words: list[str] | None = None) -> Column:
    return F.coalesce(F.lower(F.trim(col(c))).isin(words or TRUE_WORDS), F.lit(False))


def community_code(c) -> Column:
    """Digits only, a trailing ``.0`` dropped, padded with zeros to four places (longer codes stay whole)."""
    digits = F.regexp_replace(F.regexp_replace(F.trim(col(c).cast("string")), r"\.0$", ""), r"\D", "")
    return F.when(F.length(digits) >= 4, digits).when(digits == "", None).otherwise(F.lpad(digits, 4, "0"))


def alias_name(c, prefixes: dict[str, str]) -> Column:
    """The name that stands for a family of names with a common prefix."""
    name = F.trim(col(c))
    out = name
    for prefix, canonical in prefixes.items():
        out = F.when(name.startswith(prefix), F.lit(canonical)).otherwise(out)
    return out


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The name of the first check that holds, else null: a static filter chain."""
    return F.coalesce(*[F.when(condition, F.lit(reason)) for condition, reason in checks])


def flags(*checks: tuple[Column, str]) -> Column:
    return F.concat_ws("; ", *[F.when(condition, F.lit(name)) for condition, name in checks])


def clamp(c, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(c)))


def path_weight(allocated, demand, share, least: float = 0.0) -> Column:
    """Allocated passengers where positive, else demand times share."""
    return F.when(col(allocated) > least, col(allocated)).otherwise(F.greatest(col(demand), F.lit(0.0)) * F.greatest(col(share), F.lit(0.0)))


# clock ----------------------------------------------------------------------


def clock_text(minute, wrap: bool = True) -> Column:
    """``HH:MM`` of minutes after midnight; null and negative give ``NA``."""
    m = col(minute)
    at = F.pmod(m, F.lit(1440)) if wrap else m
    return F.when(m.isNull() | (m < 0), F.lit("NA")).otherwise(F.format_string("%02d:%02d", F.floor(at / 60).cast("int"), (at % 60).cast("int")))


def clock_minute(text) -> Column:
    part = F.split(F.trim(col(text)), ":")
    return F.get(part, 0).try_cast("int") * 60 + F.get(part, 1).try_cast("int")


def clockface(minute, cycle: int = CYCLE) -> Column:
    return F.pmod(col(minute), F.lit(cycle))


def clock_list(text) -> Column:
    """The minutes of a comma-separated list of ``HH:MM``; what is no time is left out."""
    return F.filter(F.transform(F.split(F.coalesce(col(text), F.lit("")), ","), clock_minute), lambda x: x.isNotNull())


def leading_number(text) -> Column:
    return F.regexp_extract(col(text), r"(-?\d+)", 1).try_cast("int")


#: Fixed format of a timetable token: minute, n (even hours) or i (odd hours), P, Q, in either case.
TOKEN = r"^\s*(\d{1,2})\s*([inIN]?)\s*([Pp]?)\s*([Qq]?)\s*$"


def token(text) -> Column:
    """A struct ``minute``, ``parity`` (all, even, odd), ``p``, ``q``; null where the text is no token."""
    part = lambda k: F.lower(F.regexp_extract(col(text), TOKEN, k))
    minute = part(1).try_cast("int")
    parity = F.when(part(2) == "n", F.lit("even")).when(part(2) == "i", F.lit("odd")).otherwise(F.lit("all"))
    return F.when(minute.between(0, 59), F.struct(minute.alias("minute"), parity.alias("parity"), (part(3) == "p").alias("p"), (part(4) == "q").alias("q")))


def token_text(t) -> Column:
    """The token as it is written: no leading zero, then the hours, P and Q."""
    t = col(t)
    mark = F.when(t["parity"] == "even", "n").when(t["parity"] == "odd", "i").otherwise("")
    return F.concat(t["minute"].cast("string"), mark, F.when(t["p"], "P").otherwise(""), F.when(t["q"], "Q").otherwise(""))


def token_shifted(t, delta) -> Column:
    """The token moved by minutes; each odd number of hours carried turns even hours to odd ones."""
    t = col(t)
    total = t["minute"] + col(delta)
    odd = F.pmod(F.floor(total / 60), F.lit(2)) == 1
    parity = F.when(~odd | (t["parity"] == "all"), t["parity"]).when(t["parity"] == "even", F.lit("odd")).otherwise(F.lit("even"))
    return F.struct(F.pmod(total, F.lit(60)).cast("int").alias("minute"), parity.alias("parity"), t["p"].alias("p"), t["q"].alias("q"))


def token_faces(t) -> Column:
    """The clockface minutes (of 120, from 05:00) at which the token stands."""
    t = col(t)
    return F.when(t["parity"] == "odd", F.array(t["minute"])).when(t["parity"] == "even", F.array(t["minute"] + 60)).otherwise(F.array(t["minute"], t["minute"] + 60))


# texts ----------------------------------------------------------------------

#: White space between words, and a time of the day with what may not stand before it.
WHITE, CLOCK = r"[\x20\x09-\x0D]+", r"(^|[^0-9:])([01]?[0-9]|2[0-3]):[0-5][0-9]"


def word_count(text) -> Column:
    """Words between white space (null: 0); each becomes one letter and all else goes, so no array of words is made."""
    letters = F.regexp_replace(col(text), r"[^\x20\x09-\x0D]+", "w")
    return F.coalesce(F.length(F.translate(letters, " \t\n\x0b\x0c\r", "")).cast("long"), F.lit(0))


def clock_count(text) -> Column:
    """Times of the day, ``H:MM`` or ``HH:MM``, in a text (null: 0)."""
    return F.coalesce(F.regexp_count(col(text), F.lit(CLOCK)).cast("long"), F.lit(0))


# distance and decay ---------------------------------------------------------


def haversine(lat1, lon1, lat2, lon2, radius: float = EARTH_KM, least: float = 0.0) -> Column:
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    km = 2 * radius * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))
    return F.greatest(km, F.lit(least)) if least else km


def to_lv95(lat, lon) -> tuple[Column, Column]:
    """East and north by the published approximate formulas (fixed values)."""
    p, q = (col(lat) * 3600 - 169028.66) / 10000, (col(lon) * 3600 - 26782.5) / 10000
    east = 2600072.37 + 211455.93 * q - 10938.51 * q * p - 0.36 * q * p * p - 44.54 * q * q * q
    north = 1200147.07 + 308807.95 * p + 3745.25 * q * q + 76.63 * p * p - 194.56 * q * q * p + 119.79 * p * p * p
    return east, north


def fitted(x, y, bounds: tuple[float, float, float, float], width: float, height: float) -> tuple[Column, Column]:
    """Planar coordinates scaled to a viewport that keeps proportions (y downwards)."""
    low_x, low_y, high_x, high_y = bounds
    scale = min(width / (high_x - low_x), height / (high_y - low_y))
    return (col(x) - low_x) * scale, (high_y - col(y)) * scale


def bucket(c, thresholds: list[float]) -> Column:
    """The place of the first threshold that is not below the value; null for null, NaN and negative values."""
    x = col(c)
    out = F.lit(len(thresholds))
    for i in reversed(range(len(thresholds))):
        out = F.when(x <= thresholds[i], F.lit(i)).otherwise(out)
    return F.when(x.isNotNull() & ~F.isnan(x) & (x >= 0), out)


def duration_text(seconds) -> Column:
    s = F.floor(col(seconds)).cast("long")
    h, m = F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long")
    return F.when(h > 0, F.format_string("%d h %d min %d s", h, m, s % 60)).when(m > 0, F.format_string("%d min %d s", m, s % 60)).otherwise(F.format_string("%d s", s % 60))


def clipped_exp(c, bound: float = 60.0) -> Column:
    return F.exp(clamp(c, -bound, bound))


def power_decay(distance, add: float, power: float) -> Column:
    return F.lit(1.0) / F.pow(col(distance) + add, F.lit(power))


def attenuation(distance, scale: float) -> Column:
    return F.least(F.lit(1.0), col(distance) / scale)


def geometric_blend(a, b, alpha: float) -> Column:
    a, b = col(a), col(b)
    return F.when((a > 0) & (b > 0), F.exp(alpha * F.ln(a) + (1 - alpha) * F.ln(b))).otherwise(F.lit(0.0))


def near_damping(distance, least: float, most_km: float, power: float) -> Column:
    """A factor for short distances, from ``least`` at none to 1 at ``most_km``; 1 where there is no distance."""
    d = col(distance)
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), d / most_km))
    return F.when(d.isNull() | F.isnan(d) | (d <= 0) | (d >= most_km), 1.0).otherwise(least + (1 - least) * F.pow(ratio, F.lit(power)))


def transfer_discount(target, transfers, strength: float = 0.4, cap: float = 0.7, floor: float = 0.3) -> Column:
    """A station's target after a discount by its transfer passengers, twice of whom are in the target; nothing stays nothing."""
    old = F.greatest(col(target), F.lit(0.0))
    share = F.least(F.lit(cap), F.greatest(F.lit(0.0), strength * 2 * col(transfers) / old))
    return F.when(old > 0, F.greatest(old * floor, old * (1 - share))).otherwise(0.0)


def short_id(*parts) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)


def simplex(a, b, c) -> tuple[Column, Column]:
    """Plane coordinates of a triple of shares."""
    total = col(a) + col(b) + col(c)
    return (col(b) + col(c) / 2) / total, col(c) * (3**0.5 / 2) / total


def weight_half_even(c, digits: int) -> Column:
    return F.bround(col(c), digits)


# arrays ---------------------------------------------------------------------


def without_repeats(values) -> Column:
    """The array with each value that equals the one before it left out."""
    a = col(values)
    return F.filter(a, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(a, i - 1)))


def first_of_each(values) -> Column:
    return F.array_distinct(col(values))


def listed(values, most: int | None = None) -> Column:
    """Distinct values in order, the first ``most``, joined by a semicolon."""
    a = F.array_sort(F.collect_set(values))
    return F.array_join(F.slice(a, 1, most) if most else a, "; ")


def ring_area(xs, ys) -> Column:
    """The signed area of a ring of points (shoelace)."""
    x, y = col(xs), col(ys)
    n = F.size(x)
    term = lambda i: F.get(x, i) * F.get(y, (i + 1) % n) - F.get(x, (i + 1) % n) * F.get(y, i)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda total, i: total + term(i)) / 2


def ring_centroid(xs, ys) -> tuple[Column, Column]:
    """The area-weighted centroid; the mean of the points where the area is next to nothing."""
    x, y = col(xs), col(ys)
    n, area = F.size(x), ring_area(xs, ys)
    cross = lambda i: F.get(x, i) * F.get(y, (i + 1) % n) - F.get(x, (i + 1) % n) * F.get(y, i)

    def one(v):
        moment = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda t, i: t + (F.get(v, i) + F.get(v, (i + 1) % n)) * cross(i))
        mean = F.aggregate(v, F.lit(0.0), lambda t, e: t + e) / n
        return F.when(F.abs(area) < 1e-9, mean).otherwise(moment / (6 * area))

    return one(x), one(y)


def _corners(a: Column, b: Column):
    n = F.size(a)
    return F.sequence(F.lit(0), n - 1), lambda i: (F.get(a, i), F.get(b, i), F.get(a, (i + 1) % n), F.get(b, (i + 1) % n))


def crossed(x, y, xs, ys) -> Column:
    """Whether a ray from a point crosses a ring an odd number of times."""
    x, y, a, b = map(col, (x, y, xs, ys))
    edges, corner = _corners(a, b)

    def crosses(i):
        x1, y1, x2, y2 = corner(i)
        return ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / F.when(y1 != y2, y2 - y1) + x1)

    return F.aggregate(edges, F.lit(False), lambda odd, i: F.when(crosses(i), ~odd).otherwise(odd))


def on_border(x, y, xs, ys) -> Column:
    x, y, a, b = map(col, (x, y, xs, ys))
    edges, corner = _corners(a, b)

    def border(i):
        x1, y1, x2, y2 = corner(i)
        return (F.abs((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)) < 1e-12) & x.between(F.least(x1, x2), F.greatest(x1, x2)) & y.between(F.least(y1, y2), F.greatest(y1, y2))

    return F.exists(edges, border)


def inside(x, y, xs, ys) -> Column:
    """Whether a point lies within a ring or on its border (even-odd test)."""
    return on_border(x, y, xs, ys) | crossed(x, y, xs, ys)
