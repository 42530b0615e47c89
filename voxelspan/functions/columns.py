"""Column functions: units, keys, projections, profiles. All stay inside the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def nodata_to_null(x: Column, nodata: float = 32767) -> Column:
    return F.nullif(x, F.lit(nodata))


def dm_to_m(x: Column, nodata: int = 32767) -> Column:
    return nodata_to_null(x, nodata) / 10


def m_to_dm(x: Column) -> Column:
    """Whole decimetres, halves to even."""
    return F.bround(x * 10).cast("int")


def finite(x: Column) -> Column:
    """The value, or null if it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def spatial_cell(lon: Column, lat: Column, degrees: float) -> Column:
    return F.concat_ws("_", F.floor(lat / degrees).cast("string"), F.floor(lon / degrees).cast("string"))


def shot_parts(shot: Column) -> dict[str, Column]:
    """Orbit, minor frame and number within the beam, out of a shot id."""
    div = lambda by: F.call_function("div", shot, F.lit(by).cast("long"))
    return {"orbit": div(10**13), "minor_frame": div(10**8) % 1000, "within_beam": shot % 10**8}


def parse_shot_id(text: Column) -> Column:
    """Whole number of an id that comes as text, through double only where it is written as one."""
    return F.coalesce(text.try_cast("bigint"), F.round(text.try_cast("double")).cast("bigint"))


def boa_offset(value: Column, is_reflectance: Column, baseline: Column, processed: Column, acquired: Column, since: str = "2022-01-25") -> Column:
    """Reflectance without the offset of newer processing: by baseline, else processing date, else acquisition date."""
    new = F.coalesce(baseline >= 4, processed >= F.lit(since), acquired >= F.lit(since), F.lit(False))
    return F.when(new & is_reflectance, F.greatest(value, F.lit(1000)) - 1000).otherwise(value)


def scene_parts(scene: Column) -> dict[str, Column]:
    """Fields of mission_level_sensing_orbit_tile_processing."""
    p = F.split(scene, "_")
    return {k: F.get(p, F.lit(i)) for i, k in enumerate(("mission", "level", "sensing", "orbit", "scene_tile", "processing"))}


def growing_window(day: Column, on: Column, off: Column, flag: Column, half: int = 90) -> tuple[Column, Column]:
    """Date +- ``half`` days, or leaf-on to leaf-off (a year later where it wraps) if the date lies inside and flag is 0."""
    end = F.when(off < on, F.date_add(off, 365)).otherwise(off)
    inside = (flag == 0) & (day >= on) & (day <= end)
    return F.when(inside, on).otherwise(F.date_add(day, -half)), F.when(inside, end).otherwise(F.date_add(day, half))


def level(profile: Column, k: int) -> Column:
    return F.get(profile, F.lit(k))


def normalized_profile(profile: Column, top: int) -> Column:
    """Levels over the top height; null where that is not positive."""
    return F.when(level(profile, top) > 0, F.transform(profile, lambda x: x / level(profile, top)))


def understory_ratio(profile: Column, k: int, top: int) -> Column:
    return F.when(level(profile, top) > 0, level(profile, k) / level(profile, top))


def realistic(profile: Column, low: float, high: float) -> Column:
    """Whether a profile has a value and none out of range."""
    return F.exists(profile, lambda x: x.isNotNull()) & ~F.exists(profile, lambda x: (x < low) | (x > high))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def profile_histogram(profile: Column, width: float, top: float) -> Column:
    """Counts of the positive values, clipped at ``top``, in bins of ``width``."""
    n = math.ceil(top / width)
    at = F.transform(F.filter(profile, lambda x: x > 0), lambda x: F.least(F.floor(F.least(x, F.lit(top)) / width), F.lit(n - 1)).cast("int"))
    return let(at, lambda held: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.size(F.filter(held, lambda x: x == k))))


def diversity(profile: Column, width: float, top: float, low: int, high: int) -> dict[str, Column]:
    """Shannon diversity fhd of the height bins, its exponential, the inverse of the summed squares, canopy ratio.

    With counts c of the bins and their sum n: fhd = ln n - sum(c ln c) / n, and the summed squares are sum(c c) / n n.
    """
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("c_ln"), F.lit(0.0).alias("c_c"))
    add = lambda a, c: F.struct((a["n"] + c).alias("n"), (a["c_ln"] + F.when(c > 0, c * F.ln(c)).otherwise(0.0)).alias("c_ln"), (a["c_c"] + c * c).alias("c_c"))
    sums = F.aggregate(profile_histogram(profile, width, top), zero, add)
    shares = let(sums, lambda s: F.struct((F.ln(s["n"]) - F.try_divide(s["c_ln"], s["n"])).alias("fhd"), F.try_divide(s["n"] * s["n"], s["c_c"]).alias("enl2d"), s["n"].alias("n")))
    fhd = F.when(shares["n"] > 0, shares["fhd"])
    ratio = F.when(level(profile, high) > 0, (level(profile, high) - F.greatest(level(profile, low), F.lit(0))) / level(profile, high))
    return {"fhd": fhd, "enl1d": F.exp(fhd), "enl2d": F.when(shares["n"] > 0, shares["enl2d"]), "canopy_ratio": ratio}


def profile_auc(profile: Column, top: int, least: float) -> Column:
    """Mean of the levels over the top height, not below 0; null below the forest threshold."""
    h = level(profile, top)
    mean = F.aggregate(profile, F.lit(0.0), lambda a, x: a + x / h) / F.size(profile)
    return F.when(h >= least, F.greatest(mean, F.lit(0.0)))


def relative_entropy(fhd: Column, height: Column, width: float) -> Column:
    return F.when(height > width, fhd / F.ln(height / width))


def shape_rmse(a: Column, b: Column) -> Column:
    """Root mean squared difference of two profiles of equal length."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a))


def quantile_sort(lo: Column, mid: Column, hi: Column, gap: float = 0.0) -> tuple[Column, Column, Column]:
    """The three in order, outer ones at least ``gap`` from the middle."""
    s = F.array_sort(F.array(lo, mid, hi))
    m = s[1]
    return F.least(s[0], m - gap), m, F.greatest(s[2], m + gap)


def conformal_score(y: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo - y, y - hi)


def pinball_loss(y: Column, p: Column, q: float) -> Column:
    e = y - p
    return F.greatest((q - 1) * e, q * e)


def interval_width(lo: Column, mid: Column, hi: Column, nodata: float = 32767) -> dict[str, Column]:
    """Width of an interval, and its share of the median in thousandths (nodata where the median is not positive)."""
    ok = (lo != nodata) & (mid != nodata) & (hi != nodata)
    return {"width": F.when(ok, hi - lo).otherwise(nodata), "relative": F.when(ok & (mid > 0), F.round((hi - lo) / mid * 1000)).otherwise(nodata)}


def ratio_shares(num_a: Column, den_a: Column, num_b: Column, den_b: Column, least: float = 1e-9) -> dict[str, Column]:
    """Share of numerator and denominator in the contrast of two logarithmic ratios; null near cancellation."""
    num, den = F.ln(num_a / num_b), -F.ln(den_a / den_b)
    return {"contrast": num + den, "numerator_share": F.when(F.abs(num + den) > least, num / (num + den)), "denominator_share": F.when(F.abs(num + den) > least, den / (num + den))}


def undisturbed(*marks: Column) -> Column:
    """Whether no mark of loss, gain, fire or disturbance is set; missing marks count as none."""
    out = F.lit(True)
    for m in marks:
        out = out & (F.coalesce(m, F.lit(0)) == 0)
    return out


#: Ellipsoid and scale of UTM. Fixed values.
A, FLATTENING, SCALE = 6378137.0, 1 / 298.257223563, 0.9996


def _series() -> tuple[float, list[float]]:
    """Rectifying radius and coefficients of the transverse Mercator series to the fourth power of the third flattening."""
    n = FLATTENING / (2 - FLATTENING)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    return radius, alpha


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) % 60 + 1).cast("int")


def utm(lon: Column, lat: Column, zone: Column | None = None) -> tuple[Column, Column]:
    """Easting and northing (false northing 10,000 km in the south)."""
    radius, alpha = _series()
    zone = utm_zone(lon) if zone is None else zone
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + SCALE * radius * x, SCALE * radius * y + F.when(lat < 0, 10000000.0).otherwise(0.0)


def mgrs_square(lon: Column, lat: Column) -> Column:
    """Name of the 100 km square of a point: zone, band, column and row letter; null from 56 degrees of latitude on."""
    zone = utm_zone(lon)
    east, north = utm(lon, lat, zone)
    band = F.substring(F.lit("CDEFGHJKLMNPQRSTUVWX"), F.floor((lat + 80) / 8).cast("int") + 1, F.lit(1))
    column = F.substring(F.lit("ABCDEFGHJKLMNPQRSTUVWXYZ"), ((zone - 1) % 3 * 8 + F.floor(east / 100000)).cast("int"), F.lit(1))
    row = (F.floor(north / 100000) + F.when(zone % 2 == 0, 5).otherwise(0)) % 20
    letter = F.substring(F.lit("ABCDEFGHJKLMNPQRSTUV"), row.cast("int") + 1, F.lit(1))
    return F.when(F.abs(lat) < 56, F.concat(F.lpad(zone.cast("string"), 2, "0"), band, column, letter))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371008.8 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a ring of struct<x,y>: ray casting over its edges (left and lower borders count)."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        over = (a["y"] > y) != (b["y"] > y)
        return F.when(over & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), crosses), F.lit(0), lambda s, c: s + c) % 2 == 1


def majority_months(months: Sequence[float] | Column) -> Column:
    """Months with a share above one half if there are five, else the five most frequent (of equal ones the earlier)."""
    pairs = F.transform(months, lambda x, i: F.struct((-x).alias("k"), (i + 1).alias("month")))
    often = F.filter(pairs, lambda p: p["k"] < -0.5)
    top = F.slice(F.array_sort(F.filter(pairs, lambda p: p["k"] < 0)), 1, 5)
    return F.array_sort(F.transform(F.when(F.size(often) >= 5, often).otherwise(top), lambda p: p["month"]))
