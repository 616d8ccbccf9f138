"""Radiometric calibration of digital numbers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlake.functions.dates import sun_distance_squared
from gridlake.functions.numeric import clamp, ratio


def gain_bias(low: float, high: float, steps: int = 254) -> tuple[float, float]:
    """Gain and bias of a band whose numbers 1 to 255 span the radiances ``low`` to ``high``."""
    gain = (high - low) / steps
    return gain, low - gain


def radiance(number: Column, sensor: str, *constants: float) -> Column:
    """At-sensor radiance, 0 where it would be negative.

    ``landsat``: gain, bias. ``aster``: unit conversion. ``cbers``: calibration. ``worldview2``: factor, bandwidth."""
    n = number.cast("double")
    if sensor == "landsat":
        value = n * constants[0] + constants[1]
    elif sensor == "aster":
        value = (n - 1) * constants[0]
    elif sensor == "cbers":
        value = n / constants[0]
    elif sensor == "worldview2":
        value = n * constants[0] / constants[1]
    else:
        raise ValueError(f"unknown sensor {sensor!r}")
    return F.when(value > 0, value).otherwise(0.0)


def reflectance(radiance_: Column, day: Column, esun: float, elevation: Column) -> Column:
    """Top-of-atmosphere reflectance; ``elevation``: of the sun, in degrees."""
    return ratio(F.pi() * radiance_ * sun_distance_squared(day), esun * F.cos(F.radians(90 - elevation)))


def scaled_reflectance(number: Column, gain: float, bias: float, elevation: Column) -> Column:
    """Reflectance of sensors whose numbers carry scaled reflectance."""
    return ratio(number.cast("double") * gain + bias, F.cos(F.radians(90 - elevation)))


def optical_depth(wavelength: float) -> float:
    """Rayleigh optical depth at a wavelength in micrometres."""
    return 0.008569 * wavelength**-4 * (1 + 0.0113 * wavelength**-2 + 0.00013 * wavelength**-4)


def path_radiance(dark: Column, day: Column, esun: float, elevation: Column, share: float = 0.01) -> Column:
    """Radiance of the dark object less what a surface of reflectance ``share`` would send."""
    return dark - share * esun * F.cos(F.radians(90 - elevation)) / (F.pi() * sun_distance_squared(day))


def reflectance_dark(radiance_: Column, path: Column, day: Column, esun: float, elevation: Column) -> Column:
    """Surface reflectance by dark-object subtraction, 0 where it would be negative."""
    value = ratio(F.pi() * (radiance_ - path) * sun_distance_squared(day), esun * F.cos(F.radians(90 - elevation)))
    return F.when(value > 0, value).otherwise(0.0)


def dark_number(number: Column, least: int) -> tuple[Column, Column]:
    """For ``df.groupBy(number).count()``: (condition, aggregate) of the smallest number of 1 or more held by ``least`` cells."""
    return (number >= 1) & (F.col("count") >= least), F.min(number)


def kelvin(radiance_: Column, k1: float, k2: float) -> Column:
    """Brightness temperature; null where radiance is 0 or less."""
    return F.when(radiance_ > 0, k2 / F.log(k1 / F.when(radiance_ > 0, radiance_) + 1))


def stored(x: Column, kind: str) -> Column:
    """Values of 0 to 1 stretched to whole numbers: 0-255 for ``byte``, 0-10000 for ``uint16``."""
    top = {"byte": 255, "uint16": 10000}[kind]
    return F.floor(clamp(x, 0.0, 1.0) * top).cast("int")


#: What each flag of a quality band means: first bit, last bit, least level.
QUALITY_BITS: dict[str, dict[str, tuple[int, int, int]]] = {
    "HLS": {"cirrus": (0, 0, 1), "cloud": (1, 1, 1), "adjacent": (2, 2, 1), "shadow": (3, 3, 1), "snowice": (4, 4, 1), "water": (5, 5, 1)},
    "L8": {"cirrus": (12, 13, 3), "cloud": (14, 15, 3), "shadow": (6, 7, 3), "snowice": (10, 11, 3), "water": (4, 5, 3), "fill": (0, 0, 1), "dropped": (1, 1, 1), "terrain": (2, 2, 1)},
    "ARD": {"fill": (0, 0, 1), "clear": (1, 1, 1), "water": (2, 2, 1), "shadow": (3, 3, 1), "snowice": (4, 4, 1), "cloud": (5, 5, 1)},
}
#: Class codes of the flags.
QUALITY_CODES = {"clear": 0, "water": 1, "shadow": 2, "snowice": 3, "cloud": 4, "cirrus": 5, "adjacent": 6, "saturated": 7, "dropped": 8, "terrain": 9, "fill": 255}


def bits(value: Column, first: int, last: int) -> Column:
    """The number in bits ``first`` to ``last``."""
    return F.shiftright(value, first).bitwiseAND((1 << (last - first + 1)) - 1)


def quality(value: Column, sensor: str, items: list[str]) -> Column:
    """Class codes of a quality band; of several flags the last of ``items`` wins, without any it is clear."""
    table = QUALITY_BITS[sensor]
    unknown = [i for i in items if i not in table or i not in QUALITY_CODES]
    if unknown:
        raise ValueError(f"{sensor} has no flag {', '.join(unknown)}")
    out = F.lit(QUALITY_CODES["clear"])
    for i in items:
        first, last, level = table[i]
        out = F.when(bits(value, first, last) >= level, QUALITY_CODES[i]).otherwise(out)
    return out


def modis_usable(value: Column, level: int) -> Column:
    """1 where bit 2 of the quality word, as a number, is ``level`` or less."""
    return (value.bitwiseAND(4) <= level).cast("int")
