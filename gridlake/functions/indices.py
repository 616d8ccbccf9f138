"""Spectral indices as Column expressions: bands in, one double out, no shuffle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions.numeric import clamp, filled, ratio, stretch


@dataclass(frozen=True)
class Index:
    bands: tuple[str, ...]
    formula: Callable[..., Column]
    low: float | None = None
    high: float | None = None
    scaled: bool = True  # whether bands are divided by the scale factor first


def _difference(b: Column, a: Column) -> Column:
    return ratio(a - b, a + b)


def _soil(red: Column, nir: Column, L: float) -> Column:
    return ratio(nir - red, nir + red + L) * (1 + L)


def _evi2(red, nir, c1=2.4, g=2.5, L=1.0):
    return ratio(nir - red, nir + L + c1 * red) * g


def _root(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def _wet(red, midir):
    s = red + midir
    return F.when(s > 0.5, F.lit(0.0)).otherwise(1 - s / 0.5)


def _twvi(red, nir, midir):
    grass = stretch(clamp(_evi2(red, nir), 0.0, 1.0), (-1, 1), (0, 1))
    snow = stretch(clamp(_difference(nir, midir), -1.0, 1.0), (-1, 1), (0, 1))
    return ratio(snow - grass, snow + grass)


def _msavi(red, nir):
    a = 2 * nir + 1
    return (a - _root(a * a - 8 * (nir - red))) / 2


#: Name -> bands in order, equation and range. ``L``, ``g``, ``c1`` and so on can be given as keywords.
INDICES: dict[str, Index] = {
    "ARVI": Index(("blue", "red", "nir"), lambda blue, red, nir, y=1.0: ratio(nir - (red - y * (blue - red)), nir + (red - y * (blue - red)))),
    "BRIGHT": Index(("green", "red", "nir", "midir"), lambda *b: F.sqrt(sum((x * x for x in b[1:]), b[0] * b[0])), 0.0, 1.0),
    "CBI": Index(("cblue", "blue"), _difference, -1.0, 1.0),
    "CIRE": Index(("rededge", "rededge3"), lambda a, b: ratio(b, a) - 1, -1.0, 1.0),
    "EVI": Index(("blue", "red", "nir"), lambda blue, red, nir, g=2.5, c1=6.0, c2=7.5, L=1.0: ratio(nir - red, nir + c1 * red - c2 * blue + L) * g, 0.0, 1.0),
    "EVI2": Index(("red", "nir"), _evi2, 0.0, 1.0),
    "IPVI": Index(("red", "nir"), lambda red, nir: ratio(nir, nir + red)),
    "GNDVI": Index(("green", "nir"), _difference, -1.0, 1.0),
    "MNDWI": Index(("midir", "green"), _difference, -1.0, 1.0),
    "MSAVI": Index(("red", "nir"), _msavi, scaled=False),
    "NDSI": Index(("nir", "midir"), _difference, -1.0, 1.0),
    "NDBAI": Index(("midir", "farir"), _difference, -1.0, 1.0),
    "NBRI": Index(("farir", "nir"), _difference, -1.0, 1.0),
    "NDII": Index(("ndvi", "midir", "farir"), lambda ndvi, midir, farir: ratio(farir - midir + ndvi, farir + midir + ndvi), -1.0, 1.0, False),
    "NDVI": Index(("red", "nir"), _difference, -1.0, 1.0),
    "RENDVI": Index(("rededge", "nir"), _difference, -1.0, 1.0),
    "ONDVI": Index(("red", "nir"), lambda red, nir: F.atan(_difference(red, nir)) * F.lit(4.0) / F.pi()),
    "NDWI": Index(("nir", "green"), _difference, -1.0, 1.0),
    "PNDVI": Index(("green", "red"), _difference, -1.0, 1.0),
    "RBVI": Index(("blue", "red"), _difference, -1.0, 1.0),
    "GBVI": Index(("blue", "green"), _difference, -1.0, 1.0),
    "SATVI": Index(("red", "midir", "farir"), lambda red, midir, farir, L=1.0: _soil(red, midir, L) - farir / 2),
    "SAVI": Index(("red", "nir"), lambda red, nir, L=1.0: _soil(red, nir, L)),
    "OSAVI": Index(("red", "nir"), lambda red, nir, L=1.0: F.atan(_soil(red, nir, L) / 1.5) * 2),
    "SVI": Index(("red", "nir"), lambda red, nir: ratio(nir, red)),
    "TNDVI": Index(("red", "nir"), lambda red, nir: _root(_difference(red, nir) * 0.5)),
    "TVI": Index(("green", "nir"), lambda green, nir: _root(_difference(green, nir) + 0.5)),
    "TWVI": Index(("red", "nir", "midir"), _twvi, -1.0, 1.0),
    "YNDVI": Index(("yellow", "nir"), _difference, -1.0, 1.0),
    "VCI": Index(("red", "nir"), lambda red, nir, low=-1.0, high=1.0: (_difference(red, nir) - low) / (high - low), scaled=False),
    "VISMU": Index(("blue", "green", "red"), lambda blue, green, red: (blue + green + red) / 3, 0.0, 1.0),
    "WI": Index(("red", "midir"), _wet, 0.0, 1.0),
}

#: Band names of each sensor in order, band 1 first.
SENSORS: dict[str, tuple[str, ...]] = {
    "Landsat": ("blue", "green", "red", "nir", "midir", "farir"),
    "Landsat-thermal": ("blue", "green", "red", "nir", "midir", "farir", "thermal"),
    "Landsat8": ("cblue", "blue", "green", "red", "nir", "midir", "farir"),
    "Sentinel2-10m": ("blue", "green", "red", "nir"),
    "Sentinel2": ("blue", "green", "red", "rededge", "rededge2", "rededge3", "nir", "rededge4", "midir", "farir"),
    "MODIS": ("red", "nir", "blue", "green", "bandFive", "midir", "farir"),
    "RapidEye": ("blue", "green", "red", "rededge", "nir"),
    "WorldView2": ("cblue", "blue", "green", "yellow", "red", "rededge", "nir", "midir"),
    "ASTER": ("green", "red", "nir"),
    "Quickbird": ("blue", "green", "red", "nir"),
    "RGB": ("red", "green", "blue"),
}


def band_numbers(index: str, sensor: str) -> list[int]:
    """1-based bands of a sensor that an index reads. KeyError for an unknown name, ValueError for a missing band."""
    have = SENSORS[sensor]
    need = INDICES[index.upper()].bands
    missing = [b for b in need if b not in have]
    if missing:
        raise ValueError(f"{sensor} has no band {', '.join(missing)} for {index}")
    return [have.index(b) + 1 for b in need]


def supported(sensor: str) -> list[str]:
    """Names of the indices that a sensor's bands allow."""
    have = set(SENSORS[sensor])
    return sorted(n for n, i in INDICES.items() if have.issuperset(i.bands))


def index(name: str, *bands: Column, scale: float = 1.0, in_no_data: float | None = 0.0, no_data: float = 0.0, mask: Column | None = None, rescale: tuple[float, float] | None = None, **constants) -> Column:
    """One index of ``bands``, given in the order of ``INDICES[name].bands``.

    Bands are divided by ``scale``, the result is clipped, and ``no_data`` stands where it is null, NaN or infinite,
    where any band equals ``in_no_data`` and where ``mask`` is true. ``rescale``: target range, truncated to whole
    numbers, from the clip range (or -1 to 1)."""
    spec = INDICES[name.upper()]
    if len(bands) != len(spec.bands):
        raise ValueError(f"{name} takes {', '.join(spec.bands)}")
    ready = [b.cast("double") / scale if spec.scaled and scale != 1 else b.cast("double") for b in bands]
    value = clamp(spec.formula(*ready, **constants), spec.low, spec.high)
    if rescale is not None:
        value = F.floor(stretch(value, (-1.0 if spec.low is None else spec.low, 1.0 if spec.high is None else spec.high), rescale)).cast("double")
    value = filled(value, no_data)
    if in_no_data is not None:
        bad = bands[0] == in_no_data
        for b in bands[1:]:
            bad = bad | (b == in_no_data)
        value = F.when(bad, F.lit(float(no_data))).otherwise(value)
    return value if mask is None else F.when(mask, F.lit(float(no_data))).otherwise(value)


def with_indices(df: DataFrame, names: list[str] | str, sensor: str | None = None, columns: dict[str, str] | None = None, **how) -> DataFrame:
    """``df`` with a column for each index, in one projection. ``names``: a list, or 'all' that the bands allow.

    ``columns``: band name -> column of ``df``; by default the names themselves."""
    columns = columns or {b: b for b in (SENSORS[sensor] if sensor else df.columns) if b in df.columns}
    if names == "all":
        names = sorted(n for n, i in INDICES.items() if set(columns).issuperset(i.bands))
    made = {n.lower(): index(n, *(F.col(columns[b]) for b in INDICES[n.upper()].bands), **how) for n in names}
    return df.withColumns(made)


def condition_index(df: DataFrame, red: str, nir: str, out: str = "vci", **how) -> DataFrame:
    """Vegetation condition: NDVI between its own least and largest value over all rows, each floored at 0.

    The two limits come from one aggregate with partial sums on every task."""
    ndvi = index("NDVI", F.col(red), F.col(nir), **how)
    low, high = df.agg(F.min(ndvi), F.max(ndvi)).first()
    low, high = max(0.0, low or 0.0), max(0.0, high or 0.0)
    value = index("VCI", F.col(red), F.col(nir), low=low, high=high, **how) if high > low else F.lit(0.0)
    return df.withColumn(out, value)
