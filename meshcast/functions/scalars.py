"""Column expressions: calendar, physics, codes, bands and the grid. Nulls stay null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MONTHS = ("Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio", "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre")
CLOUD_TYPE = {0: "Clear", 1: "Probably Clear", 2: "Fog", 3: "Water", 4: "Super-Cooled Water", 5: "Mixed", 6: "Opaque Ice", 7: "Cirrus", 8: "Overlapping", 9: "Overshooting", 10: "Unknown", 11: "Dust", 12: "Smoke", -15: "Sin dato"}
FILL_FLAG = {0: "", 1: "Missing Image", 2: "Low Irradiance", 3: "Exceeds Clearsky", 4: "Missing Cloud Properties", 5: "Rayleigh Violation"}
UNITS = {"ghi": "W/m²", "dni": "W/m²", "dhi": "W/m²", "clearsky_ghi": "W/m²", "clearsky_dni": "W/m²", "clearsky_dhi": "W/m²", "ghi_uv_280_400": "W/m²", "ghi_uv_295_385": "W/m²", "temperature": "°C", "dew_point": "°C", "pressure": "mbar", "relative_humidity": "%", "precipitable_water": "cm", "wind_speed": "m/s", "wind_direction": "°", "solar_zenith_angle": "°", "ozone": "atm-cm"}
KEY_COLUMNS = ("nodo_id", "datetime", "year", "month", "day", "hour")
FLAG_COLUMNS = ("cloud_type", "cloud_fill_flag", "fill_flag")
RANGES = {"ghi": (0, 1500), "dni": (0, 1200), "dhi": (0, 1200), "clearsky_ghi": (0, 1500), "clearsky_dni": (0, 1200), "clearsky_dhi": (0, 1200), "temperature": (-40, 60), "dew_point": (-50, 45), "relative_humidity": (0, 100), "pressure": (700, 1100), "precipitable_water": (0, 10), "wind_speed": (0, 80), "wind_direction": (0, 360), "solar_zenith_angle": (0, 180), "surface_albedo": (0, 1)}
PRESSURE_TOLERANCE = 60.0

AGGREGATES = {"mean": F.avg, "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)), "max": F.max, "min": F.min, "std": F.stddev_samp, "median": F.median, "count": F.count}


def aggregate(name: str, column) -> Column:
    if name not in AGGREGATES:
        raise ValueError(f"unknown aggregate {name!r}; one of {', '.join(AGGREGATES)}")
    return AGGREGATES[name](column)


def clearness(ghi="ghi", clearsky="clearsky_ghi") -> Column:
    """ghi / clearsky where clearsky > 0, else null."""
    return F.when(F.col(clearsky) > 0, F.col(ghi) / F.col(clearsky))


def timestamp_of(year="year", month="month", day="day", hour="hour") -> Column:
    return F.make_timestamp_ntz(year, month, day, hour, F.lit(0), F.lit(0))


def label_of(code, labels: dict) -> Column:
    """The label of a code; null for a code without one."""
    pairs = F.create_map(*(x for k, v in labels.items() for x in (F.lit(k), F.lit(v))))
    return pairs[F.col(code) if isinstance(code, str) else code]


def month_name(month) -> Column:
    return F.try_element_at(F.array(*map(F.lit, MONTHS)), F.col(month) if isinstance(month, str) else month)


def surface_pressure(elevation) -> Column:
    """Standard-atmosphere pressure (mbar) at an elevation in metres."""
    return F.lit(1013.25) * F.pow(1 - F.lit(2.25577e-5) * elevation, F.lit(5.25588))


def snapped(value: Column, offset: float, step: float) -> Column:
    """Nearest point of the grid offset + k * step; ties away from zero; 4 decimals."""
    k = (value - offset) / step
    return F.round(F.signum(k) * F.floor(F.abs(k) + 0.5) * step + offset, 4)


def hours_in_year(year: Column, leap_day: bool = True) -> Column:
    days = F.datediff(F.make_date(year + 1, F.lit(1), F.lit(1)), F.make_date(year, F.lit(1), F.lit(1)))
    return (days if leap_day else F.least(days, F.lit(365))) * 24


def sector(direction: Column, sectors: int = 16) -> Column:
    """Compass sector, 0 centred on north."""
    width = 360.0 / sectors
    return F.floor(F.pmod(direction + width / 2, F.lit(360.0)) / width).cast("int")


def banded(value: Column, edges) -> Column:
    """Number (from 0) of the right-closed bin (edges[i], edges[i+1]]; null outside."""
    out = None
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        inside = (value > a) & (value <= b)
        out = F.when(inside, F.lit(i)) if out is None else out.when(inside, F.lit(i))
    return out


def labelled_bands(value: Column, bands, otherwise: str) -> Column:
    """Label of the first (least, label) with value >= least; null stays null."""
    out = F.when(value.isNull(), F.lit(None))
    for least, label in bands:
        out = out.when(value >= least, F.lit(label))
    return out.otherwise(otherwise)


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * 6378137.0


def mercator_y(lat: Column) -> Column:
    return F.ln(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)) * 6378137.0


def wkt_point(lon: Column, lat: Column, decimals: int = 4) -> Column:
    return F.format_string(f"POINT(%.{decimals}f %.{decimals}f)", lon, lat)


def tidy_name(name: str, dashes: bool = False) -> str:
    name = name.strip().lower().replace(" ", "_")
    return name.replace("-", "_") if dashes else name


def decoded_number(raw) -> Column:
    """UTF-8 bytes as a number; null where they are none."""
    return F.expr(f"try_cast(trim(decode({raw}, 'UTF-8')) AS double)")


def decoded_text(raw) -> Column:
    return F.trim(F.decode(F.col(raw), "UTF-8"))


def analysable(df) -> list[str]:
    """The variables of a table: its numeric columns without keys and flags."""
    return [f.name for f in df.schema if f.name not in KEY_COLUMNS + FLAG_COLUMNS and f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double")]


def with_units(df):
    """Units as metadata of the columns that have one."""
    for c in df.columns:
        if c in UNITS:
            df = df.withMetadata(c, {"unit": UNITS[c]})
    return df
