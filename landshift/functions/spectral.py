"""Band arithmetic, scene classes and display bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from landshift.config import CLOUD_CLASSES, SHADOW_CLASSES, VALID_CLASSES

# Compact class codes used inside detection.
INVALID, VALID, CLOUD, SHADOW = 0, 1, 2, 3


def scl_class(scl: Column) -> Column:
    """Scene-classification code as ``valid``, ``cloud``, ``shadow`` or ``invalid``."""
    return (
        F.when(scl.isin(*VALID_CLASSES), "valid")
        .when(scl.isin(*CLOUD_CLASSES), "cloud")
        .when(scl.isin(*SHADOW_CLASSES), "shadow")
        .otherwise("invalid")
    )


def scl_code(scl: Column) -> Column:
    """The same classes as one byte, for shuffles."""
    return (
        F.when(scl.isin(*VALID_CLASSES), VALID)
        .when(scl.isin(*CLOUD_CLASSES), CLOUD)
        .when(scl.isin(*SHADOW_CLASSES), SHADOW)
        .otherwise(INVALID)
        .cast("tinyint")
    )


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def bands_valid(red: Column, nir: Column) -> Column:
    """Both bands present and finite, and their sum not zero."""
    return F.coalesce(finite(red) & finite(nir) & ((red + nir) != 0), F.lit(False))


def ndvi(red: Column, nir: Column) -> Column:
    """Normalised difference in single precision; NULL where it is undefined."""
    red, nir = red.cast("float"), nir.cast("float")
    quotient = F.try_divide(nir - red, nir + red).cast("float")
    return F.when(bands_valid(red, nir) & finite(quotient), quotient)


def abs_delta(before: Column, after: Column, valid: Column) -> Column:
    """Absolute difference; 0 where the comparison is not valid."""
    return F.when(valid, F.abs(after - before)).otherwise(F.lit(0.0).cast("float"))


def comparison_flags(before_code: Column, after_code: Column) -> dict[str, Column]:
    """Validity of a pixel pair. Cloud on either date outranks shadow."""
    cloud = (before_code == CLOUD) | (after_code == CLOUD)
    shadow = ((before_code == SHADOW) | (after_code == SHADOW)) & ~cloud
    valid = (before_code == VALID) & (after_code == VALID)
    return {"valid": valid, "cloud": cloud, "shadow": shadow}


def percentage6(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(part, whole) * 100.0, F.lit(0.0)), 6)


def interpolate(lower: Column, upper: Column, part: Column) -> Column:
    """Value ``part`` of the way between two 16-bit values, with one rounding for ``lower * (1 - part) + ...``.

    The products with the high and the low half of the weight are exact; what their sum loses is added last.
    """
    weight, above = 1.0 - part, upper * part
    half = F.round(weight * float(1 << 26)) / float(1 << 26)
    first, rest = lower * half, lower * (weight - half)
    total = first + above
    back = total - first
    lost = (first - (total - back)) + (above - back)
    return total + (lost + rest)


def stretch_byte(value: Column, low: Column, high: Column, inside: Column) -> Column:
    """Linear stretch to 0..255, truncated; 0 outside the AOI or without data."""
    scaled = (value.cast("double") - low) / (high - low) * 255.0
    byte = F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), scaled)))
    return F.when(inside & value.isNotNull(), byte).otherwise(0).cast("int")


def alpha_byte(inside: Column, *bands: Column) -> Column:
    """Opaque inside the AOI where every display band has a value, clouds included."""
    visible = inside
    for band in bands:
        visible = visible & band.isNotNull()
    return F.when(visible, 255).otherwise(0).cast("int")


def ndvi_gray(value: Column) -> Column:
    """NDVI as a grey byte; 235 marks pixels without a value."""
    clipped = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), value.cast("double")))
    return F.coalesce(F.floor((clipped + 1.0) * 127.5), F.lit(235)).cast("int")
