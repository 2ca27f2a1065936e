"""Equal-area sizes of grid cells on arrays, for use inside tasks.

A tile's corners are projected once, as a lattice; cells take their size from their four corners. The formulas
are those of ``geometry.pixel_area_m2``.
"""

from __future__ import annotations

import math
import sys

import numpy as np
from pyspark import cloudpickle

from landshift.functions import geometry as g

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PARALLEL = math.radians(g.EQUAL_AREA_PARALLEL)
_K0 = math.cos(_PARALLEL) / math.sqrt(1 - g.ECC2 * math.sin(_PARALLEL) ** 2)
CONSTANTS = {
    "scale": g.UTM_SCALE * g.RECTIFYING, "easting": g.UTM_EASTING, "south": g.UTM_SOUTH, "beta": g.BETA, "delta": g.DELTA,
    "ecc": g.ECC, "ecc2": g.ECC2, "across": g.SEMI_MAJOR * _K0, "along": g.SEMI_MAJOR / (2 * _K0) * (1 - g.ECC2),
}


def flat_places(crs: str, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTM metres to the global equal-area cylindrical grid."""
    c = CONSTANTS
    xi0 = (y - (c["south"] if crs.startswith("EPSG:327") else 0.0)) / c["scale"]
    eta0 = (x - c["easting"]) / c["scale"]
    xi, eta = xi0.copy(), eta0.copy()
    for j, b in enumerate(c["beta"], start=1):
        xi -= b * np.sin(2 * j * xi0) * np.cosh(2 * j * eta0)
        eta -= b * np.cos(2 * j * xi0) * np.sinh(2 * j * eta0)
    chi = np.arcsin(np.sin(xi) / np.cosh(eta))
    phi = chi.copy()
    for j, d in enumerate(c["delta"], start=1):
        phi += d * np.sin(2 * j * chi)
    lam = math.radians(int(crs[-2:]) * 6.0 - 183.0) + np.arctan2(np.sinh(eta), np.cos(xi))
    s = np.sin(phi)
    return lam * c["across"], c["along"] * (s / (1 - c["ecc2"] * s * s) + np.arctanh(c["ecc"] * s) / c["ecc"])


def cell_areas(crs: str, transform: list[float], top: int, left: int, height: int, width: int) -> np.ndarray:
    """Square metres of the cells of a window of the grid, row by row."""
    col, row = np.meshgrid(np.arange(left, left + width + 1), np.arange(top, top + height + 1))
    x, y = flat_places(crs, transform[2] + col * transform[0], transform[5] + row * transform[4])
    ax, ay = x[1:, 1:] - x[:-1, :-1], y[1:, 1:] - y[:-1, :-1]
    bx, by = x[1:, :-1] - x[:-1, 1:], y[1:, :-1] - y[:-1, 1:]
    return np.abs(ax * by - ay * bx) / 2.0
