"""Small in-memory tables for unit tests."""

from __future__ import annotations

import numpy as np

from landshift import schemas

GRID = {
    "crs": "EPSG:32632", "transform": [10.0, 0.0, 600000.0, 0.0, -10.0, 5000000.0], "width": 4, "height": 4,
    "resolution": [10.0, 10.0], "bounds": [600000.0, 4999960.0, 600040.0, 5000000.0], "count": 2,
    "dtype": "float32", "nodata": 0.0,
}


def grid(width: int, height: int, **changes) -> dict:
    left, top = 600000.0, 5000000.0
    return {
        **GRID, "width": width, "height": height,
        "bounds": [left, top - 10 * height, left + 10 * width, top], **changes,
    }


def pixel_rows(acq: int, red, nir, scl, aoi: int = 1) -> list[tuple]:
    """Band arrays to pixel rows; a 0 in a band is nodata, as in the band files."""
    red, nir, scl = np.asarray(red), np.asarray(nir), np.asarray(scl)
    rows = []
    for r in range(red.shape[0]):
        for c in range(red.shape[1]):
            bands = [float(b[r, c]) if b[r, c] else None for b in (red, nir)]
            rows.append((aoi, acq, r, c, bands[0], bands[1], int(scl[r, c]), None, None))
    return rows


def pixel_table(spark, *scenes: list[tuple]):
    return spark.createDataFrame([row for scene in scenes for row in scene], schemas.PIXELS)


def scene_table(spark, acqs: list[int], width: int, height: int, aoi: int = 1):
    from datetime import datetime

    rows = [
        (aoi, a, f"scene-{aoi}-{a}", "sentinel-2-l2a", datetime(2024, 1 + a % 12, 1), grid(width, height))
        for a in acqs
    ]
    return spark.createDataFrame(
        rows, f"aoi_id bigint, acq_id bigint, item_id string, collection string, ts timestamp, grid {schemas.GRID}"
    )


def flood_fill(mask: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
    """Reference labelling: every changed pixel with the first pixel of its component."""
    labels: dict[tuple[int, int], tuple[int, int]] = {}
    for start in zip(*np.nonzero(mask)):
        start = (int(start[0]), int(start[1]))
        if start in labels:
            continue
        todo = [start]
        labels[start] = start
        while todo:
            r, c = todo.pop()
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    at = (r + dr, c + dc)
                    inside = 0 <= at[0] < mask.shape[0] and 0 <= at[1] < mask.shape[1]
                    if inside and mask[at] and at not in labels:
                        labels[at] = start
                        todo.append(at)
    return labels


def broadcast_rows(frame) -> tuple[list, list[int]]:
    """The rows of a result, and how many rows each of its broadcasts held."""
    rows, sent, todo = frame.collect(), [], [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(node.plan())
        if name == "BroadcastExchange":
            sent.append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows, sent
