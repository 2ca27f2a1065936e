"""Region outlines: pixel sets to polygons with holes.

Sides between pixels of a region cancel in a distributed sum. What is left is cut into tiles, and
each tile links its sides to chains in an Arrow function. Chains that leave their tile are put in order by
pointer doubling over chain rows, so the number of rounds grows with the logarithm of the chains of a ring,
and neither the sides nor the chains of a region ever meet in one task. Areas, corners and boxes are
sums over chains. A hole finds its polygon by the next upright side to the right of its top. Only
the finished outline, corners alone, is one value per polygon.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landshift.functions import geometry
from landshift.schemas import RINGS
from landshift.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEY = ["aoi_id", "k", "region_no"]
SIDE = 512  # tiles whose sides are linked in one step
CHAIN = (
    "chain bigint, entry_row int, entry_col int, entry_dir int, saddle boolean, exit_row int, exit_col int, exit_dir int, closed boolean, "
    "points array<struct<y:int,x:int>>, doubled bigint, corners bigint, top struct<y:int,x:int>, "
    "uprights array<struct<col:int,low:int,high:int>>"
)


def outline_edges(region_pixels: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Directed boundary edges with the region on their right.

    Every pixel emits its four sides; a side shared by two pixels of the region is
    emitted once in each direction and cancels out.
    """
    r, c = F.col("row"), F.col("col")

    def edge(horizontal: bool, row, col, sign: int):
        return F.struct(
            F.lit(horizontal).alias("horizontal"), row.alias("row"), col.alias("col"), F.lit(sign).alias("sign")
        )

    sides = F.array(edge(True, r, c, 1), edge(True, r + 1, c, -1), edge(False, r, c, -1), edge(False, r, c + 1, 1))
    return (
        region_pixels.select(*keys, F.explode(sides).alias("e"))
        .groupBy(*keys, "e.horizontal", "e.row", "e.col")
        .agg(F.sum("e.sign").alias("sign"))
        .where("sign <> 0")
    )


def _chains(row: np.ndarray, col: np.ndarray, way: np.ndarray, home: np.ndarray) -> dict[str, np.ndarray]:
    """Sides of many tiles linked to chains.

    A side starts at (row, col) and goes one step ``way`` (0 right, 1 down, 2 left, 3 up); ``home`` is its tile,
    and equal for sides that may follow each other. Returns sides in the order of chains, with bounds of the chains.
    """
    n = len(row)
    end_row, end_col = row + (way == 1) - (way == 3), col + (way == 0) - (way == 2)
    low_row, low_col = row.min() - 1, col.min() - 1
    height, width = int(row.max() - low_row) + 2, int(col.max() - low_col) + 2
    spot = lambda r, c: (home * height + (r - low_row)) * width + (c - low_col)
    start, end = spot(row, col), spot(end_row, end_col)
    order = np.argsort(start, kind="stable")
    sorted_start = start[order]
    at = np.minimum(np.searchsorted(sorted_start, end), n - 1)
    met = sorted_start[at] == end
    first, second = order[at], order[np.minimum(at + 1, n - 1)]
    # Where two sides leave a corner, the right turn stays with the same pixel.
    right = (start[second] == end) & (way[second] == (way + 1) % 4)
    following = np.where(met, np.where(right, second, first), -1)
    two = np.zeros(n, dtype=bool)
    same = np.flatnonzero(sorted_start[1:] == sorted_start[:-1])
    two[order[same]] = two[order[same + 1]] = True
    leads = np.ones(n, dtype=bool)
    leads[following[following >= 0]] = False
    # Least side and distance to the end of each chain or ring, by pointer doubling.
    last = following < 0
    jump, least = np.where(last, np.arange(n), following), np.arange(n)
    reach = 1
    while reach < n:
        least = np.minimum(least, least[jump])
        jump, reach = jump[jump], 2 * reach
        if np.array_equal(least, least[jump]) and np.array_equal(jump, jump[jump]):
            break
    ring = ~last[jump]
    stop = np.where(ring, least, jump)  # a ring is cut in front of its least side
    ends = last | (ring & (following == least))
    steps, hop = np.where(ends, 0, 1), np.where(ends, np.arange(n), following)
    while not np.array_equal(hop, hop[hop]):
        steps = steps + steps[hop]
        hop = hop[hop]
    order = np.lexsort((-steps, np.where(ring, stop, hop), ring))
    opens = np.flatnonzero(np.concatenate([[True], np.diff(np.where(ring, n + stop, hop)[order]) != 0]))
    return {"order": order, "opens": opens, "ring": ring[order][opens], "two": two[order][opens], "end_row": end_row, "end_col": end_col}


def _chain_batches(keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            lists = batch.column("edges")
            edges = lists.flatten()
            field = lambda name: edges.field(name).to_numpy(zero_copy_only=False)
            home = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            row, col, way = (field(c).astype(np.int64) for c in ("row", "col", "way"))
            linked = _chains(row, col, way, home)
            order, opens, closed = linked["order"], linked["opens"], linked["ring"]
            y, x, d = row[order], col[order], way[order]
            end_y, end_x = linked["end_row"][order], linked["end_col"][order]
            n, closes = len(order), np.append(opens[1:], len(order)) - 1
            size = closes - opens + 1
            chain = np.repeat(np.arange(len(opens)), size)
            before = np.arange(n) - 1
            before[opens] = closes  # of rings; where an open chain begins is told later
            turn = d[before] != d
            turn[opens[~closed]] = True
            doubled = np.add.reduceat(x * end_y - end_x * y, opens)
            position = np.lexsort((x, y, chain))[opens]
            top_y, top_x = y[position], x[position]
            kept = np.flatnonzero(turn)
            per = np.bincount(chain[kept], minlength=len(opens))
            # Upright runs: sides that go on in the same direction.
            upright = d % 2 == 1
            begins = upright & (turn | (np.arange(n) == opens[chain]))
            fresh, run_id = np.flatnonzero(begins), np.cumsum(begins) - 1
            rows_of = np.where(d == 1, y, end_y)
            low = np.full(len(fresh), np.iinfo(np.int64).max)
            high = np.full(len(fresh), -1)
            np.minimum.at(low, run_id[upright], rows_of[upright])
            np.maximum.at(high, run_id[upright], rows_of[upright] + 1)
            uprights = np.bincount(chain[fresh], minlength=len(opens))
            struct = lambda **columns: pa.StructArray.from_arrays([pa.array(v.astype(np.int32)) for v in columns.values()], names=list(columns))
            nested = lambda counts, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), type=pa.int32()), values)
            i32 = lambda v: pa.array(v.astype(np.int32))
            columns = {
                **{k: batch.column(k).take(pa.array(home[order][opens])) for k in keys},
                "chain": pa.array((y[opens] << 33) + (x[opens] << 2) + d[opens]),
                "entry_row": i32(y[opens]), "entry_col": i32(x[opens]), "entry_dir": i32(d[opens]), "saddle": pa.array(linked["two"]),
                "exit_row": i32(end_y[closes]), "exit_col": i32(end_x[closes]), "exit_dir": i32(d[closes]), "closed": pa.array(closed),
                "points": nested(per, struct(y=y[kept], x=x[kept])), "doubled": pa.array(doubled),
                "corners": pa.array(per - ~closed), "top": struct(y=top_y, x=top_x),
                "uprights": nested(uprights, struct(col=x[fresh], low=low, high=high)),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def chains(pixels: DataFrame, keys: list[str] = KEY, side: int = SIDE) -> DataFrame:
    """The outline of each pixel set, cut into the chains of its tiles."""
    edge = outline_edges(pixels, keys)
    across, ahead = F.col("horizontal"), F.col("sign") > 0
    way = F.when(across, F.when(ahead, 0).otherwise(2)).otherwise(F.when(ahead, 1).otherwise(3))
    sided = edge.select(
        *keys, (F.col("row") + F.when(~across & ~ahead, 1).otherwise(0)).alias("row"),
        (F.col("col") + F.when(across & ~ahead, 1).otherwise(0)).alias("col"), way.alias("way"),
    )
    tiled = sided.groupBy(*keys, F.floor(F.col("row") / side).alias("_tr"), F.floor(F.col("col") / side).alias("_tc")).agg(
        F.collect_list(F.struct("row", "col", "way")).alias("edges")
    )
    kinds = ", ".join(f"{k} {pixels.schema[k].dataType.simpleString()}" for k in keys)
    return tiled.select(*keys, "edges").mapInArrow(_chain_batches(keys), f"{kinds}, {CHAIN}")


def _doubled(ranked: DataFrame, keys: list[str], steps: int) -> DataFrame:
    """One doubling: each chain looks as far again along its ring."""
    ahead = ranked.select(*keys, F.col("chain").alias("jump"), F.col("jump").alias("_jump"), F.col("low").alias("_low"), F.col("at").alias("_at"))
    lower = F.col("_low") < F.col("low")
    return ranked.join(ahead, [*keys, "jump"]).select(
        *keys, "chain", F.col("_jump").alias("jump"), F.least("low", "_low").alias("low"),
        F.when(lower, F.col("_at") + steps).otherwise(F.col("at")).alias("at"), "turns", (F.col("changed") | lower).alias("changed"),
    )


def ring_order(linked: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """The ring (its least chain) of every open chain and the steps from there to that chain.

    ``linked`` has for each chain the next one (``jump``). A round doubles the look-ahead twice.
    """
    ranked = materialize(
        linked.select(*keys, "chain", "jump", F.col("chain").alias("low"), F.lit(0).cast("bigint").alias("at"), "turns", F.lit(True).alias("changed")), "ring-ends"
    )
    steps = 1
    while not ranked.where("changed").isEmpty():
        fresh = ranked.withColumn("changed", F.lit(False))
        ranked = materialize(_doubled(_doubled(fresh, keys, steps), keys, 2 * steps), "ring-order")
        steps *= 4
    return ranked.select(*keys, "chain", F.col("low").alias("ring"), "at", "turns")


def rings(pixels: DataFrame, keys: list[str] = KEY, side: int = SIDE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chains with their ring and place, rings with area, corners and top, rings with their points).

    A closed chain is a ring as it stands; only chains that leave their tile are put together.
    """
    found = materialize(chains(pixels, keys, side), "chains")
    closed = found.where("closed")
    stored = closed.select(*keys, F.col("chain").alias("ring"), "uprights")
    figures = closed.select(*keys, F.col("chain").alias("ring"), "doubled", "corners", "top")
    points = closed.select(*keys, F.col("chain").alias("ring"), F.col("points").alias("p"))
    loose = found.where("not closed")
    if loose.isEmpty():
        return stored, figures, points
    ends = loose.select(*keys, "chain", F.col("exit_row").alias("entry_row"), F.col("exit_col").alias("entry_col"), "exit_dir")
    starts = loose.select(*keys, F.col("chain").alias("jump"), "entry_row", "entry_col", "entry_dir", "saddle")
    fits = ~F.col("saddle") | (F.col("entry_dir") == (F.col("exit_dir") + 1) % 4)
    linked = ends.join(starts, [*keys, "entry_row", "entry_col"]).where(fits)
    # Whether the ring turns where it enters the next chain.
    entered = linked.select(*keys, F.col("jump").alias("chain"), (F.col("entry_dir") != F.col("exit_dir")).alias("turns"))
    order = ring_order(linked.select(*keys, "chain", "jump").join(entered, [*keys, "chain"]), keys)
    joined = materialize(loose.join(order, [*keys, "chain"]), "ring-chains")
    made = joined.groupBy(*keys, "ring").agg(
        F.sum("doubled").alias("doubled"), F.sum(F.col("corners") + F.when(F.col("turns"), 1).otherwise(0)).alias("corners"), F.min("top").alias("top")
    )
    # Chains begin with their entry, which is a corner only where the ring turns there.
    own = F.when(F.col("turns"), F.col("points")).otherwise(F.slice("points", 2, F.size("points")))
    in_order = F.array_sort(F.collect_list(F.struct((F.col("at") > 0).alias("later"), (-F.col("at")).alias("place"), own.alias("own"))))
    put = joined.groupBy(*keys, "ring").agg(F.flatten(F.transform(in_order, lambda c: c["own"])).alias("p"))
    return stored.unionByName(joined.select(*stored.columns)), figures.unionByName(made), points.unionByName(put)


def hole_owners(stored: DataFrame, figures: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """The outer ring around each hole: (keys, ring, owner).

    From the pixel above the top of a hole the next upright side to the right bounds the same polygon. It is
    part of the outer ring or of a hole further right, whose owner is then the same.
    """
    holes = figures.where("doubled < 0")
    asked = holes.select(*keys, F.col("ring").alias("hole"), (F.col("top.y") - 1).alias("row"), (F.col("top.x") + 1).alias("col"))
    upright = stored.join(holes.select(*keys).distinct(), keys, "left_semi").select(*keys, "ring", F.inline("uprights")).select(
        *keys, "ring", "col", F.explode(F.sequence(F.col("low"), F.col("high") - 1)).alias("row")
    )
    met = upright.join(asked.select(*keys, "row").distinct(), [*keys, "row"], "left_semi").select(
        *keys, "row", "col", F.lit(None).cast("bigint").alias("hole"), "ring"
    )
    lines = met.unionByName(asked.withColumn("ring", F.lit(None).cast("bigint")).select(*met.columns))
    line = Window.partitionBy(*keys, "row").orderBy("col", F.col("hole").asc_nulls_last()).rowsBetween(1, Window.unboundedFollowing)
    owners = lines.withColumn("owner", F.first("ring", ignorenulls=True).over(line)).where("hole is not null").select(
        *keys, F.col("hole").alias("ring"), "owner"
    )
    owners = materialize(owners, "hole-owners")
    while True:
        ahead = owners.select(*keys, F.col("ring").alias("owner"), F.col("owner").alias("_next"))
        if owners.join(ahead, [*keys, "owner"], "left_semi").isEmpty():
            return owners
        owners = materialize(
            owners.join(ahead, [*keys, "owner"], "left").select(*keys, "ring", F.coalesce("_next", "owner").alias("owner")), "hole-owners"
        )


def polygonize(pixels: DataFrame, keys: list[str] = KEY, side: int = SIDE) -> DataFrame:
    """Polygons in pixel-corner coordinates (x = column, y = row): keys, top_row, top_col, rings.

    ``pixels`` are distinct (keys, row, col). Pixels that touch only at a corner give separate polygons of one
    region, each named by the top left corner of its outer ring. Rings begin at their top left corner; holes follow in
    raster order of theirs. Sizes and tiles change nothing.
    """
    stored, figures, points = rings(pixels, keys, side)
    first = F.array_position("p", F.array_min("p")).cast("int")
    turned = F.concat(F.slice("p", first, F.size("p")), F.slice("p", F.lit(1), first))
    shown = F.transform(turned, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    outlined = points.select(*keys, "ring", F.array_min("p").alias("top"), shown.alias("outline"))
    named = lambda top: [top["y"].alias("top_row"), top["x"].alias("top_col")]
    if figures.where("doubled < 0").isEmpty():
        return outlined.select(*keys, *named(F.col("top")), F.array("outline").alias("rings"))
    owners = hole_owners(stored, figures, keys)
    part = F.struct(F.col("owner").isNotNull().alias("hole"), "top", "outline")
    owned = outlined.join(owners, [*keys, "ring"], "left").withColumn("part", part).groupBy(*keys, F.coalesce("owner", "ring").alias("owner"))
    whole = owned.agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return whole.select(*keys, *named(F.col("parts")[0]["top"]), F.transform("parts", lambda q: q["outline"]).alias("rings"))


def track_outlines(track_pixels: DataFrame, grids: DataFrame, keys: list[str], side: int = SIDE) -> DataFrame:
    """The dissolved regions of each track as polygons in longitude and latitude: keys, geometry.

    ``track_pixels`` are the distinct pixels of the regions, ``grids`` has one header per AOI. Outer rings run
    counter-clockwise on the map.
    """
    found = polygonize(track_pixels, keys, side).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("top_row", "top_col", "rings"))).alias("p"))
    t = F.col("grid.transform")
    place = lambda p: geometry.from_utm(t[2] + p["x"] * t[0] + p["y"] * t[1], t[5] + p["x"] * t[3] + p["y"] * t[4], F.col("grid.crs"))
    outline = F.transform("p", lambda q: F.transform(q["rings"], lambda r: F.reverse(F.transform(r, place))))
    return found.join(grids.select("aoi_id", "grid"), "aoi_id").select(*keys, outline.alias("geometry"))


def georeference(polygons: DataFrame, grids: DataFrame) -> DataFrame:
    """Pixel corners to map coordinates and to longitude/latitude.

    ``grids`` has one header per AOI.
    """
    t = F.col("grid.transform")
    to_map = lambda p: F.struct(
        (t[2] + p["x"] * t[0] + p["y"] * t[1]).alias("x"), (t[5] + p["x"] * t[3] + p["y"] * t[4]).alias("y")
    )
    mapped = polygons.join(grids, "aoi_id").withColumn(
        "map_rings", F.transform("rings", lambda r: F.transform(r, to_map))
    )
    return mapped.withColumn(
        "lonlat_rings", geometry.unproject_rings(F.col("map_rings"), F.col("grid.crs"))
    ).withColumn("geojson", geometry.geojson(F.col("lonlat_rings")))
