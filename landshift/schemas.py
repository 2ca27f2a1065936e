"""Table schemas. Readers take these; none of them is inferred."""

from __future__ import annotations

POINT = "struct<x:double,y:double>"
RINGS = f"array<array<{POINT}>>"

GRID = (
    "struct<crs:string,transform:array<double>,width:int,height:int,"
    "resolution:array<double>,bounds:array<double>,count:int,dtype:string,nodata:double>"
)

PIXELS = (
    "aoi_id bigint, acq_id bigint, row int, col int, red float, nir float, scl int, "
    "green float, blue float"
)

AOI = f"aoi_id bigint, rings {RINGS}, created_at timestamp"

ACQUISITIONS = (
    "aoi_id bigint, acq_id bigint, item_id string, collection string, ts timestamp, "
    f"grid {GRID}, state string, reason string, total_pixels bigint, invalid_pixels bigint, "
    "cloud_pixels bigint, shadow_pixels bigint, usable_pixels bigint, "
    "invalid_percentage double, cloud_percentage double, shadow_percentage double, "
    "usable_percentage double, processing_version string, masking_method string"
)

# A saved page of catalog search results: one GeoJSON feature collection per line.
CATALOG_PAGE = (
    "features array<struct<id:string,collection:string,geometry:string,"
    "properties:map<string,string>,"
    "assets:map<string,struct<href:string>>>>"
)

AOI_GEOJSON = "struct<type:string,coordinates:array<array<array<double>>>>"

# Coordinates of the two area types; a polygon is an array of rings of positions.
POLYGON_COORDINATES = "coordinates array<array<array<double>>>"
MULTIPOLYGON_COORDINATES = "coordinates array<array<array<array<double>>>>"
