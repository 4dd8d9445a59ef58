"""Projection to the equal-area plane and the fixed 10 km grid, as Catalyst expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecorisk.functions.categories import RULES, classify_sql, code_sql

# The WGS84 ellipsoid and the grid.
AXIS = 6378137.0
FLATTENING = 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
ECC = math.sqrt(E2)
CELL = 10_000.0
CELL_AREA = CELL * CELL
GRID_CRS = "ESRI:54034"


def _finite(lon: Column, lat: Column) -> Column:
    return (F.abs(lon) < float("inf")) & (F.abs(lat) < float("inf"))


def project_x(lon: Column, lat: Column) -> Column:
    """Easting in metres; NaN where a coordinate isn't finite. Longitudes aren't wrapped."""
    return F.when(_finite(lon, lat), F.lit(AXIS) * F.radians(lon)).otherwise(F.lit(float("nan")))


def project_y(lon: Column, lat: Column) -> Column:
    """Northing in metres; latitudes are clamped to the poles."""
    s = F.sin(F.radians(F.greatest(F.lit(-90.0), F.least(F.lit(90.0), lat))))
    q = F.lit(1 - E2) * (s / (1 - F.lit(E2) * s * s) - F.log((1 - F.lit(ECC) * s) / (1 + F.lit(ECC) * s)) / F.lit(2 * ECC))
    return F.when(_finite(lon, lat), F.lit(AXIS) * q / 2).otherwise(F.lit(float("nan")))


def cell_of(v: Column) -> Column:
    """Index of the half-open cell that holds a projected coordinate, saturated to 32 bits; NaN is cell 0."""
    at = F.floor(F.when(F.isnan(v), F.lit(0.0)).otherwise(v) / CELL)
    return F.greatest(F.lit(-(2**31)), F.least(F.lit(2**31 - 1), at)).cast("int")


def cover_cells(df: DataFrame, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
    """df once for each cell (col, row) that a bounding box touches; none for inverted or NaN boxes.

    Columns are dealt out first and rows then, so that a huge box is spread before it reaches its full size.
    """
    good = (F.col(x0) <= F.col(x1)) & (F.col(y0) <= F.col(y1)) & ~F.isnan(x0) & ~F.isnan(y0) & ~F.isnan(x1) & ~F.isnan(y1)
    wide = df.where(good).withColumn("col", F.explode(F.sequence(cell_of(F.col(x0)), cell_of(F.col(x1)))))
    return wide.withColumn("row", F.explode(F.sequence(cell_of(F.col(y0)), cell_of(F.col(y1)))))


def interval_overlap(a0: Column, a1: Column, index: Column) -> Column:
    """Length that [a0, a1] shares with the cell interval at `index`."""
    return F.greatest(F.lit(0.0), F.least(a1, (index + 1) * F.lit(CELL)) - F.greatest(a0, index * F.lit(CELL)))


def ring_area(ring: Column) -> Column:
    """Signed shoelace area of ARRAY<STRUCT<x, y>>; the closing vertex is optional, fewer than 3 points have none."""
    turned = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    terms = F.zip_with(ring, turned, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2)


def project_ring(ring: Column) -> Column:
    """A ring of STRUCT<x, y> in degrees, projected vertex by vertex."""
    return F.transform(ring, lambda p: F.struct(project_x(p["x"], p["y"]).alias("x"), project_y(p["x"], p["y"]).alias("y")))


def bounding_box(rings: Column) -> Column:
    """STRUCT<x0, y0, x1, y1> over the finite vertices of all rings; nulls without one."""
    points = F.filter(F.flatten(rings), lambda p: (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def register(spark) -> None:
    """SQL functions project_x, project_y, cell_of and category_of for use in SQL text; all are SQL bodies, none Python."""
    finite = "abs(lon) < double('Infinity') AND abs(lat) < double('Infinity')"
    sine = "sin(radians(greatest(-90D, least(90D, lat))))"
    q = f"{1 - E2!r}D * ({sine} / (1D - {E2!r}D * {sine} * {sine}) - ln((1D - {ECC!r}D * {sine}) / (1D + {ECC!r}D * {sine})) / {2 * ECC!r}D)"
    of = " ".join(f"WHEN criterion = '{c}' THEN {code_sql(classify_sql(c, 'v'))}" for c in RULES)
    bodies = {
        "project_x(lon DOUBLE, lat DOUBLE) RETURNS DOUBLE": f"CASE WHEN {finite} THEN {AXIS!r}D * radians(lon) ELSE double('NaN') END",
        "project_y(lon DOUBLE, lat DOUBLE) RETURNS DOUBLE": f"CASE WHEN {finite} THEN {AXIS!r}D * {q} / 2D ELSE double('NaN') END",
        "cell_of(v DOUBLE) RETURNS INT": f"CAST(greatest(-2147483648L, least(2147483647L, floor(CASE WHEN isnan(v) THEN 0D ELSE v END / {CELL!r}D))) AS INT)",
        "category_of(criterion STRING, v DOUBLE) RETURNS STRING": f"CASE {of} ELSE CAST(raise_error(concat('no threshold table for ', criterion)) AS STRING) END",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
