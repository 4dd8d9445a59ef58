"""From features to occupancy (cells), extent (hulls) and their metrics per ecosystem.

Features are rows (ecosystem STRING, geometry BINARY): WKB polygons in degrees. Null geometries are left out, a null
ecosystem is the empty string.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ecorisk.functions import geometry
from ecorisk.functions.spatial import CELL, CELL_AREA, GRID_CRS, cover_cells, interval_overlap, ring_area
from ecorisk.storage import materialize

CUTOFF, MARGIN = 0.01, 1e-9


def features(spark: SparkSession, polygons) -> DataFrame:
    """In-memory (ecosystem, rings) pairs, or a mapping of ecosystem to list of ring lists, as features, validated."""
    pairs = [(k, r) for k, rs in polygons.items() for r in rs] if isinstance(polygons, dict) else list(polygons)
    for eco, rings in pairs:
        if not rings or not len(rings[0]):
            raise ValueError(f"{eco}: a polygon needs an exterior ring")
        for lon, lat in (p for ring in rings for p in ring):
            _check(eco, lon, lat)
    return spark.createDataFrame([(eco or "", geometry.write_wkb([rings])) for eco, rings in pairs], "ecosystem string, geometry binary")


def _check(eco, lon: float, lat: float) -> None:
    if not (np.isfinite(lon) and np.isfinite(lat)):
        raise ValueError(f"{eco}: coordinates must be finite, not ({lon}, {lat})")
    if abs(lat) > 90 or abs(lon) > 180:
        raise ValueError(f"{eco}: ({lon}, {lat}) is no longitude and latitude in degrees")


def _present(df: DataFrame) -> DataFrame:
    return df.where(F.col("geometry").isNotNull()).select(F.coalesce("ecosystem", F.lit("")).alias("ecosystem"), "geometry")


class _Batch:
    """The polygons of an Arrow batch as arrays: points belong to rings, rings to polygons, polygons to ecosystems."""

    def __init__(self, batch, validate: bool):
        self.ecosystems: list[str] = []
        index: dict[str, int] = {}
        rings, polygon, outer, group = [], [], [], []
        for eco, data in zip(batch.column("ecosystem").to_pylist(), batch.column("geometry").to_pylist(), strict=True):
            for own in geometry.read_wkb(data):
                if validate and own and not len(own[0]):
                    raise ValueError(f"{eco}: a polygon needs an exterior ring")
                if own:
                    polygon += [len(group)] * len(own)
                    outer += [True] + [False] * (len(own) - 1)
                    group.append(index.setdefault(eco, len(index)))
                    rings += own
        self.ecosystems = list(index)
        self.polygon, self.outer, self.group = np.array(polygon, np.int64), np.array(outer, bool), np.array(group, np.int64)
        points = np.concatenate([np.empty((0, 2)), *rings])
        self.ring = np.repeat(np.arange(len(rings)), [len(r) for r in rings])
        if validate:
            bad = np.flatnonzero(~np.isfinite(points).all(axis=1) | (np.abs(points) > (180, 90)).any(axis=1))
            if len(bad):
                _check(self.ecosystems[self.group[self.polygon[self.ring[bad[0]]]]], *points[bad[0]])
        self.points = geometry.project(points)

    def cells(self) -> pa.RecordBatch:
        """Area by ecosystem and cell, as rows of MEASURED."""
        group, col, row, a = geometry.cells_of(self.points, self.ring, self.polygon, self.outer, self.group)
        ecos = pa.array(self.ecosystems, pa.string()).take(pa.array(group))
        none = pa.nulls(len(a), pa.float64())
        return pa.RecordBatch.from_arrays([ecos, pa.array(col.astype(np.int32)), pa.array(row.astype(np.int32)), pa.array(a), none, none], names=_NAMES)

    def add_corners(self, parts: dict[str, np.ndarray]) -> None:
        """Merges the hulls of the exteriors into those of `parts`."""
        at = np.flatnonzero(self.outer[self.ring]) if len(self.ring) else np.empty(0, np.int64)
        owner = self.group[self.polygon[self.ring[at]]]
        order = np.argsort(owner, kind="stable")
        first = np.flatnonzero(np.diff(owner[order], prepend=-1))
        for k, own in zip(owner[order][first].tolist(), np.split(self.points[at[order]], first[1:]), strict=True) if len(first) else ():
            eco = self.ecosystems[k]
            parts[eco] = geometry.hull(np.concatenate([parts[eco], own]) if eco in parts else own)


#: Rows of a cell (col, row, extent_m2) or of a hull's point (x, y).
MEASURED = "ecosystem string, col int, row int, extent_m2 double, x double, y double"
_NAMES = [f.split()[0] for f in MEASURED.split(", ")]


def measured(df: DataFrame, validate: bool = True, cells: bool = True, corners: bool = True) -> DataFrame:
    """Each polygon decoded and projected once: its area in each cell it touches, summed per batch, and the hulls of each
    task's exteriors by ecosystem."""

    def run(batches):
        parts: dict[str, np.ndarray] = {}
        for batch in batches:
            own = _Batch(batch, validate)
            if corners:
                own.add_corners(parts)
            if cells:
                yield own.cells()
        points = _points(parts)
        none = [pa.nulls(points.num_rows, t) for t in (pa.int32(), pa.int32(), pa.float64())]
        yield pa.RecordBatch.from_arrays([points.column("ecosystem"), *none, points.column("x"), points.column("y")], names=_NAMES)

    return _present(df).mapInArrow(run, MEASURED)


def _cells(rows: DataFrame) -> DataFrame:
    return rows.where("col IS NOT NULL").select("ecosystem", "col", "row", "extent_m2")


def _corners(rows: DataFrame) -> DataFrame:
    return rows.where("x IS NOT NULL").select("ecosystem", "x", "y")


def polygon_extents(df: DataFrame, validate: bool = True) -> DataFrame:
    """Area of each polygon in each cell it touches, summed per batch before it leaves the task."""
    return _cells(measured(df, validate, corners=False))


def rectangle_extents(df: DataFrame, x0: str = "x0", y0: str = "y0", x1: str = "x1", y1: str = "y1", weight: Column | None = None) -> DataFrame:
    """The same for axis-parallel rectangles in metres, in closed form; `weight` scales the area (a raster's coverage)."""
    cells = cover_cells(df, x0, y0, x1, y1)
    a = interval_overlap(F.col(x0), F.col(x1), F.col("col")) * interval_overlap(F.col(y0), F.col(y1), F.col("row"))
    return cells.select(F.coalesce("ecosystem", F.lit("")).alias("ecosystem"), "col", "row", (a if weight is None else a * weight).alias("extent_m2")).where("extent_m2 > 0")


def raster_extents(pixels: DataFrame, origin_x: float, origin_y: float, step_x: float, step_y: float, coverage: str = "coverage") -> DataFrame:
    """The same for pixels (ecosystem, px_col, px_row, coverage); steps may have either sign, coverage that isn't finite or positive is left out."""
    edges = {n: [F.lit(o) + F.col(c) * F.lit(s), F.lit(o) + (F.col(c) + 1) * F.lit(s)] for n, o, c, s in (("x", origin_x, "px_col", step_x), ("y", origin_y, "px_row", step_y))}
    boxes = {f"{n}{k}": f(*e) for n, e in edges.items() for k, f in ((0, F.least), (1, F.greatest))}
    good = (F.col(coverage) > 0) & (F.col(coverage) < float("inf"))
    return rectangle_extents(pixels.where(good).withColumns(boxes), weight=F.col(coverage))


def class_mask(value: Column, wanted: float) -> Column:
    """1 where a raster's value is the class, else 0."""
    return (value == F.lit(float(wanted))).cast("double")


def aoo_grid(extents: DataFrame, capacity: float = CELL_AREA, strict: bool = False) -> DataFrame:
    """Occupied cells: ecosystem, col, row, extent_m2 (capped at a cell's area), fraction, overfull.

    `strict` sums decimals of a millionth of a square metre, so that results don't depend on the order of the rows, bit by
    bit; extents that aren't finite are then left out row by row.
    """
    value = F.col("extent_m2").cast("decimal(28,6)") if strict else F.col("extent_m2")
    total = extents.groupBy("ecosystem", "col", "row").agg(F.sum(value).cast("double").alias("raw")).where((F.col("raw") > 0) & (F.col("raw") < float("inf")))
    return total.select("ecosystem", "col", "row", F.least("raw", F.lit(capacity)).alias("extent_m2"), (F.least("raw", F.lit(capacity)) / capacity).alias("fraction"), (F.col("raw") > capacity).alias("overfull"))


def one_percent(grid: DataFrame) -> DataFrame:
    """Per ecosystem: total_extent, occupied_cell_count, overfull_cells, aoo_cells after leaving out the smallest cells that
    together hold up to 1 %, threshold_margin, near_boundary.

    The running share needs an ecosystem's cells in order, smallest first, row by row (ROWS, as equal extents must not
    share a value). Rows are cells, not features, at most as many as the grid has, so that the ordered part stays small
    beside the input. One shuffle serves both sums and the aggregation.
    """
    own = Window.partitionBy("ecosystem")
    before = own.orderBy("extent_m2", "col", "row").rowsBetween(Window.unboundedPreceding, 0)
    cells = grid.select("ecosystem", "extent_m2", "overfull", F.sum("extent_m2").over(before).alias("running"), F.sum("extent_m2").over(own).alias("total_extent"))
    share = F.col("running") / F.col("total_extent")
    out = cells.groupBy("ecosystem").agg(
        F.max("total_extent").alias("total_extent"),
        F.count(F.lit(1)).alias("occupied_cell_count"),
        F.count_if("overfull").alias("overfull_cells"),
        F.count_if(share > CUTOFF).alias("aoo_cells"),
        F.min(F.abs(share - CUTOFF)).alias("threshold_margin"),
    )
    return out.withColumn("near_boundary", F.col("threshold_margin") < MARGIN)


def hulls(df: DataFrame, validate: bool = True) -> DataFrame:
    """Convex hull of the exteriors per ecosystem, ARRAY<STRUCT<x, y>>: of each task's points first, then of those hulls."""
    return merged_hulls(_corners(measured(df, validate, cells=False)))


def folded(df: DataFrame, validate: bool = True) -> tuple[DataFrame, DataFrame]:
    """(extents, hulls) of features, from one pass over them that is written as a table."""
    rows = materialize(measured(df, validate))
    return _cells(rows), merged_hulls(_corners(rows))


def point_hulls(points: DataFrame) -> DataFrame:
    """Hulls of projected points (ecosystem, x, y)."""

    def run(batches):
        parts: dict[str, np.ndarray] = {}
        for batch in batches:
            ecos = np.array(batch.column("ecosystem").to_pylist(), object)
            xy = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y")], axis=1)
            for eco in set(ecos.tolist()):
                own = xy[ecos == eco]
                parts[eco] = geometry.hull(np.concatenate([parts[eco], own]) if eco in parts else own)
        yield _points(parts)

    return merged_hulls(points.select("ecosystem", "x", "y").mapInArrow(run, "ecosystem string, x double, y double"))


def _points(parts: dict[str, np.ndarray]) -> pa.RecordBatch:
    xy = np.concatenate([np.empty((0, 2)), *parts.values()])
    ecos = [e for e, p in parts.items() for _ in range(len(p))]
    return pa.RecordBatch.from_arrays([pa.array(ecos, pa.string()), pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["ecosystem", "x", "y"])


def merged_hulls(points: DataFrame) -> DataFrame:
    """(ecosystem, hull) from hull points of parts."""

    def merge(t: pa.Table) -> pa.Table:
        h = geometry.hull(np.stack([t.column("x").to_numpy(), t.column("y").to_numpy()], axis=1))
        return pa.table({"ecosystem": pa.array([t.column("ecosystem")[0].as_py()], pa.string()), "hull": pa.array([[{"x": x, "y": y} for x, y in h.tolist()]], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))})

    return points.groupBy("ecosystem").applyInArrow(merge, "ecosystem string, hull array<struct<x:double,y:double>>")


def eoo(hull_rows: DataFrame) -> DataFrame:
    """ecosystem, eoo_km2; 0 for a degenerate hull."""
    return hull_rows.select("ecosystem", (F.abs(ring_area(F.col("hull"))) / 1e6).alias("eoo_km2"))


def assembled(ecosystems: DataFrame, aoo: DataFrame, extents_of: DataFrame) -> DataFrame:
    """Metrics of every ecosystem, 0 where it has no cell or no area."""
    out = ecosystems.join(aoo, "ecosystem", "left").join(extents_of, "ecosystem", "left")
    return out.select(
        "ecosystem",
        F.coalesce("eoo_km2", F.lit(0.0)).alias("eoo_km2"),
        F.coalesce("aoo_cells", F.lit(0)).cast("long").alias("aoo_cells"),
        F.coalesce("occupied_cell_count", F.lit(0)).cast("long").alias("occupied_cell_count"),
        F.coalesce("near_boundary", F.lit(False)).alias("aoo_near_boundary"),
        F.coalesce("overfull_cells", F.lit(0)).cast("long").alias("overfull_cells"),
    )


def distribution_metrics(df: DataFrame, validate: bool = True) -> DataFrame:
    """ecosystem, eoo_km2, aoo_cells, occupied_cell_count, aoo_near_boundary, overfull_cells of features.

    An ecosystem is listed if one of its polygons has a finite vertex, though none of its cells may have area.
    """
    extents, hull_rows = folded(df, validate)
    return assembled(hull_rows.where(F.size("hull") > 0).select("ecosystem"), one_percent(aoo_grid(extents)), eoo(hull_rows))


def summary(metrics: DataFrame) -> DataFrame:
    """One JSON document: ecosystems in byte order, overfull_cells, grid_crs, cell_size_m."""
    one = F.struct("ecosystem", "eoo_km2", "aoo_cells", "occupied_cell_count", "aoo_near_boundary")
    rows = metrics.agg(F.array_sort(F.collect_list(one)).alias("ecosystems"), F.coalesce(F.sum("overfull_cells"), F.lit(0)).alias("overfull_cells"))
    return rows.select(F.to_json(F.struct("ecosystems", "overfull_cells", F.lit(GRID_CRS).alias("grid_crs"), F.lit(CELL).alias("cell_size_m"))).alias("summary"))


def cells(extents: DataFrame, ecosystem: str) -> DataFrame:
    """An ecosystem's occupied cells in order: col, row, extent_m2, fraction; none for an ecosystem that isn't there."""
    return aoo_grid(extents.where(F.col("ecosystem") == ecosystem)).select("col", "row", "extent_m2", "fraction").orderBy("col", "row")


def overfull(extents: DataFrame) -> DataFrame:
    """The cells that hold more than their own area, which means that polygons overlap there: ecosystem, col, row."""
    return aoo_grid(extents).where("overfull").select("ecosystem", "col", "row").orderBy("ecosystem", "col", "row")


def metric_of(metrics: DataFrame, ecosystem: str, name: str) -> float:
    """One number of distribution_metrics(); 0 for an ecosystem that isn't there."""
    row = metrics.where(F.col("ecosystem") == ecosystem).select(name).first()
    return 0 if row is None else row[0]


def unexpected_cells(extents: DataFrame, expected: DataFrame) -> DataFrame:
    """Cells (ecosystem, col, row) that only one of both has: `side` is `extra` or `missing`."""
    own, keys = aoo_grid(extents).select("ecosystem", "col", "row"), ["ecosystem", "col", "row"]
    extra, missing = own.join(expected, keys, "left_anti"), expected.select(*keys).join(own, keys, "left_anti")
    return extra.withColumn("side", F.lit("extra")).unionByName(missing.withColumn("side", F.lit("missing")))
