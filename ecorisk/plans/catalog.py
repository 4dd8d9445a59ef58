"""One query per operator over the driver's tables, each with its SQL.

The tables hold no geometry, so footprints are derived from integer keys, alike in both.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ecorisk.functions import categories, spatial
from ecorisk.functions.geometry import read_wkb, write_wkb
from ecorisk.functions.spatial import AXIS, E2, ECC
from ecorisk.operators import criteria, distribution
from ecorisk.sources import geojson, geoparquet, raster
from ecorisk.storage import shared_dir


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- derived inputs -------------------------------------------------------------------------------------------------


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as points: ecosystem, id, lon, lat; one ecosystem per nation, wider ones for later nations."""
    c, n = F.col("c_custkey"), F.col("c_nationkey").cast("double")
    spread = F.lit(0.02) * (1.0 + n) * (1.0 + n)
    lon = n * 12.0 - 150.0 + spread * (((c * c * 7919 + c * 104729) % 1009).cast("double") / 1009.0)
    lat = (F.col("c_nationkey") % 9).cast("double") * 12.0 - 50.0 + spread * (((c * c * 3571 + c * 7907) % 1013).cast("double") / 1013.0)
    return read(spark, sf_dir, "customer").select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("ecosystem"), c.alias("id"), lon.alias("lon"), lat.alias("lat"))


FOOTPRINTS = """fp AS (
  SELECT 'N' || c_nationkey AS ecosystem, c_custkey AS id,
    CAST(c_nationkey AS DOUBLE) * 12e0 - 150e0 + 0.02e0 * (1e0 + c_nationkey) * (1e0 + c_nationkey) * (CAST((c_custkey * c_custkey * 7919 + c_custkey * 104729) % 1009 AS DOUBLE) / 1009e0) AS lon,
    CAST(c_nationkey % 9 AS DOUBLE) * 12e0 - 50e0 + 0.02e0 * (1e0 + c_nationkey) * (1e0 + c_nationkey) * (CAST((c_custkey * c_custkey * 3571 + c_custkey * 7907) % 1013 AS DOUBLE) / 1013e0) AS lat
  FROM customer)"""
_S = "sin(radians(lat))"
PROJECTED = f"""{FOOTPRINTS}, pp AS (
  SELECT ecosystem, id, {AXIS!r}e0 * radians(lon) AS x,
    {AXIS!r}e0 * ({1 - E2!r}e0 * ({_S} / (1e0 - {E2!r}e0 * {_S} * {_S}) - ln((1e0 - {ECC!r}e0 * {_S}) / (1e0 + {ECC!r}e0 * {_S})) / {2 * ECC!r}e0)) / 2e0 AS y
  FROM fp)"""


def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = F.col("lon"), F.col("lat")
    return footprints(spark, sf_dir).select("ecosystem", "id", spatial.project_x(lon, lat).alias("x"), spatial.project_y(lon, lat).alias("y"))


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rectangles in metres: ecosystem (brand), x0, y0, x1, y1 on a 10 m raster."""
    k = F.col("p_partkey")
    x0 = ((k * k * 31 + k * 7919) % 60013).cast("double") * 10.0 - 300000.0
    y0 = ((k * k * 17 + k * 3571) % 40009).cast("double") * 10.0 - 200000.0
    size = F.col("p_size").cast("double")
    return read(spark, sf_dir, "part").select(F.col("p_brand").alias("ecosystem"), k.alias("id"), x0.alias("x0"), y0.alias("y0"), (x0 + size * 410.0).alias("x1"), (y0 + size * 230.0).alias("y1"))


RECTANGLES = """r AS (
  SELECT p_brand AS ecosystem, p_partkey AS id,
    CAST((p_partkey * p_partkey * 31 + p_partkey * 7919) % 60013 AS DOUBLE) * 10e0 - 300000e0 AS x0,
    CAST((p_partkey * p_partkey * 17 + p_partkey * 3571) % 40009 AS DOUBLE) * 10e0 - 200000e0 AS y0,
    CAST((p_partkey * p_partkey * 31 + p_partkey * 7919) % 60013 AS DOUBLE) * 10e0 - 300000e0 + CAST(p_size AS DOUBLE) * 410e0 AS x1,
    CAST((p_partkey * p_partkey * 17 + p_partkey * 3571) % 40009 AS DOUBLE) * 10e0 - 200000e0 + CAST(p_size AS DOUBLE) * 230e0 AS y1
  FROM part)"""


def cells_sql(source: str, weight: str = "1e0") -> str:
    """CTEs cells (each rectangle and cell) and grid (occupied cells) over `source` (ecosystem, x0, y0, x1, y1)."""
    return f"""wide AS (SELECT *, unnest(generate_series(CAST(floor(x0 / 10000e0) AS BIGINT), CAST(floor(x1 / 10000e0) AS BIGINT))) AS col FROM {source}),
tall AS (SELECT *, unnest(generate_series(CAST(floor(y0 / 10000e0) AS BIGINT), CAST(floor(y1 / 10000e0) AS BIGINT))) AS "row" FROM wide),
cells AS (SELECT ecosystem, col, "row", {weight} * greatest(0e0, least(x1, (col + 1) * 10000e0) - greatest(x0, col * 10000e0)) * greatest(0e0, least(y1, ("row" + 1) * 10000e0) - greatest(y0, "row" * 10000e0)) AS a FROM tall),
summed AS (SELECT ecosystem, col, "row", sum(a) AS raw FROM cells WHERE a > 0 GROUP BY 1, 2, 3),
grid AS (SELECT ecosystem, col, "row", least(raw, 1e8) AS extent_m2, raw > 1e8 AS overfull FROM summed),
shares AS (SELECT *, sum(extent_m2) OVER (PARTITION BY ecosystem ORDER BY extent_m2, col, "row" ROWS UNBOUNDED PRECEDING) / sum(extent_m2) OVER (PARTITION BY ecosystem) AS share FROM grid),
aoo AS (SELECT ecosystem, count(*) FILTER (WHERE share > 0.01) AS aoo_cells, count(*) AS occupied_cell_count, count(*) FILTER (WHERE overfull) AS overfull_cells FROM shares GROUP BY 1)"""


def features_of(rows: DataFrame) -> DataFrame:
    """Rectangles in degrees (ecosystem, x0, y0, x1, y1) as features."""

    def run(batches):
        for b in batches:
            boxes = zip(*[b.column(c).to_pylist() for c in ("x0", "y0", "x1", "y1")], strict=True)
            yield pa.RecordBatch.from_arrays([b.column("ecosystem"), pa.array([write_wkb([[[(w, s), (e, s), (e, n), (w, n)]]]) for w, s, e, n in boxes], pa.binary())], ["ecosystem", "geometry"])

    return rows.select("ecosystem", "x0", "y0", "x1", "y1").mapInArrow(run, "ecosystem string, geometry binary")


# --- queries --------------------------------------------------------------------------------------------------------


def project_points(spark, sf_dir):
    return projected(spark, sf_dir).select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


def project_points_sql_function(spark, sf_dir):
    spatial.register(spark)
    return footprints(spark, sf_dir).selectExpr("id", "round(project_x(lon, lat), 3) AS x", "round(project_y(lon, lat), 3) AS y")


def cell_assign(spark, sf_dir):
    return projected(spark, sf_dir).select("id", spatial.cell_of(F.col("x")).alias("col"), spatial.cell_of(F.col("y")).alias("row"))


def occupied_cells(spark, sf_dir):
    grid = distribution.aoo_grid(distribution.rectangle_extents(rectangles(spark, sf_dir)))
    return grid.select("ecosystem", F.col("col").cast("long"), F.col("row").cast("long"), F.round("extent_m2", 1).alias("extent_m2"), F.round("fraction", 7).alias("fraction"))


def aoo_one_percent(spark, sf_dir):
    out = distribution.one_percent(distribution.aoo_grid(distribution.rectangle_extents(rectangles(spark, sf_dir))))
    return out.select("ecosystem", "aoo_cells", "occupied_cell_count", "overfull_cells")


def polygon_hole_extent(spark, sf_dir):
    """Squares of degrees with a hole, through the general clip: projected area in km2 is the closed form's."""

    def run(batches):
        for b in batches:
            polygons = [[[(w, s), (e, s), (e, n), (w, n)], [((3 * w + e) / 4, (3 * s + n) / 4), ((w + 3 * e) / 4, (3 * s + n) / 4), ((w + 3 * e) / 4, (s + 3 * n) / 4), ((3 * w + e) / 4, (s + 3 * n) / 4)]] for w, s, e, n in zip(*[b.column(c).to_pylist() for c in ("x0", "y0", "x1", "y1")], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("ecosystem"), pa.array([write_wkb([p]) for p in polygons], pa.binary())], ["ecosystem", "geometry"])

    rows = _degree_boxes(spark, sf_dir).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("ecosystem"), "x0", "y0", "x1", "y1")
    extents = distribution.polygon_extents(rows.mapInArrow(run, "ecosystem string, geometry binary"))
    return extents.groupBy("ecosystem").agg(F.round(F.sum("extent_m2") / 1e6, 3).alias("area_km2"))


def _degree_boxes(spark, sf_dir):
    k = F.col("s_suppkey").cast("double")
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("all").alias("ecosystem"), (k % 300 - 150.0).alias("x0"), (k % 90 - 45.0).alias("y0"), (k % 300 - 149.5).alias("x1"), (k % 90 - 44.75).alias("y1"))


def _north(v: str) -> str:
    s = f"sin(radians({v}))"
    return f"({AXIS!r}e0 * ({1 - E2!r}e0 * ({s} / (1e0 - {E2!r}e0 * {s} * {s}) - ln((1e0 - {ECC!r}e0 * {s}) / (1e0 + {ECC!r}e0 * {s})) / {2 * ECC!r}e0)) / 2e0)"


def wkb_roundtrip(spark, sf_dir):
    """Boxes written as WKB and decoded again: vertices and bounds."""

    def run(batches):
        for b in batches:
            points = [read_wkb(g)[0][0] for g in b.column("geometry").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([len(p) for p in points], pa.int64()), *[pa.array([float(f(p[:, k])) for p in points]) for k in (0, 1) for f in (min, max)]], ["n_vertices", "x0", "x1", "y0", "y1"])

    return features_of(_degree_boxes(spark, sf_dir)).mapInArrow(run, "n_vertices long, x0 double, x1 double, y0 double, y1 double")


def eoo_hull(spark, sf_dir):
    return distribution.eoo(distribution.point_hulls(projected(spark, sf_dir))).select("ecosystem", F.round("eoo_km2", 2).alias("eoo_km2"))


HULLS = """edges AS (
  SELECT a.ecosystem, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_
  FROM pp a JOIN pp b ON a.ecosystem = b.ecosystem AND (a.x <> b.x OR a.y <> b.y)
  WHERE NOT EXISTS (SELECT 1 FROM pp c WHERE c.ecosystem = a.ecosystem AND (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0)),
hull AS (SELECT ecosystem, sum(ax * by_ - bx * ay) / 2e0 / 1e6 AS eoo_km2 FROM edges GROUP BY 1)"""


def raster_aoo(spark, sf_dir):
    """Events as 1 km pixels, off the grid by 500 m, classed by value."""
    k = F.col("event_id")
    pixels = read(spark, sf_dir, "events").select(F.concat(F.lit("C"), F.floor(F.col("value") / 50.0).cast("string")).alias("ecosystem"), (k % 100).cast("int").alias("px_col"), F.floor(k / 100).cast("int").alias("px_row"), distribution.class_mask((F.col("event_id") * 0 + 1).cast("double"), 1.0).alias("coverage"))
    out = distribution.one_percent(distribution.aoo_grid(distribution.raster_extents(pixels, 500.0, 1000500.0, 1000.0, -1000.0)))
    return out.select("ecosystem", "aoo_cells", "occupied_cell_count", F.round(F.col("total_extent") / 1e6, 3).alias("total_km2"))


def category_dim(spark, sf_dir):
    return categories.category_table(spark)


def criterion_dim(spark, sf_dir):
    return categories.criterion_table(spark)


def thresholds_table(spark, sf_dir):
    return categories.threshold_table(spark).na.fill(-1)


def classify_b1(spark, sf_dir):
    v = F.col("o_totalprice") / 8.0
    return read(spark, sf_dir, "orders").select("o_orderkey", categories.code_of(categories.classify("B1", v)).alias("category"))


def classify_b2(spark, sf_dir):
    spatial.register(spark)
    return read(spark, sf_dir, "orders").selectExpr("o_orderkey", "category_of('B2', CAST(o_custkey % 60 AS DOUBLE)) AS category")


def classify_estimate(spark, sf_dir):
    v = F.col("o_totalprice") / 8.0
    e = categories.estimate(v, v * 0.5, F.when(F.col("o_orderkey") % 3 != 0, v * 1.5))
    return read(spark, sf_dir, "orders").select("o_orderkey", e.alias("e")).select("o_orderkey", F.col("e.lower").alias("lower"), F.col("e.upper").alias("upper"), categories.display(categories.classify_estimate("B1", F.col("e"))).alias("category"))


def evidence(spark, sf_dir):
    """Orders as assessments with partly unknown evidence."""
    k = F.col("o_orderkey")
    three = lambda n: F.element_at(F.array(F.lit("met"), F.lit("not_met"), F.lit("not_assessed")), (F.floor(k / n) % 3 + 1).cast("int"))
    kinds = F.array(*[F.lit(x) for x in ("count", "count", "no_plausible_threats", "insufficient_information", "not_assessed")])
    v = F.col("o_totalprice") / 8.0
    return read(spark, sf_dir, "orders").select(
        k.alias("id"),
        F.when(k % 11 != 0, v).alias("eoo_km2"), F.when(k % 2 == 0, v * 0.6).alias("eoo_lower"), F.when(k % 4 != 1, v * 1.4).alias("eoo_upper"),
        F.when(k % 13 != 0, (k % 60).cast("double")).alias("aoo_cells"), F.when(k % 3 == 0, (k % 60).cast("double") * 0.5).alias("aoo_lower"), F.when(k % 3 == 0, (k % 60).cast("double") * 2.0).alias("aoo_upper"),
        three(1).alias("a_i"), three(3).alias("a_ii"), three(9).alias("a_iii"), three(27).alias("b"), three(81).alias("b3_rapid_collapse"),
        F.element_at(kinds, (F.floor(k / 5) % 5 + 1).cast("int")).alias("locations_kind"), (k % 12).cast("int").alias("locations"),
    )


def _three_sql(n: int) -> str:
    return f"(ARRAY['met', 'not_met', 'not_assessed'])[CAST(floor(k / {n}e0) AS BIGINT) % 3 + 1]"


_BASE = f"""ev0 AS (SELECT o_orderkey AS k, o_totalprice / 8e0 AS v FROM orders),
ev AS (SELECT k, CASE WHEN k % 11 <> 0 THEN v END AS e, CASE WHEN k % 11 <> 0 AND k % 2 = 0 AND k % 4 <> 1 THEN v * 0.6e0 WHEN k % 11 <> 0 THEN v END AS elo, CASE WHEN k % 11 <> 0 AND k % 2 = 0 AND k % 4 <> 1 THEN v * 1.4e0 WHEN k % 11 <> 0 THEN v END AS ehi,
  CASE WHEN k % 13 <> 0 THEN CAST(k % 60 AS DOUBLE) END AS c, CASE WHEN k % 13 <> 0 THEN CASE WHEN k % 3 = 0 THEN (k % 60) * 0.5e0 ELSE CAST(k % 60 AS DOUBLE) END END AS clo, CASE WHEN k % 13 <> 0 THEN CASE WHEN k % 3 = 0 THEN (k % 60) * 2e0 ELSE CAST(k % 60 AS DOUBLE) END END AS chi,
  {_three_sql(1)} AS a1, {_three_sql(3)} AS a2, {_three_sql(9)} AS a3, {_three_sql(27)} AS b, {_three_sql(81)} AS rapid,
  (ARRAY['count', 'count', 'no_plausible_threats', 'insufficient_information', 'not_assessed'])[CAST(floor(k / 5e0) AS BIGINT) % 5 + 1] AS kind, CAST(k % 12 AS INTEGER) AS n FROM ev0),
st AS (SELECT *, CASE WHEN a1 = 'met' OR a2 = 'met' OR a3 = 'met' THEN 'met' WHEN a1 = 'not_met' AND a2 = 'not_met' AND a3 = 'not_met' THEN 'not_met' ELSE 'not_assessed' END AS a FROM ev)"""


def _gate(bound: int, unknown: bool) -> str:
    met = f"(a = 'met' OR b = 'met' OR (kind = 'count' AND n <= {bound}))"
    return f"({met} OR a = 'not_assessed' OR b = 'not_assessed' OR kind IN ('insufficient_information', 'not_assessed'))" if unknown else met


def _class(v: str, bounds) -> str:
    return f"CASE WHEN {v} <= {bounds[0]} THEN 1 WHEN {v} <= {bounds[1]} THEN 2 WHEN {v} <= {bounds[2]} THEN 3 ELSE 5 END"


def _level(v: str, bounds, unknown: bool) -> str:
    return "CASE " + " ".join(f"WHEN {v} <= {m} AND {_gate(n, unknown)} THEN {r}" for r, (m, n) in enumerate(zip(bounds, (1, 5, 10), strict=True), 1)) + " ELSE 5 END"


def _spatial(name: str, v: str, lo: str, hi: str, bounds) -> str:
    case = lambda ne, t, dd, rest: f"CASE WHEN {v} IS NULL THEN {ne} WHEN {_class(lo, bounds)} = 5 THEN {t} WHEN kind = 'insufficient_information' AND a <> 'met' AND b <> 'met' THEN {dd} ELSE {rest} END"
    best = case(7, _class(v, bounds), 6, _level(v, bounds, True))
    low, high = _level(lo, bounds, True), _level(hi, bounds, False)
    least = case(7, _class(hi, bounds), 6, f"greatest({low}, {high})")
    most = case(7, 5, 6, f"least({low}, {high})")
    return f"{best} AS {name}, {least} AS {name}_least, {most} AS {name}_most"


_B3 = """CASE WHEN kind = 'not_assessed' AND rapid = 'not_assessed' THEN 7 WHEN kind = 'insufficient_information' THEN 6
  WHEN (kind = 'count' AND n > 4) OR kind = 'no_plausible_threats' OR rapid = 'not_met' THEN 5 ELSE 3 END"""
ASSESSED = f"""{_BASE}, ranges AS (SELECT *, {_spatial("b1", "e", "elo", "ehi", (2000, 20000, 50000))}, {_spatial("b2", "c", "clo", "chi", (2, 20, 50))},
  {_B3} AS b3, CASE WHEN {_B3} = 3 AND NOT (kind = 'count' AND n <= 4 AND rapid = 'met') THEN 5 ELSE {_B3} END AS b3_least, {_B3} AS b3_most FROM st),
overall AS (SELECT *, """ + ", ".join(
    f"CASE WHEN b1 < 6 OR b2 < 6 OR b3 < 6 THEN least(CASE WHEN b1 < 6 THEN b1{s} ELSE 9 END, CASE WHEN b2 < 6 THEN b2{s} ELSE 9 END, CASE WHEN b3 < 6 THEN b3{s} ELSE 9 END) WHEN b1 = 6 OR b2 = 6 OR b3 = 6 THEN 6 ELSE 7 END AS o{s}"
    for s in ("", "_least", "_most")
) + " FROM ranges)"
# fixed values: category codes in order of risk
_CODES = "ARRAY['CO', 'CR', 'EN', 'VU', 'NT', 'LC', 'DD', 'NE']"


def _shown(r: str) -> str:
    code = lambda x: f"({_CODES})[{x} + 1]"
    return f"CASE WHEN {r}_least = {r}_most THEN {code(r)} ELSE {code(r)} || ' (' || {code(r + '_least')} || '-' || {code(r + '_most')} || ')' END"


_PENDING = "(CASE WHEN a = 'not_assessed' THEN 1 ELSE 0 END + CASE WHEN b = 'not_assessed' THEN 1 ELSE 0 END + CASE WHEN kind = 'not_assessed' THEN 1 ELSE 0 END)"


def _note_count(v: str, lo: str, bounds) -> str:
    near = "CASE WHEN kind = 'count' AND n <= 9 THEN 1 ELSE 0 END"
    return f"CASE WHEN {v} IS NULL THEN 1 WHEN {_class(lo, bounds)} = 5 THEN 1 WHEN kind = 'insufficient_information' AND a <> 'met' AND b <> 'met' THEN 1 ELSE CASE WHEN {_PENDING} > 0 THEN 1 WHEN {_level(lo, bounds, True)} = 5 THEN 1 ELSE 0 END + {near} END"


def criterion_b(spark, sf_dir):
    out = criteria.assess_criterion_b(evidence(spark, sf_dir))
    return out.select("id", "b1", "b2", "b3", "overall", "is_threatened", F.size("notes").cast("long").alias("n_notes"), F.coalesce("b1_threshold", F.lit("-")).alias("b1_threshold"))


_NOTES3 = "CASE WHEN b3 = 7 OR b3 = 6 THEN 1 ELSE CASE WHEN b3 = 3 AND b3_least = 5 THEN 1 ELSE 0 END + CASE WHEN kind = 'count' AND n <= 4 THEN 1 ELSE 0 END END"
_T1 = f"CASE WHEN e IS NULL THEN '-' WHEN {_class('ehi', (2000, 20000, 50000))} = {_class('elo', (2000, 20000, 50000))} THEN ({_CODES})[{_class('e', (2000, 20000, 50000))} + 1] ELSE ({_CODES})[{_class('e', (2000, 20000, 50000))} + 1] || ' (' || ({_CODES})[{_class('ehi', (2000, 20000, 50000))} + 1] || '-' || ({_CODES})[{_class('elo', (2000, 20000, 50000))} + 1] || ')' END"


def gate_levels(spark, sf_dir):
    df = criteria.completed(evidence(spark, sf_dir))
    gates = {f"{lv.lower()}_{k}": g for lv in criteria.LEVELS for k, g in zip(("met", "unknown"), criteria.gate_at("B1", lv), strict=True)}
    return df.select("id", *[g.alias(n) for n, g in gates.items()], F.concat_ws("", criteria.pending()).alias("pending"))


def note_sentences(spark, sf_dir):
    """How often each sentence of notes is said, counts in it masked."""
    out = criteria.assess_criterion_b(evidence(spark, sf_dir)).select(F.explode_outer("notes").alias("note")).where("note IS NOT NULL")
    return out.groupBy(F.regexp_replace("note", "^with [0-9]+ ", "with n ").alias("note")).agg(F.count(F.lit(1)).alias("n"))


def distribution_to_category(spark, sf_dir):
    """Points to hull areas and cells, to categories: the whole way."""
    points = projected(spark, sf_dir)
    spots = points.select("ecosystem", (F.col("x") - 500.0).alias("x0"), (F.col("y") - 500.0).alias("y0"), (F.col("x") + 500.0).alias("x1"), (F.col("y") + 500.0).alias("y1"))
    aoo = distribution.one_percent(distribution.aoo_grid(distribution.rectangle_extents(spots)))
    metrics = distribution.assembled(points.select("ecosystem").distinct(), aoo, distribution.eoo(distribution.point_hulls(points)))
    out = criteria.assess_criterion_b(metrics.withColumns({"a_i": F.lit("met"), "aoo_cells": F.col("aoo_cells").cast("double")}))
    return out.select("ecosystem", F.round("eoo_km2", 1).alias("eoo_km2"), F.col("aoo_cells").cast("long"), "b1", "b2", "b3", "overall", "is_threatened")


def polygon_metrics(spark, sf_dir):
    """Boxes in degrees through WKB, projection, clip and hull."""
    out = distribution.distribution_metrics(features_of(_degree_boxes(spark, sf_dir).withColumn("ecosystem", F.concat(F.lit("E"), F.col("id").cast("string")))))
    return out.select("ecosystem", F.round("eoo_km2", 2).alias("eoo_km2"), "occupied_cell_count")


def ecosystem_filter(spark, sf_dir):
    return read(spark, sf_dir, "part").where(F.col("p_brand").isin("Brand#11", "Brand#22", "Brand#33")).select("p_partkey", "p_brand")


def bbox_filter(spark, sf_dir):
    return rectangles(spark, sf_dir).where("x0 <= 100000D AND x1 >= -100000D AND y0 <= 50000D AND y1 >= -50000D").select("ecosystem", "id")


def geojson_scan(spark, sf_dir):
    """Each box as a GeoJSON document, read back: vertices and corners."""
    x = {c: F.col(c).cast("decimal(9,3)").cast("string") for c in ("x0", "y0", "x1", "y1")}
    corner = lambda a, b: F.concat(F.lit("["), x[a], F.lit(","), x[b], F.lit("]"))
    ring = F.concat(F.lit("[["), corner("x0", "y0"), F.lit(","), corner("x1", "y0"), F.lit(","), corner("x1", "y1"), F.lit(","), corner("x0", "y1"), F.lit("]]"))
    head = json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"ECO_CODE": "@"}, "geometry": {"type": "Polygon", "coordinates": "#"}}]})
    before, after = head.replace('"#"', "#").split("#")
    texts = _degree_boxes(spark, sf_dir).select(F.concat(F.replace(F.lit(before), F.lit("@"), F.concat(F.lit("E"), F.col("id").cast("string"))), ring, F.lit(after)).alias("value"))
    ring_ = F.col("polygons")[0][0]
    return geojson.parse(texts).select("ecosystem", F.size(ring_).cast("long").alias("n_vertices"), ring_[0][0].alias("west"), ring_[0][1].alias("south"), ring_[2][0].alias("east"), ring_[2][1].alias("north"))


def geojson_files(spark, sf_dir):
    """Customers' boxes written as GeoJSON files and streamed back."""
    path = f"{shared_dir(spark)}/geojson"
    geojson.write(features_of(_places(spark, sf_dir)), path)
    return _corners(geojson.read(spark, path))


def top_ecosystems(spark, sf_dir):
    """The report's first 15 lines."""
    out = distribution.one_percent(distribution.aoo_grid(distribution.rectangle_extents(rectangles(spark, sf_dir))))
    return out.select("ecosystem", "occupied_cell_count").orderBy(F.desc("occupied_cell_count"), "ecosystem").limit(15)


def ecosystems_listed(spark, sf_dir):
    return rectangles(spark, sf_dir).select("ecosystem").distinct()


def multi_dataset_union(spark, sf_dir):
    """Two datasets folded into one assessment."""
    r = rectangles(spark, sf_dir)
    both = r.where("id % 2 = 0").unionByName(r.where("id % 2 = 1").withColumn("x0", F.col("x0") - 0.0))
    grid = distribution.aoo_grid(distribution.rectangle_extents(both))
    return grid.groupBy("ecosystem").agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum("extent_m2") / 1e6, 3).alias("km2"))


def byte_ranges_merged(spark, sf_dir):
    """Touching or overlapping ranges merged, gaps never bridged: gaps and islands."""
    r = read(spark, sf_dir, "part").select((F.col("p_partkey") % 25).alias("file"), (F.floor(F.col("p_partkey") / 25) * 100).cast("long").alias("start"), (F.floor(F.col("p_partkey") / 25) * 100 + F.col("p_size") * 4).cast("long").alias("stop"))
    return geoparquet.merged_ranges(r)


# --- maps and rasters, written to the shared folder and read back through the sources --------------------------------


def _places(spark, sf_dir):
    """Customers as boxes of a twentieth of a degree: ecosystem, id, x0, y0, x1, y1."""
    return footprints(spark, sf_dir).select("ecosystem", "id", F.col("lon").alias("x0"), F.col("lat").alias("y0"), (F.col("lon") + 0.05).alias("x1"), (F.col("lat") + 0.05).alias("y1"))


def _map(spark, boxes: DataFrame, row_group: int = 10_000) -> str:
    path = f"{shared_dir(spark)}/map"
    geoparquet.write(features_of(boxes), path, row_group=row_group)
    return path


def _one_file(spark, sf_dir) -> str:
    """All places in one file with groups of 100 rows, so that its groups are the same on any machine."""
    return _map(spark, _places(spark, sf_dir).repartition(1), 100)


def _corners(features: DataFrame) -> DataFrame:
    """ecosystem, number of vertices and the south-west corner of each feature's exterior."""

    def run(batches):
        for b in batches:
            points = [read_wkb(g)[0][0] for g in b.column("geometry").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("ecosystem"), pa.array([len(p) for p in points], pa.int64()), *[pa.array([float(p[:, k].min()) for p in points], pa.float64()) for k in (0, 1)]], ["ecosystem", "n_vertices", "west", "south"])

    out = features.mapInArrow(run, "ecosystem string, n_vertices long, west double, south double")
    return out.select("ecosystem", "n_vertices", F.round("west", 8).alias("west"), F.round("south", 8).alias("south"))


SOME = ["N3", "N7", "N11", "N99"]
BOX = (-100.0, -30.0, 60.0, 25.0)


def geoparquet_scan(spark, sf_dir):
    return _corners(geoparquet.read(spark, _map(spark, _places(spark, sf_dir)), "ecosystem"))


def geoparquet_ecosystem_filter(spark, sf_dir):
    return _corners(geoparquet.read(spark, _map(spark, _places(spark, sf_dir)), "ecosystem", ecosystems=SOME))


def geoparquet_bbox_filter(spark, sf_dir):
    return _corners(geoparquet.read(spark, _map(spark, _places(spark, sf_dir)), "ecosystem", bbox=BOX))


def geoparquet_datasets_folded(spark, sf_dir):
    """Two datasets in one call from paths to metrics."""
    places = _places(spark, sf_dir)
    paths = [_map(spark, places.where(F.col("id") % 2 == k)) for k in (0, 1)]
    metrics, _ = geoparquet.distribution_from(spark, paths, "ecosystem")
    return metrics.select("ecosystem", "aoo_cells", "occupied_cell_count", "overfull_cells")


def geoparquet_inspect(spark, sf_dir):
    groups = geoparquet.inspect(spark, _map(spark, _places(spark, sf_dir)), "ecosystem")
    bounds = [F.round(f(c), 8).alias(c) for f, c in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax"))]
    return groups.agg(F.sum("rows").alias("features"), *bounds, F.min("first_ecosystem").alias("first_ecosystem"), F.max("last_ecosystem").alias("last_ecosystem"), F.min("crs").alias("crs"))


def geoparquet_read_plan(spark, sf_dir):
    plan = geoparquet.read_plan(spark, _one_file(spark, sf_dir), "ecosystem", ecosystems=SOME)
    return plan.select("row_group", "rows", "first_ecosystem", "last_ecosystem", "read")


def geoparquet_read_report(spark, sf_dir):
    """What was read and skipped, and that the merged ranges of the plan hold just the bytes planned."""
    path = _one_file(spark, sf_dir)
    report = geoparquet.read_report(spark, path, "ecosystem", ecosystems=SOME)
    ranges = geoparquet.plan_ranges(spark, path, "ecosystem", ecosystems=SOME).agg(F.sum(F.col("stop") - F.col("start")).alias("merged"), F.lit(path).alias("path"))
    less = (F.col("bytes_planned") < F.col("bytes_total")).alias("reads_less")
    return report.join(ranges, "path").select("groups_read", "groups_skipped", "features", less, (F.col("merged") == F.col("bytes_planned")).alias("ranges_agree"))


def geoparquet_structure(spark, sf_dir):
    path = _one_file(spark, sf_dir)
    kinds = geoparquet.schema_of(spark, path).select(F.lit("column").alias("severity"), F.concat_ws(" ", "column", "kind").alias("message"))
    return geoparquet.check_structure(spark, path).select("severity", "message").unionByName(kinds)


def odd_features(spark, sf_dir):
    """Null geometries are left out, a null ecosystem is the empty string, parts of a multipolygon count together."""

    def run(batches):
        for b in batches:
            rows = zip(*[b.column(c).to_pylist() for c in ("ecosystem", "id", "x0", "y0", "x1", "y1")], strict=True)
            out = [(None if k % 7 == 0 else e, None if k % 5 == 0 else write_wkb([[[(w, s), (x, s), (x, n), (w, n)]], [[(w, s + 1), (x, s + 1), (x, n + 1), (w, n + 1)]]])) for e, k, w, s, x, n in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.binary())], ["ecosystem", "geometry"])

    extents = distribution.polygon_extents(_places(spark, sf_dir).mapInArrow(run, "ecosystem string, geometry binary"))
    return extents.groupBy("ecosystem").agg(F.round(F.sum("extent_m2") / 1e6, 3).alias("km2"))


def many_vertices(spark, sf_dir):
    """Customers as polygons of 40 vertices, a tenth of a degree and more across: area by ecosystem."""

    def run(batches):
        turn = np.arange(40) * (np.pi / 20)
        for b in batches:
            rows = zip(*[b.column(c).to_pylist() for c in ("id", "lon", "lat")], strict=True)
            rings = [np.stack([x + (1 + k % 5) * 0.05 * np.cos(turn), y + (1 + k % 5) * 0.05 * np.sin(turn)], axis=1) for k, x, y in rows]
            yield pa.RecordBatch.from_arrays([b.column("ecosystem"), pa.array([write_wkb([[r]]) for r in rings], pa.binary())], ["ecosystem", "geometry"])

    polygons = footprints(spark, sf_dir).mapInArrow(run, "ecosystem string, geometry binary")
    return distribution.polygon_extents(polygons).groupBy("ecosystem").agg(F.round(F.sum("extent_m2") / 1e6, 2).alias("km2"))


def projected_rings(spark, sf_dir):
    """Rings of degrees projected vertex by vertex, and their bounding boxes."""
    ring = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])
    box = _places(spark, sf_dir).select("id", spatial.bounding_box(F.array(spatial.project_ring(ring))).alias("b"))
    return box.select("id", *[F.round(F.col("b")[c], 3).alias(c) for c in ("x0", "y0", "x1", "y1")])


def cells_in_order(spark, sf_dir):
    """One ecosystem's cells by column and row, numbered as they come."""
    own = distribution.cells(distribution.rectangle_extents(rectangles(spark, sf_dir)), "Brand#22")
    return own.select(F.col("col").cast("long"), F.col("row").cast("long"), F.round("fraction", 7).alias("fraction"))


def overfull_cells(spark, sf_dir):
    return distribution.overfull(distribution.rectangle_extents(rectangles(spark, sf_dir))).select("ecosystem", F.col("col").cast("long"), F.col("row").cast("long"))


def unexpected_cells(spark, sf_dir):
    """Cells of all rectangles against those of the first half of them."""
    r = rectangles(spark, sf_dir)
    some = distribution.aoo_grid(distribution.rectangle_extents(r.where("id % 2 = 0")))
    return distribution.unexpected_cells(distribution.rectangle_extents(r), some).select("ecosystem", F.col("col").cast("long"), F.col("row").cast("long"), "side")


def strict_extents(spark, sf_dir):
    grid = distribution.aoo_grid(distribution.rectangle_extents(rectangles(spark, sf_dir)), strict=True)
    return grid.groupBy("ecosystem").agg(F.round(F.sum("extent_m2") / 1e6, 4).alias("km2"), F.count(F.lit(1)).alias("cells"))


def metrics_summary(spark, sf_dir):
    """The JSON document of all metrics, read again."""
    grid = distribution.one_percent(distribution.aoo_grid(distribution.rectangle_extents(rectangles(spark, sf_dir))))
    metrics = distribution.assembled(grid.select("ecosystem"), grid, grid.select("ecosystem", F.lit(0.0).alias("eoo_km2")))
    schema = "ecosystems array<struct<ecosystem:string,aoo_cells:long,occupied_cell_count:long>>, overfull_cells long, grid_crs string, cell_size_m double"
    doc = distribution.summary(metrics).select(F.from_json("summary", schema).alias("d")).select("d.*")
    return doc.select(F.posexplode("ecosystems").alias("position", "e"), "overfull_cells", "grid_crs", "cell_size_m").select("position", "e.ecosystem", "e.aoo_cells", "e.occupied_cell_count", "overfull_cells", "grid_crs", "cell_size_m")


def _raster(spark, sf_dir) -> str:
    """Nations as blocks of 16 pixels of 3 km, valued by region: a deflated raster with differenced rows."""
    region = {r["n_nationkey"]: r["n_regionkey"] for r in read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect()}  # 25 rows
    r, c = np.mgrid[0:120, 0:160]
    values = np.vectorize(lambda k: region.get(k, -1) + 1)((c // 16 + 10 * (r // 16)) % 25).astype("u1")
    path = f"{shared_dir(spark)}/regions.tif"
    raster.write_tiled(path, values, 32, (500.0, 1000500.0), 3000.0, predictor=2)
    return path


def raster_scan(spark, sf_dir):
    return raster.pixels(spark, _raster(spark, sf_dir)).select("px_col", "px_row", F.col("value").cast("int").alias("value"))


def raster_window(spark, sf_dir):
    """A window that reaches over the raster's edge is cut to it."""
    return raster.pixels(spark, _raster(spark, sf_dir), (100, 90, 100, 100)).select("px_col", "px_row", F.col("value").cast("int").alias("value"))


def raster_classes(spark, sf_dir):
    """All classes of a raster file in one pass."""
    extents = raster.raster_class_extents(spark, _raster(spark, sf_dir), {k + 1: f"R{k}" for k in range(5)})
    out = distribution.one_percent(distribution.aoo_grid(extents))
    return out.select("ecosystem", "aoo_cells", "occupied_cell_count", F.round(F.col("total_extent") / 1e6, 3).alias("total_km2"))


def raster_mask(spark, sf_dir):
    """One class, masked by value."""
    out = distribution.one_percent(distribution.aoo_grid(raster.raster_mask_extents(spark, _raster(spark, sf_dir), 3, "R2")))
    return out.select("ecosystem", "aoo_cells", "occupied_cell_count", F.round(F.col("total_extent") / 1e6, 3).alias("total_km2"))


def raster_array(spark, sf_dir):
    """A coverage array in memory: the part of each pixel that is covered."""
    r, c = np.mgrid[0:40, 0:30]
    grid = distribution.aoo_grid(raster.array_extents(spark, "A", ((r + c) % 5) / 4.0, (500.0, 1000500.0), (3000.0, -3000.0)))
    return grid.select(F.col("col").cast("long"), F.col("row").cast("long"), F.round("extent_m2", 1).alias("extent_m2"))


def thresholds_metadata(spark, sf_dir):
    t = categories.thresholds()
    rows = [(t["guidelines_version"], t["guidelines_year"], t["criteria_version"], c["id"], c["metric"], c["above_all"]) for c in t["criterion"]]
    return spark.createDataFrame(rows, "guidelines_version string, guidelines_year int, criteria_version string, criterion string, metric string, above_all string")


def criterion_b_results(spark, sf_dir):
    """The result of each sub-criterion: range and number of notes."""
    out, each = criteria.assess_criterion_b(evidence(spark, sf_dir)), None
    for c in ("B1", "B2", "B3"):
        one = criteria.result_of(out, c).select("id", F.lit(c).alias("criterion"), categories.display(F.col("result.range")).alias("category"), F.size("result.notes").cast("long").alias("n_notes"))
        each = one if each is None else each.unionByName(one)
    return each


def criterion_b_document(spark, sf_dir):
    """The JSON document of each assessment, read again; its notes are said once each."""
    schema = "overall string, is_threatened boolean, b1 string, b2 string, b3 string, notes array<string>, guidelines_version string"
    docs = criteria.documents(criteria.assess_criterion_b(evidence(spark, sf_dir))).select("id", F.from_json("document", schema).alias("d"))
    return docs.select("id", "d.overall", "d.is_threatened", "d.b1", "d.b2", "d.b3", (F.size("d.notes") == F.size(F.array_distinct("d.notes"))).alias("said_once"), "d.guidelines_version")


def criterion_b_cases(spark, sf_dir):
    """Assessments from loose input."""
    cases = [
        {"eoo_km2": 2000, "clauses": ["a=met"]}, {"eoo_km2": 2000.01, "clauses": ["a.i=MET"]}, {"eoo_km2": 50001, "clauses": [("b", "met")]}, {"aoo_cells": 2, "clauses": [("continuing_decline", "met")]},
        {"aoo_cells": 51, "clauses": ["a=met"]}, {"eoo_km2": 1500, "locations_insufficient_information": True}, {"eoo_km2": 1500, "eoo_bounds": (3000, 1000), "clauses": ["a=met"]},
        {"locations": 4, "clauses": ["b3_rapid_collapse=met"]}, {"no_plausible_threats": True}, {}, {"eoo_km2": float("nan"), "aoo_cells": 10, "clauses": ["a=not_met", "b=not_met"], "locations": 5},
        {"eoo_km2": 1500, "clauses": ["a=not_met", "b=not_met"], "locations": 11},
    ]
    return criteria.assess_cases(spark, cases).select("case", "b1", "b2", "b3", "overall", "overall_code", "is_threatened")


QUERIES = {
    f.__name__: f
    for f in (
        geoparquet_scan, geoparquet_ecosystem_filter, geoparquet_bbox_filter, geoparquet_datasets_folded, geoparquet_inspect, geoparquet_read_plan, geoparquet_read_report, geoparquet_structure,
        odd_features, many_vertices, projected_rings, cells_in_order, overfull_cells, unexpected_cells, strict_extents, metrics_summary, raster_scan, raster_window, raster_classes, raster_mask, raster_array,
        thresholds_metadata, criterion_b_results, criterion_b_document, criterion_b_cases,
        distribution_to_category, project_points, project_points_sql_function, cell_assign, occupied_cells, aoo_one_percent, polygon_hole_extent,
        wkb_roundtrip, eoo_hull, raster_aoo, category_dim, criterion_dim, thresholds_table, classify_b1, classify_b2, classify_estimate, gate_levels,
        criterion_b, note_sentences, polygon_metrics, ecosystem_filter, bbox_filter, geojson_scan, geojson_files, top_ecosystems, ecosystems_listed, multi_dataset_union, byte_ranges_merged,
    )
}

_BOXES = "q AS (SELECT s_suppkey AS id, CAST(s_suppkey AS DOUBLE) % 300 - 150e0 AS w, CAST(s_suppkey AS DOUBLE) % 90 - 45e0 AS s FROM supplier)"
_SPOTS = "spots AS (SELECT ecosystem, x - 500e0 AS x0, y - 500e0 AS y0, x + 500e0 AS x1, y + 500e0 AS y1 FROM pp)"
_POINTS_SQL = f"WITH {PROJECTED} SELECT id, round(x, 3) AS x, round(y, 3) AS y FROM pp"
_CLASS_E = _class("eoo_km2", (2000, 20000, 50000))
_CLASS_C = _class("aoo_cells", (2, 20, 50))
ORACLE_SQL = {
    "project_points": _POINTS_SQL,
    "project_points_sql_function": _POINTS_SQL,
    "cell_assign": f'WITH {PROJECTED} SELECT id, CAST(floor(x / 10000e0) AS INTEGER) AS col, CAST(floor(y / 10000e0) AS INTEGER) AS "row" FROM pp',
    "occupied_cells": f'WITH {RECTANGLES}, {cells_sql("r")} SELECT ecosystem, col, "row", round(extent_m2, 1) AS extent_m2, round(extent_m2 / 1e8, 7) AS fraction FROM grid',
    "aoo_one_percent": f"WITH {RECTANGLES}, {cells_sql('r')} SELECT * FROM aoo",
    "polygon_hole_extent": f"WITH {_BOXES} SELECT 'S' || id AS ecosystem, round(({AXIS!r}e0 * radians(0.5e0) * ({_north('s + 0.25e0')} - {_north('s')}) - {AXIS!r}e0 * radians(0.25e0) * ({_north('s + 0.1875e0')} - {_north('s + 0.0625e0')})) / 1e6, 3) AS area_km2 FROM q",
    "wkb_roundtrip": f"WITH {_BOXES} SELECT CAST(4 AS BIGINT) AS n_vertices, w AS x0, w + 0.5e0 AS x1, s AS y0, s + 0.25e0 AS y1 FROM q",
    "raster_aoo": f"""WITH p AS (SELECT 'C' || CAST(floor(value / 50e0) AS BIGINT) AS ecosystem, event_id % 100 AS c, CAST(floor(event_id / 100e0) AS BIGINT) AS r FROM events),
px AS (SELECT ecosystem, 500e0 + c * 1000e0 AS x0, 500e0 + (c + 1) * 1000e0 AS x1, 1000500e0 - (r + 1) * 1000e0 AS y0, 1000500e0 - r * 1000e0 AS y1 FROM p), {cells_sql("px")}
SELECT ecosystem, aoo_cells, occupied_cell_count, round(t / 1e6, 3) AS total_km2 FROM aoo JOIN (SELECT ecosystem AS g, sum(extent_m2) AS t FROM grid GROUP BY 1) ON g = ecosystem""",
    # fixed values: categories, sub-criteria and thresholds as published, written out
    "category_dim": """SELECT * FROM (VALUES (0, 'CO', 'Collapsed', 0, 0, 0, true), (1, 'CR', 'Critically Endangered', 255, 0, 0, true), (2, 'EN', 'Endangered', 255, 165, 0, true),
(3, 'VU', 'Vulnerable', 255, 255, 0, true), (4, 'NT', 'Near Threatened', 173, 255, 47, false), (5, 'LC', 'Least Concern', 0, 128, 0, false),
(6, 'DD', 'Data Deficient', 128, 128, 128, false), (7, 'NE', 'Not Evaluated', 255, 255, 255, false)) AS t(rank, code, name, red, green, blue, is_threatened)""",
    "criterion_dim": """SELECT * FROM (VALUES (0, 'A1', 'A'), (1, 'A2a', 'A'), (2, 'A2b', 'A'), (3, 'A3', 'A'), (4, 'B1', 'B'), (5, 'B2', 'B'), (6, 'B3', 'B'), (7, 'C1', 'C'), (8, 'C2a', 'C'),
(9, 'C2b', 'C'), (10, 'C3', 'C'), (11, 'D1', 'D'), (12, 'D2a', 'D'), (13, 'D2b', 'D'), (14, 'D3', 'D'), (15, 'E', 'E')) AS t(position, code, parent)""",
    "thresholds_table": """SELECT * FROM (VALUES ('B1', 'CR', 2000e0, -1), ('B1', 'EN', 20000e0, -1), ('B1', 'VU', 50000e0, -1), ('B2', 'CR', 2e0, -1), ('B2', 'EN', 20e0, -1), ('B2', 'VU', 50e0, -1),
('B1', 'CR', -1e0, 1), ('B1', 'EN', -1e0, 5), ('B1', 'VU', -1e0, 10), ('B2', 'CR', -1e0, 1), ('B2', 'EN', -1e0, 5), ('B2', 'VU', -1e0, 10), ('B3', 'VU', -1e0, 4)) AS t(criterion, category, max_metric, max_locations)""",
    "thresholds_metadata": "SELECT * FROM (VALUES ('2.0', 2024, '2.1', 'B1', 'eoo_km2', 'LC'), ('2.0', 2024, '2.1', 'B2', 'aoo_cells', 'LC'), ('2.0', 2024, '2.1', 'B3', 'none', 'LC')) AS t(guidelines_version, guidelines_year, criteria_version, criterion, metric, above_all)",
    "classify_b1": f"SELECT o_orderkey, ({_CODES})[{_class('o_totalprice / 8e0', (2000, 20000, 50000))} + 1] AS category FROM orders",
    "classify_b2": f"SELECT o_orderkey, ({_CODES})[{_class('o_custkey % 60', (2, 20, 50))} + 1] AS category FROM orders",
    "classify_estimate": f"""WITH v AS (SELECT o_orderkey, o_totalprice / 8e0 AS v, o_orderkey % 3 <> 0 AS both_ FROM orders),
e AS (SELECT o_orderkey, v, CASE WHEN both_ THEN v * 0.5e0 ELSE v END AS lo, CASE WHEN both_ THEN v * 1.5e0 ELSE v END AS hi FROM v),
t AS (SELECT *, {_class("v", (2000, 20000, 50000))} AS t, {_class("hi", (2000, 20000, 50000))} AS t_least, {_class("lo", (2000, 20000, 50000))} AS t_most FROM e)
SELECT o_orderkey, lo AS lower, hi AS upper, {_shown("t")} AS category FROM t""",
    "gate_levels": f"WITH {_BASE} SELECT k AS id, "
    + ", ".join(f"{_gate(n, False)} AS {lv}_met, {_gate(n, True)} AND NOT {_gate(n, False)} AS {lv}_unknown" for lv, n in (("cr", 1), ("en", 5), ("vu", 10)))
    + ", CASE WHEN a = 'not_assessed' THEN 'a' ELSE '' END || CASE WHEN b = 'not_assessed' THEN 'b' ELSE '' END || CASE WHEN kind = 'not_assessed' THEN 'c' ELSE '' END AS pending FROM st",
    "criterion_b": f"WITH {ASSESSED} SELECT k AS id, {_shown('b1')} AS b1, {_shown('b2')} AS b2, {_shown('b3')} AS b3, {_shown('o')} AS overall, o <= 3 AS is_threatened, CAST({_note_count('e', 'elo', (2000, 20000, 50000))} + {_note_count('c', 'clo', (2, 20, 50))} + {_NOTES3} AS BIGINT) AS n_notes, {_T1} AS b1_threshold FROM overall",
    "ecosystem_filter": "SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#11', 'Brand#22', 'Brand#33')",
    "bbox_filter": f"WITH {RECTANGLES} SELECT ecosystem, id FROM r WHERE x0 <= 100000 AND x1 >= -100000 AND y0 <= 50000 AND y1 >= -50000",
    "geojson_scan": f"WITH {_BOXES} SELECT 'E' || id AS ecosystem, CAST(4 AS BIGINT) AS n_vertices, w AS west, s AS south, w + 0.5e0 AS east, s + 0.25e0 AS north FROM q",
    "top_ecosystems": f"WITH {RECTANGLES}, {cells_sql('r')} SELECT ecosystem, occupied_cell_count FROM aoo ORDER BY 2 DESC, 1 LIMIT 15",
    "ecosystems_listed": f"WITH {RECTANGLES} SELECT DISTINCT ecosystem FROM r",
    "multi_dataset_union": f"WITH {RECTANGLES}, {cells_sql('r')} SELECT ecosystem, count(*) AS cells, round(sum(extent_m2) / 1e6, 3) AS km2 FROM grid GROUP BY 1",
    "eoo_hull": f"WITH {PROJECTED}, {HULLS} SELECT ecosystem, round(eoo_km2, 2) AS eoo_km2 FROM hull",
    "distribution_to_category": f"""WITH {PROJECTED}, {HULLS}, {_SPOTS}, {cells_sql("spots")},
m AS (SELECT h.ecosystem, eoo_km2, aoo_cells, {_CLASS_E} AS b1, {_CLASS_C} AS b2 FROM hull h JOIN aoo ON aoo.ecosystem = h.ecosystem)
SELECT ecosystem, round(eoo_km2, 1) AS eoo_km2, aoo_cells, ({_CODES})[b1 + 1] AS b1, ({_CODES})[b2 + 1] AS b2, 'NE' AS b3, ({_CODES})[least(b1, b2) + 1] AS overall, least(b1, b2) <= 3 AS is_threatened FROM m""",
    "polygon_metrics": f"""WITH {_BOXES}, m AS (SELECT 'E' || id AS ecosystem, {AXIS!r}e0 * radians(w) AS x0, {AXIS!r}e0 * radians(w + 0.5e0) AS x1, {_north("s")} AS y0, {_north("s + 0.25e0")} AS y1 FROM q), {cells_sql("m")}
SELECT m.ecosystem, round((x1 - x0) * (y1 - y0) / 1e6, 2) AS eoo_km2, occupied_cell_count FROM m JOIN aoo ON aoo.ecosystem = m.ecosystem""",
    "byte_ranges_merged": """WITH r AS (SELECT p_partkey % 25 AS file, CAST(floor(p_partkey / 25e0) AS BIGINT) * 100 AS start, CAST(floor(p_partkey / 25e0) AS BIGINT) * 100 + p_size * 4 AS stop FROM part),
m AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY file ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM r),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT file, min(start) AS start, max(stop) AS stop FROM i GROUP BY file, island""",
}

_PLACES = f"{FOOTPRINTS}, places AS (SELECT ecosystem, id, lon AS x0, lat AS y0, lon + 0.05e0 AS x1, lat + 0.05e0 AS y1 FROM fp)"
_CORNERS = "SELECT ecosystem, CAST(4 AS BIGINT) AS n_vertices, round(x0, 8) AS west, round(y0, 8) AS south FROM places"
_SOME = "('N3', 'N7', 'N11', 'N99')"
_METRES = f"SELECT ecosystem, id, {AXIS!r}e0 * radians(x0) AS x0, {AXIS!r}e0 * radians(x1) AS x1, {_north('y0')} AS y0, {_north('y1')} AS y1 FROM places"
_GROUPS = f"""{_PLACES}, numbered AS (SELECT ecosystem, CAST((row_number() OVER (ORDER BY ecosystem) - 1) // 100 AS INTEGER) AS row_group FROM places),
groups AS (SELECT row_group, count(*) AS rows, min(ecosystem) AS first_ecosystem, max(ecosystem) AS last_ecosystem FROM numbered GROUP BY 1),
planned AS (SELECT *, {" OR ".join(f"'{e}' BETWEEN first_ecosystem AND last_ecosystem" for e in SOME)} AS read FROM groups)"""
_REGIONS = """px AS (SELECT CAST(c AS INTEGER) AS px_col, CAST(r AS INTEGER) AS px_row, CAST(n_regionkey + 1 AS INTEGER) AS value
  FROM (SELECT unnest(generate_series(0, 159)) AS c) CROSS JOIN (SELECT unnest(generate_series(0, 119)) AS r) JOIN nation ON n_nationkey = (c // 16 + 10 * (r // 16)) % 25)"""
_PIXELS = "500e0 + px_col * 3000e0 AS x0, 500e0 + (px_col + 1) * 3000e0 AS x1, 1000500e0 - (px_row + 1) * 3000e0 AS y0, 1000500e0 - px_row * 3000e0 AS y1"
_TOTAL = "SELECT ecosystem, aoo_cells, occupied_cell_count, round(t / 1e6, 3) AS total_km2 FROM aoo JOIN (SELECT ecosystem AS g, sum(extent_m2) AS t FROM grid GROUP BY 1) ON g = ecosystem"
_LETTERS = "array_to_string(list_filter([CASE WHEN a = 'not_assessed' THEN '(a)' END, CASE WHEN b = 'not_assessed' THEN '(b)' END, CASE WHEN kind = 'not_assessed' THEN '(c)' END], lambda x: x IS NOT NULL), ', ')"


def _notes_sql(v: str, lo: str, bounds) -> str:
    """Two selects: the sentence on the metric or the sub-conditions, and the one on Near Threatened."""
    early = f"{v} IS NULL OR {_class(lo, bounds)} = 5 OR (kind = 'insufficient_information' AND a <> 'met' AND b <> 'met')"
    # fixed values: the sentences of notes
    return f"""SELECT CASE WHEN {v} IS NULL THEN 'no metric was supplied, so this criterion could not be evaluated' WHEN {_class(lo, bounds)} = 5 THEN 'the metric exceeds every threshold, so this criterion is not triggered'
  WHEN {early} THEN 'threats exist but the number of threat-defined locations could not be assessed, so this sub-criterion is Data Deficient'
  WHEN {_PENDING} > 0 THEN 'sub-condition' || CASE WHEN {_PENDING} = 1 THEN '' ELSE 's' END || ' ' || {_LETTERS} || ' not assessed, so the listing is provisional'
  WHEN {_level(lo, bounds, True)} = 5 THEN 'every sub-condition was assessed and none is met, so this criterion is not triggered' END AS note FROM overall
UNION ALL SELECT CASE WHEN NOT ({early}) AND kind = 'count' AND n <= 9 THEN {_near_sql(9)} END FROM overall"""


def _near_sql(bound: int) -> str:
    return f"'with n threat-defined locations (<= {bound}), Near Threatened may apply under Guidelines Box 13 step 6(iv) if information is insufficient and less than 30% of the distribution is unthreatened'"


ORACLE_SQL |= {
    "note_sentences": f"""WITH {ASSESSED}, said AS ({_notes_sql("e", "elo", (2000, 20000, 50000))} UNION ALL {_notes_sql("c", "clo", (2, 20, 50))}
UNION ALL SELECT CASE WHEN b3 = 7 OR (b3 = 3 AND b3_least = 5) THEN 'B3 requires both very few threat-defined locations and capability of rapid collapse; at least one limb is unassessed'
  WHEN b3 = 6 THEN 'threats exist but the number of threat-defined locations could not be assessed, so this sub-criterion is Data Deficient' END FROM overall
UNION ALL SELECT CASE WHEN b3 < 6 AND kind = 'count' AND n <= 4 THEN {_near_sql(4)} END FROM overall)
SELECT note, count(*) AS n FROM said WHERE note IS NOT NULL GROUP BY 1""",
    "geoparquet_scan": f"WITH {_PLACES} {_CORNERS}",
    "geojson_files": f"WITH {_PLACES} {_CORNERS}",
    "geoparquet_ecosystem_filter": f"WITH {_PLACES} {_CORNERS} WHERE ecosystem IN {_SOME}",
    "geoparquet_bbox_filter": f"WITH {_PLACES} {_CORNERS} WHERE x0 <= {BOX[2]!r} AND x1 >= {BOX[0]!r} AND y0 <= {BOX[3]!r} AND y1 >= {BOX[1]!r}",
    "geoparquet_datasets_folded": f"WITH {_PLACES}, m AS ({_METRES}), {cells_sql('m')} SELECT ecosystem, aoo_cells, occupied_cell_count, overfull_cells FROM aoo",
    "geoparquet_inspect": f"WITH {_PLACES} SELECT count(*) AS features, round(min(x0), 8) AS xmin, round(min(y0), 8) AS ymin, round(max(x1), 8) AS xmax, round(max(y1), 8) AS ymax, min(ecosystem) AS first_ecosystem, max(ecosystem) AS last_ecosystem, 'OGC:CRS84' AS crs FROM places",
    "geoparquet_read_plan": f"WITH {_GROUPS} SELECT * FROM planned",
    "geoparquet_read_report": f"WITH {_GROUPS} SELECT count(*) FILTER (WHERE read) AS groups_read, count(*) FILTER (WHERE NOT read) AS groups_skipped, (SELECT count(*) FROM places WHERE ecosystem IN {_SOME}) AS features, count(*) FILTER (WHERE NOT read) > 0 AS reads_less, true AS ranges_agree FROM planned",
    "geoparquet_structure": "SELECT * FROM (VALUES ('note', 'no CRS is stated, which means OGC:CRS84'), ('column', 'ecosystem BYTE_ARRAY'), ('column', 'geometry BYTE_ARRAY'), ('column', 'bbox.xmin DOUBLE'), ('column', 'bbox.ymin DOUBLE'), ('column', 'bbox.xmax DOUBLE'), ('column', 'bbox.ymax DOUBLE')) AS t(severity, message)",
    "odd_features": f"""WITH {_PLACES}, two AS (SELECT CASE WHEN id % 7 = 0 THEN '' ELSE ecosystem END AS ecosystem, id, x0, x1, y0 + up AS y0, y1 + up AS y1 FROM places CROSS JOIN (VALUES (0e0), (1e0)) AS u(up) WHERE id % 5 <> 0)
SELECT ecosystem, round(sum({AXIS!r}e0 * radians(x1 - x0) * ({_north("y1")} - {_north("y0")})) / 1e6, 3) AS km2 FROM two GROUP BY 1""",
    "many_vertices": f"""WITH {FOOTPRINTS}, v AS (SELECT ecosystem, id, i, lon + (1 + id % 5) * 0.05e0 * cos(i * pi() / 20e0) AS lon, lat + (1 + id % 5) * 0.05e0 * sin(i * pi() / 20e0) AS lat FROM fp CROSS JOIN (SELECT unnest(generate_series(0, 40)) AS i)),
m AS (SELECT ecosystem, id, i, {AXIS!r}e0 * radians(lon) AS x, {_north("lat")} AS y FROM v),
e AS (SELECT ecosystem, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM m WINDOW w AS (PARTITION BY id ORDER BY i))
SELECT ecosystem, round(sum((nx - x) * -(ny + y) / 2e0) / 1e6, 2) AS km2 FROM e WHERE nx IS NOT NULL GROUP BY 1""",
    "projected_rings": f"WITH {_PLACES} SELECT id, round(x0, 3) AS x0, round(y0, 3) AS y0, round(x1, 3) AS x1, round(y1, 3) AS y1 FROM ({_METRES})",
    "cells_in_order": f"""WITH {RECTANGLES}, {cells_sql("r")} SELECT col, "row", round(extent_m2 / 1e8, 7) AS fraction FROM grid WHERE ecosystem = 'Brand#22' ORDER BY 1, 2""",
    "overfull_cells": f"""WITH {RECTANGLES}, {cells_sql("r")} SELECT ecosystem, col, "row" FROM grid WHERE overfull""",
    "unexpected_cells": f"""WITH {RECTANGLES}, {cells_sql("r")} SELECT ecosystem, col, "row", 'extra' AS side FROM grid WHERE NOT EXISTS (
  SELECT 1 FROM r WHERE r.id % 2 = 0 AND r.ecosystem = grid.ecosystem AND least(x1, (col + 1) * 10000e0) > greatest(x0, col * 10000e0) AND least(y1, ("row" + 1) * 10000e0) > greatest(y0, "row" * 10000e0))""",
    "strict_extents": f"WITH {RECTANGLES}, {cells_sql('r')} SELECT ecosystem, round(sum(extent_m2) / 1e6, 4) AS km2, count(*) AS cells FROM grid GROUP BY 1",
    "metrics_summary": f"WITH {RECTANGLES}, {cells_sql('r')} SELECT CAST(row_number() OVER (ORDER BY ecosystem) - 1 AS INTEGER) AS position, ecosystem, aoo_cells, occupied_cell_count, CAST(sum(overfull_cells) OVER () AS BIGINT) AS overfull_cells, 'ESRI:54034' AS grid_crs, 10000e0 AS cell_size_m FROM aoo",
    "raster_scan": f"WITH {_REGIONS} SELECT * FROM px",
    "raster_window": f"WITH {_REGIONS} SELECT * FROM px WHERE px_col >= 100 AND px_row >= 90",
    "raster_classes": f"WITH {_REGIONS}, b AS (SELECT 'R' || (value - 1) AS ecosystem, {_PIXELS} FROM px), {cells_sql('b')} {_TOTAL}",
    "raster_mask": f"WITH {_REGIONS}, b AS (SELECT 'R2' AS ecosystem, {_PIXELS} FROM px WHERE value = 3), {cells_sql('b')} {_TOTAL}",
    "raster_array": f"""WITH a AS (SELECT c AS px_col, r AS px_row, ((r + c) % 5) / 4e0 AS w FROM (SELECT unnest(generate_series(0, 29)) AS c) CROSS JOIN (SELECT unnest(generate_series(0, 39)) AS r)),
b AS (SELECT 'A' AS ecosystem, w, {_PIXELS} FROM a WHERE w > 0), {cells_sql("b", "w")} SELECT col, "row", round(extent_m2, 1) AS extent_m2 FROM grid""",
    "criterion_b_results": f"""WITH {ASSESSED} SELECT k AS id, 'B1' AS criterion, {_shown("b1")} AS category, CAST({_note_count("e", "elo", (2000, 20000, 50000))} AS BIGINT) AS n_notes FROM overall
UNION ALL SELECT k, 'B2', {_shown("b2")}, CAST({_note_count("c", "clo", (2, 20, 50))} AS BIGINT) FROM overall UNION ALL SELECT k, 'B3', {_shown("b3")}, CAST({_NOTES3} AS BIGINT) FROM overall""",
    "criterion_b_document": f"WITH {ASSESSED} SELECT k AS id, {_shown('o')} AS overall, o <= 3 AS is_threatened, {_shown('b1')} AS b1, {_shown('b2')} AS b2, {_shown('b3')} AS b3, true AS said_once, '2.0' AS guidelines_version FROM overall",
    "criterion_b_cases": """SELECT * FROM (VALUES (0, 'CR', 'NE', 'NE', 'CR', 'CR', true), (1, 'EN', 'NE', 'NE', 'EN', 'EN', true), (2, 'LC', 'NE', 'NE', 'LC', 'LC', false), (3, 'NE', 'CR', 'NE', 'CR', 'CR', true),
(4, 'NE', 'LC', 'NE', 'LC', 'LC', false), (5, 'DD', 'NE', 'DD', 'DD', 'DD', false), (6, 'CR (EN-CR)', 'NE', 'NE', 'CR (EN-CR)', 'CR', true), (7, 'NE', 'NE', 'VU', 'VU', 'VU', true), (8, 'NE', 'NE', 'LC', 'LC', 'LC', false),
(9, 'NE', 'NE', 'NE', 'NE', 'NE', false), (10, 'NE', 'EN', 'LC', 'EN', 'EN', true), (11, 'LC', 'NE', 'LC', 'LC', 'LC', false)) AS t("case", b1, b2, b3, overall, overall_code, is_threatened)""",
}
