import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from ecorisk.functions import geometry, spatial
from ecorisk.operators import distribution as d
from ecorisk.sources import geojson, geoparquet, raster
from ecorisk.streaming.fold import Assessment, start


def square(lon, lat, size):
    return [[lon, lat], [lon + size, lat], [lon + size, lat + size], [lon, lat + size]]


def test_projection(spark):
    # fixed values: points of an independent implementation
    points = [(0.0, 0.0, 0.0, 0.0), (1.0, 1.0, 111319.49079327357, 110568.81239991242), (-1.0, -1.0, -111319.49079327357, -110568.81239991207), (180.0, 0.0, 20037508.342789244, 0.0)]
    df = spark.createDataFrame(points, "lon double, lat double, x double, y double")
    for r in df.withColumns({"px": spatial.project_x(F.col("lon"), F.col("lat")), "py": spatial.project_y(F.col("lon"), F.col("lat"))}).collect():
        assert abs(r.px - r.x) < 1e-8 and abs(r.py - r.y) < 1e-8
    own = geometry.project(np.array([[p[0], p[1]] for p in points]))
    assert np.allclose(own, [[p[2], p[3]] for p in points], atol=1e-8)
    assert np.isnan(geometry.project(np.array([[np.inf, 0.0]]))).all()


def test_one_degree_square(spark):
    row = d.distribution_metrics(d.features(spark, {"T1": [[square(0, 0, 1)]]})).first()
    assert (row.occupied_cell_count, row.aoo_cells) == (144, 128) and abs(row.eoo_km2 - 12308.46) < 0.01
    assert json.loads(d.summary(d.distribution_metrics(d.features(spark, [("T1", [square(0, 0, 1)])]))).first().summary)["cell_size_m"] == 10000


# fixed values: published cases of the 1 % rule
@pytest.mark.parametrize("extents, expected", [([0.5] * 4, (4, 4)), ([0.001, 1], (1, 2)), ([1, 99], (1, 2)), ([0, 0, 5], (1, 1)), ([1.0] * 145 + [0.1] * 10, (145, 155))])
def test_one_percent(spark, extents, expected):
    rows = spark.createDataFrame([("e", i, 0, float(x)) for i, x in enumerate(extents)], "ecosystem string, col int, row int, extent_m2 double")
    row = d.one_percent(d.aoo_grid(rows)).first()
    assert (row.aoo_cells, row.occupied_cell_count) == expected
    assert row.near_boundary == (extents == [1, 99])


def test_area_is_conserved():
    rng = np.random.default_rng(1)
    for _ in range(20):
        ring = rng.uniform(-60000, 60000, (3, 2))
        assert math.isclose(sum(geometry.cell_extents([ring]).values()), abs(geometry.area(ring)), rel_tol=1e-9)


def test_hull_merges_in_any_order():
    line = np.array([[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]])
    assert len(geometry.hull(line)) == 2 and geometry.area(geometry.hull(line)) == 0
    points = np.random.default_rng(2).normal(size=(200, 2))
    whole, parts = geometry.hull(points), geometry.hull(np.concatenate([geometry.hull(points[:90]), geometry.hull(points[90:])]))
    assert np.allclose(whole, parts) and geometry.area(whole) > 0


def test_wkb():
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]
    big = struct.pack(">BII", 0, 3, 1) + struct.pack(">I", 3) + struct.pack(">6d", *[c for p in ring for c in p])
    assert geometry.read_wkb(big)[0][0].tolist() == [list(p) for p in ring]
    z = struct.pack("<BII", 1, 1003, 1) + struct.pack("<I", 3) + struct.pack("<9d", *[c for p in ring for c in (*p, 7.0)])
    assert geometry.read_wkb(z)[0][0].tolist() == [list(p) for p in ring]
    srid = struct.pack("<BIII", 1, 3 | 0x20000000, 4326, 1) + struct.pack("<I", 3) + struct.pack("<6d", *[c for p in ring for c in p])
    assert len(geometry.read_wkb(srid)[0][0]) == 3
    assert len(geometry.read_wkb(geometry.write_wkb([[ring], [ring]]))) == 2
    for bad in (b"", big[:-1], b"\x07" + big[1:], struct.pack("<BI", 1, 1), struct.pack("<BII", 1, 3, 1 << 30)):
        with pytest.raises(geometry.GeometryError):
            geometry.read_wkb(bad)


def test_holes_overlaps_and_refusals(spark):
    holed = d.features(spark, [("h", [square(0, 0, 1), square(0.25, 0.25, 0.5)])])
    whole = d.features(spark, [("h", [square(0, 0, 1)])])
    hole = d.features(spark, [("h", [square(0.25, 0.25, 0.5)])])
    area = [d.polygon_extents(x).agg(F.sum("extent_m2")).first()[0] for x in (holed, whole, hole)]
    assert math.isclose(area[0], area[1] - area[2], rel_tol=1e-9)
    twice = d.distribution_metrics(whole.union(whole)).first()
    assert twice.overfull_cells > 0 and twice.occupied_cell_count == 144
    for bad in ([("x", [])], [("x", [[]])], [("x", [[[0, 91], [1, 1], [2, 2]]])], [("x", [[[float("nan"), 1], [1, 1], [2, 2]]])]):
        with pytest.raises(ValueError):
            d.features(spark, bad)


def test_geoparquet(spark, tmp_path):
    path = str(tmp_path / "map")
    pairs = [(f"E{k}", [square(10 * k, 0, 0.5)]) for k in range(8)]
    geoparquet.write(d.features(spark, pairs).repartition(2), path, row_group=2)
    assert geoparquet.read(spark, path, "ecosystem").count() == 8
    assert geoparquet.read(spark, path, "ecosystem", ecosystems=["E1", "E9"]).count() == 1
    some = geoparquet.read(spark, path, "ecosystem", bbox=(9, 0, 21, 1))
    assert sorted(r.ecosystem for r in some.collect()) == ["E1", "E2"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "bbox.xmin" in plan.split("PushedFilters")[1]
    assert geoparquet.inspect(spark, path).agg(F.sum("rows")).first()[0] == 8
    assert geoparquet.read_plan(spark, path, "ecosystem", ecosystems=["E1"]).where("read").count() < geoparquet.inspect(spark, path).count()
    assert geoparquet.check_structure(spark, path).where("severity = 'error'").count() == 0
    whole = geoparquet.read_report(spark, path, "ecosystem").first()
    part = geoparquet.read_report(spark, path, "ecosystem", ecosystems=["E1"]).first()
    assert (whole.groups_skipped, whole.features, part.features) == (0, 8, 1) and part.bytes_planned < whole.bytes_planned == whole.bytes_total
    assert geoparquet.largest_group(spark, path).count() == 1 and geoparquet.schema_of(spark, path).where("is_geometry").first().column == "geometry"
    metrics, report = geoparquet.distribution_from(spark, [path, path], "ecosystem", bbox=(9, 0, 21, 1))
    assert metrics.count() == 2 and report.agg(F.sum("features")).first()[0] == 4
    ranges = spark.createDataFrame([("a", 0, 10), ("a", 10, 20), ("a", 15, 18), ("a", 21, 30), ("b", 5, 6)], "file string, start long, stop long")
    assert sorted(map(tuple, geoparquet.merged_ranges(ranges).collect())) == [("a", 0, 20), ("a", 21, 30), ("b", 5, 6)]
    with pytest.raises(ValueError, match="there are"):
        geoparquet.read(spark, path, "code")
    assert "data.source.coop" in geoparquet.failure_hint("https://source.coop/x")


def test_geo_layout(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    good = {"version": "1.1.0", "primary_column": "g", "columns": {"g": {"encoding": "WKB", "geometry_types": ["Polygon", "Polygon Z"], "edges": "planar", "bbox": [0, 0, 1, 1], "epoch": 2020.5, "covering": {"bbox": {k: ["b", k] for k in ("xmin", "ymin", "xmax", "ymax")}}}}}

    def found(**changes):
        doc = json.loads(json.dumps(good))
        doc["columns"]["g"] |= changes.pop("g", {})
        doc |= changes
        pq.write_table(pa.table({"g": [b""]}).replace_schema_metadata({"geo": json.dumps(doc)}), str(tmp_path / "x.parquet"))
        return [m for _, m in geoparquet.schema_findings(pq.read_metadata(str(tmp_path / "x.parquet")))]

    assert found() == []
    assert found(version="9.9") == ["version '9.9' has no known layout"]
    for g, said in (({"encoding": "point"}, None), ({"encoding": "WKT"}, "encoding"), ({"geometry_types": ["Blob"]}, "Blob"), ({"geometry_types": None}, "no list"), ({"edges": "round"}, "edges"), ({"bbox": [1, 2]}, "bbox"), ({"epoch": "now"}, "epoch"), ({"covering": {"bbox": {}}}, "covering"), ({"crs": "EPSG:4326"}, "PROJJSON")):
        assert (found(g=g) == []) if said is None else (len(found(g=g)) == 1 and said in found(g=g)[0])
    assert found(version="1.0.0", g={"encoding": "point"}) and found(columns={}) == ["`columns` describes no column"]


def test_geojson(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [{"properties": {"ECO_CODE": "A"}, "geometry": {"type": "Polygon", "coordinates": [square(0, 0, 1)]}}, {"properties": {"ECO_CODE": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square(2, 0, 1)], [square(4, 0, 1)]]}}]}
    (tmp_path / "a.geojson").write_text(json.dumps(doc))
    out = {r.ecosystem: r for r in d.distribution_metrics(geojson.read(spark, str(tmp_path / "a.geojson"))).collect()}
    assert out["A"].occupied_cell_count == 144 and out["B"].eoo_km2 > 3 * out["A"].eoo_km2 * 0.99


def test_geojson_is_streamed(spark, tmp_path):
    doc = {"name": 'a "features": [ in a text', "n": 12, "features": [{"properties": {"ECO_CODE": f"E{k}"}, "geometry": {"type": "Polygon", "coordinates": [square(k, 0, 1) * (1 + 30 * (k % 3))]}} for k in range(25)], "more": None}
    text = json.dumps(doc, indent=1)
    for size in (1, 7, 1000, len(text)):
        got = list(geojson._features(iter([text[k : k + size] for k in range(0, len(text), size)])))
        assert got == doc["features"]
    for bad in ("", "[", '{"a": 1}', '{"features": [{"a": 1}', '{"features": 3}', '{"features": [{"a" 1}]}'):
        with pytest.raises(ValueError):
            list(geojson._features(iter([bad])))
    assert list(geojson._features(iter(['{"features": []}']))) == []
    for feature, said in (({"properties": {}}, "property"), ({"properties": {"c": "x"}, "geometry": {"type": "Point"}}, "no area"), ({"properties": {"c": "x"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0, 1]]]}}, "two numbers")):
        with pytest.raises(ValueError, match=said):
            geojson._polygons(feature, "c")
    path = str(tmp_path / "out")
    features = d.features(spark, [("A", [square(0, 0, 1)]), ("B", [square(5, 5, 1), square(5.2, 5.2, 0.1)])])
    geojson.write(features.repartition(2), path)
    same = geojson.read(spark, path)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, features.collect()))
    with pytest.raises(FileNotFoundError):
        geojson.read(spark, str(tmp_path / "nowhere"))


def test_raster(spark, tmp_path):
    y, x = np.mgrid[0:512, 0:512]
    values = (x // 64 + 8 * (y // 64)).astype("u1")
    for deflate in (True, False):
        path = str(tmp_path / f"r{deflate}.tif")
        raster.write_tiled(path, values, 256, (0.0, 0.0), 10000.0, deflate)
        spark.dataSource.register(raster.TiledRaster)
        df = spark.read.format("tiledraster").load(path)
        assert df.rdd.getNumPartitions() == 1  # small tiles share a task
        got = {(r.px_col, r.px_row): r.value for r in df.where("(px_col, px_row) IN ((255, 255), (256, 0), (0, 256), (511, 511), (300, 100))").collect()}
        assert got == {(255, 255): 27, (256, 0): 4, (0, 256): 32, (511, 511): 63, (300, 100): 12}
        assert spark.read.format("tiledraster").option("window", "250,250,10,10").load(path).count() == 100
    grid = d.aoo_grid(raster.raster_class_extents(spark, path, {27.0: "X", 12.0: "Y"}))
    assert {r.ecosystem: r.occupied_cell_count for r in d.one_percent(grid).collect()} == {"X": 4096, "Y": 4096}
    raster.write_tiled(path, values, 256, (0.0, 0.0), 1.0, keys={raster.MODEL: 2})
    with pytest.raises(Exception, match="equal-area"):
        spark.read.format("tiledraster").load(path).count()


def test_raster_window_mask_and_array(spark, tmp_path):
    values = (np.arange(64 * 48).reshape(48, 64) % 7).astype("i2")
    path = str(tmp_path / "p.tif")
    raster.write_tiled(path, values, 16, (0.0, 480000.0), 10000.0, predictor=2)
    h = raster.read_header(path)
    got = {(r.px_col, r.px_row): r.value for r in raster.pixels(spark, path, (60, 40, 100, 100)).collect()}
    assert got == {(c, r): values[r, c] for r in range(40, 48) for c in range(60, 64)}
    assert len(h.tiles((0, 0, 17, 1))) == 2 and h.tiles((64, 0, 5, 5)) == [] and len(raster.window_ranges(h)) == 1
    masked = d.aoo_grid(raster.raster_mask_extents(spark, path, 3, "three"))
    assert masked.count() == int((values == 3).sum()) and masked.where("fraction < 1").count() == 0
    same = d.aoo_grid(raster.array_extents(spark, "three", values == 3, h.origin, h.step))
    assert same.exceptAll(masked).count() == 0 and same.count() == masked.count()
    moved = d.aoo_grid(raster.array_extents(spark, "three", values[40:48, 60:64] == 3, h.origin, h.step, (60, 40)))
    assert moved.join(masked, ["col", "row"], "left_anti").count() == 0 and moved.count() == int((values[40:48, 60:64] == 3).sum())


def test_accessors(spark):
    df = d.features(spark, [("a", [square(0, 0, 1)]), ("a", [square(0, 0, 1)]), ("b", [square(5, 5, 0.01)])])
    extents, metrics = d.polygon_extents(df), d.distribution_metrics(df)
    own = [(r.col, r.row) for r in d.cells(extents, "a").collect()]
    assert own == sorted(own) and len(own) == 144 and d.cells(extents, "z").count() == 0
    assert d.metric_of(metrics, "a", "occupied_cell_count") == 144 and d.metric_of(metrics, "z", "eoo_km2") == 0
    assert d.overfull(extents).select("ecosystem").distinct().first().ecosystem == "a"
    expected = spark.createDataFrame([("b", 55, 55), ("b", 56, 55)], "ecosystem string, col int, row int")
    assert d.unexpected_cells(extents.where("ecosystem = 'b'"), expected).where("side = 'missing'").count() >= 1


def test_strict_sums_do_not_depend_on_order(spark):
    rng = np.random.default_rng(4)
    rows = [("e", 0, 0, float(x)) for x in 10.0 ** rng.uniform(-3, 6, 2000)]
    schema = "ecosystem string, col int, row int, extent_m2 double"
    sums = {d.aoo_grid(spark.createDataFrame(some, schema).repartition(n), strict=True).first().extent_m2 for n, some in ((1, rows), (7, rows[::-1]), (3, sorted(rows, key=lambda r: r[3])))}
    assert len(sums) == 1


def test_shared_folder():
    from types import SimpleNamespace as Some

    from ecorisk.storage import shared_dir

    def session(master, base):
        conf = Some(get=lambda k, default=None: {"spark.master": master, "spark.checkpoint.dir": base}.get(k, default))
        return Some(conf=Some(get=lambda k, default=None: base, set=lambda k, v: None), sparkContext=Some(getConf=lambda: conf))

    assert shared_dir(session("spark://h:7077", "/shared")).startswith("file:///shared/ecorisk-")
    assert shared_dir(session("local[2]", None)).startswith("file:///")
    with pytest.raises(ValueError, match="share"):
        shared_dir(session("local-cluster[2,1,1024]", None))


def test_fold(spark, tmp_path):
    pairs = [("A", [square(0, 0, 1)]), ("A", [square(3, 0, 1)]), ("B", [square(5, 5, 1)])]
    for k, p in enumerate(pairs):
        d.features(spark, [p]).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("ecosystem string, geometry binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = start(stream, str(tmp_path / "state"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.ecosystem, round(r.eoo_km2, 6), r.aoo_cells, r.occupied_cell_count)
    kept = Assessment(spark, str(tmp_path / "state"))
    expected = sorted(map(key, d.distribution_metrics(d.features(spark, pairs)).collect()))
    assert sorted(map(key, kept.metrics().collect())) == expected
    kept.fold(d.features(spark, pairs[:1]), 0)  # a batch folded before changes nothing
    assert sorted(map(key, kept.metrics().collect())) == expected
