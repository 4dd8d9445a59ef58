"""GeoJSON FeatureCollections: documents in a column by Spark's JSON functions, files as streams of features."""

from __future__ import annotations

import codecs
import json
import os

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ecorisk.functions.geometry import read_wkb, write_wkb

#: Characters read at a time, and features to a batch.
PIECE, BATCH = 1 << 20, 1000

FEATURES = "struct<type:string,features:array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>>"
RINGS = "array<array<array<double>>>"


def parse(texts: DataFrame, column: str = "value", ecosystem: str = "ECO_CODE") -> DataFrame:
    """(ecosystem, polygons ARRAY<rings>) of documents in a text column; only Polygon and MultiPolygon in two dimensions."""
    each = texts.select(F.explode(F.from_json(F.col(column), FEATURES)["features"]).alias("f")).select(
        F.col("f.properties")[ecosystem].alias("ecosystem"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c")
    )
    polygons = F.when(F.col("kind") == "Polygon", F.array(F.from_json("c", RINGS))).when(F.col("kind") == "MultiPolygon", F.from_json("c", f"array<{RINGS}>"))
    polygons = polygons.otherwise(F.raise_error(F.concat(F.lit("geometry has no area: "), F.coalesce("kind", F.lit("none")))))
    flat = F.forall(F.flatten(F.flatten("polygons")), lambda p: F.size(p) == 2)
    out = each.select("ecosystem", polygons.alias("polygons"))
    named = F.when(F.col("ecosystem").isNull(), F.raise_error(F.lit(f"a feature lacks the property {ecosystem}"))).otherwise(F.col("ecosystem"))
    checked = F.when(flat, F.col("polygons")).otherwise(F.raise_error(F.lit("positions must have two numbers")))
    return out.select(named.alias("ecosystem"), checked.alias("polygons"))


def to_features(polygons: DataFrame) -> DataFrame:
    """Polygon arrays as features with WKB geometry."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("ecosystem"), pa.array([write_wkb(p) for p in batch.column("polygons").to_pylist()], pa.binary())], ["ecosystem", "geometry"])

    return polygons.select("ecosystem", "polygons").mapInArrow(run, "ecosystem string, geometry binary")


def _features(pieces):
    """The features of one document that comes in pieces of text: no more of it is held than one feature and one piece."""
    decoder, text, at, ended = json.JSONDecoder(), "", 0, False

    def more() -> None:
        nonlocal text, at, ended
        piece = next(pieces, None)
        if piece is None:
            if ended:
                raise ValueError("the document is cut off")
            ended, piece = True, " "  # a number or word at the very end is complete now
        text, at = text[at:] + piece, 0

    def skip() -> str:
        """The next character that isn't white space."""
        nonlocal at
        while True:
            while at < len(text) and text[at].isspace():
                at += 1
            if at < len(text):
                return text[at]
            more()

    def value():
        nonlocal at
        skip()
        while True:
            try:
                out, stop = decoder.raw_decode(text, at)
                if stop < len(text) or ended:
                    at = stop
                    return out
            except ValueError:
                if ended:
                    raise
            held = len(text) - at  # a value larger than a piece is tried again when twice as much is there
            while len(text) - at < 2 * held and not ended:
                more()

    def take(*wanted: str) -> str:
        nonlocal at
        c = skip()
        if c not in wanted:
            raise ValueError(f"{' or '.join(wanted)} was expected, not {c}")
        at += 1
        return c

    take("{")
    while True:
        key = value()
        take(":")
        if key == "features":
            take("[")
            if skip() == "]":
                return
            while True:
                yield value()
                if take(",", "]") == "]":
                    return
        value()
        if take(",", "}") == "}":
            raise ValueError("the document has no features")


def _polygons(feature: dict, ecosystem: str) -> tuple[str, list]:
    """(ecosystem, polygons) of a feature."""
    named = (feature.get("properties") or {}).get(ecosystem)
    if named is None:
        raise ValueError(f"a feature lacks the property {ecosystem}")
    shape = feature.get("geometry") or {}
    if shape.get("type") not in ("Polygon", "MultiPolygon"):
        raise ValueError(f"geometry has no area: {shape.get('type', 'none')}")
    polygons = [shape["coordinates"]] if shape["type"] == "Polygon" else shape["coordinates"]
    if any(len(p) != 2 for rings in polygons for ring in rings for p in ring):
        raise ValueError("positions must have two numbers")
    return str(named), polygons


def read(spark: SparkSession, path: str, ecosystem: str = "ECO_CODE") -> DataFrame:
    """Features of the FeatureCollection files at a path, each streamed by one task; `-` reads standard input."""
    if path == "-":
        import sys

        rows = [_polygons(f, ecosystem) for f in _features(iter(lambda: sys.stdin.read(PIECE) or None, None))]
        return spark.createDataFrame([(e, write_wkb(p)) for e, p in rows], "ecosystem string, geometry binary")
    uri = path if "://" in path else "file://" + os.path.abspath(path)
    system, at = fs.FileSystem.from_uri(uri)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [at] if info.type == fs.FileType.File else sorted(x.path for x in system.get_file_info(fs.FileSelector(at, recursive=True)) if x.path.endswith(("json", "geojson")))

    def run(batches):
        own = fs.FileSystem.from_uri(uri)[0]
        for f in (f for b in batches for f in b.column("file").to_pylist()):
            with own.open_input_stream(f, compression=None) as raw:
                text = codecs.getreader("utf-8")(raw)
                rows: list[tuple[str, bytes]] = []
                for feature in _features(iter(lambda t=text: t.read(PIECE) or None, None)):
                    name, polygons = _polygons(feature, ecosystem)
                    rows.append((name, write_wkb(polygons)))
                    if len(rows) == BATCH:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    listed = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, len(files)))
    return listed.mapInArrow(run, "ecosystem string, geometry binary")


def _batch(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["ecosystem", "geometry"])


def write(df: DataFrame, path: str, ecosystem: str = "ECO_CODE") -> None:
    """Features (ecosystem, geometry) as FeatureCollections, one file per task."""
    uri = path if "://" in path else "file://" + os.path.abspath(path)

    def run(batches):
        system, at = fs.FileSystem.from_uri(uri)
        system.create_dir(at, recursive=True)
        context, n = TaskContext.get(), 0
        own = f"{at}/_{context.taskAttemptId()}.tmp"
        with system.open_output_stream(own) as out:
            out.write(b'{"type": "FeatureCollection", "features": [')
            for batch in batches:
                for eco, data in zip(batch.column("ecosystem").to_pylist(), batch.column("geometry").to_pylist(), strict=True):
                    polygons = [[r.tolist() for r in rings] for rings in read_wkb(data)]
                    one = {"type": "Feature", "properties": {ecosystem: eco}, "geometry": {"type": "MultiPolygon", "coordinates": polygons}}
                    out.write((", " if n else "").encode() + json.dumps(one).encode())
                    n += 1
            out.write(b"]}")
        system.move(own, f"{at}/part-{context.partitionId():05d}.geojson")
        yield pa.RecordBatch.from_pydict({"rows": [n]})

    df.where("geometry IS NOT NULL").select(F.coalesce("ecosystem", F.lit("")).alias("ecosystem"), "geometry").mapInArrow(run, "rows long").agg(F.sum("rows")).collect()
