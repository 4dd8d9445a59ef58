"""GeoParquet: footers read by tasks, data through Spark's own scan with pushed filters."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEVERITIES = ["error", "warning", "note"]


@dataclass
class Geo:
    """A file's `geo` metadata."""

    version: str
    primary: str
    columns: dict

    @property
    def column(self) -> dict:
        return self.columns[self.primary]

    @property
    def encoding(self) -> str:
        return self.column.get("encoding", "WKB")

    @property
    def covering(self) -> dict | None:
        """Paths of xmin, ymin, xmax and ymax."""
        return (self.column.get("covering") or {}).get("bbox")

    @property
    def crs_code(self) -> str | None:
        """AUTHORITY:CODE or the name; None where no CRS is stated, which means longitude and latitude on WGS84."""
        crs = self.column.get("crs")
        if not crs:
            return None
        own = crs.get("id")
        return f"{own['authority']}:{own['code']}" if own else crs.get("name", "an unnamed coordinate system")

    @property
    def geographic(self) -> bool:
        crs = self.column.get("crs")
        if not crs:
            return True
        axes = (crs.get("coordinate_system") or {}).get("axis", [])
        return crs.get("type") == "GeographicCRS" and all(a.get("unit") == "degree" for a in axes)


def _files(path: str) -> tuple[fs.FileSystem, list[str]]:
    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(failure_hint(path))
    if info.type == fs.FileType.File:
        return system, [at]
    return system, sorted(x.path for x in system.get_file_info(fs.FileSelector(at, recursive=True)) if x.path.endswith(".parquet"))


def per_footer(spark: SparkSession, path: str, rows_of, schema: str) -> DataFrame:
    """The rows that `rows_of(file, metadata)` gives for each footer of a file or folder; no data is read.

    The driver lists the files, tasks open their footers.
    """
    files = _files(path)[1]
    if not files:
        raise FileNotFoundError(f"no Parquet file in {path}")
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[f.split()[1]] for f in schema.split(", ")]

    def run(batches):
        system = fs.FileSystem.from_uri(path)[0] if "://" in path else fs.LocalFileSystem()
        for f in (f for b in batches for f in b.column("file").to_pylist()):
            rows = list(rows_of(f, pq.read_metadata(f, filesystem=system)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    listed = spark.createDataFrame([(f,) for f in files], "file string")
    return listed.repartition(min(len(files), 1000)).mapInArrow(run, schema)


def geo_metadata(meta: pq.FileMetaData) -> Geo:
    raw = (meta.metadata or {}).get(b"geo")
    if raw is None:
        raise ValueError("no `geo` metadata: not a GeoParquet file")
    doc = json.loads(raw)
    if doc.get("primary_column") not in doc.get("columns", {}):
        raise ValueError(f"the primary column {doc.get('primary_column')!r} is not described")
    return Geo(str(doc.get("version", "")), doc["primary_column"], doc["columns"])


def _leaves(meta: pq.FileMetaData) -> list[str]:
    return [meta.schema.column(i).path for i in range(meta.num_columns)]


def structure(meta: pq.FileMetaData) -> list[tuple[str, str]]:
    """(severity, message) of what the metadata says against what the file has, worst first."""
    geo, have, out = geo_metadata(meta), _leaves(meta), []
    for name in geo.columns:
        if name not in have:
            out.append(("error", f"geometry column `{name}` is described but absent; the file has: {', '.join(have)}"))
    if geo.encoding != "WKB":
        out.append(("error", f"the geometry column is encoded as `{geo.encoding}`; only WKB can be read"))
    if not geo.geographic:
        out.append(("error", f"the geometry is in {geo.crs_code}, which is projected; longitude and latitude in degrees are needed"))
    if geo.covering:
        for corner in ("xmin", "ymin", "xmax", "ymax"):
            name = ".".join(geo.covering[corner])
            if name not in have:
                out.append(("error", f"bounding-box column `{name}` is described but absent, so nothing can be skipped by place"))
        if geo.version.startswith("1.0"):
            out.append(("note", f"version {geo.version} is declared but `covering` is of 1.1; it is used all the same"))
    else:
        out.append(("note", "no bounding-box columns, so a spatial query reads every row group"))
    if geo.crs_code is None:
        out.append(("note", "no CRS is stated, which means OGC:CRS84"))
    for codec in {meta.row_group(g).column(c).compression for g in range(meta.num_row_groups) for c in range(meta.num_columns)}:
        if codec == "LZO":
            out.append(("error", "columns are compressed by LZO, which can't be read"))
    return sorted(out, key=lambda x: SEVERITIES.index(x[0]))


# What the published layout allows in a geometry column's description.
GEOMETRIES = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")
ENCODINGS = {"1.0.0": ("WKB",), "1.1.0": ("WKB", "point", "linestring", "polygon", "multipoint", "multilinestring", "multipolygon")}


def _faults(column: dict, version: str):
    """What is wrong with a geometry column's description, by the layout of its version."""
    if not isinstance(column, dict):
        yield "is no object"
        return
    if column.get("encoding") not in ENCODINGS[version]:
        yield f"`encoding` is {column.get('encoding')!r}, not one of {', '.join(ENCODINGS[version])}"
    kinds = column.get("geometry_types")
    if not isinstance(kinds, list):
        yield "`geometry_types` is missing or no list"
    else:
        yield from (f"`geometry_types` holds {k!r}" for k in kinds if not isinstance(k, str) or k.removesuffix(" Z") not in GEOMETRIES)
        if len(set(map(str, kinds))) < len(kinds):
            yield "`geometry_types` repeats a type"
    crs = column.get("crs")
    if crs is not None and not (isinstance(crs, dict) and "type" in crs):
        yield "`crs` is no PROJJSON object"
    for key, allowed in (("edges", ("planar", "spherical")), ("orientation", ("counterclockwise",))):
        if key in column and column[key] not in allowed:
            yield f"`{key}` is {column[key]!r}, not {' or '.join(allowed)}"
    box, number = column.get("bbox"), lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    if "bbox" in column and not (isinstance(box, list) and len(box) in (4, 6) and all(map(number, box))):
        yield "`bbox` is not four or six numbers"
    if "epoch" in column and not number(column["epoch"]):
        yield "`epoch` is no number"
    if "covering" in column:
        own = (column["covering"] or {}).get("bbox") if isinstance(column["covering"], dict) else None
        paths = [own.get(k) for k in ("xmin", "ymin", "xmax", "ymax")] if isinstance(own, dict) else [None]
        if not all(isinstance(p, list) and len(p) == 2 and all(isinstance(x, str) for x in p) for p in paths):
            yield "`covering.bbox` doesn't name four paths of two parts"


def schema_findings(meta: pq.FileMetaData) -> list[tuple[str, str]]:
    """(severity, message) of the `geo` document against the published layout of its version; an unknown version is read by
    the newest one."""
    doc, out = json.loads((meta.metadata or {})[b"geo"]), []
    version = doc.get("version")
    if version not in ENCODINGS:
        out.append(("warning", f"version {version!r} has no known layout"))
        version = max(ENCODINGS)
    if not isinstance(doc.get("primary_column"), str) or not doc["primary_column"]:
        out.append(("error", "`primary_column` is missing or no text"))
    if not isinstance(doc.get("columns"), dict) or not doc["columns"]:
        return [*out, ("error", "`columns` describes no column")]
    return out + [("error", f"column `{name}`: {fault}") for name, column in doc["columns"].items() for fault in _faults(column, version)]


def check_structure(spark: SparkSession, path: str) -> DataFrame:
    return per_footer(spark, path, lambda f, m: [(f, *x) for x in structure(m) + schema_findings(m)], "file string, severity string, message string")


def validate(spark: SparkSession, path: str, ecosystem: str) -> Geo:
    """The metadata of the first file; raises from footers alone, before any data is read, where a file can't be read or
    lacks the column."""

    def faults(f, meta):
        have = _leaves(meta)
        bad = [m for s, m in structure(meta) if s == "error" and "bounding-box" not in m]
        if ecosystem not in have:
            bad.append(f"no column `{ecosystem}`; there are: {', '.join(have)}")
        return [(f, x) for x in bad[:1]]

    bad = per_footer(spark, path, faults, "file string, message string").orderBy("file").first()
    if bad is not None:
        raise ValueError(f"{bad['file']}: {bad['message']}")
    system, files = _files(path)
    return geo_metadata(pq.read_metadata(files[0], filesystem=system))


def schema_of(spark: SparkSession, path: str) -> DataFrame:
    """The leaf columns of the first file: position, column, kind, and whether it holds geometry."""
    system, files = _files(path)
    meta = pq.read_metadata(files[0], filesystem=system)
    geo = geo_metadata(meta)
    rows = [(i, meta.schema.column(i).path, meta.schema.column(i).physical_type, meta.schema.column(i).path in geo.columns) for i in range(meta.num_columns)]
    return spark.createDataFrame(rows, "position int, column string, kind string, is_geometry boolean")


def inspect(spark: SparkSession, path: str, ecosystem: str | None = None) -> DataFrame:
    """One row per row group from footers: rows, bytes, geometry bytes, CRS, bounds from the covering's statistics, and
    the least and greatest ecosystem where its column is named."""

    def rows_of(f, meta):
        geo, have = geo_metadata(meta), _leaves(meta)
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            column = {have[c]: group.column(c) for c in range(group.num_columns)}
            bounds = []
            for corner, side in (("xmin", "min"), ("ymin", "min"), ("xmax", "max"), ("ymax", "max")):
                s = _statistics(column.get(".".join(geo.covering[corner]))) if geo.covering else None
                bounds.append(None if s is None else float(getattr(s, side)))
            own, s = column.get(geo.primary), _statistics(column.get(ecosystem))
            yield f, g, group.num_rows, sum(c.total_compressed_size for c in column.values()), None if own is None else own.total_compressed_size, geo.crs_code or "OGC:CRS84", *bounds, *((None, None) if s is None else (s.min, s.max))

    return per_footer(spark, path, rows_of, "file string, row_group int, rows long, bytes long, geometry_bytes long, crs string, xmin double, ymin double, xmax double, ymax double, first_ecosystem string, last_ecosystem string")


def _statistics(column):
    s = None if column is None else column.statistics
    return s if s is not None and s.has_min_max else None


def largest_group(spark: SparkSession, path: str) -> DataFrame:
    """The row group with the most geometry, which bounds what a reader holds at a time."""
    return inspect(spark, path).orderBy(F.desc("geometry_bytes"), "file", "row_group").limit(1)


def read_plan(spark: SparkSession, path: str, ecosystem: str, bbox=None, ecosystems=None) -> DataFrame:
    """inspect() and `read`: whether the group's statistics leave it in; unknown ones do."""
    keep = F.lit(True)
    if bbox is not None:
        keep &= F.coalesce((F.col("xmin") <= bbox[2]) & (F.col("xmax") >= bbox[0]) & (F.col("ymin") <= bbox[3]) & (F.col("ymax") >= bbox[1]), F.lit(True))
    if ecosystems is not None:
        some = [F.lit(e).between(F.col("first_ecosystem"), F.col("last_ecosystem")) for e in ecosystems]
        keep &= F.coalesce(F.greatest(F.lit(False), *some), F.lit(True)) if some else F.lit(False)
    return inspect(spark, path, ecosystem).withColumn("read", keep)


def column_ranges(spark: SparkSession, path: str, ecosystem: str) -> DataFrame:
    """The bytes of each row group's geometry, ecosystem and bounding-box columns: file, row_group, column, start, stop."""

    def rows_of(f, meta):
        geo, have = geo_metadata(meta), _leaves(meta)
        wanted = {geo.primary, ecosystem} | ({".".join(v) for v in geo.covering.values()} if geo.covering else set())
        for g in range(meta.num_row_groups):
            for c in (c for c in range(meta.num_columns) if have[c] in wanted):
                own = meta.row_group(g).column(c)
                start = min(x for x in (own.data_page_offset, own.dictionary_page_offset) if x)
                yield f, g, have[c], start, start + own.total_compressed_size

    return per_footer(spark, path, rows_of, "file string, row_group int, column string, start long, stop long")


def merged_ranges(ranges: DataFrame, key: str = "file") -> DataFrame:
    """Ranges (key, start, stop) with those that touch or overlap merged; gaps are never bridged."""
    own = Window.partitionBy(key).orderBy("start", "stop")
    before, running = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(Window.unboundedPreceding, 0)
    marked = ranges.withColumn("new", F.when(F.col("start") <= F.max("stop").over(before), 0).otherwise(1))
    islands = marked.withColumn("island", F.sum("new").over(running))
    return islands.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def plan_ranges(spark: SparkSession, path: str, ecosystem: str, bbox=None, ecosystems=None) -> DataFrame:
    """The merged byte ranges that a filtered read needs: file, start, stop."""
    groups = read_plan(spark, path, ecosystem, bbox, ecosystems).where("read").select("file", "row_group")
    return merged_ranges(column_ranges(spark, path, ecosystem).join(groups, ["file", "row_group"]).select("file", "start", "stop"))


def read_report(spark: SparkSession, path: str | list[str], ecosystem: str, bbox=None, ecosystems=None) -> DataFrame:
    """What a filtered read of each dataset comes to: path, groups_read, groups_skipped, features (those that pass the
    filters), bytes_planned, bytes_total (of the columns read)."""
    out = None
    for p in [path] if isinstance(path, str) else path:
        plan = read_plan(spark, p, ecosystem, bbox, ecosystems).select("file", "row_group", "read")
        sized = column_ranges(spark, p, ecosystem).groupBy("file", "row_group").agg(F.sum(F.col("stop") - F.col("start")).alias("size"))
        zero = F.lit(0).cast("long")
        groups = plan.join(sized, ["file", "row_group"]).select("read", "size", zero.alias("features"))
        rows = read(spark, p, ecosystem, bbox, ecosystems).agg(F.count(F.lit(1)).alias("features"))
        both = groups.unionByName(rows.select(F.lit(None).cast("boolean").alias("read"), zero.alias("size"), "features"))
        one = both.agg(
            F.lit(p).alias("path"),
            F.count_if("read").alias("groups_read"),
            F.count_if(~F.col("read")).alias("groups_skipped"),
            F.sum("features").alias("features"),
            F.sum(F.when(F.col("read"), F.col("size")).otherwise(zero)).alias("bytes_planned"),
            F.sum("size").alias("bytes_total"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def distribution_from(spark: SparkSession, path: str | list[str], ecosystem: str, bbox=None, ecosystems=None, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """(metrics, read report) of one or more datasets in one call."""
    from ecorisk.operators.distribution import distribution_metrics

    return distribution_metrics(read(spark, path, ecosystem, bbox, ecosystems), check), read_report(spark, path, ecosystem, bbox, ecosystems)


def read(spark: SparkSession, path: str | list[str], ecosystem: str, bbox=None, ecosystems=None) -> DataFrame:
    """Features of one or more datasets, filtered row by row: ecosystems by code, `bbox` (x0, y0, x1, y1) by closed
    intersection with a feature's covering. Both filters and the two columns reach the Parquet scan."""
    out = None
    for p in [path] if isinstance(path, str) else path:
        geo = validate(spark, p, ecosystem)
        df = spark.read.parquet(p)
        if ecosystems is not None:
            df = df.where(F.col(ecosystem).isin(list(ecosystems)))
        if bbox is not None and geo.covering:
            c = {k: F.col(".".join(v)) for k, v in geo.covering.items()}
            df = df.where((c["xmin"] <= bbox[2]) & (c["xmax"] >= bbox[0]) & (c["ymin"] <= bbox[3]) & (c["ymax"] >= bbox[1]))
        part = df.where(F.col(geo.primary).isNotNull()).select(F.coalesce(F.col(ecosystem), F.lit("")).alias("ecosystem"), F.col(geo.primary).alias("geometry"))
        out = part if out is None else out.unionByName(part)
    return out


def write(df: DataFrame, path: str, ecosystem: str = "ecosystem", row_group: int = 10_000) -> None:
    """Features as GeoParquet with bounding boxes, one file per task, ordered by ecosystem so that groups can be skipped."""
    import numpy as np
    from pyspark import TaskContext

    from ecorisk.functions.geometry import read_wkb

    corners = ("xmin", "ymin", "xmax", "ymax")
    doc = {"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", "geometry_types": ["Polygon", "MultiPolygon"], "covering": {"bbox": {k: ["bbox", k] for k in corners}}}}}
    kind = pa.struct([(k, pa.float64()) for k in corners])
    schema = pa.schema([(ecosystem, pa.string()), ("geometry", pa.binary()), ("bbox", kind)], {b"geo": json.dumps(doc).encode()})
    uri = path if "://" in path else "file://" + path

    def run(batches):
        system, at = fs.FileSystem.from_uri(uri)
        system.create_dir(at, recursive=True)
        name, n = f"{at}/part-{TaskContext.get().partitionId():05d}.parquet", 0
        own = f"{at}/_{TaskContext.get().taskAttemptId()}.tmp"
        with pq.ParquetWriter(own, schema, filesystem=system) as out:
            for batch in batches:
                boxes = []
                for data in batch.column("geometry").to_pylist():
                    points = np.concatenate([r for p in read_wkb(data) for r in p] or [np.full((1, 2), np.nan)]) if data is not None else np.full((1, 2), np.nan)
                    (x0, y0), (x1, y1) = points.min(axis=0), points.max(axis=0)
                    boxes.append({"xmin": x0, "ymin": y0, "xmax": x1, "ymax": y1} if data is not None else None)
                out.write_table(pa.table([batch.column(ecosystem), batch.column("geometry"), pa.array(boxes, kind)], schema=schema), row_group_size=row_group)
                n += batch.num_rows
        system.move(own, name)
        yield pa.RecordBatch.from_pydict({"rows": [n]})

    df.select(ecosystem, "geometry").sortWithinPartitions(ecosystem).mapInArrow(run, "rows long").agg(F.sum("rows")).collect()


def failure_hint(url: str) -> str:
    """What may be wrong with a path that can't be read."""
    if "://source.coop/" in url:
        return f"{url} is a page about the data; the data are at {url.replace('://source.coop/', '://data.source.coop/', 1)}"
    if "://www." in url or "/blob/" in url:
        return f"{url} looks like a web page, not a file"
    return f"{url} can't be found"
