"""Tiled TIFF rasters as a Spark data source: a few tiles to a partition, rows (tile, px_col, px_row, value).

    spark.dataSource.register(TiledRaster)
    spark.read.format("tiledraster").option("window", "0,0,256,256").load(path)

Only the first image is read; tiles are uncompressed or deflated, with or without horizontal differencing; missing bytes
are an error, never blank.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# TIFF field types (bytes, format), tags and GeoTIFF keys.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q"}
WIDTH, HEIGHT, BITS, COMPRESSION, SAMPLES, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, OFFSETS, COUNTS, FORMAT = 256, 257, 258, 259, 277, 317, 322, 323, 324, 325, 339
SCALE, TIEPOINT, GEO_KEYS, GEO_DOUBLES = 33550, 33922, 34735, 34736
MODEL, GEOGRAPHIC, METHOD, STD_PARALLEL, CENTRAL_MERIDIAN, FALSE_EASTING, FALSE_NORTHING = 1024, 2048, 3075, 3078, 3080, 3082, 3083
SCHEMA = "tile int, px_col int, px_row int, value double"


@dataclass
class Header:
    width: int
    height: int
    tile_width: int
    tile_height: int
    offsets: tuple
    counts: tuple
    compression: int
    predictor: int
    dtype: str
    origin: tuple[float, float]
    step: tuple[float, float]
    keys: dict

    @property
    def across(self) -> int:
        return -(-self.width // self.tile_width)

    def on_grid(self) -> bool:
        """Whether the raster is in the grid's plane, judged by parameters."""
        k = self.keys
        zero = all(not k.get(x, 0) for x in (STD_PARALLEL, CENTRAL_MERIDIAN, FALSE_EASTING, FALSE_NORTHING))
        return k.get(MODEL) == 1 and k.get(METHOD) == 28 and zero and k.get(GEOGRAPHIC, 4326) in (4326, 32767)

    def tiles(self, window=None) -> list[int]:
        """Tiles that a pixel window (col, row, width, height), clipped to the raster, touches."""
        c, r, w, h = window or (0, 0, self.width, self.height)
        c0, r0, c1, r1 = max(c, 0), max(r, 0), min(c + w, self.width), min(r + h, self.height)
        if c0 >= c1 or r0 >= r1:
            return []  # a window beside the raster holds nothing
        return [y * self.across + x for y in range(r0 // self.tile_height, (r1 - 1) // self.tile_height + 1) for x in range(c0 // self.tile_width, (c1 - 1) // self.tile_width + 1)]


def parse_header(data: bytes) -> Header:
    """The header from the file's first bytes."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        raise ValueError("not a TIFF file")
    (version,) = struct.unpack(order + "H", data[2:4])
    big = version == 43
    if version not in (42, 43):
        raise ValueError(f"TIFF version {version} is unknown")
    (at,) = struct.unpack(order + ("Q" if big else "I"), data[8:16] if big else data[4:8])
    count_size, entry, inline = (8, 20, 8) if big else (2, 12, 4)
    (n,) = struct.unpack(order + ("Q" if big else "H"), data[at : at + count_size])
    tags: dict[int, tuple] = {}
    for k in range(n):
        e = data[at + count_size + k * entry : at + count_size + (k + 1) * entry]
        tag, kind = struct.unpack(order + "HH", e[:4])
        (m,) = struct.unpack(order + ("Q" if big else "I"), e[4 : 12 if big else 8])
        if kind not in TYPES:
            continue
        form = order + (f"{m}s" if TYPES[kind] == "s" else TYPES[kind] * m)
        size, raw = struct.calcsize(form), e[-inline:]
        if size > inline:
            (where,) = struct.unpack(order + ("Q" if big else "I"), raw)
            raw = data[where : where + size]
            if len(raw) < size:
                raise ValueError("the header goes on beyond the bytes given")
        tags[tag] = struct.unpack(form, raw[:size])
    if OFFSETS not in tags or TILE_WIDTH not in tags:
        raise ValueError("the raster isn't tiled")
    if tags.get(SAMPLES, (1,))[0] != 1:
        raise ValueError("more than one sample per pixel")
    predictor = tags.get(PREDICTOR, (1,))[0]
    if tags.get(COMPRESSION, (1,))[0] not in (1, 8, 32946):
        raise ValueError(f"compression {tags.get(COMPRESSION)} can't be read")
    bits, kind = tags.get(BITS, (8,))[0], {1: "u", 2: "i", 3: "f"}[tags.get(FORMAT, (1,))[0]]
    if kind == "f" and bits < 32:
        raise ValueError("half-precision samples can't be read")
    if predictor not in (1, 2) or predictor == 2 and kind == "f":
        raise ValueError(f"predictor {predictor} can't be read")
    if SCALE not in tags or TIEPOINT not in tags:
        raise ValueError("no pixel scale and tie point")
    scale, tie = tags[SCALE], tags[TIEPOINT]
    keys, raw = {}, tags.get(GEO_KEYS, ())
    for k in range(4, len(raw), 4):
        key, place, _, value = raw[k : k + 4]
        keys[key] = value if place == 0 else tags[GEO_DOUBLES][value] if place == GEO_DOUBLES else None
    return Header(
        tags[WIDTH][0], tags[HEIGHT][0], tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0], tags[OFFSETS], tags[COUNTS],
        tags.get(COMPRESSION, (1,))[0], predictor, f"{order}{kind}{bits // 8}", (tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1]), (scale[0], -scale[1]), keys,
    )


def open_file(path: str):
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(at)


def read_header(path: str) -> Header:
    """Reads as few bytes as the header needs: 16 KiB first, then twice as many."""
    with open_file(path) as f:
        size, n = f.size(), 1 << 14
        while True:
            f.seek(0)
            data = f.read(min(n, size))
            try:
                return parse_header(data)
            except (ValueError, struct.error) as e:
                if n >= size or n >= 1 << 24 or "beyond" not in str(e) and not isinstance(e, struct.error):
                    raise
                n *= 2


def tile_range(h: Header, tile: int) -> tuple[int, int]:
    """(start, stop) of a tile's bytes in the file."""
    return h.offsets[tile], h.offsets[tile] + h.counts[tile]


def window_ranges(h: Header, window=None) -> list[tuple[int, int]]:
    """The bytes that a pixel window needs, ranges that touch or overlap merged, gaps never bridged."""
    out: list[list[int]] = []
    for start, stop in sorted(tile_range(h, t) for t in h.tiles(window)):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def decode_tile(h: Header, tile: int, data: bytes, count: int | None = None) -> np.ndarray:
    if len(data) < (h.counts[tile] if count is None else count):
        raise ValueError(f"tile {tile} is cut off")
    raw = zlib.decompress(data) if h.compression != 1 else data
    out = np.frombuffer(raw, h.dtype, h.tile_width * h.tile_height).reshape(h.tile_height, h.tile_width)
    if h.predictor == 2:
        out = np.cumsum(out, axis=1, dtype=out.dtype)
    return out.astype(float)


#: Bytes of tiles that one task reads, unless a single tile is larger.
TASK_BYTES = 16 << 20


class _Tiles(InputPartition):
    """(tile, offset, bytes) of some tiles."""

    def __init__(self, tiles: list[tuple[int, int, int]]):
        self.tiles = tiles


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.window = tuple(int(x) for x in options["window"].split(",")) if options.get("window") else None
        h = read_header(self.path)
        if options.get("any_crs", "false") != "true" and not h.on_grid():
            raise ValueError(f"{self.path} is not in the grid's equal-area plane")
        self.parts: list[_Tiles] = []
        size = 0
        for t in h.tiles(self.window):
            if not self.parts or size + h.counts[t] > TASK_BYTES:
                self.parts.append(_Tiles([]))
                size = 0
            self.parts[-1].tiles.append((t, h.offsets[t], h.counts[t]))
            size += h.counts[t]
        self.header = replace(h, offsets=(), counts=())  # tasks get the places of their own tiles alone

    def partitions(self):
        return self.parts

    def read(self, part):
        h = self.header
        c, r, w, n = self.window or (0, 0, h.width, h.height)
        with open_file(self.path) as f:
            for t, offset, count in part.tiles:
                f.seek(offset)
                values = decode_tile(h, t, f.read(count), count)
                c0, r0 = t % h.across * h.tile_width, t // h.across * h.tile_height
                a, b = max(c, c0, 0), min(c + w, c0 + h.tile_width, h.width)
                x, y = max(r, r0, 0), min(r + n, r0 + h.tile_height, h.height)
                some = values[x - r0 : y - r0, a - c0 : b - c0]
                rows, cols = np.mgrid[x:y, a:b]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(some.size, t, np.int32)), pa.array(cols.ravel().astype(np.int32)), pa.array(rows.ravel().astype(np.int32)), pa.array(some.ravel())], names=["tile", "px_col", "px_row", "value"])


class TiledRaster(DataSource):
    @classmethod
    def name(cls):
        return "tiledraster"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def pixels(spark, path: str, window=None):
    """(tile, px_col, px_row, value) of a raster or of a window (col, row, width, height) of it."""
    spark.dataSource.register(TiledRaster)
    reader = spark.read.format("tiledraster")
    return (reader if window is None else reader.option("window", ",".join(map(str, window)))).load(path)


def raster_class_extents(spark, path: str, classes: dict[float, str], window=None):
    """Extents of all classes (value -> ecosystem) of a raster in one pass over its tiles."""
    from pyspark.sql import functions as F

    from ecorisk.operators.distribution import raster_extents

    h = read_header(path)
    names = F.create_map(*[F.lit(x) for k, v in classes.items() for x in (float(k), v)])
    named = pixels(spark, path, window).withColumn("ecosystem", names[F.col("value")]).where("ecosystem IS NOT NULL")
    return raster_extents(named.withColumn("coverage", F.lit(1.0)), *h.origin, *h.step)


def raster_mask_extents(spark, path: str, wanted: float, ecosystem: str, window=None):
    """Extents of one class of a raster, its pixels masked by value."""
    from pyspark.sql import functions as F

    from ecorisk.operators.distribution import class_mask, raster_extents

    h = read_header(path)
    masked = pixels(spark, path, window).select(F.lit(ecosystem).alias("ecosystem"), "px_col", "px_row", class_mask(F.col("value"), wanted).alias("coverage"))
    return raster_extents(masked, *h.origin, *h.step)


def array_extents(spark, ecosystem: str, coverage, origin: tuple[float, float], step: tuple[float, float], first=(0, 0)):
    """Extents of a row-major coverage array in memory, its pixel (0, 0) being pixel `first` (col, row) of the raster."""
    from pyspark.sql import functions as F

    from ecorisk.operators.distribution import raster_extents

    values = np.asarray(coverage, float)
    if values.ndim != 2:
        raise ValueError("coverage needs rows and columns")
    rows = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(values)], "px_row int, line array<double>")
    each = rows.select("px_row", F.posexplode("line").alias("px_col", "coverage"))
    moved = each.select(F.lit(ecosystem).alias("ecosystem"), (F.col("px_col") + first[0]).alias("px_col"), (F.col("px_row") + first[1]).alias("px_row"), "coverage")
    return raster_extents(moved, *origin, *step)


def write_tiled(path: str, values: np.ndarray, tile: int, origin, step: float, deflate: bool = True, keys: dict | None = None, predictor: int = 1) -> None:
    """A small tiled TIFF in the grid's plane (or with other `keys`), for tests and exports."""
    rows, cols = values.shape
    bodies = []
    for r in range(0, rows, tile):
        for c in range(0, cols, tile):
            block = np.zeros((tile, tile), values.dtype)
            part = values[r : r + tile, c : c + tile]
            block[: part.shape[0], : part.shape[1]] = part
            if predictor == 2:
                block[:, 1:] = np.diff(block, axis=1)
            bodies.append(zlib.compress(block.tobytes()) if deflate else block.tobytes())
    kind = {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    geo = {MODEL: 1, METHOD: 28} if keys is None else keys
    geokeys = [1, 1, 0, len(geo), *[x for k, v in sorted(geo.items()) for x in (k, 0, 1, v)]]
    fields = [(WIDTH, "I", [cols]), (HEIGHT, "I", [rows]), (BITS, "H", [values.dtype.itemsize * 8]), (COMPRESSION, "H", [8 if deflate else 1]), (SAMPLES, "H", [1]), (PREDICTOR, "H", [predictor]), (TILE_WIDTH, "I", [tile]), (TILE_HEIGHT, "I", [tile])]
    fields += [(OFFSETS, "I", [0] * len(bodies)), (COUNTS, "I", [len(b) for b in bodies]), (FORMAT, "H", [kind]), (SCALE, "d", [step, step, 0.0]), (TIEPOINT, "d", [0.0, 0.0, 0.0, origin[0], origin[1], 0.0]), (GEO_KEYS, "H", geokeys)]
    code = {"H": 3, "I": 4, "d": 12}
    at = 8 + 2 + 12 * len(fields) + 4
    starts = at + sum((len(struct.pack("<" + f * len(v), *v)) if len(struct.pack("<" + f * len(v), *v)) > 4 else 0) for _, f, v in fields)
    offsets = [starts + sum(len(b) for b in bodies[:k]) for k in range(len(bodies))]
    entries, extra = b"", b""
    for tag, f, v in fields:
        raw = struct.pack("<" + f * len(v), *(offsets if tag == OFFSETS else v))
        entries += struct.pack("<HHI", tag, code[f], len(v)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", at + len(extra)))
        extra += raw if len(raw) > 4 else b""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    with system.open_output_stream(at) as f:
        f.write(struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(fields)) + entries + struct.pack("<I", 0) + extra + b"".join(bodies))
