"""Rasters in tiles: a data source that reads float grids by windows, and a writer of such tiles.

A raster is a folder of tiles NAME.flt (rows of little-endian 32-bit floats) with a
text header NAME.hdr each, in a store that pyarrow opens by its URI. A tile's corner
says where it lies; all tiles of a folder have one cell size and fit one grid.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..operators.raster import Grid, MisalignedError

NODATA = -9999.0
#: Cells of one partition at most; larger tiles are read by bands of rows.
PARTITION_CELLS = 1 << 20
_SCHEMA = pa.schema([("r", pa.int32()), ("c", pa.int32()), ("value", pa.float64())])


@dataclass(frozen=True)
class Tile:
    path: str
    rows: int
    columns: int
    x0: float
    y1: float
    cell: float
    nodata: float
    dtype: str


def tiles(path: str) -> list[Tile]:
    """The headers of a folder."""
    store, base = pafs.FileSystem.from_uri(path)
    out = []
    for info in sorted(store.get_file_info(pafs.FileSelector(base, recursive=True)), key=lambda x: x.path):
        if info.path.endswith(".hdr"):
            with store.open_input_stream(info.path) as file:
                h = {k.lower(): v for k, v in (line.split(None, 1) for line in file.read().decode().splitlines() if line.strip())}
            cell, rows = float(h["cellsize"]), int(h["nrows"])
            out.append(Tile(info.path.removesuffix(".hdr") + ".flt", rows, int(h["ncols"]), float(h["xllcorner"]), float(h["yllcorner"]) + rows * cell, cell, float(h.get("nodata_value", NODATA)), "<f4" if h.get("byteorder", "LSBFIRST").strip().upper().startswith("LSB") else ">f4"))
    if not out:
        raise FileNotFoundError(f"no tiles in {path}")
    return out


def placed(found: list[Tile], tolerance: float = 1e-6) -> tuple[Grid, list[tuple[Tile, int, int]]]:
    """The grid that the tiles make up, and each tile's first row and column."""
    cell, x0, y0 = found[0].cell, min(t.x0 for t in found), max(t.y1 for t in found)
    out = []
    for t in found:
        r, c = (y0 - t.y1) / cell, (t.x0 - x0) / cell
        if abs(t.cell - cell) > tolerance or abs(r - round(r)) * cell > tolerance or abs(c - round(c)) * cell > tolerance:
            raise MisalignedError(f"{t.path} doesn't fit the grid of {found[0].path}")
        out.append((t, round(r), round(c)))
    return Grid(max(r + t.rows for t, r, _ in out), max(c + t.columns for t, _, c in out), x0, y0, cell), out


@dataclass
class Band(InputPartition):
    tile: Tile
    row: int
    column: int
    rows: tuple[int, int]
    columns: tuple[int, int]


class FloatGrid(DataSource):
    """``read.format("float_grid").option("path", uri)``: (r, c, value) of the raster's grid, nodata as NULL.

    The option ``window`` (r0,r1,c0,c1, ends excluded) and, with the option
    ``pushdown``, filters on r and c leave out whole tiles
    and bands before anything is read; within a band only its columns are read.
    """

    @classmethod
    def name(cls) -> str:
        return "float_grid"

    def schema(self) -> str:
        return "r int, c int, value double"

    def reader(self, schema) -> DataSourceReader:
        kind = PushingReader if self.options.get("pushdown", "false") == "true" else FloatGridReader
        return kind(self.options["path"], self.options.get("window"))


class FloatGridReader(DataSourceReader):
    def __init__(self, path: str, window: str | None):
        self.path = path
        r0, r1, c0, c1 = map(int, window.split(",")) if window else (0, 2**31 - 1, 0, 2**31 - 1)
        if not (0 <= r0 < r1 and 0 <= c0 < c1):
            raise ValueError(f"not a window: {window}")
        self.low, self.high = {"r": r0, "c": c0}, {"r": r1, "c": c1}

    def partitions(self) -> list[InputPartition]:
        out = []
        for t, r, c in placed(tiles(self.path))[1]:
            rows, columns = (max(self.low["r"] - r, 0), min(self.high["r"] - r, t.rows)), (max(self.low["c"] - c, 0), min(self.high["c"] - c, t.columns))
            if rows[0] < rows[1] and columns[0] < columns[1]:
                step = max(1, PARTITION_CELLS // t.columns)
                out += [Band(t, r, c, (a, min(a + step, rows[1])), columns) for a in range(rows[0], rows[1], step)]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Band):  # nothing in the window
            return
        t, (a, b), (left, right) = partition.tile, partition.rows, partition.columns
        store, name = pafs.FileSystem.from_uri(t.path) if "://" in t.path else (pafs.FileSystem.from_uri(self.path)[0], t.path)
        with store.open_input_file(name) as file:
            file.seek(4 * a * t.columns)
            data = file.read(4 * (b - a) * t.columns)
        if len(data) < 4 * (b - a) * t.columns:
            raise OSError(f"{t.path} is shorter than its header says")
        values = np.frombuffer(data, t.dtype).reshape(b - a, t.columns)[:, left:right].astype(np.float64)
        r, c = np.mgrid[partition.row + a : partition.row + b, partition.column + left : partition.column + right]
        flat = values.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(r.ravel(), pa.int32()), pa.array(c.ravel(), pa.int32()), pa.array(flat, mask=(flat == np.float32(t.nodata)) | np.isnan(flat))], schema=_SCHEMA)


class PushingReader(FloatGridReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else None
            if name not in ("r", "c") or not isinstance(getattr(f, "value", None), int):
                yield f
            elif isinstance(f, EqualTo):
                self.low[name], self.high[name] = max(self.low[name], f.value), min(self.high[name], f.value + 1)
            elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.low[name] = max(self.low[name], f.value + isinstance(f, GreaterThan))
            elif isinstance(f, LessThan | LessThanOrEqual):
                self.high[name] = min(self.high[name], f.value + isinstance(f, LessThanOrEqual))
            else:
                yield f


#: Sessions push filters to Python sources only where this is set; a reader that takes them is refused elsewhere.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def read_grid(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    spark.dataSource.register(FloatGrid)
    reader = spark.read.format("float_grid").option("path", path).option("pushdown", spark.conf.get(PUSHDOWN, "false"))
    return (reader.option("window", ",".join(map(str, window))) if window else reader).load()


def aligned_pair(spark: SparkSession, left: str, right: str, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(r, c, left, right) of two rasters that lie on one grid; others are refused before a cell is read."""
    placed(tiles(left))[0].require_same(placed(tiles(right))[0])
    a, b = read_grid(spark, left, window).withColumnRenamed("value", "left"), read_grid(spark, right, window).withColumnRenamed("value", "right")
    return a.join(b, ["r", "c"])


def class_raster(spark: SparkSession, path: str, classes: Iterable[int], window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(r, c, class): a raster of whole numbers; a value that is no known class fails the query that reads it."""
    known = list(classes)
    value = F.when(F.col("value").isNull() | F.col("value").isin([float(k) for k in known]), F.col("value").cast("int")).otherwise(F.raise_error(F.concat(F.lit("no known class: "), F.col("value").cast("string"))).cast("int"))
    return read_grid(spark, path, window).select("r", "c", value.alias("class"))


def write_grid(cells: DataFrame, path: str, grid: Grid, tile: int = 256) -> DataFrame:
    """Cells (r, c, value) of a grid as tiles of a new folder: (tile, n), one row a tile, after they are written.

    Tasks write a tile under another name and rename it, so one that runs again
    leaves the same file. Cells that are not given are nodata.
    """
    store, base = pafs.FileSystem.from_uri(path)
    if store.get_file_info(base).type != pafs.FileType.NotFound:
        raise FileExistsError(path)

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        store, base = pafs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        tr, tc = map(int, key)
        height, width = min(tile, grid.rows - tr * tile), min(tile, grid.columns - tc * tile)
        values = np.full((height, width), NODATA, "<f4")
        kept = rows.dropna(subset=["value"])
        values[kept.r.to_numpy() - tr * tile, kept.c.to_numpy() - tc * tile] = kept.value.to_numpy()
        header = f"ncols {width}\nnrows {height}\nxllcorner {grid.x0 + tc * tile * grid.cell!r}\nyllcorner {grid.y0 - (tr * tile + height) * grid.cell!r}\ncellsize {grid.cell!r}\nNODATA_value {NODATA!r}\nbyteorder LSBFIRST\n"
        name = f"{base}/tile_{tr:05d}_{tc:05d}"
        for end, data in ((".flt", values.tobytes()), (".hdr", header.encode())):
            with store.open_output_stream(f"{name}{end}.{id(rows)}") as out:
                out.write(data)
            store.move(f"{name}{end}.{id(rows)}", f"{name}{end}")
        return pd.DataFrame({"tile": [f"tile_{tr:05d}_{tc:05d}"], "n": [len(kept)]})

    keyed = cells.select("r", "c", F.col("value").cast("double").alias("value"), F.floor(F.col("r") / tile).alias("tr"), F.floor(F.col("c") / tile).alias("tc"))
    return keyed.groupBy("tr", "tc").applyInPandas(write, "tile string, n long")
