"""Raw rasters as a Spark data source: windows and bands are read block by block, blocks are written in two phases.

A raster is one raw file beside its ENVI header, or a folder of raw blocks under one ``raster.hdr``. Any file system that
pyarrow opens by its address will do; executors and driver must reach the same one. Cells whose bands are all no data
aren't rows.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from gridlake.model import Extent
from gridlake.sources.metadata import ENVI_KINDS

NAME = "gridlake_raster"
STRIP_BYTES = 8 << 20  # of a single file that a task reads
BLOCK = 256


@dataclass(frozen=True)
class Layout:
    """What a header says. ``block`` is 0 for a single file; ``offset`` counts bytes before its first value."""

    rows: int
    columns: int
    bands: int
    kind: int = 5
    interleave: str = "bsq"
    block: int = 0
    offset: int = 0
    big_endian: bool = False
    no_data: float | None = None
    left: float = 0.0
    top: float = 0.0
    width: float = 1.0
    height: float = 1.0

    @property
    def dtype(self) -> np.dtype:
        d = np.dtype(ENVI_KINDS[self.kind])
        return d.newbyteorder(">") if self.big_endian else d

    @property
    def extent(self) -> Extent:
        return Extent(self.left, self.top, self.left + self.columns * self.width, self.top - self.rows * self.height, self.width, self.height)

    def text(self) -> str:
        lines = ["ENVI", f"samples = {self.columns}", f"lines = {self.rows}", f"bands = {self.bands}", f"header offset = {self.offset}", f"data type = {self.kind}", f"interleave = {self.interleave}", f"byte order = {int(self.big_endian)}"]
        lines += [f"map info = {{Arbitrary, 1, 1, {self.left!r}, {self.top!r}, {self.width!r}, {self.height!r}}}"]
        lines += [] if self.no_data is None else [f"data ignore value = {self.no_data!r}"]
        lines += [f"block size = {self.block}"] if self.block else []
        return "\n".join(lines) + "\n"


def parsed(text: str) -> Layout:
    """The layout of an ENVI header. ValueError if it names no size or a type that isn't known."""
    found = {k.strip().lower(): v.strip() for k, v in re.findall(r"(?m)^([\w ]+?)\s*=\s*(\{[^}]*\}|[^\r\n]*)", text)}
    try:
        info = [v.strip() for v in found.get("map info", "").strip("{}").split(",")]
        place = dict(zip(("left", "top", "width", "height"), map(float, info[3:7]))) if len(info) >= 7 else {}
        out = Layout(
            int(found["lines"]), int(found["samples"]), int(found.get("bands", 1)), int(found["data type"]), found.get("interleave", "bsq").lower(),
            int(found.get("block size", 0)), int(found.get("header offset", 0)), found.get("byte order", "0") == "1", float(found["data ignore value"]) if "data ignore value" in found else None, **place,
        )
    except KeyError as e:
        raise ValueError(f"the header has no {e.args[0]!r}") from None
    if out.kind not in ENVI_KINDS or out.interleave not in ("bsq", "bil", "bip"):
        raise ValueError(f"data type {out.kind} or interleave {out.interleave!r} is not known")
    return out


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"\w[\w+.-]*:", path) else (fs.LocalFileSystem(), path)


def _exists(store: fs.FileSystem, path: str) -> bool:
    return store.get_file_info(path).type != fs.FileType.NotFound


def layout(path: str) -> Layout:
    """The layout of a raster. FileNotFoundError if it has no header, as before its first write is committed."""
    store, at = _place(path)
    for name in (f"{at}/raster.hdr", f"{at}.hdr", posixpath.splitext(at)[0] + ".hdr"):
        if _exists(store, name):
            with store.open_input_stream(name) as f:
                return parsed(f.read().decode("latin-1"))
    raise FileNotFoundError(f"no header of {path}")


def read_part(store: fs.FileSystem, path: str, shape: tuple[int, int], of: Layout, rows: tuple[int, int], columns: tuple[int, int], bands: list[int]) -> np.ndarray:
    """(band, row, column) of a file of so many rows and columns; only the rows asked for, and of bsq only the bands, are read."""
    h, w = shape
    n, size = rows[1] - rows[0], of.dtype.itemsize
    with store.open_input_file(path) as f:

        def values(first: int, count: int) -> np.ndarray:
            f.seek(of.offset + first * size)
            got = f.read(count * size)
            if len(got) < count * size:
                raise ValueError(f"{path} is shorter than its header says")
            return np.frombuffer(got, of.dtype)

        if of.interleave == "bsq":
            out = np.stack([values(((b - 1) * h + rows[0]) * w, n * w).reshape(n, w) for b in bands])
        else:
            whole = values(rows[0] * w * of.bands, n * w * of.bands)
            whole = whole.reshape(n, of.bands, w).transpose(1, 0, 2) if of.interleave == "bil" else whole.reshape(n, w, of.bands).transpose(2, 0, 1)
            out = whole[[b - 1 for b in bands]]
    return out[:, :, columns[0] : columns[1]]


@dataclass
class Part(InputPartition):
    """A file, the cells of the raster it holds, and those of them to read: (first row, end, first column, end)."""

    file: str
    whole: tuple[int, int, int, int]
    cells: tuple[int, int, int, int]


class Reader(DataSourceReader):
    def __init__(self, path: str, bands: list[int], of: Layout, strip: int):
        self.path, self.bands, self.of, self.strip = path, bands, of, strip
        self.low, self.end = {"i": 0, "j": 0}, {"i": of.rows, "j": of.columns}

    def pushFilters(self, filters):
        """Bounds of i and j choose the blocks, and the cells of them, that are read; nothing is left of them for Spark."""
        for f in filters:
            c = ".".join(getattr(f, "attribute", ()))
            v = getattr(f, "value", None)
            if c in self.low and isinstance(v, int) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low[c] = max(self.low[c], v + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.end[c] = min(self.end[c], v + (not isinstance(f, LessThan)))
            else:
                yield f

    def partitions(self) -> list[Part]:
        i0, i1, j0, j1 = self.low["i"], self.end["i"], self.low["j"], self.end["j"]
        of, out = self.of, []
        if i0 >= i1 or j0 >= j1:
            return []
        if of.block:
            for a in range(i0 // of.block * of.block, i1, of.block):
                for b in range(j0 // of.block * of.block, j1, of.block):
                    whole = (a, min(a + of.block, of.rows), b, min(b + of.block, of.columns))
                    out.append(Part(f"{self.path}/block-{a // of.block}-{b // of.block}.dat", whole, (max(a, i0), min(whole[1], i1), max(b, j0), min(whole[3], j1))))
        else:
            step = max(1, self.strip // (of.columns * of.bands * of.dtype.itemsize))
            out = [Part(self.path, (0, of.rows, 0, of.columns), (a, min(a + step, i1), j0, j1)) for a in range(i0, i1, step)]
        return out

    def read(self, part: Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no part to read
            return
        store, path = _place(part.file)
        if self.of.block and not _exists(store, path):  # a block without data
            return
        a, b, c, d = part.whole
        i0, i1, j0, j1 = part.cells
        got = read_part(store, path, (b - a, d - c), self.of, (i0 - a, i1 - a), (j0 - c, j1 - c), self.bands).astype(float)
        some = np.ones(got.shape[1:], bool) if self.of.no_data is None else (got != self.of.no_data).any(0)
        i, j = np.nonzero(some)
        yield pa.RecordBatch.from_arrays([pa.array(i + i0), pa.array(j + j0), *(pa.array(v[some]) for v in got)], ["i", "j", *(f"b{k}" for k in self.bands)])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class Writer(DataSourceArrowWriter):
    """Tasks write whole blocks into a folder of this write; the commit moves them to their names and writes the header
    last, so that before it no reader finds the raster, and an abort takes the folder away."""

    def __init__(self, path: str, of: Layout, bands: list[str], overwrite: bool):
        self.path, self.of, self.bands, self.overwrite = path, of, bands, overwrite
        self.staged = f"{path}/.staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, staged = _place(self.staged)
        store.create_dir(staged, recursive=True)
        files, now, held = [], None, None

        def flush():
            if now is not None:
                name = f"{staged}/{uuid.uuid4().hex}"
                order = {"bsq": (0, 1, 2), "bil": (1, 0, 2), "bip": (1, 2, 0)}[self.of.interleave]
                with store.open_output_stream(name) as f:
                    f.write(np.ascontiguousarray(held.transpose(order)).tobytes())
                files.append((name, f"block-{now[0]}-{now[1]}.dat"))

        for batch in iterator:
            i, j = (batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in ("i", "j"))
            values = np.stack([batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False).astype(float) for c in self.bands])
            if self.of.no_data is not None:
                values[np.isnan(values)] = self.of.no_data
            a, b = i // self.of.block, j // self.of.block
            edge = np.flatnonzero((np.diff(a) != 0) | (np.diff(b) != 0)) + 1
            for own in np.split(np.arange(len(i)), edge) if len(i) else []:
                at = int(a[own[0]]), int(b[own[0]])
                if at != now:
                    flush()
                    shape = [min(self.of.block, n - k * self.of.block) for n, k in zip((self.of.rows, self.of.columns), at)]
                    now, held = at, np.full((len(self.bands), *shape), self.of.no_data or 0, self.of.dtype)
                held[:, i[own] % self.of.block, j[own] % self.of.block] = values[:, own]
        flush()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = _place(self.path)
        header = f"{at}/raster.hdr"
        if self.overwrite and _exists(store, at):
            for f in store.get_file_info(fs.FileSelector(at)):
                if f.type == fs.FileType.File and re.fullmatch(r"raster\.hdr|block-\d+-\d+\.dat", f.base_name):
                    store.delete_file(f.path)
        store.create_dir(at, recursive=True)
        for m in messages:
            for staged, name in m.files if m else []:
                store.move(staged, f"{at}/{name}")
        with store.open_output_stream(f"{header}.new") as f:
            f.write(self.of.text().encode())
        store.move(f"{header}.new", header)
        self.abort([])

    def abort(self, messages) -> None:
        store, staged = _place(self.staged)
        if _exists(store, staged):
            store.delete_dir(staged)


class RasterSource(DataSource):
    """Options: path; to read, ``bands`` as numbers between commas, and ``strip`` for bytes of a single file a task; to write, what ``Layout`` holds."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _bands(self) -> list[int]:
        named = self.options.get("bands")
        return [int(b) for b in named.split(",")] if named else list(range(1, layout(self.options["path"]).bands + 1))

    def schema(self) -> str:
        return ", ".join(["i bigint", "j bigint", *(f"b{b} double" for b in self._bands())])

    def reader(self, schema) -> Reader:
        of = layout(self.options["path"])
        if bad := [b for b in self._bands() if not 1 <= b <= of.bands]:
            raise ValueError(f"no band {bad[0]}: the raster has {of.bands}")
        return Reader(self.options["path"], self._bands(), of, int(self.options.get("strip", STRIP_BYTES)))

    def writer(self, schema, overwrite: bool) -> Writer:
        names = [f.name for f in schema.fields if f.name not in ("i", "j")]
        of = parsed(self.options["header"])
        if not overwrite:
            of_old = layout(self.options["path"])
            if of_old != of:
                raise ValueError("the raster that is there has another layout")
        return Writer(self.options["path"], of, names, overwrite)


def open_raster(spark: SparkSession, path: str, bands: list[int] | None = None, strip: int = STRIP_BYTES) -> DataFrame:
    """(i, j, b1, ...) of a raster's bands, from 1. Bounds of i and j, as of ``grid.window``, reach the scan.

    Asking for a band that isn't there, or a path without header, is an error before any task runs."""
    spark.dataSource.register(RasterSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    r = spark.read.format(NAME).option("path", path).option("strip", strip)
    return (r.option("bands", ",".join(map(str, bands))) if bands else r).load()


def check_bands(spark: SparkSession, path: str, strip: int = STRIP_BYTES) -> DataFrame:
    """(band, parts, bad, reasons): how many parts of each band can't be read, as files that are missing or too short, or
    hold values that are not finite, and why; parts are read by tasks. A block that was never written isn't bad."""
    of = layout(path)
    parts = Reader(path, [1], of, strip).partitions()
    rows = spark.createDataFrame([(p.file, *p.whole, *p.cells, b) for p in parts for b in range(1, of.bands + 1)], "file string, a long, b long, c long, d long, i0 long, i1 long, j0 long, j1 long, band int")

    def run(batches):
        for pdf in batches:
            said = []
            for r in pdf.itertuples():
                store, at = _place(r.file)
                try:
                    if of.block and not _exists(store, at):
                        said.append(None)
                        continue
                    got = read_part(store, at, (r.b - r.a, r.d - r.c), of, (r.i0 - r.a, r.i1 - r.a), (r.j0 - r.c, r.j1 - r.c), [r.band])
                    said.append(None if np.isfinite(got.astype(float)).all() else "not finite")
                except (OSError, ValueError) as e:
                    said.append("too short" if isinstance(e, ValueError) else "can't be read")
            yield pd.DataFrame({"band": pdf.band, "reason": said})

    found = rows.repartition(max(1, min(len(parts), 200))).mapInPandas(run, "band int, reason string")
    return found.groupBy("band").agg(F.count(F.lit(1)).alias("parts"), F.count("reason").alias("bad"), F.array_sort(F.collect_set("reason")).alias("reasons"))


def write_raster(pixels: DataFrame, path: str, bands: list[str], like: Layout | None = None, mode: str = "overwrite", **how) -> Layout:
    """Writes columns of ``pixels`` as bands 1, 2 and so on, in blocks, and returns the layout.

    ``how`` are fields of ``Layout``: rows and columns (else those that the last cell needs), kind, interleave, block,
    no_data, left, top, width, height; ``like`` gives them all. Cells outside are left out; cells that have no row, and
    null values, become ``no_data``; of several rows of a cell one is kept. ``append`` replaces the blocks it has rows
    of and leaves others as they are. Rows are dealt out by block, so a task holds one block at a time."""
    spark = pixels.sparkSession
    spark.dataSource.register(RasterSource)
    if like is None:
        if "rows" not in how or "columns" not in how:
            last = pixels.agg(F.max("i").alias("i"), F.max("j").alias("j")).first()
            how = {"rows": 0 if last.i is None else last.i + 1, "columns": 0 if last.j is None else last.j + 1} | how
        like = Layout(**({"bands": len(bands), "block": BLOCK, "no_data": -9999.0} | how))
    a, b = (F.floor(F.col(c) / like.block) for c in ("i", "j"))
    own = pixels.where(F.col("i").between(0, like.rows - 1) & F.col("j").between(0, like.columns - 1))
    own = own.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), *(F.col(c).cast("double").alias(c) for c in bands))
    own.repartition(a, b).sortWithinPartitions(a, b).write.format(NAME).mode(mode).options(path=path, header=like.text()).save()
    return like


def create_raster(spark: SparkSession, path: str, rows: int, columns: int, values: list[float], **how) -> Layout:
    """A raster of one value for each band."""
    cells = spark.range(rows * columns).select(F.floor(F.col("id") / columns).alias("i"), (F.col("id") % columns).alias("j"), *(F.lit(float(v)).alias(f"b{k}") for k, v in enumerate(values, 1)))
    return write_raster(cells, path, [f"b{k}" for k in range(1, len(values) + 1)], rows=rows, columns=columns, **how)
