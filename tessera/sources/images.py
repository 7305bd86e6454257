"""Image, animation, point-cloud and flow files as Spark tables, read and written through Spark's file systems.

Files are read with the ``binaryFile`` source and decoded in Arrow batches, so any file system Spark knows will do and
files spread over the cluster. Writers are a Python data source: a row is a file, written by the task that has it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tessera.sources import codecs as C

IMAGE_SCHEMA = "path string, rows int, cols int, channels int, img array<int>"
FRAME_SCHEMA = "path string, frame_no int, start_cs bigint, delay_cs int, rows int, cols int, channels int, img array<int>"
POINT_SCHEMA = "path string, pt_id bigint, x double, y double, z double, nx double, ny double, nz double"


def decode_image(data: bytes) -> np.ndarray:
    return C.decode_png(data) if data.startswith(C.PNG_MAGIC) else C.decode_pnm(data)


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")


def _batches(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def _decoded(files: DataFrame, schema: str, rows_of: Callable[[str, bytes], Iterator[tuple]]) -> DataFrame:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
    names, types = zip(*((f.split(" ")[0], kinds[f.split(" ")[1]]) for f in schema.split(", ")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield _batches(list(rows_of(path, data.as_py())), list(names), list(types))

    return files.mapInArrow(run, schema)


def _image_row(a: np.ndarray) -> tuple:
    return a.shape[0], a.shape[1], 1 if a.ndim == 2 else a.shape[2], a.reshape(-1).astype(np.int32)


def read_images(spark: SparkSession, path: str, pattern: str = "*.{png,pgm,ppm}") -> DataFrame:
    """PNG, PGM and PPM files under ``path``."""

    def rows(p: str, data: bytes) -> Iterator[tuple]:
        yield (p, *_image_row(decode_image(data)))

    return _decoded(_files(spark, path, pattern), IMAGE_SCHEMA, rows)


def read_native_images(spark: SparkSession, path: str) -> DataFrame:
    """Whatever the JVM decodes (JPEG among them), by Spark's own image source; channels turned from BGR to RGB."""
    i = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p, h, w, n, data in zip(*(batch.column(c).to_pylist() for c in ("origin", "height", "width", "nChannels", "data")), strict=True):
                a = np.frombuffer(data, np.uint8).reshape(h, w, n)
                a = a[:, :, [2, 1, 0, *range(3, n)]] if n >= 3 else a[:, :, 0]
                out.append((p, *_image_row(a)))
            yield _batches(out, ["path", "rows", "cols", "channels", "img"], [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32())])

    return i.mapInArrow(run, IMAGE_SCHEMA)


def read_gif(spark: SparkSession, path: str) -> DataFrame:
    """A row for each frame, with its start in 1/100 s."""

    def rows(p: str, data: bytes) -> Iterator[tuple]:
        start = 0
        for k, (a, delay) in enumerate(C.decode_gif(data)):
            yield (p, k, start, delay, *_image_row(a))
            start += delay

    return _decoded(_files(spark, path, "*.gif"), FRAME_SCHEMA, rows)


def read_frames(spark: SparkSession, path: str, delay_cs: int = 4) -> DataFrame:
    """A numbered sequence of image files as frames, in the order of their names within each folder."""
    from pyspark.sql import Window

    w = Window.partitionBy(F.regexp_extract("path", "^(.*)/", 1)).orderBy("path")
    out = read_images(spark, path).withColumn("frame_no", F.row_number().over(w) - 1)
    return out.select(F.regexp_extract("path", "^(.*)/", 1).alias("path"), "frame_no", (F.col("frame_no") * delay_cs).cast("bigint").alias("start_cs"), F.lit(delay_cs).alias("delay_cs"), "rows", "cols", "channels", "img")


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    def rows(p: str, data: bytes) -> Iterator[tuple]:
        v = C.decode_ply(data)
        cols = [v.get(n) for n in ("x", "y", "z", "nx", "ny", "nz")]
        for k in range(len(cols[0])):
            yield (p, k, *(None if c is None else float(c[k]) for c in cols))

    return _decoded(_files(spark, path, "*.ply"), POINT_SCHEMA, rows)


def read_pfm(spark: SparkSession, path: str) -> DataFrame:
    def rows(p: str, data: bytes) -> Iterator[tuple]:
        a = C.decode_pfm(data) if data[:1] == b"P" else C.decode_hdr(data)
        yield (p, a.shape[0], a.shape[1], 1 if a.ndim == 2 else a.shape[2], a.reshape(-1))

    return _decoded(_files(spark, path, "*.{pfm,hdr}"), IMAGE_SCHEMA.replace("array<int>", "array<double>"), rows)


def read_flow(spark: SparkSession, path: str) -> DataFrame:
    def rows(p: str, data: bytes) -> Iterator[tuple]:
        u, v = C.decode_flow(data)
        yield p, u.shape[0], u.shape[1], u.reshape(-1).astype(float), v.reshape(-1).astype(float)

    return _decoded(_files(spark, path, "*.flo"), "path string, rows int, cols int, u array<double>, v array<double>", rows)


class _Wrote(WriterCommitMessage):
    pass


class ImageFiles(DataSource):
    """``df.write.format("image_files").option("path", dir).option("kind", "png")``: columns name, rows, cols,
    channels, img. The folder must be one that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "image_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _ImageWriter(self.options)


class _ImageWriter(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.folder, self.kind = options["path"].removeprefix("file://"), options.get("kind", "png")

    def write(self, rows) -> WriterCommitMessage:
        encode = {"png": C.encode_png, "pgm": C.encode_pnm, "ppm": C.encode_pnm, "pfm": C.encode_pfm}[self.kind]
        folder = Path(self.folder)
        folder.mkdir(parents=True, exist_ok=True)
        for r in rows:
            a = np.array(r["img"])
            a = a.reshape(r["rows"], r["cols"]) if r["channels"] == 1 else a.reshape(r["rows"], r["cols"], r["channels"])
            part = folder / f".{r['name']}.part"
            part.write_bytes(encode(a))
            part.rename(folder / f"{r['name']}.{self.kind}")  # a retried task puts the same file there
        return _Wrote()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ImageFiles)


def encode_images(df: DataFrame, kind: str = "png", keep: str = "name") -> DataFrame:
    """(keep, content): each image's file as bytes."""
    encode = {"png": C.encode_png, "pgm": C.encode_pnm, "ppm": C.encode_pnm, "pfm": C.encode_pfm}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, w, n, img in zip(*(batch.column(c).to_pylist() for c in ("rows", "cols", "channels", "img")), strict=True):
                a = np.array(img)
                out.append(encode(a.reshape(h, w) if n == 1 else a.reshape(h, w, n)))
            yield pa.RecordBatch.from_arrays([batch.column(keep), pa.array(out, pa.binary())], [keep, "content"])

    kind_of = df.schema[keep].dataType.simpleString()
    return df.select(keep, "rows", "cols", "channels", "img").mapInArrow(run, f"{keep} {kind_of}, content binary")


def gif_of_frames(df: DataFrame) -> DataFrame:
    """(clip, content): one animation for each clip from its frames (clip, frame_no, delay_cs, rows, cols, channels, img).
    A clip is written by one task, as a file is; clips spread over the cluster."""

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by("frame_no")
        frames = [np.array(i).reshape(h, w) if n == 1 else np.array(i).reshape(h, w, n) for h, w, n, i in zip(*(t.column(c).to_pylist() for c in ("rows", "cols", "channels", "img")), strict=True)]
        return pa.table({"clip": t.column("clip").slice(0, 1), "content": pa.array([C.encode_gif(frames, t.column("delay_cs").to_pylist())], pa.binary())})

    return df.groupBy("clip").applyInArrow(one, f"clip {df.schema['clip'].dataType.simpleString()}, content binary")
