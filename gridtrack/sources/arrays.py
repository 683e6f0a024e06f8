"""Arrays in compressed chunks with JSON metadata (the public zarr layout, version 2) as a Spark source and sink.

A store is a folder with one folder for each variable over (frame, y, x), whose files ``t.y.x`` each hold one chunk, and one for the
frames' numbers.  A range of frames, rows and columns chooses the chunks that are read; a task reads one chunk at a time and
writes whole ones.  The ranges are options of a load, not pushed filters: this Spark keeps what a filter left on the loaded
table, where a later query of the same DataFrame without that filter would meet it.  Paths are those of pyarrow (``file``, ``hdfs``, ``s3``, ...), so driver and executors have to reach them alike.
"""

from __future__ import annotations

import json
import uuid
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType

FORMAT = "chunked_arrays"


class Store:
    """The files of one store."""

    def __init__(self, path: str):
        path = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
        self.files, self.root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        self.root = self.root.rstrip("/")

    def exists(self, name: str) -> bool:
        return self.files.get_file_info(f"{self.root}/{name}").type != fs.FileType.NotFound

    def get(self, name: str) -> bytes | None:
        """None for a file that is not there: a chunk without values."""
        try:
            with self.files.open_input_stream(f"{self.root}/{name}") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def put(self, name: str, data: bytes) -> None:
        """Under another name first, so that no reader sees half a file and a task that runs twice leaves one whole."""
        at = f"{self.root}/{name}"
        folder = at.rsplit("/", 1)[0]
        self.files.create_dir(folder, recursive=True)
        part = f"{folder}/.part-{uuid.uuid4().hex}"
        with self.files.open_output_stream(part) as f:
            f.write(data)
        self.files.move(part, at)

    def meta(self, variable: str) -> dict:
        said = self.get(f"{variable}/.zarray")
        if said is None:
            raise ValueError(f"no array {variable} in {self.root}")
        meta = json.loads(said)
        if meta["zarr_format"] != 2 or meta.get("filters"):
            raise ValueError(f"{variable}: only version 2 without filters can be read")
        return meta

    def chunk(self, variable: str, meta: dict, place: tuple[int, ...]) -> np.ndarray | None:
        """One chunk without what lies over the array's edge."""
        data = self.get(f"{variable}/{meta.get('dimension_separator', '.').join(map(str, place))}")
        if data is None:
            return None
        whole = np.frombuffer(_unpacked(data, meta["compressor"]), meta["dtype"]).reshape(meta["chunks"], order=meta["order"])
        return whole[tuple(slice(0, n - k * c) for k, c, n in zip(place, meta["chunks"], meta["shape"]))]

    def line(self, variable: str) -> np.ndarray:
        """A whole array of one dimension."""
        meta = self.meta(variable)
        parts = [self.chunk(variable, meta, (k,)) for k in range(-(-meta["shape"][0] // meta["chunks"][0]))]
        if any(p is None for p in parts):
            raise ValueError(f"{variable} has no values")
        return np.concatenate(parts) if parts else np.array([], np.int64)


def _unpacked(data: bytes, compressor: dict | None) -> bytes:
    kind = compressor and compressor["id"]
    if kind is None:
        return data
    if kind in ("zlib", "gzip"):
        return zlib.decompress(data, 47)  # either header
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    raise ValueError(f"compression {kind} cannot be read")


def _missing(values: np.ndarray, fill) -> np.ndarray:
    if values.dtype.kind == "f":
        out = np.isnan(values)
        return out if fill is None or fill == "NaN" else out | (values == float(fill))
    return np.zeros(values.shape, bool) if fill is None else values == fill


class Chunks(InputPartition):
    def __init__(self, places: list[tuple[int, int, int]]):
        self.places = places


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, frame: str, variables: list[str], ranges: list, per_task: int):
        self.path, self.variables, self.per_task = path, variables, per_task
        store = Store(path)
        self.meta = {v: store.meta(v) for v in variables}
        grids = {(tuple(m["shape"]), tuple(m["chunks"])) for m in self.meta.values()}
        if len(grids) != 1:
            raise ValueError("variables differ in shape or chunks")
        self.shape, self.chunks = grids.pop()
        self.names = (frame, "y", "x")
        self.along = [store.line(frame).astype(np.int64), *[np.arange(n, dtype=np.int64) for n in self.shape[1:]]]
        self.asked = [np.ones(len(a), bool) if r is None else (a >= r[0]) & (a <= r[1]) for a, r in zip(self.along, ranges)]

    def partitions(self):
        kept = [[k for k in range(-(-n // c)) if a[k * c : (k + 1) * c].any()] for n, c, a in zip(self.shape, self.chunks, self.asked)]
        places = list(product(*kept))
        return [Chunks(places[i : i + self.per_task]) for i in range(0, len(places), self.per_task)] or [Chunks([])]

    def read(self, partition):
        store = Store(self.path)
        for place in partition.places:
            cuts = [slice(k * c, (k + 1) * c) for k, c in zip(place, self.chunks)]
            inside = np.ix_(*[a[s] for a, s in zip(self.asked, cuts)])
            along = [v[s][a[s]] for v, a, s in zip(self.along, self.asked, cuts)]
            values, absent = [], []
            for v, meta in self.meta.items():
                got = store.chunk(v, meta, place)
                if got is None:
                    # A chunk that is not stored holds the fill value throughout.
                    fill = meta["fill_value"]
                    got = np.full([len(a[s]) for a, s in zip(self.asked, cuts)], (np.nan if np.dtype(meta["dtype"]).kind == "f" else 0) if fill is None else fill, meta["dtype"])
                got = got[inside]
                values.append(got)
                absent.append(_missing(got, meta["fill_value"]))
            t, y, x = np.nonzero(~np.logical_and.reduce(absent))
            columns = [pa.array(along[0][t]), pa.array(along[1][y].astype(np.int32)), pa.array(along[2][x].astype(np.int32))]
            columns += [pa.array(v[t, y, x].astype("f8" if v.dtype.kind == "f" else "i8"), mask=m[t, y, x]) for v, m in zip(values, absent)]
            yield pa.RecordBatch.from_arrays(columns, [*self.names, *self.variables])


class ArrayWriter(DataSourceArrowWriter):
    """Rows in the order of chunks, those of a chunk together (:func:`write_arrays` sees to that)."""

    def __init__(self, path: str, frame: str, variables: list[str]):
        self.path, self.frame, self.variables = path, frame, variables

    def write(self, iterator):
        store = Store(self.path)
        meta = {v: store.meta(v) for v in self.variables}
        shape, chunks = (meta[self.variables[0]][k] for k in ("shape", "chunks"))
        frames, now, held, written = store.line(self.frame), None, None, set()

        def flush():
            if now is not None:
                written.add(now)
                for v, values in held.items():
                    store.put(f"{v}/{'.'.join(map(str, now))}", zlib.compress(values.tobytes(), meta[v]["compressor"]["level"]))

        for batch in iterator:
            if not batch.num_rows:
                continue
            at = np.stack([np.searchsorted(frames, batch[self.frame].to_numpy(zero_copy_only=False)), batch["y"].to_numpy(zero_copy_only=False), batch["x"].to_numpy(zero_copy_only=False)])
            if (at < 0).any() or (at >= np.array(shape)[:, None]).any():
                raise ValueError("a pixel lies outside the array")
            place, inside = at // np.array(chunks)[:, None], at.astype(int) % np.array(chunks)[:, None]
            starts = np.flatnonzero(np.r_[True, (np.diff(place) != 0).any(0)])
            for a, b in zip(starts, [*starts[1:], at.shape[1]]):
                if (this := tuple(place[:, a].astype(int).tolist())) != now:
                    flush()
                    if this in written:
                        raise ValueError("rows of a chunk have to come together")
                    now, held, seen = this, {v: np.full(chunks, np.nan, meta[v]["dtype"]) for v in self.variables}, np.zeros(chunks, bool)
                own = tuple(inside[:, a:b])
                if seen[own].any() or len(np.unique(np.ravel_multi_index(own, chunks))) < b - a:
                    raise ValueError("two rows for one pixel")
                seen[own] = True
                for v in self.variables:
                    held[v][own] = batch[v].slice(a, b - a).cast(pa.float64()).to_numpy(zero_copy_only=False)
        flush()
        return WriterCommitMessage()

    def commit(self, messages):
        Store(self.path).put(".zgroup", b'{"zarr_format": 2}')


class ChunkedArrays(DataSource):
    """``spark.read.format("chunked_arrays").option("variables", "tb,rain").load(path)``: rows of pixels with a value.

    Options: ``variables``; ``frame``, the array that numbers the frames and the column of that name (frame_id); ``frames``, ``rows``,
    ``columns``, ranges such as ``[3, 7]`` with both ends, outside of which nothing is read; ``per_task``, chunks a task reads one after the other (1).  Whole numbers are longs, others doubles; the fill value is null, and pixels at which all variables are null have no row.
    """

    @classmethod
    def name(cls):
        return FORMAT

    def _settings(self):
        variables = [v for v in self.options.get("variables", "").split(",") if v]
        if not variables:
            raise ValueError("name the variables")
        return self.options["path"], self.options.get("frame", "frame_id"), variables

    def schema(self):
        path, frame, variables = self._settings()
        store, out = Store(path), StructType().add(frame, LongType()).add("y", IntegerType()).add("x", IntegerType())
        if not store.exists(".zgroup"):
            raise ValueError(f"{path} is not a store, or was not written to its end")
        for v in variables:
            out.add(v, DoubleType() if np.dtype(store.meta(v)["dtype"]).kind == "f" else LongType())
        return out

    def reader(self, schema):
        ranges = [json.loads(self.options.get(name, "null")) for name in ("frames", "rows", "columns")]
        return ArrayReader(*self._settings(), ranges, int(self.options.get("per_task", 1)))

    def writer(self, schema, overwrite):
        return ArrayWriter(*self._settings())


def read_arrays(spark: SparkSession, path: str, variables: list[str], frame: str = "frame_id", frames: tuple[int, int] | None = None, rows: tuple[int, int] | None = None, columns: tuple[int, int] | None = None, per_task: int = 1) -> DataFrame:
    """(frame, y, x, one column a variable); see :class:`ChunkedArrays`."""
    spark.dataSource.register(ChunkedArrays)
    options = {name: json.dumps(r) for name, r in (("frames", frames), ("rows", rows), ("columns", columns))}
    return spark.read.format(FORMAT).options(variables=",".join(variables), frame=frame, per_task=per_task, **options).load(path)


def write_arrays(pixels: DataFrame, path: str, shape: tuple[int, int], chunks: tuple[int, int, int], variables: list[str], frame: str = "frame_id", overwrite: bool = False, level: int = 1) -> None:
    """Writes ``pixels`` (frame, y, x and numeric ``variables``) as arrays of doubles over all frames that occur, in chunks of (frames, rows, columns).

    ``pixels`` is read twice, first for its frames, of which the driver holds a number each.  Absent and null pixels are missing;
    two rows for one pixel, and pixels beyond ``shape``, are errors.  A store that is there is an error too, unless
    ``overwrite`` is set: its named arrays go then.
    """
    spark = pixels.sparkSession
    spark.dataSource.register(ChunkedArrays)
    store = Store(path)
    if store.exists(".zgroup"):
        if not overwrite:
            raise ValueError(f"{path} is there already")
        store.files.delete_file(f"{store.root}/.zgroup")
        for v in [frame, *variables]:
            if store.exists(f"{v}/.zarray"):
                store.files.delete_dir(f"{store.root}/{v}")
    frames = np.array([r[0] for r in pixels.select(frame).where(F.col(frame).isNotNull()).distinct().orderBy(frame).collect()], np.int64)
    common = {"zarr_format": 2, "compressor": {"id": "zlib", "level": level}, "order": "C", "filters": None}
    for v in variables:
        store.put(f"{v}/.zarray", json.dumps({**common, "shape": [len(frames), *shape], "chunks": list(chunks), "dtype": "<f8", "fill_value": "NaN"}).encode())
    store.put(f"{frame}/.zarray", json.dumps({**common, "shape": [len(frames)], "chunks": [max(len(frames), 1)], "dtype": "<i8", "fill_value": None}).encode())
    store.put(f"{frame}/0", zlib.compress(frames.astype("<i8").tobytes(), level))
    # The place of a frame among all; a table of one row a frame, as small as the list it comes from.
    places = spark.createDataFrame([(int(f), k // chunks[0]) for k, f in enumerate(frames)], f"`{frame}` long, _t long")
    dealt = pixels.select(F.col(frame).cast("long").alias(frame), "y", "x", *variables).join(F.broadcast(places), frame)
    key = [F.col("_t"), F.floor(F.col("y") / chunks[1]).alias("_y"), F.floor(F.col("x") / chunks[2]).alias("_x")]
    rows = dealt.select("*", *key[1:]).repartition("_t", "_y", "_x").sortWithinPartitions("_t", "_y", "_x").select(frame, "y", "x", *variables)
    rows.write.format(FORMAT).option("variables", ",".join(variables)).option("frame", frame).mode("append").save(path)
