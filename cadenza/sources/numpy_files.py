"""Arrays of NumPy files as tables: .npz archives, and folders of .npy files, of arrays with equally many rows.

Reading takes the headers first and plans ranges of rows; a task reads its own range of each array that is asked for, byte by byte where it lies, and no
more. Writing leaves archives of a bounded number of rows; they appear under their names when all tasks are done, or not at all.
"""

from __future__ import annotations

import io
import posixpath
import struct
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

ROWS = 50_000
#: Rows of a batch while reading.
BATCH = 2_000
KINDS = {"f4": "float", "f8": "double", "f2": "float", "i1": "tinyint", "i2": "smallint", "i4": "int", "i8": "bigint", "u1": "smallint", "u2": "int", "u4": "bigint", "b1": "boolean"}
ARROW = {"float": pa.float32(), "double": pa.float64(), "tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it, of a URI or a local path."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Stored:
    """Where an array lies: the file, the member of the archive or None, the first byte of its values (-1 if they are compressed), shape and type."""

    path: str
    member: str | None
    at: int
    shape: tuple[int, ...]
    dtype: str

    @property
    def kind(self) -> str:
        d = np.dtype(self.dtype)
        one = "string" if d.kind in "US" else KINDS.get(d.kind + str(d.itemsize))
        if one is None:
            raise ValueError(f"no column type for NumPy type {self.dtype}")
        return one if len(self.shape) == 1 else f"array<{one}>"

    @property
    def row_bytes(self) -> int:
        return int(np.prod(self.shape[1:], dtype=np.int64)) * np.dtype(self.dtype).itemsize


def header(f) -> tuple[tuple[int, ...], str, int]:
    """(shape, type, bytes of the header) of an array file from its start."""
    version = np.lib.format.read_magic(f)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if fortran and len(shape) > 1 or dtype.hasobject or not shape:
        raise ValueError("arrays must have rows, lie row by row, and hold no objects")
    return shape, dtype.str, f.tell()


def arrays_of(path: str) -> dict[str, Stored]:
    """The arrays of an archive, or of the .npy files of a folder, by name. Only headers are read."""
    system, at = opened(path)
    if system.get_file_info(at).type == pafs.FileType.Directory:
        out = {}
        for info in system.get_file_info(pafs.FileSelector(at)):
            if info.path.endswith(".npy"):
                with system.open_input_file(info.path) as f:
                    shape, dtype, size = header(f)
                out[posixpath.basename(info.path)[:-4]] = Stored(f"{path.rstrip('/')}/{posixpath.basename(info.path)}", None, size, shape, dtype)
        return out
    out = {}
    with system.open_input_file(at) as f, zipfile.ZipFile(f) as z:
        for m in z.infolist():
            if not m.filename.endswith(".npy"):
                continue
            with z.open(m) as member:
                shape, dtype, size = header(member)
            begin = -1
            if m.compress_type == zipfile.ZIP_STORED:
                f.seek(m.header_offset + 26)
                name, extra = struct.unpack("<HH", f.read(4))
                begin = m.header_offset + 30 + name + extra + size
            out[m.filename[:-4]] = Stored(path, m.filename, begin, shape, dtype)
    return out


def rows_of(a: Stored, first: int, stop: int) -> np.ndarray:
    """Rows [first, stop): the bytes from where they begin. A compressed member has to be read up to there."""
    system, at = opened(a.path)
    size = (stop - first) * a.row_bytes
    with system.open_input_file(at) as f:
        if a.at >= 0:
            f.seek(a.at + first * a.row_bytes)
            raw = f.read(size)
        else:
            with zipfile.ZipFile(f) as z, z.open(a.member) as member:
                header(member)
                left = first * a.row_bytes
                while left:
                    left -= len(member.read(min(left, 1 << 20)))
                raw = member.read(size)
    return np.frombuffer(raw, a.dtype).reshape(stop - first, *a.shape[1:])


def column(values: np.ndarray, kind: str) -> pa.Array:
    inner = ARROW[kind[6:-1] if kind.startswith("array") else kind]
    flat = values.ravel()
    if flat.dtype.kind == "S":
        flat = np.char.decode(flat, "utf-8")
    made = pa.array(flat.tolist() if flat.dtype.kind == "U" else np.ascontiguousarray(flat.astype(flat.dtype.newbyteorder("="))), type=None if flat.dtype.kind != "U" else pa.string()).cast(inner)
    if not kind.startswith("array"):
        return made
    wide = flat.size // max(len(values), 1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * wide), made)


@dataclass
class Range(InputPartition):
    arrays: dict[str, Stored]
    first: int
    stop: int


class ArraySource(DataSource):
    """Options: path (an archive, a folder of archives or one of .npy files), arrays (names, comma-separated; all), first and stop (rows of each file, for a part of
    them), rows (of a task and of a written file). Columns are named as the arrays; rows of more than one value are flat arrays."""

    @classmethod
    def name(cls) -> str:
        return "numpy"

    def files(self) -> list[dict[str, Stored]]:
        path = self.options["path"]
        system, at = opened(path)
        inside = sorted(i.path for i in system.get_file_info(pafs.FileSelector(at)) if i.path.endswith(".npz")) if system.get_file_info(at).type == pafs.FileType.Directory else []
        found = [arrays_of(f"{path.rstrip('/')}/{posixpath.basename(p)}") for p in inside] or [arrays_of(path)]
        wanted = [n.strip() for n in self.options["arrays"].split(",")] if self.options.get("arrays") else None
        out = []
        for arrays in found:
            missing = [n for n in wanted or [] if n not in arrays]
            if missing:
                raise ValueError(f"no array {', '.join(missing)} in {path}")
            some = {n: arrays[n] for n in wanted or arrays}
            if len({a.shape[0] for a in some.values()}) > 1:
                raise ValueError(f"arrays of different numbers of rows in {path}: name those that belong together")
            out.append(some)
        return out

    def schema(self) -> str:
        return ", ".join(f"`{n}` {a.kind}" for n, a in self.files()[0].items())

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrayReader(self, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ArrayWriter(self.options["path"], int(self.options.get("rows", ROWS)), overwrite)


class ArrayReader(DataSourceReader):
    def __init__(self, source: ArraySource, schema: StructType):
        self.source, self.names = source, schema.fieldNames()

    def partitions(self) -> Sequence[InputPartition]:
        o = self.source.options
        step, out = int(o.get("rows", ROWS)), []
        for arrays in self.source.files():
            n = next(iter(arrays.values())).shape[0] if arrays else 0
            first, stop = min(int(o.get("first", 0)), n), min(int(o.get("stop", n)), n)
            out += [Range({k: arrays[k] for k in self.names}, i, min(i + step, stop)) for i in range(first, stop, step)]
        return out or [Range({}, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for i in range(partition.first, partition.stop, BATCH):
            j = min(i + BATCH, partition.stop)
            yield pa.RecordBatch.from_arrays([column(rows_of(a, i, j), a.kind) for a in partition.arrays.values()], list(partition.arrays))


@dataclass
class Parts(WriterCommitMessage):
    names: list[str]


class ArrayWriter(DataSourceArrowWriter):
    """Tasks write archives into a folder of this write's own; the driver moves them to their places once, when all are there."""

    def __init__(self, path: str, rows: int, overwrite: bool):
        self.path, self.rows, self.overwrite, self.run = path.rstrip("/"), rows, overwrite, uuid.uuid4().hex

    @property
    def aside(self) -> str:
        return f"{self.path}/_writing-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        names, held, size = [], [], 0
        system, aside = opened(self.aside)
        system.create_dir(aside, recursive=True)

        def save() -> None:
            t = pa.Table.from_batches(held)
            raw = io.BytesIO()
            np.savez(raw, **{n: as_numpy(t.column(n).combine_chunks()) for n in t.column_names})
            name = f"part-{uuid.uuid4().hex}.npz"  # a task that is tried again has names of its own
            with system.open_output_stream(f"{aside}/{name}") as f:
                f.write(raw.getbuffer())
            names.append(name)

        for b in iterator:
            at = 0
            while at < b.num_rows:
                some = b.slice(at, self.rows - size)
                held.append(some)
                at, size = at + some.num_rows, size + some.num_rows
                if size == self.rows:
                    save()
                    held, size = [], 0
        if size:
            save()
        return Parts(names)

    def commit(self, messages: list[Parts | None]) -> None:
        system, path = opened(self.path)
        _, aside = opened(self.aside)
        before = [i.path for i in system.get_file_info(pafs.FileSelector(path)) if i.path.endswith(".npz")]
        for name in (n for m in messages if m for n in m.names):
            system.move(f"{aside}/{name}", f"{path}/{name}")
        for old in before if self.overwrite else []:
            system.delete_file(old)
        system.delete_dir(aside)

    def abort(self, messages: list[Parts | None]) -> None:
        system, aside = opened(self.aside)
        if system.get_file_info(aside).type == pafs.FileType.Directory:
            system.delete_dir(aside)


def as_numpy(a: pa.Array) -> np.ndarray:
    """A column as an array: lists must be of one length."""
    if a.null_count:
        raise ValueError("arrays have no nulls")
    if pa.types.is_list(a.type):
        flat = as_numpy(a.flatten())
        wide = len(flat) // max(len(a), 1)
        if len(a) and not (np.diff(a.offsets.to_numpy()) == wide).all():
            raise ValueError("rows of different lengths are no array")
        return flat.reshape(len(a), wide)
    if pa.types.is_string(a.type) or pa.types.is_large_string(a.type):
        return np.array(a.to_pylist(), dtype=str)
    return a.to_numpy(zero_copy_only=False)


def read_arrays(spark: SparkSession, path: str, arrays: list[str] | None = None, first: int | None = None, stop: int | None = None, rows: int = ROWS) -> DataFrame:
    """A table of the arrays named (all, if they have as many rows), or of the rows from `first` to before `stop` of each file."""
    spark.dataSource.register(ArraySource)
    r = spark.read.format("numpy").option("path", path).option("rows", str(rows))
    for name, value in (("arrays", ",".join(arrays) if arrays else None), ("first", first), ("stop", stop)):
        if value is not None:
            r = r.option(name, str(value))
    return r.load()


def write_arrays(df: DataFrame, path: str, rows: int = ROWS, overwrite: bool = True) -> None:
    """Archives of at most `rows` rows, an array for each column. Nulls, and lists of different lengths, are errors, and leave what was there."""
    df.sparkSession.dataSource.register(ArraySource)
    df.write.format("numpy").mode("overwrite" if overwrite else "append").option("path", path).option("rows", str(rows)).save()
