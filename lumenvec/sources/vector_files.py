"""A data source for binary vector files, read in byte ranges and written by tasks: fbin, u8bin, i8bin, bvecs, npy, truth, range_truth, csr.

Fixed values, the formats (all little-endian):

- fbin, u8bin, i8bin: uint32 rows, uint32 columns, then the rows as float32, uint8 or int8.
- bvecs: rows of an int32 dimension and so many uint8.
- npy: version 1 or 2, two-dimensional float16 in row order.
- truth: uint32 queries, uint32 k, then all uint32 ids, then all float32 distances.
- range_truth: int32 queries, int32 results, an int32 count for each query, then all int32 ids, then all float32 distances.
- csr: int64 rows, columns and entries, int64 offsets (one more than rows), then all int32 columns, then all float32 values.
"""

from __future__ import annotations

import ast
import json
import posixpath
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StructType

MANIFEST = "_files.json"
#: Bytes of a split, and of a file that a task writes, at about most; rows of a batch.
SPLIT_BYTES, FILE_BYTES, BATCH_ROWS = 64 << 20, 256 << 20, 8192

_NUMBERS = {"fbin": "<f4", "u8bin": "u1", "i8bin": "i1", "bvecs": "u1", "npy": "<f2"}
_LISTS = {"truth": ("neighbors", "distances", "<u4", "<f4"), "range_truth": ("neighbors", "distances", "<i4", "<f4"), "csr": ("indices", "values", "<i4", "<f4")}


def schema_of(kind: str) -> StructType:
    schema, floats = StructType().add("id", LongType()), ArrayType(FloatType())
    if kind in _NUMBERS:
        return schema.add("vec", floats)
    if kind not in _LISTS:
        raise ValueError(f"unknown kind of vector file: {kind}")
    first, second, *_ = _LISTS[kind]
    return schema.add(first, ArrayType(IntegerType() if kind == "csr" else LongType())).add(second, floats)


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Rows(InputPartition):
    """Rows ``lo`` to ``hi`` of a file whose row 0 has the id ``first``; their entries begin at ``entry``, where rows differ in length."""

    file: str
    lo: int
    hi: int
    first: int
    shape: dict
    entry: int = 0

    def __init__(self, file: str, lo: int, hi: int, first: int, shape: dict, entry: int = 0) -> None:
        super().__init__(None)
        self.file, self.lo, self.hi, self.first, self.shape, self.entry = file, lo, hi, first, shape, entry


def _numbers(f, dtype: str, n: int, at: int) -> np.ndarray:
    raw = f.read_at(n * np.dtype(dtype).itemsize, at)
    if len(raw) != n * np.dtype(dtype).itemsize:
        raise ValueError("a vector file ends before its header says")
    return np.frombuffer(raw, dtype)


def shape_of(f, kind: str, size: int) -> dict:
    """What a file's header says: rows, and where they lie."""
    if kind == "bvecs":
        if not size:
            return {"rows": 0, "dim": 0, "at": 4, "step": 4}
        dim = int(_numbers(f, "<i4", 1, 0)[0])
        if size % (dim + 4):
            raise ValueError("rows of a bvecs file differ in length")
        return {"rows": size // (dim + 4), "dim": dim, "at": 4, "step": dim + 4}
    if kind == "npy":
        magic = f.read_at(12, 0)
        wide = 4 if magic[6] == 2 else 2
        length = int.from_bytes(magic[8 : 8 + wide], "little")
        said = ast.literal_eval(f.read_at(length, 8 + wide).decode("latin1").strip())
        if magic[:6] != b"\x93NUMPY" or said["descr"] != "<f2" or said["fortran_order"] or len(said["shape"]) != 2:
            raise ValueError(f"expected two-dimensional float16 in row order, got {said}")
        return {"rows": said["shape"][0], "dim": said["shape"][1], "at": 8 + wide + length, "step": 2 * said["shape"][1]}
    if kind == "csr":
        rows, _, entries = (int(x) for x in _numbers(f, "<i8", 3, 0))
        return {"rows": rows, "entries": entries, "at": 24 + 8 * (rows + 1)}
    rows, other = (int(x) for x in _numbers(f, "<i4" if kind == "range_truth" else "<u4", 2, 0))
    if kind == "range_truth":
        return {"rows": rows, "entries": other, "at": 8 + 4 * rows}
    if kind == "truth":
        return {"rows": rows, "entries": rows * other, "k": other, "at": 8}
    return {"rows": rows, "dim": other, "at": 8, "step": other * np.dtype(_NUMBERS[kind]).itemsize}


def _splits(f, kind: str, shape: dict, lo: int, hi: int, split: int) -> Iterator[tuple[int, int, int]]:
    """(row, row, first entry) of ranges of about ``split`` bytes between two rows."""
    if kind in ("csr", "range_truth"):
        ahead, entry, begun = 0, None, lo
        for a in range(0 if kind == "range_truth" else lo, hi, 1 << 18):
            b = min(hi, a + (1 << 18))
            if kind == "csr":
                ends = _numbers(f, "<i8", b - a + 1, 24 + 8 * a)
            else:
                ends = ahead + np.r_[0, np.cumsum(_numbers(f, "<i4", b - a, 8 + 4 * a), dtype=np.int64)]
                ahead = int(ends[-1])
            for row in range(max(a, lo), b):
                entry = int(ends[row - a]) if entry is None else entry
                if row > begun and 8 * (ends[row + 1 - a] - entry) > split:
                    yield begun, row, entry
                    begun, entry = row, int(ends[row - a])
        if entry is not None:
            yield begun, hi, entry
        return
    step = 8 * shape["k"] if kind == "truth" else shape["step"]
    rows = max(1, split // max(1, step))
    for a in range(lo, hi, rows):
        yield a, min(hi, a + rows), a * shape.get("k", 0)


def _listed(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values).cast(kind))


def read_rows(f, kind: str, part: Rows, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns ``names`` of a range of rows; bytes of others aren't read."""
    shape, entry = part.shape, part.entry
    for a in range(part.lo, part.hi, BATCH_ROWS):
        b = min(part.hi, a + BATCH_ROWS)
        n = b - a
        columns = {"id": lambda a=a, b=b: pa.array(np.arange(a, b, dtype=np.int64) + part.first)}
        if kind in _NUMBERS:
            dim, step = shape["dim"], shape["step"]

            def vec(a=a, n=n):
                raw = np.frombuffer(f.read_at((n - 1) * step + dim * np.dtype(_NUMBERS[kind]).itemsize, shape["at"] + a * step), np.uint8)
                if kind == "bvecs":
                    raw = np.r_[np.zeros(4, np.uint8), raw].reshape(n, step)[:, 4:]
                return _listed(np.ascontiguousarray(raw).reshape(-1).view(_NUMBERS[kind]).astype(np.float32), np.arange(n + 1) * dim, pa.float32())

            columns["vec"] = vec
        else:
            first, second, ids, values = _LISTS[kind]
            if kind == "csr":
                ends = _numbers(f, "<i8", n + 1, 24 + 8 * a)
            elif kind == "truth":
                ends = (a + np.arange(n + 1)) * shape["k"]
            else:
                ends = entry + np.r_[0, np.cumsum(_numbers(f, "<i4", n, 8 + 4 * a), dtype=np.int64)]
            entry, lengths = int(ends[-1]), ends - ends[0]
            at = shape["at"] + 4 * int(ends[0])
            columns[first] = lambda at=at, o=lengths: _listed(_numbers(f, ids, int(o[-1]), at), o, pa.int32() if kind == "csr" else pa.int64())
            columns[second] = lambda at=at, o=lengths: _listed(_numbers(f, values, int(o[-1]), at + 4 * shape["entries"]), o, pa.float32())
        yield pa.RecordBatch.from_arrays([columns[c]() for c in names], names)


class Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.kind, self.names = options["path"], options["kind"], schema.names
        if unknown := set(self.names) - set(schema_of(self.kind).names):
            raise ValueError(f"{self.kind} files have no columns {sorted(unknown)}")
        self.split, self.offset = int(options.get("splitbytes", SPLIT_BYTES)), int(options.get("idoffset", 0))
        self.least, self.most = None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of the id choose rows before anything is read; all other filters are left to Spark."""
        for x in filters:
            if getattr(x, "attribute", None) != ("id",) or not isinstance(x, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNotNull)):
                yield x
                continue
            if isinstance(x, IsNotNull):
                continue
            if isinstance(x, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                lo = x.value + isinstance(x, GreaterThan)
                self.least = lo if self.least is None else max(self.least, lo)
            if isinstance(x, (EqualTo, LessThan, LessThanOrEqual)):
                hi = x.value + (not isinstance(x, LessThan))
                self.most = hi if self.most is None else min(self.most, hi)

    def files(self) -> list[str]:
        where, path = store(self.path)
        if where.get_file_info(path).type == fs.FileType.File:
            return [path]
        manifest = posixpath.join(path, MANIFEST)
        if where.get_file_info(manifest).type == fs.FileType.File:
            with where.open_input_stream(manifest) as f:
                return [posixpath.join(path, x["name"]) for x in json.loads(f.read())["files"]]
        return sorted(x.path for x in where.get_file_info(fs.FileSelector(path)) if x.type == fs.FileType.File and x.path.endswith(f".{self.kind}"))

    def partitions(self) -> Sequence[InputPartition]:
        where, _ = store(self.path)
        first, out = self.offset, []
        for file in self.files():
            with where.open_input_file(file) as f:
                shape = shape_of(f, self.kind, f.size())
                lo = max(0, (self.least if self.least is not None else first) - first)
                hi = min(shape["rows"], (self.most if self.most is not None else first + shape["rows"]) - first)
                out += [Rows(file, a, b, first, shape, e) for a, b, e in (_splits(f, self.kind, shape, lo, hi, self.split) if lo < hi else ())]
            first += shape["rows"]
        return out or [Rows("", 0, 0, 0, {})]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition.lo < partition.hi:
            where, _ = store(self.path)
            with where.open_input_file(partition.file) as f:
                yield from read_rows(f, self.kind, partition, self.names)


def encode(kind: str, batch: pa.Table) -> bytes:
    """A file's bytes. Nulls have no place in these formats, nor numbers that its type can't hold."""
    n = batch.num_rows
    names = ["vec"] if kind in _NUMBERS else list(_LISTS[kind][:2])
    lists = [batch.column(c).combine_chunks() for c in names]
    flat = [x.flatten() for x in lists]
    if any(x.null_count for x in (*lists, *flat)):
        raise ValueError(f"a null in a {kind} file")
    lengths = np.diff(lists[0].offsets.to_numpy())
    if kind in _NUMBERS:
        if len(set(lengths.tolist())) > 1:
            raise ValueError(f"vectors of different dimensions in a {kind} file")
        values = flat[0].to_numpy(zero_copy_only=False)
        v = values.astype(_NUMBERS[kind]).reshape(n, -1)
        if kind in ("u8bin", "i8bin", "bvecs") and (v.reshape(-1) != values).any():
            raise ValueError(f"not whole numbers of one byte for a {kind} file")
        dim = v.shape[1] if n else 0
        if kind == "bvecs":
            return np.hstack([np.full((n, 1), dim, "<i4").view(np.uint8), v]).tobytes()
        if kind == "npy":
            head = f"{{'descr': '<f2', 'fortran_order': False, 'shape': ({n}, {dim}), }}".encode()
            head += b" " * (-(len(head) + 11) % 64) + b"\n"
            return b"\x93NUMPY\x01\x00" + len(head).to_bytes(2, "little") + head + v.tobytes()
        return np.array([n, dim], "<u4").tobytes() + v.tobytes()
    if (np.diff(lists[1].offsets.to_numpy()) != lengths).any():
        raise ValueError(f"lists of a row differ in length in a {kind} file")
    ids, values = (x.to_numpy(zero_copy_only=False) for x in flat)
    held = ids.astype(_LISTS[kind][2])
    if (held != ids).any():
        raise ValueError(f"ids of over 32 bits in a {kind} file")
    body = held.tobytes() + values.astype("<f4").tobytes()
    if kind == "truth":
        if len(set(lengths.tolist())) > 1:
            raise ValueError("queries with different numbers of neighbours")
        return np.array([n, lengths[0] if n else 0], "<u4").tobytes() + body
    if kind == "range_truth":
        return np.array([n, len(ids)], "<i4").tobytes() + lengths.astype("<i4").tobytes() + body
    return np.array([n, int(ids.max()) + 1 if len(ids) else 0, len(ids)], "<i8").tobytes() + np.r_[0, np.cumsum(lengths)].astype("<i8").tobytes() + body


@dataclass
class Written(WriterCommitMessage):
    partition: int
    files: list


class Writer(DataSourceArrowWriter):
    """Tasks write files under names of their own; those that the manifest lists are the table, so what a dead task left isn't seen."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.kind, self.overwrite = options["path"], options["kind"], overwrite
        self.bytes = int(options.get("filebytes", FILE_BYTES))
        schema_of(self.kind)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        where, path = store(self.path)
        where.create_dir(path, recursive=True)
        held, size, files, part = [], 0, [], TaskContext.get().partitionId()

        def flush() -> None:
            nonlocal held, size
            table = pa.Table.from_batches(held)
            name = f"part-{part:06d}-{len(files):04d}-{uuid.uuid4().hex}.{self.kind}"
            files.append({"name": name, "rows": table.num_rows})
            with where.open_output_stream(posixpath.join(path, name)) as f:
                f.write(encode(self.kind, table))
            held, size = [], 0

        try:
            for batch in iterator:
                if batch.num_rows:
                    held.append(batch)
                    size += batch.nbytes
                if size >= self.bytes:
                    flush()
            if held:
                flush()
        except BaseException:
            self._delete([x["name"] for x in files])
            raise
        return Written(part, files)

    def _delete(self, names: list[str]) -> None:
        where, path = store(self.path)
        for name in names:
            if where.get_file_info(posixpath.join(path, name)).type == fs.FileType.File:
                where.delete_file(posixpath.join(path, name))

    def commit(self, messages: list[Written | None]) -> None:
        where, path = store(self.path)
        manifest = posixpath.join(path, MANIFEST)
        before = []
        if where.get_file_info(manifest).type == fs.FileType.File:
            with where.open_input_stream(manifest) as f:
                before = json.loads(f.read())["files"]
        new = [x for m in sorted((m for m in messages if m), key=lambda m: m.partition) for x in m.files]
        where.create_dir(path, recursive=True)
        aside = f"{manifest}.{uuid.uuid4().hex}"
        with where.open_output_stream(aside) as f:
            f.write(json.dumps({"kind": self.kind, "files": new if self.overwrite else before + new}).encode())
        where.move(aside, manifest)
        if self.overwrite:
            self._delete([x["name"] for x in before])

    def abort(self, messages: list[Written | None]) -> None:
        self._delete([x["name"] for m in messages if m for x in m.files])


class VectorFiles(DataSource):
    """``spark.read.format("vector_files")`` with the options path, kind, idOffset and splitBytes, and ``df.write.format("vector_files")``
    with path, kind and fileBytes, once ``register`` was called. A schema of fewer columns reads only their bytes."""

    @classmethod
    def name(cls) -> str:
        return "vector_files"

    def schema(self) -> StructType:
        return schema_of(self.options["kind"])

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VectorFiles)


def read_vector_files(spark: SparkSession, path: str, kind: str, columns: list[str] | None = None, id_offset: int = 0, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(id, vec), or (id, neighbors, distances), or (id, indices, values) of a file, a folder of files or a table that ``write_vector_files`` made.

    Ids count rows from ``id_offset`` on, files in their order. A large file is read by many tasks, of about ``split_bytes`` each, planned
    from its header; ``columns`` are those whose bytes are read, and filters on id choose rows before the read. Files of no rows give none.
    """
    register(spark)
    fields = {f.name: f for f in schema_of(kind).fields}
    schema = StructType([fields[c] for c in columns or fields])
    return spark.read.format("vector_files").schema(schema).option("kind", kind).option("idOffset", id_offset).option("splitBytes", split_bytes).load(path)


def write_vector_files(df: DataFrame, path: str, kind: str, mode: str = "append", file_bytes: int = FILE_BYTES) -> None:
    """Write the list columns of ``kind`` in the order of the rows of ``df``, each task its own files of about ``file_bytes``.

    Rows become visible all at once, with the manifest; a failed job or task leaves none. ``mode`` is append or overwrite. A null, a number
    that the format can't hold, or lists of unequal length where it wants equal ones, is an error.
    """
    register(df.sparkSession)
    names = [c for c in schema_of(kind).names if c != "id"]
    df.select(*names).write.format("vector_files").option("kind", kind).option("fileBytes", file_bytes).mode(mode).save(path)
