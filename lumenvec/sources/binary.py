"""Readers of binary vector files: fbin, u8bin, i8bin, bvecs, npy halves, ground truth and sparse rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_KINDS = {"fbin": "<f4", "u8bin": "u1", "i8bin": "i1"}


def parse_bin(raw: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of a file with a header of two 32-bit numbers, rows and columns."""
    n, d = np.frombuffer(raw, "<u4", 2)
    return np.arange(n, dtype=np.int64), np.frombuffer(raw, _KINDS[kind], int(n) * int(d), 8).reshape(n, d).astype(np.float32)


def parse_bvecs(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a 32-bit dimension and so many bytes each."""
    if not raw:
        return np.zeros(0, np.int64), np.zeros((0, 0), np.float32)
    d = int(np.frombuffer(raw, "<i4", 1)[0])
    rows = np.frombuffer(raw, np.uint8).reshape(-1, d + 4)[:, 4:]
    return np.arange(len(rows), dtype=np.int64), rows.astype(np.float32)


def parse_npy(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A two-dimensional npy array of half floats."""
    import io

    a = np.load(io.BytesIO(raw), allow_pickle=False)
    if a.dtype != np.float16 or a.ndim != 2:
        raise ValueError(f"expected two-dimensional float16, got {a.dtype} with {a.ndim} dimensions")
    return np.arange(len(a), dtype=np.int64), a.astype(np.float32)


def parse_truth(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours, distances) of nearest-neighbour ground truth: header of queries and k, ids, distances."""
    n, k = (int(x) for x in np.frombuffer(raw, "<u4", 2))
    return np.frombuffer(raw, "<u4", n * k, 8).reshape(n, k).astype(np.int64), np.frombuffer(raw, "<f4", n * k, 8 + 4 * n * k).reshape(n, k)


def parse_range_truth(raw: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The same for range search, with as many results per query as there are."""
    n, total = (int(x) for x in np.frombuffer(raw, "<i4", 2))
    cuts = np.cumsum(np.frombuffer(raw, "<i4", n, 8))[:-1]
    return np.split(np.frombuffer(raw, "<i4", total, 8 + 4 * n).astype(np.int64), cuts), np.split(np.frombuffer(raw, "<f4", total, 8 + 4 * n + 4 * total), cuts)


def parse_csr(raw: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(indices, values) of each row of a sparse matrix: 64-bit rows, columns, entries; offsets; 32-bit indices; floats."""
    n, _, nnz = (int(x) for x in np.frombuffer(raw, "<i8", 3))
    ptr = np.frombuffer(raw, "<i8", n + 1, 24)
    at = 24 + 8 * (n + 1)
    return np.split(np.frombuffer(raw, "<i4", nnz, at), ptr[1:-1]), np.split(np.frombuffer(raw, "<f4", nnz, at + 4 * nnz), ptr[1:-1])


def varint(n: int) -> bytes:
    """A length as seven bits a byte, least first, the top bit set on all but the last."""
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def parse_row_binary(raw: bytes, rows: int = 10_000) -> Iterator[pd.DataFrame]:
    """(doc_id, text) rows of a 64-bit number and a string behind its length, in frames of so many."""
    at, ids, texts = 0, [], []
    while at < len(raw):
        ids.append(int.from_bytes(raw[at : at + 8], "little", signed=True))
        at, n, shift = at + 8, 0, 0
        while True:
            byte = raw[at]
            at += 1
            n |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                break
        texts.append(raw[at : at + n].decode("utf-8", "replace"))
        at += n
        if len(ids) == rows:
            yield pd.DataFrame({"doc_id": ids, "text": texts})
            ids, texts = [], []
    if ids:
        yield pd.DataFrame({"doc_id": ids, "text": texts})


def parse_arrow_stream(raw: bytes, rows: int = 32_768) -> Iterator[pd.DataFrame]:
    """The batches of an Arrow IPC stream, put together to frames of up to so many rows."""
    import pyarrow as pa

    held, n = [], 0
    with pa.ipc.open_stream(raw) as stream:
        for batch in stream:
            if held and n + batch.num_rows > rows:
                yield pa.Table.from_batches(held).to_pandas()
                held, n = [], 0
            held.append(batch)
            n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held).to_pandas()


_PARSERS = {
    **{k: (lambda raw, k=k: parse_bin(raw, k), "id long, vec array<float>") for k in _KINDS},
    "bvecs": (parse_bvecs, "id long, vec array<float>"),
    "npy": (parse_npy, "id long, vec array<float>"),
    "truth": (parse_truth, "neighbors array<long>, distances array<float>"),
    "range_truth": (parse_range_truth, "neighbors array<long>, distances array<float>"),
    "csr": (parse_csr, "indices array<int>, values array<float>"),
}


def read_vectors(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(file, row, ...) of all files under a path or glob; Spark reads the bytes, so any store will do. A file is one task's work."""
    parse, shape = _PARSERS[kind]
    names = [x.split()[0] for x in shape.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, raw in zip(pdf["path"], pdf["content"], strict=True):
                a, b = parse(bytes(raw))
                for lo in range(0, len(a), 10_000):
                    yield pd.DataFrame({"file": file, "row": np.arange(lo, min(len(a), lo + 10_000)), names[0]: list(a[lo : lo + 10_000]), names[1]: list(b[lo : lo + 10_000])})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"file string, row long, {shape}")
