"""Token ids in packed matrices: best-fit-decreasing packing with a segment tree over capacities."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenvec.llm.common import small_batches
from lumenvec.llm.kernels import release

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that parts a text before byte pairs are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ROW_TOKENS = 2048
#: Tokens that are packed together: it bounds a task's memory.
POOL_TOKENS = 1 << 22
CACHE_WORDS = 400_000
#: Texts are encoded whole if a space has other white space beside it.
_TOUCHING = re.compile(r"\s | \s")


class CapacityTree:
    """Open rows by free tokens: a segment tree of counts finds the row with the least room that is enough."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = self.size + room
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of a row with the least room of at least ``need``, taken out; None if there is none."""
        i = self.size + need
        count = self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.size
        while i:
            count[i] -= 1
            i >>= 1
        return room, self.rows[room].pop()


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit-decreasing: the pieces of each row. No length is over ``capacity``; zero lengths are left out; ties go by place."""
    tree, rows = CapacityTree(capacity), []
    for piece in sorted((i for i, n in enumerate(lengths) if n), key=lambda i: (-lengths[i], i)):
        got = tree.take(lengths[piece])
        room, row = got or (capacity, len(rows))
        if got is None:
            rows.append([])
        rows[row].append(piece)
        if room > lengths[piece]:
            tree.add(room - lengths[piece], row)
    return rows


class Encoder:
    """Byte-level BPE ids as little-endian uint16. Words between single spaces are encoded once and kept; the ids are those of the whole text."""

    def __init__(self, ranks: bytes) -> None:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.lengths = np.zeros(max(table.values()) + 1, np.int64)
        for text, i in table.items():
            self.lengths[i] = len(text)
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u2").tobytes()

    def encode(self, text: str) -> bytes:
        if _TOUCHING.search(text):
            return self.whole(text)
        first, *words = text.split(" ")
        known = self.words
        new = [w for w in dict.fromkeys(words) if w not in known]
        if not new:
            return self.whole(first) + b"".join([known[w] for w in words])
        ids = np.array(self.encoding.encode_ordinary(" " + " ".join(new)), "<u2")
        ends = np.cumsum(self.lengths[ids])
        cuts = np.searchsorted(ends, np.cumsum([len(w.encode()) + 1 for w in new])) + 1
        raw, at, fresh = ids.tobytes(), 0, {}
        for w, cut in zip(new, cuts.tolist(), strict=True):
            fresh[w] = raw[2 * at : 2 * cut]
            at = cut
        if len(known) < CACHE_WORDS:
            known.update(fresh)
        return self.whole(first) + b"".join([fresh.get(w) or known[w] for w in words])


_ENCODERS: dict[int, Encoder] = {}

SHAPE = "pack_id long, n_tokens int, doc_ids array<long>, doc_rows array<long>, pieces array<int>, cu_seqlens array<int>, position_resets array<int>, input_ids binary"


def _pack_partition(ranks: bytes, row_tokens: int, pool_tokens: int, pad: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(ranks)
        if key not in _ENCODERS:
            _ENCODERS[key] = Encoder(ranks)
        encoder, part, done, seen = _ENCODERS[key], TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, int, bytes, int]] = []

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal done, held
            rows = pack([len(x[2]) // 2 for x in held], row_tokens)
            for lo in range(0, len(rows), 512):
                cols: list[list] = [[] for _ in range(8)]
                for row in rows[lo : lo + 512]:
                    segs = [held[i] for i in row]
                    cu = np.cumsum([0, *(len(x[2]) // 2 for x in segs)]).astype(np.int32)
                    ids = b"".join(x[2] for x in segs)
                    ids += np.full(row_tokens - len(ids) // 2, pad, "<u2").tobytes()
                    for c, v in zip(cols, (part << 33 | done, int(cu[-1]), [x[0] for x in segs], [x[3] for x in segs], [x[1] for x in segs], cu, cu[:-1], ids), strict=True):
                        c.append(v)
                    done += 1
                types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in SHAPE.split(", ")])
            held = []

        size = 0
        for batch in batches:
            ids = batch.column(0)
            for lo in range(0, batch.num_rows, 256):
                for doc, text in zip(ids.slice(lo, 256).to_pylist(), batch.column(1).slice(lo, 256).to_pylist(), strict=True):
                    raw = encoder.encode(text) if text else b""
                    for k, a in enumerate(range(0, len(raw), 2 * row_tokens)):
                        held.append((doc, k, raw[a : a + 2 * row_tokens], part << 33 | seen))
                        size += min(2 * row_tokens, len(raw) - a) // 2
                    seen += 1
                    if size >= pool_tokens:
                        yield from emit()
                        size = 0
        yield from emit()
        release()

    return run


def pack_documents(docs: DataFrame, row_tokens: int = ROW_TOKENS, tokenizer: str = TOKENIZER, pool_tokens: int = POOL_TOKENS, pad: int = 50256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed rows: (pack_id, n_tokens, doc_ids, doc_rows, pieces, cu_seqlens, position_resets, input_ids).

    ``input_ids`` holds ``row_tokens`` little-endian uint16 ids, padded at the end with ``pad``. Segment i of a row is piece ``pieces[i]`` of
    document ``doc_ids[i]``, the row ``doc_rows[i]`` of this job's input (ids may repeat, these don't), at [cu_seqlens[i], cu_seqlens[i + 1]); positions begin anew at each of ``position_resets``. Documents over
    ``row_tokens`` are split at that many tokens, so their pieces in order are the document's ids without loss; no special ids are added.

    Each task packs pools of at most about ``pool_tokens`` tokens of its own partition by best-fit-decreasing, so nothing is shuffled and
    memory is bounded; a lost task redoes its own partition. Which segments share a row depends on the partitions of ``docs``. Null and empty texts have no ids and are in no row. Null ids stay null in
    ``doc_ids``; repeated rows are packed as often as they come. The vocabulary, of at most 65,536 ids, is read on the driver and shipped.
    An empty table gives an empty result; other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    ranks = Path(tokenizer).read_bytes()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_pack_partition(ranks, row_tokens, pool_tokens, pad), SHAPE)


def position_ids(cu_seqlens: np.ndarray, row_tokens: int) -> np.ndarray:
    """Positions of a packed row: from 0 in each segment, and 0 over the padding."""
    out = np.zeros(row_tokens, np.int64)
    for a, b in zip(cu_seqlens[:-1], cu_seqlens[1:], strict=True):
        out[a:b] = np.arange(b - a)
    return out


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet whose id matrices are fixed-width binary."""
    packed.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
