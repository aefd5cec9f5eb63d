"""Repeated passages by suffix sorting: bytes under a 200-byte string that also starts elsewhere are removed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenvec.llm import kernels as K
from lumenvec.llm.common import BROADCAST_ROWS, drop_scratch, hot_keys, join_hot, materialize, maybe_broadcast, small_batches
from lumenvec.llm.suffix_sort import deep_shallow

LENGTH, GRAM = 200, 64
#: Contexts that a task sorts at a time.
BATCH = 20_000
#: Anchors with more occurrences are not sorted in one task; their windows are counted by 128-bit hashes instead, spread over all tasks.
GIANT = 50_000
#: Spans in all that may be broadcast.
BROADCAST_SPANS = 2_000_000
#: Bytes of text that are scanned for anchors at a time; longer documents are scanned in overlapping pieces.
PIECE = 1 << 18
_P = 0xD1342543DE82EF95
_P_INVERSE = pow(_P, -1, 2**64)
_INVERSES = np.cumprod(np.concatenate([np.ones(1, K.U), np.full(2 * PIECE, K.U(_P_INVERSE))]))


def _gram_hashes(data: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """A hash for each start of ``width`` bytes, from prefix sums of a polynomial modulo 2**64."""
    n = len(data)
    values = K._BYTE[data ^ np.uint8(salt)] * K._powers(n)[:n]
    total = np.zeros(n + 1, K.U)
    np.cumsum(values, out=total[1:])
    return K.mix((total[width:] - total[:-width]) * _INVERSES[: n - width + 1])


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchors of a run of bytes: (hash, position, least d, most d).

    The window of ``length`` bytes that starts at s is anchored at the leftmost of its grams with the least hash, d bytes behind s. That
    depends on the window's bytes alone, so equal windows have equal anchors at equal d. An anchor serves a run of neighbouring windows.
    """
    w = length - gram + 1
    h = _gram_hashes(data, gram)
    v = (h & K.U(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=K.U)
    span = 1
    while span * 2 <= w:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    if span < w:
        v = np.minimum(v[: len(v) - (w - span)], v[w - span :])
    at = (v & K.U(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    pos = at[first]
    return h[pos].view(np.int64), pos, pos - last, pos - first


def periodic_runs(data: np.ndarray, hashes: np.ndarray, pos: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of stretches that repeat at a period below a window's grams, found by anchors of one hash in a row.

    They are at least a window and a period long, so each of their windows occurs again a period before or behind it.
    """
    same = np.flatnonzero(hashes[1:] == hashes[:-1])
    out: list[tuple[int, int, int]] = []
    for i in same.tolist():
        p, at = int(pos[i + 1] - pos[i]), int(pos[i])
        if out and out[-1][0] <= at and at + p < out[-1][1]:
            continue  # inside a stretch that is known
        step = 1 << 12
        lo, hi = at, at
        while hi < len(data) - p:  # forwards, then backwards, to where a byte isn't that of a period before
            part = data[hi : min(hi + step, len(data) - p)] != data[hi + p : min(hi + step, len(data) - p) + p]
            if part.any():
                hi += int(part.argmax())
                break
            hi += len(part)
            step *= 2
        step = 1 << 12
        while lo > 0:
            a = max(0, lo - step)
            part = (data[a:lo] != data[a + p : lo + p])[::-1]
            if part.any():
                lo -= int(part.argmax())
                break
            lo = a
            step *= 2
        if hi - lo >= length:
            out.append((lo, hi + p, p))
    return out


def without_runs(hashes: np.ndarray, pos: np.ndarray, dlo: np.ndarray, dhi: np.ndarray, runs: list[tuple[int, int, int]], length: int) -> tuple[np.ndarray, ...]:
    """Anchors without the windows of periodic stretches but for their first period's, which stand for all as occurrences."""
    for start, end, p in runs:
        first, last = pos - dhi, pos - dlo  # windows of an anchor
        a, b = start + p, end - length
        touched = (first <= b) & (last >= a)
        if not touched.any():
            continue
        before, behind = touched & (first < a), touched & (last > b)
        parts = [(hashes[~touched], pos[~touched], dlo[~touched], dhi[~touched]), (hashes[before], pos[before], pos[before] - (a - 1), dhi[before]), (hashes[behind], pos[behind], dlo[behind], pos[behind] - (b + 1))]
        hashes, pos, dlo, dhi = (np.concatenate(x) for x in zip(*parts, strict=True))
    return hashes, pos, dlo, dhi


def _scan(length: int, gram: int):
    """(k1, k2, hash, spot, runs): the anchors of each text as lists, a spot packing position, least and most d; starts and ends of periodic stretches."""
    longs = pa.list_(pa.int64())
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("hash", longs), ("spot", longs), ("runs", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(2))
            at = np.flatnonzero(np.diff(offsets) >= length)
            hashes, spots, ends, stretches = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [0], []
            for i in at.tolist():
                doc, n = data[offsets[i] : offsets[i + 1]], 0
                stretches.append([])
                for lo in range(0, len(doc) - length + 1, PIECE):
                    piece = doc[lo : lo + PIECE + length - 1]
                    h, pos, dlo, dhi = anchors(piece, length, gram)
                    if (h[1:] == h[:-1]).any() and (runs := periodic_runs(piece, h, pos, length)):
                        h, pos, dlo, dhi = without_runs(h, pos, dlo, dhi, runs, length)
                        stretches[-1] += [lo + x for run in runs for x in run[:2]]
                    hashes.append(h)
                    spots.append((pos + lo) << 16 | dlo << 8 | dhi)
                    n += len(h)
                ends.append(ends[-1] + n)
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x))) for x in (hashes, spots)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), *lists, pa.array(stretches, longs)], schema=schema)
        K.release()

    return run


#: Columns of the bytes around anchors; ``copies`` is the number of rows that have the text.
CONTEXT = "hash long, k1 long, k2 long, copies long, spot long, context binary"


def _contexts(length: int):
    """The bytes of all windows of each anchor, from (k1, k2, copies, text, hash list, spot list)."""
    schema = pa.schema([("hash", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("copies", pa.int64()), ("spot", pa.int64()), ("context", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(3))
            raw = data.tobytes()
            hashes, spots, counts = batch.column(4).flatten(), batch.column(5).flatten().to_numpy(zero_copy_only=False), batch.column(4).value_lengths().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), counts)
            for lo in range(0, len(spots), 20_000):
                part, doc = spots[lo : lo + 20_000], owner[lo : lo + 20_000]
                pos, dlo, dhi = part >> 16, part >> 8 & 255, part & 255
                a, b = offsets[doc] + pos - dhi, offsets[doc] + pos - dlo + length
                owned = [batch.column(j).take(pa.array(doc)) for j in range(3)]
                yield pa.RecordBatch.from_arrays([hashes.slice(lo, len(part)), *owned, pa.array(part), pa.array([raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())], schema=schema)

    return run


def _windows(length: int):
    """(w1, w2, k1, k2, copies, start) for each window of an anchor: 128-bit hashes of their bytes."""
    schema = pa.schema([(c, pa.int64()) for c in ("w1", "w2", "k1", "k2", "copies", "start")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                contexts = part.column(5).to_pylist()
                sizes = np.array([len(c) - length + 1 for c in contexts])
                # contexts end to end; windows that reach into the next one are left out
                flat = np.frombuffer(b"".join(contexts), np.uint8)
                begin = np.cumsum(sizes + length - 1) - sizes - length + 1
                inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                at = np.repeat(begin, sizes) + inner
                w1, w2 = (_gram_hashes(flat, length, salt)[at] for salt in (0, 0x5A))
                spot = part.column(4).to_numpy()
                start = np.repeat((spot >> 16) - (spot & 255), sizes) + inner
                own = [pa.array(np.repeat(part.column(j).to_numpy(), sizes)) for j in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays([pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), *own, pa.array(start)], schema=schema)

    return run


def repeated_spans(group: np.ndarray, copies: np.ndarray, spot: np.ndarray, contexts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, start, end) of runs of windows that occur more than once among whole groups of contexts; place is that of the context.

    Equal contexts are one class; a class of two copies is repeated throughout. Of the others, the bytes right of the anchor and those left of it
    (backwards) are sorted deep-shallow. Two occurrences share the window d bytes before the anchor iff their right common prefix reaches
    length - d and their left one d: the sorted common prefixes give classes for each d, and a class pair held twice is a repeat.
    """
    seen: dict[tuple, int] = {}
    cls = np.array([seen.setdefault(x, len(seen)) for x in zip(group.tolist(), (spot & 0xFFFF).tolist(), contexts, strict=True)], np.int64)
    first = np.full(len(seen), -1, np.int64)
    first[cls[::-1]] = np.arange(len(cls))[::-1]
    many = np.bincount(cls, copies, len(seen)) > 1
    g = group[first]
    dlo, dhi = (spot[first] >> 8 & 255), (spot[first] & 255)
    w = length - gram + 1
    covered = np.zeros((len(seen), w), bool)
    _, g_index, g_count = np.unique(g, return_inverse=True, return_counts=True)
    work = np.flatnonzero(g_count[g_index] > 1)
    if len(work):
        right, left = np.zeros((len(work), length), np.uint8), np.zeros((len(work), w), np.uint8)
        for i, c in enumerate(work.tolist()):
            text, d = np.frombuffer(contexts[first[c]], np.uint8), int(dhi[c])
            right[i, : len(text) - d] = text[d:]
            left[i, :d] = text[:d][::-1]
        gw = g_index[work]
        (ro, rl), (lo_, ll) = deep_shallow(right, gw, gram // 8 + 4), deep_shallow(left, gw, 3)
        rc, lc = np.empty(len(work), np.int64), np.empty(len(work), np.int64)
        edge = np.r_[True, np.diff(gw[ro]) != 0]
        edge_l = np.r_[True, np.diff(gw[lo_]) != 0]
        for d in range(w):
            valid = np.flatnonzero((dlo[work] <= d) & (d <= dhi[work]))
            if len(valid) < 2:
                continue
            rc[ro] = np.cumsum(edge | (rl < length - d))
            lc[lo_] = np.cumsum(edge_l | (ll < d))
            pair = rc[valid] * (len(work) + 1) + lc[valid]
            order = np.argsort(pair, kind="stable")
            same = pair[order][1:] == pair[order][:-1]
            hit = np.r_[False, same] | np.r_[same, False]
            covered[work[valid[order[hit]]], d] = True
    ds = np.arange(w)
    covered[many] = (dlo[many][:, None] <= ds) & (ds <= dhi[many][:, None])
    edges = np.diff(np.pad(covered, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    c1, from_d = np.nonzero(edges == 1)
    _, to_d = np.nonzero(edges == -1)
    # a class's runs of d, for each of its members
    member = np.argsort(cls, kind="stable")
    begin = np.searchsorted(cls[member], np.arange(len(seen) + 1))
    reps = np.diff(begin)[c1]
    at = member[np.repeat(begin[c1], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)]
    pos = spot[at] >> 16
    return at, pos - np.repeat(to_d - 1, reps), pos - np.repeat(from_d, reps) + length


def _sort(length: int, gram: int):
    schema = pa.schema([(c, pa.int64()) for c in ("k1", "k2", "start", "end")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def solve(rows: list[tuple]) -> pa.RecordBatch:
            hashes, k1, k2, copies, spots = (np.concatenate([x[j] for x in rows]) for j in range(5))
            at, start, end = repeated_spans(hashes, copies, spots, [c for x in rows for c in x[5]], length, gram)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[at], k2[at], start, end)], schema=schema)

        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                held.append((*(part.column(j).to_numpy(zero_copy_only=False) for j in range(5)), part.column(5).to_pylist()))
                if sum(len(x[0]) for x in held) >= BATCH:
                    h = held[-1][0]
                    cut = int(np.flatnonzero(h != h[-1])[-1]) + 1 if (h != h[-1]).any() else 0
                    if cut:
                        yield solve([*held[:-1], tuple(x[:cut] for x in held[-1])])
                        held = [tuple(x[cut:] for x in held[-1])]
                    elif len(held) > 1 and held[-2][0][-1] != h[-1]:
                        yield solve(held[:-1])
                        held = held[-1:]
        if held:
            yield solve(held)
        held = []
        K.release()

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = []
        for starts, ends in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            merged: list[int] = []
            for s, e in sorted(zip(starts, ends, strict=True)):
                if merged and s <= merged[-1]:
                    merged[-1] = max(merged[-1], e)
                else:
                    merged += [s, e]
            spans.append(merged)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.int64()))], ["k1", "k2", "spans"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    for batch in batches:
        data, offsets = K.text_buffers(batch.column(1))
        raw, out = memoryview(data), []
        for i, spans in enumerate(batch.column(2).to_pylist()):
            a, b = int(offsets[i]), int(offsets[i + 1])
            spans, at, kept = spans or [], a, []
            for s, e in zip(spans[::2], spans[1::2], strict=True):
                kept.append(raw[at : a + s])
                at = a + e
            kept.append(raw[at:b])
            whole = b"".join(kept)
            out.append((b - a, b - a - len(whole), len(spans) // 2, hashlib.sha256(whole).hexdigest(), whole))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string(), pa.binary()], strict=True))], names)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, giant: int = GIANT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept), kept being the remaining UTF-8 bytes.

    Every byte covered by a ``length``-byte string that also starts elsewhere in the corpus, in the same document or another, goes.
    Strings lie within one document, may overlap, and are judged on the input.

    Plan: (1) one pass finds content-defined anchors, about one in 69 bytes, so that equal windows have equal anchors, and equal texts
    become one with the number of their copies; (2) anchor hashes that occur once are dropped, which leaves little but true repeats;
    (3) the bytes around the others meet by anchor hash and are suffix sorted deep-shallow, which decides every window exactly, byte by
    byte; (4) spans are merged and cut from the texts. Anchors of more than ``giant`` occurrences in different texts are decided by
    counting 128-bit hashes of their windows in a distributed aggregate instead, so no group is larger than that in a task. Anchors and
    texts with over a thousandth of all rows are broadcast to their join, so that their rows stay where they are. Texts move once for
    documents with repeated anchors, and not at all for the cut if the spans may be broadcast.

    Stretches of a short period, as runs of one byte are, are found in the first pass: each of their windows occurs again a period away, so
    they go as they are, and the windows of one period stand for the others where texts meet. So a text of megabytes of one byte costs no more than
    its scan.

    Null texts are empty; texts shorter than ``length`` lose nothing unless other strings cover them, which can't be. Repeated rows,
    under one id too, are occurrences like any other, and cost no more than their number. Null ids stay. An empty table gives an empty
    result; other columns are not looked at. ``length`` - ``gram`` must be below 255.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = ["k1", "k2"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select("doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(gram), "text").alias("k2"))
    marks = materialize(rows.select(*key, "text").mapInArrow(_scan(length, gram), "k1 long, k2 long, hash array<long>, spot array<long>, runs array<long>"), "anchors")
    once = materialize(marks.groupBy(*key).agg(F.count("*").alias("copies"), F.first(F.struct("hash", "spot", "runs")).alias("x")).select(*key, "copies", "x.*"), "texts")
    flat = once.select(*key, "copies", F.explode(F.arrays_zip("hash", "spot")).alias("x")).select(*key, "copies", "x.*")
    counts = materialize(flat.groupBy("hash").agg(F.sum("copies").alias("copies"), F.count("*").alias("c")).where("copies > 1").select("hash", "c"), "hashes")
    total = once.agg(F.coalesce(F.sum(F.size("hash")), F.lit(0))).first()[0]
    mine = join_hot(flat, counts, ["hash"], hot_keys(counts, total)).groupBy(*key, "copies").agg(F.collect_list(F.struct("hash", "spot", "c")).alias("x"))
    mine = materialize(mine.select(*key, "copies", "x.hash", "x.spot", "x.c"), "repeated")
    here = rows.select(*key, "text").join(maybe_broadcast(mine.select(*key), mine.count()), key, "left_semi").dropDuplicates(key).join(mine, key)

    def around(test) -> DataFrame:
        x = F.filter(F.arrays_zip("hash", "spot", "c"), lambda x: test(x["c"]))
        some = here.withColumn("x", x).select(*key, "copies", "text", F.col("x.hash").alias("hash"), F.col("x.spot").alias("spot")).where("size(hash) > 0")
        return some.mapInArrow(_contexts(length), CONTEXT)

    spans = around(lambda c: c <= giant).repartition("hash").sortWithinPartitions("hash").mapInArrow(_sort(length, gram), "k1 long, k2 long, start long, end long")
    if not counts.where(F.col("c") > giant).isEmpty():
        windows = materialize(around(lambda c: c > giant).mapInArrow(_windows(length), "w1 long, w2 long, k1 long, k2 long, copies long, start long"), "windows")
        again = materialize(windows.groupBy("w1", "w2").agg(F.sum("copies").alias("copies"), F.count("*").alias("c")).where("copies > 1").drop("copies"), "again")
        found = join_hot(windows, again.select("w1", "w2"), ["w1", "w2"], hot_keys(again, windows.count()))
        spans = spans.unionByName(found.select(*key, "start", (F.col("start") + length).alias("end")))
    own = once.where("size(runs) > 0").select(*key, F.explode(F.expr("transform(sequence(0, size(runs) div 2 - 1), i -> named_struct('start', runs[2 * i], 'end', runs[2 * i + 1]))")).alias("r"))
    spans = spans.unionByName(own.select(*key, "r.start", "r.end"))
    merged = spans.groupBy(*key).agg(F.collect_list("start").alias("a"), F.collect_list("end").alias("b")).mapInArrow(_merge, "k1 long, k2 long, spans array<long>")
    merged = materialize(merged, "spans")
    n, size = merged.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    shape = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    cut = lambda df: df.select("doc_id", "text", "spans").mapInArrow(_cut, shape)
    if n <= BROADCAST_ROWS and size <= BROADCAST_SPANS:
        out = cut(rows.join(F.broadcast(merged), key, "left"))
    else:
        often = materialize(hot_keys(once, once.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0], "copies").select(*key), "often")
        out = cut(rows.join(F.broadcast(often), key, "left_anti").join(merged, key, "left"))
        if not often.isEmpty():
            out = out.unionByName(cut(rows.join(F.broadcast(often), key, "left_semi").join(F.broadcast(merged.join(F.broadcast(often), key, "left_semi")), key, "left")))
    drop_scratch(marks, counts)
    return out
