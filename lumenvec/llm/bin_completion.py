"""Best-fit packing into as few sequences as possible: bin completion branch-and-bound over the histogram of lengths."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenvec.llm.common import materialize, maybe_broadcast, small_batches
from lumenvec.llm.kernels import release
from lumenvec.llm.packing import PATTERN

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
CAPACITY = 2048
#: The id that ends a document.
END_ID = 0
CACHE_WORDS = 400_000
#: Effort of the search: bins filled, fillings compared at one node, steps to enumerate them. It bounds time, not what is packed.
NODES, FILLINGS, STEPS = 20_000, 24, 2_000
#: Texts are encoded whole if a space has other white space beside it.
_TOUCHING = re.compile(r"\s | \s")


def fast_encoder(model: str):
    """The byte pair merges of a byte-level ``tokenizers`` file as a ``tiktoken`` encoding with the same ids, or None where ids aren't in the order of merges."""
    import json

    import tiktoken

    said = json.loads(model)
    vocabulary, merges = said["model"]["vocab"], said["model"].get("merges", [])
    ordered = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" "))) for m in merges]
    split = said.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not said.get("normalizer")
    if not plain or said["model"]["type"] != "BPE" or None in ordered or ordered != sorted(ordered) or len(vocabulary) != 256 + len(set(ordered)):
        return None
    # Fixed value of byte-level vocabularies: bytes that print stand for themselves, the others in turn for the characters from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items()}
    return tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class WordEncoder:
    """Ids of a ``tokenizers`` file as little-endian uint32. Words between single spaces are encoded once and kept; the ids are those of the whole text."""

    def __init__(self, model: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.fast = Tokenizer.from_str(model), fast_encoder(model)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.lengths[i] = len(token)  # byte-level: a character of a token is a byte of the text
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def ordinary(self, text: str) -> np.ndarray:
        """Ids of a text without special tokens' strings."""
        return np.array(self.fast.encode_ordinary(text), "<u4") if self.fast else self.ids(text)

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.ids(text).tobytes()
        if _TOUCHING.search(text):
            return self.ordinary(text).tobytes()
        first, *words = text.split(" ")
        known = self.words
        new = list(set(words).difference(known))
        if not new:
            return self.ordinary(first).tobytes() + b"".join([known[w] for w in words])
        ids = self.ordinary(" " + " ".join(new))
        cuts = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(w.encode()) + 1 for w in new])) + 1
        raw, at, fresh = ids.tobytes(), 0, {}
        for w, cut in zip(new, (4 * cuts).tolist(), strict=True):
            fresh[w] = raw[at:cut]
            at = cut
        if len(known) < CACHE_WORDS:
            known.update(fresh)
        return self.ordinary(first).tobytes() + b"".join([known.get(w) or fresh[w] for w in words])


_ENCODERS: dict[int, WordEncoder] = {}

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


def _pieces(model: str, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(model)
        if key not in _ENCODERS:
            _ENCODERS[key] = WordEncoder(model)
        encoder, part, seen = _ENCODERS[key], TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = np.array([END_ID], "<u4").tobytes()
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * keep_ids
        names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * keep_ids
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                cols: list[list] = [[] for _ in names]
                for doc, text in zip(batch.column(0).slice(lo, 256).to_pylist(), batch.column(1).slice(lo, 256).to_pylist(), strict=True):
                    raw = (encoder.encode(text) if text else b"") + end
                    n = len(raw) // 4
                    at = 0
                    for k in range(-(-n // capacity)):
                        to = n - (-(-n // capacity) - 1 - k) * capacity
                        ids = raw[4 * at : 4 * to]
                        row = [doc, k, at, to - at, zlib.crc32(ids), part, seen[to - at]] + [ids] * keep_ids
                        seen[to - at] += 1
                        at = to
                        for c, v in zip(cols, row, strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)
        release()

    return run


def fewest(counts: np.ndarray, capacity: int) -> int:
    """A lower bound on the bins for ``counts[size]`` items of each size: of those over capacity - k none shares a bin with one of k or more,
    and what bins of the others over half leave must hold the rest; the best k counts."""
    sizes = np.arange(capacity + 1)
    n, mass = np.cumsum(counts), np.cumsum(counts * sizes)
    k = np.arange(capacity // 2 + 1)
    half = capacity // 2
    alone, halves = n[-1] - n[capacity - k], n[capacity - k] - n[half]
    below = np.where(k > 0, mass[np.maximum(k - 1, 0)], 0)
    spare = halves * capacity - (mass[capacity - k] - mass[half])
    rest = np.maximum(0, mass[half] - below - spare)
    return int((alone + halves + -(-rest // capacity)).max())


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit-decreasing of ``counts[size]`` items: (sizes of a bin, number of such bins). Equal bins are handled as one."""
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    mask, done = 0, []
    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        while left:
            above = mask >> size
            if above:
                room = size + (above & -above).bit_length() - 1
                held, bins = rooms[room].pop()
                if not rooms[room]:
                    mask ^= 1 << room
            else:
                room, held, bins = capacity, (), left
            each = min(room // size, left)
            used = min(bins, left // each)
            if used < bins and held:
                rooms.setdefault(room, []).append((held, bins - used))
                mask |= 1 << room
            left -= used * each
            held, room = held + (size,) * each, room - each * size
            if room:
                rooms.setdefault(room, []).append((held, used))
                mask |= 1 << room
            else:
                done.append((held, used))
    return done + [x for group in rooms.values() for x in group]


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the items ``b`` (descending) can be dealt into bins of the sizes ``a``: then filling with ``a`` is at least as good. Not looked into beyond 16 items."""
    if not b or len(b) > 16:
        return not b
    tried = set()
    for i, room in enumerate(a):
        if room >= b[0] and room not in tried:
            tried.add(room)
            if dominates((*a[:i], room - b[0], *a[i + 1 :]), b[1:]):
                return True
    return False


class Completion:
    """Bin completion: the largest item that is left gets its bin, which is filled in each undominated way in turn, as often as the counts allow.

    Fillings are tried from the least waste and the fewest items on; a branch ends where its waste, or the bound ``fewest`` of what is left,
    shows that it can't beat the best solution known. That is best-fit-decreasing at first; dead ends are completed by best fit too. The
    search ends at the lower bound, or after ``nodes`` bins.
    """

    def __init__(self, counts: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES) -> None:
        self.capacity, self.nodes = capacity, nodes
        self.left = [int(n) for n in counts]
        self.total = sum(size * n for size, n in enumerate(self.left))
        self.bound = fewest(np.array(self.left), capacity)
        self.mask = self.mirror = 0
        for size, n in enumerate(self.left):
            if n:
                self._flip(size)
        self.best = best_fit(np.array(self.left), capacity)
        self.bins = sum(n for _, n in self.best)

    def _flip(self, size: int) -> None:
        self.mask ^= 1 << size
        self.mirror ^= 1 << (self.capacity - size)

    def _take(self, size: int, n: int) -> None:
        before = self.left[size]
        self.left[size] = before - n
        if (before == 0) != (before == n):
            self._flip(size)

    def _largest(self, most: int) -> int:
        return (self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1

    def _spare(self, waste: int) -> int:
        """Tokens that may still be wasted by a solution that is better than the best known."""
        return (self.bins - 1) * self.capacity - self.total - waste

    def _pair(self, room: int, top: int) -> Iterator[tuple[int, int]]:
        """Pairs of items that fill ``room``, none over ``top``, the most unequal first."""
        pairs = self.mask & (self.mirror >> (self.capacity - room)) & ((1 << (top + 1)) - 1) & ~((1 << -(-room // 2)) - 1)
        while (a := pairs.bit_length() - 1) > 0:
            pairs ^= 1 << a
            if a != room - a or self.left[a] > 1:
                yield a, room - a

    def fillings(self, room: int, waste: int) -> list[tuple[int, ...]]:
        """Undominated ways to fill ``room`` from what is left, of at most ``waste`` free tokens, best first."""
        if room == 0 or self.mask >> room & 1:
            return [(room,) if room else ()]  # one item that fills it dominates all others
        found: list[tuple[int, ...]] = []
        self._enumerate(room, room, (), waste, found, [STEPS])
        found.sort(key=lambda f: (room - sum(f), len(f), [-x for x in f]))
        kept: list[tuple[int, ...]] = []
        for f in found:
            if not any(dominates(k, f) for k in kept):
                kept.append(f)
        return kept

    def _enumerate(self, room: int, top: int, held: tuple[int, ...], waste: int, found: list, steps: list[int]) -> None:
        """Maximal fillings by descending sizes; those that end with an exact item or pair come without a walk."""
        if (size := self._largest(room)) <= 0:
            if room <= waste:
                found.append(held)
            return
        size = min(size, self._largest(top))
        while size > 0:
            for k in range(min(self.left[size], room // size), 0, -1):
                if steps[0] <= 0 or len(found) >= FILLINGS:
                    return
                steps[0] -= 1
                rest, now = room - k * size, held + (size,) * k
                self._take(size, k)
                if rest == 0 or (rest < size and self.mask >> rest & 1):
                    found.append((*now, *([rest] if rest else [])))
                elif pair := next(self._pair(rest, size - 1), None):
                    found.append((*now, *pair))
                else:
                    self._enumerate(rest, size - 1, now, waste, found, steps)
                self._take(size, -k)
            size = self._largest(size - 1)

    def _ways(self, room: int, waste: int) -> Iterator[tuple[int, ...]]:
        """Pairs that fill the room, then all other fillings that none of them dominates; these are looked for only if a search comes back."""
        pairs = [] if self.mask >> room & 1 else [p for p, _ in zip(self._pair(room, room), range(FILLINGS), strict=False)]
        yield from pairs
        for f in self.fillings(room, self._spare(waste)):
            if not any(dominates(p, f) for p in pairs):
                yield f

    def _moves(self, waste: int) -> Iterator[tuple[dict[int, int], tuple[int, ...], int, int]]:
        """(items, bin, times, waste of one) for the bin of the largest item: as often as counts and waste allow, then once."""
        big = self._largest(self.capacity)
        self._take(big, 1)
        ways = self._ways(self.capacity - big, waste)
        while (way := next(ways, None)) is not None:
            self._take(big, -1)
            bin_ = (big, *way)
            need: dict[int, int] = {}
            for size in bin_:
                need[size] = need.get(size, 0) + 1
            free = self.capacity - sum(bin_)
            most = min(self.left[s] // k for s, k in need.items())
            if free:
                most = min(most, max(1, self._spare(waste) // free))
            for times in dict.fromkeys((most, 1)):
                yield need, bin_, times, free
            self._take(big, 1)
        self._take(big, -1)

    def _fill(self, need: dict[int, int], times: int) -> None:
        for size, k in need.items():
            self._take(size, k * times)

    def _offer(self, path: list, used: int) -> None:
        """The bins of ``path`` and best fit for the rest become the best solution, if they are fewer."""
        rest = best_fit(np.array(self.left), self.capacity)
        bins = used + sum(n for _, n in rest)
        if bins < self.bins:
            self.best, self.bins = [(f, n) for f, n, _ in path] + rest, bins

    def solve(self) -> list[tuple[tuple[int, ...], int]]:
        """(sizes of a bin, number of such bins); together they hold all items."""
        path: list[tuple[tuple[int, ...], int, dict[int, int]]] = []
        spent = offered = 0
        stack = [(self._moves(0), 0, 0)] if self.mask else []
        while stack and self.bins > self.bound and spent < self.nodes:
            moves, used, waste = stack[-1]
            move = next(moves, None)
            if move is None:
                if spent - offered > 16:
                    self._offer(path, used)
                    offered = spent
                stack.pop()
                if path:
                    _, times, need = path.pop()
                    self._fill(need, -times)
                continue
            need, bin_, times, free = move
            spent += 1
            if free * times > self._spare(waste):
                continue
            self._fill(need, times)
            now = used + times
            if self.mask and now + fewest(np.array(self.left), self.capacity) < self.bins:
                path.append((bin_, times, need))
                stack.append((self._moves(waste + free * times), now, waste + free * times))
                continue
            if not self.mask and now < self.bins:
                self.best, self.bins = [(f, n) for f, n, _ in path] + [(bin_, times)], now
            self._fill(need, -times)
        if self.bins > self.bound and path:
            self._offer(path, stack[-1][1])
        return self.best


def slots(bins: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, times, sequence, offset): pieces lo to hi of a length go to ``times`` sequences from ``sequence`` on, round by round,
    each round ``length`` behind the one before, the first at ``offset``."""
    rows, taken, sequence = [], {}, 0
    for sizes, times in bins:
        offset = 0
        for size in sorted(set(sizes), reverse=True):
            k, lo = sizes.count(size), taken.get(size, 0)
            rows.append((size, lo, lo + k * times, times, sequence, offset))
            taken[size] = lo + k * times
            offset += k * size
        sequence += times
    return rows


def pack_sequences(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, nodes: int = NODES, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset), and its ``ids`` (little-endian uint32) if ``keep_ids``.

    A document is its ids and the id 0. Those of more than ``capacity`` ids are cut into pieces of ``capacity``, the first of which may be
    shorter; all others are one piece. Sequences hold at most ``capacity`` ids, gapless from 0, and are as few as the search finds.

    What the search needs is the number of pieces of each length, which is at most ``capacity`` rows whatever the size of ``docs``; its
    result says how many sequences are filled by which lengths. Pieces are numbered within their length by task and place, without a sort
    of pieces, and find their sequence by that number. Texts never leave the task that encodes them. Which of several pieces of one length
    goes where depends on the partitions of ``docs``; the number of sequences doesn't.

    Null and empty texts are the one id 0; null ids stay null; repeated rows are documents of their own; an empty table gives an empty
    result; other columns are not looked at. The tokenizer's file is read on the driver and shipped with the tasks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = materialize(rows.mapInArrow(_pieces(Path(tokenizer).read_text(encoding="utf-8"), capacity, keep_ids), PIECES + ", ids binary" * keep_ids), "pieces")
    dealt = materialize(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for r in dealt.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row per length
        counts[r["length"]] = r["n"]
    plan = slots(Completion(counts, capacity, nodes).solve())
    wanted = spark.createDataFrame(plan, "length long, lo long, hi long, times long, first_sequence long, first_offset long")
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = pieces.join(maybe_broadcast(before, dealt.count()), ["length", "part"]).withColumn("number", F.col("place") + F.col("before"))
    placed = numbered.join(maybe_broadcast(wanted, len(plan)), "length").where("number >= lo and number < hi").withColumn("turn", F.col("number") - F.col("lo"))
    sequence = F.col("first_sequence") + F.col("turn") % F.col("times")
    offset = F.col("first_offset") + F.col("length") * F.floor(F.col("turn") / F.col("times"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), offset.cast("long").alias("offset"), *["ids"] * keep_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, doc_ids, cu_lengths, input_ids) of ``pack_sequences(..., keep_ids=True)``: the sequences' own ids, end to end.

    A group is one sequence, so it has at most ``capacity`` pieces and ids.
    """
    held = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids"))).alias("p"))
    joined = F.expr("unhex(array_join(transform(p, x -> hex(x.ids)), ''))")
    ends = F.expr("transform(p, x -> x.offset + x.length)")
    return held.select("sequence_id", F.element_at(ends, -1).alias("n_tokens"), F.col("p.doc_id").alias("doc_ids"), F.concat(F.array(F.lit(0).cast("long")), ends).alias("cu_lengths"), joined.alias("input_ids"))
